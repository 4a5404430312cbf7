"""Patterns and word lists the operators depend on, in Java's regular-expression dialect.

``(?dU)`` everywhere: only a newline ends a line, and character classes are Unicode-aware.
"""

# Patterns, word lists and limits that results depend on. ------------------------

U = "(?dU)"
UM = "(?dUm)"
UI = "(?dUi)"
UMI = "(?dUmi)"
US = "(?dUs)"
USI = "(?dUsi)"

SIGNATURE_KEYS = ("signature", "docusigned by", "by", "name", "title", "date", "witness", "attest", "printed name", "print name", "its", "signed", "email", "address", "docusign envelope id", "envelope id", "acknowledged", "agreed", "accepted")

# survey
MD_HEADING = UM + r"^(#{1,6})\s+\S"
CLAUSE = UM + r'^\s*(?:\*\*)?(\d{1,2}(?:\.\d{1,3})*)\.?\s+(?=(?:\*\*)?[A-Z"(])'
BOLD_ONLY = UM + r"^\s*([*_]{2,6})([^*_\n][^\n]{2,88}?)([*_]{2,6})\s*:?\s*$"
ARTICLE = UM + r"^\s*(?:\*\*)?(?:ARTICLE|Article|SECTION|Section|ANNEX|EXHIBIT|SCHEDULE|APPENDIX)\s+([0-9IVXLC]+)"
FIELD = UM + r"^\s*([A-Z][A-Za-z /'&.-]{1,34}):\s*\S"
LABEL_ONLY = UM + r"^\s*(?:\*\*)?([A-Z0-9][^:*\n]{2,86}):(?:\*\*)?\s*$"
RESTART = UM + r'^\s*(?:\*\*)?1\.\s+[A-Z"(]'
SALUTATION = UM + r"^\s*(?:\*\*)?Dear\s+[A-Z]"
CLOSING = UMI + r"^\s*(?:\*\*)?(?:Very truly yours|Sincerely(?: yours)?|Best regards|Kind regards|Yours (?:truly|faithfully|sincerely)|Respectfully(?: yours)?|Regards)\s*,?\s*(?:\*\*)?$"

#: Regime: flags that are on.
REGIME_RULES = {
    "clauses": ("bold", "clause", "decimal", "caps", "lettered"),
    "headings": ("bold", "lettered"),
    "deck": ("bold", "blocklead", "caps", "banner", "repeats"),
    "sparse": ("bold", "label", "blocklead"),
    "fields": (),
    "labels": ("bold", "label"),
    "letter": (),
    "flat": ("bold", "clause", "decimal", "infer", "label", "caps"),
}
FLAGS = ("bold", "clause", "decimal", "infer", "label", "blocklead", "caps", "lettered", "banner", "repeats")
LABELS_BELOW_CHARS = 25_000

# masking
BLOCK = "\x00BLK\x00"
ANCHOR = U + r"<a id='[^']*'></a>\s*"
FURNITURE = (UM + r"^\s*DocuSign Envelope ID:.*$", UM + r"^\s*<!--\s*PAGE BREAK\s*-->\s*$", UM + r"^\s*Page \d+( of \d+)?\s*$")
EMPTY_VISION = U + r"<::\s*::>|<::>"
HTML_TABLE = USI + r"<table\b.*?</table>"
PIPE_TABLE = UM + r"(?:^\s*\|.*\|\s*$\n?){2,}"
VISION = US + r"<::((?:(?!::>)(?!\x00BLK\x00).)*?)::>"
MASK_TOKEN = r"MASK\d{5}"

# titles
HEADING_LINE = U + r"^(#{1,6})\s+(.*?)\s*#*$"
HEADING_HTML = UI + r"^\s*<h([1-6])\b[^>]*>(.*?)</h\1\s*>\s*$"
CLAUSE_LINE = U + r'^(?:\*\*)?\d{1,2}(?:\.\d{1,3})*\.?\s+(?:\*\*)?[A-Z"(]'
BOLD_LEAD = U + r"^([*_]{2,6})([^*_\n][^\n]{1,88}?)([*_]{2,6})(.*)$"
DECIMAL_LEAD = U + r"^(\d{1,2}(?:\.\d{1,2}){1,3})\.?\s+(\S.*)$"
NUMBER = U + r"^(\d+(?:\.\d+)*)\.?(?:\s+(.*))?$"
WORD_NUMBER = UI + r"^(?:article|section|clause|annex|exhibit|schedule)\s+(\d+(?:\.\d+)*)\b"
ALLOWED = UM + r"^\s*(?:\*\*)?(\d{1,2}\.)\s+([A-Z][A-Za-z0-9 &/\-,']{3,70}?)(?:\*\*)?\s*:?\s*$"
NUMBER_ALONE = U + r"^\s*(?:\*\*)?(\d{1,2}(?:\.\d{1,3})*)\.?(?:\*\*)?\s*$"
DIVISION_ALONE = U + r"^\s*(#{1,6}\s+)?(?:\*\*)?((?:ARTICLE|PART|CHAPTER)\s+(?:[IVXLC]{1,7}|\d{1,3}|[A-Z]))\.?(?:\*\*)?\s*[:.]?\s*$"
BARE_NUMBER = U + r"^(\d{1,3}(?:\.\d{1,3})*)\.?$"
NO_DIVISION_TITLE = UI + r"^(?:\*\*)?(?:\d|\(|ARTICLE|PART|CHAPTER|SECTION|CLAUSE|EXHIBIT|SCHEDULE|ANNEX|APPENDIX|ATTACHMENT)\b"
MASKED_BLOCK = U + r"^\(block\)\s*MASK\d{5}\s*$"
EMBEDDED_MARKUP = USI + r"(?:\\n|\n)+\s*<(?:img|svg|table|a)\b.*$"
DATA_URI = UI + r"\s*<img\b[^>]*>|\s*data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+"
FOOTNOTE_MARK = U + "[\u00b9\u00b2\u00b3\u2070-\u2079]+\\s*$"
INLINE_TAG = UI + r"</?(?:u|i|b|em|strong|sup|sub|small|ins|mark|font|span|s|del|code)(?:\s[^<>]*)?/?>"
TITLE_LIMIT = 200
NOISE = (
    UI + r"^P\.?\s?O\.?\s+BOX\s+\d+",
    U + r"^\d+[A-Za-z]?\s+[\w'\-. ]+,\s*[A-Za-z .]+,\s*[A-Z]{2}\s+\d{5}",
    U + r"^[a-z]\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d",
    UI + r"^\s*<img\b",
    U + r"^[\d\W]+$",
    U + r"^\d{3}[.\-]\d{3}[.\-]\d{4}$",
    U + r"^\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}$",
    U + r"^\d{6,}$",
    U + r"^[A-Z][A-Za-z /'&.-]{1,34}:\s*\S",
    U + r"^[A-Z\s]+,\s*[A-Z]{2}\s+\d{5}(-\d{4})?$",
    UI + r"^\d+\.?\s+(?:[A-Z0-9][A-Za-z0-9.'-]*\s+)*(?:AVE|AVENUE|ST|STREET|RD|ROAD|BLVD|BOULEVARD|DR|DRIVE|LN|LANE|WAY|CT|COURT|PKWY|PARKWAY|PLAZA|PL|SQUARE|SQ|TERRACE|TER)\.?(?:\s*,?\s*(?:SUITE|STE|APT|UNIT|FLOOR|FL|RM|ROOM|#)\s*[A-Z0-9-]+)?\.?$",
    UI + r"^(?:page|empty row|keyline)\b",
    U + r"^(?:\[[^\]]*\]\s*)+$",
)
WITNESS = UI + r"^\s*(?:\*\*)?IN WITNESS\s+(?:WHEREOF|THEREOF)"
SIGNATURE_FIELD = UI + r"^\s*(?:\*\*)?(Signature|DocuSigned by|By|Name|Title|Date|Witness|Printed Name|Print Name|Its|Attest)\s*:"
FURNITURE_LINE = UI + r"^(?:\d{1,4}|[A-Z](?:\s+[A-Z]){2,}|KEYLINE|VN|Empty Row|-{3,}|\(Unaudited\)|\(continued\)|\(cont\.?\))$"
LEAD_NOISE = (
    U + r"^[\d\W]+$",
    U + r"^\d{3}[.\-]\d{3}[.\-]\d{4}$",
    U + r"^\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{2,4}$",
    U + r"^\d{5,}$",
    UI + r"^(?:page|empty row|keyline|source)\b",
    UI + "^note\\b(?!\\s*[\\d\u2013\u2014-]*\\s*\\d)",
)
CONTINUED = UI + "\\s*[\\(\\[]?\\s*[-\u2013\u2014,:]?\\s*(?:continued|cont\u2019?d?|cont\\.?)\\s*[\\)\\]]?\\s*$"
TRAILING_MONEY = U + r"\s[-(]?\$[\d,]+(?:\.\d\d)?\)?$"
NUMBER_PREFIX = U + r"^(?:\*\*)?(\d{1,2}(?:\.\d{1,3})*)\.?\s+"
LETTERED = UI + "^\\(?([a-z]{1,3}|[ivx]{1,4})\\)\\s+(?:[\"\u201c]?\\*\\*([^*\\n]{2,60}?)\\*\\*[\"\u201d]?|[\"\u201c]([^\"\u201d\\n]{2,60})[\"\u201d]\\s+(?:means|shall mean|has the meaning|refers to)\\b)"
ENUMERATOR = U + r"^(?:\*\*)?(?:\d{1,2}(?:\.\d{1,3})*\.?|\(\s*[A-Za-z]{1,3}\s*\))\s+"
INLINE_TITLE = U + r"^([^.:;]{2,70}?)\s*([:.])\s+(\S)"
PAGE_BREAK = UI + r"PAGE BREAK|^\s*Page \d+\b"
CAPS_LINE = U + r"^(?:\*\*)?([A-Z][A-Z0-9][A-Z0-9 &/'\-.,()]{1,68})(?:\*\*)?:?$"
SPACED_CAPS = U + r"^(?:\*\*)?((?:[A-Z]\s+){2,}[A-Z]\.?)(?:\*\*)?$"
BANNERS = ("for immediate release", "regulatory announcement", "press release", "news release", "media release", "for release", "immediate release", "not for distribution", "embargoed until", "company announcement", "ad hoc announcement", "inside information")
DAY_MONTH = UI + r"^\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
TOC_PAGE = UI + r"^(?:\d{1,4}|[ivxlcdm]{1,7})\.?$"
TOC_ENTRY = U + "^(\\S.*?[A-Za-z\\)\\]])[\\s.\u2026\u00b7\\-]+(\\d{1,4})$"
TOC_DECLARES = UI + "^\\s*(?:#{1,6}\\s*)?(?:\\*\\*)?\\s*(?:table\\s+of\\s+contents|contents|index\\s+of\\s+(?:sections|clauses))\\b[\\s:.\\-\u2014]*(?:\\(cont(?:inued)?\\.?\\))?(?:\\*\\*)?\\s*$"
BOLD_SPAN = U + r"\*\*([^*\n]{2,60}?)\*\*"
NUMBER_ONLY = U + r"^\d{1,2}(?:\.\d{1,3})*\.?$"
CAPS_NAME = U + r"^\s*([A-Z][A-Z0-9&.'-]*(?:[ ,]+[A-Z][A-Z0-9&.'-]*){1,5}),"
LIST_ITEM = U + r"^(\d{1,2})[.)]\s+(\S.*)$"
ATTACHMENT = UI + r"^\s*(?:\*\*)?(?:EXHIBIT|ANNEX|SCHEDULE|APPENDIX|ATTACHMENT|ADDENDUM|RIDER|SUPPLEMENT)(?:\b\s*[A-Z0-9IVXL]{0,4}\s*[-:.—]?\s*(?:\*\*)?$|\s+[A-Z0-9IVXL]{1,4}\b)"

MAX_PARENT_DISTANCE, RUNNING_REPEATS, RECURRING_REPEATS = 60, 8, 4
NEAR_LINES, PAGE_SPAN = 60, 250

# tables
AMOUNT = U + r"^\(?\s*(?:US)?\$\s*(-?[\d,]+(?:\.\d+)?)\s*\)?$"
TOTAL_LABEL = UI + r"\b(total|subtotal|sum|grand)\b"
PIPE_ROW = U + r"^\s*\|(.+)\|\s*$"
RULER_ROW = U + r"^[\s|:\-]+$"
PERIOD = UI + r"\b(FY\s?\*?\s?\d{2,4}|Q[1-4]|20\d\d|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|month|quarter|year|week|wave|phase)\b"
ROLE_HEADER = UI + r"\b(responsib|accountab|owner|RACI|supplier|client|customer|vendor|party)\b"
MONEY_HEADER = UI + r"\b(fee|fees|cost|costs|price|pricing|rate|charge|charges|amount|payment|invoice|\$|USD)\b"
DELIVERABLE_HEADER = UI + r"\b(deliverable|milestone|activity|activities|task)\b"
INVENTORY_HEADER = UI + r"\b(report|application|system|tool|document)\b"

# figures
VISUAL = UI + r'\b(blue|dark green|light green|green|yellow|red|orange|grey|gray|white|black)\s+(square|box|boxes|bar|bars|line|arrow|arrows|circle|shading|highlight)\b|\b(centered|centred) in the image\b|\bShort description of visual element.*|\bThe diagram is divided into\b|\b(legible|illegible)\b|\bwith the text "[^"]*" above it\b|\ban alphanumeric code below it\b'
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
FIGURE_DATE = r"(?i:\b\d{1,2}[-/]" + _MONTH + r"[a-z]*(?:[-/]\d{2,4})?\b|\b" + _MONTH + r"[a-z]*[-/ ]\d{2,4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b)"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MILESTONE = UI + r"\b([A-Z][A-Za-z ]{1,24}?)\s+(?:start|Start|go[- ]?live|GoLive|end)\b[: ]*\s*(" + FIGURE_DATE + ")"
BARE_MILESTONE = UI + r"\b(KT start|SRT start|GoLive|Go[- ]Live|Kick[- ]?off)\b[: ]*\s*(" + FIGURE_DATE + ")"
_PERSON = r"([A-Z][A-Za-z.\-']+(?:\s+(?!Title|Name|Date|By|Print|Sign)[A-Z][A-Za-z.\-']+){0,3})"
SIGNER = (U + r"DocuSigned by:\s*" + _PERSON, U + r"Signature:\s*legible\s*\(([^)]{3,44})\)", U + r"Signature:\s*" + _PERSON + r"\s*\(legible\)", U + r"/s/\s*" + _PERSON, U + r"\bName:\s*" + _PERSON, U + r"representative\s+" + _PERSON)
NOT_SIGNERS = ("By", "Title", "Name", "Date", "Print", "Sign", "Customer", "Signature", "Readable", "Short", "This", "Agreed", "Accepted", "Contractor")
SIGNER_TITLE = (U + r"\bTitle:\s*([A-Za-z][A-Za-z ,&/.\-']{2,54}?)(?:\s{2,}|\s*(?:Date|Short|This|$))", U + r"Printed name\s+([A-Za-z][A-Za-z ,&/.\-']{2,44}?)\s+Title", U + r"(?:^|\s)((?:Chief|Senior|Executive|Vice|Managing|General|Authorized)[A-Za-z ]{3,44}?)(?:\s{2,}|\s*(?:Date|This|Short|$))")
SIGNER_PARTY = (U + r"Readable Text:\s*([A-Z][A-Z .,&'-]{3,60}?)\s+(?:DocuSigned|By:)", U + r"\b([A-Z][A-Z .,&'-]{4,58}?(?:INC|LLC|LTD|CORP|CORPORATION|COMPANY|L\.?P)\.?)\b")

# chunks
SENTENCE_BREAK = U + r"(?<=[.!?])\s+(?=[A-Z(])"
ITEM_BREAK = U + r'(?=(?:^|\s)\((?:[a-z]{1,3}|i{1,3}|iv|vi{0,3}|ix|x)\)\s+[A-Za-z"“])'
COVER_MIN_WORDS, COVER_TARGET_WORDS, COVER_MAX_PARTS, ITEM_MIN_WORDS = 60, 90, 8, 25

# support
FIGURE_TOKEN = U + r"\$?\d[\d,]*(?:\.\d+)?%?"
DATE_TOKEN = UI + r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|" + _MONTH + r"[a-z]*\.?\s+\d{1,2})\b"
NAME_TOKEN = U + r"\b(?:[A-Z]{2,}[A-Za-z&.'-]*|[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*)\b"
GENERIC = tuple(
    """The This That These Those Section Clause Agreement Party Parties Provider Customer Supplier Recipient Company Services Service Order Term Terms
    Exhibit Schedule Annex Appendix Confidential Information Data Effective Date Total Account Invoice Payment Notice January February March April May
    June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday They Them Their Theirs It Its We Us Our
    You Your He Him His She Hers Neither Either Nothing None Nobody No Not Notwithstanding Accordingly However Moreover Furthermore Therefore Thus Hence
    Save Except Unless Subject Upon During Prior Where When While If Each Every Any All Both Such Should Whether Provided Failure Nor And Or But For In On
    At To Under Over After Before Once Although Because Since Also Further Additionally Finally""".split()
)
ABBREVIATIONS = ("no", "nos", "inc", "ltd", "llc", "plc", "co", "corp", "etc", "eg", "ie", "vs", "cf", "approx", "est", "art", "sec", "cl", "para", "pp", "vol", "ch", "mr", "mrs", "ms", "dr")
GLUED_HEADS = tuple("a an the of to in for by with and all any its our their his her this that each such no not is are be was were from on at as".split())
COURTESY = UI + r"\b(Mr|Mrs|Ms|Dr|Messrs|Prof|Hon|Rev|Attn|e\.g|i\.e|etc|vs|approx)\."
ROUTING_LEAD = UI + r"^(?:\s*(?:\S+@\S+\.\S+|Re\s*:.{0,90}?(?=\s(?:Dear|As|We|This|The|Pursuant|In|Please)\b)|Dear[^:]{0,40}:|Via\s+(?:Electronic\s+Mail|Email|Facsimile|Courier)|BY\s+(?:EMAIL|HAND|COURIER)|CONFIDENTIAL(?:\s+AND\s+PRIVILEGED)?)\s*)+"
VERBATIM_MAX_WORDS, VERBATIM_ENOUGH_WORDS = 60, 28

# polarity
CUES = ("not", "n't", "no", "never", "nor", "neither", "cannot", "without", "none", "nothing", "nowhere", "prohibited", "forbidden", "precluded", "barred")
SKIPPED = tuple(
    """a an the be been being is are was were am has have had do does did shall will would may might must can could should to of in on at for by with any
    all such its their his her our your this that these those it they he she we you i as so very only also just otherwise more less than then further
    hereby thereby herein therein under over both either each every some other another same own least most much many well ever yet still even almost quite
    rather somewhat entirely wholly fully solely merely simply directly indirectly reasonably materially expressly specifically event circumstances way
    manner respect""".split()
)
MODALS = tuple("shall will may must can could should would is are was were has have had does do did".split())
FUNCTION_WORDS = tuple(
    """the a an and or of to in on at for by with from that this these those it its their his her our your they we you as so than then be is are was were
    been being am has have had do does did shall will would may might must can could should not no any all such other another same own more less least
    most much many""".split()
)
WORD = U + r"[A-Za-z][A-Za-z'-]*"
NEUTRAL = UI + r"\bwithout\s+(?:limitation|limiting|prejudice)\b"
NUMBER_NO = UI + r"\bNos?\.\s*(?=[\d(])"
EXCEPTION = UI + r"\b(?:except|unless|save as|save for|save that|other than|otherwise than|until|provided that|subject to)\b"
POLARITY_BREAK = U + r"(?<=[.!?;])\s+(?=[A-Z\"'(])"
ABILITY_ENDINGS = (("ibilities", "ible"), ("ibility", "ible"), ("abilities", "able"), ("ability", "able"))
LEGAL_ENDINGS = ("ements", "ement", "ances", "ance", "ences", "ence", "ions", "ion", "ings", "ing", "ies", "ed", "es", "s", "e")
CUE_REACH, LICENCE_WINDOW = 6, 10

# verify
VERIFY_TOKEN = U + r"\$[\d,.]+|\b\d[\d,.]*%?\b|\b[A-Z][A-Za-z]*[A-Z][A-Za-z]*\b|\b[A-Z][a-z]{2,}\b"
VERIFY_STOP = tuple("The This That These Those A An And Or But If For To As At By In On Of It No Not All Any Each Such Both There Their They Where When Which While Unless".split())
CAMEL = U + r"\b[A-Za-z]*[a-z][A-Z][A-Za-z]*\b"
CLAUSE_NUMBER = U + r"\b\d+(?:\.\d+)+\b"
SPACED_TOKEN = U + r"\b([A-Z]) ([A-Z]{1,3})\b|\b(\d+)\. (\d)"

# facets
FACETS = {
    "PAY": (UI + r"(?:US\$|\$|USD|EUR|CHF)\s?[\d,]+|\bnet\s+\d+\b|\b(?:payment|invoice|invoicing|price|pricing|fee|fees|rate|rates|currency|exchange\s+rate)\b",),
    "EXPIRY": (
        U + r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|" + _MONTH + r"[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+" + _MONTH + r"[a-z]*\.?\s+\d{4})\b",
        UI + r"\b(?:expir\w+|terminat\w+|renew\w+|effective\s+date|\d+\s*(?:day|week|month|year)s?)\b",
    ),
    "PARTY": (
        U + r"\b(?:Supplier|Customer|Manufacturer|Buyer|Seller|Licensor|Licensee|Vendor|Contractor|Client|Purchaser|Consultant|Provider|Recipient|Disclosing\s+Party|Receiving\s+Party|Discloser|Landlord|Tenant|Sublandlord|Subtenant|Sublessor|Sublessee)\b",
        U + r"\b[A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,5}\s*,?\s*(?i:Inc|Corp|Corporation|Ltd|Limited|LLC|LC|GmbH|AG|plc)\.?\b",
    ),
    "PERM": (UI + r"\b(?:may|shall\s+not|must\s+not|is\s+(?:not\s+)?permitted|is\s+entitled|prohibited|consent)\b",),
    "OBLIG": (UI + r"\b(?:shall|must|is\s+required\s+to|agrees\s+to|will\s+provide)\b",),
}

# topics
TOPIC_STOP = tuple(
    """a an the and or of to in on at for by with from this that these those it its which who whom whose what when where how why be is are was were been
    being am has have had do does did shall will would may might must can could should not no other another any all such their his her our your they he
    she we you i as so than then under over both either each every some same own more less least most much many well ever yet still even given others
    end""".split()
)
TOPIC_WORD = U + r"[A-Za-z][A-Za-z-]{2,}"
TOPIC_ENDINGS = ("ements", "ement", "ances", "ance", "ences", "ence", "ions", "ion", "ings", "ing", "ures", "ure", "ies", "ed", "es", "s", "e")
FOLDER_TYPES = {"bills": "statements", "reports": "reports", "contracts": "agreements", "legal_data": "agreements"}
PASSAGE_CHARS, TOPIC_LEAST, TOPIC_MOST = 1600, 0.55, 3
