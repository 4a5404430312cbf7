"""Lines and sections of one document at a time: the steps of ``lines``, ``rules`` and
``sections`` as one pass over a text, in time and memory of that text.

No step of a document needs another document, so the pass is a map over rows: nothing is
shuffled, sorted or written on the way. Whatever depends on one line only is kept in a
:class:`Memo`. The tests hold the pass against the windows of those modules.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_EVEN, Decimal
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.local import SPACE, Memo, compiled, group, one_space, starts_lower, starts_upper, strip, word_count, words

PREAMBLE = "[preamble - before first heading]"
BATCH_ROWS, BATCH_CHARS = 4096, 4_000_000

_KEYS = frozenset(P.SIGNATURE_KEYS)
_has = lambda pattern: compiled(pattern).search
_LETTER, _NOT_CAPITAL = compiled(r"(?dU)\p{L}"), compiled(r"(?dU)[\p{Ll}\p{Lt}\p{Lo}\p{Lm}]")
_SPACES, _LOWER = compiled(P.U + r"\s{2,}"), compiled(r"(?dU)\p{Ll}")
_NOISE, _LEAD_NOISE = tuple(map(_has, P.NOISE)), tuple(map(_has, P.LEAD_NOISE))


# -- one line or title -------------------------------------------------------------------------


def strip_emphasis(t: str) -> str:
    if "<" in t:
        t = compiled(P.INLINE_TAG).sub("", t)
    t = strip(_SPACES.sub(" ", t.replace("**", " ")))
    return strip(t.strip("*_ ").strip(" .:—-"))


def mostly_digits(t: str) -> bool:
    return sum(map(str.isdecimal, t)) / len(t) > 0.45


def looks_like_content(t: str) -> bool:
    t = strip(t)
    return t == "" or mostly_digits(t) or any(f(t) for f in _NOISE)


def lead_noise(t: str) -> bool:
    return mostly_digits(t) or any(f(t) for f in _LEAD_NOISE)


def says_continued(t: str) -> bool:
    return "cont" in t.lower() and bool(_has(P.CONTINUED)(strip(t)))


def fold(t: str) -> str:
    t = strip(t)
    return (compiled(P.CONTINUED).sub("", t) if "cont" in t.lower() else t).lower()


def clean_title(t: str) -> str:
    for pattern in (P.EMBEDDED_MARKUP, P.DATA_URI, P.FOOTNOTE_MARK):
        t = compiled(pattern).sub("", t)
    t = re.sub(r"<[^>]{0,400}>", " ", t.replace("\\n", " ").replace("\\t", " "))
    t = strip(one_space(t).strip("*_ "))
    return re.sub(r" [^ ]*\Z", "", t[: P.TITLE_LIMIT]) + "…" if len(t) > P.TITLE_LIMIT else t


def lettered_title(s: str) -> str | None:
    found = _has(P.LETTERED)(s)
    if not found:
        return None
    t = strip(found[2] or found[3] or "").rstrip(".:;,")
    return f"({found[1]}) {t}" if t != "" and word_count(t) <= 9 and not (starts_lower(t) and t != t.upper()) else None


_CAPS_BARE = re.compile(r"\*\*[^\n\r\x85  ]*\*\*\Z")


def caps_title(s: str) -> str | None:
    spaced = _has(P.SPACED_CAPS)(s)
    if spaced and len("".join(words(spaced[1]))) >= 4:
        return one_space(spaced[1])
    if _LOWER.search(s) and not re.match(r"(?:\*\*)?[A-Z][A-Z0-9]", s):
        return None
    t = strip((strip(s[2:-2]) if _CAPS_BARE.match(s) else s).rstrip(":"))
    if not (len(_LETTER.findall(t)) >= 3 and not _NOT_CAPITAL.search(t)):
        line = _has(P.CAPS_LINE)(s)
        if not line:
            return None
        t = line[1]
    t = t.strip(" .,:")
    n = word_count(t)
    fits = (
        1 <= n <= 16 and len(_LETTER.findall(t)) >= 3 and not (n > 4 and _has(P.U + r"\.\s*$")(s))
        and ((k := t.lower().rstrip(":")) == "title" or k not in _KEYS) and not any(f(t) for f in _NOISE)
    )
    return t if fits else None


def inline_title(t: str) -> str | None:
    head = _has(P.NUMBER_PREFIX)(t)
    if not head:
        return None
    found = _has(P.INLINE_TITLE)(strip(t[head.end() :]))
    if not found:
        return None
    title = strip(strip(found[1]).rstrip("*"))
    w = words(title)
    fits = 1 <= len(w) <= 10 and _LETTER.match(title) and title.lower().rstrip(":") not in _KEYS
    return f"{head[1]}. {title}" if fits and sum(map(starts_upper, w)) / len(w) >= (0.5 if found[2] == ":" else 0.8) else None


def numbered_prose(t: str) -> bool:
    head = _has(P.NUMBER_PREFIX)(t)
    if not head:
        return False
    rest = strip(strip(t[head.end() :]).rstrip("*"))
    w = words(rest)
    sentence = rest.endswith((".", ";", ",")) and not re.match(r"[A-Z][A-Z &/'-]+\Z", rest)
    return rest != "" and (sentence or len(w) > 12 or (len(w) >= 5 and sum(map(starts_upper, w)) <= len(w) // 3))


def looks_titled(head: str) -> bool:
    w = words(head)
    if not (1 <= len(w) <= 7 and not head.endswith(",") and starts_upper(head) and not _has(P.U + r"(^|\s)\d+\.*$")(head)):
        return False
    alpha = [x for x in w if _LETTER.match(x)]
    return bool(alpha) and sum(map(starts_upper, alpha)) / len(alpha) >= 0.6


def decimal_title(s: str) -> str | None:
    found = _has(P.DECIMAL_LEAD)(s)
    if not found or looks_like_content(s):
        return None
    head = strip(strip_emphasis(found[2]).split(".", 1)[0])
    return f"{found[1]} {head}" if head != "" and looks_titled(head) else found[1]


def clause_heading(line: str) -> str | None:
    t = strip_emphasis(line)
    fits = (
        3 <= len(t) <= 80 and word_count(t) <= 10 and not (t.endswith(".") and not re.match(r"[0-9]+\.\Z", t)) and not re.match(r"[0-9]+[-/]", t)
        and not _has(P.DAY_MONTH)(t) and (starts_upper(t) or t[0].isdecimal()) and not looks_like_content(t)
    )
    return t if fits else None


def toc_class(s: str) -> str:
    """Of a stripped line."""
    if s == "" or s == P.BLOCK:
        return "blank"
    if "http://" in s or "https://" in s:
        return "skip"
    if s.startswith(("<", "|", "(block)")) or _has(P.HEADING_LINE)(s):
        return "stop"
    if _has(P.TOC_PAGE)(s):
        return "paged"
    n = word_count(s)
    if len(s) > 140 or n > 20:
        return "stop"
    if _has(P.TOC_ENTRY)(s):
        return "paged"
    return "stop" if n > 8 and s.endswith((".", ";", ",", "?", "!")) else "plain"


def canonical_number(n: str | None) -> str:
    return re.sub(r"(\.0)+\Z", "", n or "")


def is_attachment(title: str) -> bool:
    return bool(_has(P.ATTACHMENT)(strip(title)))


def number_of(title: str) -> str | None:
    found = _has(P.NUMBER)(title) or _has(P.WORD_NUMBER)(title)
    return found[1] if found else None


def name_from_bold(body: str) -> str | None:
    for found in compiled(P.BOLD_SPAN).finditer(body[:300]):
        t = found[1].strip(" ,.;:*")
        if 1 <= word_count(t) <= 8 and _LETTER.search(t) and t.lower() not in _KEYS:
            return t
    return None


def name_from_caps(body: str) -> str | None:
    found = _has(P.CAPS_NAME)(body[:200])
    t = found[1].strip(" ,;:") if found else ""
    return t if word_count(t) >= 2 and t.lower() not in _KEYS else None


def _good(t: str, most: int) -> bool:
    return t != "" and t.lower() not in _KEYS and word_count(t) <= most and not looks_like_content(t)


def _same_marks(found: re.Match) -> bool:
    return sorted(found[1]) == sorted(found[3])


def _heading(line: str) -> str | None:
    found = _has(P.HEADING_LINE)(line) if line.startswith("#") else None
    return found and (strip_emphasis(found[2]) or None)


def _html(line: str) -> str | None:
    found = _has(P.HEADING_HTML)(line) if "<" in line else None
    return found and (strip_emphasis(_SPACES.sub(" ", re.sub(r"<[^>]+>", " ", found[2]))) or None)


def _bold(s: str) -> tuple[str, str] | None:
    """``(rule, title)`` of a line with emphasis at its start."""
    if not s.startswith(("*", "_")):
        return None
    lead = _has(P.BOLD_LEAD)(s)
    if lead and _same_marks(lead) and strip(lead[4]) != "":
        t = strip_emphasis(lead[2])
        return ("bold-lead", t) if t != "" and word_count(t) <= 12 else None
    only = _has(P.BOLD_ONLY)(s)
    if not (only and _same_marks(only)):
        return None
    t = strip(strip_emphasis(only[2]))
    return ("bold-only", t) if _good(t, 14) else None


def _label(s: str) -> str | None:
    found = _has(P.LABEL_ONLY)(s) if ":" in s else None
    t = strip(strip_emphasis(found[1])) if found else ""
    return t if found and _good(t, 14) else None


def _clause(s: str) -> tuple[str | None, str | None]:
    """Titles of a clause line in a document of a single series of numbers, and of several."""
    if not _has(P.CLAUSE_LINE)(s):
        return None, None
    t = strip_emphasis(s)
    if t == "" or looks_like_content(t):
        return None, None
    title = inline_title(t)
    if title is not None:
        return title, title
    if numbered_prose(t):
        return group(_has(P.NUMBER_PREFIX)(t), 1) + ".", None
    return t[:120], t[:120]


def _lead_shape(s: str) -> bool:
    """What a block lead asks of the line itself."""
    w = words(s)
    if not (2 <= len(s) <= 70 and len(w) <= 9) or s.endswith((".", ",", ";", ":")) or "  " in s or _has(P.FURNITURE_LINE)(s) or _has(P.TRAILING_MONEY)(s):
        return False
    if len(w) >= 5 and starts_lower(w[-1]) and not s.endswith(("?", "!")):
        return False
    number = _has(P.ENUMERATOR)(s)
    return bool(_LETTER.match(s) or (number and starts_upper(s[number.end() :]))) and not lead_noise(s)


def _alone(line: str) -> tuple[str, int] | None:
    """A line that may join another: a bare-number heading, a division or a number alone."""
    if line.startswith("#") and (found := _has(P.HEADING_LINE)(line)) and _has(P.BARE_NUMBER)(strip(found[2])):
        return "bare", len(found[1])
    if _has(P.DIVISION_ALONE)(line):
        return "division", 0
    return ("number", 0) if _has(P.NUMBER_ALONE)(line) else None


def _facts(line: str) -> tuple:
    """``(stripped, class in contents, declares contents, joins, field, witness, page break)``."""
    s = strip(line)
    if s == "":
        return s, "blank", False, None, False, False, False
    cue = ":" in line
    return (
        s, toc_class(s), bool(_has(P.TOC_DECLARES)(line)), _alone(line), cue and bool(_has(P.SIGNATURE_FIELD)(line)), bool(_has(P.WITNESS)(line)), bool(_has(P.PAGE_BREAK)(line)),
    )


FACTS, FOLDED, CONTINUED, CAPS = Memo(_facts), Memo(fold), Memo(says_continued), Memo(caps_title)
HEADING, HTML, BOLD, DECIMAL, LABEL, LETTERED = Memo(_heading), Memo(_html), Memo(_bold), Memo(decimal_title), Memo(_label), Memo(lettered_title)
INFERRED, CLAUSE, LEAD, CLEAN = Memo(clause_heading), Memo(_clause), Memo(_lead_shape), Memo(clean_title)
ATTACHED, NUMBERED = Memo(is_attachment), Memo(number_of)
KEYED = Memo(lambda t: sha1(t.encode()).hexdigest()[:8])


# -- class and masks of a document ---------------------------------------------------------------


def _signals(line: str) -> tuple | None:
    """What a line counts for; null where blank. The second of a pair tells of the line's own
    start that the next one has to complete, as white space in a pattern may hold line ends."""
    s = strip(line)
    if s == "":
        return None
    head = _has(P.MD_HEADING)(line) if line.startswith("#") else None
    open_head = bool(not head and re.match(f"#{{1,6}}[{SPACE}]*\\Z", line))
    number = re.match(f"(?:\\*\\*)?(\\d{{1,2}}(?:\\.\\d{{1,3}})*)\\.?(?:([{SPACE}]+)(?=(?:\\*\\*)?[A-Z\"(])|([{SPACE}]*\\Z))", s)
    bold = s.startswith(("*", "_")) and (only := _has(P.BOLD_ONLY)(s)) and _same_marks(only)
    article = re.match(f"(?:\\*\\*)?(?:ARTICLE|Article|SECTION|Section|ANNEX|EXHIBIT|SCHEDULE|APPENDIX)(?:[{SPACE}]+[0-9IVXLC]()|[{SPACE}]*\\Z)", s)
    field = re.match(f"([A-Z][A-Za-z /'&.-]{{1,34}}):[{SPACE}]*([^{SPACE}])?", s)
    restart = re.match(f"(?:\\*\\*)?1\\.(?:[{SPACE}]+([A-Z\"(])|\\Z)", s)
    dear = re.match(f"(?:\\*\\*)?Dear(?:[{SPACE}]+([A-Z])|\\Z)", s)
    return (
        bool(head), open_head, int(number[1].split(".", 1)[0]) if number else None, bool(number and number[2] is None), bool(bold), bool(article and article[1] is not None), bool(article and article[1] is None),
        bool(field), bool(field and field[2] is None), bool(field and field[1].strip(" ").lower() in _KEYS), ":" in s and bool(_has(P.LABEL_ONLY)(s)),
        bool(restart and restart[1]), bool(restart and not restart[1]), bool(dear and dear[1]), bool(dear and not dear[1]), bool(_has(P.CLOSING)(s)), bool(re.match(r'(?:\*\*)?[A-Z"(]', s)), s[0],
    )


SIGNALS = Memo(_signals)
_NUMERAL = frozenset("0123456789IVXLC")


def _half_even(x: float, places: str) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(places), ROUND_HALF_EVEN))


def regime_of(text: str) -> str:
    """The class of :func:`survey.regime`."""
    heads = clauses = bolds = articles = fields = labels = letters = closings = 0
    tops = set()
    took_head = took_field = False
    found = [x for line in text.split("\n") if (x := SIGNALS[line]) is not None]
    found.append(None)
    for x, y in zip(found, found[1:]):
        head, open_head, top, open_number, bold, article, open_article, field, open_field, is_key, label, _, _, dear, open_dear, closing, _, _ = x
        if not took_head and (head or (open_head and y)):
            heads += 1
            took_head = open_head
        else:
            took_head = False
        if top is not None and (not open_number or (y and y[16])):
            clauses += 1
            tops.add(top)
        bolds += bold
        articles += article or bool(open_article and y and y[17] in _NUMERAL)
        if not took_field and field and (not open_field or y):
            fields += not is_key
            took_field = open_field
        else:
            took_field = False
        labels += label
        letters += dear or bool(open_dear and y and "A" <= y[17] <= "Z")
        closings += closing
    cover = _half_even(len(tops) / max(tops), "0.01") if tops and max(tops) > 0 else 0.0
    kb = max(1.0, len(text) / 1000.0)
    spine = _half_even(clauses / kb, "0.01") >= 0.15 or cover >= 0.5
    if (clauses >= 20 and spine) or (articles >= 5 and _half_even(articles / kb, "0.001") >= 0.02):
        return "clauses"
    if clauses >= 20 or articles >= 5:
        return "deck"
    if heads >= 5 and _half_even(heads / kb, "0.01") >= 0.16:
        return "headings"
    if clauses >= 5 and not spine:
        return "deck"
    if heads >= 2:
        return "sparse"
    if clauses >= 5 or (bolds >= 8 and bolds > fields):
        return "clauses"
    if fields >= 10:
        return "flat" if heads == 0 and labels < 3 else "fields"
    if labels >= 3:
        return "labels"
    return "letter" if letters and closings else "flat"


def _token(k: int) -> str:
    return "MASK" + str(k).rjust(5, "0")[:5]


def masked(text: str) -> tuple[str, list[str]]:
    """The text with tokens for tables and figures, and what they stand for."""
    if "<a id='" in text:
        text = compiled(P.ANCHOR).sub(f"\n{P.BLOCK}\n", text)
    for cue, pattern in zip(("DocuSign Envelope ID:", "PAGE BREAK", "Page "), P.FURNITURE):
        if cue in text:
            text = compiled(pattern).sub("", text)
    if "<::" in text:
        text = compiled(P.EMPTY_VISION).sub("", text)
    blocks: list[str] = []
    for cue, pattern in (("<", P.HTML_TABLE), ("|", P.PIPE_TABLE), ("<::", P.VISION)):
        if cue in text:
            keep = pattern == P.PIPE_TABLE

            def hide(found: re.Match) -> str:
                blocks.append(found[0])
                return f"(block) {_token(len(blocks) - 1)}" + ("\n" if keep and found[0].endswith("\n") else "")

            text = compiled(pattern).sub(hide, text)
    return re.sub(r"\n{3,}", "\n\n", text), blocks


def restored(text: str, blocks: list[str]) -> str:
    """Tokens replaced by their blocks, the last block first, as figures may hold tables."""
    waiting, seen = [], set()

    def note(piece: str, below: int) -> None:
        for k in map(int, re.findall(r"(?=MASK([0-9]{5}))", piece)):
            if k < below and k not in seen:
                seen.add(k)
                heapq.heappush(waiting, -k)

    if blocks and "MASK" in text:
        note(text, len(blocks))
        while waiting:
            k = -heapq.heappop(waiting)
            text = text.replace(_token(k), blocks[k])
            note(blocks[k], k)
    return text


def section_tables(full: str) -> list[str]:
    found = compiled(P.HTML_TABLE).findall(full) if "<" in full else []
    return found + [t for t in compiled(P.PIPE_TABLE).findall(full) if t.count("|") > 4] if "|" in full else found


def section_figures(full: str) -> list[str]:
    return compiled(P.VISION).findall(full) if "<::" in full else []


_BLK = re.compile(r"(?<![A-Za-z])BLK(?![A-Za-z])")


def section_prose(full: str) -> str:
    for cue, pattern in (("<", P.HTML_TABLE), ("<::", P.VISION), ("|", P.PIPE_TABLE)):
        if cue in full:
            full = compiled(pattern).sub(" ", full)
    if "<" in full:
        full = re.sub(r"<[^>]+>", " ", full)
    full = re.sub(r"MASK[0-9]{5}", " ", full.replace("(block)", " ")) if "MASK" in full else full.replace("(block)", " ")
    full = full.replace(P.BLOCK, " ").replace("\0", " ")
    return one_space(_BLK.sub(" ", full) if "BLK" in full else full)


# -- lines -------------------------------------------------------------------------------------


def _in_contents(facts: list[tuple]) -> list[bool]:
    inside = [False] * len(facts)
    if not any(f[2] for f in facts):
        return inside
    starts = [0, *(k for k, f in enumerate(facts) if f[1] == "stop" and k), len(facts)]
    for a, b in zip(starts, starts[1:]):
        last = max((k for k in range(a, b) if facts[k][1] == "paged"), default=None)
        if last is None:
            continue
        paged = plain = 0
        first = None
        for k in range(last, a - 1, -1):
            if facts[k][2] and paged >= 8 and paged >= 0.4 * (paged + plain):
                first = k
            paged += facts[k][1] == "paged"
            plain += facts[k][1] == "plain"
        if first is not None:
            inside[first + 1 : last + 1] = [True] * (last - first)
    return inside


_NO_TITLE = re.compile(r"(?:<a id=|<::|<table|\(block\)|- |\* |MASK[0-9]{5})")


def _divides(nxt: str) -> bool:
    return (
        3 <= len(nxt) <= 90 and not nxt.endswith(".") and word_count(nxt) <= 12 and starts_upper(nxt) and not _has(P.HEADING_LINE)(nxt) and nxt != P.BLOCK
        and not _has(P.NO_DIVISION_TITLE)(nxt) and not _has(P.MASKED_BLOCK)(nxt)
    )


def _numbers(line: str, nxt: str) -> bool:
    return (
        not _has(P.NUMBER_ALONE)(nxt) and nxt != P.BLOCK and (3 <= len(nxt) <= 90 or inline_title(_has(P.NUMBER_ALONE)(line)[1] + ". " + nxt) is not None)
        and not _NO_TITLE.match(nxt) and not (len(nxt) <= 90 and nxt.endswith(".")) and not starts_lower(nxt)
    )


def _joined(held: list[str], facts: list[tuple], in_toc: list[bool]) -> list[str]:
    """Lines with numbers and divisions that stand alone joined with their titles."""
    full = [k for k, f in enumerate(facts) if f[0] != ""]
    up, takes = set(), {}
    nth = 0
    for at, k in enumerate(full):
        joins, kind = facts[k][3], None
        if joins and not in_toc[k]:
            nxt = facts[full[at + 1]][0] if at + 1 < len(full) else None
            if joins[0] == "bare":
                above = _has(P.HEADING_LINE)(held[full[at - 1]]) if at else None
                title = strip(above[2]) if above else ""
                if above and len(above[1]) < joins[1] and title != "" and not re.match(r"[0-9]", title):
                    up.add(k)
            elif nxt is not None and (_divides(nxt) if joins[0] == "division" else _numbers(held[k], nxt)):
                kind = joins[0]
        nth = nth + 1 if kind else 0
        if nth % 2:
            takes[k] = kind
    if not up and not takes:
        return held
    head = lambda line: strip(_has(P.HEADING_LINE)(line)[2])
    out = list(held)
    for at, k in enumerate(full):
        after = full[at + 1] if at + 1 < len(full) else None
        if k in up or (at and full[at - 1] in takes):
            out[k] = ""
        elif after in up:
            out[k] = f"{_has(P.HEADING_LINE)(held[k])[1]} {head(held[after]).rstrip('.')} {head(held[k])}"
        elif k in takes:
            if takes[k] == "division":
                found = _has(P.DIVISION_ALONE)(held[k])
                out[k] = f"{group(found, 1)}{found[2]} {facts[after][0]}"
            else:
                out[k] = f"{_has(P.NUMBER_ALONE)(held[k])[1]}. {facts[after][0]}"
    return out


def _signatures(facts: list[tuple]) -> set[int]:
    """Lines where a signature block starts."""
    fields = [k for k, f in enumerate(facts) if f[4]]
    witness = [k for k, f in enumerate(facts) if f[5]]
    if not witness and len(fields) < 3:
        return set()
    found = {k: True for k in witness}
    for at, k in enumerate(fields):
        if at + 2 < len(fields) and fields[at + 2] <= k + 13:
            found.setdefault(k, False)
    skip, last, kept = -1, -1000, set()
    for k in sorted(found):
        if k >= skip:
            skip = k + (12 if found[k] else 14)
            if k - last > 25:
                last = k
                kept.add(k)
    return kept


class Lines:
    """The lines of a document and the rule and title of each: see ``lines`` and ``rules``."""

    def __init__(self, text: str):
        self.regime = regime_of(text)
        self.on = frozenset(P.REGIME_RULES[self.regime])
        self.masked, self.blocks = masked(text)
        held = self.masked.split("\n")
        facts = [FACTS[line] for line in held]
        self.in_toc = _in_contents(facts)
        self.lines = _joined(held, facts, self.in_toc)
        if self.lines is not held:
            facts = [FACTS[line] for line in self.lines]
        self.facts, self.stripped = facts, [f[0] for f in facts]
        self.signatures = _signatures(facts)
        self._mark()

    def _bodies(self, k: int) -> tuple[int, int]:
        """Weight of the rest of a line's layout block and of the next block."""
        here = ahead = 0
        no = 0
        for at in range(k + 1, min(k + 60, len(self.stripped))):
            s = self.stripped[at]
            if s == P.BLOCK:
                no += 1
                if no > 1:
                    break
                continue
            weight = 300 if "MASK" in s else len(s)
            if no == 0 and at < k + 40:
                here += weight
            elif no == 1:
                ahead += weight
        return here, ahead

    def _claims(self) -> list[tuple[int, str, str]]:
        on, stripped = self.on, self.stripped
        n = len(stripped)
        flag = {f: f in on for f in P.FLAGS}
        bold, clause, decimal, infer, lettered, blocklead, caps_on, banner = (flag[f] for f in ("bold", "clause", "decimal", "infer", "lettered", "blocklead", "caps", "banner"))
        label = flag["label"] or (self.regime == "clauses" and len(self.masked) <= P.LABELS_BELOW_CHARS)
        allow: set[str] = set()
        single = True
        if clause:
            allow = {strip(f[2]) for f in compiled(P.ALLOWED).finditer(self.masked)}
            single = len(compiled(P.RESTART).findall(self.masked)) <= 1 if "1." in self.masked else True
        lengths = sorted({len(t) for t in allow}, reverse=True)
        keys = [FOLDED[line] for line in self.lines]
        repeats = Counter(k for k, s in zip(keys, stripped) if 1 <= len(s) <= 70)
        self.furniture = {k for k, c in repeats.items() if c >= P.RUNNING_REPEATS}
        caps = [None if s == "" or s == P.BLOCK else CAPS[s] for s in stripped]
        capitals = Counter(FOLDED[c] for c in caps if c is not None) if banner and caps_on else {}
        caption = [False] * n
        if self.blocks or "(block)" in self.masked:
            following = False
            for k in range(n - 1, -1, -1):
                caption[k] = following
                if stripped[k] != "":
                    following = stripped[k].startswith("(block)") and bool(_has(P.MASKED_BLOCK)(stripped[k]))
        out = []
        for k, s in enumerate(stripped):
            if self.in_toc[k]:
                continue
            if k in self.signatures:
                out.append((k, "signature", "signature block"))
                continue
            if s == "":
                continue
            line = self.lines[k]
            t = HEADING[line]
            if t:
                out.append((k, "heading", t))
                continue
            t = HTML[line]
            if t:
                out.append((k, "html-heading", t))
                continue
            if s == P.BLOCK:
                continue
            if blocklead and k and stripped[k - 1] == P.BLOCK and not caption[k] and LEAD[s] and repeats[keys[k]] < P.RUNNING_REPEATS:
                here, ahead = self._bodies(k)
                if here >= 60 or ahead >= 120:
                    out.append((k, "block-lead", s))
                    continue
            if bold and (found := BOLD[s]):
                out.append((k, *found))
                continue
            if decimal and (t := DECIMAL[s]) is not None:
                out.append((k, "decimal", t))
                continue
            if label and (t := LABEL[s]) is not None:
                out.append((k, "label", t))
                continue
            if caps_on and (t := caps[k]) is not None and not caption[k] and repeats[keys[k]] < P.RECURRING_REPEATS:
                if strip(t).lower().rstrip(":") not in P.BANNERS and not (banner and capitals[FOLDED[t]] >= P.RUNNING_REPEATS):
                    out.append((k, "caps", t))
                    continue
            if lettered and not caption[k] and (t := LETTERED[s]) is not None:
                out.append((k, "lettered", t))
                continue
            if clause and (t := next((s[:m] for m in lengths if len(s) > m and s[:m] in allow), None)) is not None:
                out.append((k, "allowlist", t))
                continue
            if infer and len(s) < 90:
                if not caption[k] and (t := INFERRED[s]) is not None:
                    out.append((k, "inferred", t))
                continue
            if clause and (t := CLAUSE[s][0 if single else 1]) is not None:
                out.append((k, "clause", t))
        return out

    def _breaks(self, k: int) -> bool:
        """A page break in one of the three lines before."""
        return any(f[6] for f in self.facts[max(0, k - 3) : k])

    def _mark(self) -> None:
        """``marks``: what is left of the claims once repeats and dense runs of guesses are gone."""
        claims = self._claims()
        leads_on, repeats = "blocklead" in self.on, "repeats" in self.on
        live, seen, last_caps = [], set(), {}
        for k, rule, title in claims:
            key = FOLDED[title]
            lead = leads_on and rule in ("block-lead", "bold-lead", "bold-only")
            if lead:
                if (rule != "block-lead" and key in self.furniture) or (rule == "bold-lead" and _has(P.TRAILING_MONEY)(title)):
                    continue
                if key in seen and (not repeats or CONTINUED[title]):
                    continue
                seen.add(key)
            elif rule == "caps":
                last = last_caps.get(key)
                near = last is not None and not repeats and (k - last <= P.NEAR_LINES or (k - last <= P.PAGE_SPAN and self._breaks(k)))
                if last is not None and (near or CONTINUED[title]):
                    continue
                last_caps[key] = k
            live.append((k, rule, title, key))
        before: dict[str, int] = {}
        rest = []
        for k, rule, title, key in live:
            gap = k - before[key] if key in before else None
            before[key] = k
            near = gap is not None and not repeats and (gap <= P.NEAR_LINES or (gap <= P.PAGE_SPAN and self._breaks(k)))
            if gap is None or not (near or CONTINUED[title]):
                rest.append((k, rule, title))
        joins = [at > 0 and x[1] == rest[at - 1][1] == "inferred" and x[0] - rest[at - 1][0] <= 2 for at, x in enumerate(rest)]
        self.marks: list[tuple[int, str, str]] = []
        at = 0
        while at < len(rest):
            end = at + 1
            while end < len(rest) and joins[end]:
                end += 1
            self.marks += rest[at : at + 1] if end - at >= 3 else rest[at:end]
            at = end


# -- sections ----------------------------------------------------------------------------------


class Section:
    __slots__ = ("order", "id", "title", "number", "parent", "rule", "words", "container_only", "text", "full", "tables", "figures")

    def __init__(self, order: int, title: str, rule: str, text: str):
        self.order, self.title, self.rule, self.text, self.words = order, title, rule, text, word_count(text)
        self.id, self.parent = KEYED[title], None
        self.number = None if rule == "whole-document" else NUMBERED[title]


def _assembled(d: Lines) -> list[Section]:
    if not d.marks:
        return [Section(0, "no header", "whole-document", "\n".join(x for x, s in zip(d.lines, d.stripped) if s != "" and s != P.BLOCK))]
    out = []
    preamble = strip("\n".join(d.lines[: d.marks[0][0]]))
    if preamble != "":
        out.append(Section(0, PREAMBLE, "preamble", preamble))
    ends = [*(k for k, _, _ in d.marks[1:]), len(d.lines)]
    for (k, rule, title), end in zip(d.marks, ends):
        out.append(Section(len(out), CLEAN[title], rule, strip(" ".join(d.stripped[k:end]))))
    return out


def _nest(found: list[Section]) -> None:
    """Parents by number, within a distance and up to a wall; then of lettered items."""
    own: dict[str, int] = {}
    wall = anchor = None
    for x in found:
        number = x.number
        if number is not None:
            if "." in number:
                at = own.get(canonical_number(number.rsplit(".", 1)[0]))
                if at is not None and x.order - at <= P.MAX_PARENT_DISTANCE and (wall is None or wall < at):
                    x.parent = at
            key = canonical_number(number)
            if key:
                own[key] = x.order
        attached = ATTACHED[x.title]
        if x.rule == "lettered":
            if x.parent is None and anchor and not anchor[1]:
                x.parent = anchor[0]
        else:
            anchor = x.order, attached
        if attached:
            wall = x.order


def _renumbered(kept: list[Section]) -> list[Section]:
    new = {x.order: k for k, x in enumerate(kept)}
    for x in kept:
        x.order, x.parent = new[x.order], new.get(x.parent)
    return kept


def _collapsed(found: list[Section], run: int = 6, body: int = 400) -> list[Section]:
    def small(x: Section) -> bool:
        return x.title != "" and x.rule != "heading" and len(x.text) + 300 * x.text.count("MASK") < body and word_count(x.title) <= 8 and not re.match(r"[0-9]", strip(x.title))

    if len(found) < run:
        return found
    is_small = [small(x) for x in found]
    kept, at = [], 0
    while at < len(found):
        end = at + 1
        while end < len(found) and is_small[end] and is_small[end - 1] and found[end].rule == found[end - 1].rule:
            end += 1
        if is_small[at] and end - at >= run:
            found[at].text += "".join(f"\n{x.title} {x.text}" for x in found[at + 1 : end])
            kept.append(found[at])
        else:
            kept += found[at:end]
        at = end
    return kept if len(kept) == len(found) else _renumbered(kept)


_LEADING_NUMBER = compiled(P.U + r"^\s*\(?\d{1,2}(?:\.\d{1,3})*\)?[.):]?\s+")


def _named(x: Section) -> None:
    t = strip(x.title)
    bare = bool(_has(P.NUMBER_ONLY)(t))
    if not (bare or t.startswith("[preamble")):
        return
    body = _LEADING_NUMBER.sub("", x.text)
    if len(body) > 100 and (name := name_from_bold(body) or name_from_caps(body)) is not None:
        x.title = f"{t.rstrip('.')} {name}" if bare else name


_BLOCK_LINE = re.compile("(?<![^\n\r\x85  ])\x00BLK\x00(?=[\n\r\x85  ]|\\Z)\n?")
_BARE_TITLE = compiled(P.U + r"^(\d{1,2}(?:\.\d{1,3})*)\.?$")
_BARE_HEAD = compiled(P.U + r"^\(?(\d{1,2}(?:\.\d{1,3})*)\)?[.):]?\s+")


def _filled(x: Section, blocks: list[str]) -> None:
    """Title, payloads and prose of a section."""
    text = _BLOCK_LINE.sub("", x.text) if "\0" in x.text else x.text
    x.full = restored(text, blocks)
    x.title = strip(x.title.replace(P.BLOCK, ""))
    x.tables, x.figures = section_tables(x.full), section_figures(x.full)
    prose = section_prose(x.full)
    number, head = _BARE_TITLE.search(x.title), _BARE_HEAD.search(prose)
    x.text = prose[head.end() :] if number and head and head[1] == number[1] else prose
    x.words = word_count(x.text)


def _without_captions(found: list[Section]) -> list[Section]:
    guesses = [(x, FOLDED[x.title]) for x in found if x.rule in ("caps", "inferred", "block-lead")]
    if not guesses:
        return found
    parents = {x.parent for x in found if x.parent is not None}
    groups: dict[str, list[bool]] = defaultdict(list)
    for x, key in guesses:
        groups[key].append(x.words < 10 and x.order not in parents)
    gone = set()
    for x, key in guesses:
        if x.order in parents:
            continue
        running = len(groups[key]) >= 3 and all(groups[key])
        caption = x.words < 60 and bool(x.figures) and not x.tables
        empty = not x.tables and not x.figures and ((ATTACHED[x.title] or bool(parents)) if x.words < 4 else x.rule == "caps" and bool(parents) and x.words < 12)
        if running or caption or empty:
            gone.add(x.order)
    return _renumbered([x for x in found if x.order not in gone]) if gone else found


def sections_of(text: str) -> list[Section]:
    """The sections of one document."""
    d = Lines(text)
    found = _assembled(d)
    _nest(found)
    found = _collapsed(found)
    opened = None
    for x in found:
        _named(x)
        if ATTACHED[x.title]:
            opened = x.order
        elif x.parent is None:
            x.parent = opened
    parents = {x.parent for x in found}
    for x in found:
        x.container_only = x.words < 6 and x.order in parents
        _filled(x, d.blocks)
    return _without_captions(found)


# -- over all documents --------------------------------------------------------------------------

_LIST = pa.list_(pa.string())
SECTION_FIELDS = {
    "order": ("int", pa.int32()), "id": ("string", pa.string()), "title": ("string", pa.string()), "number": ("string", pa.string()), "parent": ("int", pa.int32()), "rule": ("string", pa.string()), "words": ("int", pa.int32()),
    "container_only": ("boolean", pa.bool_()), "text": ("string", pa.string()), "full": ("string", pa.string()), "tables": ("array<string>", _LIST), "figures": ("array<string>", _LIST),
}
LINE_FIELDS = {
    "line_no": ("int", pa.int32()), "line": ("string", pa.string()), "in_toc": ("boolean", pa.bool_()), "is_signature": ("boolean", pa.bool_()), "title": ("string", pa.string()), "rule": ("string", pa.string()),
}


def _lines_of(text: str) -> list[tuple]:
    d = Lines(text)
    marks = {k: (title, rule) for k, rule, title in d.marks}
    return [(k, line, d.in_toc[k], k in d.signatures, *marks.get(k, (None, None))) for k, line in enumerate(d.lines)]


def _each(docs: DataFrame, text_col: str, fields: dict, columns: list[str], rows_of: Callable[[str], tuple[list[tuple], int]]) -> DataFrame:
    kind = docs.schema["doc_key"].dataType.simpleString()
    types = [fields[c][1] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, rows, chars = batch.column(0), [], [], 0

            def out() -> pa.RecordBatch:
                held = [pa.array(list(v), t) for v, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *held], names=["doc_key", *columns])

            for k, text in enumerate(batch.column(1)):
                found, n = rows_of((text.as_py() or b"").decode("utf-8", "replace"))
                rows += found
                at += [k] * len(found)
                chars += n
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield out()
                    at, rows, chars = [], [], 0
            if rows:
                yield out()

    # Binary, as malformed UTF-8 is replaced and not an error.
    source = docs.select("doc_key", F.col(text_col).cast("string").cast("binary").alias("raw"))
    return source.mapInArrow(run, f"doc_key {kind}, " + ", ".join(f"`{c}` {fields[c][0]}" for c in columns))


def sections(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """The sections of every document of ``docs(doc_key, raw)``."""
    columns = list(SECTION_FIELDS)

    def rows_of(text: str) -> tuple[list[tuple], int]:
        found = sections_of(text)
        return [tuple(getattr(x, c) for c in columns) for x in found], sum(2 * len(x.full) for x in found)

    return _each(docs, text_col, SECTION_FIELDS, columns, rows_of)


def document_lines(docs: DataFrame, text_col: str = "raw") -> DataFrame:
    """``(doc_key, line_no, line, in_toc, is_signature, title, rule)`` of every line."""
    return _each(docs, text_col, LINE_FIELDS, list(LINE_FIELDS), lambda text: (_lines_of(text), len(text)))
