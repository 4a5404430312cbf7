"""HTML to a tree of blocks, with features of its nodes."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np

#: Elements whose content is never text of the page.
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "title", "textarea", "select", "math", "canvas", "audio", "video")
#: Possessive throughout, and what is left open runs to the end: linear on any input.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])[^>]*+(?<=/)>|<(" + "|".join(_RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTES = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_SPACE = re.compile(r"\s+")
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that run within a block; every other one is a node of the tree.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What an opening tag closes if it is open in the same container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
_STOPS = {"ul", "ol", "dl", "table", "body", "html"}

TAGS = ("#text", "html", "body", "div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "h3", "h4", "blockquote", "pre", "table", "tr", "td", "figure", "figcaption", "button", "dialog", "dl")
_TAG_NO = {t: k for k, t in enumerate(TAGS)}
#: Attribute tokens by what they tell, matched at word starts.
WORDS = {
    "menu": r"nav|menu|breadcrumb|tabs?\b|toolbar|pager|pagination|skip|toc\b",
    "top": r"header|masthead|topbar|site-?head|logo|brand",
    "bottom": r"footer|colophon|copyright|legal|site-?foot",
    "side": r"side|aside|widget|related|recommend|popular|trending|more-|rail\b|teaser|read-?next",
    "advert": r"ads?\b|ad-|advert|sponsor|promo|banner|outbrain|taboola|dfp",
    "notice": r"cookie|consent|gdpr|notice|alert|modal|popup|overlay|privacy|paywall|dialog|toast",
    "comment": r"comment|disqus|repl(?:y|ies)|discussion|respond|feedback",
    "form": r"form|search|login|signup|sign-|subscribe|newsletter|register",
    "share": r"shar(?:e|ing)|social|follow|tweet|author|byline|meta\b|tags?\b",
    "main": r"article|content|main|post|entry|story|body|text\b|prose|page-",
}
_WORD_RES = [re.compile(r"(?:^|[^a-z])(?:" + w + ")") for w in WORDS.values()]


@lru_cache(maxsize=1 << 14)
def attribute_flags(value: str) -> tuple[int, ...]:
    value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
    return tuple(int(bool(r.search(value))) for r in _WORD_RES)


@lru_cache(maxsize=1 << 14)
def named_by(attributes: str) -> str:
    """The class, id and role of a tag."""
    return " ".join((m[2] or m[3] or m[4] or "") for m in _ATTRIBUTES.finditer(attributes) if m[1].lower() in ("class", "id", "role", "aria-label"))


_NO_FLAGS = (0,) * len(WORDS)


class Tree:
    """Nodes in document order. Leaves hold text: runs of inline content between block tags."""

    def __init__(self, html: str):
        self.tag: list[int] = []
        self.parent: list[int] = []
        self.flags: list[tuple[int, ...]] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self.controls: list[int] = []
        self._build(html)

    def _node(self, tag: str, parent: int, flags: tuple[int, ...] = _NO_FLAGS) -> int:
        self.tag.append(_TAG_NO.get(tag, len(TAGS)))
        self.parent.append(parent)
        self.flags.append(flags)
        self.text.append("")
        self.links.append(0)
        self.controls.append(0)
        return len(self.tag) - 1

    def _build(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#root", self._node("#root", -1))]
        run: list[str] = []
        linked, in_link, at, head = 0, 0, 0, False

        def flush() -> None:
            nonlocal linked
            if run:
                text = _SPACE.sub(" ", unescape("".join(run))).strip()
                if text:
                    k = self._node("#text", stack[-1][1])
                    self.text[k] = text
                    self.links[k] = min(linked, len(text))
                run.clear()
            linked = 0

        opened: dict[str, int] = {}  # open elements by name: an end tag without one costs nothing

        def close() -> str:
            tag = stack.pop()[0]
            opened[tag] -= 1
            return tag

        for m in _TOKEN.finditer(html):
            if m.start() > at and not head:
                piece = html[at : m.start()]
                run.append(piece)
                if in_link:
                    linked += len(piece.strip())
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "head":
                head = not m[2]
                continue
            if tag == "body" and head:
                head = False
            if head:
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not m[2]
                elif tag == "br":
                    run.append(" ")
                continue
            flush()
            in_link = 0
            if m[2]:
                if opened.get(tag):
                    while close() != tag:
                        pass
                continue
            if tag in VOID:
                if tag == "input":
                    self.controls[stack[-1][1]] += 1
                continue
            if stack[-1][0] == "p":
                close()
            closes = _CLOSES.get(tag)
            if closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        while len(stack) > k:
                            close()
                        break
                    if stack[k][0] in _STOPS:
                        break
            value = named_by(m[4]) if m[4] and not m[4].isspace() else ""
            node = self._node(tag, stack[-1][1], attribute_flags(value) if value else _NO_FLAGS)
            if tag in ("button", "form"):
                self.controls[node] += 1
            if not m[4].endswith("/") or tag not in VOID:
                stack.append((tag, node))
                opened[tag] = opened.get(tag, 0) + 1
        if at < len(html) and not head:
            run.append(html[at:])
        flush()


FEATURES = (
    [f"tag {t}" for t in ("text", "container", "list", "heading", "paragraph")]
    + ["depth", "siblings", "place among siblings", "same-tag siblings", "children"]
    + ["text", "words", "texts below", "density", "link share", "sentence marks", "long texts below", "controls below", "place in page", "share of page", "capital start", "ends as a sentence"]
    + ["headings below", "paragraphs below", "items below"]
    + [f"own {w}" for w in WORDS]
    + [f"above {w}" for w in WORDS]
    + [f"above tag {t}" for t in ("nav", "header", "footer", "aside", "form", "article", "main", "li")]
    + [f"own tag {t}" for t in ("nav", "header", "footer", "aside", "form", "article", "main", "button", "dialog", "section", "div", "body", "figure", "blockquote", "pre", "table")]
    + ["parent text", "parent link share", "parent children", "before texts", "inside main candidate"]
)


def features(tree: Tree) -> np.ndarray:
    """``(nodes, len(FEATURES))`` in document order."""
    n = len(tree.tag)
    tag = np.array(tree.tag, np.int64)
    parent = np.array(tree.parent, np.int64)
    up = np.maximum(parent, 0)
    flags = np.array(tree.flags, np.float32)
    chars = np.array([len(t) for t in tree.text], np.float64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in tree.text], np.float64)
    marks = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in tree.text], np.float64)
    capital = np.array([t[:1].isupper() for t in tree.text], np.float64)
    ends = np.array([t[-1:] in (".", "!", "?", ":", '"', "”") for t in tree.text], np.float64)
    links, controls = np.array(tree.links, np.float64), np.array(tree.controls, np.float64)
    is_text = (tag == 0).astype(np.float64)
    depth, last = np.zeros(n), np.arange(n)
    parents = tree.parent
    above = flags.copy()
    kinds = [_TAG_NO[t] for t in ("nav", "header", "footer", "aside", "form", "article", "main", "li")]
    own_kind = np.stack([(tag == k) for k in kinds], axis=1).astype(np.float32)
    above_kind = own_kind.copy()
    children = np.bincount(up[1:], minlength=n).astype(np.float64) if n > 1 else np.zeros(n)
    place, same, seen, seen_tag = np.zeros(n), np.zeros(n), {}, {}
    for k in range(1, n):
        p = parents[k]
        depth[k] = depth[p] + 1
        place[k] = seen[p] = seen.get(p, -1) + 1
        key = (p, tree.tag[k])
        seen_tag[key] = seen_tag.get(key, 0) + 1
    for level in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == level)
        above[at] = np.maximum(above[at], above[parent[at]])
        above_kind[at] = np.maximum(above_kind[at], above_kind[parent[at]])
    for k in range(n - 1, 0, -1):
        last[parents[k]] = max(last[parents[k]], last[k])
        same[k] = seen_tag[parents[k], tree.tag[k]]

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(x)))
        return total[last + 1] - total[np.arange(n)]

    t_chars, t_words, t_texts, t_links, t_marks = map(below, (chars, words, is_text, links, marks))
    heading = ((tag >= _TAG_NO["h1"]) & (tag <= _TAG_NO["h4"])).astype(np.float64)
    paragraph, item = (tag == _TAG_NO["p"]).astype(np.float64), (tag == _TAG_NO["li"]).astype(np.float64)
    whole = max(t_chars[0], 1.0)
    before = np.concatenate(([0.0], np.cumsum(chars)))[:-1]
    link_share = t_links / np.maximum(t_chars, 1)
    container = np.isin(tag, [_TAG_NO[t] for t in ("div", "section", "article", "main", "body")]).astype(np.float64)
    lists = np.isin(tag, [_TAG_NO[t] for t in ("ul", "ol", "dl", "li")]).astype(np.float64)
    log = np.log1p
    columns = [is_text, container, lists, heading, paragraph, depth, children[up], place, same, children]
    columns += [log(t_chars), log(t_words), log(t_texts), t_chars / np.maximum(below(np.ones(n)), 1), link_share, t_marks / np.maximum(t_words, 1), below(words >= 12), below(controls), before / whole, t_chars / whole, capital, ends]
    columns += [below(heading), below(paragraph), below(item)]
    columns += list(flags.T) + list(above[up].T * (parent >= 0)) + list(above_kind[up].T * (parent >= 0))
    columns += [(tag == _TAG_NO[t]).astype(np.float64) for t in ("nav", "header", "footer", "aside", "form", "article", "main", "button", "dialog", "section", "div", "body", "figure", "blockquote", "pre", "table")]
    inside = np.maximum(above_kind[:, 5], above_kind[:, 6])
    columns += [log(t_chars[up]), link_share[up], children[up], log(np.cumsum(is_text) - is_text), inside]
    return np.stack(columns, axis=1).astype(np.float32)
