"""The pattern catalogue and text helpers for code that runs on one text at a time, in Python.

Patterns stay in Java's dialect; :func:`compiled` puts them into Python's. White space, word
characters and boundaries are those of ``(?U)``: Python's own differ for separators 1C to 1F,
marks and numerals that are no digits.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CIRCLED = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189), (0x200C, 0x200D))


@cache
def _categories() -> dict[str, list[tuple[int, int]]]:
    """Ranges of code points by general category."""
    found: dict[str, list[tuple[int, int]]] = {}
    start, of = 0, unicodedata.category("\0")
    for k in range(1, sys.maxunicode + 2):
        now = unicodedata.category(chr(k)) if k <= sys.maxunicode else ""
        if now != of:
            found.setdefault(of, []).append((start, k - 1))
            start, of = k, now
    return found


def _spelled(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@cache
def _property(name: str) -> str:
    """Inside of a character class for ``\\p{name}``, a general category or its first letter."""
    return _spelled(sorted(r for c, rs in _categories().items() if c.startswith(name) for r in rs))


@cache
def _word(negated: bool) -> str:
    inside = sorted([r for c, rs in _categories().items() if c[0] in "LM" or c in ("Nd", "Nl", "Pc") for r in rs] + list(_CIRCLED))
    if not negated:
        return _spelled(inside)
    outside, at = [], 0
    for a, b in inside:
        if a > at:
            outside.append((at, a - 1))
        at = max(at, b + 1)
    return _spelled([*outside, (at, sys.maxunicode)])


@cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern of the catalogue, which starts with its flags, ``d`` and ``U`` among them."""
    head = re.match(r"\(\?([dUims]+)\)", pattern)
    if not head or not {"d", "U"} <= set(head[1]):
        raise ValueError(f"not a pattern with (?dU): {pattern!r}")
    flags = (re.I if "i" in head[1] else 0) | (re.M if "m" in head[1] else 0) | (re.S if "s" in head[1] else 0)
    out, inside = [], False
    for token in re.findall(r"\\p\{\w+\}|\\.|.", pattern[head.end() :], re.S):
        chars = {r"\s": SPACE, r"\w": _word(False) if token == r"\w" else "", r"\W": _word(True) if token == r"\W" else ""}.get(token)
        if token.startswith(r"\p{"):
            chars = _property(token[3:-1])
        if token == "[" and not inside:
            inside = True
        elif token == "]" and inside:
            inside = False
        if chars is not None:
            token = chars if inside else f"[{chars}]"
        elif token == r"\S":
            token = f"[^{SPACE}]"
        elif token == r"\b":
            w = _word(False)
            token = f"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))"
        out.append(token)
    return re.compile("".join(out), flags)


class Memo(dict):
    """A pure function of one text that keeps a bounded number of its values for short texts."""

    MOST, LONGEST = 8192, 200

    def __init__(self, function: Callable[[str], object]):
        self.function = function

    def __missing__(self, text: str) -> object:
        value = self.function(text)
        if len(text) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[text] = value
        return value


_RUN = re.compile(f"[{SPACE}]+")
_WORDS = re.compile(f"[^{SPACE}]+")
_PLAIN = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: str) -> str:
    return text.strip(_PLAIN)


def words(text: str) -> list[str]:
    return _WORDS.findall(text)


def word_count(text: str) -> int:
    return len(_WORDS.findall(text))


def one_space(text: str) -> str:
    return _RUN.sub(" ", text).strip(_PLAIN)


def starts_upper(text: str) -> bool:
    return text[:1] != "" and unicodedata.category(text[0]) == "Lu"


def starts_lower(text: str) -> bool:
    return text[:1] != "" and unicodedata.category(text[0]) == "Ll"


def group(found: re.Match | None, k: int) -> str:
    """As ``regexp_extract``: empty without a match or where the group took no part."""
    return (found[k] or "") if found else ""
