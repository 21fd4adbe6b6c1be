"""Folding of case and accents, and patterns on values, as column expressions that stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.plans.nodes import Value


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with accents and their bare letters; combining marks stand at the end, without a counterpart, and so are dropped."""
    src, dst, marks = [], [], []
    for code in range(0xC0, 0xFFFF):
        ch = chr(code)
        if 0xAC00 <= code < 0xE000:  # Hangul syllables and surrogates
            continue
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            src.append(ch)
            dst.append(parts[0])
    return "".join(src + marks), "".join(dst)


#: Characters that insensitive comparison ignores: soft hyphen, zero-width characters.
_IGNORED = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def strip_accents(c: Column) -> Column:
    src, dst = _accents()
    return _unless_ascii(c, c, F.translate(c, src, dst))


def _unless_ascii(test: Column, plain: Column, other: Column) -> Column:
    """Most words are ASCII and need no table: then bytes and characters are as many."""
    return F.when(F.octet_length(test) == F.char_length(test), plain).otherwise(other)


def fold(c: Column, sensitivity: str = "i") -> Column:
    """s: as stored; i: without case and accents; ci: without case; di: without accents. Soft hyphens and zero-width
    characters, which insensitive comparison ignores, go with i."""
    if sensitivity == "s":
        return c
    if sensitivity == "ci":
        return F.lower(c)
    if sensitivity == "di":
        return strip_accents(c)
    src, dst = _accents()
    low = F.lower(c)
    return _unless_ascii(c, low, F.translate(low, src + _IGNORED, dst))


def fold_text(text: str, sensitivity: str = "i") -> str:
    """The same on a Python string."""
    if sensitivity in ("i", "ci"):
        text = text.lower()
    if sensitivity in ("i", "di"):
        src, dst = _accents()
        text = text.translate({ord(c): dst[i] if i < len(dst) else None for i, c in enumerate(src)})
    return re.sub(f"[{_IGNORED}]", "", text) if sensitivity == "i" else text


def fold_regex(pattern: str, sensitivity: str) -> str:
    """Folds a pattern's literal characters and leaves its escapes alone, so `\\W` doesn't turn into `\\w`."""
    return "".join(p if p.startswith("\\") else fold_text(p, sensitivity) for p in re.findall(r"\\.|[^\\]", pattern, re.DOTALL))


#: Characters that need an escape in a Java regular expression.
_ESCAPED = set("\\.[]{}()*+-?^$|&~#<>@\"")


def escape_regex(text: str) -> str:
    return "".join("\\" + c if c in _ESCAPED and c not in "<>@\"~#" else c for c in text)


def wildcard_regex(text: str) -> str:
    """`*` any characters, `?` one character."""
    return "".join(".*" if c == "*" else "." if c == "?" else escape_regex(c) for c in text)


def range_regex(low: int, high: int) -> str:
    """A regular expression for the decimal numbers from low to high, without leading zeros."""
    if low > high or low < 0:
        raise ValueError("a range needs 0 <= low <= high")

    def digits(a: int, b: int) -> str:
        return str(a) if a == b else f"[{a}-{b}]"

    def same_length(a: str, b: str) -> list[str]:
        if a == b:
            return [a]
        if len(a) == 1:
            return [digits(int(a), int(b))]
        head_a, head_b = int(a[0]), int(b[0])
        rest = len(a) - 1
        if head_a == head_b:
            return [a[0] + r for r in same_length(a[1:], b[1:])]
        out = []
        first = head_a if a[1:] == "0" * rest else head_a + 1
        last = head_b if b[1:] == "9" * rest else head_b - 1
        if first > head_a:
            out += [a[0] + r for r in same_length(a[1:], "9" * rest)]
        if first <= last:
            out.append(digits(first, last) + "[0-9]" + (f"{{{rest}}}" if rest > 1 else ""))
        if last < head_b:
            out += [b[0] + r for r in same_length("0" * rest, b[1:])]
        return out

    parts: list[str] = []
    for size in range(len(str(low)), len(str(high)) + 1):
        a = max(low, 10 ** (size - 1) if size > 1 else 0)
        b = min(high, 10**size - 1)
        if a <= b:
            parts += same_length(str(a), str(b))
    return "|".join(parts)


def matches(c: Column, value: Value, sensitivity: str = "i", folded: bool = False) -> Column:
    """Whether a value matches as a whole. A null value never does; the result is never null. folded: c is folded already."""
    how = value.sensitivity or sensitivity
    v = c if folded else fold(c, how)
    if value.kind == "range":
        test = c.rlike(f"^(?:{range_regex(value.low, value.high)})$")
    elif value.kind == "literal":
        test = v == F.lit(fold_text(value.text, how))
    elif value.kind == "prefix":
        test = v.startswith(fold_text(value.text, how))
    elif value.kind == "wildcard":
        test = v.rlike(f"^(?:{wildcard_regex(fold_text(value.text, how))})$")
    elif value.kind == "fuzzy":  # at most `high` edits, the first `low` characters fixed
        text = fold_text(value.text, how)
        test = F.levenshtein(v, F.lit(text), value.high) >= 0
        if value.low:
            test = test & v.startswith(text[: value.low])
    elif value.text == ".*":
        return c.isNotNull()
    else:
        test = v.rlike(f"^(?:{fold_regex(value.text, how)})$")
    return c.isNotNull() & test if folded else F.coalesce(test, F.lit(False))
