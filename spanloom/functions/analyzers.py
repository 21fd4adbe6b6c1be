"""Analyzers: text to index terms, as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import fold

def dutch_tokens(c: Column) -> Column:
    """Runs of letters, digits and the signs that Dutch words hold; stops, brackets and apostrophes at the ends go, and so does
    what has neither a letter nor a digit. The signs are fixed values."""
    runs = F.regexp_extract_all(c, F.lit("[\\p{L}\\p{Nd}'\\-.()\\[\\]]+"), F.lit(0))
    bare = F.transform(runs, lambda w: F.regexp_replace(w, "[.()\\[\\]]|^'|'$", ""))
    return F.filter(bare, lambda w: w.rlike("[\\p{L}0-9]"))


ANALYZERS: dict[str, Callable[[Column], Column]] = {
    # words of letters and digits, folded
    "standard": lambda c: F.regexp_extract_all(fold(c), F.lit("[\\p{L}\\p{N}]+(?:['’-][\\p{L}\\p{N}]+)*"), F.lit(0)),
    "dutch": lambda c: F.transform(dutch_tokens(c), fold),
    # split at white space, folded
    "whitespace": lambda c: F.filter(F.split(fold(c), "\\s+"), lambda w: w != ""),
    # the whole value, folded
    "nontokenizing": lambda c: F.array(fold(c)),
    "untokenized": lambda c: F.array(fold(c)),
    # the value as it is
    "keyword": lambda c: F.array(c),
    # words as they are, without marks of punctuation inside
    "sensitive": lambda c: F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}]+"), F.lit(0)),
}


def analyze(c: Column, name: str = "standard") -> Column:
    """The terms of a text; null for null."""
    if name not in ANALYZERS:
        raise ValueError(f"unknown analyzer {name}")
    return ANALYZERS[name](c)


def register(name: str, f: Callable[[Column], Column]) -> None:
    ANALYZERS[name] = f


def remove_punctuation(c: Column) -> Column:
    """Punctuation and signs go, with blanks around; words stay."""
    return F.btrim(F.regexp_replace(c, "[\\p{P}\\p{S}]+", ""))
