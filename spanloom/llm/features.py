"""Counts and distributions of texts, computed for a whole Arrow batch in arrays of code points."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spanloom.llm import codepoints as cp

# Character classes, from the fine to the coarse: name, coarse class.
CLASSES = (
    ("lower", "letter"), ("upper", "upper"), ("accented", "letter"), ("cyrillic", "letter"), ("greek", "letter"), ("hiragana", "letter"), ("katakana", "letter"), ("han", "letter"), ("letter", "letter"),
    ("mark", "letter"), ("digit", "digit"), ("blank", "blank"), ("tab", "tab"), ("line", "line"), ("stop", "stop"), ("comma", "comma"), ("colon", "comma"), ("quote", "quote"),
    ("bracket", "symbol"), ("dash", "dash"), ("slash", "symbol"), ("pipe", "tab"), ("relation", "symbol"), ("underscore", "symbol"), ("symbol", "symbol"), ("graphic", "graphic"), ("control", "graphic"),
)
NAMES = tuple(n for n, _ in CLASSES)
COARSE = tuple(dict.fromkeys(c for _, c in CLASSES))
FINE = {n: i for i, n in enumerate(NAMES)}
TO_COARSE = np.array([COARSE.index(c) for _, c in CLASSES], np.uint8)


def _is(*names: str) -> np.ndarray:
    """A table over the fine classes: whether a class is one of those named."""
    return np.isin(np.arange(len(NAMES)), [FINE[n] for n in names])


_LETTERS = ("lower", "upper", "accented", "cyrillic", "greek", "hiragana", "katakana", "han", "letter", "mark")
IS_WORD = _is(*_LETTERS, "digit")
IS_SOLID = ~_is("blank", "line", "tab")
IS_INDENT = _is("tab", "blank")
#: Classes of a line's first and last characters.
START = np.select([_is("upper"), _is("lower", "accented", "cyrillic", "greek", "letter"), _is("digit"), _is("dash"), _is("bracket"), _is("hiragana", "katakana", "han"), _is("quote")], [0, 2, 3, 4, 5, 6, 7], 8)
END = np.select([_is("stop"), _is(*_LETTERS), _is("digit"), _is("comma"), _is("quote"), _is("bracket")], [0, 1, 2, 3, 4, 5], 6)
#: Scripts written without blanks: where one of these ends and another begins, so does a word.
UNSPACED = np.select([_is("hiragana"), _is("katakana"), _is("han")], [1, 2, 3], 0).astype(np.uint8)
#: Bands of a language's common words, by rank; the last band of a distribution is for all other words.
BANDS = (2, 3, 5, 9, 17, 33)
N_BANDS = len(BANDS) + 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _class(ch: str) -> str:
    code, cat = ord(ch), unicodedata.category(ch)
    if ch in "\n\r\v\f\x85  ":
        return "line"
    if ch == "\t":
        return "tab"
    if cat == "Zs":
        return "blank"
    if code in (0xFFFD, 0xFFFC) or 0x2500 <= code < 0x2600:
        return "graphic"
    if cat[0] == "L":
        if code < 0x80:
            return "lower" if cat == "Ll" else "upper"
        if 0x400 <= code < 0x530:
            return "cyrillic"
        if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
            return "greek"
        if 0x3040 <= code < 0x30A0:
            return "hiragana"
        if 0x30A0 <= code < 0x3100 or 0x31F0 <= code < 0x3200:
            return "katakana"
        if 0x4E00 <= code < 0xA000 or 0x3400 <= code < 0x4DC0 or 0x20000 <= code:
            return "han"
        return "accented" if code < 0x250 else "letter"
    if cat[0] == "M":
        return "mark"
    if cat[0] == "N":
        return "digit"
    if ch in ".!?…。！？｡":
        return "stop"
    if ch in ",、，;；":
        return "comma"
    if ch in ":：":
        return "colon"
    if cat in ("Pi", "Pf") or ch in "\"'„「」『』":
        return "quote"
    if cat in ("Ps", "Pe"):
        return "bracket"
    if cat == "Pd" or ch in "•*·‣◦":
        return "dash"
    if ch in "/\\":
        return "slash"
    if ch in "|¦":
        return "pipe"
    if ch in "=<>+~":
        return "relation"
    if ch == "_":
        return "underscore"
    if cat in ("Cc", "Cs", "Co", "Cn") or cat == "Cf":
        return "control"
    return "symbol"


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point, and its lower case where that is one code point."""
    kind = np.full(cp.LIMIT, FINE["control"], np.uint8)
    lower = np.arange(cp.LIMIT, dtype=np.uint32)
    for code in range(0x30000):
        ch = chr(code)
        kind[code] = FINE[_class(ch)]
        low = ch.lower()
        if low != ch and len(low) == 1:
            lower[code] = ord(low)
    return kind, lower


def word_hashes(cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word in lower case, of whatever length."""
    _, lower = tables()
    some = np.flatnonzero(sizes > 0)
    out = np.zeros(len(starts), np.uint64)
    if len(some):
        n = sizes[some].astype(np.int64)
        power = np.cumprod(np.full(int(n.max()), _BASE, np.uint64))
        first = np.cumsum(n) - n
        place = cp.ranges(np.zeros(len(n), np.int64), n)
        chars = lower[cps[cp.ranges(starts[some].astype(np.int64), n)]].astype(np.uint64)
        out[some] = np.add.reduceat((chars + np.uint64(1)) * power[place], first)
    return out


@dataclass(frozen=True)
class CommonWords:
    """Frequent words of some languages: sorted hashes of all of them, and for each word and language its band, or the last one."""

    languages: tuple[str, ...]
    hashes: np.ndarray
    bands: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str | None, str | None, int | None]]) -> CommonWords:
        """rows: language, word, rank. Rows without language or word are left out, without a rank the word is in the last of its bands."""
        best: dict[tuple[str, str], int] = {}
        for lang, word, rank in rows:
            if lang and word:
                rank = 1 << 30 if rank is None else rank
                best[lang, word] = min(best.get((lang, word), 1 << 30), rank)
        languages = tuple(sorted({lang for lang, _ in best}))
        if not best:
            return CommonWords(languages, np.zeros(0, np.uint64), np.zeros((0, 0), np.int64))
        keys = list(best)
        cps, offs = cp.from_arrow(pa.array([w for _, w in keys], pa.string()))
        each = word_hashes(cps, offs[:-1], np.diff(offs))
        hashes, at = np.unique(each, return_inverse=True)
        bands = np.full((len(hashes), len(languages)), N_BANDS - 1, np.int64)
        ranked = np.searchsorted(np.array(BANDS), np.array([best[k] for k in keys]), side="right")
        for i, (lang, _) in enumerate(keys):
            j = languages.index(lang)
            bands[at[i], j] = min(bands[at[i], j], ranked[i])
        return CommonWords(languages, hashes, bands)


@dataclass
class Features:
    """Of n texts: `counts`, name to array; `shares`, name to an n x k array of distributions (rows of sum 1 or 0); and
    `function`, an n x languages x N_BANDS array, the distribution of the words over each language's common words."""

    counts: dict[str, np.ndarray]
    shares: dict[str, np.ndarray]
    function: np.ndarray


def _rows(row: np.ndarray, value: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row * np.int64(k) + value, weight, minlength=n * k).reshape(n, k).astype(np.float32)


def _share(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)


def _bucket(x: np.ndarray, bounds: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(bounds), x, side="right")


SHARES = {"chars": len(CLASSES), "steps": len(COARSE) ** 2, "word_size": 12, "line_start": 9, "line_end": 7, "line_words": 9, "cells": 8, "repeat": 8}


#: Texts are done in slices of about so many characters, which fit a processor's cache.
SLICE = 400_000


def features(texts: pa.Array, common: CommonWords) -> Features:
    """Null texts count as empty."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    slot = np.cumsum(size) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(texts)]
    parts = [_features(texts.slice(a, b - a), common) for a, b in zip(cuts[:-1], cuts[1:])]
    join = lambda what, name: np.concatenate([getattr(p, what)[name] for p in parts])
    if len(parts) == 1:
        return parts[0]
    return Features({k: join("counts", k) for k in parts[0].counts}, {k: join("shares", k) for k in parts[0].shares}, np.concatenate([p.function for p in parts]))


def _features(texts: pa.Array, common: CommonWords) -> Features:
    cps, offs = cp.from_arrow(texts)
    n, m = len(offs) - 1, len(cps)
    if m == 0:
        zero = np.zeros(n)
        names = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "n_lines", "n_letters")
        return Features({k: zero for k in names}, {k: np.zeros((n, d), np.float32) for k, d in SHARES.items()}, np.zeros((n, len(common.languages), N_BANDS), np.float32))
    kinds, lower = tables()
    kind = kinds[cps]
    row = cp.row_of(offs)
    shares: dict[str, np.ndarray] = {}
    n_fine, k = len(CLASSES), len(COARSE)
    by_class = _rows(row, kind, n, n_fine)
    shares["chars"] = _share(by_class)
    coarse = TO_COARSE[kind]
    edge = np.zeros(m + 1, bool)
    edge[offs] = True
    inside = ~edge[1:m]
    steps = (row[1:] * (k * k) + (coarse[:-1] * np.uint8(k) + coarse[1:]))[inside]
    shares["steps"] = _share(np.bincount(steps, minlength=n * k * k).reshape(n, k * k).astype(np.float32))

    # words: runs of letters, marks and digits, cut where a script without blanks gives way to another
    wordy = IS_WORD[kind]
    script = UNSPACED[kind]
    turn = np.zeros(m + 1, bool)
    turn[1:m] = script[1:] != script[:-1]
    turn |= edge
    begin = wordy & turn[:m]
    begin[1:] |= wordy[1:] & ~wordy[:-1]
    starts = np.flatnonzero(begin)
    stop = wordy & turn[1:]
    stop[:-1] |= wordy[:-1] & ~wordy[1:]
    sizes = np.flatnonzero(stop) + 1 - starts
    word_row = row[starts]
    n_words = np.bincount(word_row, minlength=n)
    hashes = word_hashes(cps, starts, sizes)
    known = np.zeros(len(hashes), bool)
    function = np.zeros((n, len(common.languages), N_BANDS), np.float32)
    if len(common.hashes):
        at = np.minimum(np.searchsorted(common.hashes, hashes), len(common.hashes) - 1)
        known = common.hashes[at] == hashes
        listed, owner = at[known], word_row[known]
        for j in range(len(common.languages)):
            own = _rows(owner, common.bands[listed, j], n, N_BANDS)
            own[:, -1] += n_words - own.sum(1)
            function[:, j] = _share(own)
    shares["word_size"] = _share(_rows(word_row, np.minimum(_bucket(sizes, [2, 3, 4, 5, 6, 7, 8, 10, 13, 18, 30]), 11), n, 12))
    pair = word_row[1:] == word_row[:-1]
    same = pair & (hashes[1:] == hashes[:-1])
    one = inside & (cps[1:] == cps[:-1]) & (kind[1:] != FINE["blank"])
    two = np.zeros(m - 1, bool)
    two[1:] = inside[1:] & inside[:-1] & (cps[2:] == cps[:-2])
    length = np.maximum(np.diff(offs), 1)
    rep_word = np.bincount(word_row[1:][same], minlength=n) / np.maximum(n_words, 1)
    rep_one = np.bincount(row[1:][one], minlength=n) / length
    rep_two = np.bincount(row[1:][two], minlength=n) / length
    # 40 bits of the hash are enough within one text
    keys = np.sort(word_row.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    fresh = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(n_words, 1)
    rep = np.stack([rep_word, 1 - rep_word, rep_one, 1 - rep_one, rep_two, 1 - rep_two, distinct, 1 - distinct], 1).astype(np.float32)
    shares["repeat"] = rep / 4

    # lines with something other than blanks
    newline = (kind == FINE["line"]) | edge[:m]
    line = np.cumsum(newline) - 1
    solid = np.flatnonzero(IS_SOLID[kind])
    n_lines = int(line[-1]) + 1
    first = np.full(n_lines, -1, np.int64)
    last = np.full(n_lines, -1, np.int64)
    line_of = line[solid]
    change = np.flatnonzero(line_of[1:] != line_of[:-1])
    if len(solid):
        heads, tails = np.append(0, change + 1), np.append(change, len(solid) - 1)
        first[line_of[heads]] = solid[heads]
        last[line_of[tails]] = solid[tails]
    real = np.flatnonzero(first >= 0)
    a, b = first[real], last[real]
    line_row = row[a]
    # how much of the text is in the line: what most of the text is counts, not most of the lines
    weight = (b - a + 1).astype(float)
    indented = np.zeros(len(a), bool)
    indented[a > 0] = (~edge[a] & IS_INDENT[kind[a - 1]])[a > 0]
    start_class = START[kind[a]]
    start_class[(start_class == 2) & indented] = 1
    shares["line_start"] = _share(_rows(line_row, start_class, n, 9, weight))
    end_class = END[kind[b]]
    shares["line_end"] = _share(_rows(line_row, end_class, n, 7, weight))
    words_in = np.bincount(line[starts], minlength=n_lines)[real]
    shares["line_words"] = _share(_rows(line_row, _bucket(words_in, [1, 2, 3, 4, 6, 9, 16, 30]), n, 9, weight))

    def in_line(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[np.flatnonzero(mask)], minlength=n_lines)[real]

    comma = in_line(cps == 0x2C)
    semi = in_line(cps == 0x3B)
    pipe = in_line((kind == FINE["pipe"]) | (kind == FINE["tab"]))
    wide = np.zeros(m, bool)
    blank = kind == FINE["blank"]
    wide[2:] = blank[2:] & blank[1:-1] & blank[:-2]
    gaps = in_line(wide)
    cells = np.maximum.reduce([pipe, gaps, np.where(comma * 3 >= words_in, comma, 0), np.where(semi * 3 >= words_in, semi, 0)])
    shares["cells"] = _share(_rows(line_row, np.minimum(cells, 3) * 2 + (in_line(kind == FINE["digit"]) * 5 > (b - a)), n, 8, weight))

    ends = np.bincount(line_row[end_class == 0], minlength=n)
    lines = np.bincount(line_row, minlength=n)
    visible = by_class.sum(1) - by_class[:, [FINE["blank"], FINE["tab"], FINE["line"]]].sum(1)
    text = by_class[:, : FINE["digit"] + 1].sum(1)
    counts = {
        "n_words": n_words,
        "mean_word_length": np.bincount(word_row, sizes, minlength=n) / np.maximum(n_words, 1),
        "symbol_ratio": (visible - text) / np.maximum(visible, 1),
        "punctuated_lines": ends / np.maximum(lines, 1),
        "common_share": np.bincount(word_row[known], minlength=n) / np.maximum(n_words, 1),
        "n_lines": lines,
        "n_letters": by_class[:, : FINE["digit"]].sum(1),
    }
    return Features(counts, shares, function)
