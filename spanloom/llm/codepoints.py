"""Arrow text as numpy arrays of code points, and back, without a call per row.

A batch of texts is (cps, offs): all code points in one array, and for n rows n + 1 offsets into it.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

LIMIT = sys.maxunicode + 1


def from_arrow(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a string array. Null rows are empty. Bytes that aren't UTF-8 become U+FFFD."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = arr.buffers()[2]
    raw = bytes(memoryview(data)[offs[0] : offs[-1]]) if data is not None else b""
    try:
        wide = raw.decode("utf-8").encode("utf-32-le")
    except UnicodeDecodeError:
        at = offs - offs[0]
        rows = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    return np.frombuffer(wide, "<u4"), before[offs - offs[0]]


def byte_offsets(cps: np.ndarray) -> np.ndarray:
    """For n code points, the n + 1 places in their UTF-8 bytes."""
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000), out=at[1:])
    return at


def to_arrow(cps: np.ndarray, offs: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A string array of the rows; `mask` marks null rows."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    at = byte_offsets(cps)[offs]
    valid = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data), valid).cast(pa.string())


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count) for each pair."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts - starts, counts)


def row_of(offs: np.ndarray) -> np.ndarray:
    """The row that each code point belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


class Replacements:
    """A lookup table from a code point to none, one or more code points; others stay as they are."""

    def __init__(self, pairs: dict[int, tuple[int, ...]]):
        self.count = np.ones(LIMIT, np.uint8)
        self.first = np.arange(LIMIT, dtype=np.uint32)
        self.start = np.zeros(LIMIT, np.int32)
        flat: list[int] = []
        for cp, to in pairs.items():
            self.count[cp] = len(to)
            if len(to) == 1:
                self.first[cp] = to[0]
            elif to:
                self.start[cp] = len(flat)
                flat.extend(to)
        self.flat = np.array(flat or [0], np.uint32)

    def apply(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[cps]
        if (counts == 1).all():
            return self.first[cps], offs
        wide = counts.astype(np.int64)
        out = np.repeat(self.first[cps], wide)
        at = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        many = np.flatnonzero(counts > 1)
        if len(many):
            out[ranges(at[many], wide[many])] = self.flat[ranges(self.start[cps[many]].astype(np.int64), wide[many])]
        return out, at[offs]


@lru_cache(maxsize=1)
def combining_classes() -> np.ndarray:
    out = np.zeros(LIMIT, np.uint8)
    for cp in range(LIMIT):
        if c := unicodedata.combining(chr(cp)):
            out[cp] = c
    return out


@lru_cache(maxsize=1)
def pair_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys base << 32 | mark and their composites, from the primary composites of the Unicode data."""
    found = []
    for cp in range(LIMIT):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            found.append((int(parts[0], 16) << 32 | int(parts[1], 16), cp))
    found.sort()
    return np.array([k for k, _ in found], np.uint64), np.array([c for _, c in found], np.uint32)


# Fixed values of Unicode's arithmetic for Hangul syllables.
_L, _V, _T, _S, _NL, _NV, _NT = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


def composites(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composite of each pair of code points, 0 where there is none."""
    keys, to = pair_table()
    want = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    out = np.where(keys[at] == want, to[at], 0).astype(np.int64)
    x, y = a.astype(np.int64), b.astype(np.int64)
    lv = (x >= _L) & (x < _L + _NL) & (y >= _V) & (y < _V + _NV)
    out[lv] = _S + ((x[lv] - _L) * _NV + y[lv] - _V) * _NT
    lvt = (x >= _S) & (x < _S + _NL * _NV * _NT) & ((x - _S) % _NT == 0) & (y > _T) & (y < _T + _NT)
    out[lvt] = x[lvt] + y[lvt] - _T
    return out


def order_marks(cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Canonical order: each run of marks sorted by combining class, stably; all runs of a batch in one sort."""
    ccc = combining_classes()[cps]
    if not ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        return cps
    heads = ccc == 0
    heads[offs[:-1][offs[:-1] < len(cps)]] = True
    # a row that starts with a mark still sorts it with the marks behind it
    order = np.lexsort((np.arange(len(cps)), ccc, np.cumsum(heads)))
    return cps[order]


def compose(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition of a decomposed and ordered batch: all starters take their next mark in each pass."""
    classes = combining_classes()
    rows = row_of(offs)
    n_rows = len(offs) - 1
    changed = False
    while len(cps):
        ccc = classes[cps]
        index = np.arange(len(cps))
        starter = np.maximum.accumulate(np.where(ccc == 0, index, -1))
        before = np.concatenate([[-1], starter[:-1]])
        there = (before >= 0) & (rows[np.maximum(before, 0)] == rows)
        last = np.concatenate([[0], ccc[:-1]])
        free = (before == index - 1) | ((last != 0) & (last < ccc))
        at = np.flatnonzero(there & free)
        to = composites(cps[before[at]], cps[at])
        at, to = at[to > 0], to[to > 0]
        if not len(at):
            break
        # a starter that is itself taken in this pass can't take another
        _, first = np.unique(before[at], return_index=True)
        at, to = at[first], to[first]
        taken = np.isin(before[at], at)
        at, to = at[~taken], to[~taken]
        cps = cps.copy()
        cps[before[at]] = to
        keep = np.ones(len(cps), bool)
        keep[at] = False
        cps, rows, changed = cps[keep], rows[keep], True
    if changed:
        offs = np.searchsorted(rows, np.arange(n_rows + 1))
    return cps, offs
