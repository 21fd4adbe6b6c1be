"""Encoding of whole texts with a byte-level BPE vocabulary, by prefix dynamic programming.

For every prefix of a piece of text, the last token of its encoding is unique: it is the one token that
ends there and is a valid neighbour of the last token of the prefix before it. So a table with one
token per byte holds the encodings of all prefixes at once. A text can grow by appending to the table, and
after an edit only the part from the edit to the next common boundary is encoded again. Time is
linear in the text, also for long runs without a boundary.

Texts are cut into pieces in arrays of code points, for a whole Arrow batch at once; each distinct piece of a
batch is encoded once, and the ids are gathered back by array indexing.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import codepoints as cp

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: Pieces are kept with their ids in each worker up to this many; longer pieces than KEEP_BYTES are not kept.
KEEP_PIECES, KEEP_BYTES = 400_000, 64
#: Pieces of more bytes look up their candidate tokens with an automaton instead of slices.
LONG_PIECE = 256


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Of each code point: letter, digit, white space or other."""
    out = np.full(cp.LIMIT, OTHER, np.uint8)
    for code in range(cp.LIMIT):
        cat = unicodedata.category(chr(code))[0]
        if cat == "L":
            out[code] = LETTER
        elif cat == "N":
            out[code] = DIGIT
    # Unicode's White_Space property.
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def cut_pieces(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece starts (with the end of all as the last), and for each row the number of its first piece.

    The pieces are those of the vocabulary's pattern: an English contraction; letters, digits or signs, each with one
    blank before; white space up to the blank that belongs to what follows.
    """
    n = len(cps)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    kind = classes()[cps]
    row_start = np.zeros(n + 1, bool)
    row_start[offs] = True
    run_start = row_start[:n].copy()
    run_start[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(run_start)
    ends = np.append(starts[1:], n)
    cut = run_start.copy()
    # white space before something else in the same row
    blank = (kind[starts] == SPACE) & ~row_start[ends]
    s, e = starts[blank], ends[blank]
    attached = cps[e - 1] == 0x20
    cut[e[attached]] = False
    cut[e - 1] = True
    # contractions: a lone apostrophe that begins a piece, then letters
    sign = (kind[starts] == OTHER) & (ends - starts == 1) & ~row_start[ends]
    at = starts[sign]
    at = at[(cps[at] == 0x27) & cut[at] & (kind[np.minimum(at + 1, n - 1)] == LETTER)]
    if len(at):
        run_end = ends[np.searchsorted(starts, at + 1)]
        one = cps[at + 1]
        two = np.where(run_end > at + 2, cps[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 2, np.where(long, 3, 0))
        some = size > 0
        at, size, run_end = at[some], size[some], run_end[some]
        cut[at + 1] = False
        rest = at + size
        cut[rest[rest < run_end]] = True
    first = np.flatnonzero(cut)
    return np.append(first, n), np.searchsorted(first, offs)


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id with, for each, the two tokens it is merged from (itself twice, where there are none)."""

    key: str
    tokens: tuple[bytes, ...]
    left: np.ndarray
    right: np.ndarray
    proper: np.ndarray

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> Vocabulary:
        """Reads a file of base64 tokens and ranks, and derives each token's last merge by its ranks."""
        with open(path, "rb") as f:
            data = f.read()
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        tokens = [b""] * (max(rank.values()) + 1)
        for t, i in rank.items():
            tokens[i] = t
        ids = np.arange(len(tokens), dtype=np.int32)
        left, right, proper = ids.copy(), ids.copy(), np.ones(len(tokens), bool)
        for t, i in rank.items():
            if len(t) < 2:
                continue
            parts = [bytes([b]) for b in t]
            while len(parts) > 2:
                best, at = i, -1
                for k in range(len(parts) - 1):
                    r = rank.get(parts[k] + parts[k + 1], i)
                    if r < best:
                        best, at = r, k
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2 and all(p in rank for p in parts):
                left[i], right[i] = rank[parts[0]], rank[parts[1]]
            else:
                proper[i] = False  # merging never makes this token
        return Vocabulary(hashlib.md5(data).hexdigest(), tuple(tokens), left, right, proper)


class Encoder:
    """Encodes bytes of single pieces with a table of last tokens by prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.left = vocabulary.left.tolist()
        self.right = vocabulary.right.tolist()
        self.ids = {t: i for i, t in enumerate(self.tokens) if t and vocabulary.proper[i]}
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i and vocabulary.proper[i]}
        self.lengths = sorted({len(t) for t in self.ids}, reverse=True)
        self.kept: dict[str, tuple[int, ...]] = {}
        self._valid: dict[tuple[int, int], bool] = {}
        self._automaton = None

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token a directly before token b is how their bytes together are encoded.

        Takes both tokens apart along their shared edge, always the later merge first. If at some point the two
        pieces at the edge could have been merged before the last part was, the pair isn't valid.
        """
        key = (a, b)
        if len(self._valid) > 2_000_000:
            self._valid.clear()
        x, y, bound = a, b, len(self.tokens)
        while True:
            m = self.merged.get((x, y))
            if m is not None and m < bound:
                answer = False
                break
            if x > y:  # x was made later: undo it first
                bound, part = x, self.right[x]
                if part == x:
                    bound, part = y + 1, self.left[y]
                    if part == y:
                        answer = True
                        break
                    y = part
                else:
                    x = part
            else:
                bound, part = y + 1, self.left[y]
                if part == y:
                    bound, part = x, self.right[x]
                    if part == x:
                        answer = True
                        break
                    x = part
                else:
                    y = part
        self._valid[key] = answer
        return answer

    def _ending(self, data: bytes, start: int) -> Iterator[list[int]]:
        """For each end after `start`, the starts of the tokens that end there, longest first, in linear time."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for t in self.ids:
                self._automaton.add_word(t.decode("latin-1"), len(t))
            self._automaton.make_automaton()
        reach = max(0, start - self.lengths[0])
        end, found = start + 1, []
        for last, k in self._automaton.iter(data[reach:].decode("latin-1")):
            at = reach + last + 1
            if at <= start:
                continue
            while end < at:
                yield sorted(found)
                end, found = end + 1, []
            found.append(at - k)
        while end <= len(data):
            yield sorted(found)
            end, found = end + 1, []

    def extend(self, table: list[int], data: bytes) -> list[int]:
        """Goes on with the table of last tokens (entry 0 unused) of a prefix of `data`, up to its end."""
        start, get, known, longest = len(table) - 1, self.ids.get, self._valid.get, self.lengths[0]
        if len(data) - start > LONG_PIECE:
            ends = self._ending(data, start)
        else:
            ends = (range(max(0, end - longest), end) for end in range(start + 1, len(data) + 1))
        for end, starts in enumerate(ends, start=start + 1):
            for s in starts:
                token = get(data[s:end])
                if token is None:
                    continue
                valid = s == 0 or known((table[s], token))
                if valid is None:
                    valid = self.neighbours(table[s], token)
                if valid:
                    table.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        return table

    def walk(self, table: list[int]) -> tuple[int, ...]:
        """The encoding of the whole prefix: from its last token back."""
        out, end = [], len(table) - 1
        while end:
            out.append(table[end])
            end -= len(self.tokens[table[end]])
        return tuple(reversed(out))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.kept.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ids.get(data)
            ids = (whole,) if whole is not None else self.walk(self.extend([-1], data))
            if len(data) <= KEEP_BYTES:
                if len(self.kept) >= KEEP_PIECES:
                    self.kept.clear()
                self.kept[piece] = ids
        return ids

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch in one array, and the n + 1 offsets of its rows. Null and empty rows have none."""
        cps, offs = cp.from_arrow(texts)
        bounds, first = cut_pieces(cps, offs)
        if len(cps) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        data = cps.tobytes().decode("utf-32-le").encode("utf-8")
        at = cp.byte_offsets(cps)[bounds]
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)).dictionary_encode()
        codes = pieces.indices.to_numpy()
        encoded = [self.encode_piece(p) for p in pieces.dictionary.to_pylist()]
        sizes = np.array([len(e) for e in encoded], np.int64)
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        per_piece = sizes[codes]
        ids = flat[cp.ranges(starts[codes], per_piece)]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(per_piece, out=ends[1:])
        return ids, ends[first]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()


@dataclass
class EditableText:
    """A text with its pieces and the tables of those that were edited, for exact appends and re-encoding near edits."""

    encoder: Encoder
    pieces: list[str] = field(default_factory=list)
    #: A piece's table is made when an edit goes on from it.
    tables: list[list[int] | None] = field(default_factory=list)
    #: Each piece's ids.
    known: list[tuple[int, ...]] = field(default_factory=list)
    #: Pieces encoded by edits; shows that an edit costs what is near it.
    encoded: int = 0

    @staticmethod
    def of(encoder: Encoder, texts: pa.Array) -> Iterator[EditableText]:
        """The texts of an array, all cut at once."""
        cps, offs = cp.from_arrow(texts)
        if len(cps) == 0:
            yield from (EditableText(encoder) for _ in range(len(texts)))
            return
        bounds, first = cut_pieces(cps, offs)
        data = cps.tobytes().decode("utf-32-le").encode("utf-8")
        at = cp.byte_offsets(cps)[bounds]
        pieces = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        encoded = [encoder.encode_piece(p) for p in distinct]  # each distinct piece of all texts once
        codes, first = pieces.indices.to_pylist(), first.tolist()
        for a, b in zip(first[:-1], first[1:]):
            own = codes[a:b]
            yield EditableText(encoder, [distinct[c] for c in own], [None] * (b - a), [encoded[c] for c in own])

    #: A boundary depends on what follows by no more than this many pieces.
    REACH = 3

    def _split(self, text: str) -> list[str]:
        cps, offs = cp.from_arrow(pa.array([text], pa.string()))
        bounds, _ = cut_pieces(cps, offs)
        return [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def _table(self, piece: str, old: tuple[str, list[int] | None] | None) -> list[int]:
        """Goes on from an old piece's table, as far as the bytes agree."""
        data, table = piece.encode(), [-1]
        if old is not None:
            was = old[0].encode()
            same = next((i for i, (x, y) in enumerate(zip(data, was)) if x != y), min(len(data), len(was)))
            # without a table of the old piece, that of the common start is made now
            table = old[1][: same + 1] if old[1] is not None else self.encoder.extend([-1], data[:same])
        self.encoded += 1
        return self.encoder.extend(table, data)

    def __len__(self) -> int:
        """Characters."""
        return sum(map(len, self.pieces))

    def append(self, text: str) -> None:
        self.replace(len(self), 0, text)

    def replace(self, start: int, length: int, text: str) -> None:
        """Replaces `length` characters from `start`; only pieces near them are cut and encoded again."""
        ends = list(accumulate(map(len, self.pieces)))
        a = max(0, bisect_left(ends, start) - self.REACH)
        b = bisect_left(ends, start + length) + 1
        begin = ends[a - 1] if a else 0
        more = self.REACH
        while True:
            stop = min(len(self.pieces), b + more)
            region = "".join(self.pieces[a:stop])
            new = self._split(region[: start - begin] + text + region[start - begin + length :])
            if stop == len(self.pieces):
                break
            # the cut is good up to where the last REACH pieces agree with the old ones
            if new[-self.REACH :] == self.pieces[stop - self.REACH : stop] and len(new) > self.REACH:
                break
            more *= 2
        olds = list(zip(self.pieces[a:stop], self.tables[a:stop]))
        same = 0
        while same < min(len(olds), len(new)) and olds[same][0] == new[same]:
            same += 1
        tail = 0
        while tail < min(len(olds), len(new)) - same and olds[-1 - tail][0] == new[-1 - tail]:
            tail += 1
        middle = new[same : len(new) - tail]
        fresh = [self._table(p, olds[same] if i == 0 and same < len(olds) else None) for i, p in enumerate(middle)]
        end = stop - tail
        self.pieces[a + same : end] = middle
        self.tables[a + same : end] = fresh
        self.known[a + same : end] = [self.encoder.walk(t) for t in fresh]

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.known))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One per worker process and vocabulary; it keeps the pieces it has met."""
    if vocabulary.key not in _encoders:
        _encoders[vocabulary.key] = Encoder(vocabulary)
    return _encoders[vocabulary.key]


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """The key and `ids`, the token ids of the whole text without special tokens, for every row.

    Null and empty texts have an empty list. Strings of special tokens inside a text are ordinary text. Repeated rows stay.
    The vocabulary is read on the driver from `path` and sent to the tasks; it has a fixed size.
    """
    vocabulary = Vocabulary.load(path or default_path())
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            ids, offs = tool.encode_batch(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{key} {key_type}, ids array<int>")


def encode_edited(df: DataFrame, key: str, text: str, at: str, remove: str, insert: str, path: str | None = None) -> DataFrame:
    """Each text after an edit, encoded by going on from the tables of the text before it.

    at, remove, insert: expressions of the first character replaced (from 0), how many are, and by what; an edit behind the end is an append. Result: the
    key, `ids` of the edited text, `pieces` of it, and `encoded_again`, how many of them the edit encoded. Null texts and edits count as empty.
    """
    vocabulary = Vocabulary.load(path or default_path())
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            ids, pieces, again = [], [], []
            for kept, a, n, new in zip(EditableText.of(tool, batch.column(1)), *(batch.column(i).to_pylist() for i in range(2, 5))):
                length = len(kept)
                start = min(max(a or 0, 0), length)
                kept.replace(start, min(max(n or 0, 0), length - start), new or "")
                ids.append(kept.ids())
                pieces.append(len(kept.pieces))
                again.append(kept.encoded)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(pieces, pa.int64()), pa.array(again, pa.int64())], names=[key, "ids", "pieces", "encoded_again"])

    rows = df.select(F.col(key), F.col(text).alias("_text"), F.expr(at).cast("int").alias("_at"), F.expr(remove).cast("int").alias("_remove"), F.expr(insert).alias("_insert"))
    return rows.mapInArrow(run, f"{key} {key_type}, ids array<int>, pieces bigint, encoded_again bigint")


def count_tokens(df: DataFrame, text: str, into: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Adds the number of tokens of the text; 0 for null and empty texts. `into` must not be a column yet."""
    if into in df.columns:
        raise ValueError(f"{into} is a column already")
    vocabulary = Vocabulary.load(path or default_path())

    @F.arrow_udf("bigint")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = encoder(vocabulary)
        for t in texts:
            yield pa.array(np.diff(tool.encode_batch(t)[1]), pa.int64())

    return df.withColumn(into, run(F.col(text)))
