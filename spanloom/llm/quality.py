"""Per-document text quality: counts and shares, and a verdict between prose, list, table and junk.

Two sets of profiles are fitted to a bounded sample of hand-labelled documents, and to nothing else. A language profile is
the mean distribution, over labelled prose, of words over the bands of that language's common words; the language whose
profile is nearest to a text is the language it is read in. A structural profile is the mean, within a cluster of labelled texts
of one kind (and, of prose, of one language), of its function-word, character-class, step, word-size, line and repetition
distributions. All distances are Jensen-Shannon divergences. The verdict is the kind of the nearest structural
profile; a text that is farther from all prose than labelled prose is from the profiles of other prose isn't prose.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import features as ft

KINDS = ("prose", "list", "table", "junk")
#: A text that is near to nothing that was labelled.
OTHER = "other"
#: At most so many labelled documents of a kind are used, those with the least hash of their id; whole texts of each.
LABELLED_PER_KIND = 400
#: Profiles at most: of prose per language, and of each other kind.
PROSE_PROFILES, OTHER_PROFILES = 8, 32
#: A profile stands for at least two texts, and for so many on average.
TEXTS_PER_PROFILE = 3
#: Prose ends at this percentile of the distances of labelled prose from profiles it wasn't used for, times the factor.
PERCENTILE, FACTOR = 99, 1.15
#: Common words of all languages; the table of them is small and fixed, more are an error.
MOST_WORDS = 200_000
#: The distributions besides that of function words.
NAMES = tuple(ft.SHARES)


def _information(x: np.ndarray) -> np.ndarray:
    return (x * np.log2(x + np.float32(1e-12))).sum(-1)


def divergence(x: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of each row from each profile, summed over the distributions that lie side by side."""
    own, theirs = _information(x), _information(profiles)
    out = np.empty((len(x), len(profiles)), np.float32)
    for i in range(0, len(x), 2048):
        part = x[i : i + 2048]
        for j, p in enumerate(profiles):
            out[i : i + 2048, j] = (own[i : i + 2048] + theirs[j]) / 2 - _information((part + p) * np.float32(0.5))
    return out


def centres(x: np.ndarray, most: int, rounds: int = 8) -> np.ndarray:
    """Cluster means under the divergence: farthest points first, then means. Deterministic. A cluster of one text is given up
    to the others, unless there is but one text."""
    chosen = [x[0]]
    far = divergence(x, x[:1])[:, 0]
    while len(chosen) < min(most, max(1, len(x) // TEXTS_PER_PROFILE)) and far.max() > 1e-6:
        at = int(far.argmax())
        chosen.append(x[at])
        far = np.minimum(far, divergence(x, x[at : at + 1])[:, 0])
    c = np.array(chosen)
    for last in [False] * rounds + [True] * 3:
        near = divergence(x, c).argmin(1)
        size = np.bincount(near, minlength=len(c))
        least = 2 if last and (size >= 2).any() else 1
        c = np.array([x[near == j].mean(0) for j in np.flatnonzero(size >= least)])
    return c


@dataclass(frozen=True)
class Profiles:
    """key: a hash of all; kinds and points: structural profiles; languages: a row per language, zeros where no prose of it is labelled."""

    key: str
    kinds: tuple[str, ...]
    points: np.ndarray
    languages: np.ndarray
    radius: float
    common: ft.CommonWords


def read_in(function: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """The language of each text: that whose prose profile is nearest. function: texts x languages x bands."""
    far = np.full(function.shape[:2], np.inf, np.float32)
    for j, p in enumerate(languages):
        if p.any():
            far[:, j] = divergence(function[:, j], p[None])[:, 0]
    return far.argmin(1) if far.shape[1] else np.zeros(len(far), np.int64)


def stacked(shares: np.ndarray, function: np.ndarray, language: np.ndarray) -> np.ndarray:
    """All distributions side by side, that of function words in the text's own language, so that divergences add up."""
    if not function.shape[1]:
        return shares
    return np.concatenate([shares, function[np.arange(len(function)), language]], 1)


def _side_by_side(f: ft.Features) -> np.ndarray:
    return np.concatenate([f.shares[n] for n in NAMES], 1)


def _sample(documents: DataFrame, labels: DataFrame, common: ft.CommonWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, distributions, function words) of the labelled sample: at most LABELLED_PER_KIND texts of a kind, in the order of a hash.

    The tasks send distributions, about 300 numbers a text, and never the texts. Null and blank texts are left out.
    """
    marks = labels.where(F.col("kind").isin(*KINDS) & F.col("doc_id").isNotNull()).select("doc_id", "kind").distinct()
    few = None
    for kind in KINDS:
        part = marks.where(F.col("kind") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_PER_KIND)
        few = part if few is None else few.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = ft.features(batch.column(2), common)
            both = np.concatenate([_side_by_side(f), f.function.reshape(batch.num_rows, -1)], 1)
            offs = np.arange(batch.num_rows + 1, dtype=np.int32) * both.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(both.ravel(), pa.float32()))
            there = pa.array(f.counts["n_lines"] > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["kind", "h", "x"]).filter(there)

    texts = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("kind", F.xxhash64("doc_id").alias("h"), "text")
    rows = sorted(texts.mapInArrow(run, "kind string, h bigint, x array<float>").collect(), key=lambda r: (r["kind"], r["h"]))
    width, n_languages = sum(ft.SHARES.values()), len(common.languages)
    x = np.array([r["x"] for r in rows], np.float32).reshape(len(rows), width + n_languages * ft.N_BANDS)
    return np.array([r["kind"] for r in rows]), x[:, :width], x[:, width:].reshape(len(rows), n_languages, ft.N_BANDS)


def _language_profiles(kinds: np.ndarray, function: np.ndarray) -> np.ndarray:
    """Means over labelled prose, each text counted for the language whose common words cover most of it."""
    out = np.zeros(function.shape[1:], np.float32)
    if function.shape[1]:
        covered = function[:, :, -1].argmin(1)
        for j in range(function.shape[1]):
            own = function[(kinds == "prose") & (covered == j), j]
            if len(own):
                out[j] = own.mean(0)
    return out


def _prose(x: np.ndarray, kinds: np.ndarray, language: np.ndarray) -> list[np.ndarray]:
    groups = [(kinds == "prose") & (language == j) for j in np.unique(language)]
    return [centres(x[g], PROSE_PROFILES) for g in groups if g.any()]


def fitted(kinds: np.ndarray, shares: np.ndarray, function: np.ndarray, common: ft.CommonWords) -> Profiles:
    """Profiles of labelled texts."""
    # how far labelled prose is from profiles of other labelled prose
    distances = []
    for side in (0, 1):
        known = np.arange(len(kinds)) % 2 == side
        languages = _language_profiles(kinds[known], function[known])
        language = read_in(function, languages)
        x = stacked(shares, function, language)
        points = _prose(x[known], kinds[known], language[known])
        rest = ~known & (kinds == "prose")
        if points and rest.any():
            distances.append(divergence(x[rest], np.concatenate(points)).min(1))
    radius = float(np.percentile(np.concatenate(distances), PERCENTILE) * FACTOR) if distances else float("inf")
    languages = _language_profiles(kinds, function)
    language = read_in(function, languages)
    x = stacked(shares, function, language)
    points, names = _prose(x, kinds, language), []
    names += ["prose"] * sum(map(len, points))
    for kind in KINDS[1:]:
        if (own := kinds == kind).any():
            points.append(centres(x[own], OTHER_PROFILES))
            names += [kind] * len(points[-1])
    stack = np.concatenate(points) if points else np.zeros((0, x.shape[1]), np.float32)
    key = hashlib.md5(pickle.dumps((names, stack.tobytes(), languages.tobytes(), radius, common.hashes.tobytes()))).hexdigest()
    return Profiles(key, tuple(names), stack, languages, radius, common)


def fit(documents: DataFrame, labels: DataFrame, common_words: DataFrame) -> Profiles:
    """Profiles from the labelled sample. Tables without rows give no profiles, and then no verdicts."""
    words = common_words.select("lang", "word", "word_rank").where("lang IS NOT NULL AND word IS NOT NULL").distinct().limit(MOST_WORDS + 1).collect()
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words; they must be a small fixed table")
    common = ft.CommonWords.of([tuple(r) for r in sorted(words, key=str)])
    return fitted(*_sample(documents, labels, common), common)


def verdicts(f: ft.Features, p: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, divergence from the nearest profile, divergence from the nearest prose profile, and language of each text."""
    language = read_in(f.function, p.languages)
    d = divergence(stacked(_side_by_side(f), f.function, language), p.points)
    labels = np.array(p.kinds)
    prose = labels == "prose"
    from_prose = d[:, prose].min(1) if prose.any() else np.full(len(d), np.nan)
    best = d.argmin(1)
    kind, near = labels[best].astype(object), d.min(1)
    beyond = (kind == "prose") & (from_prose > p.radius)
    if beyond.any():
        others = np.flatnonzero(~prose)
        kind[beyond] = labels[others[d[beyond][:, others].argmin(1)]] if len(others) else OTHER
        near[beyond] = d[beyond][:, others].min(1) if len(others) else near[beyond]
    names = np.array([*p.common.languages, ""], dtype=object)
    return kind, near.astype(np.float64), from_prose.astype(np.float64), names[language] if len(p.common.languages) else np.full(len(d), "", object)


STATISTICS = "n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_share double, n_lines bigint, language string, kind string, divergence double, from_prose double"


def statistics(documents: DataFrame, key: str, text: str, profiles: Profiles) -> DataFrame:
    """One row per document: the key, counts and shares, the language it is read in, the nearest profile's kind and divergence, and that from prose.

    n_words: runs of letters, marks and digits, cut where hiragana, katakana and han meet. symbol_ratio: visible characters that are none of these.
    punctuated_lines: share of the lines with something visible that end in a full stop, question or exclamation mark. common_share: words in a
    list of common words of any language. Null and blank texts have counts of 0 and a null language, kind and divergences; without
    profiles all have. Texts are read whole.
    """
    key_type = dict(documents.dtypes)[key]
    some = len(profiles.kinds) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = ft.features(batch.column(1), profiles.common)
            n = batch.num_rows
            blank = (f.counts["n_lines"] == 0) | (not some)
            kind, near, prose, language = verdicts(f, profiles) if some else (np.full(n, "", object), np.zeros(n), np.zeros(n), np.full(n, "", object))
            c = f.counts
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(c["n_words"], pa.int64()),
                    *(pa.array(c[n_], pa.float64()) for n_ in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_share")),
                    pa.array(c["n_lines"], pa.int64()),
                    pa.array(language, pa.string(), mask=blank),
                    pa.array(kind, pa.string(), mask=blank),
                    pa.array(near, pa.float64(), mask=blank),
                    pa.array(prose, pa.float64(), mask=blank),
                ],
                names=[key, "n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "n_lines", "language", "kind", "divergence", "from_prose"],
            )

    return documents.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{key} {key_type}, {STATISTICS}")
