"""One form for text that looks the same: full-width forms, ligatures, composed and decomposed accents,
invisible characters, kinds of blanks and look-alike letters of other scripts.

Each Arrow batch is turned into arrays of code points (see `codepoints`). A lookup-table gather with
expansion offsets does all replacements, a sort within runs puts marks in canonical order, and vectorised
passes compose them. No call is made per row.

The look-alikes come from the confusables data of the Unicode security mechanisms (UTS 39), which Spark's own
copy of ICU holds. They are narrowed to what the eye can't tell apart: only letters and signs outside ASCII are
replaced, by an ASCII character of the same general category; combining marks are never exchanged, so
visible accents stay; signs that the accepted forms themselves use keep their identity.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import codepoints as cp

# Kinds of compatibility decomposition that keep the look of a character.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
# Invisible characters outside the category Cf.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)
VARIATION = (range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0))


def invisible(ch: str) -> bool:
    code = ord(ch)
    return unicodedata.category(ch) == "Cf" or code in INVISIBLE or any(code in r for r in VARIATION)


def confusable_classes(spark: SparkSession) -> dict[str, str]:
    """Each assigned letter, digit or sign and its UTS 39 skeleton, in one call to ICU in the driver's JVM.

    Without a JVM at hand or ICU in it, look-alikes can't be told, and that is an error.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        raise RuntimeError("look-alike characters come from ICU in the driver's JVM, which this session has no way to")
    return _classes_of(jvm)


_classes: dict[str, str] = {}


def _classes_of(jvm) -> dict[str, str]:
    if not _classes:
        # a character that is canonically equal to others goes by them
        chars = [c for c in map(chr, range(0x21, 0x20000)) if unicodedata.category(c)[0] in "LNPS" and unicodedata.decomposition(c)[:1] in ("", "<")]
        checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = checker.getSkeleton("\n".join(chars)).split("\n")
        if len(skeletons) != len(chars):
            raise RuntimeError(f"ICU gave {len(skeletons)} skeletons for {len(chars)} characters")
        _classes.update(zip(chars, skeletons))
    return _classes


def look_alikes(classes: dict[str, str], keep: Iterable[str] = ()) -> dict[str, str]:
    """Non-ASCII characters to the ASCII character of the same category that they look like.

    `keep`: accepted forms; signs (not letters or digits) that they use aren't replaced.
    """
    kept = {c for form in keep for c in form if not c.isalnum()}
    ascii_by: dict[str, list[str]] = {}
    for c in map(chr, range(0x21, 0x7F)):
        ascii_by.setdefault(classes.get(c, c), []).append(c)
    out = {}
    for c, skeleton in classes.items():
        if c < "\x80" or c in kept:
            continue
        group = lambda x: unicodedata.category(x) if x.isalpha() else unicodedata.category(x)[0]
        want = group(c)
        letters = {"Lo": ("Ll", "Lu", "P"), "Lm": ("Ll",)}.get(want, (want,))
        signs = {"P": ("P", "S"), "S": ("S", "P")}.get(want, letters)
        for kind in signs:
            if hits := [a for a in ascii_by.get(skeleton, ()) if group(a) == kind]:
                out[c] = hits[0]
                break
    return out


def expand(ch: str, alikes: dict[str, str]) -> str:
    """What a character is replaced by, to the end."""
    if ch in alikes:
        return alikes[ch]
    parts = unicodedata.decomposition(ch).split()
    if parts and (parts[0][0] != "<" or parts[0] in SAME_LOOK):
        out = "".join(chr(int(p, 16)) for p in parts if p[0] != "<")
        if parts[0] == "<compat>" and " " in out:
            return ch  # spacing accents: a blank with a mark
        return "".join(expand(c, alikes) for c in out)
    return "" if invisible(ch) else ch


@dataclass(frozen=True)
class Spec:
    """The replacements of one configuration, made on the driver and sent to the tasks; about 7,000 entries."""

    key: str
    pairs: tuple[tuple[int, tuple[int, ...]], ...]
    back: tuple[tuple[str, tuple[tuple[int, int], ...]], ...]

    @staticmethod
    def of(classes: dict[str, str], keep: Iterable[str] = ()) -> Spec:
        kept = frozenset(c for form in keep for c in form if not c.isalnum())
        key = (hash(frozenset(classes.items())), kept)
        if key not in _specs:
            if len(_specs) > 15:
                _specs.clear()
            _specs[key] = Spec._made(classes, kept)
        return _specs[key]

    @staticmethod
    def _made(classes: dict[str, str], kept: frozenset[str]) -> Spec:
        alikes = look_alikes(classes, kept)
        pairs = []
        for code in range(0x80, cp.LIMIT):
            ch = chr(code)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Cs", "Co") or 0xAC00 <= code < 0xD7A4 or ch in kept:
                continue
            if invisible(ch):
                pairs.append((code, ()))
            elif cat == "Zs":
                pairs.append((code, (0x20,)))
            elif (to := expand(ch, alikes)) != ch:
                pairs.append((code, tuple(map(ord, to))))
        back: dict[str, dict[int, int]] = {"CYRILLIC": {}, "GREEK": {}}
        for src in sorted(alikes):
            for script, to in back.items():
                if unicodedata.name(src, "").startswith(script) and alikes[src].isalpha():
                    to.setdefault(ord(alikes[src]), ord(src))
        frozen = tuple(pairs), tuple((s, tuple(to.items())) for s, to in back.items())
        return Spec(hashlib.md5(repr(frozen).encode()).hexdigest(), *frozen)


#: Made specs, by the look-alike data and the signs that are kept.
_specs: dict[tuple, Spec] = {}


class Canonicaliser:
    """The tables of one configuration. `skeleton` maps equal looks to equal text, `resolve` gives it back a script."""

    # Where the two scripts lie.
    blocks = {"CYRILLIC": (0x400, 0x530), "GREEK": (0x370, 0x400)}

    def __init__(self, spec: Spec):
        self.table = cp.Replacements(dict(spec.pairs))
        self.back = {}
        for script, to in spec.back:
            table = np.zeros(128, np.uint32)
            for a, b in to:
                table[a] = b
            self.back[script] = table

    def skeleton(self, cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cps, offs = self.table.apply(cps, offs)
        return cp.compose(cp.order_marks(cps, offs), offs)

    def resolve(self, cps: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Gives words whose only telling letters are of another script their letters of that script back.

        A word is a run of letters and marks. This depends on the skeleton alone, so equal looks stay equal.
        """
        if not (cps >= 0x370).any():
            return cps
        starts = np.zeros(len(cps), bool)
        starts[offs[:-1][offs[:-1] < len(cps)]] = True
        lower = cps | 0x20
        latin = (cps < 0x80) & (lower >= 0x61) & (lower <= 0x7A)
        marks = cp.combining_classes()[cps] > 0
        other = {s: (cps >= a) & (cps < b) for s, (a, b) in self.blocks.items()}
        letter = latin | marks | other["CYRILLIC"] | other["GREEK"]
        word = np.cumsum(starts | ~letter | np.concatenate([[True], ~letter[:-1]]))
        out = cps.copy()
        for script, here in other.items():
            table = self.back[script]
            could = np.where(latin, table[np.where(latin, cps, 0)], 0)
            telling = np.zeros(word[-1] + 1, bool)
            telling[word[here]] = True
            against = np.zeros(word[-1] + 1, bool)
            against[word[latin & (could == 0)]] = True
            change = latin & telling[word] & ~against[word] & (could > 0)
            out[change] = could[change]
        return out

    def skeletons(self, texts: pa.Array) -> pa.Array:
        return cp.to_arrow(*self.skeleton(*cp.from_arrow(texts)))

    def forms(self, texts: pa.Array) -> pa.Array:
        """The one form of each text; null stays null, empty stays empty."""
        cps, offs = self.table.apply(*cp.from_arrow(texts))
        mask = np.asarray(pc.is_null(texts).to_numpy(zero_copy_only=False), bool) if texts.null_count else None
        # letters change script while their accents still stand apart
        out, at = cp.compose(cp.order_marks(self.resolve(cps, offs), offs), offs)
        return cp.to_arrow(out, at, mask)


_built: dict[str, Canonicaliser] = {}


def canonicaliser(spec: Spec) -> Canonicaliser:
    """One per worker process and configuration."""
    if spec.key not in _built:
        if len(_built) > 7:
            _built.clear()
        _built[spec.key] = Canonicaliser(spec)
    return _built[spec.key]


def unify(df: DataFrame, column: str, into: str, keep: Iterable[str] = ()) -> DataFrame:
    """Adds `into`, the one form of the text in `column`. Texts with equal looks get equal forms.

    Null stays null and empty stays empty; a text of invisible characters alone becomes empty. Texts of any length are
    done whole. `keep`: accepted forms whose signs keep their identity. `into` must not be a column of `df` yet;
    other columns are kept, whatever their names.
    """
    if into in df.columns:
        raise ValueError(f"{into} is a column already")
    spec = Spec.of(confusable_classes(df.sparkSession), keep)

    @F.arrow_udf("string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = canonicaliser(spec)
        for t in texts:
            yield tool.forms(t)

    return df.withColumn(into, run(F.col(column)))


#: At most so many accepted forms are sent to the tasks; the table of forms is small and fixed.
MAX_FORMS = 500_000


def accepted_forms(forms: DataFrame) -> dict[str, list[str]]:
    """The accepted forms of each kind, on the driver; more than MAX_FORMS are an error."""
    accepted = forms.where(F.col("form").isNotNull()).select("kind", "form").distinct().limit(MAX_FORMS + 1).collect()
    if len(accepted) > MAX_FORMS:
        raise ValueError(f"more than {MAX_FORMS} accepted forms; they must be a small fixed table")
    by_kind: dict[str, list[str]] = {}
    for r in accepted:
        by_kind.setdefault(r["kind"], []).append(r["form"])
    return by_kind


def disguised(df: DataFrame, key: str, fields: dict[str, tuple[str, str]], forms: DataFrame) -> DataFrame:
    """Elements of array columns that look like an accepted form of their kind but aren't one.

    fields: name in the result to (column expression of array<string>, kind). forms: `form`, `kind`.
    Result: key, field_name, item_no (0-based), value, form. Rows of one key that are redelivered count once: their
    findings are equal and merged after the scan, so the records themselves are not shuffled. Null arrays and
    elements give nothing; an empty element is compared like any other.
    """
    spark = df.sparkSession
    by_kind = accepted_forms(forms)
    classes = confusable_classes(spark)
    specs = {k: Spec.of(classes, v) for k, v in by_kind.items()}
    names = list(fields)
    kinds = [k for _, k in fields.values()]
    key_type = dict(df.dtypes)[key]
    schema = f"{key} {key_type}, field_name string, item_no int, value string, form string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for kind, all_forms in by_kind.items():
            c = canonicaliser(specs[kind])
            as_array = pa.array(all_forms, pa.string())
            tables[kind] = (c, as_array, c.skeletons(as_array))
        for batch in batches:
            for i, (name, kind) in enumerate(zip(names, kinds), start=1):
                if kind not in tables:
                    continue
                tool, all_forms, skeletons = tables[kind]
                lists = batch.column(i)
                values = pc.list_flatten(lists)
                parents = pc.list_parent_indices(lists).to_numpy()
                first = np.searchsorted(parents, parents)  # where each list starts among the flat values
                places = np.arange(len(values)) - first
                odd = np.flatnonzero(~(pc.is_in(values, value_set=all_forms).to_numpy(zero_copy_only=False) | pc.is_null(values).to_numpy(zero_copy_only=False)))
                some = values.take(pa.array(odd))
                at = pc.index_in(tool.skeletons(some), value_set=skeletons)
                hit = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
                n = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(parents[odd[hit]])),
                        pa.array([name] * n, pa.string()),
                        pa.array(places[odd[hit]], pa.int32()),
                        some.take(pa.array(hit)),
                        all_forms.take(at.take(pa.array(hit))),
                    ],
                    names=[key, "field_name", "item_no", "value", "form"],
                )

    scanned = df.select(F.col(key), *[F.expr(e).alias(f"_{i}") for i, (e, _) in enumerate(fields.values())])
    return scanned.mapInArrow(run, schema).dropDuplicates([key, "field_name", "item_no"])
