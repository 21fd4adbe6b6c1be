"""Sort and group properties of hits and documents, from their text form to columns.

The form is `type:annotation:sensitivity:extra`, a `-` in front reverses, a comma makes several. Properties on context words need
the tokens around the hits, which one equi-join on (doc_id, position) brings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fold
from spanloom.operators import spans as sp
from spanloom.plans.compiler import Tables

#: Words of context for sorting and grouping, unless the property names a number.
CONTEXT = 5
UNKNOWN_DECADE = 10_000_000


class PropertyError(ValueError):
    pass


@dataclass(frozen=True)
class Property:
    kind: str
    annotation: str | None = None
    sensitivity: str = "i"
    extra: str | None = None
    reverse: bool = False

    def text(self) -> str:
        parts = [self.kind]
        if self.kind in ("field", "decade"):
            parts += [self.annotation or ""]
        elif self.kind in CONTEXTUAL:
            parts += [self.annotation or "", self.sensitivity] + ([self.extra] if self.extra else [])
        return ("-" if self.reverse else "") + ":".join(parts)


#: The properties' names, old ones to new ones.
ALIASES = {"left": "before", "right": "after", "context": "ctx", "wordleft": "before", "wordright": "after", "matchedtext": "hit"}
CONTEXTUAL = ("hit", "before", "after", "ctx", "capture")
PLAIN = ("hitposition", "doc", "docid", "field", "decade", "fieldlen", "numhits", "identity", "size")


def parse(text: str) -> list[Property]:
    """The properties of a text form."""
    text = text.strip()
    if text.startswith("-(") and text.endswith(")"):
        return [Property(p.kind, p.annotation, p.sensitivity, p.extra, not p.reverse) for p in parse(text[2:-1])]
    if text.startswith("(") and text.endswith(")"):
        return parse(text[1:-1])
    out = []
    for part in text.split(","):
        reverse = part.startswith("-")
        bits = part.lstrip("-").split(":")
        kind = ALIASES.get(bits[0], bits[0])
        if kind not in CONTEXTUAL and kind not in PLAIN:
            raise PropertyError(f"unknown property {bits[0]}")
        annotation = bits[1] if len(bits) > 1 and bits[1] else None
        sensitivity = bits[2] if len(bits) > 2 and bits[2] else "i"
        extra = ":".join(bits[3:]) or None
        if bits[0] in ("wordleft", "wordright"):
            extra = "1"
        if kind == "size":
            reverse = not reverse  # the largest first by default
        out.append(Property(kind, annotation, sensitivity, extra, reverse))
    return out


def with_context(hits: DataFrame, tables: Tables, annotations: list[str], before: int, after: int, also: list[tuple[Column, Column]] = ()) -> DataFrame:
    """Adds `_ctx`, the sorted array of structs (_at, one field per annotation) around and in each hit, and in the spans of `also`,
    which may lie outside of the hit.

    Contexts end at the document's edges. The work is an equi-join of the positions wanted with the tokens and
    a grouping by hit, both spread over all tasks; an array is as long as a hit with its context.
    """
    none = F.array().cast("array<int>")
    places = lambda a, z: F.when(a <= z, F.sequence(a, z)).otherwise(none)
    at = places(F.greatest(F.lit(0), F.col("start_pos") - before), F.col("end_pos") + after - 1)
    if also:
        at = F.array_distinct(F.concat(at, *[F.coalesce(places(s, e - 1), none) for s, e in also]))
    # the whole hit goes along as the key, so that nothing is joined back; hits are distinct
    want = hits.select(F.struct(*hits.columns).alias("_h"), F.col("doc_id").alias("_d"), F.explode_outer(at).alias("_at"))
    names = [a.replace("/", "_") for a in dict.fromkeys(annotations)]
    look = tables.rows().select(F.col("doc_id").alias("_d"), F.col("pos").alias("_at"), F.lit(True).alias("_there"), *[F.col(tables.column(a)).alias(f"_v{i}") for i, a in enumerate(dict.fromkeys(annotations))])
    word = F.when(F.col("_there"), F.struct("_at", *[F.col(f"_v{i}").alias(a) for i, a in enumerate(names)]))
    got = want.join(look, ["_d", "_at"], "left").groupBy("_h").agg(F.sort_array(F.collect_set(word)).alias("_ctx"))
    return got.select("_h.*", "_ctx")


def _words(part: Column, name: str, sensitivity: str, backwards: bool = False) -> Column:
    values = F.transform(part, lambda t: F.coalesce(fold(t[name], sensitivity), F.lit("")))
    return F.reverse(values) if backwards else values


def _between(ctx: Column, low: Column, high: Column) -> Column:
    return F.filter(ctx, lambda t: (t["_at"] >= low) & (t["_at"] < high))


def _parts(p: Property, name: str) -> Column:
    """An array of words for a contextual property; words before the hit come nearest first."""
    ctx, s, e = F.col("_ctx"), F.col("start_pos"), F.col("end_pos")
    if p.kind == "hit":
        return _words(F.filter(ctx, lambda t: (t["_at"] >= s) & (t["_at"] < e)), name, p.sensitivity)
    if p.kind == "before":
        n = int(p.extra or CONTEXT)
        return _words(F.filter(ctx, lambda t: (t["_at"] < s) & (t["_at"] >= s - n)), name, p.sensitivity, True)
    if p.kind == "after":
        n = int(p.extra or CONTEXT)
        return _words(F.filter(ctx, lambda t: (t["_at"] >= e) & (t["_at"] < e + n)), name, p.sensitivity)
    if p.kind == "capture":
        low, high = span_of(p)
        return _words(_between(ctx, low, high), name, p.sensitivity)
    out = []
    for part in (p.extra or "H").split(";"):  # ctx: parts B, A, H, E with word numbers from 1, such as H1-2;B1
        where, numbers = part[0].upper(), part[1:]
        a, z = _numbers(part)
        if where == "H":
            lo, hi = s + a - 1, F.least(e, s + z)
            out.append(_words(_between(ctx, lo, hi), name, p.sensitivity))
        elif where == "E":  # from the end of the hit backwards
            lo, hi = F.greatest(s, e - z), e - a + 1
            out.append(_words(_between(ctx, lo, hi), name, p.sensitivity, True))
        elif where in "BL":
            lo, hi = s - z, s - a + 1
            out.append(_words(_between(ctx, lo, hi), name, p.sensitivity, True))
        elif where in "AR":
            lo, hi = e + a - 1, e + z
            out.append(_words(_between(ctx, lo, hi), name, p.sensitivity))
        else:
            raise PropertyError(f"unknown context part {part}")
    return F.concat(*out)


def _numbers(part: str) -> tuple[int, int]:
    """The first and the last word of a context part, from 1. An open end of a part outside of the hit counts CONTEXT words on from word 1."""
    low, dash, high = part[1:].partition("-")
    a = int(low) if low else 1
    if high or low and not dash:
        return a, int(high) if high else a
    return a, (1 << 20 if part[0].upper() in "HE" else CONTEXT + 1)


#: The two ends of a relation that a capture property may name.
ENDS = {"source": ("src_start", "src_end"), "target": ("tgt_start", "tgt_end"), "full": ("start", "end"), "": ("start", "end")}


def span_of(p: Property) -> tuple[Column, Column]:
    """Where a capture property looks: the capture's own span, or with `name:source` or `name:target` an end of its relation."""
    name, _, mode = (p.extra or "").partition(":")
    if mode not in ENDS:
        raise PropertyError(f"unknown span mode {mode}")
    if not name:
        return F.col("start_pos"), F.col("end_pos")
    low, high = ENDS[mode]
    return F.col(f"c_{name}.{low}"), F.col(f"c_{name}.{high}")


def _reach(properties: list[Property]) -> tuple[int, int]:
    before = after = 0
    for p in properties:
        if p.kind == "before":
            before = max(before, int(p.extra or CONTEXT))
        elif p.kind == "after":
            after = max(after, int(p.extra or CONTEXT))
        elif p.kind == "ctx":
            for part in (p.extra or "H").split(";"):
                n = max(_numbers(part))
                if part[0].upper() in "BL":
                    before = max(before, n)
                elif part[0].upper() in "AR":
                    after = max(after, n)
    return before, after


def columns(hits: DataFrame, tables: Tables, text: str, documents: DataFrame | None = None) -> tuple[DataFrame, list[tuple[str, Property]]]:
    """Adds a column _p0, _p1, ... per property of `text` and says which is which. Words become one string, joined by blanks."""
    properties = parse(text)
    for p in properties:
        if p.kind in ("fieldlen", "numhits", "identity", "size"):
            raise PropertyError(f"{p.kind} is not a property of hits")
    contextual = [p for p in properties if p.kind in CONTEXTUAL]
    main = next(iter(tables.annotations))
    if contextual:
        before, after = _reach(contextual)
        also = [span_of(p) for p in contextual if p.kind == "capture" and p.extra]
        hits = with_context(hits, tables, [p.annotation or main for p in contextual], before, after, also)
    fields = [p for p in properties if p.kind in ("field", "decade", "doc")]
    if fields:
        if documents is None:
            raise PropertyError("document properties need the documents")
        wanted = dict.fromkeys("pid" if p.kind == "doc" else p.annotation for p in fields)
        looked = documents.select("doc_id", *[F.col(w).alias(f"_d_{w}") for w in wanted])
        hits = hits.join(looked, "doc_id", "left")
    out = []
    for i, p in enumerate(properties):
        if p.kind in CONTEXTUAL:
            c = F.array_join(_parts(p, (p.annotation or main).replace("/", "_")), " ")
        elif p.kind == "hitposition":
            c = F.col("start_pos")
        elif p.kind == "docid":
            c = F.col("doc_id")
        elif p.kind == "doc":
            c = F.col("_d_pid")
        elif p.kind == "decade":
            c = decade(F.col(f"_d_{p.annotation}"))
        else:
            c = field_value(hits, f"_d_{p.annotation}")
        hits = hits.withColumn(f"_p{i}", c)
        out.append((f"_p{i}", p))
    return hits.drop("_ctx", *[c for c in hits.columns if c.startswith("_d_")]), out


def decade(c: Column) -> Column:
    """year - year % 10; 10,000,000 where the year is unknown, so that it sorts last."""
    year = F.regexp_extract(c.cast("string"), "([0-9]{4})", 1)
    n = F.when(year != "", year.cast("int"))
    return F.coalesce(n - n % 10, F.lit(UNKNOWN_DECADE))


def field_value(df: DataFrame, name: str) -> Column:
    """Metadata as text: several values joined by a middle dot, missing ones empty."""
    kind = dict(df.dtypes)[name]
    c = F.array_join(F.col(name), " · ") if kind.startswith("array") else F.col(name).cast("string")
    return F.coalesce(c, F.lit(""))


def order(named: list[tuple[str, Property]]) -> list[Column]:
    return [F.col(c).desc() if p.reverse else F.col(c).asc() for c, p in named]
