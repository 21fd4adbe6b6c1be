"""Relations between token groups: matching, re-projection, capture lists and alignments.

relations: doc_id, field, rel_id, rel_class, rel_type, attrs map<string, array<string>>, is_root, src_start, src_end,
tgt_field, tgt_start, tgt_end. A root relation has no source of its own. A relation capture is a struct of start, end, rel_id, rel_class, rel_type,
src_start, src_end, tgt_start, tgt_end, tgt_field; a list capture is a sorted array of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from spanloom.operators import spans as sp


def _extent() -> tuple[Column, Column]:
    """From the first to the last token of both ends; of the target alone for roots and other fields."""
    source_only = F.col("tgt_field") != F.col("field")
    start = F.when(F.col("is_root"), F.col("tgt_start")).when(source_only, F.col("src_start")).otherwise(F.least("src_start", "tgt_start"))
    end = F.when(F.col("is_root"), F.col("tgt_end")).when(source_only, F.col("src_end")).otherwise(F.greatest("src_end", "tgt_end"))
    return start, end


def _info() -> Column:
    s, e = _extent()
    own = F.when(F.col("is_root"), F.lit(None))
    return F.struct(
        s.alias("start"), e.alias("end"), "rel_id", "rel_class", "rel_type",
        own.otherwise(F.col("src_start")).alias("src_start"), own.otherwise(F.col("src_end")).alias("src_end"), "tgt_start", "tgt_end", "tgt_field",
    )


def relation_hits(rows: DataFrame, name: str, mode: str = "source", direction: str = "both", target: DataFrame | None = None) -> DataFrame:
    """Relations as hits with a capture `name`. mode: source, target, full; direction: both, root, forward or backward.

    `target`: hits of which the relation's target span must be one; their captures are added.
    """
    if direction == "root":
        rows = rows.where("is_root")
    elif direction == "forward":
        rows = rows.where("NOT is_root AND src_start <= tgt_start")
    elif direction == "backward":
        rows = rows.where("NOT is_root AND src_start >= tgt_start")
    elif direction != "both":
        raise ValueError(f"unknown direction {direction}")
    if mode == "source":
        rows = rows.where("NOT is_root")
        start, end = F.col("src_start"), F.col("src_end")
    elif mode == "target":
        start, end = F.col("tgt_start"), F.col("tgt_end")
    elif mode == "full":
        start, end = _extent()
    else:
        raise ValueError(f"unknown span mode {mode}")
    hits = rows.select("doc_id", start.alias("start_pos"), end.alias("end_pos"), _info().alias(f"c_{name}"), F.col("tgt_start").alias("_ts"), F.col("tgt_end").alias("_te"))
    if target is not None:
        caps = [c for c in sp.captures(target) if c != f"c_{name}"]
        t = target.select(F.col("doc_id").alias("_d"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), *caps)
        hits = hits.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("_ts") == F.col("_s")) & (F.col("_te") == F.col("_e"))).drop("_d", "_s", "_e")
    return sp.distinct(hits.drop("_ts", "_te"))


def both_unique(a: DataFrame, b: DataFrame, names: list[str], name: str) -> DataFrame:
    """AND of hits of relations, where the relation captured as `name` in b is none of those captured as `names` in a."""
    out = sp.both(a, b)
    for other in names:
        if other != name:
            out = out.where(F.col(f"c_{other}.rel_id") != F.col(f"c_{name}.rel_id"))
    return out


def any_order(hits: DataFrame | None, names: list[str]) -> DataFrame | None:
    """One hit for each set of relations: of hits of one span that match the same relations in different order, the first one stays."""
    if hits is None or len(names) < 2:
        return hits
    ids = F.array_sort(F.array(*[F.col(f"c_{x}.rel_id") for x in names]))
    caps = sp.captures(hits)
    first = hits.groupBy(*sp.KEYS, ids.alias("_ids")).agg(F.min(F.struct(*[f"c_{x}" for x in names], *[c for c in caps if c[2:] not in names])).alias("_first"))
    return first.select(*sp.KEYS, *[F.col(f"_first.{c}").alias(c) for c in caps])


def relation_captures(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name.startswith("c_") and isinstance(f.dataType, T.StructType) and "rel_id" in f.dataType.names]


def respan(hits: DataFrame, mode: str) -> DataFrame:
    """Moves hits to a place of their relation: source, target, full; or all: over every relation captured, and the hit itself."""
    names = relation_captures(hits)
    if not names:
        return hits
    one = names[-1]
    if mode == "all":
        start = F.least("start_pos", *[F.col(f"{c}.start") for c in names])
        end = F.greatest("end_pos", *[F.col(f"{c}.end") for c in names])
    elif mode in ("source", "target"):
        short = {"source": "src", "target": "tgt"}[mode]
        start, end = F.col(f"{one}.{short}_start"), F.col(f"{one}.{short}_end")
        hits = hits.where(start.isNotNull())
    elif mode == "full":
        start, end = F.col(f"{one}.start"), F.col(f"{one}.end")
    else:
        raise ValueError(f"unknown span mode {mode}")
    return sp.distinct(hits.withColumns({"start_pos": start, "end_pos": end}))


def in_other_field(hits: DataFrame, field_name: str) -> DataFrame:
    """The target spans that the hits' relations have in another field."""
    out = []
    for f in hits.schema.fields:
        if not f.name.startswith("c_"):
            continue
        if isinstance(f.dataType, T.ArrayType) and "tgt_field" in getattr(f.dataType.elementType, "names", ()):
            inside = F.filter(f.name, lambda r: r["tgt_field"] == field_name)
            span = F.struct(F.array_min(F.transform(inside, lambda r: r["tgt_start"])).alias("s"), F.array_max(F.transform(inside, lambda r: r["tgt_end"])).alias("e"))
        elif isinstance(f.dataType, T.StructType) and "tgt_field" in f.dataType.names:
            span = F.when(F.col(f"{f.name}.tgt_field") == field_name, F.struct(F.col(f"{f.name}.tgt_start").alias("s"), F.col(f"{f.name}.tgt_end").alias("e")))
        else:
            continue
        out.append(hits.withColumn("_t", span).where("_t.s IS NOT NULL").select("doc_id", F.col("_t.s").alias("start_pos"), F.col("_t.e").alias("end_pos"), *sp.captures(hits)))
    return sp.either(out) if out else hits.where(F.lit(False))


def capture_within(hits: DataFrame, rows: DataFrame, name: str, inside: str | None = None) -> DataFrame:
    """Adds a list of the relations whose extent lies within the hit, or within its capture `inside`. No hit is lost."""
    s, e = _extent()
    r = rows.select(F.col("doc_id").alias("_doc_id"), s.alias("fs"), e.alias("fe"), _info().alias("_info"))
    lo, hi = (F.col(f"c_{inside}.start"), F.col(f"c_{inside}.end")) if inside else (F.col("start_pos"), F.col("end_pos"))
    places = hits.select("doc_id", lo.alias("ps"), hi.alias("pe")).where("ps IS NOT NULL").distinct()
    pairs = sp._related(places, r, "containing").groupBy("doc_id", "ps", "pe").agg(F.sort_array(F.collect_set("_info")).alias(f"c_{name}"))
    keyed = hits.withColumn("ps", lo).withColumn("pe", hi)
    return keyed.join(pairs, ["doc_id", "ps", "pe"], "left").select(*sp.KEYS, *[c for c in sp.captures(hits) if c != f"c_{name}"], f"c_{name}")


def align(hits: DataFrame, rows: DataFrame, target: DataFrame | None, name: str, optional: bool = False) -> DataFrame:
    """Alignment with another field: relations whose source overlaps the hit are listed under c_<name>, and the hit grows over them.

    With `target`, the target hit that overlaps most of the relations is chosen, the shortest of equals, then the first; hits without one are dropped unless
    `optional`. Relations are listed whether or not they touch the chosen target.
    """
    r = rows.where("NOT is_root").select(F.col("doc_id").alias("_doc_id"), F.col("src_start").alias("_start_pos"), F.col("src_end").alias("_end_pos"), _info().alias("_info"))
    x = hits.withColumn("_blk", F.explode(F.sequence(sp._block("start_pos"), sp._block("end_pos"))))
    y = r.withColumn("_rblk", F.explode(F.sequence(sp._block("_start_pos"), sp._block("_end_pos"))))
    on = (F.col("doc_id") == F.col("_doc_id")) & (F.col("_blk") == F.col("_rblk")) & (F.col("start_pos") < F.col("_end_pos")) & (F.col("_start_pos") < F.col("end_pos"))
    caps = sp.captures(hits)
    keys = [*sp.KEYS, *caps]
    found = x.join(y, on).groupBy(*keys).agg(F.sort_array(F.collect_set("_info")).alias("_rels"))
    if target is not None:
        t = target.select(F.col("doc_id").alias("_d"), F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"), *[F.col(c).alias(f"_t{c}") for c in sp.captures(target)])
        lo = F.array_min(F.transform("_rels", lambda q: q["tgt_start"]))
        hi = F.array_max(F.transform("_rels", lambda q: q["tgt_end"]))
        p = found.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_b", F.explode(F.sequence(sp._block("_lo"), sp._block("_hi"))))
        q = t.withColumn("_tb", F.explode(F.sequence(sp._block("_s"), sp._block("_e"))))
        touched = F.size(F.filter("_rels", lambda q_: (q_["tgt_start"] < F.col("_e")) & (F.col("_s") < q_["tgt_end"])))
        pairs = p.join(q, (F.col("doc_id") == F.col("_d")) & (F.col("_b") == F.col("_tb")) & (F.col("_s") < F.col("_hi")) & (F.col("_lo") < F.col("_e"))).withColumn("_n", touched).where("_n > 0")
        best = W.partitionBy(*keys).orderBy(F.desc("_n"), F.col("_e") - F.col("_s"), "_s")
        tc = [c for c in sp.captures(target) if c not in caps]
        found = pairs.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*keys, "_rels", *[F.col(f"_t{c}").alias(c) for c in tc])
    else:
        tc = []
    grown = found.withColumn("start_pos", F.least("start_pos", F.array_min(F.transform("_rels", lambda q: q["src_start"])))).withColumn("end_pos", F.greatest("end_pos", F.array_max(F.transform("_rels", lambda q: q["src_end"]))))
    out = grown.select(*keys, F.col("_rels").alias(f"c_{name}"), *tc)
    if optional:
        lost = hits.join(found.select(*sp.KEYS), sp.KEYS, "left_anti")
        out = out.unionByName(lost, allowMissingColumns=True)
    return sp.distinct(out)


def span_relations(spans: DataFrame, field: str = "contents") -> DataFrame:
    """Spans as relations of class `__tag`, without tokens at both ends: the source at the start, the target at the end."""
    attrs = F.transform_values("attrs", lambda k, v: F.array(v))
    return spans.select(
        "doc_id", F.lit(field).alias("field"), F.xxhash64("doc_id", "tag", "start_pos", "end_pos").alias("rel_id"), F.lit("__tag").alias("rel_class"), F.col("tag").alias("rel_type"), attrs.alias("attrs"),
        F.lit(False).alias("is_root"), F.col("start_pos").alias("src_start"), F.col("start_pos").alias("src_end"), F.lit(field).alias("tgt_field"), F.col("end_pos").alias("tgt_start"), F.col("end_pos").alias("tgt_end"),
    )


def statistics(rows: DataFrame, limit_values: int | None = None) -> DataFrame:
    """Per class and type: the number of relations; and per attribute, the values' frequencies. With `limit_values` only so many of the most
    frequent ones, and in `truncated` whether an attribute has more."""
    counts = rows.groupBy("rel_class", "rel_type").agg(F.count("*").alias("n")).select("rel_class", "rel_type", F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value"), "n")
    attrs = rows.select("rel_class", "rel_type", F.explode("attrs").alias("attribute", "values")).select("rel_class", "rel_type", "attribute", F.element_at("values", 1).alias("value"))
    values = attrs.groupBy("rel_class", "rel_type", "attribute", "value").agg(F.count("*").alias("n"))
    if limit_values is None:
        return counts.unionByName(values)
    # the first within salted parts, then the first of those: no task ranks all values of an attribute
    own = ["rel_class", "rel_type", "attribute"]
    top = lambda *more: W.partitionBy(*own, *more).orderBy(F.desc("n"), "value")
    some = values.withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("_r", F.row_number().over(top("_s"))).where(F.col("_r") <= limit_values + 1)
    ranked = some.withColumn("_r", F.row_number().over(top())).where(F.col("_r") <= limit_values + 1).withColumn("truncated", F.max("_r").over(W.partitionBy(*own)) > limit_values)
    return counts.withColumn("truncated", F.lit(False)).unionByName(ranked.where(F.col("_r") <= limit_values).drop("_r", "_s"))
