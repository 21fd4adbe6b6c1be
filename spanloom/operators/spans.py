"""Span algebra on hits: DataFrames of doc_id, start_pos, end_pos (half-open) and one struct column c_<name> per capture.

Hits are sets: rows are distinct in their span and all captures. Sequences and exact combinations are equi-joins on
(doc_id, position), so a document that holds a third of all tokens is spread over all tasks. Interval
conditions are equi-joins on (doc_id, block of positions): the side that may cover several blocks is copied to
each of them, the other side lies in one, and the exact condition is checked on top.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.plans.nodes import MANY
from spanloom.session import cut

KEYS = ["doc_id", "start_pos", "end_pos"]
#: Positions per block of an interval join.
BLOCK = 1024
#: Gaps up to this width become equi-joins on each distance.
NARROW = 64


def captures(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("c_")]


def distinct(df: DataFrame, known: bool = False) -> DataFrame:
    """Hits without repeats; `known` when the inputs and the lengths of their hits already see to that, which saves a shuffle."""
    return df if known else df.dropDuplicates()


def _right(df: DataFrame) -> DataFrame:
    """Renames all columns but none stays ambiguous in a join: x becomes _x."""
    return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])


def _merged(a: DataFrame, b: DataFrame) -> list[Column]:
    """Capture columns of both sides of a join of a with _right(b); a name on both sides takes the first that is there."""
    left, right = captures(a), captures(b)
    out = [F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in right else F.col(c) for c in left]
    return out + [F.col(f"_{c}").alias(c) for c in right if c not in left]


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND: hits of equal span; all combinations of their captures."""
    r = _right(b)
    on = [F.col(k) == F.col(f"_{k}") for k in KEYS]
    # rows of both sides are distinct, so pairs are, unless captures of one name are merged
    known = not set(captures(a)) & set(captures(b))
    return distinct(a.join(r, reduce(Column.__and__, on)).select(*KEYS, *_merged(a, b)), known)


def but_not(a: DataFrame, b: DataFrame) -> DataFrame:
    """AND NOT: hits whose span isn't a hit of b."""
    return a.join(b.select(*KEYS), KEYS, "left_anti")


def either(parts: list[DataFrame]) -> DataFrame:
    """OR: captures that a part lacks are null."""
    return distinct(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts))


def followed_by(a: DataFrame, b: DataFrame, fixed: bool = False) -> DataFrame:
    """Sequence: b starts where a ends. fixed: all hits of a, or all of b, have one length, so no two pairs cover the same span."""
    r = _right(b)
    joined = a.join(r, (F.col("doc_id") == F.col("_doc_id")) & (F.col("end_pos") == F.col("_start_pos")))
    known = fixed and not set(captures(a)) & set(captures(b))
    return distinct(joined.select("doc_id", "start_pos", F.col("_end_pos").alias("end_pos"), *_merged(a, b)), known)


def with_gap(a: DataFrame, b: DataFrame, low: int, high: int, fixed: bool = False) -> DataFrame:
    """b starts low to high tokens after the end of a. fixed: all hits of a and all of b have one length each."""
    r = _right(b)
    if low == high == 0:
        return followed_by(a, b, fixed)
    known = fixed and not set(captures(a)) & set(captures(b))
    if high - low <= NARROW:
        steps = a.withColumn("_at", F.explode(F.sequence(F.col("end_pos") + low, F.col("end_pos") + high)))
        joined = steps.join(r, (F.col("doc_id") == F.col("_doc_id")) & (F.col("_at") == F.col("_start_pos")))
    else:
        # no further than the last b of the document
        last = b.groupBy("doc_id").agg(F.max("start_pos").alias("_last"))
        reach = F.col("_last") if high >= MANY else F.least(F.col("_last"), F.col("end_pos") + high)
        wide = a.join(last, "doc_id").withColumn("_from", F.col("end_pos") + low).withColumn("_to", reach).where("_from <= _to")
        wide = wide.withColumn("_block", F.explode(F.sequence(_block("_from"), _block("_to"))))
        r = r.withColumn("_b", _block("_start_pos"))
        joined = wide.join(r, (F.col("doc_id") == F.col("_doc_id")) & (F.col("_block") == F.col("_b")) & F.col("_start_pos").between(F.col("_from"), F.col("_to")))
    return distinct(joined.select("doc_id", "start_pos", F.col("_end_pos").alias("end_pos"), *_merged(a, b)), known)


def _block(c: str) -> Column:
    return F.floor(F.col(c) / BLOCK).cast("int")


# -- tokens and lengths ----------------------------------------------------------------------------


def any_tokens(lengths: DataFrame, low: int, high: int) -> DataFrame:
    """All spans of low to high tokens of every document. lengths: doc_id, length."""
    low = max(low, 1)
    at = lengths.where(F.col("length") >= low).select("doc_id", "length", F.explode(F.sequence(F.lit(0), F.col("length") - low)).alias("start_pos"))
    room = F.least(F.lit(high), F.col("length") - F.col("start_pos"))
    return at.select("doc_id", "start_pos", F.explode(F.sequence(F.col("start_pos") + low, F.col("start_pos") + room)).alias("end_pos"))


def fixed(lengths: DataFrame, start: int, end: int) -> DataFrame:
    return lengths.where(F.col("length") >= end).select("doc_id", F.lit(start).alias("start_pos"), F.lit(end).alias("end_pos"))


def uncovered(tokens: DataFrame, a: DataFrame) -> DataFrame:
    """NOT: single tokens that no hit covers. tokens: doc_id, pos."""
    covered = a.where("end_pos > start_pos").select("doc_id", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"))
    free = tokens.select("doc_id", "pos").join(covered, ["doc_id", "pos"], "left_anti")
    return free.select("doc_id", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"))


def expand(a: DataFrame, direction: str, low: int, high: int, lengths: DataFrame | None, fixed: bool = False) -> DataFrame:
    """Hits longer by low to high tokens on one side, within the document. fixed: all hits of a have one length."""
    known = fixed or low == high
    if direction == "left":
        room = F.least(F.lit(high), F.col("start_pos"))
        out = a.where(F.col("start_pos") >= low).withColumn("_k", F.explode(F.sequence(F.lit(low), room)))
        out = out.withColumn("start_pos", F.col("start_pos") - F.col("_k"))
        return distinct(out.drop("_k"), known)
    room = F.least(F.lit(high), F.col("length") - F.col("end_pos"))
    out = at_block(a, lengths, "end_pos").where(F.col("length") - F.col("end_pos") >= low).withColumn("_k", F.explode(F.sequence(F.lit(low), room)))
    return distinct(out.withColumn("end_pos", F.col("end_pos") + F.col("_k")).drop("_k", "length"), known)


def extended(a: DataFrame, b: DataFrame, direction: str) -> DataFrame:
    """Hits of a as they are, and those with a hit of b directly behind (right) or before them (left).

    One join: the hits of b are put together by the position where they would be joined on, and each hit of a becomes as many rows as there
    are ways to go on, and one for staying as it is.
    """
    here, there = ("end_pos", "start_pos") if direction == "right" else ("start_pos", "end_pos")
    caps = captures(b)
    kinds = dict(b.dtypes)
    way = F.struct(F.col(here).alias("_to"), *caps)
    ways = b.groupBy(F.col("doc_id").alias("_d"), F.col(there).alias("_at")).agg(F.collect_set(way).alias("_ways"))
    stay = F.struct(F.col(here).alias("_to"), *[F.lit(None).cast(kinds[c]).alias(c) for c in caps])
    joined = a.join(ways, (F.col("doc_id") == F.col("_d")) & (F.col(here) == F.col("_at")), "left")
    on = F.coalesce(F.col("_ways"), F.array().cast(ways.schema["_ways"].dataType))
    rows = joined.withColumn("_way", F.explode(F.concat(F.array(stay), on)))
    own = captures(a)
    kept = [F.coalesce(F.col(c), F.col(f"_way.{c}")).alias(c) if c in caps else F.col(c) for c in own]
    moved = {"end_pos": F.col("_way._to")} if direction == "right" else {"start_pos": F.col("_way._to")}
    keys = [moved.get(k, F.col(k)).alias(k) for k in KEYS]
    return distinct(rows.select(*keys, *kept, *[F.col(f"_way.{c}").alias(c) for c in caps if c not in own]))


def at_block(a: DataFrame, lengths: DataFrame, column: str) -> DataFrame:
    """Joins hits with the length of their document on (document, block of positions), so that a document that holds a third
    of all hits is spread. Lengths are repeated once a block, a thousandth of the tokens."""
    spread = lengths.withColumn("_lb", F.explode(F.sequence(F.lit(0), _block("length"))))
    spread = spread.withColumnRenamed("doc_id", "_ld")
    return a.join(spread, (F.col("doc_id") == F.col("_ld")) & (_block(column) == F.col("_lb"))).drop("_ld", "_lb")


def of_length(a: DataFrame, low: int, high: int) -> DataFrame:
    return a.where((F.col("end_pos") - F.col("start_pos")).between(low, high))


def edge(a: DataFrame, trailing: bool) -> DataFrame:
    at = "end_pos" if trailing else "start_pos"
    return distinct(a.withColumn("start_pos", F.col(at)).withColumn("end_pos", F.col(at)))


def capture(a: DataFrame, name: str) -> DataFrame:
    return a.withColumn(f"c_{name}", F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end")))


def in_order(a: DataFrame, by_end: bool = False) -> DataFrame:
    """Hits of a document together and in order, without a global sort."""
    keys = ["doc_id", "end_pos", "start_pos"] if by_end else KEYS
    return a.repartition("doc_id").sortWithinPartitions(*keys)


# -- repetition --------------------------------------------------------------------------------------


def runs(a: DataFrame, low: int, high: int, size: int = 1) -> DataFrame:
    """Sub-runs of low to high consecutive hits of single tokens.

    Islands of consecutive positions are found within blocks of positions, so no task holds a whole hot document; islands that
    touch a block's edge, at most two per block, are then joined over the edges.
    """
    at = a.select("doc_id", F.col("start_pos").alias("p")).distinct().withColumn("_b", F.floor(F.col("p") / (BLOCK * 64)).cast("int"))
    own = W.partitionBy("doc_id", "_b").orderBy("p")
    local = at.withColumn("_i", F.col("p") - F.row_number().over(own)).groupBy("doc_id", "_b", "_i").agg(F.min("p").alias("s"), (F.max("p") + 1).alias("e"))
    touch = (F.col("s") % (BLOCK * 64) == 0) | (F.col("e") % (BLOCK * 64) == 0)
    inner = local.where(~touch).select("doc_id", "s", "e")
    over = W.partitionBy("doc_id").orderBy("s")
    outer = local.where(touch).withColumn("_new", (F.coalesce(F.lag("e").over(over), F.lit(-1)) != F.col("s")).cast("int"))
    outer = outer.withColumn("_g", F.sum("_new").over(over)).groupBy("doc_id", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("doc_id", "s", "e")
    islands = inner.unionByName(outer).where(F.col("e") - F.col("s") >= low)
    starts = islands.select("doc_id", "e", F.explode(F.sequence("s", F.col("e") - low)).alias("start_pos"))
    room = F.least(F.lit(high), F.col("e") - F.col("start_pos"))
    return starts.select("doc_id", "start_pos", F.explode(F.sequence(F.col("start_pos") + low, F.col("start_pos") + room)).alias("end_pos"))


def repeat(a: DataFrame, low: int, high: int) -> DataFrame:
    """low to high hits of any length one after another. Captures of the last one stay.

    It goes on until a round finds nothing new, however many rounds that takes.
    """
    low = max(low, 1)
    if not captures(a) and high >= MANY:
        return _closure(a, low)
    current, found = a, [a] if low <= 1 else []
    n = 1
    while n < high:
        n += 1
        current = _then(current, a)
        if high >= MANY or n > 6:
            if n >= low and found:
                current = current.subtract(either(found).select(*current.columns))  # what was found before has been gone on from
            current = cut(current)
            if current.isEmpty():
                break
        if n >= low:
            found.append(current)
            if len(found) > 8:
                found = [cut(either(found))]
    return either(found) if found else a.limit(0)


def _then(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sequence whose captures are those of b where both have them."""
    r = _right(b)
    joined = a.join(r, (F.col("doc_id") == F.col("_doc_id")) & (F.col("end_pos") == F.col("_start_pos")))
    return distinct(joined.select("doc_id", "start_pos", F.col("_end_pos").alias("end_pos"), *[F.col(f"_{c}").alias(c) for c in captures(b)]))


def _closure(a: DataFrame, low: int) -> DataFrame:
    """All chains of at least `low` hits: exact rounds up to `low`, then doubling of the distance covered until nothing is new."""
    a = cut(a.select(*KEYS))
    start = a
    for _ in range(low - 1):
        start = _then(start, a)
    chains, known = a, a.count()  # chains of 1 .. 2**k hits
    while True:
        longer = cut(either([chains, _then(chains, chains)]))
        size = longer.count()
        if size == known:
            return either([start, _then(start, chains)])
        chains, known = longer, size


# -- conditions between intervals ------------------------------------------------------------------


def _related(p: DataFrame, f: DataFrame, operation: str) -> DataFrame:
    """Joins spans p (ps, pe) with f (fs, fe) on the condition of the operation, each pair once."""
    doc = F.col("doc_id") == F.col("_doc_id")
    ps, pe, fs, fe = (F.col(c) for c in ("ps", "pe", "fs", "fe"))
    if operation == "matches":
        return p.join(f, doc & (ps == fs) & (pe == fe))
    if operation == "starts_at":
        return p.join(f, doc & (ps == fs))
    if operation == "ends_at":
        return p.join(f, doc & (pe == fe))
    if operation == "containing_at_start":
        return p.join(f, doc & (ps == fs) & (fe <= pe))
    if operation == "containing_at_end":
        return p.join(f, doc & (pe == fe) & (fs >= ps))
    if operation == "containing":
        p = p.withColumn("_pb", F.explode(F.sequence(_block("ps"), F.greatest(_block("ps"), _block("pe")))))
        f = f.withColumn("_fb", _block("fs"))
        return p.join(f, doc & (F.col("_pb") == F.col("_fb")) & (fs >= ps) & (fe <= pe))
    if operation == "within":
        p = p.withColumn("_pb", _block("ps"))
        f = f.withColumn("_fb", F.explode(F.sequence(_block("fs"), _block("fe"))))
        return p.join(f, doc & (F.col("_pb") == F.col("_fb")) & (fs <= ps) & (fe >= pe))
    raise ValueError(f"unknown operation {operation}")


def filtered(a: DataFrame, by: DataFrame, operation: str, invert: bool = False, left: int = 0, right: int = 0) -> DataFrame:
    """Hits of a that have (or, inverted, lack) a hit of `by` in the given place; captures of the first such hit are added."""
    places = a.select(*KEYS).distinct().withColumn("ps", F.col("start_pos") + left).withColumn("pe", F.col("end_pos") + right)
    caps = captures(by)
    f = by.select(F.col("doc_id").alias("_doc_id"), F.col("start_pos").alias("fs"), F.col("end_pos").alias("fe"), *([F.struct(*caps).alias("_caps")] if caps and not invert else [])).distinct()
    pairs = _related(places, f, operation)
    if invert:
        return a.join(pairs.select(*KEYS), KEYS, "left_anti")
    if not caps:
        return a.join(pairs.select(*KEYS), KEYS, "left_semi")
    first = pairs.groupBy(*KEYS).agg(F.min(F.struct("fs", "fe", "_caps")).alias("_first"))
    joined = a.join(first, KEYS)
    old = captures(a)
    kept = [F.coalesce(F.col(c), F.col(f"_first._caps.{c}")).alias(c) if c in caps else F.col(c) for c in old]
    return joined.select(*KEYS, *kept, *[F.col(f"_first._caps.{c}").alias(c) for c in caps if c not in old])


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common part of each pair of overlapping hits. Hits without tokens overlap nothing."""
    x = a.where("end_pos > start_pos").withColumn("_blk", F.explode(F.sequence(_block("start_pos"), F.floor((F.col("end_pos") - 1) / BLOCK).cast("int"))))
    r = _right(b.where("end_pos > start_pos"))
    r = r.withColumn("_rblk", F.explode(F.sequence(_block("_start_pos"), F.floor((F.col("_end_pos") - 1) / BLOCK).cast("int"))))
    s, e = F.greatest("start_pos", "_start_pos"), F.least("end_pos", "_end_pos")
    on = (F.col("doc_id") == F.col("_doc_id")) & (F.col("_blk") == F.col("_rblk")) & (F.col("start_pos") < F.col("_end_pos")) & (F.col("_start_pos") < F.col("end_pos"))
    on = on & (F.floor(s / BLOCK) == F.col("_blk"))  # a pair belongs to the block where its common part begins
    joined = x.join(r, on).select("doc_id", s.alias("s"), e.alias("e"), *_merged(a, b))
    return distinct(joined.withColumnsRenamed({"s": "start_pos", "e": "end_pos"}))


def ngrams(by: DataFrame, operation: str, low: int, high: int, lengths: DataFrame) -> DataFrame:
    """All spans of low to high tokens that have the given place against a hit; made around the hits only."""
    low = max(low, 1)
    rows = at_block(by, lengths, "start_pos").withColumnRenamed("start_pos", "fs").withColumnRenamed("end_pos", "fe")
    fs, fe, n = F.col("fs"), F.col("fe"), F.col("length")
    if operation in ("containing", "containing_at_end"):
        first, last = F.greatest(F.lit(0), fe - high), F.least(fs, n - low)
    elif operation == "within":
        first, last = fs, F.least(fe, n) - low
    elif operation == "ends_at":
        first, last = F.greatest(F.lit(0), fe - high), fe - low
    else:
        first, last = fs, fs
    rows = rows.withColumn("_a", first).withColumn("_z", last).where("_a <= _z").withColumn("s", F.explode(F.sequence("_a", "_z")))
    s = F.col("s")
    least_end, most_end = s + low, F.least(s + high, n)
    if operation in ("containing", "containing_at_start"):
        least_end = F.greatest(least_end, fe)
    elif operation in ("containing_at_end", "ends_at", "matches"):
        least_end, most_end = F.greatest(least_end, fe), F.least(most_end, fe)
    elif operation == "within":
        most_end = F.least(most_end, fe)
    rows = rows.withColumn("_a", least_end).withColumn("_z", most_end).where("_a <= _z").withColumn("e", F.explode(F.sequence("_a", "_z")))
    return distinct(rows.select("doc_id", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), *captures(by)))


def in_documents(a: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits in the documents of a filter."""
    return a.join(documents.select("doc_id"), "doc_id", "left_semi")


def bucketed(a: DataFrame) -> DataFrame:
    """Hits put together in one row per document and block, sorted; for custom per-document work on bounded arrays."""
    return a.groupBy("doc_id", _block("start_pos").alias("block")).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("hits"))


def same_span(a: DataFrame) -> DataFrame:
    """One row per span with how many hits share it."""
    return a.groupBy(*KEYS).agg(F.count("*").alias("hits"))
