"""Items that appear together: pair counts over all baskets and their association.

Baskets are encoded to sorted integer ids. An ordinary basket gives its pairs in one task. A huge one is
split into chunks of items, once; the chunks are spread over all tasks, each is sent to every cell (chunk, chunk) that it takes part in, and
each cell, wherever it lies, gives the product of its two chunks. No row holds more than two chunks. Both kinds are counted in
arrays before they are shuffled, and then combined. Items that can't reach the least pair count asked for are left out before pairs are made, which
changes no result: a pair is in no more baskets than each of its items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.dense import with_dense_ids
from spanloom.session import cut, join_by_count
from spanloom.tables import single

#: Items of a chunk; baskets of more items are split.
CHUNK = 512
#: Frequent items are sent to the tasks up to this many, else joined.
MAX_SENT = 200_000
#: Pairs counted in one array before they leave the task.
PAIRS_AT_ONCE = 4_000_000


def _pairs_of(lists: pa.Array, others: pa.Array) -> np.ndarray:
    """Pairs a << 32 | b, a < b, within each list, or between it and its partner where there is one."""
    out: list[np.ndarray] = []
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(size) - size
    alone = pc.is_null(others).to_numpy(zero_copy_only=False)
    for k in np.unique(size[alone]):
        if k < 2:
            continue
        rows = starts[alone & (size == k)]
        i, j = np.triu_indices(int(k), 1)
        block = values[rows[:, None] + np.arange(k)]
        out.append((block[:, i] << 32 | block[:, j]).ravel())
    theirs = pc.list_flatten(others).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(others).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    for at in np.flatnonzero(~alone):
        a, b = values[starts[at] : starts[at] + size[at]], theirs[ends[at] - sizes[at] : ends[at]]
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        out.append(np.minimum(x, y) << 32 | np.maximum(x, y))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held_keys, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held_keys >> 32), pa.array(held_keys & 0xFFFFFFFF), pa.array(held_counts)], names=["a", "b", "n"])

    def merge() -> None:
        nonlocal held_keys, held_counts, waiting, n_waiting
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        held_keys, where = np.unique(np.concatenate([held_keys, keys]), return_inverse=True)
        held_counts = np.bincount(where, np.concatenate([held_counts, counts])).astype(np.int64)
        waiting, n_waiting = [], 0

    waiting: list[np.ndarray] = []
    n_waiting = 0
    for batch in batches:
        size = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.cumsum(size * np.maximum(size, 1)) // PAIRS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            pairs = _pairs_of(part.column(0), part.column(1))
            waiting.append(pairs)
            n_waiting += len(pairs)
            if n_waiting > PAIRS_AT_ONCE:
                merge()
                if len(held_keys) > PAIRS_AT_ONCE:
                    yield emit()
                    held_keys, held_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if waiting:
        merge()
    yield emit()


def pair_counts(encoded: DataFrame, chunk: int = CHUNK, some_huge: bool = True) -> DataFrame:
    """encoded: `ids`, sorted distinct integers of each basket. Result: a, b, n with a < b, one row per pair.

    some_huge: whether any basket may have more than `chunk` items; if not, the look for them is saved.
    """
    one, none = F.col("ids"), F.lit(None).cast("array<bigint>")
    ordinary = encoded.where(F.size("ids") <= chunk).where(F.size("ids") > 1).select(one.alias("x"), none.alias("y"))
    if some_huge:
        ordinary = ordinary.unionByName(_products(encoded.where(F.size("ids") > chunk), chunk))
    parts = ordinary.mapInArrow(_count, "a bigint, b bigint, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _products(huge: DataFrame, chunk: int) -> DataFrame:
    """The cells of huge baskets: x and y, two chunks, or one chunk and null for the pairs within it."""
    n = F.ceil(F.size("ids") / F.lit(chunk)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("no"), F.slice(F.col("ids"), i * chunk + 1, chunk).alias("part")))
    named = huge.withColumn("basket", F.monotonically_increasing_id())  # beside the explode it would number the chunks
    rows = named.select("basket", n.alias("n"), F.explode(pieces).alias("c"))
    chunks = cut(rows.select("basket", "n", "c.no", "c.part").repartition("basket", "no"))
    cell = ["basket", "i", "j"]
    left = chunks.select("basket", F.col("no").alias("i"), F.explode(F.sequence(F.col("no"), F.col("n") - 1)).alias("j"), F.col("part").alias("x"))
    right = chunks.where("no > 0").select("basket", F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("i"), F.col("no").alias("j"), F.col("part").alias("y"))
    within = left.where("i = j").select("x", F.lit(None).cast("array<bigint>").alias("y"))
    return within.unionByName(left.where("i < j").join(right, cell).select("x", "y"))


def _encode_sent(terms: pa.Array):
    """Encodes baskets with a dictionary that the task holds; the place of a term is its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            ids = pc.index_in(pc.list_flatten(lists), value_set=terms, skip_nulls=True)
            real = np.flatnonzero(pc.is_valid(ids).to_numpy(zero_copy_only=False))
            codes = np.unique(owner[real] << np.int64(32) | ids.take(pa.array(real)).to_numpy().astype(np.int64))
            sizes = np.bincount(codes >> 32, minlength=batch.num_rows)
            offs = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(codes & 0xFFFFFFFF))], names=["ids"])

    return run


def associations(df: DataFrame, key: str, items: str, least: int = 10, per_thousand: int = 0, most_sent: int = MAX_SENT, chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """Pairs of distinct items in the same basket, and the number of baskets.

    items: an expression of array<string>; repeated items of a basket count once, null items and null baskets
    count for nothing, an empty string is an item. Baskets of one key count once, a basket without a key is one of its own. Only pairs in at least `least`
    baskets and at least `per_thousand` of each thousand baskets are given. Result: item_a < item_b by their UTF-8 bytes, n_ab, n_a,
    n_b, lift = N n_ab / (n_a n_b), pmi = log2(lift), npmi = pmi / -log2(n_ab / N). An empty table gives no rows and 0.

    most_sent: more frequent items than this are joined to the baskets instead of being sent to the tasks; chunk: the
    most items of a basket that are paired in one row. Neither changes the result.
    """
    distinct = F.array_distinct(F.filter(F.expr(items), lambda x: x.isNotNull()))
    baskets = single(df, key).select(F.coalesce(distinct, F.array().cast("array<string>")).alias("_items"))
    total = baskets.count()
    bar = max(least, -(-per_thousand * total // 1000))
    counted = baskets.select(F.size("_items").alias("size"), F.explode("_items").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.max("size").alias("largest"))
    singles = cut(counted.where(F.col("n") >= bar))
    largest = singles.agg(F.max("largest")).first()[0] or 0  # of the baskets that hold an item that is paired
    singles = singles.drop("largest")
    if singles.count() <= most_sent:
        frequent = sorted(singles.collect(), key=lambda r: r["term"].encode())
        terms = pa.array([r["term"] for r in frequent], pa.string())
        encoded = baskets.mapInArrow(_encode_sent(terms), "ids array<bigint>")
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
        ids = F.broadcast(df.sparkSession.createDataFrame([(i, r["term"], r["n"]) for i, r in enumerate(frequent)], schema))
    else:
        # too many to send: a join, hot items apart, after which the baskets are put together again
        ids = with_dense_ids(singles)
        rows = cut(baskets.withColumn("_b", F.monotonically_increasing_id()).select("_b", F.explode("_items").alias("term")))
        encoded = join_by_count(rows, ids, ["term"], "n", rows.count()).groupBy("_b").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids")
    pairs = pair_counts(encoded, chunk, largest > chunk).where(F.col("n") >= bar)
    left = ids.select(F.col("id").alias("a"), F.col("term").alias("ta"), F.col("n").alias("na"))
    right = ids.select(F.col("id").alias("b"), F.col("term").alias("tb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    swap = F.col("ta") > F.col("tb")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    lift = F.lit(float(total)) * F.col("n") / (F.col("na") * F.col("nb"))
    out = both.select(pick("ta", "tb").alias("item_a"), pick("tb", "ta").alias("item_b"), F.col("n").alias("n_ab"), pick("na", "nb").alias("n_a"), pick("nb", "na").alias("n_b"), lift.alias("lift"))
    share = -F.log2(F.col("n_ab") / F.lit(float(total or 1)))
    return out.withColumn("pmi", F.log2("lift")).withColumn("npmi", F.when(share > 0, F.log2("lift") / share).otherwise(1.0)), total
