"""Dense integer ids for the distinct values of a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.session import cut


def with_dense_ids(df: DataFrame, into: str = "id") -> DataFrame:
    """Adds ids 0.. without gaps, and cuts the lineage so that they stay the same when a task runs again.

    No global order is made: where each partition starts is a running sum over one row per partition, joined by broadcast.
    """
    held = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id: the partition's number above bit 33, the row's place below
    parted = held.withColumn("_part", F.shiftright("_at", 33))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return parted.join(F.broadcast(starts), "_part").withColumn(into, (F.col("_start") + place).cast("bigint")).drop("_part", "_start", "_at")
