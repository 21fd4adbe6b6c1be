"""Reading of the corpus tables and removal of redelivered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import cut, importable

#: Keys that occur more than once are sent to the tasks up to this many, else their rows are shuffled.
MOST_REPEATED = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """One row per key. With `latest`, the row with the greatest value of that column wins, nulls last.

    Map-side combined, so a key that is redelivered very often doesn't gather in one task.
    Null keys are keys of their own.
    """
    if latest is None:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c not in keys]
    # a null order gives a null row for max_by unless it is made a value
    rank = F.coalesce(F.col(latest), F.lit("0001-01-01").cast("timestamp"))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def single(df: DataFrame, key: str, most: int = MOST_REPEATED) -> DataFrame:
    """One row per key, where rows of one key are equal in all that matters and few keys are redelivered.

    Only keys are shuffled to find the repeated ones; rows of those alone are then merged, all others pass by. With more than `most`
    repeated keys, a bound for what is sent to the tasks, all rows are shuffled instead, map-side combined. A row with
    a null key is a record of its own.
    """
    repeated = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    found = repeated.limit(most + 1).count()
    if not found:
        return df
    if found > most:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
    few = F.broadcast(repeated)
    return df.join(few, key, "left_anti").unionByName(df.join(few, key, "left_semi").dropDuplicates([key]))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "docs"), ["doc_id"], "indexed_at")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "tokens"), ["doc_id", "pos"])


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans once each; `attrs` becomes a sorted array of entries while rows are compared, since maps can't be."""
    df = table(spark, sf_dir, "spans")
    keyed = df.withColumn("attrs", F.sort_array(F.map_entries("attrs"))).dropDuplicates()
    return keyed.withColumn("attrs", F.map_from_entries("attrs"))
