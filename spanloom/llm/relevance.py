"""How distinctive a term is for a record: probabilistic relevance weighting (BM25).

Term frequency saturates, is normalised by the record's length against the average, and is weighted by the
inverse document frequency over the whole collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import cut, join_by_count

#: Collections that are scored at once, each with statistics of its own.
MOST_COLLECTIONS = 1000


def score_terms(counts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """counts: `collection`, `record`, `term`, `tf` with any number of rows per (collection, record, term), which are added up.

    Result, one row per collection, record and term: collection, record, term, tf, df (records of the collection holding the term), length
    (sum of the record's tf), n, norm, score. The score is idf * tf (k1 + 1) / (tf + norm)
    with norm = k1 (1 - b + b length / average) and idf = ln(1 + (n - df + 0.5) / (df + 0.5)) over the collection's n records that have terms.
    Null collections, records and terms and counts of 0 or less are left out; an empty term is a term. An empty table gives no rows.

    Hot terms and long records are combined before each shuffle; the joins with document frequencies and lengths send keys
    of more than a thousandth of all rows, of which there are at most a thousand, by broadcast. Collections are few: a row of each is sent.
    """
    rows = counts.select("collection", "record", "term", F.col("tf").cast("bigint").alias("tf"))
    rows = rows.where("collection IS NOT NULL AND record IS NOT NULL AND term IS NOT NULL AND tf > 0")
    tf = cut(rows.groupBy("collection", "record", "term").agg(F.sum("tf").alias("tf")))
    lengths = tf.groupBy("collection", "record").agg(F.sum("tf").alias("length"), F.count("*").alias("terms"))
    known = lengths.groupBy("collection").agg(F.count("*").alias("n"), F.avg("length").alias("average"), F.sum("terms").alias("total")).limit(MOST_COLLECTIONS + 1).collect()
    if len(known) > MOST_COLLECTIONS:
        raise ValueError(f"more than {MOST_COLLECTIONS} collections")
    total = sum(r["total"] for r in known)
    stats = F.broadcast(counts.sparkSession.createDataFrame([(r["collection"], r["n"], r["average"]) for r in known], "collection string, n bigint, average double"))
    df = tf.groupBy("collection", "term").agg(F.count("*").alias("df"))
    joined = join_by_count(tf, df, ["collection", "term"], "df", total)
    joined = join_by_count(joined, lengths, ["collection", "record"], "terms", total).join(stats, "collection")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.col("average"))
    return joined.select("collection", "record", "term", "tf", "df", "length", "n", norm.alias("norm"), _score(F.col("tf"), F.col("df"), F.col("n"), norm, k1).alias("score"))


def _score(tf: Column, df: Column, n: Column, norm: Column, k1: float) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + norm)


def distinctive(scored: DataFrame, min_tf: int, min_df: int, max_df: int, k1: float = 1.2) -> DataFrame:
    """Terms that are frequent in a record and shared by few others, selected by their score.

    The score grows with tf and falls with df, so a term reaches the score that `min_tf` occurrences of a term in `max_df` records
    would have in the same record if it is frequent and rare enough. Those that make up for the one by the other
    are then left out by the counts themselves.
    """
    floor = _score(F.lit(min_tf), F.lit(max_df), F.col("n"), F.col("norm"), k1)
    high = scored.where(F.col("score") >= floor * (1 - 1e-9))
    return high.where((F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df))
