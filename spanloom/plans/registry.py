"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.operators import results
from spanloom.plans import core_queries, corpus_queries, source_queries
from spanloom.plans.compiler import run


def queries() -> dict:
    return core_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return core_queries.SQL | source_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern's hits, grouped by their text, the largest groups first."""
    t = corpus_queries.corpus(spark, sf_dir)
    hits = run("[pos='JJ'] [pos='NN.*']", t)
    return results.sort_groups(results.group_hits(hits, t, "hit:word:i"), "size")
