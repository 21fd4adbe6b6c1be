"""Incremental loading: files that arrive are parsed and appended to the corpus tables, each batch once.

A batch writes into a folder of its own number, replacing what an interrupted try left there, so a batch that runs again after a
failure doesn't add its documents twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.plans.compiler import Compiler, Tables
from spanloom.plans.nodes import Node, is_token
from spanloom.plans.parser import parse
from spanloom.plans.rewrite import normalise
from spanloom.sources.descriptor import Format
from spanloom.sources.loaders import FORMATS, Loaded, documents

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, form: str | Format, out: str, checkpoint: str, glob: str = "*") -> StreamingQuery:
    """Starts a query that loads the files of a folder, those there and those to come, and then stops when all are loaded."""
    form = FORMATS[form] if isinstance(form, str) else form
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        loaded = Loaded(documents(batch, form), form)
        for name, df in (("docs", loaded.docs()), ("tokens", loaded.tokens()), ("spans", loaded.spans()), ("relations", loaded.relations())):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        loaded.parsed.unpersist()

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of all batches."""
    return spark.read.parquet(f"{out}/{name}")


def standing_token_query(tokens: DataFrame, pattern: str | Node) -> DataFrame:
    """Hits of a one-token pattern on a stream of tokens: a stateless filter, so it needs no watermark."""
    tree = normalise(parse(pattern) if isinstance(pattern, str) else pattern)
    if not is_token(tree):
        raise ValueError("a standing query takes a condition on one token")
    return Compiler(Tables(tokens)).tokens_where(tree)


def windowed_term_counts(tokens: DataFrame, time: str, term: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Term counts per time window of a stream, with late rows accepted up to a watermark."""
    return tokens.withWatermark(time, late).groupBy(F.window(time, length), F.col(term).alias("term")).agg(F.count("*").alias("freq"))
