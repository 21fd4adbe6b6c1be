"""Plain text to tokens, with the text between them and character offsets; all in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = "[\\p{L}\\p{N}]+"


def tokens_of(df: DataFrame, key: str, text: str, word: str = WORD) -> DataFrame:
    """key, pos, word. A null or empty text has no tokens."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0))).alias("pos", "word"))


def tokens_with_offsets(df: DataFrame, key: str, text: str, word: str = WORD) -> DataFrame:
    """key, pos, word, punct (the text before), char_start, char_end (in code points, the end excluded)."""
    words = F.regexp_extract_all(F.col(text), F.lit(word), F.lit(0))
    # what stands between words: split gives one piece more than there are words
    between = F.split(F.col(text), word)
    rows = df.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("_row"), key, words.alias("_w"), between.alias("_b"))
    pieces = F.zip_with("_w", F.slice("_b", 1, F.size("_w")), lambda w, b: F.struct(w.alias("word"), F.coalesce(b, F.lit("")).alias("punct")))
    flat = rows.where(F.size("_w") > 0).select("_row", key, F.posexplode(pieces).alias("pos", "_t")).select("_row", key, "pos", "_t.word", "_t.punct")
    # a text is one row, so a running sum over its words is no more than a task holds anyway
    up_to = W.partitionBy("_row").orderBy("pos")
    end = F.sum(F.length("punct") + F.length("word")).over(up_to).cast("int")
    return flat.withColumn("char_end", end).select(key, "pos", "word", "punct", (F.col("char_end") - F.length("word")).alias("char_start"), "char_end")
