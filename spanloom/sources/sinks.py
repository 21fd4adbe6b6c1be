"""Sinks: corpus tables, hits and documents as CSV, frequency lists, JSON, originals and metadata; deletion by filter."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fold
from spanloom.plans import docfilter


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, arrays of words joined by blanks, so that CSV can hold them."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(c, " ")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, separator: str = ",", single: bool = False) -> None:
    """CSV with a header; `single` writes one file, for small results only."""
    (flat(df).coalesce(1) if single else flat(df)).write.mode("overwrite").option("header", True).option("sep", separator).option("escape", '"').csv(path)


def csv_text(df: DataFrame, declare_separator: bool = False, most: int = 100_000, summary: dict | None = None) -> str:
    """A small result as CSV text, optionally with a `sep=,` line for spreadsheets. Raises beyond `most` rows.

    summary: names and values of a block behind the header, a row each, with the name in the first and the value in the second column.
    """
    import csv
    import io

    rows = flat(df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with write_csv")
    out = io.StringIO()
    if declare_separator:
        out.write("sep=,\r\n")
    w = csv.writer(out)
    w.writerow(df.columns)
    for name, value in (summary or {}).items():
        w.writerow([f"summary.{name}", value, *[""] * (len(df.columns) - 2)])
    w.writerows([["" if v is None else v for v in r] for r in rows])
    return out.getvalue()


def write_frequency_list(df: DataFrame, path: str, compress: bool = True, as_json: bool = False) -> None:
    """Sorted lists as TSV or JSON lines; sorting and spilling are Spark's."""
    ordered = df.orderBy(F.desc("freq"), *[c for c in df.columns if c != "freq"])
    w = ordered.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    w.json(path) if as_json else w.option("sep", "\t").option("header", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_originals(docs: DataFrame, path: str) -> None:
    """pid and the stored original of each document."""
    docs.select("pid", "raw").write.mode("overwrite").json(path)


def export_metadata(docs: DataFrame, path: str) -> None:
    docs.drop("raw").write.mode("overwrite").json(path)


def write_corpus(tables: dict[str, DataFrame], path: str, mode: str = "overwrite", folded: tuple[str, ...] = ("word", "lemma", "a_pos"), config: dict | None = None) -> None:
    """The tables as Parquet, tokens once per position. Tokens are clustered by document and position; a hot document is spread by blocks.

    Annotations named in `folded` get a column `<name>_i` without case and accents, and spans `tag_i`: insensitive equality and prefixes
    then reach the scan, with dictionaries and statistics to skip row groups. Lengths and relation classes are stored beside them, and so is `config`,
    what a descriptor says about the corpus as a whole.
    """
    for name, df in tables.items():
        if name == "spans":
            df = df.withColumn("tag_i", fold(F.col("tag")))
        if name == "tokens":
            df = df.dropDuplicates(["doc_id", "pos"]).withColumns({f"{c}_i": fold(F.col(c)) for c in folded if c in df.columns})
            df = df.repartition("doc_id", F.floor(F.col("pos") / 65536)).sortWithinPartitions("doc_id", "pos")
        df.write.mode(mode).parquet(f"{path}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    for name, df in store_lengths({n: spark.read.parquet(f"{path}/{n}.parquet") for n in tables}).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    if config:
        spark.createDataFrame([(json.dumps(config, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def bucketed_tables(tables: dict[str, DataFrame], prefix: str, path: str, buckets: int = 200) -> None:
    """Tables of the catalog, bucketed by document and stored below `path`: joins between them on the document, such as filters and
    originals, need no shuffle."""
    for name, df in tables.items():
        df.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id").option("path", f"{path}/{name}").saveAsTable(f"{prefix}_{name}")


def store_lengths(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The small tables that searching would otherwise compute each time: true lengths, and the classes of relations."""
    more = {"lengths": tables["tokens"].groupBy("doc_id").agg((F.max("pos") + 1).alias("length"))} if "tokens" in tables else {}
    if "relations" in tables:
        more["relation_classes"] = tables["relations"].select("rel_class").distinct()
    return more


def delete_documents(tables: dict[str, DataFrame], text: str) -> dict[str, DataFrame]:
    """The tables without the documents that a filter matches; write them to another path."""
    gone = docfilter.filter_documents(tables["docs"], text).select("doc_id")
    return {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}
