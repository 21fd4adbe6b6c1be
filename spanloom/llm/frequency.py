"""Frequencies of every distinct value, by a global integer dictionary and blockwise count arrays.

1. The records that a task reads are a block, without those redelivered; only keys are shuffled to find these. A block counts occurrences
   and record presence of its own values in arrays over a local dictionary; a value that is in a third of all rows leaves a block as one entry.
2. All distinct (field, value) pairs get dense integer ids: the global dictionary.
3. Block entries are encoded with those ids and sent to the task of their identifier range, which sums
   them in two arrays per range.
4. The sums come back to the dictionary's values by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.dense import with_dense_ids
from spanloom.session import cut
from spanloom.tables import single

#: Ids per range; the two arrays of a range take 16 bytes an id.
RANGE = 1 << 16
#: A block's local dictionary is emitted and started anew beyond so many values.
LOCAL_VALUES = 1 << 20


class _Block:
    """Counts of one block: a local dictionary per field and arrays over it."""

    def __init__(self, n_fields: int):
        self.codes: list[dict] = [{} for _ in range(n_fields)]
        self.occurrences = [np.zeros(1024, np.int64) for _ in range(n_fields)]
        self.records = [np.zeros(1024, np.int64) for _ in range(n_fields)]

    def add(self, field: int, lists: pa.Array) -> None:
        """One Arrow array of lists, one list per record. Null values are skipped."""
        values = pc.list_flatten(lists)
        if not len(values):
            return
        owner = pc.list_parent_indices(lists).to_numpy()
        local = values.dictionary_encode()
        known = self.codes[field]
        mapped = np.array([-1 if v is None else known.setdefault(v, len(known)) for v in local.dictionary.to_pylist()] or [-1], np.int64)
        codes = mapped[local.indices.fill_null(0).to_numpy(zero_copy_only=False)]
        real = ~np.asarray(pc.is_null(values).to_numpy(zero_copy_only=False), bool) & (codes >= 0)
        codes, owner = codes[real], owner[real].astype(np.int64)
        for arrays in (self.occurrences, self.records):
            if len(arrays[field]) < len(known):
                arrays[field] = np.concatenate([arrays[field], np.zeros(len(known) * 2 - len(arrays[field]), np.int64)])
        n = len(known)
        self.occurrences[field][:n] += np.bincount(codes, minlength=n)
        pairs = np.unique(owner << np.int64(32) | codes)
        self.records[field][:n] += np.bincount(pairs & 0xFFFFFFFF, minlength=n)

    def size(self) -> int:
        return sum(map(len, self.codes))

    def emit(self, n_records: int) -> pa.RecordBatch:
        fields, terms, occ, rec = [], [], [], []
        for i, known in enumerate(self.codes):
            fields += [i] * len(known)
            terms += list(known)
            occ.append(self.occurrences[i][: len(known)])
            rec.append(self.records[i][: len(known)])
        fields.append(-1)  # the block's number of records
        terms.append("")
        one = np.array([n_records], np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(fields, pa.int32()), pa.array(terms, pa.string()), pa.array(np.concatenate([*occ, one])), pa.array(np.concatenate([*rec, one]))],
            names=["field_no", "term", "occurrences", "records"],
        )


BLOCK_SCHEMA = "field_no int, term string, occurrences bigint, records bigint"


def _count_blocks(n_fields: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n_records = _Block(n_fields), 0
        for batch in batches:
            n_records += batch.num_rows
            for i in range(n_fields):
                block.add(i, batch.column(i))
            if block.size() > LOCAL_VALUES:
                yield block.emit(n_records)
                block, n_records = _Block(n_fields), 0
        yield block.emit(n_records)

    return run


def _sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums encoded block entries in arrays by identifier range; a partition holds whole ranges."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        ids, occ, rec = (batch.column(i).to_numpy() for i in range(3))
        ranges = ids // RANGE
        for r in np.unique(ranges):
            at = ranges == r
            a, b = sums.setdefault(int(r), (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)))
            np.add.at(a, ids[at] - r * RANGE, occ[at])
            np.add.at(b, ids[at] - r * RANGE, rec[at])
    for r, (a, b) in sums.items():
        some = np.flatnonzero(b)
        yield pa.RecordBatch.from_arrays([pa.array(some + r * RANGE), pa.array(a[some]), pa.array(b[some])], names=["id", "occurrences", "records"])


def value_counts(df: DataFrame, key: str, fields: dict[str, str]) -> tuple[DataFrame, int]:
    """Occurrences and records of every distinct value of some array columns, and the number of records.

    fields: name in the result to an expression of array<string>. Result: field_name, term, occurrences,
    records. Null arrays and null values count for nothing, the empty string is a value like others, and values are
    compared as stored. Records of one key count once; a record without a key is one of its own. An empty table gives no rows and 0.
    """
    names = list(fields)
    rows = df.select(F.col(key), *[F.expr(e).alias(f"_{i}") for i, e in enumerate(fields.values())])
    # Arrow lists keep their offsets only without nulls among the lists
    rows = single(rows.withColumnRenamed(key, "_key"), "_key")
    rows = rows.select(*[F.coalesce(F.col(f"_{i}"), F.array().cast("array<string>")).alias(f"_{i}") for i in range(len(names))])
    blocks = cut(rows.mapInArrow(_count_blocks(len(names)), BLOCK_SCHEMA))
    n = blocks.where("field_no = -1").agg(F.sum("records")).first()[0] or 0
    ids = with_dense_ids(blocks.where("field_no >= 0").select("field_no", "term").distinct())
    encoded = blocks.where("field_no >= 0").join(ids, ["field_no", "term"]).select("id", "occurrences", "records")
    ranges = encoded.withColumn("_range", F.col("id").bitwiseAND(~(RANGE - 1))).repartition("_range").drop("_range")
    sums = ranges.mapInArrow(_sum_ranges, "id bigint, occurrences bigint, records bigint")
    labels = F.array(*[F.lit(x) for x in names])
    out = ids.join(sums, "id").select(F.element_at(labels, F.col("field_no") + 1).alias("field_name"), "term", "occurrences", "records")
    return out, int(n)


def marked(counts: DataFrame, n_records: int, rare_below: int = 3, common_one_in: int = 50) -> DataFrame:
    """Adds `mark`: `rare` for values in fewer than `rare_below` records, `common` for others in more than one of
    `common_one_in` records, null for the useful rest. Compared in whole numbers."""
    common = F.col("records") * common_one_in > F.lit(n_records)
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(common, "common"))
