"""Checkpoints and their removal, redelivered rows, joins with hot keys."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom import session, tables


def test_checkpoints_are_deleted(spark):
    with session.temporary():
        held = session.cut(spark.range(10))
        file = session._kept[-1][1].removeprefix("file:")
        assert held.count() == 10 and os.path.isdir(file)
    assert not os.path.exists(file)


@pytest.mark.parametrize("most", [100, 0])
def test_single(spark, most):
    rows = [(i % 20, [i % 20]) for i in range(33)] + [(None, [1]), (None, [2])]
    df = spark.createDataFrame(rows, "id int, w array<int>")
    got = sorted(tables.single(df, "id", most).collect(), key=str)
    assert len(got) == 22 and sorted(r.id for r in got if r.id is not None) == list(range(20))
    assert all(r.w == [r.id] for r in got if r.id is not None)
    once = df.where("id IS NOT NULL").distinct()
    assert tables.single(once, "id", most).count() == 20 and tables.single(df.limit(0), "id", most).count() == 0


def test_join_by_count(spark):
    big = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v"))
    counts = big.groupBy("k").agg(F.count("*").alias("n"))
    got = session.join_by_count(big, counts, ["k"], "n", 1000, 10)
    want = big.join(counts, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
