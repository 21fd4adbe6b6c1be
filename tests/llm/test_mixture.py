"""Mixing of sources: shares, caps, sources without documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixture as mx


def docs(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, "word " * int(rng.integers(1, 60)), rng.choice(["en", "nl", None]), source, rng.choice(["news", "letter"])))
            i += 1
    rows += [(i, None, None, "a", None), (i + 1, "", "en", "a", "news"), (i + 2, "loose", "en", None, None)]
    return spark.createDataFrame([(int(a), b, None if c is None else str(c), d, None if e is None else str(e)) for a, b, c, d, e in rows], "doc_id bigint, text string, lang string, source string, genre string")


def test_mix(spark):
    df = docs(spark, {"a": 400, "b": 150, "c": 10, "unlisted": 50}).withColumnRenamed("doc_id", "doc_id")
    targets = spark.createDataFrame([("a", 2.0, 3), ("b", 3.0, 4), ("c", 1.0, 2), ("none", 1.0, 5), (None, 1.0, 1), ("zero", 0.0, 5)], "source string, target_weight double, max_repeats int")
    m = mx.mix(df, targets)
    rep = {r.source: r for r in m.report.collect()}
    assert set(rep) == {"a", "b", "c", "none", "zero"}
    assert {s for s, r in rep.items() if r.is_short} == {"c", "none"}
    for s in ("a", "b"):
        assert rep[s].share_of_goal == pytest.approx(rep[s].target_share, rel=0.02)
    assert rep["c"].mixed_tokens == rep["c"].size * 2 and rep["none"].mixed_tokens == 0
    chosen = m.documents.collect()
    assert all(r.copies <= {"a": 3, "b": 4, "c": 2}[r.source] and r.n_tokens > 0 for r in chosen)
    assert len({r.doc_id for r in chosen}) == len(chosen)
    again = mx.mix(df, targets).documents.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, chosen))


def brute_short(spark, df, targets):
    """The definition: size * max_repeats < share * total."""
    sizes = mx.sized(df, targets).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    size, shares = {r["source"]: r["n"] for r in sizes}, mx.wanted_shares(targets)
    total = sum(size.values())
    return {s for s, (share, cap) in shares.items() if size.get(s, 0) * cap < share * total}


def test_short_sources_against_definition(spark):
    df = docs(spark, {"a": 30, "b": 3, "c": 12})
    for weights in ((1.0, 1.0, 1.0), (1.0, 9.0, 3.0), (5.0, 0.1, 0.2)):
        targets = spark.createDataFrame([("a", weights[0], 1), ("b", weights[1], 2), ("c", weights[2], 1), ("d", 0.0, 3)], "source string, target_weight double, max_repeats int")
        got = {r.source for r in mx.mix(df, targets).report.where("is_short").collect()}
        assert got == brute_short(spark, df, targets)


def test_shortness_comes_from_the_fit(spark, monkeypatch):
    df = docs(spark, {"a": 30, "b": 3})
    targets = spark.createDataFrame([("a", 1.0, 3), ("b", 1.0, 2)], "source string, target_weight double, max_repeats int")
    assert {r.source for r in mx.mix(df, targets).report.where("is_short").collect()} == {"b"}
    real = mx.rake
    monkeypatch.setattr(mx, "rake", lambda *a: (real(*a)[0] * 0.5, 0.0))  # a fit that gives each cell half
    assert {r.source for r in mx.mix(df, targets).report.where("is_short").collect()} == {"a", "b"}


def test_margins(spark):
    df = docs(spark, {"a": 900, "b": 500, "c": 10})
    targets = spark.createDataFrame([("a", 2.0, 3), ("b", 3.0, 4), ("c", 1.0, 2)], "source string, target_weight double, max_repeats int")
    m = mx.mix(df, targets)
    rows = {(r.margin, r.value): r for r in m.margins.collect()}
    assert {k[1] for k in rows if k[0] == "language"} == {"en", "nl", None, "None"} - {"None"} and {k[1] for k in rows if k[0] == "topic"} == {"news", "letter", None}
    assert m.residual < 1e-3
    for (kind, value), r in rows.items():
        if kind != "source" and value is not None:
            assert r.fitted == pytest.approx(r.wanted, rel=1e-2) and r.mixed_tokens == pytest.approx(r.fitted, rel=0.1)
    for kind in ("source", "language", "topic"):
        assert sum(r.mixed_tokens for k, r in rows.items() if k[0] == kind) == m.report.agg(F.sum("mixed_tokens")).first()[0]


def test_many_cells_are_raked_with_joins(spark, monkeypatch):
    df = docs(spark, {"a": 400, "b": 150, "c": 10})
    targets = spark.createDataFrame([("a", 2.0, 3), ("b", 3.0, 4), ("c", 1.0, 2), ("none", 1.0, 5)], "source string, target_weight double, max_repeats int")
    few = {r.source: r for r in mx.mix(df, targets).report.collect()}
    monkeypatch.setattr(mx, "MOST_CELLS", 3)
    monkeypatch.setattr(mx, "JOINED_ROUNDS", 6)
    joined = mx.mix(df, targets)
    many = {r.source: r for r in joined.report.collect()}
    assert {s for s, r in many.items() if r.is_short} == {s for s, r in few.items() if r.is_short} == {"c", "none"}
    for s in few:
        assert many[s].mixed_tokens == pytest.approx(few[s].mixed_tokens, rel=0.01)
    assert joined.residual < 0.01


def test_nothing(spark):
    df = docs(spark, {"a": 3})
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    none = mx.mix(df.limit(0), targets)
    assert none.documents.count() == 0 and none.report.first().mixed_tokens == 0
    assert mx.mix(df, targets.limit(0)).report.count() == 0
    odd = spark.createDataFrame([("a", None, None), ("a", -2.0, -1)], "source string, target_weight double, max_repeats int")
    assert mx.mix(df, odd).documents.count() == 0


def test_rake():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 50, (3, 4, 2)).astype(float)
    s, l, g = (x.ravel() for x in np.indices(table.shape))
    cells = table.ravel()
    wanted = table.sum((1, 2))[::-1] * 0.8
    flat, residual = mx.rake(s, [l, g], cells, wanted, np.array([3.0, 3.0, 3.0]))
    out = flat.reshape(table.shape)
    assert np.allclose(out.sum((1, 2)), wanted) and (flat <= cells * 3 + 1e-9).all() and residual < 0.01
    goal = table.sum((0, 2)) / table.sum() * wanted.sum()
    assert np.allclose(out.sum((0, 2)), goal, rtol=0.01)


def test_fill():
    rng = np.random.default_rng(4)
    for _ in range(200):
        most = rng.integers(0, 9, 6).astype(float)
        out = np.minimum(rng.random(6) * 5, most)
        wanted = float(rng.random() * 40)
        got = mx.fill(out, most, wanted)
        assert (got <= most + 1e-9).all() and got.sum() == pytest.approx(min(wanted, most.sum()))
