"""Frequencies, relevance and pairs against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import dense, frequency, queries, relevance, together


def make(seed=1, n=300):
    r = random.Random(seed)
    word = lambda: r.choice(["the"] * 8 + [f"w{r.randint(0, 40)}", "", None])
    rows = [(i, [word() for _ in range(r.randint(0, 9))] if r.random() < 0.95 else None) for i in range(n)]
    return rows + rows[:20]


def test_value_counts(spark):
    rows = make()
    df = spark.createDataFrame([(k, w, "clash", "clash") for k, w in rows] + [(None, ["nullkey"], "", ""), (None, ["nullkey"], "", "")], "id bigint, w array<string>, term string, records string")
    out, n = frequency.value_counts(df, "id", {"w": "w", "again": "w"})
    occ, rec = Counter({"nullkey": 2}), Counter({"nullkey": 2})
    for _, w in {k: w for k, w in rows}.items():
        occ.update(x for x in w or [] if x is not None)
        rec.update({x for x in w or [] if x is not None})
    for field in ("w", "again"):
        got = {r.term: (r.occurrences, r.records) for r in out.where(F.col("field_name") == field).collect()}
        assert got == {t: (occ[t], rec[t]) for t in occ}
    assert n == 302
    marks = {r.term: r.mark for r in frequency.marked(out.where("field_name = 'w'"), n).collect()}
    assert all(marks[t] == ("rare" if rec[t] < 3 else "common" if rec[t] * 50 > n else None) for t in rec)
    empty, none = frequency.value_counts(df.limit(0), "id", {"w": "w"})
    assert empty.count() == 0 and none == 0


def test_string_keys_and_full_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(frequency, "LOCAL_VALUES", 5)
    rows = make(2)
    df = spark.createDataFrame([(f"k{k}", w) for k, w in rows], "id string, w array<string>")
    out, n = frequency.value_counts(df, "id", {"w": "w"})
    rec = Counter(x for _, w in {k: w for k, w in rows}.items() for x in set(w or []) if x is not None)
    assert {r.term: r.records for r in out.collect()} == dict(rec) and n == 300


def test_dense_ids(spark):
    df = dense.with_dense_ids(spark.range(1000).repartition(7))
    assert sorted(r.id for r in df.select("id").collect()) == list(range(1000))


def test_relevance(spark):
    r = random.Random(3)
    rows = [(f"d{r.randint(0, 30)}", r.choice(["the", "the", f"t{r.randint(0, 20)}", ""]), r.randint(1, 4)) for _ in range(800)]
    df = spark.createDataFrame(rows + [(None, "x", 1), ("d1", None, 1), ("d1", "zero", 0), ("d1", "nul", None)], "record string, term string, tf int").withColumns({"df": F.lit("clash"), "collection": F.lit("one")})
    df = df.unionByName(df.where("record <> 'd0'").withColumn("collection", F.lit("other"))).unionByName(df.withColumn("collection", F.lit(None).cast("string")))
    tf = Counter()
    for rec, t, n in rows:
        tf[rec, t] += n
    length, records = Counter(), defaultdict(set)
    for (rec, t), n in tf.items():
        length[rec] += n
        records[t].add(rec)
    avg, n = sum(length.values()) / len(length), len(length)
    scored = relevance.score_terms(df)
    got = {(x.record, x.term): x for x in scored.where("collection = 'one'").collect()}
    assert set(got) == set(tf)
    for (rec, t), x in got.items():
        idf = math.log(1 + (n - len(records[t]) + 0.5) / (len(records[t]) + 0.5))
        want = idf * tf[rec, t] * 2.2 / (tf[rec, t] + 1.2 * (0.25 + 0.75 * length[rec] / avg))
        assert (x.tf, x.df, x.length) == (tf[rec, t], len(records[t]), length[rec]) and x.score == pytest.approx(want)
    assert scored.where("collection = 'other' AND record = 'd0'").count() == 0 < scored.where("collection = 'other'").count()
    assert relevance.score_terms(df.limit(0)).count() == 0
    for low, few, many in ((2, 2, 4), (6, 1, 20), (1, 3, 3)):
        found = {(x.record, x.term) for x in relevance.distinctive(scored.where("collection = 'one'"), low, few, many).collect()}
        assert found == {(rec, t) for (rec, t), n in tf.items() if n >= low and few <= len(records[t]) <= many}
    # the score decides: with another one, other terms are found
    upside_down = scored.where("collection = 'one'").withColumn("score", -F.col("score"))
    assert relevance.distinctive(upside_down, 6, 1, 20).count() == 0


def brute(rows, least, per_thousand):
    baskets = [set(x for x in w or [] if x is not None) for w in {k: w for k, w in rows}.values()]
    one, two = Counter(x for b in baskets for x in b), Counter()
    for b in baskets:
        two.update(itertools.combinations(sorted(b, key=lambda s: s.encode()), 2))
    bar = max(least, -(-per_thousand * len(baskets) // 1000))
    return {(a, b): (n, one[a], one[b]) for (a, b), n in two.items() if n >= bar}, len(baskets)


@pytest.mark.parametrize("chunk,sent", [(512, 200_000), (3, 200_000), (3, 2), (1, 2)])
def test_pairs(spark, chunk, sent):
    # small chunks: every basket is a huge one; few items to send: they are joined
    rows = make(5)
    df = spark.createDataFrame([(k, w, "x") for k, w in rows], "id bigint, w array<string>, n string")
    out, n = together.associations(df, "id", "w", 3, 10, sent, chunk)
    want, total = brute(rows, 3, 10)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in out.collect()}
    assert got == want and n == total
    for r in out.collect():
        assert r.lift == pytest.approx(n * r.n_ab / (r.n_a * r.n_b))


def test_every_pair_has_a_row(spark, tmp_path):
    rows = make(7)
    part = "struct<word: array<string>>"
    hits = spark.createDataFrame([(k, (w,), (["m"],), (None,)) for k, w in rows], f"hit_id bigint, left {part}, match {part}, right {part}")
    hits.write.parquet(str(tmp_path / "hits.parquet"))
    want, _ = brute([(k, [*(w or []), "m"]) for k, w in rows], 1, 0)  # a null side leaves the other sides' words
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in queries.QUERIES["p5_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == want and min(c[0] for c in got.values()) == 1


def test_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, w array<string>")
    out, n = together.associations(df, "id", "w", least=1)
    assert out.count() == 0 and n == 0
    lone = spark.createDataFrame([(1, ["a"]), (2, None), (None, ["a", "a", None])], "id bigint, w array<string>")
    out, n = together.associations(lone, "id", "w", least=1)
    assert out.count() == 0 and n == 3


def test_huge_baskets_are_spread(spark):
    wide = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(1, wide), (2, wide[:100]), (3, ["w0", "w1"])], "id bigint, w array<string>")
    out, _ = together.associations(df, "id", "w", least=1)
    assert out.count() == 3000 * 2999 // 2
    assert {(r.n_ab, r.n_a, r.n_b) for r in out.where("item_a = 'w0' AND item_b = 'w1'").collect()} == {(3, 3, 3)}
    cells = together._products(spark.createDataFrame([(list(range(3000)),)], "ids array<bigint>"), 512)
    assert cells.count() == 21 and max(max(len(r.x), len(r.y or [])) for r in cells.collect()) == 512
