"""Result operations, relations, alignments and helpers on small tables."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import properties as pr
from spanloom.operators import relations as rl
from spanloom.operators import results as rs
from spanloom.operators import spans as sp
from spanloom.plans.compiler import Tables, run
from spanloom.session import join_by_count
from spanloom.sources import loaders, parsers
from spanloom.sources.descriptor import BUNDLED
from spanloom.tables import once

WORDS = ["the old dog saw the dog", "a dog ran", "one", "The DOG the dog"]


@pytest.fixture(scope="module")
def t(spark):
    rows, at = [], {}
    for d, text in enumerate(WORDS):
        start = 0
        for p, w in enumerate(text.split()):
            rows.append((d, p, w, w.lower(), "NN" if w.lower() == "dog" else None, " " if p else "", start, start + len(w)))
            at[d, p] = start
            start += len(w) + 1
    rows += rows[:3]  # repeated rows
    stored = spark.createDataFrame(rows, "doc_id bigint, pos int, word string, lemma string, a_pos string, punct string, char_start int, char_end int").cache()
    spans = spark.createDataFrame([(0, "s", 0, 6, {"n": "1"}), (0, "s", 0, 6, {"n": "1"}), (1, "s", 0, 2, {}), (3, "s", 0, 4, None)], "doc_id bigint, tag string, start_pos int, end_pos int, attrs map<string,string>").cache()
    rel = [(0, "contents", 1, "dep", "det", 2, 3, 0, 1, False), (0, "contents", 2, "dep", "amod", 2, 3, 1, 2, False), (0, "contents", 3, "dep", "obj", 3, 4, 5, 6, False), (0, "contents", 4, "dep", "root", 3, 4, 3, 4, True)]
    relations = spark.createDataFrame(rel, "doc_id bigint, field string, rel_id bigint, rel_class string, rel_type string, src_start int, src_end int, tgt_start int, tgt_end int, is_root boolean")
    relations = relations.withColumn("tgt_field", F.lit("contents")).withColumn("attrs", F.create_map(F.lit("k"), F.array(F.lit("v")))).cache()
    return Tables(stored.dropDuplicates(["doc_id", "pos"]), spans, relations, {"word": "word", "lemma": "lemma", "pos": "a_pos"}, stored=stored)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(0, "p0", "B", 6, "1994"), (1, "p1", "A", 3, None), (2, "p2", None, None, "x"), (3, "p3", "B", 4, "2001-05")], "doc_id bigint, pid string, title string, length_tokens int, year string")


def at(df):
    return [(r.doc_id, r.start_pos) for r in df.collect()]


def test_sorts_filters_pages(t, docs):
    h = run("'dog'", t)
    assert at(rs.sort_hits(h, t, "field:title,-hitposition", docs)) == [(1, 1), (0, 5), (3, 3), (0, 2), (3, 1)]
    assert at(rs.sort_hits(h, t, "before:word:i:1")) == [(1, 1), (0, 2), (0, 5), (3, 1), (3, 3)]
    assert at(rs.sort_hits(h, t, "-(docid,hitposition)"))[0] == (3, 3)
    assert at(rs.window(rs.sort_hits(h, t, "docid"), 1, 2)) == [(0, 5), (1, 1)]
    assert sorted(at(rs.filter_hits(h, t, "hit:word:s", "DOG"))) == [(3, 1)]
    assert rs.limited(h, 2)[1] and not rs.limited(h, 9)[1]
    one, two = rs.sample(h, number=2, seed=3), rs.sample(h, number=2, seed=3)
    assert at(one) == at(two) and len(at(one)) == 2 and len(at(rs.sample(h, fraction=0.4))) == 2
    with pytest.raises(ValueError):
        rs.sample(h)
    with pytest.raises(pr.PropertyError):
        rs.sort_hits(h, t, "numhits")
    with pytest.raises(pr.PropertyError):
        pr.parse("nosuch")


def test_groups(t, docs):
    h = run("'dog'", t)
    g = {r.g0: (r["size"], r.docs) for r in rs.group_hits(h, t, "hit:word:s").collect()}
    assert g == {"dog": (4, 3), "DOG": (1, 1)}
    kept = rs.group_hits(h, t, "hit:word:i", keep=2).first()
    assert [tuple(x) for x in kept.hits] == [(0, 2, 3), (0, 5, 6)] and kept["size"] == 5
    decades = {r.g0: r["size"] for r in rs.group_hits(h, t, "decade:year", docs).collect()}
    assert decades == {1990: 2, 10_000_000: 1, 2000: 2}
    assert [r.g0 for r in rs.sort_groups(rs.group_hits(h, t, "hit:word:s"), "identity").collect()] == ["DOG", "dog"]
    grouped = {r.g0: (r.docs, r.tokens) for r in rs.group_docs(docs, "field:title").collect()}
    assert grouped == {"B": (2, 10), "A": (1, 3), "": (1, 0)}
    with pytest.raises(pr.PropertyError):
        rs.group_docs(docs, "doc")
    assert rs.group_hits(h.limit(0), t, "hit:word:i").count() == 0


def test_contexts(t, docs):
    k = {(r.doc_id, r.start_pos): r for r in rs.kwic(run("'dog'", t), t, ["word", "lemma"], 2, 1).collect()}
    assert (k[0, 2].left_word, k[0, 2].right_word, k[3, 1].match_lemma) == (["the", "old"], ["saw"], ["dog"]) and k[0, 5].right_word == []
    c = {(r.doc_id, r.start_pos): r for r in rs.concordance(run("'saw'", t), t).collect()}
    assert (c[0, 3].left_text, c[0, 3].match_text, c[0, 3].right_text) == ("the old dog", " saw", " the dog")
    span = {(r.doc_id, r.start_pos): (len(r.left_word), len(r.right_word)) for r in rs.kwic_in_span(run("'dog'", t), t, "s").collect()}
    assert span == {(0, 2): (2, 3), (0, 5): (5, 0), (1, 1): (1, 0), (3, 1): (1, 2), (3, 3): (3, 0)}
    coll = {r.term: r.freq for r in rs.collocations(run("'saw'", t), t, None, 2, 2).collect()}
    assert coll == {"old": 1, "dog": 2, "the": 1}
    raw = docs.sparkSession.createDataFrame([(i, w) for i, w in enumerate(WORDS)], "doc_id bigint, raw string")
    assert rs.snippet(raw, run("'saw'", t), t, 1, 1).first().snippet == "dog saw the"


def test_highlight_never_crosses_tags():
    assert rs.highlight("<p>a <b>dog</b> x</p>", [(3, 11)]) == "<p><hl>a </hl><b><hl>dog</hl></b> x</p>"
    assert rs.highlight("plain", [(0, 2), (4, 9)]) == "<hl>pl</hl>ai<hl>n</hl>"


def test_terms(t, docs):
    assert {r.term: r.freq for r in rs.term_frequencies(t).collect()}["dog"] == 5
    assert {r.term: r.freq for r in rs.term_frequencies(t, terms=["DOG", "none"]).collect()} == {"dog": 5, "none": 0}
    assert [r.term for r in rs.autocomplete(t, "o").collect()] == ["old", "one"]
    lists = {(r.word, r.title): r.freq for r in rs.frequency_list(t, ["word"], ["title"], docs, "i").collect()}
    assert lists["dog", "B"] == 4 and lists["one", ""] == 1
    assert {(r.field, r.value): r.docs for r in rs.facets(docs, ["title", "year"]).collect()}["title", "B"] == 2


def test_relations(t):
    assert sorted(at(run("_ -det-> 'the' ; -amod-> 'old'", t))) == [(0, 2)]
    assert run("_ -det-> _ ; -det-> _", t).count() == 0  # children match different relations
    assert sorted(at(run("'dog' !-det-> _", t))) == [(0, 5), (1, 1), (3, 1), (3, 3)]
    assert at(run("^-root-> 'saw'", t)) == [(0, 3)]
    full = run("rspan('dog' -det-> _, 'full')", t).first()
    assert (full.start_pos, full.end_pos) == (0, 3)
    lists = {r.doc_id: len(r.c_rs or []) for r in run("rcapture(<s/>, 'rs')", t).collect()}
    assert lists == {0: 4, 1: 0, 3: 0}
    inner = run("rcapture2(A:('old' 'dog') 'saw', 'A', 'rs')", t).first()
    assert [r.rel_type for r in inner.c_rs] == ["amod"]
    ctx = {(r.doc_id, r.start_pos) for r in run("@context=s 'dog'", t).collect()}
    assert ctx == {(0, 2), (0, 5), (1, 1), (3, 1), (3, 3)}
    stats = {(r.rel_type, r.attribute): r.n for r in rl.statistics(t.relations).collect()}
    assert stats["det", None] == 1 and stats["det", "k"] == 1


def test_alignment(spark, t):
    other = spark.createDataFrame([(0, 0, "de"), (0, 1, "oude"), (0, 2, "hond")], "doc_id bigint, pos int, word string")
    rel = spark.createDataFrame([(0, "contents", 1, "al", "w", 1, 2, 1, 2, False), (0, "contents", 2, "al", "w", 2, 3, 2, 3, False)], "doc_id bigint, field string, rel_id bigint, rel_class string, rel_type string, src_start int, src_end int, tgt_start int, tgt_end int, is_root boolean")
    rel = rel.withColumn("tgt_field", F.lit("contents__nl")).withColumn("attrs", F.create_map().cast("map<string,array<string>>"))
    p = Tables(t.tokens, t.spans, rel, t.annotations, stored=t.stored, fields={"contents__nl": Tables(other, None, None, {"word": "word"}, name="contents__nl")})
    assert at(run("('old' 'dog') ==>nl ('oude' 'hond')", p)) == [(0, 1)]
    assert run("'dog' ==>nl _", p).count() == 1 and run("'dog' ==>nl? _", p).count() == 5
    assert at(run("rfield('dog' ==>nl 'hond', 'nl')", p)) == [(0, 2)]


def test_join_by_count(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)], "k string, v int")
    counts = big.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = join_by_count(big, counts, ["k"], "n", 550, hot_keys=10)
    assert sorted(map(tuple, got.select("k", "v", "m").collect())) == sorted(map(tuple, big.join(counts, "k").select("k", "v", "m").collect()))


def test_once(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP'2024-01-01 00:00:00'), (1, 'b', TIMESTAMP'2024-01-02 00:00:00'), (1, 'c', NULL), (NULL, 'd', NULL), (NULL, 'd', NULL) AS t(id, v, at)")
    assert sorted((str(r.id), r.v) for r in once(df, ["id"], "at").collect()) == [("1", "b"), ("None", "d")]


def test_helpers(spark, tmp_path):
    files = {"/x/a.xml": "<?xml version='1.0'?><w>in</w>"}
    assert loaders.resolve_includes('<d><xi:include href="a.xml"/></d>', "/x", files.__getitem__) == "<d><w>in</w></d>"
    loaders.register_converter("upper", str.upper)
    (tmp_path / "a.txt").write_text("some text")
    got = loaders.load(spark, str(tmp_path), "txt", converter="upper")
    assert [r.word for r in got.tokens().orderBy("pos").collect()] == ["SOME", "TEXT"]
    docs = spark.createDataFrame([(1, "k1", "x"), (2, None, "y")], "doc_id int, link string, title string")
    other = spark.createDataFrame([("k1", "T", 5), ("k1", "T", 5)], "k string, title string, n int")
    rows = {r.doc_id: (r.title, r.linked_title, r.n) for r in loaders.link_metadata(docs, other, "link", "k").collect()}
    assert rows == {1: ("x", "T", 5), 2: ("y", None, None)}
    for name, form in BUNDLED.items():  # no format chokes on an empty document of its kind
        body = f"<{form.document.lstrip('/.') or 'doc'}/>" if form.file_type in ("xml", "metadata") else ""
        assert all(len(d.tokens) == 0 for d in parsers.parse(body, form)), name


def test_spans_helpers(spark):
    a = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (1, 5, 6)], "doc_id bigint, start_pos int, end_pos int")
    assert {(r.start_pos, r.hits) for r in sp.same_span(a).collect()} == {(0, 2), (5, 1)}
    assert [len(r.hits) for r in sp.bucketed(a).collect()] == [3]
    assert at(sp.in_order(a)) == [(1, 0), (1, 0), (1, 5)]


def test_large_samples_are_taken_by_threshold(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("start_pos"), F.lit(1).alias("end_pos"))
    small = [rs.sample(df, n, seed=3).collect() for n in (0, 1, 700, 5000, 9000)]
    monkeypatch.setattr(rs, "SMALL_SAMPLE", -1)
    assert [rs.sample(df, n, seed=3).collect() for n in (0, 1, 700, 5000, 9000)] == small
    assert [len(x) for x in small] == [0, 1, 700, 5000, 5000]


def test_frequent_values_say_whether_there_are_more(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate("aaabbcd")], "doc_id int, f string")
    assert [(r.value, r.docs, r.truncated) for r in rs.field_values(docs, "f", 2).orderBy("value").collect()] == [("a", 3, True), ("b", 2, True)]
    assert {r.truncated for r in rs.field_values(docs, "f", 4).collect()} == {False} and rs.field_values(docs, "f").count() == 4


def test_relation_statistics_say_whether_there_are_more(spark):
    rows = [("dep", "det", {"d": [str(i % 5)]}) for i in range(12)] + [("dep", "amod", {"d": ["1"]})]
    df = spark.createDataFrame(rows, "rel_class string, rel_type string, attrs map<string,array<string>>")
    got = {(r.rel_type, r.value): (r.n, r.truncated) for r in rl.statistics(df, 2).where("attribute IS NOT NULL").collect()}
    assert got == {("det", "0"): (3, True), ("det", "1"): (3, True), ("amod", "1"): (1, False)}
    assert rl.statistics(df).where("attribute = 'd'").count() == 6
