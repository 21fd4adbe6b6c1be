"""Patterns on a small corpus of three documents, with the hits they must have."""

import pytest

from spanloom.operators import spans as sp
from spanloom.plans.compiler import CompileError, Tables, run
from spanloom.plans.parser import PatternError, parse

TEXTS = [
    ("Our/our/det old/old/adj cat/cat/noun sleeps/sleep/verb near/near/prep the/the/det warm/warm/adj stove/stove/noun", [("para", 0, 8, {"no": "1"}), ("np", 0, 3, {}), ("np", 5, 8, {})]),
    ("left right left left right stop stop", []),
    ("Rain/rain/noun fell/fall/verb on/on/prep The/the/det quiet/quiet/adj garden/garden/noun and/and/conj rain/rain/noun fell/fall/verb again/again/adv", [("para", 0, 6, {"no": "2"}), ("para", 6, 10, {}), ("np", 3, 6, {})]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    tokens, spans = [], []
    for d, (text, tags) in enumerate(TEXTS):
        for p, t in enumerate(text.split()):
            word, lemma, pos = (t.split("/") + [t.split("/")[0], None])[:3] if "/" in t else (t, t, None)
            tokens.append((d, p, word, ["Our", "ONE", "Two"] if (d, p) == (0, 0) else None, lemma, pos))
        spans += [(d, tag, s, e, a) for tag, s, e, a in tags]
    t = spark.createDataFrame(tokens, "doc_id bigint, pos int, word string, word_all array<string>, lemma string, a_pos string").cache()
    s = spark.createDataFrame(spans, "doc_id bigint, tag string, start_pos int, end_pos int, attrs map<string,string>").cache()
    return Tables(t, s)


def words():
    return [[t.split("/")[0] for t in text.split()] for text, _ in TEXTS]


def texts(df):
    w = words()
    return sorted((r.doc_id, r.start_pos, " ".join(w[r.doc_id][r.start_pos : r.end_pos])) for r in df.collect())


def only(df):
    return [t for _, _, t in texts(df)]


CASES = {
    "'the'": ["the", "The"],
    "'(?-i)the'": ["the"],
    "'one'": ["Our"],
    "[pos='adj'] [pos='noun']": ["old cat", "warm stove", "quiet garden"],
    "[word != 'left' & lemma='right']": ["right", "right"],
    "'rain' | [lemma='fall']": ["Rain", "fell", "rain", "fell"],
    "[pos='noun']{1,}": ["cat", "stove", "Rain", "garden", "rain"],
    "'left'{2}": ["left left"],
    "'left'+": ["left", "left", "left", "left left"],
    "('left' 'right'?){2,}": ["left right left", "left right left left", "left right left left right", "left left", "left left right"],
    "[]{2,2} & 'stove'": [],
    "'w.*' within <np/>": ["warm"],
    "<np/> containing 'w.*'": ["the warm stove"],
    "'the' 'warm'? []": ["the warm", "the warm stove", "The quiet"],
    "'rain' []{0,1} 'fell'": ["Rain fell", "rain fell"],
    "<para> []": ["Our", "Rain", "and"],
    "[] </para>": ["stove", "garden", "again"],
    "<para no='2'/>": ["Rain fell on The quiet garden"],
    "<para no=in[1,1]> []* 'cat' []* </para>": ["Our old cat sleeps near the warm stove"],
    "a:[] [] b:[] :: a.word = b.word": ["left right left"],
    "a:[pos='adj'] b:[] :: start(b) >= end(a) & b.lemma > 'd'": ["warm stove", "quiet garden"],
    "(c:'left')? a:[] 'right' b:[] :: c -> (a.word = b.word)": ["left right left", "left right stop"],
    "!'left' & 'stop'": ["stop", "stop"],
    "'the' overlap <np/>": ["the", "The"],
    "l\"the\" 'quiet'": ["The quiet"],
}


@pytest.mark.parametrize("pattern", list(CASES))
def test_hits(corpus, pattern):
    assert sorted(only(run(pattern, corpus))) == sorted(CASES[pattern])


def test_counts(corpus):
    assert run("[] []", corpus).count() == 7 + 6 + 9
    assert run("[]{1,3}", corpus).count() == 25 + 22 + 19
    assert run("'on|near'? [pos='noun']?", corpus).count() == 7


def test_captures_tell_hits_apart(corpus):
    rows = run("(A:'left' 'right' []|'left' 'right' A:[])", corpus).collect()
    assert sorted((r.start_pos, r.c_A.start) for r in rows) == [(0, 0), (0, 2), (3, 3), (3, 5)]


def test_many_optional_parts(corpus):
    """Twelve optional parts, and none that must be there."""
    assert sorted(only(run("'our'? 'x'? 'old'? 'x'? 'x'? 'cat'? 'x'? 'x'? 'x'? 'x'? 'x'? 'sleeps'", corpus))) == ["Our old cat sleeps", "cat sleeps", "old cat sleeps", "sleeps"]
    assert sorted(only(run("'rain'? 'x'? 'fell'? 'x'? 'again'? 'x'?", corpus))) == ["Rain", "Rain fell", "again", "fell", "fell", "fell again", "rain", "rain fell", "rain fell again"]
    rows = run("'near' a:'the'? b:'x'? c:'warm'? d:'x'? e:'stove'?", corpus).collect()
    assert sorted((r.end_pos, r.c_a is not None, r.c_b is not None, r.c_c is not None, r.c_e is not None) for r in rows) == [(5, False, False, False, False), (6, True, False, False, False), (7, True, False, True, False), (8, True, False, True, True)]


def test_errors(corpus):
    for bad in ("'a", "[word=]", "</s/>", "'a' -> 'b'", "'a'{3,2}", ""):
        with pytest.raises(PatternError):
            parse(bad)
    with pytest.raises(CompileError):
        run("[nothing='x']", corpus)
    with pytest.raises(CompileError):
        run("nofunction('x')", corpus)


def _spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, start_pos int, end_pos int")


def _rows(df):
    return sorted((r.doc_id, r.start_pos, r.end_pos) for r in df.collect())


def test_repetition_of_spans(spark):
    a = _spans(spark, [(7, p, p + 1) for p in (4, 5, 6, 9, 12, 13)])
    want = [(7, 4, 6), (7, 4, 7), (7, 5, 7), (7, 12, 14)]
    assert _rows(sp.runs(a, 2, 3)) == want
    assert _rows(sp.repeat(a, 2, 3)) == want
    assert _rows(sp.repeat(a, 2, 1 << 30)) == want


def test_long_repetitions_end(spark):
    a = _spans(spark, [(1, p, p + 1) for p in range(40)] + [(1, 50, 50)])  # one without tokens, which could go on for ever
    named = sp.capture(a, "x")
    got = sp.repeat(named, 1, 1 << 30)
    assert got.count() == 40 * 41 // 2 + 1 and got.where("start_pos = 0 AND end_pos = 40").first().c_x.start == 39


def test_runs_over_block_edges(spark):
    edge = sp.BLOCK * 64
    a = _spans(spark, [(1, p, p + 1) for p in range(edge - 2, edge + 2)] + [(1, edge * 3, edge * 3 + 1)])
    assert _rows(sp.runs(a, 3, 4)) == [(1, edge - 2, edge + 1), (1, edge - 2, edge + 2), (1, edge - 1, edge + 2)]


def test_containing(spark):
    a = _spans(spark, [(1, 0, 9), (1, 20, 30), (2, 5, 6), (2, 5, 12), (3, 1, 4)])
    b = _spans(spark, [(1, 22, 24), (2, 6, 11), (3, 1, 4), (4, 0, 1)])
    assert _rows(sp.filtered(a, b, "containing")) == [(1, 20, 30), (2, 5, 12), (3, 1, 4)]
    assert _rows(sp.filtered(a, b, "containing", invert=True)) == [(1, 0, 9), (2, 5, 6)]


OPERATIONS = {
    "containing": lambda a, f: f[0] >= a[0] and f[1] <= a[1],
    "within": lambda a, f: f[0] <= a[0] and f[1] >= a[1],
    "containing_at_start": lambda a, f: f[0] == a[0] and f[1] <= a[1],
    "containing_at_end": lambda a, f: f[0] >= a[0] and f[1] == a[1],
    "starts_at": lambda a, f: f[0] == a[0],
    "ends_at": lambda a, f: f[1] == a[1],
    "matches": lambda a, f: f == a,
}


def test_interval_operations_against_brute_force(spark):
    import random

    r = random.Random(4)
    make = lambda k: sorted({(r.randint(0, 1), s, s + r.choice([0, 1, 3, 900, 3000])) for s in (r.randint(0, 5000) for _ in range(k))})
    a, b = make(150), make(60)
    da, db = _spans(spark, a), _spans(spark, b)
    for op, test in OPERATIONS.items():
        want = [x for x in a if any(x[0] == y[0] and test(x[1:], y[1:]) for y in b)]
        assert _rows(sp.filtered(da, db, op)) == want, op
        assert _rows(sp.filtered(da, db, op, invert=True)) == [x for x in a if x not in want], op
    want = sorted({(x[0], max(x[1], y[1]), min(x[2], y[2])) for x in a for y in b if x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]})
    assert _rows(sp.overlapping(da, db)) == want
    want = sorted({(x[0], x[1], y[2]) for x in a for y in b if x[0] == y[0] and 5 <= y[1] - x[2] <= 700})
    assert _rows(sp.with_gap(da, db, 5, 700)) == want
