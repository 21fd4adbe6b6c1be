"""Parsing, rewriting and serialising of patterns; filter language; contextual queries; text helpers."""

import random
import re

import pytest

from spanloom.functions import text as tx
from spanloom.plans import contextql, docfilter, nodes as n
from spanloom.plans.parser import fill_template, parse, template_values
from spanloom.plans.rewrite import normalise
from spanloom.plans.serialise import from_json, to_json, to_text

PATTERNS = [
    "'the'", "[pos='adj'] [pos='noun']", "('left' [word!='right']{1,3}){2,}", "'b.*' within <entity/>", "a:[] 'left' :: a.word = 'x'", "_ -nsubj-> 'x' ; !-obj-> _",
    "^-root-> 'is'", "'a' =word=>nl? _", "<s test='1'/> containing l\"a.b\"", "rspan('a' -dep-> _, 'all')", "@context=s 'a' 'b'", "'a' | ('b' & 'c')", "!'a'", "[]{2,5} 'x'", "'(?-i)The' overlap <s>",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_round_trips(pattern):
    tree = parse(pattern)
    assert from_json(to_json(tree)) == tree
    again = parse(to_text(tree))
    assert normalise(again) == normalise(tree)


REWRITES = {
    "'a' 'a'": "'a'{2}",
    "'a' 'a'+": "'a'{2,}",
    "('a'+)+": "'a'+",
    "('a'{2}){3}": "'a'{6}",
    "!!'a'": "'a'",
    "'a'{1,1}": "'a'",
    "<s> []* 'x' []* </s>": "<s/> containing 'x'",
    "'.*'": "[]",
}


@pytest.mark.parametrize("pattern", REWRITES)
def test_rewrites(pattern):
    assert normalise(parse(pattern)) == normalise(parse(REWRITES[pattern]))


def test_rewrites_avoid_arbitrary_tokens():
    a = normalise(parse("'a' []{2,3} 'b' []*"))
    assert isinstance(a, n.Expand) and isinstance(a.part, n.Gap) and (a.part.low, a.part.high) == (2, 3)
    assert isinstance(normalise(parse("[]{2,2} & 'stove'")), n.Nothing)
    assert isinstance(normalise(parse("[]{2,4} containing 'x'")), n.NGrams)
    assert len(normalise(parse("'a'? 'b'? 'c'?")).parts) == 7
    sizes = [len(to_json(normalise(parse("'x' " + " ".join(f"'w{i}'?" for i in range(k)))))) for k in (8, 16, 32)]
    assert sizes[2] < 5 * sizes[0]  # the tree grows with the parts, not with their combinations


def test_precedence_is_to_the_right():
    assert parse("'a' & 'b' | 'c'") == parse("'a' & ('b' | 'c')")
    assert parse("'a' within 'b' within 'c'") == parse("'a' within ('b' within 'c')")


def test_range_regex():
    r = random.Random(3)
    for _ in range(60):
        a = r.choice([0, 1, 7, 10, 99, r.randint(0, 3000)])
        b = a + r.choice([0, 1, 9, 90, r.randint(0, 5000)])
        p = re.compile(tx.range_regex(a, b))
        for x in {a, b, a - 1, b + 1, *(r.randint(0, 9000) for _ in range(40))}:
            assert bool(p.fullmatch(str(x))) == (a <= x <= b), (a, b, x)


def test_fold(spark):
    words = ["Café", "ÀÉÎ", "naïve", "Ἀθήνα", "éa", "so­ft", "ß", "", None]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.fold(tx.F.col("w")).alias("f"), tx.fold(tx.F.col("w"), "ci").alias("c"), tx.fold(tx.F.col("w"), "di").alias("d"))
    for row in df.collect():
        if row.w is None:
            assert row.f is None
            continue
        assert (row.f, row.c, row.d) == tuple(tx.fold_text(row.w, k) for k in ("i", "ci", "di"))
    assert tx.fold_text("Café") == "cafe" and tx.fold_regex("\\W[A-É]", "i") == "\\W[a-e]"


def test_filters(spark):
    docs = spark.createDataFrame([(0, "Star Wars", 1977, ["a", "b c"]), (1, "The Star", 2001, None), (2, None, None, ["wars"])], "doc_id int, title string, year int, tags array<string>")
    get = lambda t: sorted(r.doc_id for r in docfilter.filter_documents(docs, t).collect())
    assert get("title:star") == [0, 1]
    assert get('title:"star wars"') == [0]
    assert get("title:star AND year:[1970 TO 1980]") == [0]
    assert get("title:star -year:2001") == [0]
    assert get("tags:wars OR title:wars") == [0, 2]
    assert get("title:w*s") == [0] and get("title:?tar") == [0, 1] and get("title:stra~") == [0, 1]
    assert get("(title:the OR tags:b) AND NOT title:wars") == [1]
    assert get("year:{2001 TO 2001}") == [1]
    for bad in ("nofield:x", "(title:a", "", "year:x"):
        with pytest.raises(docfilter.FilterError):
            get(bad)


def test_contextual():
    q = contextql.parse_contextual('lemma="be" and metadata.title="star wars"')
    assert q.pattern == n.Is("lemma", n.Value("be", "literal")) and q.filter == 'title:"star wars"'
    assert contextql.parse_contextual('"a b"').pattern == n.Seq((n.Is(None, n.Value("a", "literal")), n.Is(None, n.Value("b", "literal"))))
    assert contextql.parse_contextual("metadata.year >= 1990").filter == "year:[1990 TO *]"
    for bad in ("a prox b", "a and/x b", "(a"):
        with pytest.raises(contextql.ContextError):
            contextql.parse_contextual(bad)


def test_templates():
    assert fill_template("'@@' '@@'", template_values("a\tx\nb\ty\n")) == "'a|b' 'x|y'"
