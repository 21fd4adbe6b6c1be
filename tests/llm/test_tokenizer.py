"""Encoding against another implementation of the same vocabulary."""

import base64
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import tokenizer as tk

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    path = P.path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return tk.Encoder(tk.Vocabulary.load(path)), other


PIECES = [*"ab'srtvelmdLE  \n\t\r　\xa0 é中1２٣.,-!😀́\x1c\x1f\x85<|", "'re", "'ll", " 's", "don't", "   ", "aaaa", "<|endoftext|>"]


def test_random_texts(both):
    ours, theirs = both
    r = random.Random(7)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 3000, "é" * 2000 + " " * 400 + "x", "\n" * 999, "", None]
    ids, offs = ours.encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == [theirs.encode_ordinary(t or "") for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    path = P.path("byte_bpe_50k.tiktoken")
    e = tk.encoder(tk.Vocabulary.load(path))
    ids = e.encode(text)
    assert b"".join(e.tokens[i] for i in ids).decode() == text  # an exact round trip


def test_edits_encode_again_only_near_them(both):
    ours, theirs = both
    r = random.Random(8)
    for _ in range(200):
        s = "".join(r.choice(PIECES) for _ in range(60))
        t = tk.EditableText(ours)
        t.append(s)
        for _ in range(5):
            at = r.choice([len(s), r.randint(0, len(s))])
            n, new = r.randint(0, min(6, len(s) - at)), "".join(r.choice(PIECES) for _ in range(r.randint(0, 5)))
            t.replace(at, n, new)
            s = s[:at] + new + s[at + n :]
            assert t.ids() == theirs.encode_ordinary(s)
    long = tk.EditableText(ours)
    long.append("some words here " * 2000)
    before = long.encoded
    long.replace(7000, 4, "more")
    assert long.encoded - before < 20 and long.ids() == theirs.encode_ordinary("".join(long.pieces))


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (None, "a" * 100_000)], "doc_id bigint, text string").selectExpr("*", "1 AS ids")
    rows = tk.encode(df, "doc_id", "text").collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in rows)[:4] == [("1", 2), ("1", 2), ("2", 0), ("3", 0)] and len(rows) == 5
    counted = tk.count_tokens(df, "text", "n")
    assert sorted(r.n for r in counted.collect())[:4] == [0, 0, 2, 2]
    assert tk.encode(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        tk.count_tokens(df, "text", "ids")


def test_edited_texts_are_encoded_like_new_ones(spark):
    texts = ["", None, "Hello wörld, it's 1234 o'clock.\n\n  Next line", "漢字かな交じり文 and <|endoftext|> text", "a" * 3000, "x y " * 500]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    for at, remove, insert in (("length(text)", "0", "' -- more'"), ("length(text) div 2", "5", "'an edit '"), ("0", "1", "null"), ("-3", "99999", "'all'"), ("null", "null", "null")):
        got = {r.doc_id: r for r in tk.encode_edited(df, "doc_id", "text", at, remove, insert).collect()}
        edited = df.selectExpr("doc_id", f"coalesce(text, '') AS t", f"least(greatest(coalesce({at}, 0), 0), length(coalesce(text, ''))) AS a", f"greatest(coalesce({remove}, 0), 0) AS n", f"coalesce({insert}, '') AS i").collect()
        new = spark.createDataFrame([(r.doc_id, r.t[: r.a] + r.i + r.t[r.a + r.n :]) for r in edited], "doc_id bigint, text string")
        want = {r.doc_id: r.ids for r in tk.encode(new, "doc_id", "text").collect()}
        assert {k: r.ids for k, r in got.items()} == want
    near = {r.doc_id: r for r in tk.encode_edited(df, "doc_id", "text", "length(text) div 2", "5", "'an edit '").collect()}
    assert near[5].encoded_again < 30 < near[5].pieces  # what is far from the edit isn't encoded again
