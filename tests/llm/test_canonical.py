"""One form for equal looks."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import canonical as cn
from spanloom.llm import codepoints as cp
from spanloom.llm import queries


@given(st.lists(st.one_of(st.none(), st.text(max_size=12), st.text("aeouAȨ̣́̈각가", max_size=8)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_composition_is_that_of_unicode(texts):
    pairs = {c: tuple(map(ord, unicodedata.normalize("NFD", chr(c)))) for t in texts if t for c in map(ord, t) if unicodedata.normalize("NFD", chr(c)) != chr(c)}
    cps, offs = cp.Replacements(pairs).apply(*cp.from_arrow(pa.array(texts, pa.string())))
    got = cp.to_arrow(*cp.compose(cp.order_marks(cps, offs), offs)).to_pylist()
    assert got == [unicodedata.normalize("NFC", t or "") for t in texts]


def test_arrow_slices_and_bytes():
    arr = pa.array(["aé", None, "", "漢😀"]).slice(1)
    cps, offs = cp.from_arrow(arr)
    assert offs.tolist() == [0, 0, 0, 2] and cp.to_arrow(cps, offs).to_pylist() == ["", "", "漢😀"]
    broken = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, 2], np.int64).tobytes()), pa.py_buffer(b"a\xff")])
    assert cp.to_arrow(*cp.from_arrow(broken)).to_pylist() == ["a�"]


@pytest.fixture(scope="module")
def tool(spark):
    return cn.Canonicaliser(cn.Spec.of(cn.confusable_classes(spark)))


EQUAL = [("café", "café"), ("the", "tһe"), ("the", "ｔｈｅ"), ("finish", "ﬁnish"), ("library", "libr\xada‍ry"), ("coffin", "ϲоffіn"), ("Kehosus", "Kеһօѕuѕ"), ("a b", "a b"), ("a b", "a　b"), (", ", "‚ "), ("? ", "？ "), (": ", "∶ "), ("! ", "ǃ "), ("; ", "; "), ("", "​﻿"), ("ij", "ĳ")]
DIFFERENT = [("the", "The"), ("the", "thě"), ("as", "ạs"), ("u", "ű"), ("ü", "ű"), ("o", "ȯ"), ("corn", "com"), ("l", "1"), ("книга", "knuga"), ("a  b", "a b"), ("ø", "o")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal_looks(tool, a, b):
    assert len(set(tool.forms(pa.array([a, b])).to_pylist())) == 1


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_looks(tool, a, b):
    assert len(set(tool.forms(pa.array([a, b])).to_pylist())) == 2


def test_without_icu_it_is_an_error(monkeypatch):
    class NoClass:
        def __getattr__(self, name):
            raise RuntimeError("no such class")

    monkeypatch.setattr(cn, "_classes", {})
    for session in (object(), type("S", (), {"_jvm": None})(), type("S", (), {"_jvm": NoClass()})()):
        with pytest.raises(RuntimeError):
            cn.confusable_classes(session)


def test_other_scripts_stay(tool):
    assert tool.forms(pa.array(["книга", "λόγος", "漢字", None, ""])).to_pylist() == ["книга", "λόγος", "漢字", None, ""]


def test_unify(spark):
    df = spark.createDataFrame([(1, "ｔhe" * 20_000, "x"), (1, None, "x"), (2, "", None)], "id int, text string, form_ string")
    rows = {(r.id, r.text): r.form for r in cn.unify(df, "text", "form").collect()}
    assert set(rows.values()) == {"the" * 20_000, None, ""}
    with pytest.raises(ValueError):
        cn.unify(df, "text", "form_")
    assert cn.unify(df.limit(0), "text", "form").count() == 0


def test_disguised(spark):
    hits = spark.createDataFrame([(1, ["the", "tһe", None, ""], [" ", " "]), (1, ["the", "tһe", None, ""], [" ", " "]), (None, ["ｏｆ"], None), (2, None, []), (3, ["tһě", "thee"], ["–", "‐"])], "hit_id bigint, w array<string>, p array<string>")
    forms = spark.createDataFrame([("the", "word"), ("of", "word"), (" ", "punct"), ("-", "punct"), ("–", "punct"), (None, "word")], "form string, kind string")
    found = cn.disguised(hits, "hit_id", {"w": ("w", "word"), "p": ("p", "punct")}, forms)
    got = sorted([(str(r.hit_id), r.field_name, r.item_no, r.form) for r in found.collect()])
    assert got == [("1", "p", 1, " "), ("1", "w", 1, "the"), ("3", "p", 1, "-"), ("None", "w", 0, "of")]
    assert cn.disguised(hits.limit(0), "hit_id", {"w": ("w", "word")}, forms).count() == 0
    assert cn.disguised(hits, "hit_id", {"w": ("w", "word")}, forms.limit(0)).count() == 0


def test_forms_wherever_tokens_occur(spark, tmp_path, monkeypatch):
    part = "struct<word: array<string>, punct: array<string>>"
    side = lambda w, p: ([w], [p])
    spark.createDataFrame([(1, side("dog", ","), side("dоg", " "), side("dog​", "，"))], f"hit_id bigint, left {part}, match {part}, right {part}").write.parquet(str(tmp_path / "hits.parquet"))
    spark.createDataFrame([(1, 0, "ｄog", ["dog", "dоg", None], "，"), (1, 1, None, None, None)], "doc_id bigint, pos int, word string, word_all array<string>, punct string").write.parquet(str(tmp_path / "tokens.parquet"))
    spark.createDataFrame([("dog", "word"), (",", "punct"), (" ", "punct")], "form string, kind string").write.parquet(str(tmp_path / "canonical_forms.parquet"))
    got = {}
    for r in queries.QUERIES["p2_forms"](spark, str(tmp_path)).collect():
        got.setdefault(r.field_name, set()).add(r.form)
    words = {f"{s}.word": {"dog"} for s in ("left", "match", "right", "tokens")} | {"tokens.word_all": {"dog"}}
    assert got == words | {"left.punct": {","}, "match.punct": {" "}, "right.punct": {","}, "tokens.punct": {","}}
    monkeypatch.setattr(cn, "MAX_FORMS", 2)
    with pytest.raises(ValueError):
        queries.QUERIES["p2_forms"](spark, str(tmp_path))
