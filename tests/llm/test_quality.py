"""Text statistics and the verdict."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import features, quality

NOUNS = "apple bread chair dinner engine forest garden harbour island kitchen lamp market needle orchard paper river school table village window".split()
DUTCH = "appel brood stoel avond motor bos tuin haven eiland keuken lamp markt naald papier rivier school tafel dorp venster".split()
COMMON = [("en", w, i + 1) for i, w in enumerate("the of and to in was that it she he had with a".split())] + [("nl", w, i + 1) for i, w in enumerate("de het een en van in was dat zij hij had met".split())]


def prose(r, lang="en"):
    if lang == "nl":
        one = lambda: f"{r.choice(['hij', 'zij'])} had de {r.choice(DUTCH)} van het {r.choice(DUTCH)} met een {r.choice(DUTCH)} in de {r.choice(DUTCH)}"
    else:
        one = lambda: f"{r.choice(['he', 'she', 'it'])} {r.choice(['was', 'had'])} {r.choice(['with', 'in', 'of'])} the {r.choice(NOUNS)} and to a {r.choice(NOUNS)} that was {r.choice(NOUNS)}"
    return " ".join(one().capitalize() + r.choice([".", ".", "?", ", and so on."]) for _ in range(r.randint(4, 12)))


def listed(r):
    mark = r.choice(["- ", "* ", "1. "])
    return "Contents\n" + "\n".join(mark + r.choice(NOUNS) for _ in range(r.randint(8, 30)))


def tabled(r):
    sep = r.choice(["\t", ",", " | "])
    return "\n".join(sep.join([r.choice(NOUNS), str(r.randint(1, 900)), f"{r.random():.3f}", "NN"]) for _ in range(r.randint(8, 30)))


def junk(r):
    return "".join(r.choice("xx%&/(§ ~~|{}[ ]±¬¦ 0_+*#@ <>;:^ ") for _ in range(400))


def labelled(seed, n=30):
    r = random.Random(seed)
    rows = [("prose", prose(r, r.choice(["en", "nl"]))) for _ in range(3 * n)]
    return rows + [(k, f(r)) for k, f in (("list", listed), ("table", tabled), ("junk", junk)) for _ in range(n)]


@pytest.fixture(scope="module")
def profiles(spark):
    rows = labelled(1)
    docs = spark.createDataFrame([(i, t, "x") for i, (_, t) in enumerate(rows)] + [(900, None, "x"), (901, " \n", "x")], "doc_id bigint, text string, kind string")
    labels = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)] + [(0, "prose"), (None, "list"), (9999, "table"), (1, None), (900, "junk"), (901, "junk")], "doc_id bigint, kind string")
    common = spark.createDataFrame(COMMON + [("en", None, 1), (None, "the", 1), ("en", "w" * 100, None)], "lang string, word string, word_rank int")
    return quality.fit(docs, labels, common)


def test_verdicts_on_texts_not_fitted_on(spark, profiles):
    rows = labelled(2)
    df = spark.createDataFrame([(i, t, "clash") for i, (_, t) in enumerate(rows)], "doc_id bigint, text string, kind string")
    got = {r.doc_id: r for r in quality.statistics(df, "doc_id", "text", profiles).collect()}
    right = sum(got[i].kind == k for i, (k, _) in enumerate(rows))
    assert right >= 0.98 * len(rows)
    assert {got[i].language for i, (k, t) in enumerate(rows) if k == "prose" and " het " in t} == {"nl"}
    assert {got[i].language for i, (k, t) in enumerate(rows) if k == "prose" and " the " in t} == {"en"}


def test_profiles_are_of_languages_and_of_several_texts(profiles):
    assert profiles.common.languages == ("en", "nl") and (profiles.languages.sum(1) > 0.99).all()
    assert {"prose", "list", "table", "junk"} == set(profiles.kinds)
    rows = labelled(1)
    f = features.features(pa.array([t for _, t in rows]), profiles.common)
    x = quality.stacked(quality._side_by_side(f), f.function, quality.read_in(f.function, profiles.languages))
    same = [np.abs(x - p).max(1).min() for p in profiles.points]
    assert min(same) > 1e-4  # no profile is a copy of one text


def test_statistics(spark, profiles):
    df = spark.createDataFrame([(1, "The cat. It was\nin of\n\n1,2!"), (2, None), (3, ""), (4, " \n\t "), (5, "word " * 50_000), (None, "…"), (6, "w" * 100 + " " + "v" * 100_000)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in quality.statistics(df, "doc_id", "text", profiles).collect()}
    r = rows[1]
    assert (r.n_words, r.n_lines) == (8, 3) and r.mean_word_length == pytest.approx(17 / 8) and r.common_share == pytest.approx(5 / 8)
    assert r.symbol_ratio == pytest.approx(3 / 20) and r.punctuated_lines == pytest.approx(1 / 3)
    for i in (2, 3, 4):
        assert rows[i].n_words == 0 and rows[i].kind is None and rows[i].divergence is None and rows[i].language is None
    assert rows[5].n_words == 50_000 and rows[6].common_share == pytest.approx(0.5)  # long words are told apart like others
    assert quality.statistics(df.limit(0), "doc_id", "text", profiles).count() == 0


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, kind string")
    common = spark.createDataFrame([], "lang string, word string, word_rank int")
    p = quality.fit(docs, labels, common)
    one = spark.createDataFrame([(1, "a\tb\n1\t2\n")], "doc_id bigint, text string")
    row = quality.statistics(one, "doc_id", "text", p).first()
    assert p.kinds == () and row.kind is None and row.n_words == 4


def test_far_from_all_prose_is_not_prose(spark):
    r = random.Random(5)
    texts = [prose(r) for _ in range(40)]
    common = features.CommonWords.of(COMMON)
    f = features.features(pa.array(texts), common)
    p = quality.fitted(np.array(["prose"] * 40), quality._side_by_side(f), f.function, common)
    df = spark.createDataFrame([(1, prose(r)), (2, junk(r)), (3, tabled(r))], "doc_id bigint, text string")
    assert {x.doc_id: x.kind for x in quality.statistics(df, "doc_id", "text", p).collect()} == {1: "prose", 2: quality.OTHER, 3: quality.OTHER}


def test_sample_is_bounded_and_of_all_scripts(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED_PER_KIND", 100)
    texts = [f"A house {i}" for i in range(200)] + [f"Дом {i}" for i in range(40)] + [f"家 {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "prose") for i in range(len(texts))], "doc_id bigint, kind string")
    kinds, shares, function = quality._sample(docs, labels, features.CommonWords.of(COMMON))
    assert len(kinds) == 100 and function.shape == (100, 2, features.N_BANDS)
    for name in ("cyrillic", "han"):
        share = (shares[:, features.FINE[name]] > 0).mean()
        assert share == pytest.approx(40 / 280, abs=0.1)


def test_words_of_unspaced_scripts():
    common = features.CommonWords.of([("ja", "の", 1), ("ja", "は", 2)])
    f = features.features(pa.array(["村の市場はホテル"]), common)
    assert f.counts["n_words"][0] == 5 and f.function[0, 0, 0] == pytest.approx(1 / 5) and f.function[0, 0, 1] == pytest.approx(1 / 5)


def test_slices_make_no_difference(monkeypatch):
    common = features.CommonWords.of(COMMON)
    texts = pa.array([t for _, t in labelled(3, 5)] + [None, ""], pa.string())
    whole = features.features(texts, common)
    monkeypatch.setattr(features, "SLICE", 300)
    parts = features.features(texts, common)
    for k in whole.shares:
        assert abs(whole.shares[k] - parts.shares[k]).max() < 1e-6
    assert abs(whole.function - parts.function).max() < 1e-6
