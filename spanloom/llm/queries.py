"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import canonical, frequency, mixture, quality, relevance, together, tokenizer
from spanloom.session import cut
from spanloom.tables import single, table

P2_FIELDS = {"match.word": ("match.word", "word"), "left.punct": ("left.punct", "punct")}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = canonical.disguised(table(spark, sf_dir, "hits"), "hit_id", P2_FIELDS, table(spark, sf_dir, "canonical_forms"))
    return found.select("hit_id", "field_name", "item_no")


#: Wherever the words and separators of the corpus occur: name in the result to (table, expression of array<string>, kind).
P2_PLACES = {f"{side}.{kind}": ("hits", f"{side}.{kind}", kind) for side in ("left", "match", "right") for kind in ("word", "punct")} | {
    "tokens.word": ("tokens", "array(word)", "word"),
    "tokens.word_all": ("tokens", "word_all", "word"),
    "tokens.punct": ("tokens", "array(punct)", "punct"),
}


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value of each place with its one form: the accepted form of the same look, or else the form that equal looks share."""
    forms = table(spark, sf_dir, "canonical_forms")
    by_kind = canonical.accepted_forms(forms)
    parts = []
    for kind in ("word", "punct"):
        accepted = by_kind.get(kind, [])
        own = forms.where(F.col("kind") == kind).select(F.col("form").alias("accepted")).where("accepted IS NOT NULL").distinct()
        looks = canonical.unify(own, "accepted", "look", accepted)
        places = [table(spark, sf_dir, t).select(F.lit(name).alias("field_name"), F.explode(F.expr(e)).alias("value")) for name, (t, e, k) in P2_PLACES.items() if k == kind]
        values = reduce(DataFrame.unionByName, places).where("value IS NOT NULL").distinct()
        one = canonical.unify(values, "value", "look", accepted).join(F.broadcast(looks), "look", "left")
        parts.append(one.select("field_name", "value", F.coalesce("accepted", "look").alias("form")))
    return parts[0].unionByName(parts[1])


P3_FIELDS = {f"match.{x}": f"match.{x}" for x in ("word", "lemma", "pos")}


def _p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, n = frequency.value_counts(table(spark, sf_dir, "hits"), "hit_id", P3_FIELDS)
    return frequency.marked(counts.where(F.col("term") != ""), n)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p3(spark, sf_dir)


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the terms of both kinds of record, two collections that are scored in one go."""
    responses = single(table(spark, sf_dir, "colloc").select("colloc_id", "tokenfrequencies"), "colloc_id")
    responses = responses.select(F.lit("tokenfrequencies").alias("collection"), F.col("colloc_id").cast("string").alias("record"), F.explode("tokenfrequencies").alias("term", "tf"))
    hits = single(table(spark, sf_dir, "hits").select("hit_id", "docpid", F.col("match.lemma").alias("l")), "hit_id")
    hits = hits.select(F.lit("match.lemma").alias("collection"), F.col("docpid").alias("record"), F.explode("l").alias("term"), F.lit(1).alias("tf"))
    return relevance.score_terms(responses.unionByName(hits).where(F.col("term") != ""))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relevance.distinctive(_p4(spark, sf_dir), 6, 2, 4)
    return found.select(F.col("collection").alias("field_name"), F.col("record").alias("record_key"), "term")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _p4(spark, sf_dir)
    return scored.select(F.col("collection").alias("field_name"), F.col("record").alias("record_key"), "term", "tf", "df", "length", F.round("score", 6).alias("score"))


def _p5(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return together.associations(table(spark, sf_dir, "hits"), "hit_id", "concat(left.word, match.word, right.word)", least=10, per_thousand=1)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, n = _p5(spark, sf_dir)
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    strong = F.lit(n).cast("decimal(18,0)") * exact("n_ab") >= F.lit(6).cast("decimal(1,0)") * (exact("n_a") * exact("n_b"))
    return pairs.where(strong).select(F.col("item_a").alias("word_a"), F.col("item_b").alias("word_b"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = _p5(spark, sf_dir)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair, however rare; p5_pairs has those that reach the bar of p5_found."""
    words = "concat({})".format(", ".join(f"coalesce({side}.word, array())" for side in ("left", "match", "right")))
    pairs, _ = together.associations(table(spark, sf_dir, "hits"), "hit_id", words, least=1, per_thousand=0)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p5_document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas in the same document. The largest documents are huge baskets, and few items are sent, so that they are joined."""
    words = cut(table(spark, sf_dir, "tokens").groupBy("doc_id").agg(F.collect_set("lemma").alias("lemmas")))
    pairs, _ = together.associations(words, "doc_id", "lemmas", least=10, per_thousand=5, most_sent=1000)
    return pairs.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its source's name appended, encoded by going on from the text's own table."""
    return tokenizer.encode_edited(table(spark, sf_dir, "documents"), "doc_id", "text", "length(text)", "0", "concat(' -- ', coalesce(source, 'no source'))")


def p6_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with five characters of its middle replaced, of which only what is near is encoded again."""
    return tokenizer.encode_edited(table(spark, sf_dir, "documents"), "doc_id", "text", "length(text) div 2", "5", "'an edit '")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixed.report.where("is_short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).report


def p7_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source, language and topic was to get, what the fit gives it and what the draw gave it, in tokens."""
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).margins


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).documents


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = quality.fit(documents, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "common_words"))
    return quality.statistics(documents, "doc_id", "text", profiles)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir).where("kind <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir)


_HITS = """WITH h AS (SELECT DISTINCT ON (hit_id) * FROM hits)"""
_P3 = (
    _HITS
    + """, v AS (
  SELECT hit_id, 'match.word' AS field_name, unnest("match".word) AS term FROM h
  UNION ALL SELECT hit_id, 'match.lemma', unnest("match".lemma) FROM h
  UNION ALL SELECT hit_id, 'match.pos', unnest("match".pos) FROM h
), c AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT hit_id) AS records FROM v WHERE term <> '' GROUP BY ALL
), m AS (
  SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records * 50 > (SELECT count(*) FROM h) THEN 'common' END AS mark FROM c
) """
)
_P4 = (
    _HITS
    + """, q AS (
  SELECT 'tokenfrequencies' AS field_name, CAST(colloc_id AS VARCHAR) AS record_key, unnest(map_keys(tokenfrequencies)) AS term, unnest(map_values(tokenfrequencies)) AS n
  FROM (SELECT DISTINCT ON (colloc_id) * FROM colloc)
  UNION ALL SELECT 'match.lemma', docpid, unnest("match".lemma), 1 FROM h
), tf AS (
  SELECT field_name, record_key, term, CAST(sum(n) AS BIGINT) AS tf FROM q WHERE term <> '' AND record_key IS NOT NULL AND n > 0 GROUP BY ALL
), x AS (
  SELECT *, count(*) OVER (PARTITION BY field_name, term) AS df, CAST(sum(tf) OVER (PARTITION BY field_name, record_key) AS BIGINT) AS length FROM tf
) """
)
_P5 = (
    _HITS
    + """, b AS (
  SELECT DISTINCT hit_id, unnest(list_concat(list_concat("left".word, "match".word), "right".word)) AS w FROM h
), n AS (SELECT count(*) AS n FROM h), f AS (
  SELECT w, count(*) AS c FROM b WHERE w IS NOT NULL GROUP BY w HAVING count(*) >= 10 AND 1000 * count(*) >= (SELECT n FROM n)
), k AS (SELECT hit_id, w, c FROM b JOIN f USING (w)), p AS (
  SELECT x.w AS item_a, y.w AS item_b, count(*) AS n_ab, any_value(x.c) AS n_a, any_value(y.c) AS n_b
  FROM k x JOIN k y ON x.hit_id = y.hit_id AND x.w < y.w GROUP BY ALL HAVING count(*) >= 10 AND 1000 * count(*) >= (SELECT n FROM n)
) """
)
_P5_ALL = (
    _HITS
    + """, b AS (
  SELECT DISTINCT hit_id, unnest(list_concat(list_concat("left".word, "match".word), "right".word)) AS w FROM h
), n AS (SELECT count(*) AS n FROM h), f AS (SELECT w, count(*) AS c FROM b WHERE w IS NOT NULL GROUP BY w), k AS (SELECT hit_id, w, c FROM b JOIN f USING (w)), p AS (
  SELECT x.w AS item_a, y.w AS item_b, count(*) AS n_ab, any_value(x.c) AS n_a, any_value(y.c) AS n_b FROM k x JOIN k y ON x.hit_id = y.hit_id AND x.w < y.w GROUP BY ALL
) """
)
_P5_DOCUMENTS = """WITH b AS (SELECT DISTINCT doc_id, lemma AS w FROM tokens WHERE lemma IS NOT NULL), n AS (SELECT count(DISTINCT doc_id) AS n FROM tokens), f AS (
  SELECT w, count(*) AS c FROM b GROUP BY w HAVING count(*) >= 10 AND 1000 * count(*) >= 5 * (SELECT n FROM n)
), k AS (SELECT doc_id, w, c FROM b JOIN f USING (w)), p AS (
  SELECT x.w AS item_a, y.w AS item_b, count(*) AS n_ab, any_value(x.c) AS n_a, any_value(y.c) AS n_b FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.w < y.w
  GROUP BY ALL HAVING count(*) >= 10 AND 1000 * count(*) >= 5 * (SELECT n FROM n)
) """

QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_frequencies": p3_frequencies,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p5_all_pairs": p5_all_pairs,
    "p5_document_pairs": p5_document_pairs,
    "p6_ids": p6_ids,
    "p6_appended": p6_appended,
    "p6_edited": p6_edited,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_margins": p7_margins,
    "p7_mixture": p7_mixture,
    "p8_found": p8_found,
    "p8_statistics": p8_statistics,
}
SQL: dict[str, str] = {
    "p3_found": _P3 + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p3_frequencies": _P3 + "SELECT field_name, term, occurrences, records, mark FROM m",
    "p4_found": _P4 + "SELECT field_name, record_key, term FROM x WHERE tf >= 6 AND df BETWEEN 2 AND 4",
    "p4_scores": _P4
    + """, a AS (SELECT field_name, count(*) AS n, avg(length) AS al FROM (SELECT DISTINCT field_name, record_key, length FROM x) GROUP BY ALL)
SELECT field_name, record_key, term, tf, df, length,
  round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al)), 6) AS score FROM x JOIN a USING (field_name)""",
    "p5_found": _P5 + "SELECT item_a AS word_a, item_b AS word_b FROM p, n WHERE n * n_ab >= 6 * n_a * n_b",
    "p5_pairs": _P5 + "SELECT item_a, item_b, n_ab, n_a, n_b, round(n * n_ab / (n_a * n_b), 6) AS lift FROM p, n",
    "p5_document_pairs": _P5_DOCUMENTS + "SELECT item_a, item_b, n_ab, n_a, n_b, round(n * n_ab / (n_a * n_b), 6) AS lift FROM p, n",
    "p5_all_pairs": _P5_ALL + "SELECT item_a, item_b, n_ab, n_a, n_b, round(n * n_ab / (n_a * n_b), 6) AS lift FROM p, n",
}
