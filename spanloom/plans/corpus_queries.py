"""Queries of the corpus operators over docs, tokens and spans, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import tables as tb
from spanloom.functions import process
from spanloom.operators import properties as pr
from spanloom.operators import relations as rl
from spanloom.operators import results as rs
from spanloom.operators import spans as sp
from spanloom.plans import docfilter, nodes as n
from spanloom.plans.compiler import Compiler, Tables, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Tables:
    annotations = {"word": "word", "lemma": "lemma", "pos": "a_pos", "punct": "punct"}
    return Tables(tb.tokens(spark, sf_dir), tb.table(spark, sf_dir, "spans"), None, annotations, stored=tb.table(spark, sf_dir, "tokens"))


def derived_relations(t: Tables, field: str = "contents", target: str = "contents") -> DataFrame:
    """Relations made from the tokens by rule: nouns to the adjective before (amod) and the determiner up to two before (det), and
    a root relation to each first token of a `u` span."""
    k = t.tokens.select("doc_id", "pos", "a_pos")
    noun = k.where("a_pos LIKE 'NN%'").select("doc_id", F.col("pos").alias("h"))

    def edge(test: str, kind: str, back: int, no: int) -> DataFrame:
        dep = k.where(test).select("doc_id", (F.col("pos") + back).alias("h"), F.col("pos").alias("d"))
        return noun.join(dep, ["doc_id", "h"]).select("doc_id", F.lit(kind).alias("rel_type"), "h", "d", (F.col("doc_id") * 10_000_000 + F.col("h") * 10 + no).alias("rel_id"))

    edges = edge("a_pos = 'JJ'", "amod", 1, 0).unionByName(edge("a_pos = 'DT'", "det", 1, 1)).unionByName(edge("a_pos = 'DT'", "det", 2, 2))
    first = t.spans.where("tag = 'u' AND end_pos > start_pos").select("doc_id", "start_pos").distinct()
    roots = first.select("doc_id", F.lit("root").alias("rel_type"), F.col("start_pos").alias("h"), F.col("start_pos").alias("d"), (F.col("doc_id") * 10_000_000 + F.col("start_pos") * 10 + 3).alias("rel_id"))
    both = edges.withColumn("is_root", F.lit(False)).unionByName(roots.withColumn("is_root", F.lit(True)))
    return both.select(
        "doc_id", F.lit(field).alias("field"), "rel_id", F.lit("dep").alias("rel_class"), "rel_type", F.create_map(F.lit("dist"), F.array((F.col("h") - F.col("d")).cast("string"))).alias("attrs"), "is_root",
        F.col("h").alias("src_start"), (F.col("h") + 1).alias("src_end"), F.lit(target).alias("tgt_field"), F.col("d").alias("tgt_start"), (F.col("d") + 1).alias("tgt_end"),
    )


_FOLD = "regexp_replace(lower(strip_accents({0})), '[' || chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || ']', '', 'g')"
_F = _FOLD.format
PRE = f"""WITH RECURSIVE T AS (
  SELECT DISTINCT ON (doc_id, pos) doc_id, pos, word, word_all, lemma, a_pos, punct, {_F('word')} AS w, {_F('lemma')} AS l, {_F('a_pos')} AS p,
    list_prepend({_F('word')}, coalesce(list_transform(word_all, lambda x: {_F('x')}), [])) AS ws FROM tokens
), L AS (SELECT doc_id, max(pos) + 1 AS length FROM T GROUP BY 1
), S AS (SELECT DISTINCT doc_id, tag, start_pos AS s, end_pos AS e, attrs FROM spans
), D AS (SELECT DISTINCT ON (doc_id) * FROM docs ORDER BY doc_id, indexed_at DESC NULLS LAST
)"""
_K = "doc_id, start_pos, end_pos"


def tok(name: str, condition: str) -> str:
    """A common table of one-token hits."""
    return f", {name} AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM T WHERE {condition})"


def is_word(x: str) -> str:
    return f"list_contains(ws, '{x}')"


def out(source: str) -> str:
    return f" SELECT DISTINCT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM {source}"


def hits_query(name: str, pattern: str | n.Node, sql: str) -> None:
    """Registers a pattern; the result is the distinct spans of its hits."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(pattern, corpus(spark, sf_dir)).select(*sp.KEYS).distinct()

    QUERIES[name], SQL[name] = query, sql


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# -- leaf queries ------------------------------------------------------------------------------------

hits_query("term", "'you'", PRE + tok("a", is_word("you")) + out("a"))
hits_query("term_sensitive", "'(?-i)The'", PRE + tok("a", "word = 'The' OR list_contains(word_all, 'The')") + out("a"))
hits_query("term_case_insensitive", n.Is(None, n.Value("The", "literal", sensitivity="ci")), PRE + tok("a", "lower(word) = 'the' OR list_contains(list_transform(word_all, lambda x: lower(x)), 'the')") + out("a"))
hits_query("term_diacritics_insensitive", n.Is(None, n.Value("cafe", "literal", sensitivity="di")), PRE + tok("a", "strip_accents(word) = 'cafe' OR list_contains(list_transform(word_all, lambda x: strip_accents(x)), 'cafe')") + out("a"))
_RE = "len(list_filter(ws, lambda x: regexp_full_match(x, '{0}'))) > 0"
hits_query("regex", "'(th|wh).+e'", PRE + tok("a", _RE.format("(th|wh).+e")) + out("a"))
hits_query("wildcard", n.Is(None, n.Value("*ing", "wildcard")), PRE + tok("a", _RE.format(".*ing")) + out("a"))
hits_query("prefix", "'re.*'", PRE + tok("a", "len(list_filter(ws, lambda x: starts_with(x, 're'))) > 0") + out("a"))
hits_query("fuzzy", n.Is("lemma", n.Value("table", "fuzzy", 0, 1)), PRE + tok("a", "levenshtein(l, 'table') <= 1") + out("a"))
hits_query("integer_range", "[word=in[1,30]]", PRE + tok("a", "len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+') AND NOT starts_with(x, '0') AND TRY_CAST(x AS BIGINT) BETWEEN 1 AND 30)) > 0") + out("a"))
hits_query("token_expression", "[word='the' | (pos='NN.*' & !(lemma='t.*'))]", PRE + tok("a", f"{is_word('the')} OR (coalesce(regexp_full_match(p, 'nn.*'), false) AND NOT coalesce(regexp_full_match(l, 't.*'), false))") + out("a"))
hits_query("not_equal_includes_missing", "[pos!='NN']", PRE + tok("a", "coalesce(p, '') <> 'nn'") + out("a"))
hits_query("any_ngrams", "[]{1,2}", PRE + ", a AS (SELECT T.doc_id, pos AS s, pos + k AS e FROM T JOIN L USING (doc_id), (VALUES (1), (2)) v(k) WHERE pos + k <= length)" + out("a"))
hits_query("fixed_span", n.Fixed(2, 6), PRE + ", a AS (SELECT doc_id, 2 AS s, 6 AS e FROM L WHERE length >= 6)" + out("a"))
hits_query("no_hits", n.Nothing(), "SELECT CAST(1 AS BIGINT) AS doc_id, CAST(1 AS INTEGER) AS start_pos, CAST(1 AS INTEGER) AS end_pos WHERE false")
hits_query("annotation_wrapper", n.OnAnnotation("lemma", n.Is(None, n.Value("be", "literal"))), PRE + tok("a", "l = 'be'") + out("a"))
hits_query("sensitivity_wrapper", n.Sensitive("s", n.Is("lemma", n.Value("be", "literal"))), PRE + tok("a", "lemma = 'be'") + out("a"))
hits_query("tags", "<entity kind='p.*'/>", PRE + f", a AS (SELECT doc_id, s, e FROM S WHERE tag = 'entity' AND regexp_full_match({_F('attrs[' + chr(39) + 'kind' + chr(39) + ']')}, 'p.*'))" + out("a"))
hits_query("tag_leading_edge", "<u>", PRE + ", a AS (SELECT doc_id, s, s AS e FROM S WHERE tag = 'u')" + out("a"))
hits_query("tag_trailing_edge", "</u>", PRE + ", a AS (SELECT doc_id, e AS s, e FROM S WHERE tag = 'u')" + out("a"))
hits_query("hit_edge", n.Edge(n.Repeat(n.Is("pos", n.Value("NN", "literal")), 2, 2), True), PRE + ", a AS (SELECT x.doc_id, y.pos + 1 AS s, y.pos + 1 AS e FROM T x JOIN T y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE x.p = 'nn' AND y.p = 'nn')" + out("a"))

hits_query("literal_string", 'l"kitchen"', PRE + tok("a", is_word("kitchen")) + out("a"))
hits_query("flags_without_effect", "'the' %cd", PRE + tok("a", is_word("the")) + out("a"))

# -- span algebra ------------------------------------------------------------------------------------

_AN = tok("a", "p = 'jj'") + tok("b", "p = 'nn'")
hits_query("sequence", "[pos='JJ'] [pos='NN']", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s)" + out("c"))
hits_query("sequence_of_three", "'the' [pos='JJ'] [pos='NN']", PRE + _AN + tok("th", is_word("the")) + ", c AS (SELECT a.doc_id, th.s, b.e FROM th JOIN a ON th.doc_id = a.doc_id AND th.e = a.s JOIN b ON a.doc_id = b.doc_id AND a.e = b.s)" + out("c"))
hits_query("and_same_span", "([pos='JJ'] []) & ([] [pos='NN'])", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s)" + out("c"))
hits_query("or_of_spans", "([pos='JJ'] [pos='NN']) | <entity/>", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s UNION SELECT doc_id, s, e FROM S WHERE tag = 'entity')" + out("c"))
hits_query("not_covered", "!([pos='JJ'] [pos='NN'])", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s), free AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM T WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = T.doc_id AND T.pos >= c.s AND T.pos < c.e))" + out("free"))


@query("and_not", PRE + _AN + ", c AS (SELECT doc_id, s, e FROM S WHERE tag = 'u' AND NOT EXISTS (SELECT 1 FROM S x WHERE x.tag = 'entity' AND x.doc_id = S.doc_id AND x.s = S.s AND x.e = S.e))" + out("c"))
def and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    return sp.but_not(run("<u/>", t), run("<entity/>", t)).select(*sp.KEYS).distinct()


hits_query("gap", "'the' []{1,3} 'of'", PRE + tok("a", is_word("the")) + tok("b", is_word("of")) + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e + 1 AND a.e + 3)" + out("c"))
hits_query("wide_gap", "'kitchen' []{5,200} 'letter'", PRE + tok("a", is_word("kitchen")) + tok("b", is_word("letter")) + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e + 5 AND a.e + 200)" + out("c"))
_RUNS = """, x AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM T WHERE p = 'nn'), y AS (SELECT doc_id, min(pos) AS a, max(pos) + 1 AS z FROM x GROUP BY doc_id, g),
 c AS (SELECT doc_id, i AS s, j AS e FROM y, unnest(range(a, z)) q(i), unnest(range(a + 1, z + 1)) r(j) WHERE j - i BETWEEN {0} AND {1})"""
hits_query("repetition", "[pos='NN']{2,3}", PRE + _RUNS.format(2, 3) + out("c"))
hits_query("repetition_unbounded", "[pos='NN']+", PRE + _RUNS.format(1, 1000000) + out("c"))
hits_query("repetition_of_sequences", "([pos='IN'] [pos='NN']){2,3}", PRE + tok("a", "p = 'in'") + tok("b", "p = 'nn'") + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s), two AS (SELECT x.doc_id, x.s, y.e FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.e = y.s), f AS (SELECT * FROM two UNION SELECT x.doc_id, x.s, y.e FROM two x JOIN c y ON x.doc_id = y.doc_id AND x.e = y.s)" + out("f"))

@query("repetition_to_closure", PRE + ", u AS (SELECT DISTINCT doc_id, s, e FROM S WHERE tag = 'entity'), c AS (SELECT doc_id, s, e, 1 AS k FROM u UNION SELECT c.doc_id, c.s, u.e, least(c.k + 1, 2) FROM c JOIN u ON c.doc_id = u.doc_id AND c.e = u.s)" + out("(SELECT * FROM c WHERE k = 2)"))
def repetition_to_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    return sp.repeat(run("<entity/>", t).select(*sp.KEYS).distinct(), 2, n.MANY)


hits_query("optional_parts", "'in' 'the'? [pos='JJ']? [pos='NN']", PRE + tok("i", is_word("in")) + tok("th", is_word("the")) + _AN + """, x AS (SELECT * FROM i UNION SELECT i.doc_id, i.s, th.e FROM i JOIN th ON i.doc_id = th.doc_id AND i.e = th.s),
 y AS (SELECT * FROM x UNION SELECT x.doc_id, x.s, a.e FROM x JOIN a ON x.doc_id = a.doc_id AND x.e = a.s), z AS (SELECT y.doc_id, y.s, b.e FROM y JOIN b ON y.doc_id = b.doc_id AND y.e = b.s)""" + out("z"))
_OPT = ["the", "a", "an", "this", "that", "very", "so", "more", "most", "my", "his", "her"]
hits_query("many_optional_parts", "'(in|of|to)' " + " ".join(f"'{w}'?" for w in _OPT) + " [pos='NN']", PRE + tok("i", _RE.format("in|of|to")) + ", x0 AS (SELECT * FROM i)" + "".join(f", o{k} AS (SELECT doc_id, pos FROM T WHERE {is_word(w)}), x{k + 1} AS (SELECT * FROM x{k} UNION SELECT x.doc_id, x.s, x.e + 1 FROM x{k} x JOIN o{k} o ON o.doc_id = x.doc_id AND o.pos = x.e)" for k, w in enumerate(_OPT)) + tok("b", "p = 'nn'") + f", z AS (SELECT x.doc_id, x.s, b.e FROM x{len(_OPT)} x JOIN b ON b.doc_id = x.doc_id AND b.s = x.e)" + out("z"))
hits_query("expansion_right", "'kitchen' []{1,2}", PRE + tok("a", is_word("kitchen")) + ", c AS (SELECT a.doc_id, a.s, a.e + k AS e FROM a JOIN L USING (doc_id), (VALUES (1), (2)) v(k) WHERE a.e + k <= length)" + out("c"))
hits_query("expansion_left", "[]{1,2} 'kitchen'", PRE + tok("a", is_word("kitchen")) + ", c AS (SELECT a.doc_id, a.s - k AS s, a.e FROM a, (VALUES (1), (2)) v(k) WHERE a.s >= k)" + out("c"))
_PLACES = {
    "containing": "f.s >= a.s AND f.e <= a.e",
    "containing_at_start": "f.s = a.s AND f.e <= a.e",
    "containing_at_end": "f.s >= a.s AND f.e = a.e",
    "within": "f.s <= a.s AND f.e >= a.e",
    "starts_at": "f.s = a.s",
    "ends_at": "f.e = a.e",
    "matches": "f.s = a.s AND f.e = a.e",
}
for _op, _test in _PLACES.items():
    _part, _by = (n.Tag("entity"), n.Tag("u")) if _op == "within" else (n.Tag("u"), n.Tag("entity"))
    for _inv in (False, True):
        _a, _f = _part.name, _by.name
        hits_query(f"filter_{_op}" + ("_inverted" if _inv else ""), n.Filter(_part, _by, _op, _inv), PRE + f", c AS (SELECT a.doc_id, a.s, a.e FROM S a WHERE a.tag = '{_a}' AND {'NOT ' if _inv else ''}EXISTS (SELECT 1 FROM S f WHERE f.tag = '{_f}' AND f.doc_id = a.doc_id AND {_test}))" + out("c"))
hits_query("within_span", "[pos='JJ'] [pos='NN'] within <entity/>", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s WHERE EXISTS (SELECT 1 FROM S WHERE tag = 'entity' AND S.doc_id = a.doc_id AND S.s <= a.s AND S.e >= b.e))" + out("c"))
hits_query("whole_span_containing", "<entity> []* [pos='JJ'] []* </entity>", PRE + _AN + ", c AS (SELECT S.doc_id, S.s, S.e FROM S WHERE tag = 'entity' AND EXISTS (SELECT 1 FROM a WHERE a.doc_id = S.doc_id AND a.s >= S.s AND a.e <= S.e))" + out("c"))
hits_query("filter_adjusted", n.Filter(n.Is(None, n.Value("the", "literal")), n.Tag("u"), "containing_at_start", False, 1, 0), PRE + tok("a", is_word("the")) + ", c AS (SELECT * FROM a WHERE EXISTS (SELECT 1 FROM S WHERE tag = 'u' AND S.doc_id = a.doc_id AND S.s = a.s + 1 AND S.e <= a.e))" + out("c"))
hits_query("overlap", "<u/> overlap <entity/>", PRE + ", c AS (SELECT a.doc_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM S a JOIN S b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e WHERE a.tag = 'u' AND b.tag = 'entity')" + out("c"))
hits_query("ngrams_containing", "[]{2,3} containing 'kitchen'", PRE + tok("a", is_word("kitchen")) + ", c AS (SELECT a.doc_id, a.s - i AS s, a.s - i + k AS e FROM a JOIN L USING (doc_id), (VALUES (2), (3)) v(k), (VALUES (0), (1), (2)) q(i) WHERE i < k AND a.s - i >= 0 AND a.s - i + k <= length)" + out("c"))
hits_query("ngrams_within", "[]{2,2} within <entity/>", PRE + ", c AS (SELECT S.doc_id, pos AS s, pos + 2 AS e FROM S JOIN T ON S.doc_id = T.doc_id AND T.pos >= S.s AND T.pos + 2 <= S.e JOIN L ON L.doc_id = S.doc_id AND pos + 2 <= length WHERE tag = 'entity')" + out("c"))
hits_query("hit_length", n.OfLength(n.Tag("u"), 3, 6), PRE + ", c AS (SELECT doc_id, s, e FROM S WHERE tag = 'u' AND e - s BETWEEN 3 AND 6)" + out("c"))

# -- captures and constraints ----------------------------------------------------------------------

_AB = ", c AS (SELECT a.doc_id, a.pos AS s, b.pos + 1 AS e, a.w AS aw, b.w AS bw, a.l AS al, b.l AS bl FROM T a JOIN T m ON a.doc_id = m.doc_id AND m.pos = a.pos + 1 JOIN T b ON b.doc_id = a.doc_id AND b.pos = a.pos + 2 WHERE m.p = 'cc')"
hits_query("constraint_equal", "a:[] [pos='CC'] b:[] :: a.word = b.word", PRE + _AB + out("(SELECT * FROM c WHERE aw = bw)"))
hits_query("constraint_compare", "a:[] [pos='CC'] b:[] :: a.lemma < b.lemma & !(b.word = 'the')", PRE + _AB + out("(SELECT * FROM c WHERE coalesce(al < bl, false) AND NOT coalesce(bw = 'the', false))"))
hits_query("constraint_or", "a:[] [pos='CC'] b:[] :: a.word = b.word | b.lemma = 'the'", PRE + _AB + out("(SELECT * FROM c WHERE coalesce(aw = bw, false) OR coalesce(bl = 'the', false))"))
hits_query("constraint_implication", "(c:'the')? a:[pos='JJ'] b:[pos='NN'] :: c -> a.word < b.word", PRE + ", x AS (SELECT a.doc_id, a.pos AS s, b.pos + 1 AS e, a.w AS aw, b.w AS bw FROM T a JOIN T b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.p = 'jj' AND b.p = 'nn'), c AS (SELECT doc_id, s, e FROM x UNION ALL SELECT x.doc_id, x.s - 1, e FROM x JOIN T ON T.doc_id = x.doc_id AND T.pos = x.s - 1 WHERE list_contains(ws, 'the') AND aw < bw)" + out("c"))
hits_query("constraint_position", "a:[pos='NN'] []{0,5} b:[pos='NN'] :: start(b) > end(a) & a.word = b.word", PRE + ", c AS (SELECT a.doc_id, a.pos AS s, b.pos + 1 AS e FROM T a JOIN T b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 2 AND a.pos + 6 WHERE a.p = 'nn' AND b.p = 'nn' AND a.w = b.w)" + out("c"))


@query("captures", PRE + ", c AS (SELECT a.doc_id, a.pos AS s, b.pos + 1 AS e, a.pos AS x, b.pos AS y FROM T a JOIN T b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.p = 'jj' AND b.p = 'nn') SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, CAST(x AS INTEGER) AS adj, CAST(y AS INTEGER) AS noun FROM c")
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = run("a:[pos='JJ'] b:[pos='NN']", corpus(spark, sf_dir))
    return h.select(*sp.KEYS, F.col("c_a.start").alias("adj"), F.col("c_b.start").alias("noun"))


@query("capture_of_first_filter_hit", PRE + tok("a", "p = 'jj'") + ", c AS (SELECT a.doc_id, a.s, a.e, min(struct_pack(s := S.s, e := S.e)) AS f FROM a JOIN S ON S.doc_id = a.doc_id AND S.tag = 'u' AND S.s <= a.s AND S.e >= a.e GROUP BY ALL) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, f.s AS u_start, f.e AS u_end FROM c")
def capture_of_first_filter_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = run("[pos='JJ'] within <u/>", corpus(spark, sf_dir))
    return h.select(*sp.KEYS, F.col("c_u.start").alias("u_start"), F.col("c_u.end").alias("u_end"))


# -- relations ---------------------------------------------------------------------------------------

REL = PRE + """, N AS (SELECT doc_id, pos AS h FROM T WHERE a_pos LIKE 'NN%'), R AS (
  SELECT N.doc_id, 'amod' AS rel_type, h, pos AS d, false AS is_root, N.doc_id * 10000000 + h * 10 AS rel_id FROM N JOIN T ON T.doc_id = N.doc_id AND T.pos = h - 1 WHERE a_pos = 'JJ'
  UNION ALL SELECT N.doc_id, 'det', h, pos, false, N.doc_id * 10000000 + h * 10 + 1 FROM N JOIN T ON T.doc_id = N.doc_id AND T.pos = h - 1 WHERE a_pos = 'DT'
  UNION ALL SELECT N.doc_id, 'det', h, pos, false, N.doc_id * 10000000 + h * 10 + 2 FROM N JOIN T ON T.doc_id = N.doc_id AND T.pos = h - 2 WHERE a_pos = 'DT'
  UNION ALL SELECT DISTINCT doc_id, 'root', s, s, true, doc_id * 10000000 + s * 10 + 3 FROM S WHERE tag = 'u' AND e > s
)"""


def with_relations(spark: SparkSession, sf_dir: str) -> Tables:
    t = corpus(spark, sf_dir)
    t.relations, t.relation_classes = derived_relations(t), ("dep",)
    return t


def relation_query(name: str, pattern: str, sql: str) -> None:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(pattern, with_relations(spark, sf_dir)).select(*sp.KEYS).distinct()

    QUERIES[name], SQL[name] = q, sql


relation_query("relation_child", "_ -amod-> 'new'", REL + f", c AS (SELECT R.doc_id, h AS s, h + 1 AS e FROM R JOIN T ON T.doc_id = R.doc_id AND T.pos = d WHERE rel_type = 'amod' AND {is_word('new')})" + out("c"))
relation_query("relation_parent_and_children", "[pos='NN'] -amod-> _ ; -det-> 'the'", REL + f", c AS (SELECT a.doc_id, a.h AS s, a.h + 1 AS e FROM R a JOIN R b ON a.doc_id = b.doc_id AND a.h = b.h JOIN T t ON t.doc_id = b.doc_id AND t.pos = b.d JOIN T p ON p.doc_id = a.doc_id AND p.pos = a.h WHERE a.rel_type = 'amod' AND b.rel_type = 'det' AND p.p = 'nn' AND list_contains(t.ws, 'the'))" + out("c"))
relation_query("relation_unique_children", "_ -.*-> _ ; -.*-> _", REL + ", c AS (SELECT a.doc_id, a.h AS s, a.h + 1 AS e FROM R a JOIN R b ON a.doc_id = b.doc_id AND a.h = b.h AND a.rel_id <> b.rel_id WHERE NOT a.is_root AND NOT b.is_root)" + out("c"))
relation_query("relation_negated", "[pos='NN'] !-det-> _", REL + ", c AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM T WHERE p = 'nn' AND NOT EXISTS (SELECT 1 FROM R WHERE R.doc_id = T.doc_id AND h = pos AND rel_type = 'det'))" + out("c"))
relation_query("relation_root", "^-root-> [pos='PP']", REL + ", c AS (SELECT R.doc_id, d AS s, d + 1 AS e FROM R JOIN T ON T.doc_id = R.doc_id AND pos = d WHERE is_root AND p = 'pp')" + out("c"))
relation_query("relation_span_full", "rspan(_ -det-> _, 'full')", REL + ", c AS (SELECT doc_id, d AS s, h + 1 AS e FROM R WHERE rel_type = 'det')" + out("c"))
relation_query("relation_span_target", "rspan(_ -amod-> _, 'target')", REL + ", c AS (SELECT doc_id, d AS s, d + 1 AS e FROM R WHERE rel_type = 'amod')" + out("c"))
relation_query("relation_span_all", "rspan([pos='NN'] -amod-> _ ; -det-> _, 'all')", REL + ", c AS (SELECT a.doc_id, least(a.d, b.d) AS s, a.h + 1 AS e FROM R a JOIN R b ON a.doc_id = b.doc_id AND a.h = b.h JOIN T ON T.doc_id = a.doc_id AND pos = a.h WHERE a.rel_type = 'amod' AND b.rel_type = 'det' AND p = 'nn')" + out("c"))
relation_query("relation_function", "rel('det', _, 'full', 'x', 'backward')", REL + ", c AS (SELECT doc_id, d AS s, h + 1 AS e FROM R WHERE rel_type = 'det')" + out("c"))
relation_query("relation_match_function", "rmatch(rel('amod'), [pos='NN'])", REL + ", c AS (SELECT R.doc_id, h AS s, h + 1 AS e FROM R JOIN T ON T.doc_id = R.doc_id AND pos = h WHERE rel_type = 'amod' AND p = 'nn')" + out("c"))
_TWO = "a JOIN R b ON a.doc_id = b.doc_id AND a.h = b.h AND a.rel_id <> b.rel_id"
relation_query("rmatch_unique", "rmatch(rel('det'), rel('det'))", REL + f", c AS (SELECT a.doc_id, a.h AS s, a.h + 1 AS e FROM R {_TWO} WHERE a.rel_type = 'det' AND b.rel_type = 'det')" + out("c"))
relation_query("adjusted_hits_setting", "@adjusthits=yes _ -det-> _", REL + ", c AS (SELECT doc_id, d AS s, h + 1 AS e FROM R WHERE rel_type = 'det')" + out("c"))


@query("relation_sets", REL + f" SELECT doc_id, CAST(h AS INTEGER) AS start_pos, count(*) AS n FROM (SELECT DISTINCT a.doc_id, a.h, least(a.rel_id, b.rel_id) AS x, greatest(a.rel_id, b.rel_id) AS y FROM R {_TWO} WHERE NOT a.is_root AND NOT b.is_root) GROUP BY ALL")
def relation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two children in either order are one hit."""
    h = run("_ -.*-> _ ; -.*-> _", with_relations(spark, sf_dir))
    return h.groupBy("doc_id", "start_pos").agg(F.count("*").alias("n"))


@query("relations_captured_within", REL + ", c AS (SELECT S.doc_id, s, e, count(rel_id) AS n FROM (SELECT DISTINCT doc_id, s, e FROM S WHERE tag = 'entity') S LEFT JOIN R ON R.doc_id = S.doc_id AND least(h, d) >= s AND h + 1 <= e GROUP BY ALL) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, n FROM c")
def relations_captured_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = run("rcapture(<entity/>, 'rels')", with_relations(spark, sf_dir))
    return h.select(*sp.KEYS, F.coalesce(F.size("c_rels"), F.lit(0)).cast("bigint").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("relation_statistics", REL + " SELECT 'dep' AS rel_class, rel_type, NULL AS attribute, NULL AS value, count(*) AS n FROM R GROUP BY rel_type UNION ALL SELECT 'dep', rel_type, 'dist', CAST(h - d AS VARCHAR), count(*) FROM R GROUP BY ALL")
def relation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.statistics(with_relations(spark, sf_dir).relations)


@query("relation_default_class", "SELECT 'dep' AS rel_class")
def relation_default_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_relations(spark, sf_dir)
    t.relation_classes = None  # looked for in the relations themselves
    name = Compiler(t).default_class()
    return spark.createDataFrame([(name,)], "rel_class string")


@query("spans_as_relations", PRE + " SELECT DISTINCT doc_id, tag AS rel_type, s AS start_pos, e AS end_pos FROM S")
def spans_as_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    t.relations = rl.span_relations(t.spans)
    h = run("rel('__tag::.*', _, 'full', 'x')", t)
    return h.select("doc_id", F.col("c_x.rel_type").alias("rel_type"), "start_pos", "end_pos").distinct()


# A parallel version: the same tokens in capitals under another field, aligned to single tokens.


def parallel(spark: SparkSession, sf_dir: str) -> Tables:
    t = corpus(spark, sf_dir)
    other = Tables(t.tokens.withColumn("word", F.upper("word")).drop("word_all"), t.spans, None, dict(t.annotations), name="contents__up")
    t.fields = {"contents__up": other}
    k = t.tokens.where("a_pos LIKE 'NN%' OR a_pos = 'JJ'").select("doc_id", "pos")
    t.relations = k.select(
        "doc_id", F.lit("contents").alias("field"), (F.col("doc_id") * 10_000_000 + F.col("pos")).alias("rel_id"), F.lit("al").alias("rel_class"), F.lit("word").alias("rel_type"), F.create_map().cast("map<string,array<string>>").alias("attrs"),
        F.lit(False).alias("is_root"), F.col("pos").alias("src_start"), (F.col("pos") + 1).alias("src_end"), F.lit("contents__up").alias("tgt_field"), F.col("pos").alias("tgt_start"), (F.col("pos") + 1).alias("tgt_end"),
    )
    return t


_ALIGNED = PRE + ", c AS (SELECT doc_id, pos AS s, pos + 1 AS e FROM T WHERE (a_pos LIKE 'NN%' OR a_pos = 'JJ') AND {0})"


@query("alignment", _ALIGNED.format(is_word("kitchen") + " AND w = 'kitchen'") + out("c"))
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("'kitchen' ==>up 'kitchen'", parallel(spark, sf_dir)).select(*sp.KEYS).distinct()


@query("alignment_optional", PRE + tok("c", is_word("the") + " OR p = 'jj'") + out("c"))
def alignment_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("('the' | [pos='JJ']) ==>up? _", parallel(spark, sf_dir)).select(*sp.KEYS).distinct()


@query("alignment_other_field", _ALIGNED.format("p = 'jj'") + out("c"))
def alignment_other_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("rfield([pos='JJ'] ==>up _, 'up')", parallel(spark, sf_dir)).select(*sp.KEYS).distinct()


_BEST = """, h AS (SELECT DISTINCT doc_id, s, e FROM S WHERE tag = 's' AND e > s), rel AS (
  SELECT h.doc_id, h.s, h.e, T.pos FROM h JOIN T ON T.doc_id = h.doc_id AND T.pos >= h.s AND T.pos < h.e WHERE a_pos LIKE 'NN%' OR a_pos = 'JJ'
), tg AS (SELECT DISTINCT doc_id, s, e FROM S WHERE tag = 'u'), n AS (
  SELECT rel.doc_id, rel.s, rel.e, tg.s AS ts, tg.e AS te, count(*) AS n FROM rel JOIN tg ON tg.doc_id = rel.doc_id AND rel.pos >= tg.s AND rel.pos < tg.e GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY n DESC, te - ts, ts) AS r FROM n)
SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, ts AS target_start, te AS target_end FROM r WHERE r = 1"""


@query("alignment_best_target", PRE + _BEST)
def alignment_best_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences aligned over many relations: of the utterances in the other version, the one that most of them touch."""
    h = run("<s/> ==>up target:<u/>", parallel(spark, sf_dir))
    return h.select(*sp.KEYS, F.col("c_target.start").alias("target_start"), F.col("c_target.end").alias("target_end")).distinct()


# -- hits pipeline -----------------------------------------------------------------------------------

_JN = PRE + ", h AS (SELECT a.doc_id, a.pos AS s, b.pos + 1 AS e, a.w || ' ' || b.w AS t FROM T a JOIN T b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.p = 'jj' AND b.p = 'nn')"


def _jn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Tables]:
    t = corpus(spark, sf_dir)
    return run("[pos='JJ'] [pos='NN']", t), t


@query("sort_by_hit_text_page", _JN + " SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM h ORDER BY t, doc_id, s LIMIT 50 OFFSET 10")
def sort_by_hit_text_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.window(rs.sort_hits(h, t, "hit:word:i"), 10, 50)


@query("sort_by_right_context", _JN + ", x AS (SELECT h.doc_id, s, e, coalesce((SELECT string_agg(w, ' ' ORDER BY pos) FROM T WHERE T.doc_id = h.doc_id AND pos >= h.e AND pos < h.e + 3), '') AS r FROM h) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM x ORDER BY r, doc_id, s LIMIT 100")
def sort_by_right_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.window(rs.sort_hits(h, t, "after:word:i:3"), 0, 100)


@query("sort_by_left_context_reversed", _JN + ", x AS (SELECT h.doc_id, s, e, coalesce((SELECT string_agg(w, ' ' ORDER BY pos DESC) FROM T WHERE T.doc_id = h.doc_id AND pos < h.s AND pos >= h.s - 2), '') AS r FROM h) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM x ORDER BY r DESC, doc_id, s LIMIT 100")
def sort_by_left_context_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.window(rs.sort_hits(h, t, "-before:word:i:2"), 0, 100)


@query("sort_by_metadata", _JN + " SELECT h.doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM h LEFT JOIN D USING (doc_id) ORDER BY coalesce(title, ''), s DESC, h.doc_id LIMIT 100")
def sort_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.window(rs.sort_hits(h, t, "field:title,-hitposition", tb.docs(spark, sf_dir)), 0, 100)


@query("filter_by_property", _JN + out("(SELECT * FROM h JOIN T ON T.doc_id = h.doc_id AND T.pos = h.e WHERE w = 'of')").replace("SELECT DISTINCT doc_id", "SELECT DISTINCT doc_id"))
def filter_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.filter_hits(h, t, "after:word:i:1", "of")


SQL["filter_by_property"] = _JN + ", x AS (SELECT h.doc_id, h.s, h.e FROM h JOIN T ON T.doc_id = h.doc_id AND T.pos = h.e WHERE w = 'of')" + out("x")


@query("sample")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.sample(_jn(spark, sf_dir)[0], number=200, seed=5)


@query("sample_fraction")
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.sample(_jn(spark, sf_dir)[0], fraction=0.1, seed=5)


def _sampled(rows: DataFrame, all_rows: DataFrame, keys: list[str]) -> DataFrame:
    """What can be told of a sample without its hash: how many rows, how many of them distinct, and how many that were not there."""
    known = rows.join(all_rows.select(*keys, F.lit(True).alias("_known")), keys, "left")
    return known.agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("different"), F.count(F.when(F.col("_known").isNull(), 1)).alias("outside"))


@query("sample_of_hits", _JN + " SELECT least(200, count(*)) AS rows, least(200, count(*)) AS different, CAST(0 AS BIGINT) AS outside FROM h")
def sample_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _jn(spark, sf_dir)[0]
    return _sampled(rs.sample(h, number=200, seed=5), h, sp.KEYS)


@query("sample_of_many_hits", PRE + " SELECT CAST(floor(0.6 * count(*) + 0.5) AS BIGINT) AS rows, CAST(floor(0.6 * count(*) + 0.5) AS BIGINT) AS different, CAST(0 AS BIGINT) AS outside FROM T")
def sample_of_many_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample too large for a top-k: by the threshold of a histogram."""
    h = run("[]", corpus(spark, sf_dir))
    return _sampled(rs.sample(h, fraction=0.6, seed=9), h, sp.KEYS)


@query("sample_of_groups", _JN + " SELECT least(20, count(DISTINCT t)) AS rows, least(20, count(DISTINCT t)) AS different, CAST(0 AS BIGINT) AS outside FROM h")
def sample_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    g = rs.group_hits(h, t, "hit:word:i")
    return _sampled(rs.sample(g, number=20, keys=["g0"]), g, ["g0"])


@query("sample_of_documents", PRE + " SELECT CAST(floor(0.1 * count(*) + 0.5) AS BIGINT) AS rows, CAST(floor(0.1 * count(*) + 0.5) AS BIGINT) AS different, CAST(0 AS BIGINT) AS outside FROM D")
def sample_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.docs(spark, sf_dir)
    return _sampled(rs.sample(d, fraction=0.1, keys=["doc_id"]), d, ["doc_id"])


@query("count", _JN + " SELECT count(*) AS hits, count(DISTINCT doc_id) AS docs FROM h")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.count_hits(_jn(spark, sf_dir)[0])


@query("per_document", _JN + " SELECT doc_id, count(*) AS n_hits FROM h GROUP BY 1")
def per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.per_document(_jn(spark, sf_dir)[0])


@query("hits_in_filtered_documents", _JN + ", x AS (SELECT h.* FROM h JOIN D USING (doc_id) WHERE lower(title) LIKE '%letter%')" + out("x"))
def hits_in_filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _ = _jn(spark, sf_dir)
    return sp.in_documents(h, docfilter.filter_documents(tb.docs(spark, sf_dir), "title:letter"))


@query("hits_in_one_document", _JN + out("(SELECT * FROM h WHERE doc_id = 3)"))
def hits_in_one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.hits_in_document(_jn(spark, sf_dir)[0], 3)


_SLICE = "(SELECT coalesce(list(T.{0} ORDER BY T.pos), []) FROM T WHERE T.doc_id = h.doc_id AND T.pos >= {1} AND T.pos < {2})"


@query("kwic", PRE + tok("h", is_word("kitchen")) + f" SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, array_to_string({_SLICE.format('word', 'h.s - 4', 'h.s')}, ' ') AS left_text, array_to_string({_SLICE.format('word', 'h.s', 'h.e')}, ' ') AS match_text, array_to_string({_SLICE.format('word', 'h.e', 'h.e + 4')}, ' ') AS right_text FROM h")
def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    k = rs.kwic(run("'kitchen'", t), t, ["word"], 4, 4)
    return k.select(*sp.KEYS, *[F.array_join(f"{x}_word", " ").alias(f"{x}_text") for x in ("left", "match", "right")])


@query("concordance", PRE + tok("h", is_word("kitchen")) + ", q AS (SELECT *, coalesce(punct, '') || coalesce(word, '') AS piece FROM T), z AS (SELECT h.doc_id, s, e, string_agg(piece, '' ORDER BY pos) FILTER (pos < s) AS a, string_agg(piece, '' ORDER BY pos) FILTER (pos >= s AND pos < e) AS b, string_agg(piece, '' ORDER BY pos) FILTER (pos >= e) AS c FROM h JOIN q ON q.doc_id = h.doc_id AND pos BETWEEN s - 5 AND e + 4 GROUP BY ALL) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, coalesce(a, '') AS left_text, b AS match_text, coalesce(c, '') AS right_text FROM z")
def concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    return rs.concordance(run("'kitchen'", t), t)


@query("kwic_in_span", PRE + tok("h", is_word("kitchen")) + ", f AS (SELECT h.doc_id, h.s, h.e, min(struct_pack(s := S.s, e := S.e)) AS u FROM h JOIN S ON S.doc_id = h.doc_id AND tag = 'u' AND S.s <= h.s AND S.e >= h.e GROUP BY ALL), g AS (SELECT h.doc_id, h.s, h.e, coalesce(f.u.s, h.s) AS a, coalesce(f.u.e, h.e) AS z FROM h LEFT JOIN f USING (doc_id, s, e)) SELECT g.doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, count(*) FILTER (pos < s) AS n_left, count(*) FILTER (pos >= e) AS n_right FROM g JOIN T ON T.doc_id = g.doc_id AND pos >= a AND pos < z GROUP BY ALL")
def kwic_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    k = rs.kwic_in_span(run("'kitchen'", t), t, "u", ["word"])
    return k.select(*sp.KEYS, F.size("left_word").cast("bigint").alias("n_left"), F.size("right_word").cast("bigint").alias("n_right"))


@query("collocations", PRE + tok("h", "l = 'be'") + " SELECT w AS term, count(*) AS freq FROM h JOIN T ON T.doc_id = h.doc_id AND ((pos >= s - 5 AND pos < s) OR (pos >= e AND pos < e + 5)) WHERE w IS NOT NULL GROUP BY 1")
def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    return rs.collocations(run("[lemma='be']", t), t)


# -- groups ------------------------------------------------------------------------------------------


def group_query(name: str, by: str, key_sql: str, docs: bool = False, names: int = 1) -> None:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        h, t = _jn(spark, sf_dir)
        return rs.group_hits(h, t, by, tb.docs(spark, sf_dir) if docs else None)

    QUERIES[name], SQL[name] = q, _JN + f", x AS (SELECT h.doc_id, {key_sql} FROM h {'LEFT JOIN D USING (doc_id)' if docs else ''}) SELECT {', '.join(f'g{i}' for i in range(names))}, count(*) AS size, count(DISTINCT doc_id) AS docs FROM x GROUP BY ALL"


def _ctx_sql(low: str, high: str, order: str = "ASC", column: str = "w") -> str:
    return f"coalesce((SELECT string_agg(coalesce({column}, ''), ' ' ORDER BY pos {order}) FROM T WHERE T.doc_id = h.doc_id AND pos >= {low} AND pos < {high}), '')"


group_query("group_by_hit", "hit:word:i", "t AS g0")
group_query("group_by_hit_sensitive", "hit:word:s", _ctx_sql("h.s", "h.e", column="word") + " AS g0")
group_query("group_by_lemma_of_hit", "hit:lemma:i", _ctx_sql("h.s", "h.e", column="l") + " AS g0")
group_query("group_by_word_before", "wordleft:word:i", _ctx_sql("h.s - 1", "h.s") + " AS g0")
group_query("group_by_words_after", "after:word:i:2", _ctx_sql("h.e", "h.e + 2") + " AS g0")
group_query("group_by_context_parts", "ctx:word:i:H1;B1;E1", f"concat_ws(' ', {_ctx_sql('h.s', 'h.s + 1')}, nullif({_ctx_sql('h.s - 1', 'h.s')}, ''), {_ctx_sql('h.e - 1', 'h.e')}) AS g0")
group_query("group_by_position", "hitposition", "CAST(h.s AS INTEGER) AS g0")
group_query("group_by_document", "doc", "pid AS g0", True)
group_query("group_by_document_id", "docid", "h.doc_id AS g0")
group_query("group_by_field", "field:lang", "coalesce(lang, '') AS g0", True)
group_query("group_by_decade", "decade:recorded_at", "CAST(coalesce(year(recorded_at) - year(recorded_at) % 10, 10000000) AS INTEGER) AS g0", True)
group_query("group_by_several", "hit:pos:i,field:lang", _ctx_sql("h.s", "h.e", column="p") + " AS g0, coalesce(lang, '') AS g1", True, 2)


@query("group_by_capture", PRE + " SELECT b.w AS g0, count(*) AS size, count(DISTINCT a.doc_id) AS docs FROM T a JOIN T b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.p = 'jj' AND b.p = 'nn' GROUP BY 1")
def group_by_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    return rs.group_hits(run("[pos='JJ'] n:[pos='NN']", t), t, "capture:word:i:n")


group_query("group_by_context_open", "ctx:word:i:B1-;A3-", f"concat_ws(' ', nullif({_ctx_sql('h.s - 6', 'h.s', 'DESC')}, ''), nullif({_ctx_sql('h.e + 2', 'h.e + 6')}, '')) AS g0")


@query("group_by_capture_outside", PRE + tok("a", "p = 'jj'") + """, f AS (SELECT a.doc_id, a.s, a.e, min(struct_pack(s := S.s, e := S.e)) AS around FROM a JOIN S ON S.doc_id = a.doc_id AND S.tag = 'entity' AND S.s <= a.s AND S.e >= a.e GROUP BY ALL),
 h AS (SELECT doc_id, around.s AS s, around.e AS e FROM f), x AS (SELECT h.doc_id, """ + _ctx_sql("h.s", "h.e") + " AS g0 FROM h) SELECT g0, count(*) AS size, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1")
def group_by_capture_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the text of the span around the hit, most of which lies outside of it."""
    t = corpus(spark, sf_dir)
    return rs.group_hits(run("[pos='JJ'] within <entity/>", t), t, "capture:word:i:entity")


@query("group_by_relation_target", REL + " SELECT t.w AS g0, coalesce(s.w, '') AS g1, count(*) AS size, count(DISTINCT R.doc_id) AS docs FROM R JOIN T t ON t.doc_id = R.doc_id AND t.pos = R.d JOIN T s ON s.doc_id = R.doc_id AND s.pos = R.h WHERE rel_type = 'amod' GROUP BY ALL")
def group_by_relation_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_relations(spark, sf_dir)
    return rs.group_hits(run("_ -amod-> _", t), t, "capture:word:i:amod:target,capture:word:i:amod:source")


@query("group_with_stored_hits", _JN + ", r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM h) SELECT t AS g0, count(*) AS size, count(DISTINCT doc_id) AS docs, sum(s * 7 + e) FILTER (r <= 3) AS kept FROM r GROUP BY 1")
def group_with_stored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    g = rs.group_hits(h, t, "hit:word:i", keep=3)
    return g.select("g0", "size", "docs", F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["start_pos"] * 7 + x["end_pos"]).alias("kept"))


@query("top_groups", _JN + " SELECT t AS g0, count(*) AS size, count(DISTINCT doc_id) AS docs FROM h GROUP BY 1 ORDER BY size DESC, g0 LIMIT 25")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.window(rs.sort_groups(rs.group_hits(h, t, "hit:word:i"), "size"), 0, 25)


@query("filtered_groups", _JN + " SELECT coalesce(lang, '') AS g0, count(*) AS size, count(DISTINCT doc_id) AS docs FROM h LEFT JOIN D USING (doc_id) GROUP BY 1 HAVING g0 = 'nl'")
def filtered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.filter_groups(rs.group_hits(h, t, "field:lang", tb.docs(spark, sf_dir)), ["nl"])


@query("view_group", _JN + ", x AS (SELECT h.* FROM h JOIN D USING (doc_id) WHERE lang = 'nl')" + out("x"))
def view_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.view_group(h, t, "field:lang", ["nl"], tb.docs(spark, sf_dir))


@query("token_frequencies_by_field", PRE + " SELECT w AS g0, coalesce(lang, '') AS g1, count(*) AS size, count(DISTINCT T.doc_id) AS docs FROM T LEFT JOIN D USING (doc_id) GROUP BY ALL")
def token_frequencies_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any token, grouped by its text and a document's field: one grouping of the tokens, without a join of contexts."""
    return _handle(spark, sf_dir).search("[]").group("hit:word:i,field:lang")


@query("token_frequencies_in_filtered_documents", PRE + " SELECT l AS g0, D.doc_id AS g1, count(*) AS size, count(DISTINCT T.doc_id) AS docs FROM (SELECT doc_id, coalesce(l, '') AS l FROM T) T JOIN D USING (doc_id) WHERE lower(title) LIKE '%letter%' GROUP BY ALL")
def token_frequencies_in_filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handle(spark, sf_dir).search("[]", "title:letter").group("hit:lemma:i,docid")


@query("doc_groups_sorted", PRE + " SELECT coalesce(lang, '') AS g0, count(*) AS docs, CAST(coalesce(sum(coalesce(length_tokens, 0)), 0) AS BIGINT) AS tokens FROM D GROUP BY 1 ORDER BY docs DESC, g0 LIMIT 3")
def doc_groups_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.window(rs.sort_groups(rs.group_docs(tb.docs(spark, sf_dir), "field:lang"), "size"), 0, 3)


@query("doc_groups_by_identity", PRE + " SELECT coalesce(lang, '') AS g0, count(*) AS docs, CAST(coalesce(sum(coalesce(length_tokens, 0)), 0) AS BIGINT) AS tokens FROM D GROUP BY 1 ORDER BY g0 DESC LIMIT 4 OFFSET 1")
def doc_groups_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.window(rs.sort_groups(rs.group_docs(tb.docs(spark, sf_dir), "field:lang"), "-identity"), 1, 4)


@query("buckets_per_document", _JN + " SELECT doc_id, CAST(floor(s / 1024) AS INTEGER) AS block, count(*) AS n, min(s) AS first, max(s) AS last FROM h GROUP BY ALL")
def buckets_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sp.bucketed(_jn(spark, sf_dir)[0])
    return b.select("doc_id", "block", F.size("hits").cast("bigint").alias("n"), F.element_at("hits", 1)["start_pos"].alias("first"), F.element_at("hits", -1)["start_pos"].alias("last"))


@query("hits_of_the_same_span", PRE + " SELECT doc_id, s AS start_pos, e AS end_pos, count(*) AS hits FROM (SELECT DISTINCT doc_id, tag, s, e FROM S) GROUP BY ALL")
def hits_of_the_same_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.same_span(tb.spans(spark, sf_dir).select("doc_id", "tag", *sp.KEYS[1:]).distinct())


# -- many hits: about a quarter of all tokens, and twice as many as there are tokens -------------------

_MANY = PRE + ", h AS (SELECT doc_id, pos AS s, pos + 1 AS e, w AS t FROM T WHERE p LIKE 'n%')"


def _many(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Tables]:
    t = corpus(spark, sf_dir)
    return run("[pos='N.*']", t), t


@query("many_sorted_by_title", _MANY + " SELECT h.doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM h LEFT JOIN D USING (doc_id) ORDER BY coalesce(title, ''), h.doc_id, s LIMIT 1000")
def many_sorted_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _many(spark, sf_dir)
    return rs.window(rs.sort_hits(h, t, "field:title", tb.docs(spark, sf_dir)), 0, 1000)


@query("many_sorted_by_right_context", _MANY + ", x AS (SELECT h.doc_id, s, e, coalesce(T1.w, '') || CASE WHEN T2.w IS NULL THEN '' ELSE ' ' || T2.w END AS r FROM h LEFT JOIN T T1 ON T1.doc_id = h.doc_id AND T1.pos = h.e LEFT JOIN T T2 ON T2.doc_id = h.doc_id AND T2.pos = h.e + 1) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos FROM x ORDER BY r, doc_id, s LIMIT 1000")
def many_sorted_by_right_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _many(spark, sf_dir)
    return rs.window(rs.sort_hits(h, t, "after:word:i:2"), 0, 1000)


@query("many_grouped_by_text", PRE + ", g AS (SELECT doc_id, w AS t FROM T UNION ALL SELECT a.doc_id, a.w || ' ' || b.w FROM T a JOIN T b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1) SELECT t AS g0, count(*) AS size, count(DISTINCT doc_id) AS docs FROM g GROUP BY 1")
def many_grouped_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of one and of two tokens by their text."""
    t = corpus(spark, sf_dir)
    return rs.group_hits(run("[]{1,2}", t), t, "hit:word:i")


# -- documents and terms -----------------------------------------------------------------------------


@query("docs_filter", PRE + " SELECT doc_id, pid FROM D WHERE regexp_matches(lower(title), '(^| )(letter|news)( |$)') AND coalesce(length_tokens BETWEEN 50 AND 200, false)")
def docs_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docfilter.filter_documents(tb.docs(spark, sf_dir), "title:(letter OR news) AND length_tokens:[50 TO 200]").select("doc_id", "pid")


@query("docs_filter_phrase", PRE + " SELECT doc_id, pid FROM D WHERE lower(title) LIKE '%letter to the%' AND NOT coalesce(lower(lang), '') LIKE 'en%'")
def docs_filter_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docfilter.filter_documents(tb.docs(spark, sf_dir), 'title:"letter to the" -lang:en*').select("doc_id", "pid")


@query("docs_sorted", PRE + " SELECT doc_id, length_tokens FROM D ORDER BY length_tokens DESC NULLS LAST, doc_id LIMIT 20")
def docs_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.window(rs.sort_docs(tb.docs(spark, sf_dir), "-fieldlen"), 0, 20).select("doc_id", "length_tokens")


@query("docs_sorted_by_hits", _JN + " SELECT doc_id, count(*) AS n_hits FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def docs_sorted_by_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rs.per_document(_jn(spark, sf_dir)[0])
    return rs.window(rs.sort_docs(d, "-numhits"), 0, 20)


@query("docs_grouped", PRE + " SELECT coalesce(lang, '') AS g0, count(*) AS docs, CAST(coalesce(sum(coalesce(length_tokens, 0)), 0) AS BIGINT) AS tokens FROM D GROUP BY 1")
def docs_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.group_docs(tb.docs(spark, sf_dir), "field:lang")


@query("docs_filtered_by_property", PRE + " SELECT doc_id FROM D WHERE lang = 'de'")
def docs_filtered_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.filter_docs(tb.docs(spark, sf_dir), "field:lang", "de").select("doc_id")


@query("facets", PRE + " SELECT 'lang' AS field, coalesce(lang, '') AS value, count(*) AS docs FROM D GROUP BY ALL UNION ALL SELECT 'title', coalesce(title, ''), count(*) FROM D GROUP BY ALL")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.facets(tb.docs(spark, sf_dir), ["lang", "title"])


@query("sum_over_docs", PRE + " SELECT CAST(sum(length_tokens) AS BIGINT) AS total, max(length_tokens) AS largest, count(*) AS n FROM D")
def sum_over_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.total(tb.docs(spark, sf_dir), "length_tokens")


@query("subcorpus_size", PRE + " SELECT count(*) AS docs, CAST(coalesce(sum(length_tokens), 0) AS BIGINT) AS tokens FROM D WHERE lower(title) LIKE '%letter%'")
def subcorpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.subcorpus_size(docfilter.filter_documents(tb.docs(spark, sf_dir), "title:letter"))


@query("tokens_per_value", PRE + " SELECT coalesce(lang, '') AS value, CAST(sum(coalesce(length_tokens, 0)) AS BIGINT) AS tokens, count(*) AS docs FROM D GROUP BY 1")
def tokens_per_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.tokens_per_value(tb.docs(spark, sf_dir), "lang")


@query("term_frequencies", PRE + " SELECT w AS term, count(*) AS freq FROM T WHERE w IS NOT NULL GROUP BY 1")
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.term_frequencies(corpus(spark, sf_dir))


@query("term_frequencies_asked", PRE + ", q AS (SELECT unnest(['the', 'kitchen', 'nosuchword']) AS term) SELECT term, count(w) AS freq FROM q LEFT JOIN T ON w = term GROUP BY 1")
def term_frequencies_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.term_frequencies(corpus(spark, sf_dir), terms=["The", "kitchen", "nosuchword"])


@query("term_frequencies_in_documents", PRE + " SELECT l AS term, count(*) AS freq FROM T JOIN D USING (doc_id) WHERE lower(title) LIKE '%letter%' AND l IS NOT NULL GROUP BY 1")
def term_frequencies_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.term_frequencies(corpus(spark, sf_dir), "lemma", documents=docfilter.filter_documents(tb.docs(spark, sf_dir), "title:letter"))


@query("frequency_list", PRE + " SELECT coalesce(lemma, '') AS lemma, coalesce(a_pos, '') AS pos, coalesce(lang, '') AS lang, count(*) AS freq FROM T JOIN D USING (doc_id) GROUP BY ALL HAVING count(*) >= 2")
def frequency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.frequency_list(corpus(spark, sf_dir), ["lemma", "pos"], ["lang"], tb.docs(spark, sf_dir), least=2)


@query("autocomplete", PRE + " SELECT DISTINCT w AS term FROM T WHERE starts_with(w, 'st') ORDER BY 1 LIMIT 30")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.autocomplete(corpus(spark, sf_dir), "st")


@query("metadata_values", PRE + " SELECT lang AS value, count(*) AS docs FROM D WHERE lang IS NOT NULL GROUP BY 1")
def metadata_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.field_values(tb.docs(spark, sf_dir), "lang")


@query("metadata_values_truncated", PRE + " SELECT title AS value, count(*) AS docs, true AS truncated FROM D WHERE title IS NOT NULL GROUP BY 1 ORDER BY docs DESC, value LIMIT 15")
def metadata_values_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.field_values(tb.docs(spark, sf_dir), "title", 15)


@query("annotation_values", PRE + " SELECT a_pos AS value, count(*) AS freq FROM T WHERE a_pos IS NOT NULL GROUP BY 1")
def annotation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.annotation_values(corpus(spark, sf_dir), "pos")


# -- loading and value processing --------------------------------------------------------------------


@query("plain_text_tokens", r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS word FROM documents WHERE text IS NOT NULL) SELECT word, count(*) AS freq, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1")
def plain_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.sources import text

    t = text.tokens_of(tb.table(spark, sf_dir, "documents"), "doc_id", "text")
    return t.groupBy("doc_id", "word").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("freq"), F.count("*").alias("docs"))


_STEPS = """SELECT doc_id, regexp_replace(title, 'the', 'THE', 'g') AS replaced, coalesce(nullif(trim(title), ''), 'unknown') AS defaulted, CASE WHEN pid IS NULL THEN lang ELSE concat_ws('-', pid, nullif(lang, '')) END AS appended,
 split_part(title, ' ', 1) AS first_word, regexp_replace(title, '^[ lt]+|[ lt]+$', '', 'g') AS stripped, CASE lang WHEN 'en' THEN 'English' WHEN 'nl' THEN 'Dutch' ELSE lang END AS mapped FROM D"""


@query("value_steps", PRE + " " + _STEPS)
def value_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.docs(spark, sf_dir)
    one = lambda c, *steps, fields=None: process.apply(F.col(c), list(steps), d)
    return d.select(
        "doc_id",
        one("title", {"action": "replace", "find": "the", "replace": "THE"}).alias("replaced"),
        process.apply(F.trim("title"), [{"action": "default", "value": "unknown"}], d).alias("defaulted"),
        one("pid", {"action": "append", "field": "lang", "separator": "-"}).alias("appended"),
        one("title", {"action": "split", "separator": " "}).alias("first_word"),
        one("title", {"action": "strip", "chars": " lt"}).alias("stripped"),
        process.map_values(F.col("lang"), {"en": "English", "nl": "Dutch"}).alias("mapped"),
    )


# -- languages and settings ----------------------------------------------------------------------------

_SEQ = PRE + tok("a", is_word("the")) + tok("b", "p = 'nn'") + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s)"
hits_query("forced_first_clause", "_FI1('the', [pos='NN'])", _SEQ + out("c"))
hits_query("forced_second_clause", "_FI2('the', [pos='NN'])", _SEQ + out("c"))
hits_query("identity_function", "_ident('the' [pos='NN'])", _SEQ + out("c"))
hits_query("double_negation", "!!'the'", PRE + tok("a", is_word("the")) + out("a"))
hits_query("negated_repetition", "'the' !'of'{2} 'the'", PRE + tok("a", is_word("the")) + ", f AS (SELECT doc_id, pos FROM T WHERE NOT " + is_word("of") + "), o AS (SELECT x.doc_id, x.pos FROM T x JOIN T y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE list_contains(x.ws, 'of') AND list_contains(y.ws, 'of')), k AS (SELECT doc_id, pos FROM T WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = T.doc_id AND T.pos IN (o.pos, o.pos + 1))), c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN k ON k.doc_id = a.doc_id AND k.pos = a.e JOIN a b ON b.doc_id = a.doc_id AND b.s = k.pos + 1)" + out("c"))
hits_query("overlap_of_patterns", "([pos='JJ'] [pos='NN']) overlap ([] [pos='JJ'])", PRE + _AN + ", x AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s), y AS (SELECT doc_id, s - 1 AS s, e FROM a WHERE s > 0), c AS (SELECT x.doc_id, greatest(x.s, y.s) AS s, least(x.e, y.e) AS e FROM x JOIN y ON x.doc_id = y.doc_id AND x.s < y.e AND y.s < x.e)" + out("c"))
hits_query("spans_within_spans", "<u/> within <s/>", PRE + ", c AS (SELECT a.doc_id, a.s, a.e FROM S a JOIN S b ON a.doc_id = b.doc_id AND b.s <= a.s AND b.e >= a.e WHERE a.tag = 'u' AND b.tag = 's')" + out("c"))
hits_query("span_by_speaker_containing", "<u who='#S1'/> containing ('yeah' 'yeah')", PRE + tok("a", is_word("yeah")) + ", y AS (SELECT x.doc_id, x.s, z.e FROM a x JOIN a z ON x.doc_id = z.doc_id AND x.e = z.s), c AS (SELECT S.doc_id, S.s, S.e FROM S WHERE tag = 'u' AND lower(attrs['who']) = '#s1' AND EXISTS (SELECT 1 FROM y WHERE y.doc_id = S.doc_id AND y.s >= S.s AND y.e <= S.e))" + out("c"))
hits_query("start_of_span", "<u> 'yeah'", PRE + tok("a", is_word("yeah")) + ", c AS (SELECT a.* FROM a JOIN S ON S.doc_id = a.doc_id AND S.s = a.s AND tag = 'u')" + out("c"))
hits_query("end_of_span", "'know' </u>", PRE + tok("a", is_word("know")) + ", c AS (SELECT a.* FROM a JOIN S ON S.doc_id = a.doc_id AND S.e = a.e AND tag = 'u')" + out("c"))


@query("pattern_from_json", _SEQ + out("c"))
def pattern_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.plans.parser import parse
    from spanloom.plans.serialise import from_json, to_json

    return run(from_json(to_json(parse("'the' [pos='NN']"))), corpus(spark, sf_dir)).select(*sp.KEYS).distinct()


@query("pattern_from_text", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e + 1 AND a.e + 2)" + out("c"))
def pattern_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern written as text again, and that parsed."""
    from spanloom.plans.parser import parse
    from spanloom.plans.serialise import to_text

    return run(to_text(parse("[pos='JJ'] []{1,2} [pos='NN']")), corpus(spark, sf_dir)).select(*sp.KEYS).distinct()


@query("first_hits", PRE + tok("a", is_word("the")) + " SELECT CAST(50 AS BIGINT) AS rows, count(*) > 50 AS more FROM a")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit on hits and whether it was reached."""
    some, more = rs.limited(run("'the'", corpus(spark, sf_dir)), 50)
    return some.agg(F.count("*").alias("rows"), F.lit(more).alias("more"))


def _handle(spark: SparkSession, sf_dir: str):
    from spanloom.corpus import Corpus

    return Corpus(corpus(spark, sf_dir), tb.docs(spark, sf_dir))


@query("contextual_query", PRE + tok("a", "l = 'be'") + ", c AS (SELECT a.* FROM a JOIN D USING (doc_id) WHERE lower(title) LIKE '%letter%')" + out("c"))
def contextual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handle(spark, sf_dir).search('lemma="be" and metadata.title=letter', language="contextql").frame.select(*sp.KEYS).distinct()


@query("pattern_template", PRE + tok("a", is_word("kitchen") + " OR " + is_word("letter")) + out("a"))
def pattern_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handle(spark, sf_dir).search("'@@'", gaps="kitchen\nletter\n").frame.select(*sp.KEYS).distinct()


@query("search_in_filtered_documents", PRE + _AN + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s JOIN D ON D.doc_id = a.doc_id WHERE lower(lang) LIKE 'en%')" + out("c"))
def search_in_filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handle(spark, sf_dir).search("[pos='JJ'] [pos='NN']", "lang:en*").frame.select(*sp.KEYS).distinct()


@query("documents_of_hits", _JN + " SELECT D.doc_id, pid, count(*) AS n_hits FROM h JOIN D USING (doc_id) GROUP BY ALL")
def documents_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _handle(spark, sf_dir).search("[pos='JJ'] [pos='NN']").docs().select("doc_id", "pid", "n_hits")


@query("relation_captures_in_capture", REL + ", c AS (SELECT t.doc_id, t.pos AS s, j.pos + 2 AS e, j.pos AS a FROM T t JOIN T j ON j.doc_id = t.doc_id AND j.pos = t.pos + 1 JOIN T k ON k.doc_id = t.doc_id AND k.pos = j.pos + 1 WHERE t.p = 'dt' AND j.p = 'jj' AND k.p = 'nn') SELECT c.doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, count(rel_id) AS n FROM c LEFT JOIN R ON R.doc_id = c.doc_id AND least(h, d) >= a AND h + 1 <= e GROUP BY ALL")
def relation_captures_in_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = run("rcapture2([pos='DT'] A:([pos='JJ'] [pos='NN']), 'A', 'rels')", with_relations(spark, sf_dir))
    return h.select(*sp.KEYS, F.greatest(F.lit(0), F.coalesce(F.size("c_rels"), F.lit(0))).cast("bigint").alias("n"))


@query("context_setting", PRE + tok("a", is_word("kitchen")) + ", c AS (SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM S WHERE tag = 'entity' AND S.doc_id = a.doc_id AND S.s <= a.s AND S.e >= a.e))" + out("c"))
def context_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run("@context=entity 'kitchen'", with_relations(spark, sf_dir)).select(*sp.KEYS).distinct()


@query("collocations_most_frequent", PRE + tok("h", "l = 'letter'") + " SELECT lemma AS term, count(*) AS freq FROM h JOIN T ON T.doc_id = h.doc_id AND ((pos >= s - 3 AND pos < s) OR (pos >= e AND pos < e + 3)) WHERE lemma IS NOT NULL GROUP BY 1 ORDER BY freq DESC, term LIMIT 20")
def collocations_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    c = rs.collocations(run("[lemma='letter']", t), t, "lemma", 3, 3, "s")
    return rs.window(c.orderBy(F.desc("freq"), "term"), 0, 20)


@query("group_sizes", _JN + ", g AS (SELECT t, count(*) AS size FROM h GROUP BY 1) SELECT CAST(sum(size) AS BIGINT) AS total, max(size) AS largest, count(*) AS n FROM g")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.total(rs.group_hits(h, t, "hit:word:i"), "size")


@query("groups_sampled")
def groups_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, t = _jn(spark, sf_dir)
    return rs.sample(rs.group_hits(h, t, "hit:word:i"), number=20, keys=["g0"])


@query("documents_sampled")
def documents_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.sample(tb.docs(spark, sf_dir), fraction=0.1, keys=["doc_id"]).select("doc_id", "pid")


@query("documents_grouped_by_two_fields", PRE + " SELECT coalesce(lang, '') AS g0, CAST(coalesce(year(recorded_at) - year(recorded_at) % 10, 10000000) AS INTEGER) AS g1, count(*) AS docs, CAST(sum(coalesce(length_tokens, 0)) AS BIGINT) AS tokens FROM D GROUP BY ALL")
def documents_grouped_by_two_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.group_docs(tb.docs(spark, sf_dir), "field:lang,decade:recorded_at")


@query("spans_per_speaker", PRE + " SELECT coalesce(attrs['who'], '') AS who, count(*) AS spans, CAST(sum(e - s) AS BIGINT) AS tokens FROM S WHERE tag = 'u' GROUP BY 1")
def spans_per_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.spans(spark, sf_dir).where("tag = 'u'")
    return rows.groupBy(F.coalesce(F.col("attrs")["who"], F.lit("")).alias("who")).agg(F.count("*").alias("spans"), F.sum(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("tokens"))


@query("text_tokens_with_offsets", r"WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(ws) AS n, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS letters, CAST(0 AS BIGINT) AS misplaced FROM w WHERE len(ws) > 0")
def text_tokens_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.sources import text

    d = tb.table(spark, sf_dir, "documents")
    t = text.tokens_with_offsets(d, "doc_id", "text").join(d.select("doc_id", "text"), "doc_id")
    wrong = F.substring("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("word")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("word")).cast("bigint").alias("letters"), F.sum(wrong.cast("bigint")).alias("misplaced"))
