"""Queries of the general training-data operators that belong to the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import shred
from spanloom.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child object of a hit that was routed to one of the subtype tables of captures, infos and relations."""
    rows = shred.shred_responses(table(spark, sf_dir, "containing"), only=("capture", "info", "relation")).supertype()
    nested = F.col("role") == "relation"
    return rows.select(
        "response_id",
        F.col("hit_no").cast("int").alias("hit_no"),
        F.col("role").alias("kind"),
        "item_name",
        F.when(nested, F.col("nested_no")).otherwise(0).cast("int").alias("item_no"),
    )


def _flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that rows can be compared: lists element by element, maps as entries sorted by key."""
    cols = []
    for name, kind in rows.dtypes:
        c = F.sort_array(F.map_entries(name)) if kind.startswith("map") else F.col(name)
        cols.append((F.to_json(c) if kind.startswith(("map", "array")) else c).alias(name))
    return rows.select(*cols)


def _table(role: shred.Role, depth: int, variant: str | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shredded = shred.shred_responses(table(spark, sf_dir, "containing"), only=(role.name,), variant=variant)
        return _flat(shredded.subtype(role, variant, depth) if variant else shredded.table(role, depth))

    return run


P1_PARTS = r"""
WITH RECURSIVE raw AS (
  SELECT DISTINCT response_id, ltrim(body, chr(65279) || ' ' || chr(10) || chr(13) || chr(9)) AS body
  FROM containing WHERE body IS NOT NULL
), one AS (
  SELECT response_id, CASE WHEN json_valid(body) THEN CASE json_type(body) WHEN 'VARCHAR' THEN ltrim(CAST(body AS JSON) ->> '$', chr(65279)) ELSE body END END AS body FROM raw
), good AS (
  SELECT response_id, body, json_extract(body, '$.hits') AS hits FROM one WHERE json_valid(body) AND json_type(body) = 'OBJECT'
), hit AS (
  SELECT response_id, unnest(range(CAST(json_array_length(hits) AS BIGINT))) AS hit_no, unnest(CAST(hits AS JSON[])) AS h FROM good WHERE json_type(hits) = 'ARRAY'
  UNION ALL SELECT response_id, 0, hits FROM good WHERE json_type(hits) = 'OBJECT'
), part AS (
  SELECT response_id, hit_no, h, h -> '$.captureGroups' AS c, h -> '$.matchInfos' AS m FROM hit WHERE json_type(h) = 'OBJECT'
), capture AS (
  SELECT response_id, hit_no, unnest(range(CAST(json_array_length(c) AS BIGINT))) AS no, unnest(CAST(c AS JSON[])) AS o FROM part WHERE json_type(c) = 'ARRAY'
  UNION ALL SELECT response_id, hit_no, 0, c FROM part WHERE json_type(c) = 'OBJECT'
), info AS (
  SELECT response_id, hit_no, no, o ->> '$.name' AS item_name, o FROM (SELECT response_id, hit_no, unnest(range(CAST(json_array_length(m) AS BIGINT))) AS no, unnest(CAST(m AS JSON[])) AS o FROM part WHERE json_type(m) = 'ARRAY')
  UNION ALL
  SELECT response_id, hit_no, no, k, json_extract(m, '$."' || k || '"') FROM (SELECT response_id, hit_no, m, unnest(range(len(json_keys(m)))) AS no, unnest(json_keys(m)) AS k FROM part WHERE json_type(m) = 'OBJECT')
), relation AS (
  SELECT response_id, hit_no, no, item_name, unnest(range(CAST(json_array_length(o -> '$.infos') AS BIGINT))) AS item_no, unnest(CAST(o -> '$.infos' AS JSON[])) AS r
  FROM info WHERE json_type(o -> '$.infos') = 'ARRAY'
)
"""
_INT = "TRY_CAST({0} ->> '$.{1}' AS BIGINT) AS {2}"
P1_SQL = (
    P1_PARTS
    + """
SELECT response_id, CAST(hit_no AS INTEGER) AS hit_no, 'capture' AS kind, o ->> '$.name' AS item_name, 0 AS item_no FROM capture WHERE json_type(o) = 'OBJECT'
UNION ALL
SELECT response_id, CAST(hit_no AS INTEGER), 'info', item_name, 0 FROM info WHERE json_type(o) = 'OBJECT'
UNION ALL
SELECT response_id, CAST(hit_no AS INTEGER), 'relation', item_name, CAST(item_no AS INTEGER) FROM relation WHERE json_type(r) = 'OBJECT'
"""
)
P1_CAPTURES = P1_PARTS + f"""SELECT response_id, 'plain' AS variant, CAST(hit_no AS INTEGER) AS hit_no, CAST(NULL AS VARCHAR) AS hit_name, CAST(no AS INTEGER) AS item_no, o ->> '$.name' AS item_name,
  {_INT.format('o', 'start', 'start_pos')}, {_INT.format('o', 'end', 'end_pos')} FROM capture WHERE json_type(o) = 'OBJECT'"""
P1_INFOS = P1_PARTS + f""", x AS (SELECT *, CASE WHEN json_exists(o, '$.infos') THEN 'list' WHEN json_exists(o, '$.relType') THEN 'relation' WHEN json_exists(o, '$.tagName') OR json_exists(o, '$.attributes') THEN 'tag' ELSE 'span' END AS variant FROM info WHERE json_type(o) = 'OBJECT')
SELECT response_id, variant, CAST(hit_no AS INTEGER) AS hit_no, item_name, o ->> '$.type' AS kind_type, o ->> '$.relType' AS rel_type, o ->> '$.tagName' AS tag_name, o -> '$.attributes' ->> '$.who[0]' AS who,
  {_INT.format('o', 'start', 'start_pos')}, {_INT.format('o', 'end', 'end_pos')}, {_INT.format('o', 'sourceStart', 'source_start')}, {_INT.format('o', 'targetEnd', 'target_end')} FROM x"""
P1_RELATIONS = P1_PARTS + f"""SELECT response_id, 'target_only' AS variant, CAST(hit_no AS INTEGER) AS hit_no, item_name, CAST(item_no AS INTEGER) AS nested_no, r ->> '$.type' AS kind_type, r ->> '$.relType' AS rel_type,
  {_INT.format('r', 'targetStart', 'target_start')}, {_INT.format('r', 'targetEnd', 'target_end')}, CAST(r ->> '$.isRoot' AS BOOLEAN) AS is_root FROM relation WHERE json_type(r) = 'OBJECT'"""
P1_HITS = P1_PARTS + f"""SELECT response_id, CAST(hit_no AS INTEGER) AS hit_no, h ->> '$.docPid' AS doc_pid, {_INT.format('h', 'start', 'start_pos')}, {_INT.format('h', 'end', 'end_pos')},
  array_to_string(CAST(h -> '$.match' -> '$.word' AS VARCHAR[]), ' ') AS match_words, array_to_string(CAST(h -> '$.left' -> '$.punct' AS VARCHAR[]), '|') AS left_punct FROM part"""
P1_RESPONSES = P1_PARTS + "SELECT response_id, json_extract_string(body, '$.summary.searchParam.patt') AS pattern, TRY_CAST(json_extract_string(body, '$.summary.numberOfHits') AS BIGINT) AS number_of_hits FROM good"

_TEXTS = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS VARCHAR[]) WHEN 'NULL' THEN NULL ELSE CASE WHEN {0} IS NOT NULL THEN [{0} ->> '$'] END END"
_SIDES = [(f"{p}_{a}", f"(h -> '$.{p}' -> '$.{a}')") for p in ("left", "match", "right") for a in ("word", "lemma", "pos", "punct")]
_CONTEXT = ", ".join(f"CAST(to_json({_TEXTS.format(x)}) AS VARCHAR) AS {name}" for name, x in _SIDES)
P1_WHOLE_HITS = P1_PARTS + f"""SELECT response_id, CAST(hit_no AS INTEGER) AS hit_no, CAST(NULL AS VARCHAR) AS hit_name, h ->> '$.docPid' AS doc_pid, {_INT.format('h', 'start', 'start_pos')}, {_INT.format('h', 'end', 'end_pos')},
  {_CONTEXT} FROM part"""
P1_WHOLE_INFOS = P1_PARTS + f""", x AS (SELECT *, CASE WHEN json_exists(o, '$.infos') THEN 'list' WHEN json_exists(o, '$.relType') OR json_exists(o, '$.targetStart') OR json_exists(o, '$.sourceStart') THEN 'relation'
  WHEN json_exists(o, '$.tagName') OR json_exists(o, '$.attributes') THEN 'tag' WHEN json_exists(o, '$.start') OR json_exists(o, '$.end') OR json_exists(o, '$.type') THEN 'span' ELSE 'plain' END AS variant FROM info WHERE json_type(o) = 'OBJECT')
SELECT response_id, variant, CAST(hit_no AS INTEGER) AS hit_no, CAST(NULL AS VARCHAR) AS hit_name, CAST(no AS INTEGER) AS item_no, item_name, o ->> '$.type' AS kind_type, o ->> '$.relType' AS rel_type, o ->> '$.tagName' AS tag_name,
  CASE WHEN json_type(o -> '$.attributes') = 'OBJECT' THEN CAST(to_json(list_sort(list_transform(map_entries(CAST(o -> '$.attributes' AS MAP(VARCHAR, JSON))), lambda e: {{'key': e.key, 'value': coalesce({_TEXTS.format('e.value')}, [])}}))) AS VARCHAR) END AS attributes,
  {', '.join(_INT.format('o', f, c) for f, c in (('start', 'start_pos'), ('end', 'end_pos'), ('sourceStart', 'source_start'), ('sourceEnd', 'source_end'), ('targetStart', 'target_start'), ('targetEnd', 'target_end')))} FROM x"""

P1_WHOLE_RELATIONS = P1_PARTS + f"""SELECT response_id, CASE WHEN json_exists(r, '$.sourceStart') THEN 'edge' WHEN json_exists(r, '$.targetStart') THEN 'target_only' ELSE 'plain' END AS variant, CAST(hit_no AS INTEGER) AS hit_no,
  CAST(NULL AS VARCHAR) AS hit_name, CAST(no AS INTEGER) AS item_no, item_name, CAST(item_no AS INTEGER) AS nested_no, r ->> '$.name' AS nested_name, r ->> '$.type' AS kind_type, r ->> '$.relType' AS rel_type,
  {', '.join(_INT.format('r', f, c) for f, c in (('sourceStart', 'source_start'), ('sourceEnd', 'source_end'), ('targetStart', 'target_start'), ('targetEnd', 'target_end')))},
  CAST(r ->> '$.isRoot' AS BOOLEAN) AS is_root FROM relation WHERE json_type(r) = 'OBJECT'"""
P1_VARIANTS = P1_PARTS + f""", d AS (SELECT response_id, json_extract(body, '$.docInfos') AS d FROM good), doc AS (
  SELECT response_id FROM (SELECT response_id, unnest(CAST(d AS JSON[])) AS o FROM d WHERE json_type(d) = 'ARRAY') WHERE json_type(o) = 'OBJECT'
  UNION ALL SELECT response_id FROM (SELECT response_id, unnest(json_keys(d)) AS k, d FROM d WHERE json_type(d) = 'OBJECT') WHERE json_type(json_extract(d, '$."' || k || '"')) = 'OBJECT'
) SELECT 'response' AS role, 'plain' AS variant, count(*) AS n FROM good HAVING count(*) > 0
UNION ALL SELECT 'hit', 'plain', count(*) FROM part HAVING count(*) > 0 UNION ALL SELECT 'doc', 'plain', count(*) FROM doc HAVING count(*) > 0
UNION ALL SELECT 'capture', 'plain', count(*) FROM capture WHERE json_type(o) = 'OBJECT' HAVING count(*) > 0
UNION ALL SELECT 'info', variant, count(*) FROM ({P1_WHOLE_INFOS}) GROUP BY variant UNION ALL SELECT 'relation', variant, count(*) FROM ({P1_WHOLE_RELATIONS}) GROUP BY variant"""


def p1_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(shred.RESPONSE, 0)(spark, sf_dir).drop("variant")


def p1_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shred.shred_responses(table(spark, sf_dir, "containing"), only=("hit",)).table(shred.HIT, 1)
    return rows.select("response_id", "hit_no", "doc_pid", "start_pos", "end_pos", F.array_join("match_word", " ").alias("match_words"), F.array_join("left_punct", "|").alias("left_punct"))


def p1_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shred.shred_responses(table(spark, sf_dir, "containing"), only=("info",)).table(shred.INFO, 2)
    who = F.element_at(F.col("attributes")["who"], 1)
    return rows.select("response_id", "variant", "hit_no", "item_name", "kind_type", "rel_type", "tag_name", who.alias("who"), "start_pos", "end_pos", "source_start", "target_end")


def p1_whole_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with all their columns, the twelve context arrays element by element, as JSON text."""
    return _table(shred.HIT, 1)(spark, sf_dir).drop("variant")


def p1_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(shred.RELATION, 3)(spark, sf_dir)
    return rows.select("response_id", "variant", "hit_no", "item_name", "nested_no", "kind_type", "rel_type", "target_start", "target_end", "is_root")


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects each subtype table holds."""
    return shred.shred_responses(table(spark, sf_dir, "containing")).supertype().groupBy("role", "variant").agg(F.count("*").alias("n"))


QUERIES = {
    "p1_found": p1_found,
    "p1_responses": p1_responses,
    "p1_hits": p1_hits,
    "p1_whole_hits": p1_whole_hits,
    "p1_whole_infos": _table(shred.INFO, 2),
    "p1_captures": _table(shred.CAPTURE, 2),
    "p1_infos": p1_infos,
    "p1_relations": p1_relations,
    "p1_variants": p1_variants,
}
SQL = {"p1_found": P1_SQL, "p1_responses": P1_RESPONSES, "p1_hits": P1_HITS, "p1_captures": P1_CAPTURES, "p1_infos": P1_INFOS, "p1_relations": P1_RELATIONS, "p1_whole_hits": P1_WHOLE_HITS, "p1_whole_infos": P1_WHOLE_INFOS, "p1_variants": P1_VARIANTS}
# one table per variant, with the columns that it can have
for _name, _role, _depth, _sql in (("infos", shred.INFO, 2, P1_WHOLE_INFOS), ("relations", shred.RELATION, 3, P1_WHOLE_RELATIONS)):
    for _variant in _role.variant_names:
        _places = [f"{x}_{y}" for x in shred.RESPONSE_LEVELS[:_depth] for y in ("no", "name")]
        _columns = ["response_id", "variant", *_places, *(c.name for c in _role.columns_of(_variant))]
        QUERIES[f"p1_{_name}_{_variant}"] = _table(_role, _depth, _variant)
        SQL[f"p1_{_name}_{_variant}"] = f"SELECT {', '.join(_columns)} FROM ({_sql}) WHERE variant = '{_variant}'"
