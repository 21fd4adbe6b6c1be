"""Nested responses into flat tables: forms of collections, damage, redelivery, nulls."""

import json
import random

import duckdb
import pytest

from spanloom.operators import shred
from spanloom.plans import core_queries

HIT = {"docPid": "d", "start": 1, "end": 3, "captureGroups": [{"name": "u", "start": "1", "end": 2}, None, {"name": None}], "matchInfos": {"u": {"type": "tag", "tagName": "u", "start": 1, "end": 2}, "void": None, "r": {"type": "list", "infos": [None, {"relType": "det", "targetStart": 1, "isRoot": False}]}}}
SCHEMA = "response_id bigint, body string, role string, item_name string"


def rows(spark, bodies, roles=("capture", "info", "relation")):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in bodies], SCHEMA)
    out = shred.shred_responses(df, roles).supertype().collect()
    return sorted((r.response_id, r.hit_no, r.role, str(r.item_name), r.nested_no if r.role == "relation" else 0) for r in out)


def test_forms(spark):
    body = json.dumps({"hits": [HIT]})
    want = [(1, 0, "capture", "None", 0), (1, 0, "capture", "u", 0), (1, 0, "info", "r", 0), (1, 0, "info", "u", 0), (1, 0, "relation", "r", 1)]
    assert rows(spark, [(1, body)]) == want
    assert rows(spark, [(1, json.dumps({"hits": HIT}))]) == want  # a lone hit
    assert rows(spark, [(1, "﻿\n" + body)]) == want
    assert rows(spark, [(1, json.dumps(body))]) == want  # JSON text in a JSON string
    assert rows(spark, [(1, body), (1, body)]) == want  # redelivered


def test_collections_by_name_and_lone(spark):
    lone = {"hits": [{"docPid": "d", "captureGroups": {"name": "A", "start": 1}, "matchInfos": [{"name": "B", "type": "span"}]}]}
    assert rows(spark, [(1, json.dumps(lone))]) == [(1, 0, "capture", "A", 0), (1, 0, "info", "B", 0)]
    keyed = {"hits": [{"docPid": "d", "captureGroups": {"start": {"start": 1, "end": 2}, "x": None, "B": {}}, "matchInfos": {"type": {"type": "span"}}}]}
    assert rows(spark, [(1, json.dumps(keyed))]) == [(1, 0, "capture", "B", 0), (1, 0, "capture", "start", 0), (1, 0, "info", "type", 0)]


def test_defects(spark):
    bad = [(1, None), (2, ""), (3, "null"), (4, "[1]"), (5, '{"hits": [{"docPid"'), (6, "{}"), (7, '{"hits": null}'), (8, '{"hits": [null, 3, "x"]}'), (None, '{"hits": []}'), (9, "[" * 100_000)]
    assert rows(spark, bad) == []
    assert rows(spark, []) == []
    long = {"hits": [dict(HIT, matchInfos={f"n{i}": {"type": "span"} for i in range(5000)})]}
    assert len(rows(spark, [(1, json.dumps(long))], ("info",))) == 5000


def test_equal_siblings_stay(spark):
    twice = {"hits": [{"docPid": "d", "captureGroups": [{"name": "u"}, {"name": "u"}]}]}
    assert rows(spark, [(1, json.dumps(twice)), (1, json.dumps(twice))]) == [(1, 0, "capture", "u", 0)] * 2


def test_subtypes_and_types(spark):
    df = spark.createDataFrame([(1, json.dumps({"summary": {"numberOfHits": "7"}, "hits": [HIT], "docInfos": {"d": {"title": "t", "lengthInTokens": 5, "mayView": True}}}))], "response_id bigint, body string")
    out = shred.shred_responses(df)
    info = out.subtype(shred.INFO, "tag", 2).collect()
    assert [(r.item_name, r.tag_name, r.start_pos, r.hit_no) for r in info] == [("u", "u", 1, 0)]
    cap = {r.item_name: r.start_pos for r in out.table(shred.CAPTURE, 2).collect()}
    assert cap == {"u": 1, None: None}  # numbers given as text are numbers
    doc = out.subtype(shred.DOC, "plain", 1).first()
    assert (doc.hit_name, doc.title, doc.length_tokens, doc.may_view) == ("d", ["t"], 5, True)
    assert out.table(shred.RESPONSE, 0).first().number_of_hits == 7


def test_subtypes_written_in_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(1, json.dumps({"hits": [HIT]})), (1, json.dumps({"hits": [HIT]}))], "response_id bigint, body string")
    out = shred.shred_responses(df)
    out.write(str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t" / "role=info").iterdir()} == {"variant=tag", "variant=list"}
    for role, variant in (("info", "tag"), ("info", "list"), ("relation", "target_only"), ("capture", "plain")):
        role = {r.name: r for r in shred.RESPONSE_ROLES}[role]
        got = shred.read_subtype(spark, str(tmp_path / "t"), "response_id", role, variant, shred.RESPONSE_LEVELS)
        want = out.subtype(role, variant)
        plain = lambda d: sorted(map(str, d.drop("attributes").collect()))
        assert got.columns == want.columns and plain(got) == plain(want) != []


def test_what_is_not_routed_is_not_found(spark, monkeypatch):
    bodies = [(1, json.dumps({"hits": [HIT]}))]
    assert [r[2] for r in rows(spark, bodies)] == ["capture", "capture", "info", "info", "relation"]
    # relations of a variant whose table isn't wanted lie in no table, and so aren't found
    df = spark.createDataFrame(bodies, "response_id bigint, body string")
    wanted = [(r.name, v) for r in shred.RESPONSE_ROLES for v in r.variant_names if (r.name, v) not in (("relation", "target_only"), ("info", "tag"))]
    left = shred.shred(df, "response_id", "body", shred.RESPONSE_ROLES, "response", shred.RESPONSE_LEVELS, wanted).supertype().collect()
    assert sorted((r.role, r.variant) for r in left) == [("capture", "plain"), ("capture", "plain"), ("hit", "plain"), ("info", "list"), ("response", "plain")]


def test_deep_and_wrapped_bodies(spark):
    deep = lambda n: "[" * n + "]" * n
    body = json.dumps({"hits": [HIT]})
    want = [(1, 0, "capture", "None", 0), (1, 0, "capture", "u", 0), (1, 0, "info", "r", 0), (1, 0, "info", "u", 0), (1, 0, "relation", "r", 1)]
    for n in (1_200, 5_000, 50_000):
        assert rows(spark, [(1, body[:-1] + f', "odd": {deep(n)}' + "}")]) == want
        assert rows(spark, [(1, body.replace('"tagName": "u"', f'"tagName": {deep(n)}'))]) == want
    wrapped = body
    for _ in range(10):
        wrapped = json.dumps(wrapped)
    assert rows(spark, [(1, wrapped)]) == want
    assert rows(spark, [(1, body.replace('"tagName": "u"', '"odd": ' + "9" * 6_000))]) == want  # a number of 6,000 digits
    assert rows(spark, [(1, body.replace('"start": 1, "end": 3', '"start": ' + "9" * 6_000))]) == want
    assert rows(spark, [(1, '{"hits": ' + "[" * 50_000 + "]" * 49_999 + "}")]) == []
    assert rows(spark, [(1, body.replace('"tagName": "u"', '"tagName": "\\ud800"'))]) == want  # half a surrogate pair


def test_parsing_deep_json_equals_the_decoder():
    r = random.Random(3)

    def tree(d):
        k = r.randint(0, 7)
        if not d or k < 3:
            return r.choice([None, True, 1, -2.5, 'a"b\\é ', "", {}, []])
        return [tree(d - 1) for _ in range(r.randint(0, 3))] if k < 5 else {f"k{i}": tree(d - 1) for i in range(r.randint(0, 3))}

    for _ in range(500):
        value = tree(5)
        text = json.dumps(value, indent=r.choice([None, 1]))
        assert shred._parse_deep(text) == value and shred._dump_deep(value) == json.dumps(value, ensure_ascii=False)
        i = r.randrange(len(text))
        for bad in (text[:i], text[:i] + r.choice(",}]:x") + text[i + 1 :]):
            try:
                expected = json.loads(bad)
            except ValueError:
                with pytest.raises(ValueError):
                    shred._parse_deep(bad)
            else:
                assert shred._parse_deep(bad) == expected


def test_whole_hits_and_infos(spark, tmp_path):
    info = {"type": "relation", "attributes": {"who": ["a", "b"], "mood": "calm", "no": None}, "sourceStart": 1, "sourceEnd": "2", "targetStart": 3, "targetEnd": 4}
    hit = {"docPid": "d", "start": 1, "left": {"word": ["a b", "c"], "lemma": [None, "c"]}, "right": {"pos": [""], "punct": "lone"}, "matchInfos": {"r": info}}
    spark.createDataFrame([(1, json.dumps({"hits": [hit]}))], "response_id bigint, body string").write.parquet(str(tmp_path / "containing.parquet"))
    q = core_queries.QUERIES
    h = q["p1_whole_hits"](spark, str(tmp_path)).first()
    assert (h.left_word, h.left_lemma, h.right_pos, h.right_punct, h.match_word) == ('["a b","c"]', '[null,"c"]', '[""]', '["lone"]', None)
    i = q["p1_whole_infos"](spark, str(tmp_path)).first()
    assert json.loads(i.attributes) == [{"key": "mood", "value": ["calm"]}, {"key": "no", "value": []}, {"key": "who", "value": ["a", "b"]}]
    assert (i.hit_no, i.item_no, i.item_name, i.source_start, i.source_end, i.target_start, i.target_end) == (0, 0, "r", 1, 2, 3, 4)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW containing AS SELECT * FROM '{tmp_path}/containing.parquet/*.parquet'")
    assert con.execute(core_queries.SQL["p1_whole_hits"]).fetchall() == [tuple(h)]
    assert con.execute(f"SELECT source_end, target_start, json_array_length(attributes), attributes -> '$[2].value' FROM ({core_queries.SQL['p1_whole_infos']})").fetchall() == [(2, 3, 3, '["a","b"]')]


def test_a_table_per_variant(spark, tmp_path):
    infos = {"t": {"tagName": "u", "start": 1}, "r": {"relType": "det", "sourceStart": 1}, "s": {"start": 1}, "p": {"targetEnd": 2}}
    infos["l"] = {"infos": [{"sourceStart": 1, "targetStart": 2}, {"targetStart": 1, "isRoot": True}, {"isRoot": True, "targetEnd": 5}]}
    spark.createDataFrame([(1, json.dumps({"hits": [{"docPid": "d", "matchInfos": infos}]}))], "response_id bigint, body string").write.parquet(str(tmp_path / "containing.parquet"))
    get = {q: f(spark, str(tmp_path)) for q, f in core_queries.QUERIES.items() if q.startswith(("p1_infos_", "p1_relations_"))}
    assert {q: d.count() for q, d in get.items()} == {"p1_infos_list": 1, "p1_infos_relation": 1, "p1_infos_tag": 1, "p1_infos_span": 1, "p1_infos_plain": 1, "p1_relations_edge": 1, "p1_relations_target_only": 1, "p1_relations_plain": 1}
    assert all(v for role in shred.RESPONSE_ROLES for _, v in role.variants)  # each variant can be chosen
    assert "source_start" not in get["p1_relations_target_only"].columns and get["p1_relations_target_only"].first().is_root
    assert "tag_name" not in get["p1_infos_span"].columns and get["p1_infos_tag"].first().tag_name == "u"
    assert get["p1_infos_plain"].first().target_end == 2 and get["p1_relations_plain"].first().target_end == 5


def test_automaton_is_finite():
    s = shred.Shredder(shred.RESPONSE_ROLES, "response")
    for i in range(200):
        list(s.objects({"hits": [dict(HIT, matchInfos={f"name{i}": {"type": "span", f"odd{i}": i}})]}))
        list(s.objects({"hits": [{"odd": json.loads("[" * (i + 1) + "]" * (i + 1))}], "matchInfos": {"infos": [{"infos": []}] * i}}))
    assert len(s.automaton.shape) < 60
