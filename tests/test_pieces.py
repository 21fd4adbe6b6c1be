"""Files that are read in pieces and documents that come in parts: the same as whole ones, and no part grows with its document."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import results as rs
from spanloom.plans import source_queries as sq
from spanloom.plans.compiler import Tables
from spanloom.sources import loaders, parsers
from spanloom.sources.descriptor import BUNDLED
from spanloom.sources.held import Ids, Spool

CONLLU = BUNDLED["conll-u"]
N = 12_000


def sentence(n=N):
    yield "# newdoc id = 7\n"
    for i in range(n):
        yield f"{i + 1}\tw{i}\t_\tNN\t_\t_\t{n - i - 1}\tx\t_\t_\n"
    yield "\n"


def xml(n=N, tail="</layer></doc></all>"):
    yield '<?xml version="1.0"?>\n<all><doc pid="7"><meta><f n="size" v="é"/></meta><text>'
    for i in range(n):
        yield f'<w id="w{i}" w="é{i}" l="l" p="NN"/>\n'
    yield "</text><layer>"
    for i in range(0, n - 1, 2):
        yield f'<span type="s" from="w{i}" to="#w{i + 1}"/><link type="ends" from="w{i}" to="#w{i + 1}"/>\n'
    yield tail


def shown(documents):
    return [(d.metadata, d.tokens, d.spans, d.relations, d.raw) for d in documents]


def bounded(found):
    for p in found:
        assert max(map(len, (p.tokens, p.spans, p.relations))) <= 2 * parsers.PART and len(p.raw or "") <= parsers.BLOCK
    assert [p.part for p in found] == list(range(len(found))) and len(found) > 5 and [p.last for p in found].count(True) == 1


def test_a_long_sentence_comes_in_parts():
    """tokens, relations and the document of one sentence."""
    found = list(parsers.parts(sentence(), CONLLU))
    bounded(found)
    (d,) = parsers.joined(found)
    assert [t[0]["word"] for t in d.tokens] == [[f"w{i}"] for i in range(N)] and d.metadata == {"pid": ["7"]} and d.raw == "".join(sentence())
    heads = [(r[2], r[4]) for r in d.relations]
    assert heads == [(N - i - 2 if i < N - 1 else None, i) for i in range(N)] and d.spans == [("s", 0, N, {})]
    assert d.raw[d.tokens[5][2] : d.tokens[5][3]].startswith("6\tw5")


def test_large_xml_comes_in_parts():
    """F2, F3, F4, F6, F8: the same as from the tree."""
    found = list(parsers.parts(xml(), sq.XML))
    bounded(found)
    assert shown(parsers.joined(found)) == shown(parsers.PARSERS["xml"]("".join(xml()), sq.XML))


ODD = """<?xml version="1.0"?>
<all>é<doc pid="1"><meta><f n="size" v="é3"/></meta><text>ab<w id="w0" w="é" l="b" p="c"/>
<anchor id="k"/><w id="w1" w="x>'" l='"' p="c"></w>
 <w id="w3" w="q" p="c"><z/></w><w id="w3" w="r" l="" p="c"/><!-- <w/> --><anchor id="e"/></text><layer>u<span type="s" from="w0" to="#w3"/><link type="ends" from="w9" to="#w1"/>
<link type="ends" from="w3" to="#w1"/><span type="s" from="k" to="e"/><span from="w0" to="w0"/>t</layer></doc><doc pid="2"/><doc><text/><meta><f n="a" v=""/></meta></doc></all>"""
NESTED = '<all><doc><text><w id="a" w="1" l="2" p="3"><w id="b" w="4" l="5" p="6"/></w></text></doc></all>'


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 4096])
def test_pieces_of_xml(size, monkeypatch):
    monkeypatch.setattr(parsers, "PIECE", size)
    got = parsers.joined(parsers.parts((ODD[i : i + size] for i in range(0, len(ODD), size)), sq.XML))
    assert shown(got) == shown(parsers.PARSERS["xml"](ODD, sq.XML))
    assert shown(parsers.parse(NESTED, sq.XML)) == shown(parsers.PARSERS["xml"](NESTED, sq.XML))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_pieces_of_lines(size, monkeypatch):
    text = "# newdoc\r\n# newdoc id = a\r\n1\tA\t_\r\n2-3\tb\r\n2\tB\tb\tX\t_\t_\t3\tr\t_\tSpaceAfter=No\r\n3\tC\t_\t_\t_\t_\t0\troot\r\n3\tD\t_\t_\t_\t_\t2\tq\r\n\r\n1\tE\r\n# newdoc id = b\r\n"
    want = shown(parsers.parse(text, CONLLU))
    monkeypatch.setattr(parsers, "PIECE", size)
    assert shown(parsers.joined(parsers.parts((text[i : i + size] for i in range(0, len(text), size)), CONLLU))) == want
    assert [len(d[1]) for d in want] == [5, 0] and want[0][3] == [("dep", "r", 3, 4, 1, 2, {}), ("dep", "root", None, None, 3, 4, {}), ("dep", "q", 1, 2, 3, 4, {})]


def test_ids_and_spools():
    keys = ["w1", "w2", "x", "w2", "w3", "w09", "w10", "w010", "7", "8", "a7", "8", "0", "w0", "9" * 15, "1" + "0" * 15, *(f"w{i}" for i in range(100, 140, 2)), "w101", "w100"]
    ids, want = Ids(), {}
    for at, k in enumerate(keys):
        ids.put(k, at)
        want[k] = at
        assert all(ids.get(x) == y for x, y in want.items()), k
    assert ids.get("w4") is None and ids.get("") is None and ids.get("w") is None
    s = Spool(3)
    for i in range(10):
        s.append(i)
    assert list(s) == list(s) == list(range(10))


def files(spark, *given):
    rows = [(path, n, x) for path, texts in given for n, x in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, n int, content string").repartition("path").sortWithinPartitions("path", "n").select("path", "content")


def test_loading_in_pieces(spark):
    """Rows hold parts; a file that breaks off behind many parts gives its error alone."""
    parsed = loaders.documents(files(spark, ("a", list(xml())), ("b", list(xml(tail="</layer>"))), ("c", ["<all><doc pid='9'/></all>"])), sq.XML, pieces=True)
    x = loaders.Loaded(parsed, sq.XML)
    assert x.parsed.where("path = 'a'").count() > 5 and x.parsed.select(F.max(F.size("tokens"))).first()[0] <= 2 * parsers.PART
    assert [(r.path, r.error[:10]) for r in x.errors().collect()] == [("b", "ParseError")]
    docs = {r.path: r for r in x.docs().collect()}
    assert set(docs) == {"a", "c"} and docs["a"].length_tokens == N and docs["a"].pid == "7" and docs["a"].metadata["size"] == ["é"]
    assert docs["a"].raw == "".join(xml()).removeprefix('<?xml version="1.0"?>\n<all>').removesuffix("</all>")
    assert x.tokens().agg(F.count_distinct("pos"), F.max("pos"), F.count("*")).first()[:] == (N, N - 1, N)
    assert x.relations().select("rel_id").distinct().count() == N // 2 and x.spans().count() == N // 2
    hits = x.docs().where("path = 'a'").select("doc_id").join(spark.range(0, N, 97).select(F.col("id").cast("int").alias("start_pos")), how="cross").withColumn("end_pos", F.col("start_pos") + 1)
    t = Tables(x.tokens(), None, None, {"word": "word"})
    one, two = ({tuple(r) for r in rs.original_concordance(raw, hits, t, 900, 900).collect()} for raw in (x.originals(), x.docs()))
    assert one == two and len(one) == len(range(0, N, 97))
    x.parsed.unpersist()
