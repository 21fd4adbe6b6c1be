"""Loading, writing, incremental loading and the corpus handle."""

import io
import tarfile
import zipfile

import pytest

from spanloom.corpus import Corpus
from spanloom.functions import analyzers, process
from spanloom.sources import descriptor, loaders, parsers, paths, sinks, text, transcripts
from spanloom.streaming import ingest
from pyspark.sql import functions as F

CONLLU = """# newdoc id = d1
# sent_id = 1
1\tThe\tthe\tDET\t_\t_\t2\tdet\t_\t_
2\tdog\tdog\tNOUN\t_\t_\t3\tnsubj\t_\t_
3\tbarks\tbark\tVERB\t_\t_\t0\troot\t_\tSpaceAfter=No
4\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_

# newdoc id = d2
1\tHi\thi\tINTJ\t_\t_\t0\troot\t_\t_
"""

TEI = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>A  title</title></titleStmt></teiHeader>
<text><body><p n="1"><s><w xml:id="w1" lemma="the">The</w> <w xml:id="w2" lemma="dog" pos="NN">dog</w></s></p></body></text></TEI>"""

STANDOFF = """<TEI><text><anchor synch="T1"/><w id="w1" lemma="Kris">Kris</w><w id="w2">Kringle</w><anchor synch="T2"/>
<spanGrp type="character" subtype="time"><span from="T1" to="T2">Santa Claus</span></spanGrp><w id="w3">Oschter</w><w id="w4">Haws</w>
<spanGrp type="character"><span from="w3" to="w4">Easter Bunny</span></spanGrp><link from="w1" to="w2" type="flat"/></text></TEI>"""


def test_conllu():
    a, b = parsers.parse(CONLLU, descriptor.BUNDLED["conll-u"])
    assert [t[0]["word"][0] for t in a.tokens] == ["The", "dog", "barks", "."] and a.metadata == {"pid": ["d1"]}
    assert [t[1] for t in a.tokens] == ["", " ", " ", ""]
    assert ("dep", "root", None, None, 2, 3, {}) in a.relations and ("dep", "det", 1, 2, 0, 1, {}) in a.relations
    assert a.spans[0][:3] == ("s", 0, 4) and len(b.tokens) == 1


def test_tables():
    tsv = parsers.parse('word\tlemma\tpos\nThe\tthe\tDT\n"do""g"\tdog\tNN\n', descriptor.BUNDLED["tsv"])[0]
    assert [t[0] for t in tsv.tokens] == [{"word": ["The"], "lemma": ["the"], "pos": ["DT"]}, {"word": ['do"g'], "lemma": ["dog"], "pos": ["NN"]}]
    docs = parsers.parse('<doc id="x">\n<s>\nDon\tVB\tdo\n<g/>\n\'t\tRB\tnot\n</s>\n</doc>\n<doc id="y">\nA\tDT\ta\n</doc>\n', descriptor.BUNDLED["sketch-wpl"])
    assert [d.metadata for d in docs] == [{"id": ["x"]}, {"id": ["y"]}] and docs[0].spans == [("s", 0, 2, {})] and docs[0].tokens[1][1] == ""
    assert parsers.parse("", descriptor.BUNDLED["tsv"])[0].tokens == []


def test_chat():
    d = parsers.parse("@Languages:\teng\n@ID:\teng|c|CHI|2;03.10|male|||Target_Child|||\n*CHI:\tI want [/] want &-um dat [: that] .\n%mor:\tpro|I v|want pro|that .\n@End\n", descriptor.BUNDLED["chat"])[0]
    assert [t[0]["word"][0] for t in d.tokens] == ["I", "want", "want", "that", "."]
    assert [t[0].get("pos") for t in d.tokens] == [["pro"], None, ["v"], ["pro"], ["."]] and d.tokens[3][0]["lemma"] == ["that"]
    assert d.spans == [("u", 0, 5, {"who": "CHI", "uttid": "1", "language": "eng", "corpus": "c", "age": "2;03.10", "months": "27", "sex": "male", "role": "Target_Child"})]


SAID = {
    "the (be)cause I (.) go (1.5) now .": "the because I go now .",
    "<I want> [//] I need <a big> [?] dog [*] !": "I want I need a big dog !",
    "no 0is &=laughs xxx www [+ bch] .": "no is xxx .",
    "hap@o New_York wo^rd it~is +/.": "hap NewYork word it is",
    "+< yes [= I mean so] , mommy [!!] ↑now ?": "yes , mommy now ?",
    "goed [: went ran] [x 3] <to the> [<] [% comment]": "went ran to the",
    "well \x15100_200\x15 \x150\x15 done +...": "well done",
    "": "",
}


@pytest.mark.parametrize("said", list(SAID))
def test_utterances(said):
    assert " ".join(w for w, _ in transcripts.words_of(said)) == SAID[said]


def test_headers_hold_until_they_change():
    text = "@Begin\n@Participants:\tCHI Sara Target_Child, MOT Mother\n@Date:\t14-JUN-1998\n@Birth of CHI:\t01-jan-1996\n*MOT:\thi\n\tthere .\n@New Episode\n@Situation:\tat home\n*CHI:\they .\n@New Episode\n*CHI:\tyes .\n"
    d = parsers.parse(text, descriptor.BUNDLED["chat"])[0]
    a, b, c = (attrs for _, _, _, attrs in d.spans)
    assert a == {"who": "MOT", "uttid": "1", "date": "1998-06-14", "role": "Mother"} and [t[0]["word"][0] for t in d.tokens[:3]] == ["hi", "there", "."]
    assert b["new_episode"] == "1" and b["situation"] == "at home" and (b["name"], b["birth_of"]) == ("Sara", "1996-01-01") and c["new_episode"] == "2"
    assert (transcripts.months("3;6.14"), transcripts.months("2"), transcripts.months("x"), transcripts.iso_date("soon")) == (42, 24, None, "soon")


def test_xml_and_standoff():
    d = parsers.parse(TEI, descriptor.BUNDLED["tei-p5"])[0]
    assert d.metadata["title"] == ["A title"] and d.tokens[1][0] == {"word": ["dog"], "lemma": ["dog"], "pos": ["NN"]}
    assert ("s", 0, 2, {}) in d.spans and ("p", 0, 2, {"n": "1"}) in d.spans
    form = descriptor.from_dict(
        "x",
        {"documentPath": "//TEI", "annotatedFields": {"contents": {"containerPath": ".//text", "wordPath": ".//w", "tokenIdPath": "@id", "annotations": [{"name": "word", "valuePath": "."}],
         "standoffAnnotations": [{"path": ".//spanGrp/span", "spanStartPath": "@from", "spanEndPath": "@to", "spanNamePath": "../@type", "annotations": [{"name": "v", "valuePath": "."}]}, {"path": ".//link", "type": "relation", "sourcePath": "@from", "targetPath": "@to", "valuePath": "@type"}]}}},
    )
    d = parsers.parse(STANDOFF, form)[0]
    assert d.spans == [("character", 0, 2, {"v": "Santa Claus"}), ("character", 2, 4, {"v": "Easter Bunny"})]
    assert d.relations == [("rel", "flat", 0, 1, 1, 2, {})]


def test_paths():
    t = paths.parse("<a><b x='1'>one</b><b x='2' y='z'>two<c/></b><d><b>three</b></d></a>")
    r = t.root
    assert t.values(r, "b") == ["one", "two"] and t.values(r, ".//b") == ["one", "two", "three"] and t.values(r, "b[@x='2']") == ["two"]
    assert t.values(r, "b[not(@y)]/@x") == ["1"] and t.values(r, "b[2]") == ["two"] and t.values(r, "//d/b|b[1]") == ["three", "one"] and t.value(r, "zz|@q|d") == "three"
    assert t.values(r, ".//*[self::b or self::c]/name()") == ["b", "b", "c", "b"]


def test_load_write_and_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("x.conllu", CONLLU)
    data = CONLLU.replace("d1", "d3").replace("d2", "d4").encode()
    with tarfile.open(tmp_path / "in/b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.conllu")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    loaded = loaders.load(spark, str(tmp_path / "in"), "conll-u")
    assert loaded.errors().count() == 0 and sorted(r.pid for r in loaded.docs().collect()) == ["d1", "d2", "d3", "d4"]
    out = str(tmp_path / "corpus")
    sinks.write_corpus({"docs": loaded.docs(), "tokens": loaded.tokens(), "spans": loaded.spans(), "relations": loaded.relations()}, out)
    c = Corpus.open(spark, out)
    assert c.search("'dog' 'barks'").frame.count() == 2
    assert c.search("[pos='VERB'] -nsubj-> 'dog'").frame.count() == 2
    assert c.search("^-root-> 'hi'").frame.count() == 2
    assert c.search("'dog'", "pid:d1").frame.count() == 1
    assert c.search('lemma="dog" and metadata.pid=d3', language="contextql").frame.count() == 1
    assert c.search("'@@'", gaps="dog\nhi\n").frame.count() == 4
    k = c.search("'dog'").sort("field:pid").window(0, 1).kwic(["word"], 1, 1).first()
    assert (k.left_word, k.match_word, k.right_word) == (["The"], ["dog"], ["barks"])
    assert c.describe()["documents"] == 4 and c.relation_statistics().count() > 3
    assert sinks.csv_text(c.search("'dog'").count(), True) == "sep=,\r\nhits,docs\r\n2,2\r\n"
    sinks.write_csv(c.search("'dog'").kwic(), str(tmp_path / "csv"))
    sinks.write_frequency_list(c.termfreq(), str(tmp_path / "freq"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "freq")).count() == 5
    left = sinks.delete_documents({"docs": c.docs, "tokens": c.tables.tokens}, "pid:d1")
    assert left["docs"].count() == 3 and left["tokens"].count() == 6
    c.register("double", lambda x: __import__("spanloom.plans.nodes", fromlist=["Seq"]).Seq((x, x)))
    assert c.search("double('dog')").frame.count() == 0
    assert "Scan parquet" in c.search("'dog'").explain()


def test_bad_files_are_reported(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<TEI><text>")
    loaded = loaders.load(spark, str(tmp_path), "tei-p5")
    assert loaded.errors().count() == 1 and loaded.docs().count() == 0
    with pytest.raises(descriptor.FormatError):
        loaders.load(spark, str(tmp_path), "nosuchformat")


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i in range(2):
        (tmp_path / f"in/{i}.txt").write_text(f"some words number {i}")
        ingest.watch(spark, str(tmp_path / "in"), "txt", out, check).awaitTermination()
    assert ingest.read(spark, out, "docs").count() == 2 and ingest.read(spark, out, "tokens").count() == 8
    stream = spark.readStream.schema("doc_id bigint, pos int, word string").parquet(out + "/tokens/batch=0")
    q = ingest.standing_token_query(stream, "'w.*'").writeStream.format("memory").queryName("standing").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("standing").count() == 1


def test_steps(spark):
    df = spark.createDataFrame([("a;b", "2020", "2", None), ("", None, None, None), (None, "19", "x", "31")], "v string, y string, m string, d string")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(process.apply_all(F.col("v"), [{"action": "split", "separator": ";", "keep": "both"}])) == [["a;b", "a", "b"], [""], None]
    assert get(process.apply(F.col("v"), [{"action": "default", "field": "y"}])) == ["a;b", None, "19"]
    assert get(process.apply(F.col("v"), [{"action": "append", "field": "y", "separator": "-", "prefix": "y"}])) == ["a;b-y2020", "", "y19"]
    assert get(process.concat_date(F.col("y"), F.col("m"), F.col("d"), "end")) == ["20200229", None, "00191231"]
    ages = spark.createDataFrame([("2;3.10",), ("1;0.20",), (None,)], "a string").select(process.chat_age_to_months(F.col("a")))
    assert [r[0] for r in ages.collect()] == ["27", "13", None]
    pos = spark.createDataFrame([("N(type=com,num=sg)",)], "p string")
    assert pos.select(process.apply(F.col("p"), [{"action": "parsePos", "field": "num"}]), process.apply(F.col("p"), [{"action": "parsePos"}])).first()[:] == ("sg", "N")
    with pytest.raises(process.StepError):
        process.apply(F.col("v"), [{"action": "nosuch"}])
    terms = df.select(analyzers.analyze(F.lit("Café-au Lait!"))).first()[0]
    assert terms == ["cafe-au", "lait"]


def test_offsets(spark):
    df = spark.createDataFrame([(1, "Ab, cd!"), (2, ""), (3, None)], "doc_id int, text string")
    rows = [tuple(r) for r in text.tokens_with_offsets(df, "doc_id", "text").collect()]
    assert rows == [(1, 0, "Ab", "", 0, 2), (1, 1, "cd", ", ", 4, 6)]


def test_originals_and_offsets():
    """A token's characters in the document's original are its own, in every format."""
    text = '<a>\n<doc pid="1"><w l="é">Ä é</w> <w>b</w></doc><doc pid="2"><s><w>c&amp;</w></s></doc></a>'
    docs = parsers.parse(text, descriptor.BUNDLED["testformat"])
    assert [d.raw for d in docs] == ['<doc pid="1"><w l="é">Ä é</w> <w>b</w></doc>', '<doc pid="2"><s><w>c&amp;</w></s></doc>']
    assert [d.raw[a:z] for d in docs for _, _, a, z in d.tokens] == ['<w l="é">Ä é</w>', "<w>b</w>", "<w>c&amp;</w>"]
    a, b = parsers.parse(CONLLU, descriptor.BUNDLED["conll-u"])
    assert a.raw + b.raw == CONLLU and b.raw.startswith("# newdoc id = d2")
    assert [a.raw[x:z].split("\t")[1] for _, _, x, z in a.tokens] == ["The", "dog", "barks", "."]
    x, y = parsers.parse('<doc id="x">\nDon\tVB\tdo\n</doc>\n<doc id="y">\nA\tDT\ta\n</doc>', descriptor.BUNDLED["sketch-wpl"])
    assert x.raw == '<doc id="x">\nDon\tVB\tdo\n</doc>' and y.raw == '<doc id="y">\nA\tDT\ta\n</doc>' and [y.raw[p:q] for _, _, p, q in y.tokens] == ["A\tDT\ta"]
    t = parsers.parse('word\tlemma\tpos\r\nThe\tthe\tDT\r\n"do\nor"\tdog\tNN\r\n', descriptor.BUNDLED["tsv"])[0]
    assert [t.raw[p:q] for _, _, p, q in t.tokens] == ["The\tthe\tDT", '"do\nor"\tdog\tNN']
    c = parsers.parse("@Begin\n*CHI:\tI want want dat [: that] .\n", descriptor.BUNDLED["chat"])[0]
    assert [c.raw[p:q] for _, _, p, q in c.tokens] == ["I", "want", "want", "that", "."]


def test_commands():
    text = "# all\nDOC_START\n METADATA title A test # here\n FIELD_START contents\n VAL word The\n VAL lemma the\n ADVANCE 1\n VAL word fox\n ADVANCE 2\n VAL word jumps\n SPAN ne 0 2\n FIELD_END\nDOC_END\n"
    (d,) = parsers.parse(text, descriptor.BUNDLED["commands"])
    assert [t[0] for t in d.tokens] == [{"word": ["The"], "lemma": ["the"]}, {"word": ["fox"]}, {}, {"word": ["jumps"]}] and d.spans == [("ne", 0, 2, {})] and d.metadata == {"title": ["A test"]}
    with pytest.raises(descriptor.FormatError):
        parsers.parse("DOC_START\nJUMP 1\n", descriptor.BUNDLED["commands"])


PARALLEL = {
    "documentPath": "//doc", "metadata": {"fields": [{"name": "pid", "valuePath": "@id"}]},
    "annotatedFields": {
        "contents__en": {"containerPath": "en", "wordPath": ".//w", "tokenIdPath": "@id", "annotations": [{"name": "word", "valuePath": "."}, {"forEachPath": "f", "namePath": "@n", "valuePath": "@v"}],
         "inlineTags": [{"path": ".//s", "extraAttributes": [{"name": "words", "valuePath": "count(w)"}]}], "standoffAnnotations": [{"path": "al", "type": "relation", "sourcePath": "@a", "targetPath": "@b", "relationClass": "al", "valuePath": "@t"}]},
        "contents__nl": {"containerPath": "nl", "wordPath": ".//w", "tokenIdPath": "@id", "annotations": [{"name": "word", "valuePath": "."}]},
    },
}


def test_parallel_fields(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<r><doc id="d"><en><s><w id="e1">the</w><w id="e2">cat<f n="num" v="sg"/></w></s></en><nl><w id="n1">de</w><w id="n2">kat</w></nl><al a="e2" b="n2" t="word"/></doc></r>')
    form = descriptor.from_dict("parallel", PARALLEL)
    loaded = loaders.load(spark, str(tmp_path), form)
    assert loaded.errors().count() == 0 and [(r.pid, r.length_tokens) for r in loaded.docs().collect()] == [("d", 2)]
    c = Corpus(loaded.tables(), loaded.docs())
    assert c.search("'cat' ==>nl 'kat'").frame.count() == 1 and c.search("'the' ==>nl 'kat'").frame.count() == 0
    assert c.search("[num='sg']").frame.count() == 1 and c.search("<s words='2'/>").frame.count() == 1
    assert [r.word for r in loaded.tokens("contents__nl").orderBy("pos").collect()] == ["de", "kat"]


def test_linked_documents_and_includes(spark, tmp_path):
    (tmp_path / "in").mkdir(), (tmp_path / "meta").mkdir(), (tmp_path / "parts").mkdir()
    (tmp_path / "parts/body.xml").write_text("<?xml version='1.0'?><s><w>in</w><w>here</w></s>")
    for i in (1, 2, 3):
        (tmp_path / f"in/{i}.xml").write_text(f'<doc pid="d{i}"><ext id="m{i}"/><xi:include xmlns:xi="http://www.w3.org/2001/XInclude" href="../parts/body.xml"/></doc>')
    for i in (1, 2):
        (tmp_path / f"meta/m{i}.xml").write_text(f"<CMD><Components><speaker>S{i}</speaker><pid>no</pid></Components></CMD>")
    base = {"documentPath": "//doc", "annotatedFields": {"contents": {"wordPath": ".//w"}}, "metadata": {"fields": [{"name": "pid", "valuePath": "@pid"}, {"name": "speaker", "valuePath": "none"}]}}
    link = {"linkValues": [{"valuePath": "ext/@id"}], "inputFile": f"{tmp_path}/meta/$1.xml", "inputFormat": "cmdi"}
    loaded = loaders.load(spark, str(tmp_path / "in"), descriptor.from_dict("x", base | {"linkedDocuments": {"metadata": link | {"ifLinkPathMissing": "ignore"}}}))
    rows = {r.pid: r for r in loaded.docs().collect()}
    assert {p: r.speaker for p, r in rows.items()} == {"d1": "S1", "d2": "S2", "d3": None} and all(r.length_tokens == 2 for r in rows.values())
    strict = loaders.load(spark, str(tmp_path / "in"), descriptor.from_dict("x", base | {"linkedDocuments": {"metadata": link}}))
    assert strict.docs().count() == 2 and "m3.xml" in strict.errors().first().error


def test_archives_are_spread(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep words here")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(20):
            z.writestr(f"f{i}.txt", f"word {i}")
        z.writestr("b.zip", inner.getvalue())
    (tmp_path / "plain.txt").write_text("plain words")
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    loaded = loaders.load(spark, str(tmp_path), "txt")
    assert loaded.docs().count() == 22 and loaded.errors().count() == 1
    assert loaders.read_files(spark, str(tmp_path)).where("path LIKE '%.zip/%'").rdd.glom().filter(len).count() > 1


def test_snippets_from_xml_originals(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<doc pid="d"><s><w l="the">The</w> <w>old</w>, <w>cat</w> <w>sat</w></s></doc>')
    loaded = loaders.load(spark, str(tmp_path), "testformat")
    t = loaded.tables()
    from spanloom.operators import results as rs
    from spanloom.plans.compiler import run

    s = rs.snippet(loaded.docs(), run("'old'", t), t, 1, 1).first().snippet
    assert s == '<w l="the">The</w> <w>old</w>, <w>cat</w>'


def test_tool_contents_and_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.xml").write_text('<all><doc pid="d" title="A"><s><w l="the">The</w> <w>old</w>, <w>cat</w> <w>sat</w></s></doc><doc pid="e" title="B"><w>old</w></doc></all>')
    loaded = loaders.load(spark, str(tmp_path / "in"), "testformat")
    out = str(tmp_path / "corpus")
    sinks.write_corpus({"docs": loaded.docs(), "tokens": loaded.tokens(), "spans": loaded.spans(), "relations": loaded.relations()}, out)
    c = Corpus.open(spark, out)
    h = c.search("'old'")
    assert h.contents("d") == '<doc pid="d" title="A"><s><w l="the">The</w> <w><hl>old</hl></w>, <w>cat</w> <w>sat</w></s></doc>'
    assert c.contents("e") == '<doc pid="e" title="B"><w>old</w></doc>' and c.contents("no") is None
    o = {r.left_raw: (r.match_raw, r.right_raw) for r in h.concordance(1, 1, original=True).collect()}
    assert o == {'<w l="the">The</w> ': ("<w>old</w>", ", <w>cat</w>"), "": ("<w>old</w>", "")}
    text = h.csv(before=1, after=1, declare_separator=True).splitlines()
    assert text[0] == "sep=," and "summary.numberOfHits,2" in text[3] and len(text) == 9
    from spanloom.tool import Tool

    t = Tool(c)
    lines = list(t.run(["'old'", ":filter pid:d", ":sort hit:word:i", ":group hit:word:i", ":docs", ":colloc", ":page 2", ":nosuch", "[bad", ":size 3", ":describe", ":help", ":quit", "'cat'"]))
    assert any("The [old] cat sat" in x for x in lines) and "2 hits in 2 documents, page 1" in lines and "1 hits in 1 documents, page 1" in lines and "1\told" in lines and "1\td" in lines
    assert sum(x.startswith("error") for x in lines) == 2 and not any("[cat]" in x for x in lines)
    assert Tool(c).say(":docs") == ["error: no pattern yet"]


def test_corpus_grows_and_shrinks(spark, tmp_path):
    form = descriptor.from_dict("cfg", {"documentPath": "//doc", "annotatedFields": {"contents": {"wordPath": ".//w"}}, "metadata": {"fields": [{"name": "code", "valuePath": "@pid"}]}, "corpusConfig": {"displayName": "Small", "specialFields": {"pidField": "code"}}})
    out = str(tmp_path / "corpus")
    for i in (1, 2, 3):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}/x.xml").write_text(f'<doc pid="d{i}"><w>one</w><w>w{i}</w></doc>')
        c = Corpus.add(loaders.load(spark, str(tmp_path / f"{i}"), form), out)
    assert c.search("'one'").frame.count() == 3 and c.doc("d2").count() == 1 and c.contents("d3").startswith('<doc pid="d3">')
    assert c.describe()["name"] == "Small" and c.describe()["pidField"] == "code"
    info = c.field_info("word", 2)
    assert info["is"] == "annotation" and info["main"] and info["folded"] and info["truncated"] and info["values"]["one"] == 3
    assert c.field_info("code")["values"] == {"d1": 1, "d2": 1, "d3": 1} and not c.field_info("code")["truncated"]
    less = c.without("code:d2", str(tmp_path / "less"))
    assert less.search("'one'").frame.count() == 2 and less.config == c.config and "tei-p5" in Corpus.formats()


def test_stages_before_parsing(spark, tmp_path):
    loaders.register_converter("backwards", lambda data: data[::-1].decode(), binary=True)
    loaders.register_converter("louder", str.upper)
    (tmp_path / "a.txt").write_bytes(b"olleh")
    got = loaders.load(spark, str(tmp_path), "txt", converter=["backwards", "louder"])
    assert [r.word for r in got.tokens().collect()] == ["HELLO"]
    for bad in (["nosuch"], ["louder", "backwards"]):
        with pytest.raises(descriptor.FormatError):
            loaders.load(spark, str(tmp_path), "txt", converter=bad)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("pid"))
    tokens = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    sinks.bucketed_tables({"docs": docs, "tokens": tokens}, "bucketed", str(tmp_path / "b"), 4)
    try:
        joined = spark.table("bucketed_tokens").hint("merge").join(spark.table("bucketed_docs"), "doc_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 200 and "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        for name in ("docs", "tokens"):
            spark.sql(f"DROP TABLE bucketed_{name}")
