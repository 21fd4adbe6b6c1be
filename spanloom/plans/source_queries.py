"""Queries that load, write and change corpora: files are made from the tables, parsed by the loaders and compared with the tables."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom import tables as tb
from spanloom.corpus import Corpus
from spanloom.functions import analyzers, process
from spanloom.operators import results as rs
from spanloom.operators import spans as sp
from spanloom.plans import nodes as n
from spanloom.plans.compiler import run
from spanloom.plans.corpus_queries import _JN, PRE, QUERIES, SQL, corpus, is_word, out, query, tok
from spanloom.session import importable, scratch
from spanloom.sources import descriptor, loaders, sinks
from spanloom.streaming import ingest

#: Words that need no escape in any format.
PLAIN = "^[A-Za-z]+$"


def files(rows: DataFrame, line: Column, separator: str = "\n", head: Column | None = None, tail: Column | None = None) -> DataFrame:
    """One file per document: path and content, from a line for each row in the order of `pos`."""
    lines = rows.select("doc_id", F.struct("pos", line.alias("line")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["line"]), separator)
    text = F.concat(*[c for c in (head, body, tail) if c is not None])
    return lines.select(F.concat(F.lit("made/"), F.col("doc_id").cast("string")).alias("path"), F.encode(text, "UTF-8").alias("content"))


def pieces(lines: DataFrame) -> DataFrame:
    """lines: doc_id, part, pos, line. The same files as pieces, each line with its end, in the order of part and pos. No row holds a file: a file's lines meet in a sort, which may spill."""
    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", "part", "pos")
    return ordered.select(F.concat(F.lit("made/"), F.col("doc_id").cast("string")).alias("path"), F.col("line").alias("content"))


def load(files_: DataFrame, form: str | descriptor.Format, pieces_: bool = False) -> loaders.Loaded:
    form = loaders.FORMATS[form] if isinstance(form, str) else form
    return loaders.Loaded(loaders.documents(files_, form, pieces=pieces_), form, keep=False)


def named(loaded: loaders.Loaded, rows: DataFrame) -> DataFrame:
    """Rows with the document ids that the files were made from."""
    own = F.regexp_extract("path", "([0-9]+)$", 1).cast("bigint")
    return rows.join(loaded.parsed.select("doc_id", own.alias("_own")).distinct(), "doc_id").withColumn("doc_id", F.col("_own")).drop("_own")


def owned(loaded: loaders.Loaded) -> loaders.Loaded:
    """The same with the document ids that the files were made from, which their paths end in; so no second parse is joined."""
    own = F.expr("try_cast(regexp_extract(path, '(-?[0-9]+)$', 1) AS bigint)")
    return loaders.Loaded(loaded.parsed.withColumn("doc_id", own), loaded.form, keep=False, numbered=True)


def cell(name: str, missing: str = "_") -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(missing))


def _conllu(spark: SparkSession, sf_dir: str) -> loaders.Loaded:
    t = tb.tokens(spark, sf_dir)
    head = F.when(F.col("pos") == 0, "0").otherwise(F.col("pos").cast("string"))
    relation = F.when(F.col("pos") == 0, "root").otherwise("next")
    line = F.concat_ws("\t", (F.col("pos") + 1).cast("string"), cell("word"), cell("lemma"), cell("a_pos"), F.lit("_"), F.lit("_"), head, relation, F.lit("_"), F.lit("_"))
    lines = t.select("doc_id", F.lit(1).alias("part"), "pos", F.concat(line, F.lit("\n")).alias("line"))
    each = tb.table(spark, sf_dir, "tokens").select("doc_id").distinct()
    around = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("# newdoc id = "), F.col("doc_id").cast("string"), F.lit("\n")).alias("line")), F.struct(F.lit(2).alias("part"), F.lit("\n").alias("line")))
    edges = each.select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.part", F.lit(0).alias("pos"), "x.line")
    return load(pieces(lines.unionByName(edges)), "conll-u", True)


@query("load_treebank", PRE + " SELECT doc_id, pos, word, nullif(lemma, '') AS lemma, nullif(a_pos, '') AS a_pos FROM T")
def load_treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_conllu(spark, sf_dir)).tokens().select("doc_id", "pos", "word", "lemma", "a_pos")


@query("load_treebank_relations", PRE + " SELECT doc_id, CASE WHEN pos = 0 THEN 'root' ELSE 'next' END AS rel_type, pos = 0 AS is_root, greatest(pos - 1, 0) AS src_start, pos AS tgt_start FROM T")
def load_treebank_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_conllu(spark, sf_dir)).relations().select("doc_id", "rel_type", "is_root", "src_start", "tgt_start")


@query("load_treebank_documents", PRE + " SELECT doc_id, CAST(doc_id AS VARCHAR) AS pid, CAST(count(*) AS INTEGER) AS length_tokens FROM T GROUP BY ALL")
def load_treebank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_conllu(spark, sf_dir)).docs().select("doc_id", "pid", "length_tokens")


def _quoted(name: str) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(F.col(name), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


@query("load_table", PRE + " SELECT doc_id, pos, coalesce(word, '') AS word, coalesce(lemma, '') AS lemma, coalesce(a_pos, '') AS a_pos FROM T")
def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", _quoted("word"), _quoted("lemma"), _quoted("a_pos"))
    x = load(files(tb.tokens(spark, sf_dir), line, head=F.lit("word,lemma,pos\n")), "csv")
    return named(x, x.tokens()).select("doc_id", "pos", "word", "lemma", "a_pos")


_TENS = PRE + ", M AS (SELECT doc_id, max(pos) AS m FROM T GROUP BY 1) "


def _tagged(spark: SparkSession, sf_dir: str) -> loaders.Loaded:
    """A word per line with tags: sentences of ten tokens, and glue before every third token."""
    t = tb.tokens(spark, sf_dir)
    glue = F.when(F.col("pos") % 3 == 2, "<g/>\n").otherwise("")
    begin = F.when(F.col("pos") % 10 == 0, F.concat(F.when(F.col("pos") > 0, "</s>\n").otherwise(""), F.lit('<s n="'), (F.col("pos") / 10).cast("int").cast("string"), F.lit('">\n'))).otherwise("")
    line = F.concat(begin, glue, F.concat_ws("\t", _quoted("word"), _quoted("a_pos"), _quoted("lemma")))
    return load(files(t, line, head=F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('">\n')), tail=F.lit("\n</s>\n</doc>\n")), "sketch-wpl")


@query("load_tagged_lines", PRE + " SELECT doc_id, pos, coalesce(word, '') AS word, CASE WHEN pos % 3 = 2 OR pos = 0 THEN '' ELSE ' ' END AS punct FROM T")
def load_tagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _tagged(spark, sf_dir)
    return named(x, x.tokens()).select("doc_id", "pos", "word", "punct")


@query("load_tagged_lines_spans", _TENS + "SELECT doc_id, 's' AS tag, CAST(i * 10 AS INTEGER) AS start_pos, CAST(least(i * 10 + 10, m + 1) AS INTEGER) AS end_pos, CAST(i AS VARCHAR) AS n FROM M, unnest(range(CAST(m // 10 + 1 AS BIGINT))) q(i)")
def load_tagged_lines_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _tagged(spark, sf_dir)
    return named(x, x.spans()).select("doc_id", "tag", "start_pos", "end_pos", F.col("attrs")["n"].alias("n"))


@query("tags_by_range", _TENS + "SELECT doc_id, CAST(i * 10 AS INTEGER) AS start_pos, CAST(least(i * 10 + 10, m + 1) AS INTEGER) AS end_pos FROM M, unnest(range(CAST(m // 10 + 1 AS BIGINT))) q(i) WHERE i BETWEEN 2 AND 12")
def tags_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _tagged(spark, sf_dir)
    return named(x, run("<s n=in[2,12]/>", x.tables())).select(*sp.KEYS)


_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))


def _escaped(c: Column) -> Column:
    for a, b in _ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _escaped_sql(name: str) -> str:
    out_ = f"coalesce({name}, '')"
    for a, b in _ESCAPES:
        out_ = f"replace({out_}, '{a}', '{b}')"
    return out_


XML = descriptor.from_dict(
    "made-xml",
    {
        "documentPath": "//doc", "metadata": [{"fields": [{"name": "pid", "valuePath": "@pid"}]}, {"containerPath": "meta", "fields": [{"forEachPath": "f", "namePath": "@n", "valuePath": "@v"}]}],
        "annotatedFields": {
            "contents": {
                "containerPath": "text", "wordPath": "w", "tokenIdPath": "@id", "annotations": [{"name": "word", "valuePath": "@w"}, {"name": "lemma", "valuePath": "@l"}, {"name": "pos", "valuePath": "@p"}],
                "standoffAnnotations": [{"path": "layer/span", "spanStartPath": "@from", "spanEndPath": "@to", "spanNamePath": "@type"}, {"path": "layer/link", "type": "relation", "sourcePath": "@from", "targetPath": "@to", "valuePath": "@type", "relationClass": "nav"}],
            }
        },
    },
)


def _xml(spark: SparkSession, sf_dir: str) -> loaders.Loaded:
    """Tokens in attributes, spans as standoff elements from token to token, and a link from each span's first to its last token."""
    t = tb.tokens(spark, sf_dir)
    esc = lambda n: _escaped(F.coalesce(F.col(n), F.lit("")))
    word = F.concat(F.lit('<w id="w'), F.col("pos").cast("string"), F.lit('" w="'), esc("word"), F.lit('" l="'), esc("lemma"), F.lit('" p="'), esc("a_pos"), F.lit('"/>'))
    words = t.select("doc_id", F.lit(1).alias("part"), "pos", F.concat(word, F.lit("\n")).alias("line"))
    s = _whole_spans(t, tb.spans(spark, sf_dir))
    ends = F.concat(F.lit('from="w'), F.col("start_pos").cast("string"), F.lit('" to="#w'), (F.col("end_pos") - 1).cast("string"), F.lit('"/>'))
    mark = F.concat(F.lit('<span type="'), F.col("tag"), F.lit('" '), ends, F.lit('<link type="ends" '), ends, F.lit("\n"))
    marks = s.select("doc_id", F.lit(3).alias("part"), F.col("start_pos").alias("pos"), mark.alias("line"))
    sizes = words.groupBy("doc_id").agg((F.sum(F.length("line")) - 1).cast("string").alias("size"))
    head = F.concat(F.lit('<?xml version="1.0"?>\n<all><doc pid="'), F.col("doc_id").cast("string"), F.lit('"><meta><f n="size" v="'), F.col("size"), F.lit('"/></meta><text>'))
    around = F.array(*(F.struct(F.lit(part).alias("part"), line.alias("line")) for part, line in ((0, head), (2, F.lit("</text><layer>")), (4, F.lit("</layer></doc></all>")))))
    edges = sizes.select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.part", F.lit(0).alias("pos"), "x.line")
    return load(pieces(words.unionByName(marks).unionByName(edges)), XML, True)


def _whole_spans(t: DataFrame, spans: DataFrame) -> DataFrame:
    lengths = t.groupBy("doc_id").agg((F.max("pos") + 1).alias("length"))
    return spans.select("doc_id", "tag", "start_pos", "end_pos").distinct().join(lengths, "doc_id").where("start_pos >= 0 AND end_pos > start_pos AND end_pos <= length").drop("length")


_WHOLE = PRE + ", W AS (SELECT DISTINCT S.doc_id, tag, s, e FROM S JOIN L USING (doc_id) WHERE s >= 0 AND e > s AND e <= length)"


@query("load_xml", PRE + " SELECT doc_id, pos, coalesce(word, '') AS word, coalesce(lemma, '') AS lemma, coalesce(a_pos, '') AS a_pos FROM T")
def load_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_xml(spark, sf_dir)).tokens().select("doc_id", "pos", "word", "lemma", "a_pos")


@query("load_xml_standoff_spans", _WHOLE + " SELECT doc_id, tag, s AS start_pos, e AS end_pos FROM W")
def load_xml_standoff_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_xml(spark, sf_dir)).spans().select("doc_id", "tag", "start_pos", "end_pos")


@query("load_xml_standoff_relations", _WHOLE + " SELECT doc_id, 'nav' AS rel_class, 'ends' AS rel_type, s AS src_start, e - 1 AS tgt_start FROM W")
def load_xml_standoff_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_xml(spark, sf_dir)).relations().select("doc_id", "rel_class", "rel_type", "src_start", "tgt_start")


_PIECE = f"""'<w id="w' || pos || '" w="' || {_escaped_sql('word')} || '" l="' || {_escaped_sql('lemma')} || '" p="' || {_escaped_sql('a_pos')} || '"/>'"""


@query("load_xml_metadata", PRE + f" SELECT doc_id, CAST(doc_id AS VARCHAR) AS pid, CAST(length(string_agg({_PIECE}, chr(10) ORDER BY pos)) AS VARCHAR) AS size FROM T GROUP BY doc_id")
def load_xml_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owned(_xml(spark, sf_dir)).docs().select("doc_id", "pid", F.element_at(F.col("metadata")["size"], 1).alias("size"))


@query("snippets_of_originals", PRE + tok("h", is_word("kitchen")) + f", x AS (SELECT h.doc_id, h.s, h.e, string_agg({_PIECE}, chr(10) ORDER BY pos) AS snippet FROM h JOIN T ON T.doc_id = h.doc_id AND pos BETWEEN h.s - 2 AND h.e + 1 GROUP BY ALL) SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(e AS INTEGER) AS end_pos, snippet FROM x")
def snippets_of_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in loaded XML, shown by the characters of the original around them."""
    x = owned(_xml(spark, sf_dir))
    own = corpus(spark, sf_dir)  # every value at a position counts, of which the files have the first
    hits = run("'kitchen'", own).select(*sp.KEYS)
    return rs.snippet(x.originals(), hits, x.tables(), 2, 2).select(*sp.KEYS, "snippet")


_PLAIN_T = PRE + """, Q AS (SELECT doc_id, pos, 0 AS x, word FROM T WHERE regexp_full_match(word, '[A-Za-z]+') AND word NOT IN ('xxx', 'yyy', 'www')
  UNION ALL SELECT DISTINCT doc_id, pos // 8 * 8 + 7, 1, '.' FROM T), P AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, x) - 1 AS INTEGER) AS n, pos, word FROM Q)"""


def _chat(spark: SparkSession, sf_dir: str) -> loaders.Loaded:
    """Utterances of eight tokens by three speakers; words that the format would read as codes are left out."""
    t = tb.tokens(spark, sf_dir)
    word = F.when(F.col("word").rlike(PLAIN) & ~F.col("word").isin("xxx", "yyy", "www"), F.col("word"))
    said = t.groupBy("doc_id", F.floor(F.col("pos") / 8).cast("int").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", word.alias("w")))), lambda x: x["w"]), " ").alias("words"))
    line = F.concat(F.lit("*S"), (F.col("pos") % 3).cast("string"), F.lit(":\t"), F.col("words"), F.lit(" ."))
    head = F.concat(F.lit("@Begin\n@Languages:\teng\n@PID:\t"), F.col("doc_id").cast("string"), F.lit("\n@ID:\teng|c|S1|2;03.10|male|||Target_Child|||\n"))
    return load(files(said, line, head=head, tail=F.lit("\n@End\n")), "chat")


@query("load_transcript", _PLAIN_T + " SELECT doc_id, n AS pos, word FROM P")
def load_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _chat(spark, sf_dir)
    return named(x, x.tokens()).select("doc_id", "pos", "word")


@query("load_transcript_utterances", _PLAIN_T + ", u AS (SELECT doc_id, pos // 8 AS k, count(*) AS words FROM P GROUP BY ALL) SELECT doc_id, 'S' || (k % 3) AS who, CASE WHEN k % 3 = 1 THEN '2;03.10' END AS age, count(*) AS utterances, CAST(sum(words) AS BIGINT) AS words FROM u GROUP BY ALL")
def load_transcript_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _chat(spark, sf_dir)
    rows = named(x, x.spans()).groupBy("doc_id", F.col("attrs")["who"].alias("who"), F.col("attrs")["age"].alias("age"))
    return rows.agg(F.count("*").alias("utterances"), F.sum(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("words"))


@query("load_instructions", PRE + " SELECT doc_id, pos, CASE WHEN regexp_full_match(word, '[A-Za-z]+') THEN word END AS word FROM T")
def load_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tb.tokens(spark, sf_dir)
    line = F.concat(F.when(F.col("word").rlike(PLAIN), F.concat(F.lit("VAL word "), F.col("word"))).otherwise("VAL odd x"), F.lit("\nADVANCE 1 # next"))
    head = F.concat(F.lit("DOC_START\nMETADATA pid "), F.col("doc_id").cast("string"), F.lit("\nFIELD_START contents\n"))
    x = load(files(t, line, head=head, tail=F.lit("\nFIELD_END\nDOC_END\n")), "commands")
    return named(x, x.tokens()).select("doc_id", "pos", "word")


# -- sinks, deletion, value processing, streaming --------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None) -> Corpus:
    importable(spark)
    path = scratch(spark)
    own = tables or {"docs": tb.docs(spark, sf_dir), "tokens": tb.tokens(spark, sf_dir), "spans": tb.spans(spark, sf_dir)}
    sinks.write_corpus(own, path)
    return Corpus.open(spark, path)


@query("written_corpus_term", PRE + tok("a", is_word("kitchen")) + out("a"))
def written_corpus_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).search("'kitchen'").frame.select(*sp.KEYS).distinct()


@query("written_corpus_sequence", PRE + tok("a", "len(list_filter(ws, lambda x: starts_with(x, 'th'))) > 0") + tok("b", "p = 'nn'") + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND a.e = b.s JOIN D ON D.doc_id = a.doc_id WHERE lower(title) LIKE '%letter%')" + out("c"))
def written_corpus_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).search("'th.*' [pos='NN']", "title:letter").frame.select(*sp.KEYS).distinct()


@query("corpus_description", PRE + " SELECT (SELECT count(*) FROM T) AS tokens, (SELECT count(DISTINCT doc_id) FROM T) AS documents, 'word,lemma,pos,punct' AS annotations")
def corpus_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Corpus(corpus(spark, sf_dir), tb.docs(spark, sf_dir)).describe()
    return spark.createDataFrame([(d["tokens"], d["documents"], ",".join(d["annotations"]))], "tokens bigint, documents bigint, annotations string")


@query("deleted_documents", PRE + " SELECT doc_id, count(*) AS tokens FROM T WHERE doc_id NOT IN (SELECT doc_id FROM D WHERE lower(title) LIKE '%letter%') GROUP BY 1")
def deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sinks.delete_documents({"docs": tb.docs(spark, sf_dir), "tokens": tb.tokens(spark, sf_dir)}, "title:letter")
    return left["tokens"].groupBy("doc_id").agg(F.count("*").alias("tokens"))


@query("csv_read_back", _JN + " SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(s AS VARCHAR) AS start_pos, t AS match_word FROM h")
def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus(spark, sf_dir)
    k = rs.kwic(run("[pos='JJ'] [pos='NN']", t), t, ["word"], 0, 0)
    folded = k.withColumn("match_word", F.transform("match_word", lambda w: rs.fold(w, "i"))).select("doc_id", "start_pos", "match_word")
    path = scratch(spark)
    sinks.write_csv(folded, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("frequency_list_read_back", PRE + " SELECT w AS term, CAST(count(*) AS VARCHAR) AS freq FROM T WHERE w IS NOT NULL AND regexp_full_match(w, '[a-z]+') GROUP BY 1")
def frequency_list_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_frequency_list(rs.term_frequencies(corpus(spark, sf_dir)).where(F.col("term").rlike("^[a-z]+$")), path)
    return spark.read.option("sep", "\t").csv(path).toDF("term", "freq")


@query("exported_metadata", PRE + " SELECT doc_id, pid, lang FROM D WHERE pid IS NOT NULL AND lang IS NOT NULL")
def exported_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.export_metadata(tb.docs(spark, sf_dir).select("doc_id", "pid", "lang"), path)
    return spark.read.schema("doc_id bigint, pid string, lang string").json(path).where("pid IS NOT NULL AND lang IS NOT NULL")


@query("linked_metadata", PRE + ", n AS (SELECT docpid AS pid, count(DISTINCT hit_id) AS hits FROM hits GROUP BY 1) SELECT doc_id, D.pid, n.hits FROM D LEFT JOIN n USING (pid)")
def linked_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = tb.table(spark, sf_dir, "hits").groupBy("docpid").agg(F.count_distinct("hit_id").alias("hits"))
    return loaders.link_metadata(tb.docs(spark, sf_dir), other, "pid", "docpid").select("doc_id", "pid", "hits")


@query(
    "more_value_steps",
    PRE
    + """ SELECT doc_id, coalesce(pid, '') || CASE WHEN coalesce(lang, '') = '' THEN '' ELSE '-x' || lang END AS appended, CAST(len(list_distinct(string_split(coalesce(title, ''), ' '))) AS BIGINT) AS n_all,
 CAST(len(list_distinct(list_prepend(coalesce(title, ''), string_split(coalesce(title, ''), ' ')))) AS BIGINT) AS n_both, 'N' AS head, coalesce(lang, '') AS feature, CAST(CAST(length_tokens % 7 AS INTEGER) * 12 + 3 + CASE WHEN length_tokens % 30 >= 15 THEN 1 ELSE 0 END AS VARCHAR) AS months,
 CASE WHEN recorded_at IS NOT NULL THEN strftime(recorded_at, '%Y') || strftime(recorded_at, '%m') || '01' END AS first_day, CASE WHEN recorded_at IS NOT NULL THEN strftime(last_day(recorded_at), '%Y%m%d') END AS last_day FROM D""",
)
def more_value_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of format descriptors: append, split in all ways, features of a part of speech, ages and dates."""
    d = tb.docs(spark, sf_dir)
    month, year = F.date_format("recorded_at", "MM"), F.date_format("recorded_at", "yyyy")
    d = d.withColumns({"t": F.coalesce("title", F.lit("")), "p": F.coalesce("pid", F.lit("")), "y": year, "m": month, "none": F.lit(None).cast("string")})
    d = d.withColumn("tagged", F.concat(F.lit("N(type=com,lang="), F.coalesce("lang", F.lit("")), F.lit(",num=sg)")))
    age = F.concat((F.col("length_tokens") % 7).cast("string"), F.lit(";3."), (F.col("length_tokens") % 30).cast("string"))
    one = lambda c, *steps: process.apply(c, list(steps), d)
    split = lambda keep: process.apply_all(F.col("t"), [{"action": "split", "separator": " ", "keep": keep}], d)
    date = lambda fill: {"action": "concatDate", "yearField": "y", "monthField": "m", "dayField": "none", "autofill": fill}
    return d.select(
        "doc_id",
        one(F.col("p"), {"action": "append", "field": "lang", "separator": "-", "prefix": "x"}).alias("appended"),
        F.size(split("all")).cast("bigint").alias("n_all"),
        F.size(split("both")).cast("bigint").alias("n_both"),
        one(F.col("tagged"), {"action": "parsePos"}).alias("head"),
        one(F.col("tagged"), {"action": "parsePos", "field": "lang"}).alias("feature"),
        one(age, {"action": "chatFormatAgeToMonths"}).alias("months"),
        one(F.col("t"), date("start")).alias("first_day"),
        one(F.col("t"), date("end")).alias("last_day"),
    )


@query("standing_query", PRE + tok("a", is_word("kitchen")) + out("a"))
def standing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern of one token on a stream of tokens; what it finds is written batch by batch."""
    importable(spark)
    schema = tb.table(spark, sf_dir, "tokens").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/tokens.parquet*")
    found, marks = scratch(spark), scratch(spark)
    hits = ingest.standing_token_query(stream.select("doc_id", "pos", "word", "word_all"), "'kitchen'")
    q = hits.writeStream.format("parquet").option("path", found).option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("doc_id bigint, start_pos int, end_pos int").parquet(found).distinct()


@query("terms_per_window", PRE + " SELECT strftime(date_trunc('day', recorded_at), '%Y-%m-%d') AS day, coalesce(lang, '') AS term, count(*) AS freq FROM D WHERE recorded_at IS NOT NULL GROUP BY ALL")
def terms_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.docs(spark, sf_dir).withColumn("l", F.coalesce("lang", F.lit("")))
    w = ingest.windowed_term_counts(d, "recorded_at", "l", "1 day", "1 day")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "term", "freq")


@query("dutch_tokens", r"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}''\-.()\[\]]+')) AS t FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, regexp_replace(t, '[.()\[\]]|^''|''$', '', 'g') AS t FROM x) SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS letters FROM y WHERE regexp_matches(t, '[\p{L}0-9]') GROUP BY 1")
def dutch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tb.table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.explode(analyzers.dutch_tokens(F.col("text"))).alias("t"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("t")).cast("bigint").alias("letters"))


# -- extension points ----------------------------------------------------------------------------------


@query("own_query_function", PRE + tok("a", is_word("the")) + tok("b", "p = 'nn'") + ", c AS (SELECT a.doc_id, a.s, b.e FROM a JOIN b ON a.doc_id = b.doc_id AND b.s BETWEEN a.e AND a.e + 1)" + out("c"))
def own_query_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the query language that is registered by name: two patterns with at most one token between them."""
    c = Corpus(corpus(spark, sf_dir), tb.docs(spark, sf_dir))
    c.register("near", lambda a, b: n.Seq((a, n.Any_(0, 1), b)))
    return c.search("near('the', [pos='NN'])").frame.select(*sp.KEYS).distinct()


@query("own_analyzer", PRE + " SELECT doc_id, CAST(len(string_split(coalesce(title, ''), 'e')) AS BIGINT) AS pieces FROM D")
def own_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzers.register("at_e", lambda c: F.split(c, "e"))
    return tb.docs(spark, sf_dir).select("doc_id", F.size(analyzers.analyze(F.coalesce("title", F.lit("")), "at_e")).cast("bigint").alias("pieces"))


_TITLE_WORDS = PRE + r", x AS (SELECT doc_id, {0} AS t FROM D WHERE title IS NOT NULL), w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+(?:[''’-][\p{{L}}\p{{N}}]+)*')) AS word FROM x) "


@query("own_stages", _TITLE_WORDS.format("upper(reverse(title))") + "SELECT doc_id, word, count(*) AS freq FROM w GROUP BY ALL")
def own_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go through a converter of bytes and a tagger before they are parsed."""
    loaders.register_converter("reversed", lambda data: data.decode()[::-1], binary=True)
    loaders.register_converter("capitals", str.upper)
    d = tb.docs(spark, sf_dir).where("title IS NOT NULL").select(F.concat(F.lit("made/"), F.col("doc_id").cast("string")).alias("path"), F.encode("title", "UTF-8").alias("content"))
    form = loaders.FORMATS["txt"]
    importable(spark)
    x = loaders.Loaded(loaders.documents(d, form, ["reversed", "capitals"]), form, keep=False)
    return named(x, x.tokens()).groupBy("doc_id", "word").agg(F.count("*").alias("freq"))


@query("watched_folder", _TITLE_WORDS.format("title") + "SELECT word, count(*) AS freq FROM w GROUP BY 1")
def watched_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, loaded as they come, each batch once."""
    importable(spark)
    folder, found, marks = scratch(spark), scratch(spark), scratch(spark)
    tb.docs(spark, sf_dir).where("title IS NOT NULL").select("title").repartition(4).write.text(folder)
    ingest.watch(spark, folder, "txt", found, marks, glob="part-*").awaitTermination()
    return ingest.read(spark, found, "tokens").groupBy("word").agg(F.count("*").alias("freq"))


@query("field_values_described", PRE + " SELECT lang AS value, count(*) AS n, false AS truncated FROM D WHERE lang IS NOT NULL GROUP BY 1")
def field_values_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = Corpus(corpus(spark, sf_dir), tb.docs(spark, sf_dir)).field_info("lang")
    return spark.createDataFrame([(v, k, info["truncated"]) for v, k in info["values"].items()], "value string, n bigint, truncated boolean")


@query("hits_in_order", _JN + " SELECT count(*) AS hits, CAST(0 AS BIGINT) AS out_of_order FROM h")
def hits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits sorted within their documents, without a sort of all."""
    t = corpus(spark, sf_dir)
    rows = sp.in_order(run("[pos='JJ'] [pos='NN']", t)).withColumn("_i", F.monotonically_increasing_id())
    before = F.lag("start_pos").over(W.partitionBy("doc_id").orderBy("_i"))
    return rows.withColumn("_late", before > F.col("start_pos")).agg(F.count("*").alias("hits"), F.count(F.when(F.col("_late"), 1)).alias("out_of_order"))


@query("csv_with_summary", _JN + " SELECT 'summary.numberOfHits' AS name, CAST(count(*) AS VARCHAR) AS value FROM h UNION ALL SELECT 'summary.numberOfDocs', CAST(count(DISTINCT doc_id) AS VARCHAR) FROM h UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM h")
def csv_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as CSV text, with the block that says what was found."""
    hits = Corpus(corpus(spark, sf_dir), tb.docs(spark, sf_dir)).search("[pos='JJ'] [pos='NN']")
    lines = list(csv.reader(io.StringIO(hits.csv(["lemma"], 1, 1, most=10_000_000))))[1:]
    block = {r[0]: r[1] for r in lines if r[0].startswith("summary.")}
    rows = [("summary.numberOfHits", block["summary.numberOfHits"]), ("summary.numberOfDocs", block["summary.numberOfDocs"]), ("rows", str(len(lines) - len(block)))]
    return spark.createDataFrame(rows, "name string, value string")


__all__ = ["QUERIES", "SQL"]
