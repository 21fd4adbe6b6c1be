"""What is done with hits: sort, filter, window, sample, group, count, keywords in context, collocations, documents.

Every order ends in doc_id, start_pos, end_pos, so that pages and samples are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.functions.text import fold, fold_text
from spanloom.operators import properties as pr
from spanloom.operators import spans as sp
from spanloom.plans.compiler import Tables
from spanloom.sources.parsers import BLOCK

# -- hits ------------------------------------------------------------------------------------------


def sort_hits(hits: DataFrame, tables: Tables, by: str, documents: DataFrame | None = None) -> DataFrame:
    """A distributed range sort; followed by a window it becomes a top-k without a full sort."""
    keyed, named = pr.columns(hits, tables, by, documents)
    return keyed.orderBy(*pr.order(named), *sp.KEYS).drop(*[c for c, _ in named])


def filter_hits(hits: DataFrame, tables: Tables, by: str, value: str, documents: DataFrame | None = None) -> DataFrame:
    """Hits whose property has a value; contextual values are compared folded."""
    keyed, named = pr.columns(hits, tables, by, documents)
    (name, p), *rest = named
    if rest:
        raise pr.PropertyError("a filter takes one property")
    wanted = fold_text(value, p.sensitivity) if p.kind in pr.CONTEXTUAL else value
    return keyed.where(F.col(name).cast("string") == wanted).drop(name)


def window(df: DataFrame, first: int, number: int) -> DataFrame:
    """A page: `number` rows from `first`, in the order the rows have. An offset plus limit on sorted rows is a top-k."""
    return df.offset(first).limit(number) if first else df.limit(number)


#: Samples of up to so many rows are taken as a top-k; larger ones by a threshold.
SMALL_SAMPLE = 10_000
#: Bits of the hash that the threshold is looked for in.
SAMPLE_BITS = 14


def sample(df: DataFrame, number: int | None = None, fraction: float | None = None, seed: int = 1, keys: list[str] | None = None) -> DataFrame:
    """A sample without replacement, the same for the same seed: the rows of the least hashes. fraction: of round(fraction * total) rows.

    For a large sample the hash up to which rows are taken is found on a histogram of 2^14 bins; the rows of the bin that
    it falls into, a fraction of all, are settled by order. No task holds the sample.
    """
    if (number is None) == (fraction is None):
        raise ValueError("give a number or a fraction")
    if fraction is not None:
        if not 0 <= fraction <= 1:
            raise ValueError("a fraction is between 0 and 1")
        number = int(fraction * df.count() + 0.5)
    keys = keys or [c for c in sp.KEYS if c in df.columns] or df.columns
    marked = df.withColumn("_m", F.xxhash64(F.lit(seed), *keys))
    if number <= SMALL_SAMPLE:
        return marked.orderBy("_m", *keys).limit(number).drop("_m").orderBy(*keys)
    marked = marked.withColumn("_bin", F.shiftright("_m", 64 - SAMPLE_BITS))
    left, edge = number, None
    for r in sorted(marked.groupBy("_bin").agg(F.count("*").alias("n")).collect()):
        edge = r["_bin"]
        if r["n"] >= left:
            break
        left -= r["n"]
    else:
        return df.orderBy(*keys)
    inside = marked.where(F.col("_bin") < edge)
    last = marked.where(F.col("_bin") == edge).orderBy("_m", *keys).limit(left)
    return inside.unionByName(last).drop("_m", "_bin").orderBy(*keys)


def hits_in_document(hits: DataFrame, doc_id: int) -> DataFrame:
    return hits.where(F.col("doc_id") == doc_id)


def count_hits(hits: DataFrame) -> DataFrame:
    """One row: hits and documents."""
    per = hits.groupBy("doc_id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.count("*").alias("docs"))


def limited(hits: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most `most` hits and whether there were more."""
    return hits.limit(most), hits.limit(most + 1).count() > most


def _values(words: Column, name: str) -> Column:
    return F.transform(words, lambda t: t[name])


def kwic(hits: DataFrame, tables: Tables, annotations: list[str] | None = None, before: int = 5, after: int = 5) -> DataFrame:
    """Adds arrays left_<a>, match_<a>, right_<a> of the words around and in each hit, for each annotation."""
    names = annotations or [next(iter(tables.annotations))]
    ctx = pr.with_context(hits, tables, names, before, after)
    s, e = F.col("start_pos"), F.col("end_pos")
    parts = {"left": lambda t: t["_at"] < s, "match": lambda t: (t["_at"] >= s) & (t["_at"] < e), "right": lambda t: t["_at"] >= e}
    cols = {f"{k}_{a.replace('/', '_')}": _values(F.filter("_ctx", test), a.replace("/", "_")) for k, test in parts.items() for a in names}
    return ctx.withColumns(cols).drop("_ctx")


def kwic_in_span(hits: DataFrame, tables: Tables, tag: str, annotations: list[str] | None = None, most: int = 1000) -> DataFrame:
    """Keywords in the context of the first enclosing span of a name; at most `most` tokens, the end is cut. Hits outside any such span show themselves."""
    names = annotations or [next(iter(tables.annotations))]
    spans = tables.spans.where(F.col("tag") == tag).select("doc_id", "start_pos", "end_pos")
    around = sp.filtered(hits.select(*sp.KEYS).distinct(), sp.capture(spans, "_around"), "within").select(*sp.KEYS, F.col("c__around.start").alias("_s"), F.col("c__around.end").alias("_e"))
    placed = hits.join(around, sp.KEYS, "left").withColumns({"_s": F.coalesce("_s", "start_pos"), "_e": F.coalesce("_e", "end_pos")})
    wide = placed.select("doc_id", F.col("_s").alias("start_pos"), F.least(F.col("_e"), F.col("_s") + most).alias("end_pos"), F.struct(F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).alias("c__hit"))
    ctx = pr.with_context(wide.distinct(), tables, names, 0, 0)
    s, e = F.col("c__hit.start"), F.col("c__hit.end")
    parts = {"left": lambda t: t["_at"] < s, "match": lambda t: (t["_at"] >= s) & (t["_at"] < e), "right": lambda t: t["_at"] >= e}
    cols = {f"{k}_{a}": _values(F.filter("_ctx", test), a) for k, test in parts.items() for a in names}
    return ctx.withColumns(cols).select("doc_id", s.alias("start_pos"), e.alias("end_pos"), *cols)


def concordance(hits: DataFrame, tables: Tables, before: int = 5, after: int = 5, punct: str = "punct") -> DataFrame:
    """Running text left, match and right, with the punctuation that stands before each word."""
    main = next(iter(tables.annotations))
    own = [main, punct] if punct in tables.tokens.columns else [main]
    ctx = pr.with_context(hits, tables, own, before, after)
    s, e = F.col("start_pos"), F.col("end_pos")
    piece = lambda t: F.concat(F.coalesce(t[punct], F.lit("")), F.coalesce(t[main], F.lit(""))) if len(own) > 1 else t[main]
    join = lambda test: F.array_join(F.transform(F.filter("_ctx", test), piece), "" if len(own) > 1 else " ")
    out = ctx.withColumns({"left_text": join(lambda t: t["_at"] < s), "match_text": join(lambda t: (t["_at"] >= s) & (t["_at"] < e)), "right_text": join(lambda t: t["_at"] >= e)})
    return out.drop("_ctx")


def snippet(raw: DataFrame, hits: DataFrame, tables: Tables, before: int = 20, after: int = 20) -> DataFrame:
    """Pieces of the original text by character offsets. raw: doc_id, raw; tokens need char_start and char_end."""
    return original_concordance(raw, hits, tables, before, after).select(*sp.KEYS, F.concat("left_raw", "match_raw", "right_raw").alias("snippet"))


def original_concordance(raw: DataFrame, hits: DataFrame, tables: Tables, before: int = 5, after: int = 5) -> DataFrame:
    """The original left of, in and right of each hit, with its markup, cut by the character offsets of tokens.

    raw: doc_id and raw, or the blocks of `Loaded.originals`. Tokens are read once, for all places around the hits. Whole originals are joined
    once per document: its hits' character ranges are put together first, in blocks of positions, so that neither a text
    is repeated for each of its hits nor a hot document's hits lie in one row. Blocks are joined with what lies in them.
    """
    around = F.sequence(F.greatest(F.lit(0), F.col("start_pos") - before), F.greatest("start_pos", F.col("end_pos") - 1, F.col("end_pos") + after - 1))
    wanted = hits.select(*sp.KEYS).distinct().select(*sp.KEYS, F.explode(around).alias("_p"))
    look = tables.tokens.select(F.col("doc_id").alias("_d"), F.col("pos").alias("_at"), "char_start", "char_end")
    found = wanted.join(look, (F.col("doc_id") == F.col("_d")) & (F.col("_p") == F.col("_at")))
    last = F.greatest("start_pos", F.col("end_pos") - 1)
    placed = found.groupBy(*sp.KEYS).agg(
        F.min_by("char_start", "_p").alias("_c0"), F.max(F.when(F.col("_p") == F.col("start_pos"), F.col("char_start"))).alias("_c1"),
        F.max(F.when(F.col("_p") == last, F.col("char_end"))).alias("_c2"), F.max_by("char_end", "_p").alias("_c3"),
    ).where("_c1 IS NOT NULL AND _c2 IS NOT NULL")
    if "block" in raw.columns:
        return _of_blocks(raw, placed)
    spots = F.struct("start_pos", "end_pos", "_c0", "_c1", "_c2", "_c3")
    packed = placed.groupBy("doc_id", F.floor(F.col("start_pos") / (sp.BLOCK * 16)).alias("_block")).agg(F.collect_list(spots).alias("_spots"))
    piece = lambda s, a, z: F.substring(F.col("raw"), s[a] + 1, s[z] - s[a])
    cut_out = packed.join(raw.select("doc_id", "raw"), "doc_id").select("doc_id", F.explode(F.transform("_spots", lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), piece(s, "_c0", "_c1").alias("left_raw"), piece(s, "_c1", "_c2").alias("match_raw"), piece(s, "_c2", "_c3").alias("right_raw")))).alias("x"))
    return cut_out.select("doc_id", "x.*")


def _of_blocks(raw: DataFrame, placed: DataFrame) -> DataFrame:
    """The pieces of hits from blocks of originals: what lies in each block, put together again where a hit reaches over its edge."""
    block = lambda c: F.floor(c / BLOCK).cast("int")
    spread = placed.withColumn("block", F.explode(F.sequence(block(F.col("_c0")), block(F.greatest(F.col("_c0"), F.col("_c3") - 1)))))
    begin = F.col("block") * BLOCK

    def piece(a: str, z: str) -> Column:
        first = F.greatest(F.col(a) - begin, F.lit(0))
        return F.substring(F.col("raw"), first + 1, F.greatest(F.least(F.col(z) - begin, F.lit(BLOCK)) - first, F.lit(0)))

    names = ("left_raw", "match_raw", "right_raw")
    of = F.struct("block", *(piece(f"_c{i}", f"_c{i + 1}").alias(name) for i, name in enumerate(names)))
    cut_out = spread.join(raw.select("doc_id", "block", "raw"), ["doc_id", "block"]).select(*sp.KEYS, of.alias("x"))
    whole = cut_out.groupBy(*sp.KEYS).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    together = lambda name: F.array_join(F.transform("xs", lambda x: x[name]), "").alias(name)
    return whole.select(*sp.KEYS, *map(together, names))


def highlight(text: str, spots: list[tuple[int, int]], before: str = "<hl>", after: str = "</hl>") -> str:
    """Marks character ranges in XML without crossing its tags: a mark ends before a tag and goes on behind it."""
    import re

    marked = [False] * (len(text) + 1)
    for a, b in spots:
        for i in range(max(a, 0), min(b, len(text))):
            marked[i] = True
    out, at, on = [], 0, False
    for m in [*re.finditer(r"<[^>]*>", text), None]:
        end = m.start() if m else len(text)
        for i in range(at, end):
            if marked[i] != on:
                out.append(before if marked[i] else after)
                on = marked[i]
            out.append(text[i])
        if on:
            out.append(after)
            on = False
        if m:
            out.append(m.group())
            at = m.end()
    return "".join(out)


def collocations(hits: DataFrame, tables: Tables, annotation: str | None = None, before: int = 5, after: int = 5, sensitivity: str = "i") -> DataFrame:
    """Frequencies of the words around hits, the hits themselves left out; contexts that overlap count repeatedly."""
    name = tables.column(annotation)
    spans = hits.select(*sp.KEYS).distinct()
    s, e = F.col("start_pos"), F.col("end_pos")
    left = F.sequence(F.greatest(F.lit(0), s - before), s - 1)
    places = F.concat(F.when((s > 0) & F.lit(before > 0), left).otherwise(F.array().cast("array<int>")), F.sequence(e, e + after - 1) if after else F.array().cast("array<int>"))
    # places are counted before the join, so that hits close to each other bring one row per token
    want = spans.select("doc_id", F.explode(places).alias("pos")).groupBy("doc_id", "pos").agg(F.count("*").alias("n"))
    words = want.join(tables.rows().select("doc_id", "pos", fold(F.col(name), sensitivity).alias("term")), ["doc_id", "pos"])
    if tables.stored is not None:
        words = words.dropDuplicates(["doc_id", "pos"])
    return words.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("freq"))


# -- groups ------------------------------------------------------------------------------------------


def group_hits(hits: DataFrame, tables: Tables, by: str, documents: DataFrame | None = None, keep: int = 0) -> DataFrame:
    """One row per combination of property values: g0, g1, ..., size, docs and, with `keep`, up to so many of its hits in order.

    Sizes and document counts are combined before the shuffle, so a group of a third of all hits is no single task's.
    """
    keyed, named = pr.columns(hits, tables, by, documents)
    keys = [F.col(c).alias(f"g{i}") for i, (c, _) in enumerate(named)]
    names = [f"g{i}" for i in range(len(named))]
    rows = keyed.select(*keys, *sp.KEYS)
    per_doc = rows.groupBy(*names, "doc_id").agg(F.count("*").alias("n"))
    out = per_doc.groupBy(*names).agg(F.sum("n").alias("size"), F.count("*").alias("docs"))
    if keep:
        # the first hits within salted parts, then the first of those: no task ranks a whole hot group
        part = F.pmod(F.xxhash64(*sp.KEYS), F.lit(64))
        inner = W.partitionBy(*names, "_s").orderBy(*sp.KEYS)
        few = rows.withColumn("_s", part).withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= keep)
        outer = W.partitionBy(*names).orderBy(*sp.KEYS)
        few = few.withColumn("_r", F.row_number().over(outer)).where(F.col("_r") <= keep)
        kept = few.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(*sp.KEYS))).alias("hits"))
        renamed = kept.select(*[F.col(n).alias(f"_{n}") for n in names], "hits")
        test = None
        for n in names:
            c = F.col(n).eqNullSafe(F.col(f"_{n}"))
            test = c if test is None else test & c
        out = out.join(renamed, test, "left").drop(*[f"_{n}" for n in names])
    return out


def group_tokens(tables: Tables, by: str, documents: DataFrame | None = None) -> DataFrame:
    """`group_hits` of all single tokens, by annotations of the token and fields of its document: tokens are counted per document and value,
    and no context is joined; document fields see counts."""
    properties = pr.parse(by)
    main = next(iter(tables.annotations))
    if not only_tokens(by):
        raise pr.PropertyError(f"{by} needs more than the tokens themselves")
    keys = [(f"g{i}", F.coalesce(fold(F.col(tables.column(p.annotation or main)), p.sensitivity), F.lit(""))) for i, p in enumerate(properties) if p.kind == "hit"]
    names = [k for k, _ in keys]
    per = tables.tokens.select("doc_id", *[c.alias(k) for k, c in keys]).groupBy("doc_id", *names).agg(F.count("*").alias("n"))
    others = [(i, p) for i, p in enumerate(properties) if p.kind != "hit"]
    fields = [(i, p) for i, p in others if p.kind != "docid"]
    if fields:
        if documents is None:
            raise pr.PropertyError("document properties need the documents")
        looked = documents.select("doc_id", *[F.col("pid" if p.kind == "doc" else p.annotation).alias(f"_d{i}") for i, p in fields])
        per = per.join(looked, "doc_id", "left")
    for i, p in others:
        c = F.col("doc_id") if p.kind == "docid" else F.col(f"_d{i}") if p.kind == "doc" else pr.decade(F.col(f"_d{i}")) if p.kind == "decade" else pr.field_value(per, f"_d{i}")
        per = per.withColumn(f"g{i}", c)
    return per.groupBy(*[f"g{i}" for i in range(len(properties))]).agg(F.sum("n").alias("size"), F.count("*").alias("docs"))


def only_tokens(by: str) -> bool:
    """Whether single tokens can be grouped by these properties without their contexts."""
    return all(p.kind in ("hit", "field", "decade", "doc", "docid") for p in pr.parse(by))


def sort_groups(groups: DataFrame, by: str = "size") -> DataFrame:
    """Groups of hits or of documents. by: `size` (the largest first; of documents, how many there are) or `identity`, reversed by `-`."""
    (p,) = pr.parse(by)
    names = [c for c in groups.columns if c[:1] == "g" and c[1:].isdigit()]
    if p.kind == "size":
        size = F.col("size" if "size" in groups.columns else "docs")
        return groups.orderBy(size.desc() if p.reverse else size, *names)
    if p.kind == "identity":
        return groups.orderBy(*[F.col(n).desc() if p.reverse else F.col(n) for n in names])
    raise pr.PropertyError(f"groups can't be sorted by {p.kind}")


def filter_groups(groups: DataFrame, identity: list[str]) -> DataFrame:
    for i, v in enumerate(identity):
        groups = groups.where(F.col(f"g{i}").cast("string") == v)
    return groups


def view_group(hits: DataFrame, tables: Tables, by: str, identity: list, documents: DataFrame | None = None) -> DataFrame:
    """The hits of one group."""
    keyed, named = pr.columns(hits, tables, by, documents)
    for (c, _), v in zip(named, identity):
        keyed = keyed.where(F.col(c).cast("string") == str(v))
    return keyed.drop(*[c for c, _ in named])


# -- documents ---------------------------------------------------------------------------------------


def per_document(hits: DataFrame, keep: int = 0) -> DataFrame:
    """doc_id, n_hits and, with `keep`, its first hits."""
    out = hits.groupBy("doc_id").agg(F.count("*").alias("n_hits"))
    if keep:
        few = hits.withColumn("_s", F.pmod(F.xxhash64(*sp.KEYS), F.lit(64)))
        few = few.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "_s").orderBy(*sp.KEYS))).where(F.col("_r") <= keep)
        few = few.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(*sp.KEYS))).where(F.col("_r") <= keep)
        out = out.join(few.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("hits")), "doc_id")
    return out


def document_property(docs: DataFrame, p: pr.Property) -> Column:
    if p.kind in ("docid", "doc"):
        return F.col("doc_id" if p.kind == "docid" else "pid")
    if p.kind == "field":
        return pr.field_value(docs, p.annotation or "pid")
    if p.kind == "decade":
        return pr.decade(F.col(p.annotation or "year"))
    if p.kind == "fieldlen":
        return F.col("length_tokens")
    if p.kind == "numhits":
        return F.col("n_hits")
    raise pr.PropertyError(f"{p.kind} is not a property of documents")


def sort_docs(docs: DataFrame, by: str) -> DataFrame:
    props = pr.parse(by)
    return docs.orderBy(*[document_property(docs, p).desc() if p.reverse else document_property(docs, p).asc() for p in props], "doc_id")


def filter_docs(docs: DataFrame, by: str, value: str) -> DataFrame:
    (p,) = pr.parse(by)
    return docs.where(document_property(docs, p).cast("string") == value)


def group_docs(docs: DataFrame, by: str) -> DataFrame:
    """One row per combination of metadata values: g0, ..., docs and tokens (length_tokens, unknown ones 0)."""
    props = pr.parse(by)
    for p in props:
        if p.kind in ("docid", "doc") or p.kind in pr.CONTEXTUAL:
            raise pr.PropertyError(f"documents can't be grouped by {p.kind}")
    keys = [document_property(docs, p).alias(f"g{i}") for i, p in enumerate(props)]
    hits = [F.sum("n_hits").alias("hits")] if "n_hits" in docs.columns else []
    return docs.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum(F.coalesce("length_tokens", F.lit(0))).cast("bigint").alias("tokens"), *hits)


def facets(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of every value of each field, in one pass over the documents: field, value, docs."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), pr.field_value(docs, f).alias("value")) for f in fields])
    return docs.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("docs"))


def total(docs: DataFrame, column: str) -> DataFrame:
    """Sum, greatest value and number over documents or groups."""
    return docs.agg(F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias("total"), F.max(column).alias("largest"), F.count("*").alias("n"))


def subcorpus_size(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length_tokens"), F.lit(0)).cast("bigint").alias("tokens"))


# -- terms -------------------------------------------------------------------------------------------


def term_frequencies(tables: Tables, annotation: str | None = None, sensitivity: str = "i", documents: DataFrame | None = None, terms: list[str] | None = None) -> DataFrame:
    """Token counts per term, of all documents or those of a filter. Terms that are asked for and absent have 0."""
    t = tables.tokens if documents is None else sp.in_documents(tables.tokens, documents)
    rows = t.select(fold(F.col(tables.column(annotation)), sensitivity).alias("term")).where("term IS NOT NULL")
    if terms is None:
        return rows.groupBy("term").agg(F.count("*").alias("freq"))
    wanted = [(x,) for x in dict.fromkeys(fold_text(x, sensitivity) for x in terms)]
    asked = t.sparkSession.createDataFrame(wanted, "term string")
    counts = rows.where(F.col("term").isin([w for (w,) in wanted])).groupBy("term").agg(F.count("*").alias("freq"))
    return asked.join(counts, "term", "left").select("term", F.coalesce("freq", F.lit(0)).alias("freq"))


def frequency_list(tables: Tables, annotations: list[str], metadata: list[str] | None = None, documents: DataFrame | None = None, sensitivity: str = "s", least: int = 1) -> DataFrame:
    """Counts per combination of annotations and metadata fields; missing values are empty strings."""
    rows = tables.tokens
    cols = [F.coalesce(fold(F.col(tables.column(a)), sensitivity), F.lit("")).alias(a) for a in annotations]
    if metadata:
        # tokens are counted per document first, so the metadata join sees counts and not tokens
        per_doc = rows.select("doc_id", *cols).groupBy("doc_id", *annotations).agg(F.count("*").alias("n"))
        meta = documents.select("doc_id", *[pr.field_value(documents, m).alias(m) for m in metadata])
        return per_doc.join(meta, "doc_id").groupBy(*annotations, *metadata).agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
    return rows.groupBy(*cols).agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def autocomplete(tables: Tables, prefix: str, annotation: str | None = None, most: int = 30, sensitivity: str = "i") -> DataFrame:
    """The first terms with a prefix, in order."""
    term = fold(F.col(tables.column(annotation)), sensitivity).alias("term")
    return tables.rows().select(term).where(F.col("term").startswith(fold_text(prefix, sensitivity))).distinct().orderBy("term").limit(most)


def field_values(documents: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """A metadata field's values and numbers of documents; with `most`, see `most_frequent`."""
    kind = dict(documents.dtypes)[name]
    value = F.explode(name) if kind.startswith("array") else F.col(name).cast("string")
    counts = documents.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("docs"))
    return counts if most is None else most_frequent(counts, "docs", most)


def annotation_values(tables: Tables, annotation: str, most: int | None = None) -> DataFrame:
    """An annotation's values and numbers of tokens; with `most`, see `most_frequent`."""
    name = tables.column(annotation)
    counts = tables.tokens.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("freq"))
    return counts if most is None else most_frequent(counts, "freq", most)


def most_frequent(counts: DataFrame, by: str, most: int) -> DataFrame:
    """The `most` most frequent values, and in `truncated` whether there are more."""
    top = counts.orderBy(F.desc(by), "value").limit(most + 1)
    ranked = top.withColumn("_r", F.row_number().over(W.orderBy(F.desc(by), "value"))).withColumn("truncated", F.count("*").over(W.partitionBy()) > most)
    return ranked.where(F.col("_r") <= most).drop("_r")


def tokens_per_value(documents: DataFrame, name: str) -> DataFrame:
    return documents.groupBy(pr.field_value(documents, name).alias("value")).agg(F.sum(F.coalesce("length_tokens", F.lit(0))).cast("bigint").alias("tokens"), F.count("*").alias("docs"))
