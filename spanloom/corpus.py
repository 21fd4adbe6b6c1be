"""The corpus handle: search, documents, terms and description over one set of tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import relations as rl
from spanloom.operators import results as rs
from spanloom.operators import spans as sp
from spanloom.plans import contextql, docfilter, serialise
from spanloom.plans.compiler import Compiler, Tables
from spanloom.plans.nodes import Any_, Node
from spanloom.plans.parser import fill_template, parse, template_values
from spanloom.plans.rewrite import normalise


#: Relation classes that a corpus may have; they are names of layers, and few.
MOST_CLASSES = 10_000


@dataclass
class Hits:
    """Hits of a pattern, with what can be done next. Each step is a new handle over a lazy plan."""

    frame: DataFrame
    corpus: Corpus
    tree: Node | None = None
    #: The tables that all hits of `tree` come from, while no hit has been left out.
    whole: Tables | None = None

    def _next(self, df: DataFrame) -> Hits:
        return Hits(df, self.corpus, self.tree)

    def sort(self, by: str) -> Hits:
        return self._next(rs.sort_hits(self.frame, self.corpus.tables, by, self.corpus.docs))

    def filter(self, by: str, value: str) -> Hits:
        return self._next(rs.filter_hits(self.frame, self.corpus.tables, by, value, self.corpus.docs))

    def sample(self, number: int | None = None, fraction: float | None = None, seed: int = 1) -> Hits:
        return self._next(rs.sample(self.frame, number, fraction, seed, sp.KEYS))

    def window(self, first: int, number: int) -> Hits:
        return self._next(rs.window(self.frame, first, number))

    def group(self, by: str, keep: int = 0) -> DataFrame:
        if not keep and self.tree == Any_() and rs.only_tokens(by) and self.whole is not None:
            return rs.group_tokens(self.whole, by, self.corpus.docs)
        return rs.group_hits(self.frame, self.corpus.tables, by, self.corpus.docs, keep)

    def view_group(self, by: str, identity: list) -> Hits:
        return self._next(rs.view_group(self.frame, self.corpus.tables, by, identity, self.corpus.docs))

    def count(self) -> DataFrame:
        return rs.count_hits(self.frame)

    def docs(self, keep: int = 0) -> DataFrame:
        per = rs.per_document(self.frame, keep)
        return per if self.corpus.docs is None else per.join(self.corpus.docs, "doc_id")

    def kwic(self, annotations: list[str] | None = None, before: int = 5, after: int = 5) -> DataFrame:
        return rs.kwic(self.frame, self.corpus.tables, annotations, before, after)

    def concordance(self, before: int = 5, after: int = 5, original: bool = False) -> DataFrame:
        """Running text around the hits, from the tokens or, with its markup, from the documents' originals."""
        if original:
            return rs.original_concordance(self.corpus.docs, self.frame, self.corpus.tables, before, after)
        return rs.concordance(self.frame, self.corpus.tables, before, after)

    def collocations(self, annotation: str | None = None, before: int = 5, after: int = 5, sensitivity: str = "i") -> DataFrame:
        return rs.collocations(self.frame, self.corpus.tables, annotation, before, after, sensitivity)

    def csv(self, annotations: list[str] | None = None, before: int = 5, after: int = 5, summary: bool = True, declare_separator: bool = False, most: int = 100_000) -> str:
        """A small result as CSV text, with a block in front that says what was asked and found."""
        from spanloom.sources import sinks

        block = {}
        if summary:
            n = self.count().first()
            block = {"pattern": serialise.to_json(self.tree) if self.tree else "", "numberOfHits": n["hits"], "numberOfDocs": n["docs"], "contextBefore": before, "contextAfter": after}
        return sinks.csv_text(self.kwic(annotations, before, after), declare_separator, most, block)

    def contents(self, pid: str) -> str | None:
        """A document's original with these hits marked in it."""
        doc = self.corpus.docs.where(F.col(self.corpus.pid) == pid).select("doc_id", "raw").first()
        if doc is None:
            return None
        own = self.frame.where(F.col("doc_id") == doc["doc_id"])
        spots = rs.original_concordance(self.corpus.docs.where(F.col(self.corpus.pid) == pid), own, self.corpus.tables, 0, 0)
        where = spots.join(self.corpus.tables.tokens.select("doc_id", F.col("pos").alias("start_pos"), "char_start"), ["doc_id", "start_pos"])
        ranges = [(r["char_start"], r["char_start"] + len(r["match_raw"])) for r in where.select("char_start", "match_raw").collect()]
        return rs.highlight(doc["raw"], ranges)

    def explain(self) -> str:
        """The pattern as it was, as it is run, and the plan."""
        plan = self.frame.sparkSession._jvm.PythonSQLUtils.explainString(self.frame._jdf.queryExecution(), "formatted")
        return f"{serialise.to_json(self.tree) if self.tree else ''}\n{plan}"


@dataclass
class Corpus:
    tables: Tables
    docs: DataFrame | None = None
    functions: dict = field(default_factory=dict)
    #: What the descriptor says about the corpus: names, special fields, groups of fields.
    config: dict = field(default_factory=dict)
    _kept: dict = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, path: str, **options) -> Corpus:
        """Tables written by `sinks.write_corpus`; spans and relations may be missing."""

        def there(name: str) -> DataFrame | None:
            try:
                return spark.read.parquet(f"{path}/{name}.parquet")
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" in str(e):
                    return None
                raise

        tokens = there("tokens")
        if tokens is None:
            raise FileNotFoundError(f"no tokens in {path}")
        structural = ("doc_id", "pos", "field", "char_start", "char_end")
        names = [c for c in tokens.columns if c not in structural and not (c.endswith(("_all", "_i")) and c.rpartition("_")[0] in tokens.columns)]
        classes = there("relation_classes")
        known = None if classes is None else tuple(r["rel_class"] for r in classes.limit(MOST_CLASSES).collect())
        tables = Tables(tokens, there("spans"), there("relations"), {"pos" if c == "a_pos" else c: c for c in names}, there("lengths"), relation_classes=known)
        try:
            options = {"config": json.loads(spark.read.text(f"{path}/config").first()[0])} | options
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        return Corpus(tables, there("docs"), **options)

    @staticmethod
    def formats() -> dict[str, str]:
        """The input formats that are known, with the names to show."""
        from spanloom.sources import loaders

        return {n: f.display_name or n for n, f in sorted(loaders.FORMATS.items())}

    @staticmethod
    def add(loaded, path: str) -> Corpus:
        """Adds loaded documents to a written corpus, which is made if it isn't there. Documents that are there already must be deleted first."""
        from spanloom.sources import sinks

        tables = {"docs": loaded.docs(), "tokens": loaded.tokens(), "spans": loaded.spans(), "relations": loaded.relations()}
        sinks.write_corpus(tables, path, "append", config=loaded.form.extra)
        return Corpus.open(loaded.parsed.sparkSession, path)

    def without(self, filter: str, path: str) -> Corpus:
        """Writes the corpus without the documents of a filter to another place."""
        from spanloom.sources import sinks

        t = self.tables
        left = sinks.delete_documents({"docs": self.docs, "tokens": t.tokens} | ({"spans": t.spans} if t.spans is not None else {}) | ({"relations": t.relations} if t.relations is not None else {}), filter)
        sinks.write_corpus(left, path, config=self.config)
        return Corpus.open(self.docs.sparkSession, path, functions=self.functions)

    @property
    def pid(self) -> str:
        """The field that documents are named by."""
        return self.config.get("specialFields", {}).get("pidField", "pid")

    def field_info(self, name: str, most: int = 200) -> dict:
        """What a metadata field or an annotation holds: its kind, its most frequent values with their numbers, and whether there are more."""
        if self.docs is not None and name in self.docs.columns:
            rows = rs.field_values(self.docs, name, most).collect()
            return {"name": name, "is": "metadata", "type": dict(self.docs.dtypes)[name], "values": {r["value"]: r["docs"] for r in rows}, "truncated": bool(rows) and rows[0]["truncated"]}
        rows = rs.annotation_values(self.tables, name, most).collect()
        column = self.tables.column(name)
        found = {r["value"]: r["freq"] for r in rows}
        return {"name": name, "is": "annotation", "main": name == next(iter(self.tables.annotations)), "folded": f"{column}_i" in self.tables.tokens.columns, "several": f"{column}_all" in self.tables.tokens.columns, "values": found, "truncated": bool(rows) and rows[0]["truncated"]}

    def parse(self, pattern: str, language: str = "default") -> tuple[Node, str | None]:
        """A pattern and a filter from text in the pattern language, JSON, or contextual query language."""
        if language == "contextql":
            q = contextql.parse_contextual(pattern)
            if q.pattern is None:
                raise ValueError("the query has no pattern")
            return q.pattern, q.filter
        if language == "json" or language == "default" and pattern.lstrip().startswith('{"node"'):
            return serialise.from_json(pattern), None
        return parse(pattern), None

    def register(self, name: str, function) -> None:
        """A query function: trees in, a tree out."""
        self.functions[name] = function

    def search(self, pattern: str | Node, filter: str | None = None, language: str = "default", gaps: str | None = None, keep: bool = False) -> Hits:
        """Hits of a pattern, in the documents of a filter. The filter comes first, so tokens of other documents are never joined.

        gaps: TSV text whose columns fill the pattern's gaps `@@`. keep: persist the hits and reuse them for the same search.
        """
        if isinstance(pattern, str) and gaps is not None:
            pattern = fill_template(pattern, template_values(gaps))
        tree, also = (pattern, None) if isinstance(pattern, Node) else self.parse(pattern, language)
        tree = normalise(tree)
        key = (serialise.to_json(tree), filter, also)
        if key in self._kept:
            return self._kept[key]
        t = self.tables
        for text in (filter, also):
            if text:
                wanted = docfilter.filter_documents(self.docs, text).select("doc_id")
                inside = {x: sp.in_documents(d, wanted) for x in ("tokens", "spans", "relations", "stored") if (d := getattr(t, x)) is not None}
                t = replace(t, **inside, lengths=None)
        hits = Hits(Compiler(t, functions=self.functions).hits(tree), self, tree, t)
        if keep:
            hits.frame = hits.frame.persist()
            self._kept[key] = hits
        return hits

    def forget(self) -> None:
        for h in self._kept.values():
            h.frame.unpersist()
        self._kept.clear()

    def documents(self, filter: str | None = None) -> DataFrame:
        return self.docs if not filter else docfilter.filter_documents(self.docs, filter)

    def contents(self, pid: str) -> str | None:
        """A document's original."""
        row = self.docs.where(F.col(self.pid) == pid).select("raw").first()
        return row and row["raw"]

    def doc(self, pid: str) -> DataFrame:
        return self.docs.where(F.col(self.pid) == pid)

    def termfreq(self, annotation: str | None = None, sensitivity: str = "i", filter: str | None = None, terms: list[str] | None = None) -> DataFrame:
        return rs.term_frequencies(self.tables, annotation, sensitivity, self.documents(filter) if filter else None, terms)

    def autocomplete(self, prefix: str, annotation: str | None = None, most: int = 30) -> DataFrame:
        return rs.autocomplete(self.tables, prefix, annotation, most)

    def relation_statistics(self, limit_values: int | None = 200) -> DataFrame:
        rows = self.tables.relations
        if self.tables.spans is not None:
            spans = rl.span_relations(self.tables.spans)
            rows = spans if rows is None else rows.unionByName(spans)
        return rl.statistics(rows, limit_values)

    def describe(self) -> dict:
        """Annotations, metadata fields with their kinds, and sizes."""
        n = self.tables.tokens.agg(F.count("*").alias("tokens"), F.countDistinct("doc_id").alias("docs")).first()
        fields = {c: t for c, t in self.docs.dtypes if c != "raw"} if self.docs is not None else {}
        return {"annotations": list(self.tables.annotations), "metadata": fields, "tokens": n["tokens"], "documents": n["docs"], "spans": self.tables.spans is not None, "relations": self.tables.relations is not None, "fields": list(self.tables.fields), "name": self.config.get("displayName", ""), "pidField": self.pid, "kept": len(self._kept)}
