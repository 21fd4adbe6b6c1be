"""Pattern tree to DataFrame. Conditions on one token become one column expression over the tokens; everything
else becomes span algebra. The compiler runs on the driver only; Catalyst and adaptive execution do the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import fold, fold_text, matches
from spanloom.operators import relations as rel
from spanloom.operators import spans as sp
from spanloom.plans import nodes as n
from spanloom.plans.nodes import Node
from spanloom.plans.rewrite import normalise


class CompileError(ValueError):
    """The pattern can't be run on this corpus."""


@dataclass
class Tables:
    """What a pattern is run on.

    tokens: doc_id, pos and one string column per annotation, optionally `<annotation>_all` arrays with every value at the position;
    spans: doc_id, tag, start_pos, end_pos, attrs map; relations: see `operators.relations`. Fields other than the main one
    are in `fields`, by name.
    """

    tokens: DataFrame
    spans: DataFrame | None = None
    relations: DataFrame | None = None
    #: Annotation names to column names, where they differ; the first one is the main annotation.
    annotations: dict[str, str] = field(default_factory=lambda: {"word": "word", "lemma": "lemma", "pos": "a_pos"})
    lengths: DataFrame | None = None
    fields: dict[str, Tables] = field(default_factory=dict)
    name: str = "contents"
    #: The classes of `relations`, where they are known.
    relation_classes: tuple[str, ...] | None = None
    #: The tokens as stored, in which rows may be repeated. Conditions are checked there, so that they reach the scan, and
    #: only what matches is made distinct. Not needed where `tokens` itself is stored without repeats.
    stored: DataFrame | None = None

    def rows(self) -> DataFrame:
        return self.tokens if self.stored is None else self.stored

    def length_table(self) -> DataFrame:
        """doc_id, length: the true number of tokens."""
        if self.lengths is None:
            self.lengths = self.rows().groupBy("doc_id").agg((F.max("pos") + 1).alias("length"))
        return self.lengths

    def column(self, annotation: str | None) -> str:
        if annotation is None:
            return next(iter(self.annotations.values()))
        name = annotation.replace("/", "_")
        if name in self.annotations:
            return self.annotations[name]
        if name in self.tokens.columns and name not in ("doc_id", "pos"):
            return name
        raise CompileError(f"no annotation {annotation}")


@dataclass
class Compiler:
    tables: Tables
    annotation: str | None = None
    sensitivity: str = "i"
    relation_class: str | None = None
    used: set[str] = field(default_factory=set)
    functions: dict = field(default_factory=dict)
    #: Only the first value at a position counts.
    first_value: bool = False

    # -- conditions on one token

    def condition(self, e: Node) -> Column:
        if isinstance(e, n.Is):
            return self._value(e.annotation or self.annotation, e.value)
        if isinstance(e, n.Any_):
            return F.lit(True)
        if isinstance(e, n.And):
            return reduce(Column.__and__, map(self.condition, e.parts))
        if isinstance(e, n.Or):
            return reduce(Column.__or__, map(self.condition, e.parts))
        if isinstance(e, n.Not):
            return ~self.condition(e.part)
        if isinstance(e, n.Sensitive):
            return replace(self, sensitivity=e.sensitivity).condition(e.part)
        if isinstance(e, n.OnAnnotation):
            return replace(self, annotation=e.annotation).condition(e.part)
        raise CompileError(f"not a condition on one token: {e}")

    def _value(self, annotation: str | None, value: n.Value) -> Column:
        """The first value at the position, or any of all values where there are several."""
        name = self.tables.column(annotation)
        folded = f"{name}_i"  # written beside the annotation, it lets equality and prefixes reach the scan
        ready = folded in self.tables.tokens.columns and (value.sensitivity or self.sensitivity) == "i" and value.kind != "range"
        own = matches(F.col(folded), value, self.sensitivity, folded=True) if ready else matches(F.col(name), value, self.sensitivity)
        several = f"{name}_all"
        if self.first_value or several not in self.tables.tokens.columns:
            return own
        return own | F.coalesce(F.exists(F.col(several), lambda x: matches(x, value, self.sensitivity)), F.lit(False))

    def tokens_where(self, e: Node) -> DataFrame:
        place = ["doc_id", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos")]
        rows = self.tables.rows()
        if isinstance(e, n.Is):
            name = self.tables.column(e.annotation or self.annotation)
            if f"{name}_i" in rows.columns and f"{name}_all" in rows.columns:
                # two scans that each push their filter down, instead of one whose OR can't be
                first = rows.where(replace(self, first_value=True).condition(e)).select(*place)
                return first.unionByName(rows.where(F.col(f"{name}_all").isNotNull()).where(self.condition(e)).select(*place)).distinct()
        hits = rows.where(self.condition(e)).select(*place)
        return hits if self.tables.stored is None else hits.distinct()

    # -- everything else

    def hits(self, e: Node) -> DataFrame:
        if n.is_token(e):
            return self.tokens_where(e)
        return getattr(self, f"_{type(e).__name__.rstrip('_').lower()}")(e)

    def _any(self, e: n.Any_) -> DataFrame:
        return sp.any_tokens(self.tables.length_table(), e.low, e.high)

    def _default(self, e: n.Default) -> DataFrame:
        return self._any(n.Any_(1, n.MANY))

    def _nothing(self, e: n.Nothing) -> DataFrame:
        return self.tokens_where(n.Any_()).where(F.lit(False))

    def _and(self, e: n.And) -> DataFrame:
        tokens = [p for p in e.parts if n.is_token(p)]
        rest = [p for p in e.parts if not n.is_token(p) and not isinstance(p, n.Default)]
        negative = [p for p in rest if isinstance(p, n.Not)]
        positive = [self.hits(p) for p in rest if p not in negative]
        if tokens:  # one column expression, and one-token hits: a negation is then an exclusion of the covered tokens
            positive.insert(0, self.hits(n.And(tuple(tokens)) if len(tokens) > 1 else tokens[0]))
        out = reduce(sp.both, positive) if positive else self.hits(negative.pop())
        for p in negative:
            out = sp.both(out, self.hits(p))
        return out

    def _or(self, e: n.Or) -> DataFrame:
        tokens = [p for p in e.parts if n.is_token(p)]
        rest = [p for p in e.parts if not n.is_token(p)]
        parts = ([self.hits(n.Or(tuple(tokens)) if len(tokens) > 1 else tokens[0])] if tokens else []) + [self.hits(p) for p in rest]
        return sp.either(parts)

    def _not(self, e: n.Not) -> DataFrame:
        return sp.uncovered(self.tables.tokens, self.hits(e.part))

    def _seq(self, e: n.Seq) -> DataFrame:
        out, so_far = self.hits(e.parts[0]), n.extent(e.parts[0])
        for p in e.parts[1:]:
            size = n.extent(p)
            out = sp.followed_by(out, self.hits(p), so_far.fixed or size.fixed)
            so_far = n.Extent(so_far.low + size.low, min(so_far.high + size.high, n.MANY))
        return out

    def _gap(self, e: n.Gap) -> DataFrame:
        return sp.with_gap(self.hits(e.left), self.hits(e.right), e.low, e.high, n.extent(e.left).fixed and n.extent(e.right).fixed)

    def _repeat(self, e: n.Repeat) -> DataFrame:
        part = self.hits(e.part)
        size = n.extent(e.part)
        if size == n.Extent(1, 1) and not sp.captures(part):
            return sp.runs(part, max(e.low, 1), e.high)
        return sp.repeat(part, e.low, e.high)

    def _expand(self, e: n.Expand) -> DataFrame:
        lengths = self.tables.length_table() if e.direction == "right" else None
        return sp.expand(self.hits(e.part), e.direction, e.low, e.high, lengths, n.extent(e.part).fixed)

    def _extended(self, e: n.Extended) -> DataFrame:
        return sp.extended(self.hits(e.base), self.hits(e.part), e.direction)

    def _capture(self, e: n.Capture) -> DataFrame:
        self.used.add(e.name)
        return sp.capture(self.hits(e.part), e.name)

    def fresh(self, wanted: str, default: str) -> str:
        """An automatic capture name: the letters of what is wanted, made unique."""
        base = "".join(c for c in wanted if c.isalpha() and c.isascii()) or default
        name, i = base, 2
        while name in self.used:
            name, i = f"{base}{i}", i + 1
        self.used.add(name)
        return name

    def span_rows(self, e: n.Tag) -> DataFrame:
        if self.tables.spans is None:
            raise CompileError("this corpus has no spans")
        name = n.Value(e.name, "literal" if re.fullmatch(r"[\w-]+", e.name) else "regex")
        ready = "tag_i" in self.tables.spans.columns
        test = matches(F.col("tag_i" if ready else "tag"), name, folded=ready)
        for key, value in e.attributes:
            test = test & matches(F.element_at("attrs", F.lit(key)), value)
        return self.tables.spans.where(test).select("doc_id", "start_pos", "end_pos").where("start_pos >= 0 AND end_pos >= start_pos").distinct()

    def _tag(self, e: n.Tag) -> DataFrame:
        rows = self.span_rows(e)
        if e.label:
            self.used.add(e.label)
        rows = sp.capture(rows, e.label or self.fresh(e.name, "tag"))
        return rows if e.edge == "full" else sp.edge(rows, e.edge == "end")

    def _edge(self, e: n.Edge) -> DataFrame:
        return sp.edge(self.hits(e.part), e.trailing)

    def _filter(self, e: n.Filter) -> DataFrame:
        return sp.filtered(self.hits(e.part), self.hits(e.by), e.operation, e.invert, e.left, e.right)

    def _ngrams(self, e: n.NGrams) -> DataFrame:
        return sp.ngrams(self.hits(e.by), e.operation, e.low, e.high, self.tables.length_table())

    def _overlap(self, e: n.Overlap) -> DataFrame:
        return sp.overlapping(self.hits(e.left), self.hits(e.right))

    def _oflength(self, e: n.OfLength) -> DataFrame:
        return sp.of_length(self.hits(e.part), e.low, e.high)

    def _fixed(self, e: n.Fixed) -> DataFrame:
        return sp.fixed(self.tables.length_table(), e.start, e.end)

    def _sensitive(self, e: n.Sensitive) -> DataFrame:
        return replace(self, sensitivity=e.sensitivity).hits(e.part)

    def _onannotation(self, e: n.OnAnnotation) -> DataFrame:
        return replace(self, annotation=e.annotation).hits(e.part)

    def _infield(self, e: n.InField) -> DataFrame:
        return replace(self, tables=self.field(e.field_name)).hits(e.part)

    def field(self, name: str) -> Tables:
        for known, t in self.tables.fields.items():
            if known == name or known.rpartition("__")[2] == name:
                return t
        raise CompileError(f"no field {name}")

    def _settings(self, e: n.Settings) -> DataFrame:
        values = dict(e.values)
        inner = replace(self, relation_class=values.get("relationclass", self.relation_class), sensitivity=values.get("sensitivity", self.sensitivity), annotation=values.get("annotation", self.annotation))
        out = inner.hits(e.part)
        if values.get("adjusthits") in ("yes", "true"):
            out = rel.respan(out, "all")
        if tag := values.get("context"):
            around = inner.span_rows(n.Tag(tag))
            listed = rel.capture_within(sp.capture(around, self.fresh(tag, "tag")), self.relations(), "context_rels")
            out = sp.filtered(out, listed, "within")
        return out

    # -- relations

    def relations(self) -> DataFrame:
        if self.tables.relations is None:
            raise CompileError("this corpus has no relations")
        return self.tables.relations

    def default_class(self) -> str:
        """The first class by name but spans; `rel` without any. Stored with the corpus, else looked for once per compiler."""
        if self.relation_class is None and self.tables.relation_classes is not None:
            named = sorted(c for c in self.tables.relation_classes if c and c != "__tag")
            self.relation_class = named[0] if named else "rel"
        if self.relation_class is None:
            found = self.relations().where("rel_class <> '__tag'").agg(F.min("rel_class")).first()[0]
            self.relation_class = found or "rel"
        return self.relation_class

    def relation_rows(self, kind: str) -> DataFrame:
        """Relations of a type: `class::type`, or a type of the default class."""
        cls, _, rest = kind.rpartition("::")
        rows = self.relations()
        test = matches(F.col("rel_type"), n.Value(rest or ".*", "regex"))
        cls_value = n.Value(cls or self.default_class(), "regex")
        return rows.where(matches(F.col("rel_class"), cls_value) & test)

    def _relationhits(self, e: n.RelationHits) -> DataFrame:
        rows = self.relation_rows(e.type)
        for key, value in e.attributes:
            rows = rows.where(matches(F.element_at(F.element_at("attrs", F.lit(key)), 1), value))
        name = e.capture or self.fresh(e.type.rpartition("::")[2], "rel")
        target = None if e.target is None or isinstance(e.target, n.Default) or e.target == n.Any_(0, n.MANY) else self.hits(e.target)
        return rel.relation_hits(rows, name, e.mode, e.direction, target)

    def _relations(self, e: n.Relations) -> DataFrame:
        if any(c.relation.alignment for c in e.children_):
            return self._alignment(e)
        out = None if e.parent is None or isinstance(e.parent, n.Default) or e.parent == n.Any_(0, n.MANY) else self.hits(e.parent)
        names: list[str] = []
        later = []
        for c in e.children_:
            r = c.relation
            inner = self if r.version is None else replace(self, tables=replace(self.field(r.version), fields=self.tables.fields))
            rows = self.relation_rows(r.type)
            if r.version is not None:
                rows = rows.where(F.col("tgt_field") == inner.tables.name)
            free = isinstance(c.target, n.Default) or c.target == n.Any_(0, n.MANY)
            target = None if free else inner.hits(c.target)
            name = c.label or self.fresh(r.type.rpartition("::")[2] + (f"__{r.version}" if r.version else ""), "rels" if r.negated else "rel")
            hits = rel.relation_hits(rows, name, "target" if r.root else "source", "root" if r.root else "both", target)
            if r.negated:
                later.append(sp.uncovered(self.tables.tokens, hits.select(*sp.KEYS)))
                continue
            out = hits if out is None else rel.both_unique(out, hits, names, name)
            names.append(name)
        out = rel.any_order(out, names)
        for free_tokens in later:
            out = free_tokens if out is None else sp.both(out, free_tokens)
        return out

    def _alignment(self, e: n.Relations) -> DataFrame:
        if e.parent is None:
            raise CompileError("an alignment needs a source")
        out = self._any(n.Any_(1, 1)) if isinstance(e.parent, n.Default) else self.hits(e.parent)
        for c in e.children_:
            r = c.relation
            other = self.field(r.version or "")
            inner = replace(self, tables=replace(other, fields=self.tables.fields))
            free = isinstance(c.target, n.Default) or c.target == n.Any_(0, n.MANY)
            target = None if free else inner.hits(c.target)
            rows = self.relation_rows(r.type).where(F.col("tgt_field") == other.name)
            name = c.label or self.fresh((r.type if r.type != ".*" else "") + "", "rels") + f"__{r.version}"
            out = rel.align(out, rows, target, name, r.optional)
        return out

    def _relationspan(self, e: n.RelationSpan) -> DataFrame:
        return rel.respan(self.hits(e.part), e.mode)

    def _relationfield(self, e: n.RelationField) -> DataFrame:
        return rel.in_other_field(self.hits(e.part), self.field(e.field_name).name)

    def _capturerelations(self, e: n.CaptureRelations) -> DataFrame:
        self.used.add(e.capture)
        return rel.capture_within(self.hits(e.part), self.relation_rows(e.type), e.capture, e.inside)

    def _call(self, e: n.Call) -> DataFrame:
        if e.name == "rmatch" and len(e.arguments) > 1:
            return self._matched(e.arguments)
        return self.hits(normalise(self.called(e)))  # what a function gives is a new tree

    def _matched(self, parts: tuple[Node, ...]) -> DataFrame:
        """AND of relations: each part must match a relation of its own."""
        out, names = None, []
        for p in parts:
            if isinstance(p, n.Default):
                continue
            hits = self.hits(normalise(p))
            own = rel.relation_captures(hits)
            name = own[-1].removeprefix("c_") if own else None
            out = hits if out is None else rel.both_unique(out, hits, names, name) if name else sp.both(out, hits)
            if name and name not in names:
                names.append(name)
        if out is None:
            raise CompileError("rmatch: an argument is missing")
        return rel.any_order(out, names)

    def called(self, e: n.Call) -> Node:
        """A function call as a tree; missing and `_` arguments take their defaults."""
        arguments = list(e.arguments)

        def given(i: int) -> bool:
            return i < len(arguments) and not isinstance(arguments[i], n.Default)

        def text(i: int, default: str) -> str:
            if not given(i):
                return default
            a = arguments[i]
            if isinstance(a, n.Is):
                return a.value.text
            raise CompileError(f"{e.name}: argument {i + 1} must be a string")

        def pattern(i: int) -> Node:
            if not given(i):
                raise CompileError(f"{e.name}: argument {i + 1} is missing")
            return arguments[i]

        if e.name == "rel":
            return n.RelationHits(text(0, ".*"), arguments[1] if given(1) else None, text(2, "source"), text(3, "") or None, text(4, "both"))
        if e.name == "rmatch":
            return pattern(0)
        if e.name == "rspan":
            return n.RelationSpan(pattern(0), text(1, "full"))
        if e.name == "rfield":
            return n.RelationField(pattern(0), text(1, ""))
        if e.name == "rcapture":
            return n.CaptureRelations(pattern(0), None, text(1, "captured_rels"), text(2, ".*"))
        if e.name == "rcapture2":
            return n.CaptureRelations(pattern(0), text(1, ""), text(2, "captured_rels"), text(3, ".*"))
        if e.name == "_ident":
            return pattern(0)
        if e.name in ("_FI1", "_FI2"):
            return n.Seq((pattern(0), pattern(1)))
        if e.name in self.functions:
            return self.functions[e.name](*arguments)
        raise CompileError(f"unknown function {e.name}")

    # -- constraints

    def _constrained(self, e: n.Constrained) -> DataFrame:
        hits = self.hits(e.part)
        names: dict[tuple[str, str], str] = {}
        _tokens_of(e.constraint, names)
        known = sp.captures(hits)
        for cap, _ in names:
            if f"c_{cap}" not in known:
                raise CompileError(f"no capture {cap}")
        for cap in dict.fromkeys(c for c, _ in names):
            wanted = [(a, col) for (c, a), col in names.items() if c == cap and a]
            if not wanted:
                continue
            look = self.tables.rows().select(F.col("doc_id").alias("_d"), F.col("pos").alias("_p"), *[fold(F.col(self.tables.column(a))).alias(col) for a, col in wanted])
            hits = hits.join(look, (F.col("doc_id") == F.col("_d")) & (F.col(f"c_{cap}.start") == F.col("_p")), "left").drop("_d", "_p")
        test = _truth(_constraint(e.constraint, names, known))
        return sp.distinct(hits.where(test).select(*sp.KEYS, *known))


def _tokens_of(c: n.Constraint, names: dict[tuple[str, str], str]) -> None:
    if isinstance(c, n.CToken):
        names.setdefault((c.capture, c.annotation or ""), f"_k{len(names)}")
    elif isinstance(c, n.CCall):
        names.setdefault((c.capture, ""), f"_k{len(names)}")
    elif isinstance(c, n.CNot):
        _tokens_of(c.part, names)
    elif isinstance(c, (n.CBool, n.CCompare)):
        _tokens_of(c.left, names)
        _tokens_of(c.right, names)


@dataclass
class _Value:
    """A constraint's value: kind is bool, int or text; null stands for undefined, which is falsy."""

    column: Column
    kind: str


def _truth(v: _Value) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    return v.column.isNotNull()


def _constraint(c: n.Constraint, names: dict[tuple[str, str], str], known: list[str]) -> _Value:
    sub = lambda x: _constraint(x, names, known)
    if isinstance(c, n.CText):
        return _Value(F.lit(fold_text(c.text)), "text")
    if isinstance(c, n.CNumber):
        return _Value(F.lit(c.number), "int")
    if isinstance(c, n.CToken):
        if c.annotation:
            return _Value(F.col(names[c.capture, c.annotation]), "text")
        return _Value(F.col(f"c_{c.capture}.start"), "int")
    if isinstance(c, n.CCall):
        return _Value(F.col(f"c_{c.capture}.{c.name}"), "int")
    if isinstance(c, n.CNot):
        return _Value(~_truth(sub(c.part)), "bool")
    if isinstance(c, n.CBool):
        a, b = _truth(sub(c.left)), _truth(sub(c.right))
        return _Value(a & b if c.operator == "&" else a | b if c.operator == "|" else ~a | b, "bool")
    if isinstance(c, n.CCompare):
        a, b = sub(c.left), sub(c.right)
        if a.kind != b.kind:
            if c.operator == "=":
                return _Value(F.lit(False), "bool")
            raise CompileError("a comparison of different kinds of values")
        x, y = a.column, b.column
        test = {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[c.operator]
        return _Value(F.coalesce(test, F.lit(False)), "bool")
    raise CompileError(f"not a constraint: {c}")


def run(pattern: str | Node, tables: Tables, **options) -> DataFrame:
    """Hits of a pattern: doc_id, start_pos, end_pos and the captures, each distinct combination once."""
    from spanloom.plans.parser import parse

    tree = normalise(parse(pattern) if isinstance(pattern, str) else pattern)
    return Compiler(tables, **options).hits(tree)
