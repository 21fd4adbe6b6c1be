"""Deeply nested records into related flat tables, through a tree automaton over object shapes.

The automaton reads JSON trees bottom-up. What a parent sees of a child is the child's class: its kind, and of a list or
an object also the kinds of its members. The state of an object is the set of pairs (field, class of the value), where a
field that the schema doesn't know counts as `*`. Kinds are six, so classes and states are finitely many whatever the size or depth
of a tree, and no step looks further down than two levels: nothing recurses. States are interned in a table that grows lazily and is
shared by all rows of a task; whether a state can be read as a record of a role, as a keyed collection ("object by name") or
as a list, and which variant of the role it is, is decided once per (state, role), not once per node.

The schema lists roles, from the root down: a role's typed columns, its variants and its child collections. Every object that
the automaton accepts is routed to the subtype table of its role and variant, which has the columns that this variant can
have. All subtype tables share the supertype's keys: the document's key, role, variant, and the places and names of all ancestors.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL, NUMBER, TEXT, FLAG, LIST, OBJECT = "null", "number", "text", "flag", "list", "object"
SCALARS = frozenset({NUMBER, TEXT, FLAG})
INT = pa.int64()
STR = pa.string()
BOOL = pa.bool_()
#: A map, as its entries: rows with maps can't be compared.
TEXTS = pa.list_(pa.struct([pa.field("key", pa.string(), False), pa.field("value", pa.list_(pa.string()))]))
STRINGS = pa.list_(pa.string())
PLAIN = "plain"


@dataclass(frozen=True)
class Column:
    """A typed column of a role: the output name, the path of fields below the object and the type."""

    name: str
    path: tuple[str, ...]
    type: pa.DataType


@dataclass(frozen=True)
class Role:
    """A kind of object. `variants`: name to the fields of which one must be there, in order; else `plain`."""

    name: str
    columns: tuple[Column, ...] = ()
    children: tuple[tuple[str, str], ...] = ()  # field, role of the child objects
    variants: tuple[tuple[str, tuple[str, ...]], ...] = ()
    name_field: str | None = None

    def __post_init__(self):
        if not all(wanted for _, wanted in self.variants):
            raise ValueError(f"a variant of {self.name} has no fields and could never be chosen")

    @property
    def fields(self) -> frozenset[str]:
        own = {c.path[0] for c in self.columns} | {f for f, _ in self.children} | {f for _, wanted in self.variants for f in wanted}
        return frozenset(own | ({self.name_field} if self.name_field else set()))

    @property
    def variant_names(self) -> tuple[str, ...]:
        return (*(v for v, _ in self.variants), PLAIN)

    def columns_of(self, variant: str | None = None) -> tuple[Column, ...]:
        """The columns an object of the variant can have: all but those whose field would have made it an earlier variant."""
        if variant is None:
            return self.columns
        if variant not in self.variant_names:
            raise ValueError(f"{self.name} has no variant {variant}")
        earlier = {f for _, wanted in self.variants[: self.variant_names.index(variant)] for f in wanted}
        return tuple(c for c in self.columns if c.path[0] not in earlier)


def kind_of(value: object) -> str:
    if value is None:
        return NULL
    if isinstance(value, str):
        return TEXT
    if isinstance(value, dict):
        return OBJECT
    if isinstance(value, list):
        return LIST
    return FLAG if isinstance(value, bool) else NUMBER


@dataclass
class TreeAutomaton:
    """The lazily grown transition table. States are small integers; `shape` describes them."""

    fields: frozenset[str]
    shape: list[frozenset] = field(default_factory=list)
    _delta: dict = field(default_factory=dict)
    _accept: dict = field(default_factory=dict)

    @staticmethod
    def seen(value: object) -> tuple[str, frozenset]:
        """The class of a node: all that its parent's transition depends on."""
        if isinstance(value, dict):
            return OBJECT, frozenset(map(kind_of, value.values()))
        if isinstance(value, list):
            return LIST, frozenset(map(kind_of, value))
        return kind_of(value), frozenset()

    def state(self, value: dict) -> int:
        """The transition of an object, from the classes of its fields' values."""
        known = self.fields
        shape = frozenset((k if k in known else "*", self.seen(v)) for k, v in value.items())
        state = self._delta.get(shape)
        if state is None:
            state = self._delta[shape] = len(self.shape)
            self.shape.append(shape)
        return state

    def is_record(self, state: int, role: Role) -> bool:
        """Whether the object is one record of the role: one of the role's fields is there in a fitting kind."""
        key = (state, role.name)
        if key not in self._accept:
            children = {f for f, _ in role.children}
            scalar = {c.path[0] for c in role.columns if len(c.path) == 1 and not pa.types.is_nested(c.type)}
            nested = {c.path[0] for c in role.columns} - scalar

            def fits(name: str, kind: str, members: frozenset) -> bool:
                if name == role.name_field or name in scalar:
                    return kind in SCALARS
                if name in nested:
                    return kind == OBJECT and LIST in members
                return name in children and kind == LIST

            self._accept[key] = any(fits(n, *c) for n, c in self.shape[state])
        return self._accept[key]

    def variant(self, state: int, role: Role) -> str:
        key = (state, role.name, "variant")
        if key not in self._accept:
            there = {n for n, (kind, _) in self.shape[state] if kind != NULL}
            self._accept[key] = next((v for v, wanted in role.variants if not there.isdisjoint(wanted)), PLAIN)
        return self._accept[key]


def _wide_int(digits: str) -> float | int:
    """Numbers of more digits than Python reads as an integer are read as numbers without end."""
    try:
        return int(digits)
    except ValueError:
        return float(digits)


_BLANK = re.compile(r"[ \t\n\r]*")


def _parse_deep(text: str) -> object:
    """JSON of any depth, with an explicit stack; the decoder in C is faster but gives up on deep nesting."""
    scalar = json.JSONDecoder(parse_int=_wide_int).raw_decode
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]  # containers, and the key that waits in each
    at, wants_value, first = _BLANK.match(text).end(), True, False
    while True:
        box, name = stack[-1]
        if wants_value:
            ch = text[at : at + 1]
            if ch == "]" and first and isinstance(box, list) and box is not root:
                stack.pop()
                at, wants_value = at + 1, False
            elif ch and ch in "[{":
                value: object = [] if ch == "[" else {}
                box.append(value) if isinstance(box, list) else box.__setitem__(name, value)
                stack.append((value, None))
                at, first = at + 1, True
                if ch == "{":
                    at, done = _key(text, at, stack, True)
                    wants_value = not done
            else:
                value, at = scalar(text, at)
                box.append(value) if isinstance(box, list) else box.__setitem__(name, value)
                wants_value = False
        else:
            if box is root:
                if at != len(text):
                    raise ValueError("text after the value")
                return root[0]
            ch = text[at : at + 1]
            if ch == ("]" if isinstance(box, list) else "}"):
                stack.pop()
                at += 1
            elif ch == ",":
                at, wants_value, first = at + 1, True, False
                if isinstance(box, dict):
                    at, _ = _key(text, at, stack, False)
            else:
                raise ValueError("a comma or an end is missing")
        at = _BLANK.match(text, at).end()


def _key(text: str, at: int, stack: list, may_end: bool) -> tuple[int, bool]:
    """Reads a field's name and colon into the top of the stack, or the end of an empty object."""
    at = _BLANK.match(text, at).end()
    if may_end and text[at : at + 1] == "}":
        stack.pop()
        return at + 1, True
    if text[at : at + 1] != '"':
        raise ValueError("a name is missing")
    name, at = json.decoder.scanstring(text, at + 1)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("a colon is missing")
    stack[-1] = (stack[-1][0], name)
    return at + 1, False


def parse_body(body: str | None) -> object:
    """The JSON value of a body; None if it is damaged.

    Invisible leading characters are skipped, and JSON text inside a JSON string is unwrapped however often it is wrapped.
    """
    while isinstance(body, str):
        start = 0
        while start < len(body) and (body[start].isspace() or unicodedata.category(body[start]) in ("Cf", "Cc")):
            start += 1
        text = body[start:] if start else body
        try:
            body = json.loads(text)
        except json.JSONDecodeError:
            return None
        except (RecursionError, ValueError):  # too deep, or a number too long, for the decoder
            try:
                body = _parse_deep(text)
            except ValueError:
                return None
    return body


def _integer(value: object) -> int | None:
    try:
        if isinstance(value, bool) or value is None:
            return None
        number = int(value.strip()) if isinstance(value, str) else int(value)
    except (ValueError, OverflowError, TypeError, AttributeError):
        return None
    return number if -(2**63) <= number < 2**63 else None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _dump_deep(value)


def _dump_deep(value: object) -> str:
    """JSON text of a value of any depth."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(True, value)]  # whether it is a value still to be written, or text
    while todo:
        is_value, v = todo.pop()
        if not is_value:
            out.append(v)
        elif isinstance(v, (dict, list)):
            named = isinstance(v, dict)
            parts: list[tuple[bool, object]] = [(False, "{" if named else "[")]
            for i, x in enumerate(v.items() if named else v):
                if i:
                    parts.append((False, ", "))
                if named:
                    parts.append((False, json.dumps(x[0], ensure_ascii=False) + ": "))
                parts.append((True, x[1] if named else x))
            parts.append((False, "}" if named else "]"))
            todo += reversed(parts)
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _number(value: object) -> int | None:
    return value if type(value) is int and -(2**63) <= value < 2**63 else _integer(value)


def _flag(value: object) -> bool | None:
    if value is None or isinstance(value, (bool, dict, list)):
        return value if isinstance(value, bool) else None
    return {"true": True, "false": False}.get(str(value).lower())


def _texts(value: object) -> list | None:
    return None if value is None else [_text(v) for v in (value if isinstance(value, list) else [value])]


def _entries(value: object) -> list | None:
    return [{"key": k, "value": _texts(v) or []} for k, v in value.items()] if isinstance(value, dict) else None


def converter(kind: pa.DataType):
    """What brings a value into the column's type: numbers given as text count as numbers, lone values as lists of one."""
    return next((f for t, f in ((INT, _number), (BOOL, _flag), (STRINGS, _texts), (TEXTS, _entries)) if t == kind), _text)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # half a surrogate pair, which JSON can hold and UTF-8 can't
        return pa.array(_whole(values), kind)


def _whole(value: object) -> object:
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, list):
        return [_whole(v) for v in value]
    return {k: _whole(v) for k, v in value.items()} if isinstance(value, dict) else value


def _at(value: object, path: tuple[str, ...]) -> object:
    for name in path:
        if not isinstance(value, dict):
            return None
        value = value.get(name)
    return value


class Shredder:
    """Walks the accepted roles of one document from the root down and yields rows."""

    def __init__(self, roles: tuple[Role, ...], root: str):
        self.roles = {r.name: r for r in roles}
        self.root = self.roles[root]
        self.automaton = TreeAutomaton(frozenset().union(*(r.fields for r in roles)))

    def members(self, value: object, role: Role) -> Iterator[tuple[int, str | None, dict]]:
        """The objects of a collection, whatever its form, as (place, key, object); nulls keep their place."""
        if isinstance(value, list):
            for i, v in enumerate(value):
                if isinstance(v, dict):
                    yield i, None, v
        elif isinstance(value, dict):
            if self.automaton.is_record(self.automaton.state(value), role):
                yield 0, None, value
            else:
                for i, (k, v) in enumerate(value.items()):
                    if isinstance(v, dict):
                        yield i, k, v

    def objects(self, tree: object) -> Iterator[tuple[Role, str, tuple, dict]]:
        """(role, variant, path of (place, name) below the root, object) of each accepted object."""
        if not isinstance(tree, dict):
            return
        todo = [(self.root, (), tree)]
        while todo:
            role, path, value = todo.pop()
            yield role, self.automaton.variant(self.automaton.state(value), role), path, value
            for name, child in role.children:
                if name in value:
                    below = self.roles[child]
                    for place, key, v in self.members(value[name], below):
                        label = key if key is not None else _text(v.get(below.name_field)) if below.name_field else None
                        todo.append((below, (*path, (place, label)), v))


@dataclass(frozen=True)
class Shredded:
    """Objects routed to the subtype tables. `routed` has the supertype's keys and one struct per subtype table, of which
    only the one of the row's role and variant is there; redelivered bodies aren't merged in it yet."""

    routed: DataFrame
    key: str
    roles: tuple[Role, ...]
    levels: tuple[str, ...]
    tables: tuple[tuple[str, str], ...]

    def places(self) -> list[str]:
        return [f"{x}_{y}" for x in self.levels for y in ("no", "name")]

    def supertype(self) -> DataFrame:
        """One row per object: the key, `role`, `variant`, the places and names of its ancestors and its own.

        Role and variant are those of the subtype table that the object lies in, so what isn't routed isn't there.
        """
        at = reduce(lambda rest, t: F.when(F.col(_struct(*t)).isNotNull(), F.struct(F.lit(t[0]).alias("role"), F.lit(t[1]).alias("variant"))).otherwise(rest), reversed(self.tables), F.lit(None))
        rows = self.routed.withColumn("_t", at).where("_t IS NOT NULL") if self.tables else self.routed.where(F.lit(False)).withColumn("_t", F.struct(F.lit("").alias("role"), F.lit("").alias("variant")))
        return rows.select(self.key, "_t.role", "_t.variant", *self.places()).distinct()

    def subtype(self, role: Role, variant: str, depth: int | None = None) -> DataFrame:
        """The table of one variant: the key, `variant`, the places of `depth` levels, and the typed columns that the variant can have."""
        own = self.places() if depth is None else self.places()[: 2 * depth]
        struct = _struct(role.name, variant)
        rows = self.routed.where(F.col(struct).isNotNull()).dropDuplicates([self.key, *self.places()])
        return rows.select(self.key, F.lit(variant).alias("variant"), *own, *[_column(struct, c) for c in role.columns_of(variant)])

    def table(self, role: Role, depth: int | None = None) -> DataFrame:
        """All variants of a role put together: the key, `variant`, places, and all the role's columns, null where a variant lacks them."""
        own = self.places() if depth is None else self.places()[: 2 * depth]
        structs = [(v, _struct(role.name, v)) for v in role.variant_names if (role.name, v) in self.tables]
        there = reduce(SparkColumn.__or__, [F.col(s).isNotNull() for _, s in structs])
        rows = self.routed.where(there).dropDuplicates([self.key, *self.places(), "role"])
        of = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(v)) for v, s in structs])
        columns = []
        for c in role.columns:
            has = [_column(s, c) for v, s in structs if c in role.columns_of(v)]
            columns.append((F.coalesce(*has) if has else F.lit(None)).alias(c.name))
        return rows.select(self.key, of.alias("variant"), *own, *columns)

    def write(self, path: str) -> None:
        """Writes all subtype tables in one pass over the bodies, a folder each; `read_subtype` reads one."""
        rows = self.routed.dropDuplicates([self.key, "role", *self.places()])
        rows.write.mode("overwrite").partitionBy("role", "variant").parquet(path)


def _struct(role: str, variant: str) -> str:
    return f"{role}_{variant}"


def _column(struct: str, c: Column) -> SparkColumn:
    value = F.col(f"{struct}.{c.name}")
    return (F.map_from_entries(value) if c.type == TEXTS else value).alias(c.name)


def read_subtype(spark: SparkSession, path: str, key: str, role: Role, variant: str, levels: tuple[str, ...]) -> DataFrame:
    """A subtype table that `Shredded.write` has written; only its own folder and columns are read."""
    rows = spark.read.parquet(path).where((F.col("role") == role.name) & (F.col("variant") == variant))
    places = [f"{x}_{y}" for x in levels for y in ("no", "name")]
    return rows.select(key, "variant", *places, *[_column(_struct(role.name, variant), c) for c in role.columns_of(variant)])


def shred(df: DataFrame, key: str, body: str, roles: tuple[Role, ...], root: str, levels: tuple[str, ...], only: Iterable[tuple[str, str]] | None = None) -> Shredded:
    """Routes each accepted object of every body to the subtype table of its role and variant.

    `levels` names the levels of nesting below the root: `<level>_no` is the 0-based place in the collection, `<level>_name` the name.
    `only`: the (role, variant) tables that are wanted; objects of others are walked through but not kept.

    Null, damaged and non-object bodies give no rows. Bodies may be nested to any depth and wrapped any number of times. Redelivered
    bodies count once: their rows have equal keys and places and are merged with a map-side combine; bodies themselves are never shuffled.
    Null keys form one group. Further columns of `df` are ignored, so names can't clash. Children of an object that isn't
    accepted are not reached.
    """
    every = [(r.name, v) for r in roles for v in r.variant_names]
    tables = tuple(every if only is None else [t for t in every if t in set(only)])
    by_name = {r.name: r for r in roles}
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    fields = [pa.field(key, to_arrow_type(df.schema[key].dataType)), pa.field("role", STR), pa.field("variant", STR)]
    for level in levels:
        fields += [pa.field(f"{level}_no", pa.int32()), pa.field(f"{level}_name", STR)]
    # a struct needs a field, so each has one that says it is there
    here = pa.field("_here", BOOL)
    fields += [pa.field(_struct(*t), pa.struct([here, *(pa.field(c.name, c.type) for c in by_name[t[0]].columns_of(t[1]))])) for t in tables]
    schema = pa.schema(fields)
    typed = {t: by_name[t[0]].columns_of(t[1]) for t in tables}
    n_common = 3 + 2 * len(levels)

    def batch_of(common: list[list], values: dict, rows_of: dict) -> pa.RecordBatch:
        n = len(common[0])
        arrays = [_array(v, t.type) for v, t in zip(common, schema)]
        for t in tables:
            struct = schema.field(_struct(*t)).type
            if not rows_of[t]:
                arrays.append(pa.nulls(n, struct))
                continue
            dense = pa.StructArray.from_arrays([pa.array([True] * len(rows_of[t])), *(_array(v, c.type) for v, c in zip(values[t], typed[t]))], fields=list(struct))
            at = [None] * n
            for i, row in enumerate(rows_of[t]):
                at[row] = i
            arrays.append(dense.take(pa.array(at, pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = Shredder(roles, root)
        how = {t: [(c.path[0] if len(c.path) == 1 else None, c.path, converter(c.type)) for c in cs] for t, cs in typed.items()}
        fresh = lambda: ([[] for _ in range(n_common)], {t: [[] for _ in typed[t]] for t in tables}, {t: [] for t in tables})
        common, values, rows_of = fresh()
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1)):
                k = k.as_py()
                for role, variant, path, value in shredder.objects(parse_body(text.as_py())):
                    t = (role.name, variant)
                    if t not in typed:
                        continue
                    rows_of[t].append(len(common[0]))
                    for into, (own, below, to) in zip(values[t], how[t]):
                        into.append(to(value.get(own) if own is not None else _at(value, below)))
                    flat: list = [k, role.name, variant]
                    for i in range(len(levels)):
                        flat += path[i] if i < len(path) else (None, None)
                    for into, v in zip(common, flat):
                        into.append(v)
                if len(common[0]) >= 20_000:
                    yield batch_of(common, values, rows_of)
                    common, values, rows_of = fresh()
        yield batch_of(common, values, rows_of)

    routed = df.select(key, body).where(F.col(body).isNotNull()).mapInArrow(run, from_arrow_schema(schema))
    return Shredded(routed, key, roles, levels, tables)


# The roles of a response to a "containing" query, in the project's terms.
_SPAN = (Column("start_pos", ("start",), INT), Column("end_pos", ("end",), INT))
_TARGET = (Column("target_start", ("targetStart",), INT), Column("target_end", ("targetEnd",), INT))
_SOURCE = (Column("source_start", ("sourceStart",), INT), Column("source_end", ("sourceEnd",), INT))
_REL = (Column("kind_type", ("type",), STR), Column("rel_type", ("relType",), STR))
RESPONSE = Role(
    "response",
    (Column("pattern", ("summary", "searchParam", "patt"), STR), Column("number_of_hits", ("summary", "numberOfHits"), INT)),
    (("hits", "hit"), ("docInfos", "doc")),
)
HIT = Role(
    "hit",
    (Column("doc_pid", ("docPid",), STR), *_SPAN, *(Column(f"{p}_{a}", (p, a), STRINGS) for p in ("left", "match", "right") for a in ("word", "lemma", "pos", "punct"))),
    (("captureGroups", "capture"), ("matchInfos", "info")),
)
DOC = Role("doc", (Column("title", ("title",), STRINGS), Column("pid", ("pid",), STRINGS), Column("length_tokens", ("lengthInTokens",), INT), Column("may_view", ("mayView",), BOOL)))
CAPTURE = Role("capture", _SPAN, name_field="name")
INFO = Role(
    "info",
    (*_REL, Column("tag_name", ("tagName",), STR), Column("attributes", ("attributes",), TEXTS), *_SPAN, *_SOURCE, *_TARGET),
    (("infos", "relation"),),
    (("list", ("infos",)), ("relation", ("relType", "targetStart", "sourceStart")), ("tag", ("tagName", "attributes")), ("span", ("start", "end", "type"))),
    "name",
)
RELATION = Role("relation", (*_REL, *_SOURCE, *_TARGET, Column("is_root", ("isRoot",), BOOL)), name_field="name", variants=(("edge", ("sourceStart",)), ("target_only", ("targetStart",))))
RESPONSE_ROLES = (RESPONSE, HIT, DOC, CAPTURE, INFO, RELATION)
RESPONSE_LEVELS = ("hit", "item", "nested")


def shred_responses(df: DataFrame, only: tuple[str, ...] | None = None, variant: str | None = None) -> Shredded:
    """The objects of all `containing` responses, of the roles in `only` and of one variant of them if it is given; see `shred`."""
    wanted = None if only is None else [(r.name, v) for r in RESPONSE_ROLES if r.name in only for v in r.variant_names if variant in (None, v)]
    return shred(df, "response_id", "body", RESPONSE_ROLES, "response", RESPONSE_LEVELS, wanted)
