"""The pattern tree: what a token pattern means, independent of how it is run."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

#: No upper bound of a repetition.
MANY = 1 << 30


class Node:
    """A pattern that matches spans of tokens."""

    def children(self) -> list[Node]:
        out = []
        for f in fields(self):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            out += [v] if isinstance(v, Node) else [x for x in v if isinstance(x, Node)] if isinstance(v, tuple) else []
        return out

    def map(self, change) -> Node:
        """The same node over changed children."""
        new = {}
        for f in fields(self):  # type: ignore[arg-type]
            v = getattr(self, f.name)
            if isinstance(v, Node):
                new[f.name] = change(v)
            elif isinstance(v, tuple) and any(isinstance(x, Node) for x in v):
                new[f.name] = tuple(change(x) if isinstance(x, Node) else x for x in v)
        return replace(self, **new) if new else self  # type: ignore[type-var]


# -- conditions on one token ---------------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """What an annotation or attribute is compared with. kind: regex, literal, range, wildcard, prefix or fuzzy."""

    text: str = ""
    kind: str = "regex"
    low: int = 0
    high: int = 0
    #: None: the default (insensitive); else `s`, `i`, `ci` (case-insensitive) or `di` (diacritics-insensitive).
    sensitivity: str | None = None


@dataclass(frozen=True)
class Is(Node):
    """The token's annotation has the value; None is the main annotation."""

    annotation: str | None
    value: Value


@dataclass(frozen=True)
class Any_(Node):
    """`[]`: low to high arbitrary tokens."""

    low: int = 1
    high: int = 1


@dataclass(frozen=True)
class Default(Node):
    """`_`: any number of tokens, or a function's default."""


@dataclass(frozen=True)
class Nothing(Node):
    """No hits."""


# -- combinations --------------------------------------------------------------------------------


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Not(Node):
    part: Node


@dataclass(frozen=True)
class Seq(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Gap(Node):
    """left, then low to high arbitrary tokens, then right."""

    left: Node
    right: Node
    low: int
    high: int


@dataclass(frozen=True)
class Repeat(Node):
    part: Node
    low: int
    high: int


@dataclass(frozen=True)
class Expand(Node):
    """Hits made longer by low to high tokens; direction: left or right."""

    part: Node
    direction: str
    low: int
    high: int


@dataclass(frozen=True)
class Extended(Node):
    """Hits of base as they are, and those with a hit of part on one side; direction: left or right."""

    base: Node
    part: Node
    direction: str = "right"


@dataclass(frozen=True)
class Capture(Node):
    name: str
    part: Node


@dataclass(frozen=True)
class Tag(Node):
    """Spans of a name. edge: full, start or end. label: the capture's name if given."""

    name: str
    attributes: tuple[tuple[str, Value], ...] = ()
    edge: str = "full"
    label: str | None = None


@dataclass(frozen=True)
class Edge(Node):
    """The leading or trailing edge of each hit, as a hit without tokens."""

    part: Node
    trailing: bool = False


@dataclass(frozen=True)
class Filter(Node):
    """Hits of `part` by their place against hits of `by`.

    operation: containing, containing_at_start, containing_at_end, within, starts_at, ends_at or matches.
    left and right are added to the edges of `part` for the comparison only.
    """

    part: Node
    by: Node
    operation: str
    invert: bool = False
    left: int = 0
    right: int = 0


@dataclass(frozen=True)
class NGrams(Node):
    """All spans of low to high tokens with the given place against hits of `by`."""

    by: Node
    operation: str
    low: int
    high: int


@dataclass(frozen=True)
class Overlap(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class OfLength(Node):
    part: Node
    low: int
    high: int


@dataclass(frozen=True)
class Fixed(Node):
    """The span [start, end) of every document that reaches so far."""

    start: int
    end: int


@dataclass(frozen=True)
class Constrained(Node):
    part: Node
    constraint: Constraint


@dataclass(frozen=True)
class Call(Node):
    name: str
    arguments: tuple[Any, ...]


@dataclass(frozen=True)
class Settings(Node):
    values: tuple[tuple[str, str], ...]
    part: Node


@dataclass(frozen=True)
class Sensitive(Node):
    """Another sensitivity for the values below that have none."""

    sensitivity: str
    part: Node


@dataclass(frozen=True)
class OnAnnotation(Node):
    """Another annotation for the values below that have none."""

    annotation: str
    part: Node


@dataclass(frozen=True)
class InField(Node):
    """Another annotated field for the part."""

    field_name: str
    part: Node


# -- relations -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class RelationType:
    """`-type->version`, `^-type->`, `!-type->`, `=type=>version?`."""

    type: str = ".*"
    root: bool = False
    negated: bool = False
    alignment: bool = False
    optional: bool = False
    version: str | None = None


@dataclass(frozen=True)
class Child:
    relation: RelationType
    target: Node
    label: str | None = None


@dataclass(frozen=True)
class Relations(Node):
    """parent -type-> target ; ... A None parent stands for root relations."""

    parent: Node | None
    children_: tuple[Child, ...]

    def children(self) -> list[Node]:
        return ([self.parent] if self.parent else []) + [c.target for c in self.children_]

    def map(self, change) -> Node:
        return Relations(change(self.parent) if self.parent else None, tuple(replace(c, target=change(c.target)) for c in self.children_))


@dataclass(frozen=True)
class RelationHits(Node):
    """`rel(type, target, spanMode, captureAs, direction)`."""

    type: str = ".*"
    target: Node | None = None
    mode: str = "source"
    capture: str | None = None
    direction: str = "both"
    attributes: tuple[tuple[str, Value], ...] = ()


@dataclass(frozen=True)
class RelationSpan(Node):
    """`rspan`: hits moved to the source, target, full extent, or all of their relations."""

    part: Node
    mode: str


@dataclass(frozen=True)
class RelationField(Node):
    """`rfield`: the hits in the other field."""

    part: Node
    field_name: str


@dataclass(frozen=True)
class CaptureRelations(Node):
    """`rcapture`: a list capture of the relations within the hit, or within a capture of it."""

    part: Node
    inside: str | None = None
    capture: str = "captured_rels"
    type: str = ".*"


# -- constraints ---------------------------------------------------------------------------------


class Constraint:
    pass


@dataclass(frozen=True)
class CBool(Constraint):
    """operator: &, | or ->."""

    operator: str
    left: Constraint
    right: Constraint


@dataclass(frozen=True)
class CNot(Constraint):
    part: Constraint


@dataclass(frozen=True)
class CCompare(Constraint):
    operator: str
    left: Constraint
    right: Constraint


@dataclass(frozen=True)
class CText(Constraint):
    text: str


@dataclass(frozen=True)
class CNumber(Constraint):
    number: int


@dataclass(frozen=True)
class CToken(Constraint):
    """`A.word`, or `A` alone: the position of the capture's first token."""

    capture: str
    annotation: str | None = None


@dataclass(frozen=True)
class CCall(Constraint):
    """`start(A)` or `end(A)`."""

    name: str
    capture: str


# -- what can be told without running --------------------------------------------------------------


@dataclass(frozen=True)
class Extent:
    """The least and greatest number of tokens of a hit."""

    low: int
    high: int

    @property
    def fixed(self) -> bool:
        return self.low == self.high


def _plus(a: int, b: int) -> int:
    return min(a + b, MANY)


def _times(a: int, b: int) -> int:
    return MANY if a >= MANY or b >= MANY else min(a * b, MANY)


def extent(n: Node) -> Extent:
    if isinstance(n, Is):
        return Extent(1, 1)
    if isinstance(n, (Any_, NGrams)):
        return Extent(n.low, n.high)
    if isinstance(n, Not):
        return Extent(1, 1)
    if isinstance(n, Default):
        return Extent(0, MANY)
    if isinstance(n, Or):
        e = [extent(p) for p in n.parts]
        return Extent(min(x.low for x in e), max(x.high for x in e))
    if isinstance(n, And):
        e = [extent(p) for p in n.parts if not isinstance(p, Default)] or [Extent(0, MANY)]
        return Extent(max(x.low for x in e), min(x.high for x in e))
    if isinstance(n, Seq):
        low = high = 0
        for p in n.parts:
            e = extent(p)
            low, high = _plus(low, e.low), _plus(high, e.high)
        return Extent(low, high)
    if isinstance(n, Gap):
        a, b = extent(n.left), extent(n.right)
        return Extent(a.low + b.low + n.low, _plus(_plus(a.high, b.high), n.high))
    if isinstance(n, Repeat):
        e = extent(n.part)
        return Extent(_times(e.low, n.low), _times(e.high, n.high))
    if isinstance(n, Expand):
        e = extent(n.part)
        return Extent(e.low, _plus(e.high, n.high))
    if isinstance(n, Extended):
        e = extent(n.base)
        return Extent(e.low, _plus(e.high, extent(n.part).high))
    if isinstance(n, OfLength):
        e = extent(n.part)
        return Extent(max(e.low, n.low), min(e.high, n.high))
    if isinstance(n, Edge) or isinstance(n, Tag) and n.edge != "full":
        return Extent(0, 0)
    if isinstance(n, Settings) and dict(n.values).keys() & {"adjusthits", "context"}:
        return Extent(0, MANY)
    if isinstance(n, (Capture, Filter, Constrained, Settings, Sensitive, OnAnnotation, InField, CaptureRelations)):
        return extent(n.part)
    if isinstance(n, Fixed):
        return Extent(n.end - n.start, n.end - n.start)
    if isinstance(n, Relations) and n.parent is not None and not any(c.relation.alignment for c in n.children_):
        return extent(n.parent)
    return Extent(1, MANY) if isinstance(n, Tag) else Extent(0, MANY)


def is_token(n: Node) -> bool:
    """Whether the pattern is a condition on one token, and so one column expression."""
    if isinstance(n, Is):
        return True
    if isinstance(n, Any_):
        return n.low == n.high == 1
    if isinstance(n, (And, Or)):
        return all(is_token(p) for p in n.parts)
    if isinstance(n, Not):
        return is_token(n.part)
    return isinstance(n, (Sensitive, OnAnnotation)) and is_token(n.part)
