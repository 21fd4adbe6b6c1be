"""Pattern trees to JSON and back, and to pattern text."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

from spanloom.plans import nodes as n

_TYPES = {c.__name__.rstrip("_").lower(): c for c in vars(n).values() if isinstance(c, type) and is_dataclass(c) and c is not n.Extent}


def to_json(tree: n.Node) -> str:
    return json.dumps(_tagged(tree), ensure_ascii=False)


def from_json(text: str) -> n.Node:
    return _untagged(json.loads(text))  # type: ignore[return-value]


def _tagged(x: object) -> object:
    if is_dataclass(x):
        return {"node": type(x).__name__.rstrip("_").lower()} | {f.name.rstrip("_"): _tagged(getattr(x, f.name)) for f in fields(x) if getattr(x, f.name) != f.default}
    return [_tagged(v) for v in x] if isinstance(x, tuple) else x


def _untagged(x: object) -> object:
    if isinstance(x, dict):
        kind = _TYPES.get(str(x.get("node")))
        if kind is None:
            raise ValueError(f"unknown node {x.get('node')!r}")
        known = {f.name.rstrip("_"): f.name for f in fields(kind)}
        return kind(**{known[k]: _untagged(v) for k, v in x.items() if k != "node"})
    return tuple(_untagged(v) for v in x) if isinstance(x, list) else x


# -- to text -----------------------------------------------------------------------------------------


def _quoted(v: n.Value) -> str:
    if v.kind == "range":
        return f"in[{v.low},{v.high}]"
    flag = {"s": "(?-i)", "i": "(?i)"}.get(v.sensitivity or "", "")
    text = v.text
    if v.kind == "prefix":
        text += ".*"
    elif v.kind == "literal" and any(c in set(".?+*|{}[]()\"\\#@&<>~^$") for c in text):
        if flag:
            raise ValueError("a literal with a sensitivity has no text form")
        return 'l"' + text.replace('"', '\\"') + '"'
    elif v.kind not in ("literal", "regex"):
        raise ValueError(f"a {v.kind} value has no text form")
    return "'" + flag + text.replace("'", "\\'") + "'"


def _times(low: int, high: int) -> str:
    named = {(0, n.MANY): "*", (1, n.MANY): "+", (0, 1): "?", (1, 1): ""}
    if (low, high) in named:
        return named[low, high]
    return f"{{{low}}}" if low == high else f"{{{low},}}" if high >= n.MANY else f"{{{low},{high}}}"


def _condition(e: n.Node) -> str:
    if isinstance(e, n.Is):
        return f"{e.annotation}={_quoted(e.value)}"
    if isinstance(e, n.Not):
        if isinstance(e.part, n.Is) and e.part.annotation:
            return f"{e.part.annotation}!={_quoted(e.part.value)}"
        return f"!({_condition(e.part)})"
    sign = " & " if isinstance(e, n.And) else " | "
    return sign.join(f"({_condition(p)})" if isinstance(p, (n.And, n.Or)) else _condition(p) for p in e.parts)  # type: ignore[attr-defined]


def _has_annotations(e: n.Node) -> bool:
    if isinstance(e, n.Is):
        return e.annotation is not None
    return isinstance(e, (n.And, n.Or, n.Not)) and all(_has_annotations(c) for c in e.children())


def _constraint(c: n.Constraint) -> str:
    if isinstance(c, n.CText):
        return "'" + c.text.replace("'", "\\'") + "'"
    if isinstance(c, n.CNumber):
        return str(c.number)
    if isinstance(c, n.CToken):
        return c.capture + (f".{c.annotation}" if c.annotation else "")
    if isinstance(c, n.CCall):
        return f"{c.name}({c.capture})"
    if isinstance(c, n.CNot):
        return f"!({_constraint(c.part)})"
    if isinstance(c, n.CCompare):
        return f"{_constraint(c.left)} {c.operator} {_constraint(c.right)}"
    if isinstance(c, n.CBool):
        return f"({_constraint(c.left)}) {c.operator} ({_constraint(c.right)})"
    raise ValueError(f"{c} has no text form")


def to_text(e: n.Node) -> str:
    """The pattern text. Nodes that only rewriting makes have none and raise."""
    if isinstance(e, n.Is):
        return _quoted(e.value) if e.annotation is None else f"[{_condition(e)}]"
    if isinstance(e, n.Any_):
        return "[]" + _times(e.low, e.high)
    if isinstance(e, n.Default):
        return "_"
    if _has_annotations(e):
        return f"[{_condition(e)}]"
    if isinstance(e, (n.And, n.Or)):
        return (" & " if isinstance(e, n.And) else " | ").join(_inner(p) for p in e.parts)
    if isinstance(e, n.Not):
        return "!" + _inner(e.part)
    if isinstance(e, n.Seq):
        return " ".join(_inner(p) for p in e.parts)
    if isinstance(e, n.Gap):
        return f"{_inner(e.left)} []{_times(e.low, e.high)} {_inner(e.right)}"
    if isinstance(e, n.Expand):
        free = f"[]{_times(e.low, e.high)}"
        return f"{free} {_inner(e.part)}" if e.direction == "left" else f"{_inner(e.part)} {free}"
    if isinstance(e, n.Repeat):
        return _inner(e.part) + _times(e.low, e.high)
    if isinstance(e, n.Capture):
        return f"{e.name}:{_inner(e.part)}"
    if isinstance(e, n.Tag):
        attributes = "".join(f" {k}={_quoted(v)}" for k, v in e.attributes)
        text = {"full": f"<{e.name}{attributes}/>", "start": f"<{e.name}{attributes}>", "end": f"</{e.name}{attributes}>"}[e.edge]
        return f"{e.label}:{text}" if e.label else text
    if isinstance(e, n.Filter) and e.operation in ("within", "containing") and not (e.invert or e.left or e.right):
        return f"{_inner(e.part)} {e.operation} {_inner(e.by)}"
    if isinstance(e, n.Overlap):
        return f"{_inner(e.left)} overlap {_inner(e.right)}"
    if isinstance(e, n.Constrained):
        return f"{_inner(e.part)} :: {_constraint(e.constraint)}"
    if isinstance(e, n.Call):
        return f"{e.name}({', '.join(to_text(a) for a in e.arguments)})"
    if isinstance(e, n.Settings):
        return "@" + ",".join(f"{k}={v}" for k, v in e.values) + " " + to_text(e.part)
    if isinstance(e, n.Relations):
        children = " ; ".join((f"{c.label}:" if c.label else "") + _operator(c.relation) + " " + _inner(c.target) for c in e.children_)
        return children if e.parent is None else f"{_inner(e.parent)} {children}"
    raise ValueError(f"{type(e).__name__} has no text form")


def _operator(r: n.RelationType) -> str:
    kind = "" if r.type == ".*" else r.type
    if r.alignment:
        return f"={kind}=>{r.version or ''}{'?' if r.optional else ''}"
    return ("!" if r.negated else "^" if r.root else "") + f"-{kind}->{r.version or ''}"


def _inner(e: n.Node) -> str:
    text = to_text(e)
    return text if isinstance(e, (n.Is, n.Any_, n.Default, n.Tag, n.Call)) or _has_annotations(e) else f"({text})"
