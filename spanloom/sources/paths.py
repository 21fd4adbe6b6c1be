"""A path language over XML elements: what format descriptors use of XPath. Namespaces are ignored; names are local names.

Steps by the axes child, descendant, parent, ancestor, self, the siblings and attribute; predicates with positions, comparisons, `and`, `or`
and functions; unions; and a path that is a function call (`concat`, `string-join`, `count`, `normalize-space` and others) gives its value.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from xml.parsers import expat


def local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


class Tree:
    """Elements with their parents, and where each begins and ends in the text. Events give the text between elements in order."""

    def __init__(self, root: ET.Element, text: str = "", places: dict | None = None):
        self.root = root
        self.text = text
        self.places = places or {}
        self.parent = {c: p for p in root.iter() for c in p}

    def place(self, e: ET.Element) -> tuple[int | None, int | None]:
        return self.places.get(e, (None, None))

    def find(self, at: ET.Element, path: str) -> list:
        """Elements, or texts for paths that end in @x, text(), name() or are `.` with values wanted; duplicates removed, in order."""
        out, seen = [], set()
        for part in _split(path, "|"):
            for x in self._one(at, part.strip()):
                key = id(x) if isinstance(x, ET.Element) else None
                if key is None or key not in seen:
                    seen.add(key)
                    out.append(x)
        return out

    def _one(self, at: ET.Element, path: str) -> list:
        if path in ("", "."):
            return [at]
        if m := _CALL.fullmatch(path):
            if m.group(1) in FUNCTIONS:
                value = self.evaluate(at, path)
                return value if isinstance(value, list) else [_written(value)]
        current: list = [at]
        if path.startswith("//"):
            steps, current = _steps(path), [_Above(self.root)]
        elif path.startswith("/"):
            steps = _steps(path[1:])
            current = [_Above(self.root)]
        else:
            steps = _steps(path)
        for step in steps:
            new: list = []
            for x in current:
                new += self._step(x, step)
            current = new
        return current

    def _step(self, x, step: str) -> list:
        deep = step.startswith("//")
        step = step[2:] if deep else step
        name, conditions = _parts(step)
        if isinstance(x, str):
            return []
        if name == "..":
            name = "parent::node()"
        if name.startswith("@"):
            want = name[1:].rpartition(":")[2]
            return [v for e in (x.iter() if deep else [x]) for k, v in e.attrib.items() if want == "*" or local(k) == want]
        if name == "text()":
            return [t for e in (x.iter() if deep else [x]) for t in [e.text, *(c.tail for c in e)] if t]
        if name in ("name()", "local-name()"):
            return [local(x.tag)]
        axis, _, test = name.rpartition("::")
        if name == "." or name.startswith(".["):
            axis, test = "self", "node()"
        pool = self._along(x, axis, deep)
        want = test.rpartition(":")[2]
        out = [e for e in pool if isinstance(e.tag, str) and (want in ("*", "node()") or local(e.tag) == want)]
        for c in conditions:
            out = [e for i, e in enumerate(out, 1) if self.test(e, c, i, len(out))]
        return out

    def _along(self, x, axis: str, deep: bool) -> list:
        """The elements of an axis, nearest first where it goes backwards."""
        if isinstance(x, _Above):
            return list(x.element.iter()) if deep or axis.startswith("descendant") else [x.element]
        if axis in ("", "child"):
            return [e for e in x.iter() if e is not x] if deep else list(x)
        if axis in ("descendant", "descendant-or-self"):
            return [e for e in x.iter() if e is not x or axis.endswith("self")]
        if axis == "self":
            return [x, *(e for e in x.iter() if e is not x)] if deep else [x]
        above = []
        up = self.parent.get(x)
        while up is not None:
            above.append(up)
            up = self.parent.get(up)
        if axis == "parent":
            return above[:1]
        if axis in ("ancestor", "ancestor-or-self"):
            return [x, *above] if axis.endswith("self") else above
        if axis in ("following-sibling", "preceding-sibling"):
            around = list(above[0]) if above else [x]
            at = next(i for i, e in enumerate(around) if e is x)
            return around[at + 1 :] if axis.startswith("following") else around[:at][::-1]
        raise ValueError(f"unknown axis {axis}")

    def test(self, e: ET.Element, condition: str, at: int = 1, last: int = 1) -> bool:
        c = condition.strip()
        parts = _split(c, " or ")
        if len(parts) > 1:
            return any(self.test(e, p, at, last) for p in parts)
        parts = _split(c, " and ")
        if len(parts) > 1:
            return all(self.test(e, p, at, last) for p in parts)
        for sign, compare in COMPARISONS:
            sides = _split(c, sign)
            if len(sides) == 2:
                left, right = (self.evaluate(e, x.strip(), at, last) for x in sides)
                return any(compare(*_alike(x, y)) for x in _several(left) for y in _several(right))
        value = self.evaluate(e, c, at, last)
        return value == at if isinstance(value, float) else bool(value)

    def evaluate(self, e: ET.Element, expression: str, at: int = 1, last: int = 1):
        """A string, number or truth value, or a list of elements and texts."""
        x = expression.strip()
        if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"":
            return x[1:-1]
        if re.fullmatch(r"\d+(\.\d+)?", x):
            return float(x)
        if (m := _CALL.fullmatch(x)) and m.group(1) in FUNCTIONS:
            name, inside = m.groups()
            if name in ("position", "last"):
                return float(at if name == "position" else last)
            if name == "not":
                return not self.test(e, inside, at, last)
            given = [self.evaluate(e, a, at, last) for a in _split(inside, ",")] if inside.strip() else [[e]]
            return FUNCTIONS[name](*given)
        return self.find(e, x)

    def values(self, at: ET.Element, path: str) -> list[str]:
        if path[:1] == "@" and path[1:].isidentifier():  # the most frequent kind of path
            v = at.attrib.get(path[1:])
            if v is not None:
                return [v]
        return [text_of(v) for v in self.find(at, path)]

    def value(self, at: ET.Element, path: str) -> str | None:
        if len(path) > 1 and path[0] == path[-1] and path[0] in "'\"":
            return path[1:-1]
        if path[:1] == "@" and (v := at.attrib.get(path[1:])) is not None:
            return v
        for part in _split(path, "|"):  # the first alternative that is there
            found = self.values(at, part.strip())
            if found:
                return found[0]
        return None


_CALL = re.compile(r"([a-z-]+)\((.*)\)", re.DOTALL)
COMPARISONS = ((" != ", lambda x, y: x != y), ("!=", lambda x, y: x != y), ("<=", lambda x, y: x <= y), (">=", lambda x, y: x >= y), ("=", lambda x, y: x == y), ("<", lambda x, y: x < y), (">", lambda x, y: x > y))


def _several(value) -> list:
    return [text_of(v) for v in value] if isinstance(value, list) else [value]


def _alike(x, y) -> tuple:
    """Two values to compare: as numbers if one is a number, else as texts."""
    if isinstance(x, float) or isinstance(y, float):
        return tuple(_number(v) for v in (x, y))
    return _written(x), _written(y)


def _number(value) -> float:
    try:
        return float(_string(value))
    except ValueError:
        return float("nan")


def _written(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return f"{value:g}" if isinstance(value, float) else value


def _string(value="") -> str:
    if isinstance(value, list):
        return text_of(value[0]) if value else ""
    return _written(value)


#: The functions of paths; a list stands for a set of nodes.
FUNCTIONS = {
    "position": None, "last": None, "not": None,
    "string": _string, "normalize-space": lambda v: " ".join(_string(v).split()), "string-length": lambda v: float(len(_string(v))), "count": lambda v: float(len(_several(v))), "number": _number,
    "concat": lambda *v: "".join(map(_string, v)), "string-join": lambda v, sep="": _string(sep).join(_several(v)), "contains": lambda a, b: _string(b) in _string(a), "starts-with": lambda a, b: _string(a).startswith(_string(b)),
    "ends-with": lambda a, b: _string(a).endswith(_string(b)), "substring-before": lambda a, b: _string(a).partition(_string(b))[0] if _string(b) in _string(a) else "", "substring-after": lambda a, b: _string(a).partition(_string(b))[2],
    "substring": lambda v, a, n=None: _string(v)[max(int(a) - 1, 0) :][: None if n is None else int(n)], "lower-case": lambda v: _string(v).lower(), "upper-case": lambda v: _string(v).upper(), "replace": lambda v, a, b: re.sub(_string(a), re.sub(r"\$(\d)", r"\\\1", _string(b)), _string(v)),
    "matches": lambda v, a: bool(re.search(_string(a), _string(v))), "tokenize": lambda v, a: [x for x in re.split(_string(a), _string(v)) if x], "distinct-values": lambda v: list(dict.fromkeys(_several(v))), "true": lambda *_: True, "false": lambda *_: False,
}


class _Above:
    """Stands over the root, so that absolute paths can find it."""

    def __init__(self, element: ET.Element):
        self.element = element


def text_of(x) -> str:
    return x if isinstance(x, str) else re.sub(r"\s+", " ", "".join(x.itertext())).strip()


@lru_cache(maxsize=4096)
def _split(text: str, sign: str) -> list[str]:
    """Splits outside brackets and quotes. The list is shared and must not be changed."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    while i < len(text):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif depth == 0 and text.startswith(sign, i):
            out.append(text[last:i])
            i += len(sign)
            last = i
            continue
        elif ch in "[(":
            depth += 1
        elif ch in "])":
            depth -= 1
        i += 1
    return [*out, text[last:]]


@lru_cache(maxsize=4096)
def _parts(step: str) -> tuple[str, list[str]]:
    """A step's name and its predicates."""
    m = re.match(r"([^\[]*)((?:\[.*\])*)$", step, re.DOTALL)
    conditions = [c for c in _split(m.group(2)[1:-1], "][") if c] if m.group(2) else []
    return m.group(1).strip().replace("attribute::", "@"), conditions


@lru_cache(maxsize=4096)
def _steps(path: str) -> list[str]:
    out: list[str] = []
    deep = False
    for part in _split(path, "/"):
        if part == "":
            deep = True
            continue
        out.append(("//" if deep else "") + part.strip())
        deep = False
    return [s for s in out if s != "."] or ["."]


def events(e: ET.Element) -> Iterator[tuple[str, object]]:
    """start, text and end events of a subtree in document order."""
    yield "start", e
    if e.text:
        yield "text", e.text
    for c in e:
        yield from events(c)
        if c.tail:
            yield "text", c.tail
    yield "end", e


#: A start tag in bytes; quotes may hold a `>`.
_TAG = re.compile(rb"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")


def parse(text: str) -> Tree:
    """Elements of the text with the places where each begins and ends, in characters."""
    data = text.encode()
    build = ET.TreeBuilder()
    places: dict = {}
    stack: list[tuple[ET.Element, int]] = []
    reader = expat.ParserCreate(namespace_separator="}")
    reader.buffer_text = True

    def start(name: str, attributes: dict) -> None:
        stack.append((build.start(name, attributes), reader.CurrentByteIndex))

    def end(name: str) -> None:
        e, begin = stack.pop()
        build.end(name)
        opened = _TAG.match(data, begin).end()
        # an element without an end tag of its own ends with its start tag
        places[e] = (begin, opened if data[opened - 2 : opened] == b"/>" else data.find(b">", reader.CurrentByteIndex) + 1)

    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, end, build.data
    try:
        reader.Parse(data, True)
    except expat.ExpatError as e:
        raise ET.ParseError(str(e)) from None
    root = build.close()
    if len(data) != len(text):
        chars = list(accumulate((int(b & 0xC0 != 0x80) for b in data), initial=0))
        places = {e: (chars[a], chars[z]) for e, (a, z) in places.items()}
    return Tree(root, text, places)


class Places:
    """Feeds a reader in pieces and says, while it calls, where in the text a tag begins and ends, in characters. Of the text it keeps what
    the reader hasn't come to yet."""

    def __init__(self) -> None:
        self.reader = expat.ParserCreate(namespace_separator="}")
        self.reader.buffer_text = True
        self.data, self.base, self.chars = b"", 0, 0
        self.ascii, self.counts = True, None
        self.at = 0
        #: The byte up to which the original has been taken, None outside of documents.
        self.taken: int | None = 0

    def feed(self, piece: str, last: bool = False) -> None:
        keep = (self.at if self.taken is None else min(self.at, self.taken)) - self.base
        self.chars += self._count(keep)
        more = piece.encode()
        self.data, self.base = self.data[keep:] + more, self.base + keep
        self.ascii, self.counts = self.data.isascii(), None
        try:
            self.reader.Parse(more, last)
        except expat.ExpatError as e:
            raise ET.ParseError(str(e)) from None

    def _count(self, n: int) -> int:
        """Characters of the first n bytes that are kept."""
        if self.ascii:
            return n
        if self.counts is None:
            import numpy as np

            self.counts = np.concatenate([[0], np.cumsum((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)])
        return int(self.counts[n])

    def seen(self) -> None:
        self.at = max(self.at, self.reader.CurrentByteIndex)

    def start_tag(self) -> tuple[int, tuple[int, int] | None]:
        """Where the start tag begins and, if its element has no end tag, where that ends, in characters and in bytes."""
        self.seen()
        begin = self.reader.CurrentByteIndex - self.base
        end = self.data.find(b">", begin) + 1
        if self.data.count(b'"', begin, end) % 2 or self.data.find(b"'", begin, end) >= 0:  # it may stand in a value
            end = _TAG.match(self.data, begin).end()
        return self.chars + self._count(begin), (self.chars + self._count(end), self.base + end) if self.data[end - 2 : end] == b"/>" else None

    def end_tag(self) -> tuple[int, int]:
        """Where an element ends that has an end tag, in characters and in bytes."""
        end = self.data.find(b">", self.reader.CurrentByteIndex - self.base) + 1
        return self.chars + self._count(end), self.base + end

    def begin(self, whole: bool) -> int:
        """Begins a document with the start tag at hand or, if `whole`, with the text."""
        self.seen()
        if whole:
            return 0
        self.taken = self.reader.CurrentByteIndex
        return self.chars + self._count(self.taken - self.base)

    def take(self, d, end: int | None) -> None:
        """Gives a document its original up to a byte, -1 for all, None for what the reader has come to; a byte given ends the document."""
        stop = self.at if end is None else self.base + len(self.data) if end == -1 else end
        d.original(self.data[self.taken - self.base : stop - self.base].decode())
        self.taken = stop if end is None else None
