"""Parsers of single files: text to documents with tokens, spans, relations and metadata. They run inside tasks, a file at a time.

Files come as pieces of text and documents leave in parts, so that a task doesn't hold a large one as a whole, where the format allows that.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from spanloom.sources import paths, transcripts
from spanloom.sources.held import Ids, Spool
from spanloom.sources.descriptor import Format, FormatError


@dataclass
class Document:
    """What one document gives in one annotated field. tokens: (values by annotation, punct, char_start, char_end in `raw`); spans: (tag, start, end,
    attributes); relations: (class, type, source start, source end or None for roots, target start, end, attributes) and, where the target
    lies in another field, that field's name. Fields of one document follow each other; the first one has the metadata and the original."""

    metadata: dict[str, list[str]] = field(default_factory=dict)
    tokens: list[tuple[dict[str, list[str]], str, int | None, int | None]] = field(default_factory=list)
    spans: list[tuple[str, int, int, dict[str, str]]] = field(default_factory=list)
    relations: list[tuple] = field(default_factory=list)
    raw: str = ""
    field: str = "contents"
    #: Whether it is another field of the document before it.
    further: bool = False
    #: Of a part: its number, the position of its first token, the number of its first relation, that of its block of the original, and whether it is
    #: the document's last one, which has the metadata. A part without a block has no `raw`.
    part: int = 0
    first: int = 0
    related: int = 0
    block: int = 0
    last: bool = True

    def word(self, values: dict[str, list[str]], punct: str = " ", start: int | None = None, end: int | None = None) -> int:
        self.tokens.append((values, punct, start, end))
        return len(self.tokens) - 1


#: Tokens, spans or relations of a part, about.
PART = 4096
#: Characters of the original in a block.
BLOCK = 1 << 16
#: Characters that are read at a time.
PIECE = 1 << 18


class Parts:
    """A document that is taken in parts while it grows."""

    def __init__(self) -> None:
        self.metadata: dict[str, list[str]] = {}
        self.tokens: list[tuple] = []
        self.spans: list[tuple] = []
        self.relations: list[tuple] = []
        self.length = self._related = self._part = self._block = self._chars = 0
        self._text: list[str] = []

    def word(self, values: dict[str, list[str]], punct: str, start: int | None, end: int | None) -> int:
        self.tokens.append((values, punct, start, end))
        self.length += 1
        return self.length - 1

    def original(self, text: str) -> None:
        self._text.append(text)
        self._chars += len(text)

    def full(self) -> bool:
        return self._chars >= BLOCK or len(self.tokens) >= PART or len(self.spans) >= PART or len(self.relations) >= PART

    def part(self, last: bool = False) -> Document:
        raw = None
        if self._chars >= BLOCK or last and (self._chars or not self._block):
            text = "".join(self._text)
            raw, self._text, self._chars = text[:BLOCK], [text[BLOCK:]], max(0, self._chars - BLOCK)
        d = Document(self.metadata if last else {}, self.tokens, self.spans, self.relations, raw, part=self._part, first=self.length - len(self.tokens), related=self._related, block=self._block, last=last)
        self._related += len(self.relations)
        self._part += 1
        self._block += raw is not None
        self.tokens, self.spans, self.relations = [], [], []
        return d

    def close(self) -> Iterator[Document]:
        while self._chars > BLOCK:
            yield self.part()
        yield self.part(True)


def cut(d: Document) -> Iterator[Document]:
    """A whole document in parts."""
    n = max(1, -(-max(len(d.tokens), len(d.spans), len(d.relations)) // PART), -(-len(d.raw) // BLOCK))
    for i in range(n):
        of = lambda xs, size=PART: xs[i * size : (i + 1) * size]  # noqa: B023, E731
        raw = of(d.raw, BLOCK)
        yield Document(d.metadata if i == n - 1 else {}, of(d.tokens), of(d.spans), of(d.relations), raw if raw or not i else None, d.field, d.further, i, i * PART, i * PART, i, i == n - 1)


def joined(parts_: Iterable[Document]) -> Iterator[Document]:
    """Whole documents from their parts."""
    d, texts = None, []
    for p in parts_:
        if not p.part:
            d, texts = Document(field=p.field, further=p.further), []
        d.tokens += p.tokens
        d.spans += p.spans
        d.relations += p.relations
        texts.append(p.raw or "")
        if p.last:
            d.metadata, d.raw = p.metadata, "".join(texts)
            yield d


PARSERS: dict[str, Callable[[str, Format], Iterator[Document]]] = {}
#: Those that read pieces and give parts.
STREAMED: dict[str, Callable[[Iterable[str], Format], Iterator[Document]]] = {}


def parser(name: str):
    def keep(f):
        PARSERS[name] = f
        return f

    return keep


def streamed(name: str):
    def keep(f):
        STREAMED[name] = f
        return f

    return keep


def parse(text: str, form: Format) -> list[Document]:
    try:
        return list(joined(parts([text], form)))
    except Nested:
        return list(joined(parts([text], form, whole=True)))


class Nested(FormatError):
    """Elements of a kind within others of the kind, which need the whole tree."""


def parts(pieces: Iterable[str], form: Format, whole: bool = False) -> Iterator[Document]:
    """The documents of a file in parts, from a file that is read in pieces if its format allows that and unless `whole`. After Nested, what came before doesn't count."""
    plan = _streamable(form) if form.file_type == "xml" and not whole else None
    if plan:
        yield from _Stream(form, plan).run(_small(pieces))
    elif form.file_type in STREAMED:
        yield from STREAMED[form.file_type](_small(pieces), form)
    elif form.file_type in PARSERS:
        for d in PARSERS[form.file_type]("".join(pieces), form):
            yield from cut(d)
    else:
        raise FormatError(f"unknown file type {form.file_type}")


def _small(pieces: Iterable[str]) -> Iterator[str]:
    """Pieces of a size that is good to read: small ones are put together, large ones cut."""
    held, size = [], 0
    for p in pieces:
        if len(p) > PIECE:
            yield "".join(held)
            held, size = [], 0
            for i in range(0, len(p), PIECE):
                yield p[i : i + PIECE]
            continue
        held.append(p)
        size += len(p)
        if size >= PIECE:
            yield "".join(held)
            held, size = [], 0
    yield "".join(held)


def _lines(text: str) -> list[str]:
    """Lines with their ends, which are those of files: other signs that separate lines belong to the values."""
    return list(io.StringIO(text, newline=""))


@parser("text")
def plain(text: str, form: Format) -> Iterator[Document]:
    d, last = Document(raw=text), 0
    name = form.annotations[0].name
    for m in re.finditer(r"[^\W_]+(?:['’-][^\W_]+)*", text):
        d.word({name: [m.group()]}, text[last : m.start()], m.start(), m.end())
        last = m.end()
    yield d


_TAG = re.compile(r"<(/?)([\w.:-]+)((?:\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>\s*$")


def _attributes(text: str) -> dict[str, str]:
    return {k: a if a is not None and a != "" else b for k, a, b in re.findall(r"([\w.:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", text)}


@parser("tabular")
def tabular(text: str, form: Format) -> Iterator[Document]:
    """One token a row; by option with a header, tags on their own lines, glue tags `<g/>`, several values per cell, and documents in tags."""
    tags, glue_tags = form.option("inline_tags", form.option("inlineTags", False)), form.option("glue_tags", form.option("glueTags", False))
    separator = form.option("separator") or form.option("delimiter") or ("," if form.option("type") == "csv" else "\t")
    quote = form.option("quote", '"')
    header = form.option("header", form.option("columnNames", False))
    several = form.option("multiple_separator", form.option("multipleValuesSeparator", ";"))
    doc_tag = form.option("document_tag", form.option("documentTag"))
    d, columns, stack, glue, any_row, begin = Document(raw=text), None, [], False, False, 0
    for row, first, behind in _rows(text, separator, quote, bool(tags)):
        if not row or row == [""]:
            continue
        m = _TAG.match(row[0].strip()) if tags and len(row) == 1 else None
        if m:
            closing, name, attributes, empty = m.groups()
            if glue_tags and name == "g" and empty:
                glue = True
            elif name == doc_tag:
                if closing:
                    d.raw = text[begin:behind]
                    yield d
                    d, any_row = Document(), False
                else:
                    d, begin = Document(metadata={k: [v] for k, v in _attributes(attributes).items()}), first
            elif empty:
                d.spans.append((name, len(d.tokens), len(d.tokens), _attributes(attributes)))
            elif closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        tag, start, attrs = stack.pop(i)
                        d.spans.append((tag, start, len(d.tokens), attrs))
                        break
            else:
                stack.append((name, len(d.tokens), _attributes(attributes)))
            continue
        if header and columns is None:
            columns = {c.strip(): i for i, c in enumerate(row)}
            continue
        values = {}
        for name, a in form.all_annotations():
            at = int(a.value) - 1 if a.value.isdigit() else (columns or {}).get(a.value, -1)
            if 0 <= at < len(row):
                values[name] = [v for v in re.split(several, row[at]) if v] if a.multiple else [row[at]]
        d.word(values, "" if glue or not d.tokens else " ", first - begin, behind - begin)
        glue, any_row = False, True
    if any_row or not doc_tag:
        d.raw = d.raw or text[begin:]
        yield d


def _rows(text: str, separator: str, quote: str, tagged: bool) -> Iterator[tuple[list[str], int, int]]:
    """Rows with the characters they take up, without the line's end. A quoted cell may hold line ends, but not beside lines with tags."""
    lines = _lines(text)
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    end = lambda i: at[i + 1] - (len(lines[i]) - len(lines[i].rstrip("\r\n")))
    if tagged:
        for i, line in enumerate(lines):
            if line.strip():
                yield [line.strip()] if _TAG.match(line.strip()) else next(csv.reader([line.rstrip("\r\n")], delimiter=separator, quotechar=quote)), at[i], end(i)
        return
    reader = csv.reader(lines, delimiter=separator, quotechar=quote)
    before = 0
    for row in reader:
        yield row, at[before], end(reader.line_num - 1)
        before = reader.line_num


def _lines_of(pieces: Iterable[str]) -> Iterator[str]:
    """Lines with their ends, of which a piece may hold a part."""
    held: list[str] = []
    for p in pieces:
        held.append(p)
        if "\n" not in p and "\r" not in p:
            continue
        lines = _lines("".join(held))
        held = [lines.pop()] if lines and not lines[-1].endswith("\n") else []
        yield from lines
    yield from _lines("".join(held))


@streamed("conll-u")
def conllu(pieces: Iterable[str], form: Format) -> Iterator[Document]:
    """A treebank: sentences become spans `s`, HEAD and DEPREL relations of class `dep`; a head of 0 is a root relation.

    Tokens leave as they come; of a sentence, only its ids and heads are kept until its end.
    """
    columns = [(n, int(a.value) - 1) for n, a in form.all_annotations() if a.value.isdigit()]
    d, comments, glued, place = Parts(), {}, False, 0
    first, any_row, at, heads = 0, False, Ids(), Spool()

    def flush() -> Iterator[Document]:
        nonlocal comments, any_row, at, heads
        if any_row:
            for own, head, kind in heads:
                if (target := at.get(own)) is None:
                    continue
                if head == "0":
                    d.relations.append(("dep", kind, None, None, target, target + 1, {}))
                elif (source := at.get(head)) is not None:
                    d.relations.append(("dep", kind, source, source + 1, target, target + 1, {}))
                if d.full():
                    yield d.part()
            d.spans.append(("s", first, d.length, {k: v for k, v in comments.items() if k in ("sent_id", "text")}))
            any_row, at, heads = False, Ids(), Spool()
        comments = {}

    for whole in _lines_of(pieces):
        line = whole.rstrip("\r\n")
        if not line.strip():
            yield from flush()
        elif line.startswith("#"):
            key, _, value = line[1:].partition("=")
            if key.strip() == "newdoc id" or key.strip() == "newdoc":
                yield from flush()
                if d.length:
                    yield from d.close()
                d, glued, place = Parts(), False, 0
                if value.strip():
                    d.metadata["pid"] = [value.strip()]
            else:
                comments[key.strip()] = value.strip()
        else:
            cells = line.split("\t")
            if not any_row:
                any_row, first = True, d.length
            if "-" not in cells[0] and "." not in cells[0]:
                values = {n: [cells[i]] for n, i in columns if i < len(cells) and cells[i] != "_"}
                at.put(cells[0], d.word(values, " " if d.length and not glued else "", place, place + len(line)))
                glued = len(cells) > 9 and "SpaceAfter=No" in cells[9].split("|")
                if len(cells) > 7 and cells[6] not in ("_", ""):
                    heads.append((cells[0], cells[6], cells[7]))
        d.original(whole)
        place += len(whole)
        while d.length and d.full():
            yield d.part()
    yield from flush()
    yield from d.close()


@parser("chat")
def chat(text: str, form: Format) -> Iterator[Document]:
    """A transcript, see `transcripts`: a span `u` for each utterance, with its number, its speaker and what the headers say at that point."""
    d, headers, place, number = Document(raw=text), transcripts.Headers(), 0, 0
    standing: list[int] = []
    for line in transcripts.lines_of(text):
        if line[0] == "@":
            headers.read(line)
        elif line[0] == "*":
            who, _, said = line[1:].partition(":")
            start, standing = len(d.tokens), []
            place = max(place, text.find("\n*" + who, place))
            for w, stands in transcripts.words_of(said):
                found = text.find(w, place)  # a replaced form is found where it is written
                at = d.word({"word": [w]}, " " if d.tokens else "", *((found, found + len(w)) if found >= 0 else (None, None)))
                place = found + len(w) if found >= 0 else place
                if stands:
                    standing.append(at)
            number += 1
            d.spans.append(("u", start, len(d.tokens), {"who": who, "uttid": str(number), **headers.in_force(who)}))
        elif line.startswith("%mor:"):
            items = transcripts.mor_items(line[5:])
            if len(items) == len(standing):  # else it can't be told which is which
                for at, (pos, lemma) in zip(standing, items):
                    d.tokens[at][0].update({"pos": [pos]} | ({"lemma": [lemma]} if lemma else {}))
    d.metadata = headers.every
    yield d


@parser("xml")
def xml(text: str, form: Format) -> Iterator[Document]:
    tree = paths.parse(text)
    documents = tree.find(tree.root, form.document) if form.document != "." else [tree.root]
    for root in documents:
        yield from xml_document(tree, root, form)


def xml_document(tree: paths.Tree, root, form: Format) -> Iterator[Document]:
    """A document for each annotated field; tokens of all are known before standoff annotations refer to them."""
    begin, stop = (0, len(tree.text)) if form.document == "." else tree.place(root)
    found = []
    for i, f in enumerate((form, *form.further)):
        d = Document(field=f.field, further=i > 0)
        found.append((f, d, _xml_tokens(tree, root, f, d, begin or 0)))
    everywhere = {d.field: ids for _, d, ids in found}
    for f, d, ids in found:
        _xml_standoff(tree, root, f, d, ids, everywhere)
    first = found[0][1]
    first.metadata, first.raw = xml_metadata(tree, root, form), tree.text[begin or 0 : stop]
    for _, d, _ in found:
        yield d


def _xml_tokens(tree: paths.Tree, root, form: Format, d: Document, begin: int) -> dict[str, int]:
    """Fills tokens and inline spans and gives the position of each token id and anchor."""
    containers = tree.find(root, form.container)
    ids: dict[str, int] = {}
    for c in containers:
        words = {id(w): w for w in tree.find(c, form.word)}
        punct = {id(p) for p in tree.find(c, form.punct)} if form.punct else set()
        tags = [(t, {id(e) for e in tree.find(c, t.path)}) for t in form.inline_tags]
        open_tags: dict[int, tuple] = {}
        pending, inside = [], 0
        marks: list[str] = []
        for kind, x in paths.events(c):
            if kind == "text":
                if not inside:
                    pending.append(x)
                continue
            if kind == "start":
                if id(x) in words:
                    e = words[id(x)]
                    before = re.sub(r"\s+", " ", "".join(pending))
                    first, behind = tree.place(e)
                    at = d.word(_values(tree, e, form), before if before.strip() or not d.tokens else before or " ", *((first - begin, behind - begin) if first is not None else (None, None)))
                    pending = []
                    inside += 1
                    for m in marks:
                        ids.setdefault(m, at)
                    marks = []
                    if form.token_id and (ref := tree.value(e, form.token_id)):
                        ids[ref] = at
                elif id(x) in punct:
                    pending.append(paths.text_of(x))
                    inside += 1
                for t, elements in tags:
                    if id(x) in elements:
                        attributes = {paths.local(k): v for k, v in x.attrib.items() if (not t.include or paths.local(k) in t.include) and paths.local(k) not in t.exclude}
                        attributes |= {k: v for k, path in t.extra if (v := tree.value(x, path)) is not None}
                        open_tags[id(x)] = (t.name or paths.local(x.tag), len(d.tokens) - (1 if id(x) in words else 0), attributes)
                        if t.token_id and (ref := tree.value(x, t.token_id)):
                            marks.append(ref)
                if paths.local(x.tag) == "anchor":
                    marks += [v for k, v in x.attrib.items() if paths.local(k) in ("synch", "id")]
            else:
                if id(x) in words or id(x) in punct:
                    inside -= 1
                if id(x) in open_tags:
                    tag, start, attributes = open_tags.pop(id(x))
                    d.spans.append((tag, start, len(d.tokens), attributes))
        for m in marks:  # an anchor after the last token stands for the end
            ids.setdefault(m, len(d.tokens))
    return ids


def _values(tree: paths.Tree, e, form: Format) -> dict[str, list[str]]:
    """The values of a word's annotations; an annotation for each element of a path has its name from there."""
    values: dict[str, list[str]] = {}
    for name, a in form.all_annotations():
        if a.for_each:
            for x in tree.find(e, a.for_each):
                own, value = tree.value(x, a.name_path), tree.value(x, a.value)
                if own and value is not None:
                    values.setdefault(own, []).append(dict(a.map).get(value, value))
            continue
        found = tree.values(e, a.value) if a.multiple else [v for v in [tree.value(e, a.value)] if v is not None]
        if found:
            values[name] = [dict(a.map).get(v, v) for v in found]
    return values


def _xml_standoff(tree: paths.Tree, root, form: Format, d: Document, ids: dict[str, int], everywhere: dict[str, dict[str, int]]) -> None:
    ref = lambda s: ids.get((s or "").lstrip("#"))
    for s in form.standoff:
        for e in tree.find(root, s.path):
            if s.kind == "token":
                refs = " ".join(tree.values(e, s.token)).split()
                for at in filter(lambda i: i is not None, map(ref, refs)):
                    for a in s.annotations:
                        v = tree.value(e, a.value)
                        if v is not None and at < len(d.tokens):
                            d.tokens[at][0].setdefault(a.name, []).append(dict(a.map).get(v, v))
            elif s.kind == "span":
                first, last = tree.value(e, s.start), tree.value(e, s.end)
                start, end = ref(first), ref(last)
                if start is None or end is None:
                    continue
                # an anchor is the token behind it, so an end given by an anchor is exclusive already
                anchored = not (form.token_id and (last or "").lstrip("#") in _token_ids(tree, root, form))
                stop = end if anchored or not s.end_inclusive else end + 1
                attributes = {a.name: v for a in s.annotations if (v := tree.value(e, a.value)) is not None}
                d.spans.append((tree.value(e, s.name) or "span" if s.name else "span", start, stop, attributes))
            else:
                target, other = ref(wanted := tree.value(e, s.target)), d.field
                if target is None:  # a token of another version of the text
                    key = (wanted or "").lstrip("#")
                    other, target = next(((name, known[key]) for name, known in everywhere.items() if key in known), (d.field, None))
                source = ref(tree.value(e, s.source)) if s.source else None
                if target is None or s.source and source is None:
                    continue
                attributes = {a.name: v for a in s.annotations if (v := tree.value(e, a.value)) is not None}
                kind = tree.value(e, s.name) or "rel" if s.name else "rel"
                d.relations.append((s.relation_class, kind, source, None if source is None else source + 1, target, target + 1, attributes, *([other] if other != d.field else [])))


def _token_ids(tree: paths.Tree, root, form: Format) -> set[str]:
    cache = tree.__dict__.setdefault("_ids", {})
    if id(root) not in cache:
        cache[id(root)] = {v for c in tree.find(root, form.container) for w in tree.find(c, form.word) for v in tree.values(w, form.token_id)}
    return cache[id(root)]


_NAME = r"[A-Za-z_][\w-]*"
_CHILD = re.compile(rf"(\.//)?({_NAME}(?:/{_NAME})*)")
_WITHIN = re.compile(rf"\.|'[^']*'|(?:{_NAME}/)*(?:@?{_NAME}|text\(\))")
_OF = re.compile(rf"((?:{_NAME}/)*)@{_NAME}|({_NAME}(?:/{_NAME})*)")


def _steps(path: str) -> tuple[bool, list[str]] | None:
    """Whether a path leads to any depth, and its names; None for a path with more than names."""
    return (bool(m.group(1)), m.group(2).split("/")) if (m := _CHILD.fullmatch(path)) else None


def _within(*given: str) -> bool:
    """Whether paths stay within the element that they are seen from."""
    return all(_WITHIN.fullmatch(p.strip()) for path in given if path for p in path.split("|"))


def _streamable(form: Format) -> tuple | None:
    """How elements are known while XML is read, or None where a path of the descriptor may look at what isn't kept: words and
    standoff elements are let go as they end, and metadata lie in neither and not beside words."""
    if form.further or form.inline_tags or form.punct or not re.fullmatch(rf"(@{_NAME})?", form.token_id):
        return None
    document = None if form.document == "." else _steps("." + form.document) if form.document.startswith("//") else None
    container = (False, []) if form.container == "." else _steps(form.container)
    word, marks = _steps(form.word), [_steps(s.path) for s in form.standoff]
    if form.document != "." and document is None or container is None or word is None or None in marks:
        return None
    if not _within(*(x for _, a in form.all_annotations() for x in (a.value, a.for_each, a.name_path))) or not all(a.value for _, a in form.all_annotations()):
        return None
    for s in form.standoff:
        if s.kind == "token" or not _within(s.start, s.end, s.name, s.source, s.target, *(a.value for a in s.annotations)):
            return None
    for m in form.metadata:
        path, inner = (m.for_each, (m.value, m.name_path)) if m.for_each else (m.value, ())
        if not (found := _OF.fullmatch(path)) or not _within(*inner):
            return None
        names = [x for x in (found.group(2) or found.group(1) or "").split("/") if x]
        text = bool(found.group(2)) and not (inner and all(x.startswith("@") for x in inner))
        for deep, other in (container, *marks):
            if names and (deep or names[: len(other)] == other and (names != other or text) or text and other[: len(names)] == names):
                return None
            if names and other in [x[1] for x in marks] and names == other:
                return None
    return document, container, word, marks


class _Stream:
    """XML documents read in pieces. What isn't word, standoff or within a container stays as a tree for the metadata, until its document ends."""

    def __init__(self, form: Format, plan: tuple):
        self.form = form
        self.document, self.container, self.word, self.marks = plan
        #: Last names of the paths; elements of other names are looked at no further.
        self.tags = {"anchor", *(x[1][-1] for x in (self.document, self.container, *self.marks) if x and x[1])}
        annotations = form.all_annotations()
        plain = all(a.value[0] == "@" and a.value[1:].isidentifier() and not (a.multiple or a.map or a.for_each) for _, a in annotations)
        #: The attributes that words have their values in, if they are nowhere else.
        self.direct = [(name, a.value[1:]) for name, a in annotations] if plain else None
        self.tree = paths.Tree(paths.ET.Element("none"))  # paths that stay within an element need nothing of it
        self.ready: list = []
        self.places = paths.Places()
        self.places.taken = 0 if self.document is None else None
        self.names: list[str] = []
        self.elements: list = []
        #: Of each open element, whether standoff elements lie in it; its text is no metadata then.
        self.noted: list[bool] = []
        self.d: Parts | None = None
        self.root = self.item = None
        self.root_at = self.box_at = self.item_at = 0
        self.kinds: list[int] = []

    @staticmethod
    def _is(found: tuple[bool, list[str]], names: list[str], above: int) -> bool:
        deep, want = found
        n = len(names) - above
        return n >= len(want) and names[-1] == want[-1] and (deep or n == len(want)) and names[len(names) - len(want) :] == want

    def start(self, name: str, attributes: dict) -> None:
        names, depth = self.names, len(self.names) + 1
        tag = paths.local(name) if "}" in name else name
        names.append(tag)
        e = paths.ET.Element(name, attributes)
        kept, box = False, self.box_at
        if self.root is None:
            if self.document is None or self._is(self.document, names, 0):
                self._open(e, depth)
                if not self.container[1]:
                    self.box_at = depth
                    self.pending, self.waiting = [], []
        elif tag not in self.tags:
            if box and tag == self.word[1][-1] and self._is(self.word, names, box):
                if self.item is not None:
                    raise Nested("elements within others of their kind can't be read in pieces")
                self._word(e, depth)
            elif self.item is not None or not box:
                self.elements[-1].append(e)
        elif self.document and self._is(self.document, names, 0):
            raise Nested("elements within others of their kind can't be read in pieces")
        else:
            kinds = [k for k, m in enumerate(self.marks) if m[1][-1] == tag and self._is(m, names, self.root_at)]
            is_word = box and self._is(self.word, names, box)
            if (kinds or is_word) and self.item is not None or kinds and is_word:
                raise Nested("elements within others of their kind can't be read in pieces")
            if self.container[1] and self._is(self.container, names, self.root_at):
                if box or kinds or self.item is not None:
                    raise Nested("elements within others of their kind can't be read in pieces")
                self.box_at, self.pending, self.waiting, kept = depth, [], [], True
            elif is_word:
                self._word(e, depth)
            elif kinds:
                self.item, self.item_at, self.kinds = e, depth, kinds
                self.noted[-1] = True
            else:
                kept = self.item is not None or not box
            if self.box_at and tag == "anchor" and depth > self.box_at:
                self.waiting += [v for k, v in attributes.items() if paths.local(k) in ("synch", "id")]
            if kept:
                self.elements[-1].append(e)
        self.elements.append(e)
        self.noted.append(False)

    def _word(self, e, depth: int) -> None:
        """A word begins: its position and what stands before it are known."""
        self.item, self.item_at, self.kinds = e, depth, []
        self.first, self.behind = self.places.start_tag()
        before = "".join(self.pending)
        self.before = " " if before == "\n" else re.sub(r"\s+", " ", before)
        if not self.before and self.d.length:
            self.before = " "
        for m in self.waiting:
            self.anchors.setdefault(m, self.d.length)
        self.pending, self.waiting = [], []

    def text(self, x: str) -> None:
        self.places.seen()
        if self.root is None:
            return
        in_word = self.item is not None and not self.kinds
        if self.box_at and not in_word:
            self.pending.append(x)
        if (self.item is not None or not self.box_at) and not self.noted[-1]:
            e = self.elements[-1]
            if len(e):
                e[-1].tail = (e[-1].tail or "") + x
            else:
                e.text = (e.text or "") + x

    def end(self, name: str) -> None:
        self.places.seen()
        e, depth = self.elements.pop(), len(self.names)
        self.names.pop()
        self.noted.pop()
        if self.item is not None and depth == self.item_at:
            if self.kinds:
                for k in self.kinds:
                    self._mark(k, e)
            else:
                self._token(e)
            self.item = None
        elif self.box_at == depth:
            for m in self.waiting:  # an anchor after the last token stands for the end
                self.anchors.setdefault(m, self.d.length)
            self.box_at = 0
        if self.root is not None and depth == self.root_at:
            if self.document is None:
                return
            self.places.take(self.d, (self.root_behind or self.places.end_tag())[1])
            self._close()

    def _open(self, e, depth: int) -> None:
        self.root, self.root_at, self.d = e, depth, Parts()
        self.ids, self.anchors, self.spools = Ids(), {}, [Spool() for _ in self.marks]
        self.root_behind = self.places.start_tag()[1]
        self.begin = self.places.begin(whole=self.document is None)

    def _close(self) -> None:
        self.d.metadata = xml_metadata(paths.Tree(self.root), self.root, self.form)
        self.ready.append(self._finished(self.d, self.ids, self.anchors, self.spools))
        self.root = self.d = None

    def _token(self, e) -> None:
        behind = (self.behind or self.places.end_tag())[0]
        values = {}
        for name, attribute in self.direct or ():
            if (v := e.get(attribute)) is None:
                break
            values[name] = [v]
        else:
            attribute = ""
        if self.direct is None or attribute:
            values = _values(self.tree, e, self.form)
        at = self.d.word(values, self.before, self.first - self.begin, behind - self.begin)
        if self.form.token_id and (ref := self.tree.value(e, self.form.token_id)):
            self.ids.put(ref, at)
        if self.d.full():
            self.ready.append(self.d.part())

    def _mark(self, k: int, e) -> None:
        s, value = self.form.standoff[k], self.tree.value
        attributes = {a.name: v for a in s.annotations if (v := value(e, a.value)) is not None}
        if s.kind == "span":
            self.spools[k].append((value(e, s.start), value(e, s.end), value(e, s.name) or "span" if s.name else "span", attributes))
        else:
            self.spools[k].append((value(e, s.source) if s.source else None, value(e, s.target), value(e, s.name) or "rel" if s.name else "rel", attributes))

    def _finished(self, d: Parts, ids: Ids, anchors: dict[str, int], spools: list[Spool]) -> Iterator[Document]:
        """The rest of a document: standoff annotations, when all tokens are known."""

        def ref(key: str | None) -> tuple[int | None, bool]:
            key = (key or "").lstrip("#")
            at = ids.get(key)
            return (anchors.get(key), True) if at is None else (at, False)

        for s, spool in zip(self.form.standoff, spools):
            for first, last, name, attributes in spool:
                (a, _), (z, anchored) = ref(first), ref(last)
                if s.kind == "span":
                    if a is not None and z is not None:
                        d.spans.append((name, a, z if anchored or not s.end_inclusive else z + 1, attributes))
                elif z is not None and not (s.source and a is None):
                    d.relations.append((s.relation_class, name, a, None if a is None else a + 1, z, z + 1, attributes))
                if d.full():
                    yield d.part()
        yield from d.close()

    def run(self, pieces: Iterable[str]) -> Iterator[Document]:
        reader = self.places.reader
        reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = self.start, self.end, self.text
        for piece in pieces:
            self.places.feed(piece)
            if self.d is not None:
                self.places.take(self.d, None)
            yield from self._taken()
        self.places.feed("", True)
        if self.document is None and self.d is not None:
            self.places.take(self.d, -1)
            self._close()
        yield from self._taken()

    def _taken(self) -> Iterator[Document]:
        ready, self.ready = self.ready, []
        for x in ready:
            if isinstance(x, Document):
                yield x
            else:
                yield from x
        while self.d is not None and self.d.full():
            yield self.d.part()


def xml_metadata(tree: paths.Tree, root, form: Format) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for m in form.metadata:
        if m.for_each:
            for e in tree.find(root, m.for_each):
                name, values = tree.value(e, m.name_path), tree.values(e, m.value)
                if name:
                    out.setdefault(name, []).extend(v for v in values if v)
        else:
            values = [v for v in tree.values(root, m.value) if v]
            if values:
                out.setdefault(m.name, []).extend(values)
        if not m.for_each and m.unknown_condition in ("missing", "missing_or_empty") and not out.get(m.name):
            out[m.name] = [m.unknown_value]
    return out


@parser("metadata")
def metadata_only(text: str, form: Format) -> Iterator[Document]:
    tree = paths.parse(text)
    for root in tree.find(tree.root, form.document) if form.document != "." else [tree.root]:
        yield Document(metadata=xml_metadata(tree, root, form), raw=text)


@parser("commands")
def commands(text: str, form: Format) -> Iterator[Document]:
    """One instruction a line: DOC_START, METADATA name value, FIELD_START name, VAL annotation value, ADVANCE n, SPAN type start end, FIELD_END, DOC_END.

    What stands behind `#` is a comment. An unknown instruction is an error.
    """
    d: Document | None = None
    values: dict[str, list[str]] = {}
    begin = at = behind = 0
    for whole in _lines(text):
        first, behind = behind, behind + len(whole)
        words = whole.split("#", 1)[0].split(None, 2)
        if not words:
            continue
        name, rest = words[0], whole.split("#", 1)[0].split(None, 1)[1].strip() if len(words) > 1 else ""
        if name == "DOC_START":
            d, begin = Document(), first
        elif d is None:
            raise FormatError(f"{name} outside of a document")
        elif name == "DOC_END":
            d.raw = text[begin:behind]
            yield d
            d = None
        elif name == "METADATA":
            d.metadata.setdefault(words[1], []).append(words[2].strip() if len(words) > 2 else "")
        elif name == "FIELD_START":
            d.field, values, at = words[1], {}, first
        elif name == "VAL":
            values.setdefault(words[1], []).append(words[2].strip() if len(words) > 2 else "")
        elif name in ("ADVANCE", "FIELD_END"):
            if values:
                d.word(values, " " if d.tokens else "", at - begin, first - begin)
                values, at = {}, behind
            for _ in range(int(rest or 1) - 1 if name == "ADVANCE" else 0):
                d.word({}, " ")
        elif name == "SPAN":
            tag, start, end = rest.split()
            d.spans.append((tag, int(start), int(end), {}))
        else:
            raise FormatError(f"unknown instruction {name}")
