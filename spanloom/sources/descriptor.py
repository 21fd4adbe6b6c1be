"""Format descriptors: how documents, annotated fields, annotations, spans and metadata are found in input files."""

from __future__ import annotations

from dataclasses import dataclass, replace
from dataclasses import field as made
from typing import Any


@dataclass(frozen=True)
class Annotation:
    """value: a column name or number for tables, a path for XML. Sub-annotations become `<name>_<sub>`."""

    name: str
    value: str = ""
    process: tuple[dict, ...] = ()
    multiple: bool = False
    sensitivity: str = "sensitive_insensitive"
    sub: tuple[Annotation, ...] = ()
    map: tuple[tuple[str, str], ...] = ()
    #: Each element at this path gives an annotation, named by `name_path`.
    for_each: str = ""
    name_path: str = ""
    #: Whether it is seen in contexts, sorts and groups, and not just searched.
    forward_index: bool = True


@dataclass(frozen=True)
class Standoff:
    """Annotations declared elsewhere in the document. kind: token, span or relation.

    Paths are seen from each element at `path`. A token reference is a token's id or an anchor's; an anchor stands for the
    token that follows it.
    """

    path: str
    kind: str = "token"
    token: str = ""
    start: str = ""
    end: str = ""
    end_inclusive: bool = True
    name: str = ""
    source: str = ""
    target: str = ""
    relation_class: str = "rel"
    annotations: tuple[Annotation, ...] = ()
    anchor: str = ""


@dataclass(frozen=True)
class InlineTag:
    """Elements that become spans. Attributes: all but `exclude`, or only `include`. token: whether it stands before a token as an anchor."""

    path: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    name: str = ""
    #: Attributes of the span beside those of the element: name and path.
    extra: tuple[tuple[str, str], ...] = ()
    #: The path of an id by which standoff annotations refer to the token behind the tag.
    token_id: str = ""


@dataclass(frozen=True)
class Linked:
    """A file of metadata that each document names. values: paths in the document or names of its metadata fields, put for $1, $2 ... in `file`."""

    name: str
    file: str
    format: str
    values: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    document: str = ""
    missing: str = "fail"
    store: bool = False


@dataclass(frozen=True)
class MetadataField:
    name: str
    value: str
    process: tuple[dict, ...] = ()
    #: For blocks: each element at `for_each` gives a field named by `name_path`.
    for_each: str = ""
    name_path: str = ""
    kind: str = "tokenized"
    unknown_condition: str = "never"
    unknown_value: str = "unknown"


@dataclass(frozen=True)
class Format:
    name: str
    file_type: str
    display_name: str = ""
    document: str = "."
    container: str = "."
    word: str = ".//w"
    punct: str = ""
    token_id: str = ""
    annotations: tuple[Annotation, ...] = (Annotation("word", "."),)
    inline_tags: tuple[InlineTag, ...] = ()
    standoff: tuple[Standoff, ...] = ()
    metadata: tuple[MetadataField, ...] = ()
    #: Tables: separator, quote, header, inline_tags, glue_tags, multiple_separator.
    options: tuple[tuple[str, Any], ...] = ()
    extra: dict = made(default_factory=dict, compare=False)
    field: str = "contents"
    #: Other annotated fields of the same documents, as formats of their own.
    further: tuple[Format, ...] = ()
    linked: tuple[Linked, ...] = ()

    def option(self, name: str, default: Any = None) -> Any:
        return dict(self.options).get(name, default)

    def all_annotations(self) -> list[tuple[str, Annotation]]:
        return [x for a in self.annotations for x in [(a.name, a), *((f"{a.name}_{s.name}", s) for s in a.sub)]]


class FormatError(ValueError):
    pass


def _annotation(d: dict) -> Annotation:
    sub = d.get("subannotations", d.get("subAnnotations", []))
    return Annotation(
        d.get("name", ""), str(d.get("valuePath", d.get("value", ""))), tuple(d.get("process", ())), bool(d.get("multipleValues", False)),
        d.get("sensitivity", "sensitive_insensitive"), tuple(_annotation(s) for s in sub), tuple(sorted(d.get("mapValues", {}).items())),
        d.get("forEachPath", ""), d.get("namePath", ""), bool(d.get("forwardIndex", True)),
    )


def from_dict(name: str, d: dict) -> Format:
    """A format from the keys that descriptor files use."""
    fields = d.get("annotatedFields") or {"contents": {}}
    metadata = d.get("metadata", {})
    blocks = metadata if isinstance(metadata, list) else [metadata]
    fields_ = []
    for b in blocks:
        base = b.get("containerPath", "")
        for m in b.get("fields", []):
            path, each = m.get("valuePath", ""), m.get("forEachPath", "")
            below = lambda p: f"{base}/{p}" if base and p and p != "." else base or p  # noqa: B023, E731
            fields_.append(MetadataField(m.get("name", ""), path if each else below(path), tuple(m.get("process", ())), below(each) if each else "", m.get("namePath", ""), m.get("type", "tokenized"), m.get("unknownCondition", "never").lower(), m.get("unknownValue", "unknown")))
    options = tuple(sorted(d.get("fileTypeOptions", {}).items()))
    linked = []
    for link, x in d.get("linkedDocuments", {}).items():
        values = x.get("linkValues", [])
        linked.append(Linked(link, x["inputFile"], x.get("inputFormat", "cmdi"), tuple(v.get("valuePath", "") for v in values), tuple(v.get("valueField", "") for v in values), x.get("documentPath", ""), x.get("ifLinkPathMissing", "fail").lower(), bool(x.get("store", False))))
    known = {m.value for m in fields_}
    for link in linked:  # values that are no metadata of their own
        fields_ += [MetadataField(f"_link_{link.name}_{i}", v) for i, v in enumerate(link.values) if v and v not in known]
    forms = [_field(name, d, field_name, f) for field_name, f in fields.items()]
    return replace(forms[0], options=options, metadata=tuple(fields_), extra=d.get("corpusConfig", {}), further=tuple(forms[1:]), linked=tuple(linked))


def _field(name: str, d: dict, field_name: str, f: dict) -> Format:
    """The part of a format that describes one annotated field."""
    standoff = []
    for s in f.get("standoffAnnotations", []):
        kind = s.get("type") or ("relation" if "targetPath" in s else "span" if "spanStartPath" in s else "token")
        standoff.append(
            Standoff(
                s["path"], kind, s.get("tokenRefPath", s.get("refTokenPositionIdPath", "")), s.get("spanStartPath", ""), s.get("spanEndPath", ""), s.get("spanEndIsInclusive", True),
                s.get("spanNamePath", s.get("valuePath", "")), s.get("sourcePath", ""), s.get("targetPath", ""), s.get("relationClass", "rel"), tuple(_annotation(a) for a in s.get("annotations", [])),
            )
        )
    tags = []
    for t in f.get("inlineTags", []):
        extra = tuple((a["name"], a["valuePath"]) for a in t.get("attributes", t.get("extraAttributes", [])))
        tags.append(InlineTag(t["path"], tuple(t.get("includeAttributes", ())), tuple(t.get("excludeAttributes", ())), t.get("displayAs", ""), extra, t.get("tokenIdPath", t.get("tokenPositionIdPath", ""))))
    return Format(
        name, d.get("fileType", "xml"), d.get("displayName", name), d.get("documentPath", "."), f.get("containerPath", "."), f.get("wordPath", ".//w"), f.get("punctPath", ""),
        f.get("tokenIdPath", f.get("tokenPositionIdPath", "")), tuple(_annotation(a) for a in f.get("annotations", [{"name": "word", "valuePath": "."}])), tuple(tags), tuple(standoff), field=field_name,
    )


def from_yaml(name: str, text: str) -> Format:
    import yaml

    return from_dict(name, yaml.safe_load(text))


def _simple(name: str, file_type: str, annotations: dict[str, str], **more: Any) -> Format:
    return Format(name, file_type, name, annotations=tuple(Annotation(k, v) for k, v in annotations.items()), **more)


_THREE = {"word": "word", "lemma": "lemma", "pos": "pos"}

#: The formats that are known by name. Column numbers, paths and names in them are fixed values of the formats.
BUNDLED: dict[str, Format] = {
    f.name: f
    for f in (
        _simple("txt", "text", {"word": "."}),
        _simple("tsv", "tabular", _THREE, options=(("header", True), ("separator", "\t"))),
        _simple("csv", "tabular", _THREE, options=(("header", True), ("separator", ","))),
        _simple("tsv-frog", "tabular", {"word": "2", "lemma": "3", "morph": "4", "pos": "5", "chunk": "8"}, options=(("header", False), ("separator", "\t"))),
        _simple("sketch-wpl", "tabular", {"word": "1", "pos": "2", "lemma": "3"}, options=(("header", False), ("separator", "\t"), ("inline_tags", True), ("glue_tags", True), ("document_tag", "doc"))),
        _simple("conll-u", "conll-u", {"word": "2", "lemma": "3", "pos": "4", "xpos": "5", "feats": "6"}),
        _simple("commands", "commands", {"word": "word", "lemma": "lemma"}),
        _simple("chat", "chat", {"word": "word", "pos": "pos", "lemma": "lemma"}),
        _simple("tei-p5", "xml", {"word": ".", "lemma": "@lemma", "pos": "@pos|@type|@ana"}, document="//TEI", container=".//text", word=".//w|.//pc", token_id="@id", inline_tags=tuple(InlineTag(f".//{t}") for t in ("p", "s", "head", "u", "ab")), metadata=(MetadataField("title", ".//titleStmt/title"), MetadataField("author", ".//titleStmt/author"), MetadataField("pid", ".//publicationStmt/idno"))),
        _simple("tei-p4", "xml", {"word": ".", "lemma": "@lemma", "pos": "@type|@function"}, document="//TEI.2", container=".//text", word=".//w", inline_tags=tuple(InlineTag(f".//{t}") for t in ("p", "s", "head")), metadata=(MetadataField("title", ".//titleStmt/title"), MetadataField("author", ".//titleStmt/author"))),
        _simple("folia", "xml", {"word": "t", "lemma": "lemma/@class", "pos": "pos/@class"}, document="//FoLiA", container=".//text", word=".//w", token_id="@id", inline_tags=(InlineTag(".//s"), InlineTag(".//p")), metadata=(MetadataField("", ".", for_each=".//metadata/meta", name_path="@id"),)),
        _simple("naf", "xml", {"word": "."}, document="//NAF", container=".", word="text/wf", token_id="@id", metadata=(MetadataField("title", "nafHeader/fileDesc/@title"), MetadataField("author", "nafHeader/fileDesc/@author")), standoff=(Standoff("terms/term", "token", token="span/target/@id", annotations=(Annotation("lemma", "@lemma"), Annotation("pos", "@pos"))),)),
        _simple("tcf", "xml", {"word": "."}, document="//TextCorpus", container=".", word="tokens/token", token_id="@ID", standoff=(Standoff("lemmas/lemma", "token", token="@tokenIDs", annotations=(Annotation("lemma", "."),)), Standoff("POStags/tag", "token", token="@tokenIDs", annotations=(Annotation("pos", "."),)))),
        _simple("eaf", "xml", {"word": "."}, document="//ANNOTATION_DOCUMENT", container=".", word=".//ANNOTATION_VALUE", metadata=(MetadataField("author", "@AUTHOR"), MetadataField("date", "@DATE"))),
        _simple("alto", "xml", {"word": "@CONTENT"}, document="//alto", container=".//Layout", word=".//String", inline_tags=(InlineTag(".//TextLine"), InlineTag(".//TextBlock"))),
        _simple("pagexml", "xml", {"word": "TextEquiv/Unicode"}, document="//PcGts", container=".", word=".//Word", inline_tags=(InlineTag(".//TextLine"), InlineTag(".//TextRegion"))),
        _simple("cmdi", "metadata", {"word": "."}, document="//CMD", metadata=(MetadataField("", ".", for_each=".//Components//*[not(*)]", name_path="name()"),)),
        _simple("imdi", "metadata", {"word": "."}, document="//METATRANSCRIPT", metadata=(MetadataField("", ".", for_each=".//Session//*[not(*)]", name_path="name()"),)),
        _simple("testformat", "xml", {"word": ".", "lemma": "@l", "pos": "@p"}, document="//doc", container=".", word=".//w", inline_tags=(InlineTag(".//s"), InlineTag(".//entity")), metadata=(MetadataField("pid", "@pid"), MetadataField("title", "@title"))),
    )
}
