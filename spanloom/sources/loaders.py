"""Loading of files and archives into corpus tables: one row per part of a document from a single parse, then flat tables."""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import process
from spanloom.plans.compiler import Tables
from spanloom.session import importable
from spanloom.sources import parsers
from spanloom.sources.descriptor import BUNDLED, Annotation, Format, FormatError, Linked
from spanloom.sources.held import Spool

_VALUES = "map<string,array<string>>"
DOCUMENT = (
    "path string, doc_no int, field string, error string, metadata map<string,array<string>>, raw string, "
    f"tokens array<struct<pos:int,`values`:{_VALUES},punct:string,char_start:int,char_end:int>>, "
    "spans array<struct<tag:string,start_pos:int,end_pos:int,attrs:map<string,string>>>, "
    "relations array<struct<rel_class:string,rel_type:string,src_start:int,src_end:int,tgt_start:int,tgt_end:int,attrs:map<string,string>,tgt_field:string>>, "
    "part int, last boolean, block int, related int"
)
FORMATS: dict[str, Format] = dict(BUNDLED)
#: Stages before a file is parsed, by name: converters, from bytes or text to text, and taggers, from text to text.
CONVERTERS: dict[str, Callable] = {"none": lambda t: t}
#: The names of those that take bytes.
BINARY: set[str] = set()


def register_format(form: Format) -> None:
    FORMATS[form.name] = form


def register_converter(name: str, f: Callable, binary: bool = False) -> None:
    """A stage by name; one that is `binary` takes a file's bytes and must come first."""
    CONVERTERS[name] = f
    (BINARY.add if binary else BINARY.discard)(name)


def stages(names: str | list[str]) -> Callable[[bytes], str]:
    """What brings a file's bytes through the named stages, one after another."""
    names = [names] if isinstance(names, str) else list(names)
    for n in names:
        if n not in CONVERTERS:
            raise FormatError(f"unknown converter {n}")
    if any(n in BINARY for n in names[1:]):
        raise FormatError("a converter of bytes must come first")
    first = names[:1] if names and names[0] in BINARY else []
    start, rest = (CONVERTERS[first[0]] if first else decode), [CONVERTERS[n] for n in names[len(first) :]]

    def run(data: bytes) -> str:
        text = start(data)
        for f in rest:
            text = f(text)
        return text

    return run


ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".gz")


def members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The files in an archive, archives in archives too; any other file is its own member."""
    return _members(path, io.BytesIO(data)) if path.lower().endswith(ARCHIVES) else iter([(path, data)])


def _members(path: str, stream) -> Iterator[tuple[str, bytes]]:
    """The files of an open archive, one at a time."""
    low = path.lower()
    if low.endswith(".zip"):
        with zipfile.ZipFile(stream) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield from members(f"{path}/{i.filename}", z.read(i))
    elif low.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=stream, mode="r|*") as t:
            for i in t:
                if i.isfile() and (f := t.extractfile(i)):
                    yield from members(f"{path}/{i.name}", f.read())
    else:
        with gzip.open(stream) as f:
            yield path[:-3], f.read()


def _open(path: str):
    """A file that tasks can reach, by its URL."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "/", path))
    return system.open_input_file(inner)


#: Bytes of members that leave a task at once.
AT_ONCE = 32 << 20


def expanded(archives: DataFrame) -> DataFrame:
    """archives: path. The files in them as path and content, spread over all tasks. Archives are read as streams, of whatever size; one
    that can't be read gives a row with a null content and its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, contents, held = [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with _open(path) as f:
                        for name, data in _members(path, f):
                            names.append(name)
                            contents.append(data)
                            held += len(data)
                            if held > AT_ONCE:
                                yield flush()
                                names, contents, held = [], [], 0
                except Exception:  # noqa: BLE001  one bad archive must not stop the load
                    names.append(path)
                    contents.append(None)
        yield flush()

    members_ = archives.select("path").mapInArrow(run, "path string, content binary")
    return members_.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def decode(data: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig",):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def resolve_includes(text: str, folder: str, read: Callable[[str], str], depth: int = 8) -> str:
    """Replaces `<xi:include href="..."/>` by the files' contents without their XML declarations."""
    if depth == 0:
        raise FormatError("includes go too deep")

    def put(m: re.Match) -> str:
        path = os.path.join(folder, m.group(1))
        inner = re.sub(r"^\s*<\?xml[^>]*\?>", "", read(path))
        return resolve_includes(inner, os.path.dirname(path), read, depth - 1)

    return re.sub(r"<(?:\w+:)?include\s[^>]*href=[\"']([^\"']+)[\"'][^>]*?(?:/>|>\s*</(?:\w+:)?include>)", put, text)


_INCLUDE = re.compile(r"<(?:\w+:)?include\s")


def _read_beside(path: str) -> str:
    with _open(path) as f:
        return decode(f.read())


class _Rows:
    """Parts of documents as batches of rows, built by columns."""

    #: Tokens, spans and relations of a batch, about.
    MOST = 8192

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self._begin()

    def _begin(self) -> None:
        self.names, self.parts, self.size = [], [], 0

    def add(self, path: str | None, no: int, d: parsers.Document, error: str | None = None) -> None:
        self.names.append((path, no, error))
        self.parts.append(d)
        self.size += 1 + len(d.tokens) + len(d.spans) + len(d.relations) + (len(d.raw or "") >> 5)

    def extend(self, other: _Rows) -> None:
        self.names += other.names
        self.parts += other.parts
        self.size += other.size

    def full(self) -> bool:
        return self.size >= self.MOST

    def taken(self) -> pa.RecordBatch:
        ps, type_ = self.parts, {f.name: f.type for f in self.schema}
        at = lambda xs: pa.array(list(accumulate(xs, initial=0)), pa.int32())
        texts = lambda xs: pa.array(xs, pa.string())

        def lists(xs: list[list[str]], type_: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(at(map(len, xs)), texts([v for x in xs for v in x]), type=type_)

        def maps(xs: list[dict | None], type_: pa.DataType, items: Callable) -> pa.Array:
            full = [x or {} for x in xs]
            return pa.MapArray.from_arrays(at(map(len, full)), texts([k for x in full for k in x]), items([v for x in full for v in x.values()]), type=type_)

        def rows(of: str, columns: list[pa.Array]) -> pa.Array:
            struct = type_[of].value_type
            return pa.ListArray.from_arrays(at(len(getattr(p, of)) for p in ps), pa.StructArray.from_arrays(columns, fields=list(struct)), type=type_[of])

        def kind(of: str, name: str) -> pa.DataType:
            return type_[of].value_type.field(name).type

        ints = lambda xs: pa.array(xs, pa.int32())
        t = [x for p in ps for x in p.tokens]
        values = kind("tokens", "values")
        tokens = [ints([i for p in ps for i in range(p.first, p.first + len(p.tokens))]), maps([x[0] for x in t], values, lambda v: lists(v, values.item_type)), texts([x[1] for x in t]), ints([x[2] for x in t]), ints([x[3] for x in t])]
        s = [x for p in ps for x in p.spans]
        spans = [texts([x[0] for x in s]), ints([x[1] for x in s]), ints([x[2] for x in s]), maps([x[3] for x in s], kind("spans", "attrs"), texts)]
        r = [x for p in ps for x in p.relations]
        relations = [*(texts([x[i] for x in r]) for i in (0, 1)), *(ints([x[i] for x in r]) for i in (2, 3, 4, 5)), maps([x[6] for x in r], kind("relations", "attrs"), texts), texts([x[7] if len(x) > 7 else None for x in r])]
        known = {
            "path": [n for n, _, _ in self.names], "doc_no": [n for _, n, _ in self.names], "field": [p.field for p in ps], "error": [e for _, _, e in self.names],
            "metadata": [list(p.metadata.items()) if p.last else None for p in ps], "raw": [p.raw for p in ps], "part": [p.part for p in ps], "last": [p.last for p in ps], "block": [p.block for p in ps], "related": [p.related for p in ps],
        }
        nested = {"tokens": tokens, "spans": spans, "relations": relations}
        arrays = [rows(f.name, nested[f.name]) if f.name in nested else pa.array(known[f.name], f.type) for f in self.schema]
        self._begin()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


#: Batches of a file that are held in memory until all of it is parsed; more lie in a file.
HELD = 8


def documents(files: DataFrame, form: Format, converter: str | list[str] = "none", pieces: bool = False) -> DataFrame:
    """files: path, content (binary). Rows for the parts of each document and annotated field; a file that can't be parsed gives one row with its error.

    Files that XML includes are read from beside it. With `pieces`, contents are pieces of the files' text (string), and those of a file follow
    each other in a partition; an include must lie in one piece. So neither side holds a large file as a whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    if pieces and converter not in ("none", ["none"], []):
        raise FormatError("a converter needs whole files")
    convert = stages(converter)
    schema = StructType.fromDDL(DOCUMENT)

    def included(text: str, name: str) -> str:
        return resolve_includes(text, os.path.dirname(name), _read_beside) if form.file_type == "xml" and _INCLUDE.search(text) else text

    def parsed(name: str, of: Callable[[], Iterator[parsers.Document]]) -> tuple[Spool, _Rows]:
        """The batches of a large file, and the parts that don't fill one."""
        held, rest, no = Spool(HELD), _Rows(to_arrow_schema(schema)), -1
        for d in of():
            no += not d.further and not d.part
            rest.add(name, no, d)
            if rest.full():
                held.append(rest.taken())
        return held, rest

    def whole(path: str, data: bytes | None) -> Iterator[tuple[Spool, _Rows]]:
        if data is None:
            raise FormatError("it can't be read")
        for name, inner in members(path, data):
            text = [included(convert(inner), name)]
            try:
                yield parsed(name, lambda: parsers.parts(text, form))  # noqa: B023
            except parsers.Nested:
                yield parsed(name, lambda: parsers.parts(text, form, whole=True))  # noqa: B023

    def piecewise(path: str, texts: Iterable[str | None]) -> Iterator[tuple[Spool, _Rows]]:
        def read() -> Iterator[str]:
            for x in texts:
                if x is None:
                    raise FormatError("it can't be read")
                yield included(x, path)

        yield parsed(path, lambda: parsers.parts(read(), form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(to_arrow_schema(schema))
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        files_ = ((path, piecewise(path, (x for _, x in group))) for path, group in groupby(rows, lambda x: x[0])) if pieces else ((path, whole(path, data)) for path, data in rows)
        for path, found in files_:
            try:
                for held, rest in found:
                    yield from held
                    out.extend(rest)
                    if out.full():
                        yield out.taken()
            except Exception as e:  # noqa: BLE001  one bad file must not stop the load
                out.add(path, -1, parsers.Document(raw=None, field=form.field), f"{type(e).__name__}: {e}"[:500])
            if out.full():
                yield out.taken()
        if out.size:
            yield out.taken()

    return files.select("path", "content").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str | list[str], glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files of folders as path and content, read by the tasks, and those in archives."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    packed = F.lower("path").rlike(r"\.(zip|tar|tgz|gz)$")
    # contents of archives aren't read here, so they may be of any size
    return found.where(~packed).select("path", "content").unionByName(expanded(found.where(packed).select("path")))


class Loaded:
    """The flat tables of parsed documents. With `keep` the parse is cached while the tables are used; write them to keep them.
    Documents get an id from path and number, unless `numbered` says that they have one."""

    def __init__(self, parsed: DataFrame, form: Format, keep: bool = True, numbered: bool = False):
        rows = parsed if numbered else parsed.withColumn("doc_id", F.xxhash64("path", "doc_no"))
        self.parsed = rows.cache() if keep else rows
        self.form = form

    def errors(self) -> DataFrame:
        return self.parsed.where("error IS NOT NULL").select("path", "error")

    def docs(self) -> DataFrame:
        rows = self.parsed.where(F.col("field") == self.form.field).groupBy("doc_id", "path", "doc_no")
        blocks = F.sort_array(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("block", "raw"))))
        good = rows.agg(
            F.first("metadata", True).alias("metadata"), F.sum(F.size("tokens")).cast("int").alias("length_tokens"), F.array_join(F.transform(blocks, lambda x: x["raw"]), "").alias("raw"), F.max("error").alias("error")
        ).where("error IS NULL")
        fields = [m for m in self.form.metadata if m.name and not m.name.startswith("_link_")]
        own = [F.try_element_at("metadata", F.lit(m.name)) for m in fields]
        cols = []
        for m, values in zip(fields, own):
            v = F.try_element_at(values, F.lit(1))
            v = process.apply(v, list(m.process)) if m.process else v
            cols.append(process.unknown(v, m.unknown_condition, m.unknown_value).alias(m.name))
        names = {m.name for m in fields}
        pid = [] if "pid" in names else [F.coalesce(F.try_element_at(F.try_element_at("metadata", F.lit("pid")), F.lit(1)), F.concat_ws("#", "path", "doc_no")).alias("pid")]
        return good.select("doc_id", *pid, *cols, "metadata", "length_tokens", "raw", "path")

    def originals(self) -> DataFrame:
        """The originals in blocks of `parsers.BLOCK` characters, of which a task needn't hold all: doc_id, block, raw."""
        return self.parsed.where((F.col("field") == self.form.field) & F.col("error").isNull() & F.col("raw").isNotNull()).select("doc_id", "block", "raw")

    def _form(self, field: str | None) -> Format:
        return next(f for f in (self.form, *self.form.further) if field in (None, f.field))

    def _rows(self, field: str | None) -> DataFrame:
        return self.parsed.where(F.col("field") == self._form(field).field)

    def annotations(self, field: str | None = None) -> dict[str, Annotation]:
        """The annotations of a field: those of the format, and those that are named in the files, of which there may be MOST_NAMED."""
        form = self._form(field)
        named = {n: a for n, a in form.all_annotations() if n} | {a.name: a for s in form.standoff if s.kind == "token" for a in s.annotations}
        if any(a.for_each for _, a in form.all_annotations()):
            keys = self._rows(field).select(F.explode("tokens").alias("t")).select(F.explode(F.map_keys("t.values")).alias("k")).distinct().limit(MOST_NAMED + 1).collect()
            if len(keys) > MOST_NAMED:
                raise FormatError(f"more than {MOST_NAMED} annotations")
            named |= {k: Annotation(k) for k in sorted(r["k"] for r in keys) if k not in named}
        return named

    def tokens(self, field: str | None = None) -> DataFrame:
        rows = self._rows(field).select("doc_id", F.explode("tokens").alias("t"))
        cols = []
        for name, a in self.annotations(field).items():
            values = F.try_element_at("t.values", F.lit(name))
            if a.process:
                values = _processed(values, list(a.process))
            column = "a_pos" if name == "pos" else name
            cols += [F.try_element_at(values, F.lit(1)).alias(column), F.when(F.size(values) > 1, values).alias(f"{column}_all")]
        return rows.select("doc_id", "t.pos", *cols, F.col("t.punct").alias("punct"), "t.char_start", "t.char_end")

    def spans(self, field: str | None = None) -> DataFrame:
        return self._rows(field).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")

    def relations(self, field: str | None = None) -> DataFrame:
        own = self._form(field).field
        rows = self._rows(field).select("doc_id", "related", F.posexplode("relations").alias("rel_no", "r")).withColumn("rel_no", F.col("related") + F.col("rel_no"))
        root = F.col("r.src_start").isNull()
        return rows.select(
            "doc_id", F.lit(own).alias("field"), F.xxhash64("doc_id", F.lit(own), "rel_no").alias("rel_id"), "r.rel_class", "r.rel_type", F.transform_values("r.attrs", lambda k, v: F.array(v)).alias("attrs"), root.alias("is_root"),
            F.coalesce("r.src_start", "r.tgt_start").alias("src_start"), F.coalesce("r.src_end", "r.tgt_end").alias("src_end"), F.coalesce("r.tgt_field", F.lit(own)).alias("tgt_field"), "r.tgt_start", "r.tgt_end",
        )

    def tables(self, field: str | None = None) -> Tables:
        """The tables to search in, those of the other annotated fields beside them."""
        form = self._form(field)
        names = self.annotations(field)
        out = Tables(self.tokens(field), self.spans(field), self.relations(field), {n: "a_pos" if n == "pos" else n for n, a in names.items() if a.forward_index} | {"punct": "punct"}, name=form.field)
        if field is None:
            out.fields = {f.field: self.tables(f.field) for f in self.form.further}
        return out


#: Annotations whose names come from the files.
MOST_NAMED = 1000


def _processed(values, steps: list[dict]):
    return F.flatten(F.transform(values, lambda v: process.apply_all(v, steps)))


def load(spark: SparkSession, path: str | list[str], form: str | Format, glob: str = "*", converter: str | list[str] = "none") -> Loaded:
    """Loads files in a format given by name or descriptor."""
    importable(spark)
    if isinstance(form, str):
        if form not in FORMATS:
            raise FormatError(f"unknown format {form}")
        form = FORMATS[form]
    files = read_files(spark, path, glob)
    parsed = documents(files, form, converter)
    for link in form.linked:
        parsed = with_linked(parsed, form, link)
    return Loaded(parsed, form)


def with_linked(parsed: DataFrame, form: Format, link: Linked) -> DataFrame:
    """Adds the metadata of the files that documents name to theirs; fields that both have keep the document's own values.

    A link's value is a field of the document's metadata, by `valueField` or as a metadata field of the value's path. The folder that all the linked files
    are in is read by the tasks and joined by path. Of a file of several documents, that whose `pid` is the first value is taken, if there is one.
    A document whose link has no value or no file is an error unless the descriptor says to ignore it.
    """
    spark = parsed.sparkSession
    first = link.file.partition("$")[0]
    folder = first.rpartition("/")[0] or "."
    linked_form = FORMATS.get(link.format)
    if linked_form is None:
        raise FormatError(f"unknown format {link.format}")
    paths_ = {m.value: m.name for m in form.metadata if m.name}
    keys = [f or paths_.get(v) for f, v in zip(link.fields, link.values)]
    if None in keys:
        raise FormatError("a link's value must be a field of the metadata")
    values = [F.try_element_at(F.try_element_at("metadata", F.lit(k)), F.lit(1)) for k in keys]
    target: object = F.lit(link.file)
    for i, v in enumerate(values, 1):
        target = F.replace(target, F.lit(f"${i}"), v)
    bare = lambda c: F.regexp_replace(c, r"^(file:)?/*", "")
    others = documents(read_files(spark, folder), linked_form).where("error IS NULL AND last")
    known = others.select(bare("path").alias("_link"), F.try_element_at(F.try_element_at("metadata", F.lit("pid")), F.lit(1)).alias("_pid"), F.col("metadata").alias("_theirs"))
    if not link.document:
        known = known.dropDuplicates(["_link"])
    joined = parsed.withColumn("_to", bare(target)).join(known, F.col("_to") == F.col("_link"), "left")
    several = joined.where(F.col("_pid").isNull() | (F.col("_pid") == values[0]) | F.col("_link").isNull()) if link.document else joined
    lost = F.col("error").isNull() & F.col("_theirs").isNull() & F.lit(link.missing == "fail") & (F.col("field") == form.field) & F.col("last")
    own = F.map_filter("_theirs", lambda k, v: ~F.array_contains(F.map_keys("metadata"), k))
    merged = F.when(F.col("_theirs").isNotNull(), F.map_concat("metadata", own)).otherwise(F.col("metadata"))
    out = several.withColumn("metadata", merged).withColumn("error", F.when(lost, F.concat(F.lit("linked file missing: "), F.coalesce("_to", F.lit("no value")))).otherwise(F.col("error")))
    return out.select(*parsed.columns)


def link_metadata(docs: DataFrame, other: DataFrame, on: str, key: str) -> DataFrame:
    """Adds another table's metadata by a link value; documents without a link keep nulls. Columns that clash get `linked_` in front."""
    one = other.dropDuplicates([key])
    renamed = one.select(F.col(key).alias("_link"), *[F.col(c).alias(f"linked_{c}" if c in docs.columns else c) for c in one.columns if c != key])
    return docs.join(renamed, docs[on] == F.col("_link"), "left").drop("_link")
