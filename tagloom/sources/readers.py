"""XML and HTML files and strings as DataFrames.

XML records are read by Spark's own XML source, which holds one record at a time, whatever a file's
size. What it infers is then brought to the schema rules of
this library: bare attribute names, columns in order of first sight, the narrowest integer, yes/no as
booleans, an opaque column below ``max_depth``. Whole files come from the binary file source. HTML is
first made well formed, record by record, and then read like XML.
"""

from __future__ import annotations

import re
import uuid
from itertools import groupby
from operator import itemgetter
from xml.parsers import expat

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as M
from ..functions import _rows
from ..functions._dom import serialize
from ..functions._xpath import select
from ..session import shared_folder, whole_files

#: Presets of datetime_format: date and timestamp patterns.
DATETIME = {
    "us": ("MM/dd/yyyy", None), "eu": ("dd/MM/yyyy", None), "iso": ("yyyy-MM-dd", None),
    "us_timestamp": (None, "MM/dd/yyyy HH:mm:ss"), "eu_timestamp": (None, "dd/MM/yyyy HH:mm:ss"), "iso_timestamp": (None, "yyyy-MM-dd'T'HH:mm:ss"), "iso_timestamptz": (None, "yyyy-MM-dd'T'HH:mm:ssXXX"),
    "12hour": (None, "MM/dd/yyyy hh:mm:ss a"), "24hour": (None, "MM/dd/yyyy HH:mm:ss"),
}
HEAD_CHARS = 1 << 16
NONE = "No files found matching pattern"


def _paths(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    try:
        return spark.read.format("binaryFile").load(_paths(paths))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{NONE}: {paths}") from e
        raise


def _objects(files: DataFrame, name: str, filename: bool, maximum_file_size: int | None) -> DataFrame:
    if maximum_file_size is not None:
        over = F.raise_error(F.concat(F.lit("file is larger than maximum_file_size: "), "path")).cast("string")
        text = F.when(F.col("length") > maximum_file_size, over).otherwise(F.decode("content", "UTF-8"))
    else:
        text = F.decode("content", "UTF-8")
    return files.select(*([F.col("path").alias("filename")] if filename else []), text.alias(name))


def read_xml_objects(spark: SparkSession, paths: str | list[str], ignore_errors: bool = False, filename: bool = False, maximum_file_size: int | None = None) -> DataFrame:
    """One row per file; malformed files are an error, or left out with ``ignore_errors``."""
    return _checked(_objects(_binary(spark, paths), "xml", filename, maximum_file_size), "xml", ignore_errors)


def _checked(df: DataFrame, name: str, ignore_errors: bool) -> DataFrame:
    good = M.xml_valid(name)
    if ignore_errors:
        return df.where(good)
    return df.withColumn(name, F.when(good, F.col(name)).otherwise(F.raise_error(F.lit("a document is not valid XML")).cast("string")))


def read_html_objects(spark: SparkSession, paths: str | list[str], filename: bool = False, maximum_file_size: int | None = None) -> DataFrame:
    """One row per file; an empty file is an empty document."""
    files = _binary(spark, paths)
    df = _objects(files, "html", filename, maximum_file_size)
    names = files.inputFiles()
    if files.select("path").count() < len(names):
        # Spark plans no task for a file of no bytes
        plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        named = spark.createDataFrame([(p,) for p in names], "filename string")
        empty = named.join(files.select(plain("path").alias("p")), plain(F.col("filename")) == F.col("p"), "left_anti")
        df = df.unionByName(empty.select("filename", F.lit("").alias("html")).select(*df.columns))
    return df.withColumn("html", F.when(F.col("html") == "", "<html></html>").otherwise(F.col("html")))


def parse_xml_objects(spark: SparkSession, text: str, ignore_errors: bool = False) -> DataFrame:
    return _checked(spark.createDataFrame([(text,)], "xml string"), "xml", ignore_errors)


def parse_html_objects(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text or "<html></html>",)], "html string")


def _head(spark: SparkSession, path: str) -> str:
    """The beginning of the first file, from which the record's tag can be told."""
    try:
        lines = spark.read.text(path).select(F.substring("value", 1, HEAD_CHARS).alias("value")).limit(400).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{NONE}: {path}") from e
        raise
    return "\n".join(r["value"] for r in lines)


_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>|<(/?)([^\s/>!?]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)


def _tags(head: str):
    """Depth, name and attributes of each element that starts in ``head``."""
    depth = 0
    for m in _TAG.finditer(head):
        if m[2]:
            depth -= bool(m[1])
            if not m[1]:
                yield depth, m[2], re.findall(r"([^\s=]+)\s*=", m[3])
                depth += not m[4]


def record_tags(head: str, root_element: str = "", max_depth: int = 10) -> list[str]:
    """Tags of the records: children of the root, or of ``root_element`` where that is found; the root itself at depth 0."""
    seen, inside = list(_tags(head)), None
    if not seen:
        return []
    if max_depth == 0:
        return [seen[0][1]]
    level = 1
    for depth, name, _ in seen:
        if root_element and name == root_element:
            level, inside = depth + 1, name
            break
    out, on = [], not inside
    for depth, name, _ in seen:
        on = on or name == inside
        if on and depth == level and name not in out:
            out.append(name)
    return out or [seen[0][1]]


def all_tags(spark: SparkSession, paths: list[str], head: str, o: Options) -> list[str]:
    """Tags of the records in all files: children of the roots, or of ``root_element`` where that is found; the roots at depth 0."""
    found = sorted(x.split(" ", 1) for x in _parsed_files(spark, paths, o, lambda: _Records(o.root_element)))
    of = lambda kind: [t for k, t in found if k == kind]
    tags = of("root") if o.max_depth == 0 else of("inside") or of("child") or of("root")
    # those of the first file's beginning in their order
    first = record_tags(head, o.root_element, o.max_depth)
    return [t for t in first if t in tags] + [t for t in tags if t not in first]


def _parsed_files(spark: SparkSession, paths: list[str], o: Options, handler) -> list[str]:
    """What handlers (a new one for each file) find in all files, distinct.

    Each file is one stream of pieces that end in ">", read and parsed in order by one task, whose memory holds a batch of
    pieces; nothing but names is kept.
    """
    pieces = whole_files(spark).read.option("lineSep", ">").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")

    def told(batches):
        path, parser, found, now, held = None, None, set(), None, ""

        def feed(text, last=False):
            nonlocal parser
            try:
                if parser is not None:
                    parser.Parse(text, last)
            except expat.ExpatError as e:
                if not o.ignore_errors:
                    raise ValueError(f"{path} is not valid XML ({e}); name its record_element") from e
                parser = None

        def ended():
            nonlocal found
            # the last piece has no ">": only white space may stand there
            feed(held if not held.strip() else held + ">")
            feed("", True)
            found |= now.found if now else set()

        for batch in batches:
            for p, values in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), itemgetter(0)):
                values = [value for _, value in values]
                if p != path:
                    ended()
                    path, parser, now = p, expat.ParserCreate(), handler()
                    parser.StartElementHandler, parser.EndElementHandler = now.start, now.end
                    values[0] = values[0].removeprefix("\ufeff").lstrip()
                else:
                    values.insert(0, held)
                held = values.pop()
                if values:
                    feed(">".join(values) + ">")
        ended()
        yield pa.RecordBatch.from_pydict({"found": sorted(found)}, pa.schema([("found", pa.string())]))

    return [r["found"] for r in pieces.mapInArrow(told, "found string").distinct().collect()]


def _only_there(spark: SparkSession, paths: list[str], o: Options) -> None:
    """Elements are read by name; those of the record's name must all stand at the end of the path asked for."""
    at = [p.split("/") for p in _parsed_files(spark, paths, o, lambda: _Places(o.path[-1]))]
    want = o.path[1:] if o.path[0] == "" else o.path
    here = [p for p in at if (p == want if o.path[0] == "" else p[-len(want) :] == want)]
    if len(here) < len(at):
        raise ValueError(f"{o.record_element}: elements of this name also stand at {sorted('/' + '/'.join(p) for p in at if p not in here)[:5]}; read them by name and filter rows")


class _Places:
    """Where in a file elements of one name stand."""

    def __init__(self, name: str):
        self.name, self.stack, self.found = name, [], set()

    def start(self, name, _):
        self.stack.append(name)
        if name == self.name:
            self.found.add("/".join(self.stack))

    def end(self, _):
        self.stack.pop()


class _Records:
    """Tags of the roots, of their children and of children of ``root_element``, each after its kind."""

    def __init__(self, root_element: str):
        self.root_element, self.depth, self.inside, self.found = root_element, 0, [], set()

    def start(self, name, _):
        if self.depth < 2:
            self.found.add(f"{'child' if self.depth else 'root'} {name}")
        if self.inside and self.inside[-1] == self.depth:
            self.found.add(f"inside {name}")
        self.depth += 1
        if self.root_element and name == self.root_element:
            self.inside.append(self.depth)

    def end(self, _):
        if self.inside and self.inside[-1] == self.depth:
            self.inside.pop()
        self.depth -= 1


def first_seen(head: str, tag: str) -> list[str]:
    """Attributes and children of the records of ``tag``, in the order in which they first come."""
    order, at = [], None
    for depth, name, attributes in _tags(head):
        if name == tag and (at is None or depth <= at):
            at = depth
            order += [a for a in attributes if a not in order]
        elif at is not None and depth == at + 1 and name not in order:
            order.append(name)
    return [n.rpartition(":")[2] for n in order if not n.startswith("xmlns")]


def _record_path(record_element: str) -> list[str]:
    """The names of a record's path, after "" if it starts at the root: what is taken are names, //name, and paths of names."""
    steps = record_element.removeprefix("//").split("/")
    if not re.fullmatch(r"(//?)?[^\s/\[\]()@*=]+(/[^\s/\[\]()@*=]+)*", record_element) or any("::" in x or x.startswith(".") for x in steps):
        raise ValueError(f"record_element takes a name, //name or a path of names, not {record_element!r}; filter rows for more")
    return steps


class Options:
    """The named parameters of the readers, checked."""

    def __init__(self, ignore_errors=False, filename=False, record_element="", root_element="", force_list=(), attr_mode="columns", attr_prefix="@", text_key="#text", namespaces="strip", max_depth=10, sample_files=8, union_by_name=False, sample_size=10240, all_varchar=False, datetime_format="auto", nullstr=(), preserve_whitespace=True, columns=None, unnest_as="columns", empty_elements="null", auto_detect=True, streaming=True, maximum_file_size=16 << 20):
        if unnest_as not in ("columns", "struct"):
            raise ValueError("unnest_as must be columns or struct")
        if columns is not None and all_varchar:
            raise ValueError("columns and all_varchar exclude each other")
        if attr_mode not in ("columns", "prefixed", "discard", "map"):
            raise ValueError("attr_mode must be columns, prefixed or discard")
        if namespaces not in ("strip", "keep", "expand"):
            raise ValueError("namespaces must be strip, keep or expand")
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})
        self.max_depth = 20 if max_depth < 0 else min(max_depth, 20)
        self.force_list = [force_list] if isinstance(force_list, str) and force_list else list(force_list or ())
        self.nullstr = [nullstr] if isinstance(nullstr, str) else list(nullstr)
        self.path = _record_path(record_element) if record_element else []
        formats = [datetime_format] if isinstance(datetime_format, str) else list(datetime_format)
        known = [DATETIME.get(f, (None, f) if re.search("[Hh]", f) else (f, None)) for f in formats if f not in ("auto", "none")]
        self.dates, self.stamps = [d for d, _ in known if d], [t for _, t in known if t]
        self.auto = "auto" in formats


OPTIONS = tuple(Options.__init__.__code__.co_varnames[1 : Options.__init__.__code__.co_argcount])
#: The child of a record in which the name of its HTML file travels.
_FILE = "file-of-record"


def _schema(columns) -> T.StructType:
    if isinstance(columns, T.StructType):
        return columns
    if isinstance(columns, dict):
        return T.StructType([T.StructField(k, T._parse_datatype_string(v) if isinstance(v, str) else v) for k, v in columns.items()])
    return T.StructType.fromDDL(columns)


#: Before attributes' names as Spark reads them: no element's name starts so.
ATTRIBUTE = "@"


def _source(spark: SparkSession, tag: str, o: Options):
    reader = spark.read.format("xml").option("rowTag", tag).option("mode", "DROPMALFORMED" if o.ignore_errors else "PERMISSIVE").option("valueTag", o.text_key).option("attributePrefix", ATTRIBUTE).option("ignoreSurroundingSpaces", "true").option("ignoreNamespace", str(o.namespaces != "keep").lower())
    if o.attr_mode == "discard":
        reader = reader.option("excludeAttribute", "true")
    if o.all_varchar:
        reader = reader.option("inferSchema", "false")
    if len(o.nullstr) == 1:
        reader = reader.option("nullValue", o.nullstr[0])
    if len(o.dates) == 1:
        reader = reader.option("dateFormat", o.dates[0])
    if len(o.stamps) == 1:
        reader = reader.option("timestampFormat", o.stamps[0])
    return reader


def _opaque(kind: T.DataType, left: int, o: Options, name: str = "", force: tuple = ()) -> T.DataType:
    """Structures below ``left`` levels as the text of their XML; forced fields as lists; attributes as text, and so are times, which are told from timestamps later."""
    if name.startswith(ATTRIBUTE):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_opaque(kind.elementType, left, o))
    if isinstance(kind, T.StructType):
        kind = T.StringType() if left <= 0 else T.StructType([T.StructField(f.name, _opaque(f.dataType, left - 1, o, f.name, force)) for f in kind.fields])
    elif isinstance(kind, T.TimestampType) and not o.stamps:
        kind = T.StringType()
    return T.ArrayType(kind) if name in force else kind


def _leaves(kind: T.DataType, steps: tuple = ()):
    """Field names (None within a list) and type of each value below ``kind`` but attributes."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if not f.name.startswith(ATTRIBUTE):
                yield from _leaves(f.dataType, (*steps, f.name))
    elif isinstance(kind, T.ArrayType):
        yield from _leaves(kind.elementType, (*steps, None))
    else:
        yield steps, kind


def _every(c: Column, steps: tuple, test) -> Column:
    """Whether all values at ``steps`` below ``c`` pass ``test``; missing ones do."""
    if not steps:
        return F.coalesce(test(c), F.lit(True))
    if steps[0] is None:
        return F.coalesce(F.forall(c, lambda x: _every(x, steps[1:], test)), F.lit(True))
    return _every(c.getField(steps[0]), steps[1:], test)


def _parsed(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def _narrowed(df: DataFrame, schema: T.StructType, o: Options) -> dict[tuple, str]:
    """One pass over the values tells which long ones fit an int, and which texts are all yes or no, timestamps, or dates and times of several formats."""
    tests = []
    filled = lambda c: F.nullif(c, F.lit(""))
    for steps, kind in _leaves(schema):
        if isinstance(kind, T.LongType):
            tests.append((steps, "int", lambda c: c.between(-(1 << 31), (1 << 31) - 1)))
        if isinstance(kind, T.StringType):
            tests.append((steps, "boolean", lambda c: F.lower(c).isin("true", "false", "yes", "no", "on", "off")))
            if len(o.dates) > 1:
                tests.append((steps, "date", lambda c: _parsed(filled(c), o.dates).isNotNull() | filled(c).isNull()))
            if len(o.stamps) > 1:
                tests.append((steps, "stamp", lambda c: _parsed(filled(c), o.stamps).isNotNull() | filled(c).isNull()))
            if o.auto and not o.stamps:
                tests.append((steps, "timestamp", lambda c: c.try_cast("timestamp").isNotNull() & c.rlike("[0-9]{4}-[0-9]")))
    if not tests:
        return {}
    seen = lambda steps: F.count(F.when(~_every(F.col(f"`{steps[0]}`"), steps[1:], lambda c: filled(c.cast("string")).isNull()), 1)) > 0
    row = df.agg(*((F.bool_and(_every(F.col(f"`{s[0]}`"), s[1:], test)) & seen(s)).alias(f"t{k}") for k, (s, _, test) in enumerate(tests))).first()
    return {s: kind for k, (s, kind, _) in reversed(list(enumerate(tests))) if row[f"t{k}"]}


def _shaped(c: Column, kind: T.DataType, steps: tuple, o: Options, narrow: dict[tuple, str]) -> Column:
    """The value with its own names and types, all the way down."""
    if isinstance(kind, T.StructType):
        names = {}
        for f in kind.fields:  # an attribute and a child of one name: the first wins
            names.setdefault(_renamed(f.name, o).lower(), f)
        return F.when(c.isNotNull(), F.struct(*(_shaped(c.getField(f.name), f.dataType, (*steps, f.name), o, narrow).alias(_renamed(f.name, o)) for f in names.values())))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _shaped(x, kind.elementType, (*steps, None), o, narrow))
    to = narrow.get(steps)
    if to == "boolean":
        return F.lower(c).isin("true", "yes", "on")
    if to in ("date", "stamp"):
        return _parsed(F.nullif(c, F.lit("")), o.dates if to == "date" else o.stamps).cast("date" if to == "date" else "timestamp")
    return c.cast(to) if to else c


def _renamed(name: str, o: Options) -> str:
    return (o.attr_prefix if o.attr_mode == "prefixed" else "") + name[1:] if name.startswith(ATTRIBUTE) else name


def _records(spark: SparkSession, paths: list[str], tag: str, head: str, o: Options) -> DataFrame:
    more = ["_metadata"] if o.filename else []
    if o.columns is not None:  # a column is a child, or else an attribute; nothing has to be inferred
        wanted = _schema(o.columns)
        either = [T.StructField(x, f.dataType) for f in wanted.fields for x in (f.name, f"{ATTRIBUTE}{f.name}")]
        df = _source(spark, tag, o).schema(T.StructType(either)).load(paths)
        return df.select(*more, *(F.coalesce(f"`{f.name}`", f"`{ATTRIBUTE}{f.name}`").alias(f.name) for f in wanted.fields))
    inferred = _source(spark, tag, o).load(paths).schema
    fields = [T.StructField(f.name, _opaque(f.dataType, o.max_depth - 2, o, f.name, tuple(o.force_list))) for f in inferred.fields]
    df = _source(spark, tag, o).schema(T.StructType(fields)).load(paths)
    narrow = _narrowed(df, T.StructType([f for f in fields if f.name != "_corrupt_record"]), o) if not o.all_varchar else {}
    order = {n: k for k, n in enumerate(first_seen(head, tag))}
    rank = lambda f: order.get(f.name.removeprefix(ATTRIBUTE), len(order))
    chosen, seen = [], set()
    for f in sorted(fields, key=rank):
        out = _renamed(f.name, o)
        if out.lower() in seen:  # an attribute and a child of one name: the first wins
            continue
        seen.add(out.lower())
        c = _shaped(F.col(f"`{f.name}`"), f.dataType, (f.name,), o, narrow)
        if isinstance(f.dataType, T.StringType) and (f.name,) not in narrow:
            c = F.when(~c.isin(*o.nullstr, ""), c)
            if not o.preserve_whitespace:
                c = F.regexp_replace(F.trim(c), r"\s+", " ")
        elif o.nullstr and not isinstance(f.dataType, (T.StructType, T.ArrayType)):
            c = F.when(~F.col(f"`{f.name}`").cast("string").isin(*o.nullstr), c)
        chosen.append(c.alias(out))
    return df.select(*more, *chosen)


def read_xml(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Records of XML files as typed rows; see ``Options`` for the parameters.

    Without ``record_element`` the records are the root's children; children of several tags give the
    union of their columns, which takes a pass over all files to find the tags. ``streaming``, ``sample_files``, ``sample_size`` and ``union_by_name`` are
    accepted: Spark always reads record by record and infers over all files.
    """
    o, paths = Options(**options), _paths(paths)
    head = _head(spark, paths[0])
    tags = o.path[-1:] or all_tags(spark, paths, head, o)
    if len(o.path) > 1:
        _only_there(spark, paths, o)
    if not tags:
        raise ValueError(f"no element found in {paths[0]}")
    df = _records(spark, paths, tags[0], head, o)
    for tag in tags[1:]:
        df = df.unionByName(_records(spark, paths, tag, head, o), allowMissingColumns=True)
    if o.filename:
        df = df.select(F.col("_metadata.file_path").alias("filename"), *(F.col(f"`{c}`") for c in df.columns if c != "_metadata"))
    return df


def _stashed(df: DataFrame) -> str:
    """Strings as text files in the shared folder, for a source that reads files."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def html_records(column: Column, record_element: str, ignore_errors: bool = False) -> Column:
    """The records of an HTML document as well-formed XML on one line each.

    Records that are no XML even so (deeper than 256 levels) are an error, or left out with ``ignore_errors``.
    """
    path = record_element if record_element.startswith("/") else f"//{record_element}" if record_element else "/html/*"

    def cut(text: str | None) -> list[str]:
        out = []
        for n in select(_rows._html(text), path):
            try:
                x = serialize(n).replace("\r", "").replace("\n", "&#10;")
            except RecursionError:
                x = ""
            if _rows.valid(x):
                out.append(x)
            elif not ignore_errors:
                raise ValueError("an HTML record cannot be written as XML")
        return out

    forms, kind = M._arrow(cut, "array<string>")
    forms[1].__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(forms[1], kind)(column)


def read_html(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Records of HTML files as typed rows; without ``record_element``, head and body."""
    o = Options(**options)
    return _html_rows(read_html_objects(spark, paths, filename=o.filename), o)


def _html_rows(pages: DataFrame, o: Options) -> DataFrame:
    spark = pages.sparkSession
    records = pages.select(*(c for c in pages.columns if c != "html"), F.explode(html_records(F.col("html"), o.record_element, o.ignore_errors)).alias("value"))
    if o.filename:
        # the file's name goes along as one more child of each record
        ends = F.regexp_extract("value", "</[^<>]*>$", 0)
        begins = F.when(ends == "", F.regexp_replace("value", "/>$", ">")).otherwise(F.expr("left(value, length(value) - length(regexp_extract(value, '</[^<>]*>$', 0)))"))
        ends = F.when(ends == "", F.concat(F.lit("</"), F.regexp_extract("value", r"^<([^\s/>]+)", 1), F.lit(">"))).otherwise(ends)
        records = records.select(F.concat(begins, F.lit(f"<{_FILE}>"), M.html_escape(F.col("filename")), F.lit(f"</{_FILE}>"), ends).alias("value"))

    def rooted(batches):
        """The records of a partition between one root's tags, since a file is one document."""
        yield pa.RecordBatch.from_pydict({"value": ["<records>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</records>"]})

    path = _stashed(records.mapInArrow(rooted, "value string"))
    tags = [re.split("[/]", o.record_element)[-1]] if o.record_element else ["head", "body"]
    plain = Options(**{k: o.__dict__[k] for k in OPTIONS} | {"filename": False, "columns": o.columns and T.StructType([*_schema(o.columns).fields, *([T.StructField(_FILE, T.StringType())] if o.filename else [])])})
    head, out = _head(spark, path), None
    for tag in tags:
        df = _records(spark, [path], tag, head, plain)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(F.col(_FILE).alias("filename"), *(F.col(f"`{c}`") for c in out.columns if c != _FILE)) if o.filename else out


def parse_xml(spark: SparkSession, text: str, **options) -> DataFrame:
    """``read_xml`` over a string."""
    line = text.replace("\r\n", "\n")
    return read_xml(spark, _stashed(spark.createDataFrame([(line,)], "value string")), **options)


def parse_html(spark: SparkSession, text: str, **options) -> DataFrame:
    """``read_html`` over a string."""
    return _html_rows(parse_html_objects(spark, text), Options(**options))


#: A file as a table; what else has quotes or is a comment is passed over.
_FROM = re.compile(r"\b(from|join)\s+'([^']+\.(?:xml|html?))'|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.I | re.S)


def sql(spark: SparkSession, query: str) -> DataFrame:
    """``spark.sql`` in which files may stand as tables: ``SELECT * FROM 'books.xml'``."""

    def view(m: re.Match) -> str:
        path = m[2]
        if not path:
            return m[0]
        name = f"file_{uuid.uuid4().hex}"
        (read_xml if path.endswith(".xml") else read_html)(spark, path).createOrReplaceTempView(name)
        alias = "" if re.search(r"[*?\[{]", path) else f" AS `{path.rpartition('/')[2].rpartition('.')[0]}`"
        return f"{m[1]} {name}{alias}"

    return spark.sql(_FROM.sub(view, query))


def write_xml(df: DataFrame, path: str, root: str = "rows", record: str = "row") -> None:
    """Rows as XML files by Spark's sink."""
    df.write.format("xml").option("rootTag", root).option("rowTag", record).save(path)
