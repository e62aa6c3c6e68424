"""Every markup operation as a Column function, and in SQL after ``register(spark)``.

Operations that Spark's own expressions can say exactly are Catalyst expressions. The others are
Arrow-batched functions over one document at a time. Several of these on one column parse it
together: see ``markup_multi``. NULL handling is given by each function: mostly NULL gives NULL, the
list extractors give an empty list.
"""

from __future__ import annotations

from collections.abc import Callable
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import _rows

_COMMENT = "array<struct<content string, line_number bigint>>"
LINK = "array<struct<text string, href string, title string, line_number bigint>>"
IMAGE = "array<struct<alt string, src string, title string, width bigint, height bigint, line_number bigint>>"
CELL = "array<struct<table_index bigint, row_type string, row_index bigint, column_index bigint, cell_value string, line_number bigint, num_columns bigint, num_rows bigint>>"
TABLE = "array<struct<table_index bigint, line_number bigint, num_columns bigint, num_rows bigint, headers array<string>, table_data array<array<string>>, table_json string, json_structure string>>"
ATTRIBUTE = "array<struct<element_name string, element_path string, attribute_name string, attribute_value string, line_number bigint>>"
STATS = "struct<element_count bigint, attribute_count bigint, max_depth bigint, size_bytes bigint, namespace_count bigint>"
BLOCK = "array<struct<kind string, element_type string, content string, level int, encoding string, attributes map<string,string>, element_order int>>"

#: SQL name: what computes one row, and its Spark type. Arguments beyond those given in SQL keep their defaults.
ROWWISE: dict[str, tuple[Callable, str]] = {
    "xml_valid": (_rows.valid, "boolean"),
    "xml_well_formed": (_rows.valid, "boolean"),
    "xml_extract_text": (_rows.extract_text, "array<string>"),
    "xml_extract_all_text": (_rows.extract_all_text, "string"),
    "xml_extract_elements": (_rows.extract_elements, "array<string>"),
    "xml_extract_attributes": (_rows.extract_attributes, ATTRIBUTE),
    "xml_extract_comments": (lambda t: _rows._of_kind(t, "comment"), _COMMENT),
    "xml_extract_cdata": (lambda t: _rows._of_kind(t, "cdata"), _COMMENT),
    "xml_stats": (_rows.stats, STATS),
    "xml_namespaces": (_rows.namespaces, "map<string,string>"),
    "xml_find_undefined_prefixes": (_rows.find_undefined_prefixes, "array<string>"),
    "xml_add_namespace_declarations": (_rows.add_namespace_declarations, "string"),
    "xml_pretty_print": (_rows.pretty_print, "string"),
    "xml_minify": (_rows.minify, "string"),
    "xml_to_json": (_rows.to_json, "string"),
    "json_to_xml": (_rows.from_json, "string"),
    "parse_html": (_rows.clean_html, "string"),
    "html_text": (_rows.html_text, "string"),
    "html_texts": (lambda t, p: [] if t is None or p is None else _rows.html_text(t, p), "array<string>"),
    "html_extract_links": (_rows.links, LINK),
    "html_extract_images": (_rows.images, IMAGE),
    "html_extract_table_rows": (_rows.table_rows, CELL),
    "html_extract_tables_json": (_rows.tables_json, TABLE),
    "html_unescape": (_rows.unescape, "string"),
    "html_to_blocks": (_rows.to_blocks, BLOCK),
    "blocks_to_html": (_rows.from_blocks, "string"),
}


def _plain(value, kind: T.DataType):
    """Rows of dictionaries for Arrow, whose maps are lists of pairs."""
    return list(value.items()) if isinstance(kind, T.MapType) and isinstance(value, dict) else value


def _arrow(fn: Callable, kind: str, **fixed):
    spark_type = T._parse_datatype_string(kind) if SparkSession.getActiveSession() else None
    arrow_type = to_arrow_type(spark_type)

    def batch(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([_plain(fn(*(dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v for v in row), **fixed), spark_type) for row in rows], arrow_type)

    # the number of arguments decides which of the evaluator's forms fits
    forms = {1: lambda a: batch(a), 2: lambda a, b: batch(a, b), 3: lambda a, b, c: batch(a, b, c)}
    return forms, kind


def _call(name: str, *columns: Column | str, **fixed) -> Column:
    fn, kind = ROWWISE[name]
    forms, kind = _arrow(fn, kind, **fixed)
    form = forms[len(columns)]
    form.__annotations__ = {k: pa.Array for k in "abc"[: len(columns)]} | {"return": pa.Array}
    return F.arrow_udf(form, kind)(*columns)


def _one(name: str) -> Callable[..., Column]:
    def function(column: Column | str, **options) -> Column:
        return _call(name, column, **options)

    function.__name__, function.__doc__ = name, (ROWWISE[name][0].__doc__ or f"``{name}`` of a document column.")
    return function


xml_valid, xml_well_formed, xml_extract_all_text = _one("xml_valid"), _one("xml_well_formed"), _one("xml_extract_all_text")
xml_extract_comments, xml_extract_cdata, xml_stats, xml_namespaces = _one("xml_extract_comments"), _one("xml_extract_cdata"), _one("xml_stats"), _one("xml_namespaces")
xml_pretty_print, xml_minify, json_to_xml, parse_html = _one("xml_pretty_print"), _one("xml_minify"), _one("json_to_xml"), _one("parse_html")
html_extract_links, html_extract_images, html_extract_table_rows = _one("html_extract_links"), _one("html_extract_images"), _one("html_extract_table_rows")
html_extract_tables_json, html_unescape, html_to_blocks, blocks_to_html = _one("html_extract_tables_json"), _one("html_unescape"), _one("html_to_blocks"), _one("blocks_to_html")
html_to_duck_blocks, duck_blocks_to_html = html_to_blocks, blocks_to_html


def xml_extract_text(column, path: str | Column, namespaces: str | dict | None = None) -> Column:
    """String values of the selected nodes; an empty list for NULL, malformed documents and bad paths."""
    return _call("xml_extract_text", column, _lit(path), mode=_mode(namespaces))


def xml_extract_elements(column, path: str | Column, namespaces: str | dict | None = None) -> Column:
    return _call("xml_extract_elements", column, _lit(path), mode=_mode(namespaces))


def xml_extract_elements_string(column, path: str | Column, namespaces: str | dict | None = None) -> Column:
    """The elements one per line, each line ended; NULL for NULL."""
    found = xml_extract_elements(column, path, namespaces)
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isNotNull(), F.concat_ws("", F.transform(found, lambda x: F.concat(x, F.lit("\n")))))


def xml_extract_attributes(column, path: str | Column, namespaces: str | dict | None = None) -> Column:
    return _call("xml_extract_attributes", column, _lit(path), mode=_mode(namespaces))


def html_extract_text(column, path: str | None = None) -> Column:
    """All text as one string; with a path, the string values of the selected nodes."""
    return _call("html_text", column) if path is None else _call("html_texts", column, _lit(path))


def _lit(value):
    return F.lit(value) if isinstance(value, str) or value is None else value


def _mode(namespaces):
    if isinstance(namespaces, str) and namespaces.lower() not in ("strict", "ignore", "auto"):
        raise ValueError(f"namespaces must be 'strict', 'ignore', 'auto' or a map, not {namespaces!r}")
    return namespaces


def xml_find_undefined_prefixes(column, path: str | Column) -> Column:
    return _call("xml_find_undefined_prefixes", column, _lit(path))


def xml_add_namespace_declarations(column, names: dict[str, str]) -> Column:
    return _call("xml_add_namespace_declarations", column, names=dict(names or {}))


def xml_to_json(column, force_list: list[str] | str = (), attr_prefix: str = "@", text_key: str = "#text", namespaces: str = "strip", xmlns_key: str = "", empty_elements: str = "object") -> Column:
    if namespaces not in ("strip", "expand", "keep"):
        raise ValueError("namespaces must be strip, expand or keep")
    if empty_elements not in ("object", "null", "string"):
        raise ValueError("empty_elements must be object, null or string")
    force = [force_list] if isinstance(force_list, str) else list(force_list)
    return _call("xml_to_json", column, force_list=force, attr_prefix=attr_prefix, text_key=text_key, namespaces=namespaces, xmlns_key=xmlns_key, empty_elements=empty_elements)


def markup_multi(column, **operations: tuple) -> Column:
    """A struct of several results from one parse of each document: ``name=("xml_extract_text", "//a")`` and so on."""
    kinds = {k: T._parse_datatype_string(ROWWISE[op[0]][1]) for k, op in operations.items()}
    kind = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    arrow_type = to_arrow_type(kind)

    def batch(a: pa.Array) -> pa.Array:
        return pa.array([{k: _plain(ROWWISE[op[0]][0](x, *op[1:]), kinds[k]) for k, op in operations.items()} for x in a.to_pylist()], arrow_type)

    batch.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, kind)(column)


# Catalyst expressions


def html_escape(column) -> Column:
    out = F.col(column) if isinstance(column, str) else column
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_common_namespaces() -> Column:
    return F.create_map(*(F.lit(x) for pair in _rows.NAMESPACES.items() for x in pair))


def xml_lookup_namespace(prefix) -> Column:
    return F.try_element_at(xml_common_namespaces(), F.lower(prefix))


def xml_detect_prefixes(path) -> Column:
    bare = F.regexp_replace(path, "\"[^\"]*\"|'[^']*'", "")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(_rows.PREFIX), F.lit(1))))
    return F.array_except(found, F.array(*map(F.lit, sorted(_rows.AXES))))


def xml_mock_namespaces(prefixes) -> Column:
    keys = F.array_distinct(F.array_compact(F.coalesce(prefixes, F.expr("cast(array() as array<string>)"))))
    return F.map_from_arrays(keys, F.transform(keys, lambda p: F.concat(F.lit("urn:mock:"), p)))


def xml_wrap_fragment(fragment, wrapper) -> Column:
    name = F.col(wrapper) if isinstance(wrapper, str) else wrapper
    body = F.concat(F.lit("<"), name, F.lit(">"), fragment, F.lit("</"), name, F.lit(">"))
    bad = F.raise_error(F.concat(F.lit("not a valid element name: "), name)).cast("string")
    return F.when(name.isNull(), None).when(name.rlike(r"^[\p{L}_][\p{L}\p{N}_.\-]*(:[\p{L}_][\p{L}\p{N}_.\-]*)?$"), body).otherwise(bad)


def to_xml(column, kind: T.DataType, name: str = "xml", json: bool = False, markup: bool = False) -> Column:
    """A value of Spark type ``kind`` as an XML document, by Catalyst expressions over its structure.

    NULL gives NULL; NULL fields give empty elements; lists are wrapped in ``<name>_list``. ``markup``
    says that a string is XML already, ``json`` that it is JSON.
    """
    if not _rows._NAME.fullmatch(name):
        raise ValueError(f"not a valid element name: {name!r}")
    value = F.col(column) if isinstance(column, str) else column
    if markup:
        return value
    if json:
        return json_to_xml(value)

    def element(v: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.ArrayType):
            inner, name = F.array_join(F.transform(v, lambda x: element(x, kind.elementType, name)), ""), f"{name}_list"
        elif isinstance(kind, T.StructType):
            inner = F.concat(*(element(v[f.name], f.dataType, f.name) for f in kind.fields)) if kind.fields else F.lit("")
        elif isinstance(kind, T.MapType):
            inner = F.array_join(F.transform(F.map_entries(v), lambda e: F.concat(F.lit("<"), e["key"].cast("string"), F.lit(">"), html_escape(e["value"].cast("string")), F.lit("</"), e["key"].cast("string"), F.lit(">"))), "")
        else:
            text = v.cast("string")
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
                text = F.replace(text, F.lit(a), F.lit(b))
            inner = text
        return F.when(v.isNull() | (inner == ""), F.lit(f"<{name}/>")).otherwise(F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>")))

    return F.when(value.isNotNull(), F.concat(F.lit(_rows.DECLARATION), element(value, kind, name)))


xml = to_xml


def xml_validate_schema(column, xsd: str) -> Column:
    """Whether a document is valid by the XSD text ``xsd``; bad schemas and documents, and schemas that import others, give false."""
    import os
    import re
    import tempfile

    value = F.col(column) if isinstance(column, str) else column
    if re.search(r"<(?:\w+:)?(?:import|include|redefine)\b|<!(?:DOCTYPE|ENTITY)", xsd) or not _rows.valid(xsd):
        return F.when(value.isNotNull(), F.lit(False))
    spark = SparkSession.getActiveSession()
    path = os.path.join(tempfile.mkdtemp(), f"schema{abs(hash(xsd))}.xsd")
    with open(path, "w", encoding="utf-8") as f:
        f.write(xsd)
    spark.sparkContext.addFile(path)
    parsed = F.from_xml(value, "_corrupt_record string", {"rowValidationXSDPath": os.path.basename(path), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.when(value.isNotNull(), parsed["_corrupt_record"].isNull())


def xml_libxml2_version(column) -> Column:
    """Text with the version of the parser that is really used here, expat."""
    return F.concat(F.lit("Markup "), column, F.lit(f", {expat.EXPAT_VERSION}"))


def xml_oom_selftest() -> Column:
    return F.lit("OK (skipped: no native allocator to test)")


def _json_with(text: str | None, options: dict[str, str] | None) -> str | None:
    """``xml_to_json`` with its options in a map; force_list as names between commas."""
    options = dict(options or {})
    force = [x.strip() for x in options.pop("force_list", "").split(",") if x.strip()]
    unknown = set(options) - {"attr_prefix", "text_key", "namespaces", "xmlns_key", "empty_elements"}
    if unknown:
        raise ValueError(f"xml_to_json has no options {sorted(unknown)}")
    return _rows.to_json(text, force_list=force, **options)


def register(spark: SparkSession) -> SparkSession:
    """The functions for SQL. Extractors take (document, path), and (document, path, namespace mode) under the names with ``_ns``.

    ``html_text`` is ``html_extract_text`` of one argument; ``xml_to_json_with`` takes options as a map. ``to_xml`` and ``xml_validate_schema``
    need a type or schema when a query is made, and are Column functions only.
    """
    three = {"xml_extract_text", "xml_extract_elements", "xml_extract_attributes"}
    for name in ROWWISE:
        if name in ("html_text", "html_texts"):
            continue
        fn, kind = ROWWISE[name]
        two = name in three or name in ("xml_find_undefined_prefixes", "xml_add_namespace_declarations")
        spark.udf.register(name, _sql(fn, kind, 2 if two else 1))
        if name in three:
            spark.udf.register(f"{name}_ns", _sql(fn, kind, 3))
    spark.udf.register("html_text", _sql(*ROWWISE["html_text"], 1))
    spark.udf.register("html_extract_text", _sql(*ROWWISE["html_texts"], 2))
    spark.udf.register("html_to_duck_blocks", _sql(*ROWWISE["html_to_blocks"], 1))
    spark.udf.register("duck_blocks_to_html", _sql(*ROWWISE["blocks_to_html"], 1))
    native = {
        "html_escape": "(s STRING) RETURNS STRING RETURN replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\r', '&#13;')",
        "xml_wrap_fragment": r"(f STRING, w STRING) RETURNS STRING RETURN CASE WHEN w IS NULL THEN NULL WHEN w RLIKE '^[\\p{L}_][\\p{L}\\p{N}_.-]*(:[\\p{L}_][\\p{L}\\p{N}_.-]*)?$' THEN concat('<', w, '>', f, '</', w, '>') ELSE raise_error(concat('not a valid element name: ', w)) END",
        "xml_mock_namespaces": "(p ARRAY<STRING>) RETURNS MAP<STRING,STRING> RETURN map_from_arrays(array_distinct(array_compact(coalesce(p, cast(array() as array<string>)))), transform(array_distinct(array_compact(coalesce(p, cast(array() as array<string>)))), x -> concat('urn:mock:', x)))",
        "xml_common_namespaces": "() RETURNS MAP<STRING,STRING> RETURN map(" + ", ".join(f"'{x}'" for pair in _rows.NAMESPACES.items() for x in pair) + ")",
    }
    known = ", ".join(f"'{x}'" for pair in _rows.NAMESPACES.items() for x in pair)
    axes = ", ".join(f"'{x}'" for x in sorted(_rows.AXES))
    prefix = _rows.PREFIX.replace("\\", "\\\\").replace("'", "\\'")
    native |= {
        "xml_lookup_namespace": f"(p STRING) RETURNS STRING RETURN try_element_at(map({known}), lower(p))",
        "xml_detect_prefixes": f"(p STRING) RETURNS ARRAY<STRING> RETURN array_except(array_sort(array_distinct(regexp_extract_all(regexp_replace(p, '\"[^\"]*\"|\\'[^\\']*\\'', ''), '{prefix}', 1))), array({axes}))",
        "xml_libxml2_version": f"(p STRING) RETURNS STRING RETURN concat('Markup ', p, ', {expat.EXPAT_VERSION}')",
        "xml_oom_selftest": "() RETURNS STRING RETURN 'OK (skipped: no native allocator to test)'",
    }
    spark.udf.register("xml_extract_elements_string", _sql(lambda t, p: None if t is None else "".join(f"{x}\n" for x in _rows.extract_elements(t, p)), "string", 2))
    spark.udf.register("xml_to_json_with", _sql(_json_with, "string", 2))
    for name, body in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    from ..operators.tables import HTML_TABLES_TYPE, HtmlTables

    spark.udtf.register("html_extract_tables", F.udtf(HtmlTables, returnType=HTML_TABLES_TYPE))
    return spark


def _sql(fn: Callable, kind: str, arguments: int):
    forms, kind = _arrow(fn, kind)
    form = forms[arguments]
    form.__annotations__ = {k: pa.Array for k in "abc"[:arguments]} | {"return": pa.Array}
    return F.arrow_udf(form, kind)
