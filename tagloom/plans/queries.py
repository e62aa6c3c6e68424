"""Registered queries over the given tables, each with the SQL whose rows it must equal where SQL can say it.

Markup is made from columns (or read from ``pages``), taken apart by the library, and compared with
the columns it came from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as M
from ..operators.tables import exploded, extract_tables
from ..session import dealt, shared_folder
from ..sources import readers
from ..streaming.files import stream_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are documents to take apart."""
    return dealt(_t(spark, sf_dir, name))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _s(*parts) -> F.Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def order_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML document per order."""
    c = F.col
    doc = _s('<order id="', c("o_orderkey"), '" customer="', c("o_custkey"), '"><status>', c("o_orderstatus"), "</status><priority>", c("o_orderpriority"), "</priority><!--note ", c("o_orderkey"), "--><raw><![CDATA[<", c("o_orderstatus"), ">]]></raw></order>")
    return _docs(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", doc.alias("doc"))


LINKS = """SELECT page_id, replace(replace(replace(replace(m[1], '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS href, replace(replace(replace(replace(m[2], '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"') AS text
FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), lambda x: [regexp_extract(x, 'href="([^"]*)"', 1), regexp_extract(x, '>([^<]*)<', 1)])) AS m FROM pages)"""


@query(LINKS)
def html_extract_links(spark, sf_dir):
    return exploded(_docs(spark, sf_dir, "pages"), M.html_extract_links("html"), "page_id").select("page_id", "href", "text")


@query(f"SELECT split_part(href, '/', 2) AS word, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM ({LINKS}) GROUP BY 1")
def links_by_target(spark, sf_dir):
    """Links, grouped: an aggregation over an extractor."""
    return html_extract_links(spark, sf_dir).groupBy(F.split_part("href", F.lit("/"), F.lit(2)).alias("word")).agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


_PLAIN = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query("SELECT page_id, " + _PLAIN.format("regexp_extract(html, '<title>(.*?)</title>', 1)") + " AS title, " + _PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)") + " AS heading FROM pages")
def html_extract_text_path(spark, sf_dir):
    both = M.markup_multi("html", title=("html_texts", "//title"), heading=("html_texts", "//h1"))
    return _docs(spark, sf_dir, "pages").select("page_id", both.alias("x")).select("page_id", F.get("x.title", F.lit(0)).alias("title"), F.get("x.heading", F.lit(0)).alias("heading"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages")
def html_list_items(spark, sf_dir):
    return _docs(spark, sf_dir, "pages").select("page_id", F.size(M.html_extract_text("html", "//ul/li")).cast("long").alias("n_items"))


@query("SELECT p_partkey, p_name AS alt, concat('/img/', p_partkey, '.png') AS src, CAST(p_size AS BIGINT) AS width, CAST(0 AS BIGINT) AS height FROM part")
def html_extract_images(spark, sf_dir):
    html = _s("<p><img alt=\"", F.col("p_name"), "\" src=\"/img/", F.col("p_partkey"), ".png\" width=\"", F.col("p_size"), "\">x")
    return exploded(_docs(spark, sf_dir, "part").select("p_partkey", html.alias("html")), M.html_extract_images("html"), "p_partkey").select("p_partkey", "alt", "src", "width", "height")


def customer_tables(spark, sf_dir) -> DataFrame:
    """One HTML table, with a header, for the customers whose numbers are the same but for the last digit."""
    row = _s("<tr><td>", F.col("c_custkey"), "<td>", F.col("c_name"))
    body = F.concat_ws("", F.array_sort(F.collect_list(row)))
    return _t(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 10").alias("block")).agg(_s("<table><tr><th>key</th><th>name</th></tr>", body, "</table>").alias("html"))


_IN_ORDER = "row_number() OVER (PARTITION BY c_custkey // 10 ORDER BY CAST(c_custkey AS VARCHAR) || '<')"
_TABLE_ROWS = f"SELECT CAST(c_custkey // 10 AS BIGINT) AS block, CAST(0 AS BIGINT) AS table_index, {_IN_ORDER} AS row_index, CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer UNION ALL SELECT DISTINCT CAST(c_custkey // 10 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'key', 'name' FROM customer"


@query(_TABLE_ROWS)
def html_extract_tables(spark, sf_dir):
    return extract_tables(customer_tables(spark, sf_dir), "html", "block").select("block", "table_index", "row_index", F.get("columns", F.lit(0)).alias("key"), F.get("columns", F.lit(1)).alias("name"))


@query(_TABLE_ROWS)
def html_extract_tables_lateral(spark, sf_dir):
    M.register(spark)
    customer_tables(spark, sf_dir).createOrReplaceTempView("customer_tables")
    return spark.sql("SELECT block, table_index, row_index, get(columns, 0) AS key, get(columns, 1) AS name FROM customer_tables, LATERAL html_extract_tables(html)")


@query(f"SELECT CAST(c_custkey // 10 AS BIGINT) AS block, 'data' AS row_type, {_IN_ORDER} AS row_index, CAST(1 AS BIGINT) AS column_index, c_name AS cell_value, CAST(2 AS BIGINT) AS num_columns, count(*) OVER (PARTITION BY c_custkey // 10) AS num_rows FROM customer")
def html_extract_table_rows(spark, sf_dir):
    cells = exploded(customer_tables(spark, sf_dir), M.html_extract_table_rows("html"), "block")
    return cells.where("row_type = 'data' and column_index = 1").select("block", "row_type", "row_index", "column_index", "cell_value", "num_columns", "num_rows")


@query("SELECT CAST(c_custkey // 10 AS BIGINT) AS block, CAST(2 AS BIGINT) AS num_columns, count(*) AS num_rows, 'key,name' AS headers FROM customer GROUP BY 1")
def html_extract_tables_json(spark, sf_dir):
    return exploded(customer_tables(spark, sf_dir), M.html_extract_tables_json("html"), "block").select("block", "num_columns", "num_rows", F.array_join("headers", ",").alias("headers"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(13), '&#13;')) AS digest FROM pages""")
def html_escape(spark, sf_dir):
    return _docs(spark, sf_dir, "pages").select("page_id", F.md5(M.html_escape("html")).alias("digest"))


@query("SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE text IS NOT NULL AND position(chr(13) IN text) = 0")
def html_unescape(spark, sf_dir):
    """Escaping and unescaping give the text back."""
    t = _docs(spark, sf_dir, "conversations").where(F.col("text").isNotNull() & ~F.contains("text", F.lit("\r")))
    return t.select("conv_id", "turn", F.md5(M.html_unescape(M.html_escape("text"))).alias("digest"))


@query("SELECT p_partkey, concat('<html><body><p>', p_name, ' <b>', p_brand, '</b></p><br/></body></html>') AS html FROM part")
def parse_html(spark, sf_dir):
    html = _s("<!DOCTYPE html><p>", F.col("p_name"), "   \n <b>", F.col("p_brand"), "</b></p><br>")
    return _docs(spark, sf_dir, "part").select("p_partkey", M.parse_html(html).alias("html"))


@query("SELECT page_id, html IS NOT NULL AS valid, CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_items FROM pages")
def html_clean_pages(spark, sf_dir):
    """Every page made well formed: what comes out is valid XML, and no element is lost."""
    clean = _docs(spark, sf_dir, "pages").select("page_id", M.parse_html("html").alias("clean"))
    count = lambda tag: F.size(F.regexp_extract_all("clean", F.lit(tag), F.lit(0))).cast("long")
    return clean.select("page_id", M.xml_valid("clean").alias("valid"), count("<a ").alias("n_links"), count("<li[ >]").alias("n_items"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def xml_extract_text(spark, sf_dir):
    x = M.markup_multi("doc", status=("xml_extract_text", "/order/status"), priority=("xml_extract_text", "//priority[../@id]"))
    return order_xml(spark, sf_dir).select("o_orderkey", x.alias("x")).select("o_orderkey", F.get("x.status", F.lit(0)).alias("status"), F.get("x.priority", F.lit(0)).alias("priority"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey AS customer FROM orders")
def xml_spark_xpath(spark, sf_dir):
    """The same through Spark's own XPath, where its semantics are equal (text() and attributes of valid documents)."""
    both = F.xpath("doc", F.lit("/order/@customer | /order/status/text()"))  # in document order; one parse for both
    t = order_xml(spark, sf_dir).select("o_orderkey", both.alias("x"))
    return t.select("o_orderkey", F.when(F.col("x").isNotNull(), F.coalesce(F.get("x", F.lit(1)), F.lit(""))).alias("status"), F.get("x", F.lit(0)).cast("long").alias("customer"))


@query("SELECT o_orderkey, concat('<status>', o_orderstatus, '</status>') AS element, concat('<status>', o_orderstatus, '</status>', chr(10), '<priority>', o_orderpriority, '</priority>', chr(10)) AS both FROM orders")
def xml_extract_elements(spark, sf_dir):
    x = M.markup_multi("doc", element=("xml_extract_elements", "//status"), both=("xml_extract_elements", "//status | //priority"))
    both = F.concat_ws("", F.transform("x.both", lambda e: F.concat(e, F.lit("\n"))))
    return order_xml(spark, sf_dir).select("o_orderkey", "doc", x.alias("x")).select("o_orderkey", F.get("x.element", F.lit(0)).alias("element"), F.when(F.col("doc").isNotNull(), both).alias("both"))


@query("SELECT o_orderkey, '/order' AS element_path, 'id' AS attribute_name, CAST(o_orderkey AS VARCHAR) AS attribute_value FROM orders UNION ALL SELECT o_orderkey, '/order', 'customer', CAST(o_custkey AS VARCHAR) FROM orders")
def xml_extract_attributes(spark, sf_dir):
    return exploded(order_xml(spark, sf_dir), M.xml_extract_attributes("doc", "//*"), "o_orderkey").select("o_orderkey", "element_path", "attribute_name", "attribute_value")


@query("SELECT o_orderkey, concat(o_orderstatus, o_orderpriority, '<', o_orderstatus, '>') AS text FROM orders")
def xml_extract_all_text(spark, sf_dir):
    return order_xml(spark, sf_dir).select("o_orderkey", M.xml_extract_all_text("doc").alias("text"))


@query("SELECT o_orderkey, concat('note ', o_orderkey) AS comment, concat('<', o_orderstatus, '>') AS cdata FROM orders")
def xml_extract_comments_cdata(spark, sf_dir):
    x = M.markup_multi("doc", c=("xml_extract_comments",), d=("xml_extract_cdata",))
    return order_xml(spark, sf_dir).select("o_orderkey", x.alias("x")).select("o_orderkey", F.get("x.c", F.lit(0))["content"].alias("comment"), F.get("x.d", F.lit(0))["content"].alias("cdata"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS valid FROM orders")
def xml_valid(spark, sf_dir):
    doc = F.when(F.col("o_orderkey") % 2 == 0, F.col("doc")).otherwise(F.concat("doc", F.lit("<more>")))
    return order_xml(spark, sf_dir).select("o_orderkey", M.xml_valid(doc).alias("valid"))


@query("SELECT o_orderkey, CAST(4 AS BIGINT) AS element_count, CAST(2 AS BIGINT) AS attribute_count, CAST(3 AS BIGINT) AS max_depth, CAST(strlen(concat('<order id=\"', o_orderkey, '\" customer=\"', o_custkey, '\"><status>', o_orderstatus, '</status><priority>', o_orderpriority, '</priority><!--note ', o_orderkey, '--><raw><![CDATA[<', o_orderstatus, '>]]></raw></order>')) AS BIGINT) AS size_bytes FROM orders")
def xml_stats(spark, sf_dir):
    return order_xml(spark, sf_dir).select("o_orderkey", M.xml_stats("doc").alias("s")).select("o_orderkey", "s.element_count", "s.attribute_count", "s.max_depth", "s.size_bytes")


@query("SELECT s_suppkey, concat('urn:s:', s_nationkey) AS uri, s_name AS name, 'urn:mock:zz' AS mock, 'zz' AS undefined, 'http://www.opengis.net/gml' AS known FROM supplier")
def xml_namespaces(spark, sf_dir):
    doc = _s('<s:r xmlns:s="urn:s:', F.col("s_nationkey"), '"><s:n>', F.col("s_name"), "</s:n></s:r>")
    t = _docs(spark, sf_dir, "supplier").select("s_suppkey", doc.alias("doc"))
    return t.select(
        "s_suppkey", F.element_at(M.xml_namespaces("doc"), "s").alias("uri"), F.get(M.xml_extract_text("doc", "//s:n"), F.lit(0)).alias("name"),
        F.element_at(M.xml_mock_namespaces(M.xml_detect_prefixes(F.lit("//zz:a/child::b"))), "zz").alias("mock"), F.array_join(M.xml_find_undefined_prefixes("doc", "//s:n/zz:q"), ",").alias("undefined"), M.xml_lookup_namespace(F.lit("GML")).alias("known"),
    )


@query("SELECT s_suppkey, s_name AS name, concat('<g:r xmlns:g=\"urn:g\"><g:n>', s_name, '</g:n></g:r>') AS declared FROM supplier")
def xml_namespace_modes(spark, sf_dir):
    """Undeclared prefixes: found in mode auto, or after declarations have been added."""
    t = _docs(spark, sf_dir, "supplier").select("s_suppkey", _s("<g:r><g:n>", F.col("s_name"), "</g:n></g:r>").alias("doc"))
    return t.select("s_suppkey", F.get(M.xml_extract_text("doc", "//g:n", "auto"), F.lit(0)).alias("name"), M.xml_add_namespace_declarations("doc", {"g": "urn:g"}).alias("declared"))


@query("SELECT c_custkey, concat('<customer>', c_name, '</customer>') AS wrapped FROM customer")
def xml_wrap_fragment(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", M.xml_wrap_fragment(F.col("c_name"), F.lit("customer")).alias("wrapped"))


@query("SELECT c_custkey, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<c>', chr(10), '  <n>', c_name, '</n>', chr(10), '</c>', chr(10)) AS pretty, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<c><n>', c_name, '</n></c>') AS small FROM customer")
def xml_format(spark, sf_dir):
    t = _docs(spark, sf_dir, "customer").select("c_custkey", _s("<c><n>", F.col("c_name"), "</n></c>").alias("doc"))
    return t.select("c_custkey", M.xml_pretty_print("doc").alias("pretty"), M.xml_minify("doc").alias("small"))


@query("SELECT o_orderkey, concat('{\"order\":{\"@id\":\"', o_orderkey, '\",\"@customer\":\"', o_custkey, '\",\"priority\":{\"#text\":\"', o_orderpriority, '\"},\"raw\":{\"#text\":\"<', o_orderstatus, '>\"},\"status\":{\"#text\":\"', o_orderstatus, '\"}}}') AS json FROM orders")
def xml_to_json(spark, sf_dir):
    return order_xml(spark, sf_dir).select("o_orderkey", M.xml_to_json("doc").alias("json"))


@query("SELECT event_id, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<root><k>', json_extract_string(props, '$.k'), '</k></root>') AS xml FROM events")
def json_to_xml(spark, sf_dir):
    return _docs(spark, sf_dir, "events").select("event_id", M.json_to_xml("props").alias("xml"))


@query("SELECT l_orderkey, l_linenumber, concat('<?xml version=\"1.0\" encoding=\"UTF-8\"?>', chr(10), '<line><part>', l_partkey, '</part><flags_list><flags>', l_returnflag, '</flags><flags>', l_linestatus, '</flags></flags_list></line>') AS xml FROM lineitem")
def to_xml(spark, sf_dir):
    row = F.struct(F.col("l_partkey").alias("part"), F.array("l_returnflag", "l_linestatus").alias("flags"))
    t = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", row.alias("r"))
    return t.select("l_orderkey", "l_linenumber", M.to_xml("r", t.schema["r"].dataType, "line").alias("xml"))


XSD = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="c"><xs:complexType><xs:sequence><xs:element name="k" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>'


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer")
def xml_validate_schema(spark, sf_dir):
    doc = F.when(F.col("c_custkey") % 3 == 0, _s("<c><k>x", F.col("c_custkey"), "</k></c>")).otherwise(_s("<c><k>", F.col("c_custkey"), "</k></c>"))
    return _docs(spark, sf_dir, "customer").select("c_custkey", M.xml_validate_schema(doc, XSD).alias("valid"))


@query("SELECT p_partkey, 'heading,paragraph' AS types, p_name AS heading, concat('<h2>', p_name, '</h2><p>', p_type, '</p>') AS html FROM part")
def html_blocks(spark, sf_dir):
    t = _docs(spark, sf_dir, "part").select("p_partkey", M.html_to_blocks(_s("<h2>", F.col("p_name"), "</h2><p>", F.col("p_type"), "</p>")).alias("b"))
    return t.select("p_partkey", F.array_join("b.element_type", ",").alias("types"), F.get("b", F.lit(0))["content"].alias("heading"), M.blocks_to_html("b").alias("html"))


def customer_files(spark, sf_dir) -> str:
    """The customers as XML files, by Spark's sink."""
    path = _folder(spark)
    rows = _docs(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    readers.write_xml(rows, path, "customers", "customer")
    return path


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def read_xml(spark, sf_dir):
    """Records of files, with inferred types: attributes are text, nation an int, balance a double."""
    return readers.read_xml(spark, customer_files(spark, sf_dir), record_element="customer")


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM nation) AS nations")
def read_xml_two_tags(spark, sf_dir):
    """Records of all tags below the root, the second of which is only in other files."""
    path = _folder(spark)
    readers.write_xml(_t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("_id"), F.col("n_name").alias("title")), path, "customers", "nation")
    return readers.read_xml(spark, [customer_files(spark, sf_dir), path]).agg(F.count("key").alias("customers"), F.count("id").alias("nations"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def read_xml_columns(spark, sf_dir):
    return readers.read_xml(spark, customer_files(spark, sf_dir), record_element="customer", columns="key bigint, name string")


@query("SELECT n.n_name AS nation, count(*) AS customers, CAST(sum(CAST(round(c.c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1")
def read_xml_join_aggregate(spark, sf_dir):
    """A scan of files joined and aggregated."""
    c = readers.read_xml(spark, customer_files(spark, sf_dir), record_element="customer")
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return c.join(n, "nation").groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("customers"), F.sum(F.round(F.col("balance") * 100).cast("long")).alias("cents"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def read_xml_list(spark, sf_dir):
    """A list of paths, read as one."""
    path = _folder(spark)
    readers.write_xml(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_key"), F.col("s_name").alias("name")), path, "suppliers", "customer")
    df = readers.read_xml(spark, [customer_files(spark, sf_dir), path], record_element="customer")
    return df.select(F.col("key").cast("int").alias("key"), "name")


@query("SELECT o_orderkey AS key, o_orderstatus AS status, CAST(o_custkey AS INT) AS customer, CAST(o_custkey % 7 AS VARCHAR) AS unit, o_custkey % 2 = 1 AS odd FROM orders")
def read_xml_nested(spark, sf_dir):
    """Children with attributes: structures whose attributes have their own names and whose values have narrow types."""
    path = _folder(spark)
    c = F.col
    doc = _s('<o id="', c("o_orderkey"), '"><s>', c("o_orderstatus"), '</s><c unit="', c("o_custkey") % 7, '">', c("o_custkey"), '</c><f x="1">', F.when(c("o_custkey") % 2 == 1, "yes").otherwise("no"), "</f></o>")

    def rooted(batches):
        yield pa.RecordBatch.from_pydict({"value": ["<r>"]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": ["</r>"]})

    _docs(spark, sf_dir, "orders").select(doc.alias("value")).mapInArrow(rooted, "value string").write.text(path)
    df = readers.read_xml(spark, path, record_element="/r/o")
    return df.select(c("id").cast(_t(spark, sf_dir, "orders").schema["o_orderkey"].dataType).alias("key"), c("s").alias("status"), c("c")["#text"].alias("customer"), c("c")["unit"].alias("unit"), c("f")["#text"].alias("odd"))


def block_files(spark, sf_dir, head: str, row: F.Column, foot: str) -> str:
    """Files of a hundred customers each."""
    path = _folder(spark)
    block = F.expr("c_custkey div 100").alias("block")
    _t(spark, sf_dir, "customer").groupBy(block).agg(_s(head, F.concat_ws("", F.collect_list(row)), foot).alias("value")).write.partitionBy("block").text(path)
    return path


@query("SELECT count(DISTINCT c_custkey // 100) AS files_valid FROM customer")
def read_xml_objects(spark, sf_dir):
    path = block_files(spark, sf_dir, "<r>", _s("<n>", F.col("c_name"), "</n>"), "</r>")
    return readers.read_xml_objects(spark, f"{path}/*/*.txt").where(M.xml_valid("xml")).agg(F.count("*").alias("files_valid"))


@query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey // 100 AS VARCHAR) AS block FROM customer")
def read_html(spark, sf_dir):
    """Records of HTML files, each with its file's name."""
    path = block_files(spark, sf_dir, "<ul>", _s('<li id="', F.col("c_custkey"), '"><b>', F.col("c_name"), "</b>"), "</ul>")
    df = readers.read_html(spark, f"{path}/*/*.txt", record_element="li", filename=True)
    return df.select(F.col("b").alias("name"), "id", F.regexp_extract("filename", "block=([0-9]+)", 1).alias("block"))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, min(o_orderkey) AS first_key FROM orders GROUP BY 1 HAVING count(*) > 10")
def relational_aggregate(spark, sf_dir):
    t = xml_extract_text(spark, sf_dir).join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return t.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("priority") == "1-URGENT").alias("urgent"), F.min("o_orderkey").alias("first_key")).where("n > 10")


@query("SELECT page_id, href, position FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY href, text) AS position FROM (" + LINKS + ")) WHERE position <= 3")
def relational_window(spark, sf_dir):
    w = Window.partitionBy("page_id").orderBy("href", "text")
    return html_extract_links(spark, sf_dir).withColumn("position", F.row_number().over(w).cast("long")).where("position <= 3").select("page_id", "href", "position")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def relational_anti_join(spark, sf_dir):
    statuses = order_xml(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.explode(M.xml_extract_text("doc", "//status")).alias("status"))
    placed = statuses.where("status = 'F'").select("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey").join(placed, "c_custkey", "left_anti")


@query("SELECT o_orderkey AS key, 'O' AS kind FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'")
def relational_union_filter(spark, sf_dir):
    """The union as one pass: each document is taken apart once and gives up to two rows."""
    t = xml_extract_text(spark, sf_dir)
    kinds = F.array(F.when(F.col("status") == "O", "O"), F.when(F.col("priority") == "1-URGENT", "urgent"))
    return t.select(F.col("o_orderkey").alias("key"), F.explode(kinds).alias("kind")).where("kind is not null")


@query("SELECT CAST(c_custkey // 10 AS BIGINT) AS block, n_name AS nation, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def sql_functions(spark, sf_dir):
    """The SQL surface: a common table expression over a registered function, a lateral view and joins."""
    M.register(spark)
    customer_tables(spark, sf_dir).createOrReplaceTempView("customer_tables")
    for name in ("customer", "nation"):
        _t(spark, sf_dir, name).createOrReplaceTempView(f"{name}_view")
    return spark.sql("""WITH cells AS (SELECT block, inline(html_extract_table_rows(html)) FROM customer_tables)
        SELECT t.block, n.n_name AS nation, c.c_name AS name FROM cells t JOIN customer_view c ON c.c_custkey = CAST(t.cell_value AS BIGINT) JOIN nation_view n ON n.n_nationkey = c.c_nationkey
        WHERE t.row_type = 'data' AND t.column_index = 0""")


@query("""SELECT o_orderkey, '<status>' || o_orderstatus || '</status>' || chr(10) AS lines, 'http://www.w3.org/1999/xlink' AS uri, 'a,b' AS prefixes, '{"order":{"status":{"v":"' || o_orderstatus || '"}}}' AS json FROM orders""")
def sql_more_functions(spark, sf_dir):
    """Functions of several arguments and those without a document, in SQL."""
    M.register(spark)
    doc = _s("<order><status>", F.col("o_orderstatus"), "</status></order>")
    _docs(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")).createOrReplaceTempView("order_documents")
    return spark.sql("""SELECT o_orderkey, xml_extract_elements_string(doc, '//status') AS lines, xml_lookup_namespace('XLINK') AS uri,
        array_join(xml_detect_prefixes('//b:x[a:y="c:z"]'), ',') AS prefixes, xml_to_json_with(doc, map('text_key', 'v')) AS json FROM order_documents""")


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def stream_files(spark, sf_dir):
    """A file stream: documents arrive, are taken apart and written by a sink; the table of results is returned."""
    source, sink, state = block_files(spark, sf_dir, "<d>", _s('<c nation="', F.col("c_nationkey"), '"/>'), "</d>"), _folder(spark), _folder(spark)
    found = stream_documents(spark, f"{source}/*").select(F.explode(M.xml_extract_text("document", "//c/@nation")).alias("nation")).select(F.col("nation").cast("int").alias("nation"))
    found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("nation int").parquet(sink).groupBy("nation").agg(F.count("*").alias("n"))
