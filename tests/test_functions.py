"""Small cases of each function, with the values that they are to give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom import functions as M
from tagloom.functions import _rows
from tagloom.functions._dom import parse_html, parse_xml, serialize
from tagloom.functions._xpath import select

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


DOC = '<a x="1"><b id="q">t<c/>u</b><b>2</b><!-- k --><d><![CDATA[<z>]]></d></a>'


@pytest.mark.parametrize(
    ("path", "wanted"),
    [
        ("//b", ["tu", "2"]), ("//b[@id='q']", ["tu"]), ("/a/b[2]", ["2"]), ("//b/@id", ["q"]), ("//*[local-name()='c']", [""]), ("//b | //d", ["tu", "2", "<z>"]), ("count(//b)", []), ("//d/text()", ["<z>"]),
        ("//c/ancestor::a", ["tu2<z>"]), ("//b[. > 1]", ["2"]), ("//b[not(@id)]", ["2"]), ("//b[last()]", ["2"]), ("((", []), ("//a[b=2]/@x", ["1"]), ("//b[contains(., 't') and @id]", ["tu"]), ("//b[1]/following-sibling::b", ["2"]),
        ("//d/preceding-sibling::b[1]", ["2"]), ("//b[position() < 2]", ["tu"]), ("//b[string-length() = 1 or starts-with(., 'z')]", ["2"]), ("//comment()", [" k "]), (".//c/..", ["tu"]), ("//b[name() = 'b'][2]", ["2"]),
    ],
)
def test_xpath(path, wanted):
    assert [n.string() for n in select(parse_xml(DOC), path)] == wanted


def test_first_is_per_parent():
    assert [n.string() for n in select(parse_xml("<r><p><x>1</x><x>2</x></p><p><x>3</x></p></r>"), "//x[1]")] == ["1", "3"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        # open elements are closed where their parent ends, or where a like one begins
        ("<html><body><section><p>Open tea<em>pot</em></section></body></html>", "<html><body><section><p>Open tea<em>pot</em></p></section></body></html>"),
        ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "<html><body><dl><dt>k</dt><dd>v</dd><dt>l</dt><dd>w</dd></dl></body></html>"),
        # no text is an empty document; fragments get html and body
        ("", "<html></html>"), ("<h3><code>f</code> and <u>g</u></h3>", "<html><body><h3><code>f</code> and <u>g</u></h3></body></html>"),
        # white space becomes one space, but in pre
        ("<p>two \t\n words</p>", "<html><body><p>two words</p></body></html>"), ("<pre>1\n\t2</pre>", "<html><body><pre>1\n\t2</pre></body></html>"),
        ("<html>\n\t<body>\n\t\t<h4>Q</h4>\n\t</body>\n</html>", "<html> <body> <h4>Q</h4> </body> </html>"),
        # void elements, document types, entities, other scripts
        ('<html><body><p>a<br>b<input name="q"></p><hr></body></html>', '<html><body><p>a<br/>b<input name="q"/></p><hr/></body></html>'),
        ("<!DOCTYPE html><html><head><meta charset='utf-8'></head><body>x</body></html>", '<html><head><meta charset="utf-8"/></head><body>x</body></html>'),
        ("<html><body><i>1 &lt; 2 &amp;&amp; &quot;3&quot; &gt; 2</i></body></html>", '<html><body><i>1 &lt; 2 &amp;&amp; "3" &gt; 2</i></body></html>'),
        ("<p>žluťoučký 猫</p>", "<html><body><p>žluťoučký 猫</p></body></html>"),
    ],
)
def test_parse_html(text, wanted):
    assert _rows.clean_html(text) == wanted


@pytest.mark.parametrize("text", ["a&amp", "&copy 1", "&&&", "&notit;", "a&b=c&lt", "&", "&ampé;", "x &amp", "\ufdd0&amp", "<i>", "&#38", "&eacute;"])
def test_named_references_end_in_a_semicolon(text):
    """In text, values and scripts; numbers need none."""
    decoded = {"&#38": "&", "&eacute;": "é", "<i>": ""}.get(text, text)
    assert _rows.html_text(f"<p>{text}</p>") == decoded
    assert _rows.links(f'<a href="{text}">&amp;{text}</a>')[0]["href"] == {"<i>": text}.get(text, decoded)
    assert _rows.html_text(f"<script>{text}</script>") == text


def test_deep_html():
    """Documents of any depth are written without recursion."""
    deep = _rows.clean_html("<div>" * 3000 + "x")
    assert deep.count("<div>") == deep.count("</div>") == 3000


def test_html_script_text_is_no_markup():
    assert [n.name for n in select(parse_html('<script>var t="</p>";</script><p>x'), "//p")] == ["p"]


@pytest.mark.parametrize("text", ["<a>", "<a></b>", "", "  ", "<a/><b/>", "<" + "a>" * 1, "<r>&undefined;</r>"])
def test_invalid(text):
    assert _rows.valid(text) is False


def test_depth_and_entities():
    assert _rows.valid("<a>" * 5000 + "</a>" * 5000) is False
    external = '<!DOCTYPE r [<!ENTITY e SYSTEM "file:///etc/hostname">]><r>&e;</r>'
    root = parse_xml(external)
    assert root is None or root.string() == ""
    assert _rows.valid("<a/>") and _rows.valid(None) is None


def test_json():
    assert _rows.to_json('<ship><crew rank="mate" age="41">Ann</crew></ship>') == '{"ship":{"crew":{"@rank":"mate","@age":"41","#text":"Ann"}}}'
    assert _rows.to_json("<ship><crew>Ann</crew><crew>Bo</crew></ship>") == '{"ship":{"crew":[{"#text":"Ann"},{"#text":"Bo"}]}}'
    assert _rows.to_json("<ship><hold/></ship>") == '{"ship":{"hold":{}}}'
    assert _rows.to_json("<ship><hold/></ship>", empty_elements="null") == '{"ship":{"hold":null}}'
    assert _rows.to_json("<r><i>1</i></r>", force_list=["i"]) == '{"r":{"i":[{"#text":"1"}]}}'
    assert _rows.to_json("<bad") == "{}"
    assert _rows.from_json('{"port":{"pier":{"name":"N","berth":"4"}}}') == HEAD + "<port><pier><berth>4</berth><name>N</name></pier></port>"
    assert _rows.from_json("{}") == HEAD + "<root></root>"
    assert _rows.from_json('{"r":{"@a":"1","#text":"x","i":[1,2]}}') == HEAD + '<r a="1">x<i_list><i>1</i><i>2</i></i_list></r>'


def test_extractors(spark):
    assert one(spark, M.xml_extract_text("v", "//b"), DOC) == ["tu", "2"]
    assert one(spark, M.xml_extract_text("v", "//b"), None) == []
    assert one(spark, M.xml_extract_elements("v", "//b[2]"), DOC) == ["<b>2</b>"]
    assert one(spark, M.xml_extract_elements_string("v", "//b"), DOC) == '<b id="q">t<c/>u</b>\n<b>2</b>\n'
    assert one(spark, M.xml_extract_elements_string("v", "//zz"), DOC) == ""
    assert [tuple(r) for r in one(spark, M.xml_extract_attributes("v", "//*"), DOC)] == [("a", "/a", "x", "1", 1), ("b", "/a/b", "id", "q", 1)]
    assert [tuple(r) for r in one(spark, M.xml_extract_comments("v"), DOC)] == [(" k ", 1)]
    assert one(spark, M.xml_stats("v"), "<a><b><c><d>x</d></c></b></a>")["max_depth"] == 5
    assert one(spark, M.xml_namespaces("v"), '<r xmlns="u" xmlns:p="w"/>') == {"": "u", "p": "w"}
    assert one(spark, M.xml_valid("v"), None) is None


def test_undeclared_prefix():
    text = "<r><gml:posList>1</gml:posList></r>"
    assert _rows.extract_text(text, "//gml:posList") == []
    assert _rows.extract_text(text, '//*[local-name()="gml:posList"]') == ["1"]
    assert _rows.extract_text(text, "//gml:posList", "auto") == ["1"]
    assert _rows.extract_text(text, "//gml:posList", {"gml": "urn:x"}) == ["1"]
    with pytest.raises(ValueError, match="strict"):
        M.xml_extract_text("v", "//a", "sometimes")


def test_html_extractors(spark):
    html = '<a href="/x" title="T">L <b>k</b></a><a name="n">no</a><img src="p.jpg" width="20px" height="z">'
    assert [tuple(r) for r in one(spark, M.html_extract_links("v"), html)] == [("L k", "/x", "T", 1)]
    assert [tuple(r) for r in one(spark, M.html_extract_images("v"), html)] == [("", "p.jpg", None, 20, 0, 1)]
    assert one(spark, M.html_extract_text("v", "//b"), html) == ["k"]
    assert one(spark, M.html_unescape("v"), "&lt;b&gt; &amp; <i>x</i>") == "<b> & x"
    assert one(spark, M.html_escape("v"), "<a & \"b\">'") == "&lt;a &amp; &quot;b&quot;&gt;'"
    table = "<table><tr><th>port<th>ships</tr><tr><td>Ost<td>9</tr></table><table></table><table><tr><td>x</td></tr></table>"
    assert _rows.tables(table) == [{"line": 1, "headers": ["port", "ships"], "rows": [["Ost", "9"]]}, {"line": 1, "headers": [], "rows": [["x"]]}]


def test_native(spark):
    assert one(spark, M.xml_detect_prefixes("v"), "//gml:pos/child::x[@a:b='c:d']") == ["a", "gml"]
    assert one(spark, M.xml_wrap_fragment(F.col("v"), F.lit("w")), "<a/>") == "<w><a/></w>"
    with pytest.raises(Exception, match="not a valid element name"):
        one(spark, M.xml_wrap_fragment(F.col("v"), F.lit("a b")), "<a/>")
    assert one(spark, M.xml_mock_namespaces(F.array(F.lit("p"), F.lit(None)))) == {"p": "urn:mock:p"}
    assert one(spark, M.xml_lookup_namespace(F.lit("SVG"))) == "http://www.w3.org/2000/svg"
    assert one(spark, M.xml_lookup_namespace(F.lit("nope"))) is None


def test_to_xml(spark):
    assert one(spark, M.to_xml("v", T.StringType()), "3 < 4 & <B>") == HEAD + "<xml>3 &lt; 4 &amp; &lt;B&gt;</xml>"
    assert one(spark, M.to_xml("v", T.ArrayType(T.StringType())), ["a", "b"], "array<string>") == HEAD + "<xml_list><xml>a</xml><xml>b</xml></xml_list>"
    kind = T.StructType.fromDDL("name string, age int")
    assert one(spark, M.to_xml("v", kind), ("J", None), "struct<name:string,age:int>") == HEAD + "<xml><name>J</name><age/></xml>"
    assert one(spark, M.to_xml("v", T.IntegerType()), None, "int") is None
    with pytest.raises(ValueError, match="element name"):
        M.to_xml("v", T.StringType(), "a><b")


def test_schema_validation(spark):
    from tagloom.plans.queries import XSD

    assert one(spark, M.xml_validate_schema("v", XSD), "<c><k>1</k></c>") is True
    assert one(spark, M.xml_validate_schema("v", XSD), "<c><k>z</k></c>") is False
    assert one(spark, M.xml_validate_schema("v", "<nope"), "<c/>") is False
    assert one(spark, M.xml_validate_schema("v", XSD), None) is None


def test_formats():
    assert _rows.pretty_print("<a><b>1</b><c/></a>") == HEAD + "<a>\n  <b>1</b>\n  <c/>\n</a>\n"
    assert _rows.minify("<a> <b/> </a>") == HEAD + "<a> <b/> </a>"
    assert _rows.minify("<a> <b/> </a>", strip_blank=True) == HEAD + "<a><b/></a>"
    assert _rows.pretty_print("<bad") == "<bad"
    assert serialize(parse_xml('<a t="&lt;&quot;">&amp;<![CDATA[<]]></a>')) == '<a t="&lt;&quot;">&amp;<![CDATA[<]]></a>'


def test_blocks():
    html = '<h2 id="i">T</h2><p>a <b>b</b></p><pre><code class="language-py">x=1</code></pre><ul><li>1<li>2</ul><hr><blockquote>q</blockquote>'
    found = _rows.to_blocks(html)
    assert [b["element_type"] for b in found] == ["heading", "paragraph", "text", "bold", "code", "list", "hr", "blockquote"]
    assert _rows.from_blocks(found) == '<h2 id="i">T</h2><p>a <strong>b</strong></p><pre><code class="language-py">x=1</code></pre><ul><li>1</li><li>2</li></ul><hr/><blockquote>q</blockquote>'
    assert _rows.to_blocks(None) == [] and _rows.from_blocks(None) == ""
    odd = [{"kind": "block", "element_type": "table", "content": "[1, 2", "level": 1, "encoding": "json", "attributes": [], "element_order": 0}]
    assert _rows.from_blocks(odd) == "<table><tbody></tbody></table>"
    pandoc = '[[], [{"t":"AlignRight"}], [0], [[{"t":"Plain","c":[{"t":"Str","c":"H"}]}]], [[[{"t":"Plain","c":[{"t":"Emph","c":[{"t":"Str","c":"x"}]}]}]]]]'
    assert _rows.from_blocks([odd[0] | {"content": pandoc}]) == '<table><thead><tr><th style="text-align: right;">H</th></tr></thead><tbody><tr><td style="text-align: right;"><em>x</em></td></tr></tbody></table>'
