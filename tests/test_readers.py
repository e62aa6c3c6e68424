"""Files and strings as typed rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagloom.sources import readers as R


@pytest.fixture
def books(tmp_path):
    f = tmp_path / "books.xml"
    f.write_text('<lib><book id="1" ok="y"><title>A</title><price>1.5</price><n>3</n><sale>yes</sale></book><book id="2" ok="n"><title>B</title><price>2</price><n>4</n><sale>no</sale></book></lib>')
    return str(f)


def test_types_and_order(spark, books):
    df = R.read_xml(spark, books)
    assert dict(df.dtypes) == {"id": "string", "ok": "string", "title": "string", "price": "double", "n": "int", "sale": "boolean"}
    assert df.columns == ["id", "ok", "title", "price", "n", "sale"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "y", "A", 1.5, 3, True), ("2", "n", "B", 2.0, 4, False)]


def test_options(spark, books):
    assert set(dict(R.read_xml(spark, books, all_varchar=True).dtypes).values()) == {"string"}
    assert "id" not in R.read_xml(spark, books, attr_mode="discard").columns
    assert "@id" in R.read_xml(spark, books, attr_mode="prefixed").columns
    assert R.read_xml(spark, books, filename=True).columns[0] == "filename"
    assert [tuple(r) for r in R.read_xml(spark, books, columns={"id": "bigint", "title": "string"}).orderBy("id").collect()] == [(1, "A"), (2, "B")]
    assert R.read_xml(spark, books, nullstr="A").where("title is null").count() == 1
    assert R.read_xml(spark, books, force_list="title").schema["title"].dataType.simpleString() == "array<string>"
    with pytest.raises(ValueError, match="exclude"):
        R.read_xml(spark, books, columns="a int", all_varchar=True)
    with pytest.raises(ValueError, match="unnest_as"):
        R.read_xml(spark, books, unnest_as="rows")


def test_nested_and_depth(spark):
    text = "<r><e><id>1</id><s><k>a</k><k>b</k></s></e><e><id>2</id><s><k>c</k></s></e></r>"
    assert R.parse_xml(spark, text).schema["s"].dataType.simpleString() == "struct<k:array<string>>"
    assert R.parse_xml(spark, text, max_depth=2).schema["s"].dataType.simpleString() == "string"


def test_missing_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="No files found"):
        R.read_xml(spark, str(tmp_path / "none*.xml"), ignore_errors=True)


def test_objects(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<a/>")
    (tmp_path / "b.xml").write_text("<a>")
    assert R.read_xml_objects(spark, str(tmp_path / "*.xml"), ignore_errors=True).count() == 1
    with pytest.raises(Exception, match="not valid XML"):
        R.read_xml_objects(spark, str(tmp_path / "*.xml")).collect()
    (tmp_path / "e.html").write_text("")
    assert R.read_html_objects(spark, str(tmp_path / "e.html")).first()["html"] == "<html></html>"
    assert R.parse_html_objects(spark, "").first()["html"] == "<html></html>"
    assert R.parse_xml_objects(spark, "<x", ignore_errors=True).count() == 0


def test_html_and_sql(spark, books):
    rows = R.parse_html(spark, '<ul><li id="1"><b>x</b><li id="2"><b>y</b></ul>', record_element="li")
    assert sorted(tuple(r) for r in rows.select("id", "b").collect()) == [("1", "x"), ("2", "y")]
    assert R.sql(spark, f"SELECT count(*) AS n FROM '{books}' WHERE n > 3").first()["n"] == 1


def test_record_tags():
    assert R.record_tags("<r><!-- <x> --><a/><b>t</b><a/></r>") == ["a", "b"]
    assert R.record_tags("<r><q><a/></q></r>", "q") == ["a"]
    assert R.record_tags("<r><a/></r>", max_depth=0) == ["r"]


def test_html_records_survive(spark):
    """Names, characters, comments and scripts that XML does not have."""
    items = ['<li @click="x" _click="z" id="1"><b>a</b>', '<li id="2"><b>b\x01c</b>', '<li id="3"><!-- x -- y ---><b>d</b>', '<li id="4"><script>a<b]]>c</script><b>e</b>', '<li id="5" 1a="q"><b>f</b>']
    rows = R.parse_html(spark, f"<ul>{''.join(items)}</ul>", record_element="li")
    assert sorted((r["id"], r["b"]) for r in rows.select("id", "b").collect()) == [("1", "a"), ("2", "b\ufffdc"), ("3", "d"), ("4", "e"), ("5", "f")]
    assert R.parse_html(spark, '<body><p @click="x">t</p>').columns == ["p"]
    deep = "<ul><li>x<li>" + "<i>" * 300 + "</ul>"
    with pytest.raises(Exception, match="cannot be written"):
        R.parse_html(spark, deep, record_element="li")
    assert R.parse_html(spark, deep, record_element="li", ignore_errors=True).count() == 1


def test_late_tags(spark, tmp_path):
    """A second tag after hundreds of lines, or in another file only, across splits of a file."""
    rows = "\n".join(f"<a><n>{k}</n><!-- <z/> > --></a>" for k in range(3000))
    (tmp_path / "1.xml").write_text(f'<?xml version="1.0" encoding="UTF-8"?>\n<r>\n{rows}\n<b><m>x</m></b>\n</r>\n')
    (tmp_path / "2.xml").write_text("<r><c><k>1</k></c><q><d/></q></r>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        df = R.read_xml(spark, str(tmp_path / "*.xml"))
        assert df.columns[:1] == ["n"] and {"m", "k", "d"} <= set(df.columns)
        assert [df.where(f"{c} is not null").count() for c in "nmk"] == [3000, 1, 1] and df.count() == 3003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert R.read_xml(spark, str(tmp_path / "*.xml"), root_element="q", columns="x string").count() == 1
    (tmp_path / "3.xml").write_text("<r><c></r>")
    with pytest.raises(Exception, match="not valid XML"):
        R.read_xml(spark, str(tmp_path / "*.xml"))


def test_lists_of_paths(spark, tmp_path, books):
    (tmp_path / "more.xml").write_text("<lib><book id='3'><title>C</title></book></lib>")
    assert R.read_xml(spark, [books, str(tmp_path / "more.xml")], record_element="book").count() == 3


def test_nested_names_and_types(spark):
    """Attributes of children under their own names and as text, values of their narrowest type."""
    text = "<s>" + "".join(f'<i><cost unit="{k}">{k}.5</cost><many kind="box">{k}</many><flag x="1">yes</flag><l><v a="{k}">{k}</v><v a="0">7</v></l></i>' for k in range(3)) + "</s>"
    df = R.parse_xml(spark, text)
    assert {c: t for c, t in df.dtypes} == {"cost": "struct<#text:double,unit:string>", "many": "struct<#text:int,kind:string>", "flag": "struct<#text:boolean,x:string>", "l": "struct<v:array<struct<#text:int,a:string>>>"}
    assert sorted(tuple(r) for r in df.select("cost.unit", F.col("many")["#text"], F.col("flag")["#text"], F.col("l.v")[0]["#text"]).collect()) == [(str(k), k, True, k) for k in range(3)]
    assert "@unit" in R.parse_xml(spark, text, attr_mode="prefixed").schema["cost"].dataType.fieldNames()
    assert dict(R.parse_xml(spark, text, attr_mode="discard").dtypes)["many"] == "int"


def test_times_and_formats(spark):
    text = "<s>" + "".join(f"<i><t>10:11:1{k}</t><d>2024-01-0{k}T10:00:00</d><m>{'0' + str(k) + '/02/2024' if k % 2 else '2024-02-0' + str(k)}</m></i>" for k in range(1, 4)) + "</s>"
    df = R.parse_xml(spark, text)
    assert dict(df.dtypes) == {"t": "string", "d": "timestamp", "m": "string"} and df.where("t = '10:11:12'").count() == 1
    many = R.parse_xml(spark, text, datetime_format=["iso", "eu"])
    assert dict(many.dtypes)["m"] == "date" and sorted(str(r["m"]) for r in many.collect()) == ["2024-02-01", "2024-02-02", "2024-02-03"]
    with pytest.raises(ValueError, match="namespaces"):
        R.parse_xml(spark, text, namespaces="nope")


def test_record_paths(spark):
    text = "<r><i><k>1</k></i><q><j>2</j></q></r>"
    assert R.parse_xml(spark, text, record_element="/r/i").count() == R.parse_xml(spark, text, record_element="//q/j").count() == 1
    with pytest.raises(ValueError, match="also stand"):
        R.parse_xml(spark, "<r><i><k>1</k></i><q><i>2</i></q></r>", record_element="/r/i")
    with pytest.raises(ValueError, match="takes a name"):
        R.parse_xml(spark, text, record_element="//i[k=1]")


def test_html_filename(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.html").write_text(f'<ul><li id="{k}"><b>x{k}</b><li id="e{k}"></ul>')
    rows = R.read_html(spark, str(tmp_path / "*.html"), record_element="li", filename=True)
    assert rows.columns[0] == "filename" and sorted((r["filename"][-6:], r["id"], r["b"]) for r in rows.collect()) == [("0.html", "0", "x0"), ("0.html", "e0", None), ("1.html", "1", "x1"), ("1.html", "e1", None)]


def test_sql_leaves_literals(spark, books):
    row = R.sql(spark, f"SELECT 'taken from \\'x.xml\\'' AS a, \"from 'y.xml'\" AS b, count(*) AS n FROM '{books}' -- from 'z.xml'").first()
    assert (row["a"], row["b"], row["n"]) == ("taken from 'x.xml'", "from 'y.xml'", 2)
