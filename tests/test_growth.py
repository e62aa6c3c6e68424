"""How the markup queries share out their work: what keeps a task from growing with the table."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagloom.plans.queries import QUERIES, _docs
from tagloom.session import whole_files
from tagloom.sources import readers


def test_rows_are_dealt_evenly(spark, tmp_path):
    """One row group over many splits: all but one of the scan's partitions are empty."""
    pq.write_table(pa.table({"k": pa.array(range(40000))}), str(tmp_path / "t.parquet"))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        found = [r["count"] for r in _docs(spark, str(tmp_path), "t").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sum(found) == 40000 and max(found) <= 12000


@pytest.mark.parametrize("name", ["relational_union_filter", "relational_anti_join", "relational_aggregate", "xml_extract_attributes", "xml_to_json", "xml_extract_elements", "sql_more_functions", "json_to_xml"])
def test_documents_are_parsed_after_the_exchange(spark, sf_dir, name):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.search("\n.*Repartition[^\n]*\n", text)
    assert dealt and "#" in text[: dealt.start()] and not re.search(r"batch\(|<lambda>\(|PythonUDF|EvalPython", text[dealt.end() :].split("\n:")[0].partition("Join")[0])


@pytest.mark.parametrize(("name", "call"), [("xml_extract_elements", r"(?:batch|<lambda>)\("), ("relational_union_filter", r"(?:batch|<lambda>)\("), ("xml_spark_xpath", r"xpath\w*\(")])
def test_documents_are_parsed_once(spark, sf_dir, name, call):
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(call, text)) == 1


MIXED = "\ufeff\n<r>\n<a x='1>2'>u>>v</a><!-- <no> --><b><![CDATA[<no>]]></b>" + "<c>1</c>" * 500 + "<d/></r>\n \n"


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_tags_of_a_file_of_many_batches(spark, tmp_path, batch):
    (tmp_path / "a.xml").write_text(MIXED, encoding="utf-8")
    (tmp_path / "b.xml").write_text("<q><e/></q>", encoding="utf-8")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.xml").write_text("<q><e></q>", encoding="utf-8")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        paths = [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")]
        assert sorted(readers.all_tags(spark, paths, "", readers.Options())) == ["a", "b", "c", "d", "e"]
        with pytest.raises(Exception, match="not valid XML"):
            readers.all_tags(spark, [str(tmp_path / "bad")], "", readers.Options())
    finally:
        spark.conf.set(key, was)


def test_a_file_is_one_stream(spark, tmp_path):
    """However large files are, none is split or sorted to find its tags, and none shares a partition."""
    for k in range(10):
        (tmp_path / f"{k}.xml").write_text("<r>" + "<c>1</c>" * 5000 + "</r>", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert whole_files(spark).read.text(str(tmp_path)).rdd.getNumPartitions() == 10
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "4096"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
