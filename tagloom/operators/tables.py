"""Relational operators over markup columns: tables, links, elements and nodes as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as M
from ..functions import _rows


class HtmlTables:
    """``FROM t, LATERAL html_extract_tables(html)``: header row first where there is one, then data rows, from 0."""

    def eval(self, html: str) -> Iterator[tuple]:
        for k, t in enumerate(_rows.tables(html)):
            head = [t["headers"]] if t["headers"] else []
            for r, cells in enumerate([*head, *t["rows"]]):
                yield k, r, cells


HTML_TABLES_TYPE = "table_index bigint, row_index bigint, columns array<string>"


def extract_tables(df: DataFrame, html: str, *keep: str) -> DataFrame:
    """Rows of the tables of each document, by Spark's aggregation over cells: keep..., table_index, row_index, columns."""
    cells = df.select(*keep, F.posexplode(F.coalesce(M.html_extract_tables_json(html), F.expr(f"cast(array() as {M.TABLE})"))).alias("table_index", "t"))
    rows = F.when(F.size("t.headers") > 0, F.concat(F.array("t.headers"), "t.table_data")).otherwise(F.col("t.table_data"))
    return cells.select(*keep, F.col("table_index").cast("long").alias("table_index"), F.posexplode(rows).alias("row_index", "columns")).withColumn("row_index", F.col("row_index").cast("long"))


def exploded(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    """``keep`` and one row for each struct of an extractor's list."""
    return df.select(*keep, F.inline(found))
