"""Tables of the test and production inputs, and intermediate tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder, spread

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables made in each ``scratch`` that is open, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def stash(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, and nothing is lost with an executor.

    The shuffle files of the computation go when it ends, so that a long job's disk holds one step's shuffles. Tables stay in the
    folder until it is cleared, since Spark may read them again as long as the result is in use; those made within a ``scratch`` go with
    it, or with the one around it if they are to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if made := _OPEN.get()[: -1 if keep else None]:
        made[-1].append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables stashed within; nothing that is used later may read them but those stashed with ``keep``."""
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def own_columns(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for working columns, prefixed until they clash with no column of ``df``."""
    taken, prefix = {c.lower() for c in df.columns}, ""
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return {n: prefix + n for n in names}
