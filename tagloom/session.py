"""A session with what the library wants of Spark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session, with all functions registered for SQL."""
    from .functions import register

    builder = SparkSession.builder.appName("tagloom")
    if master:
        builder = builder.master(master)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return register(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is what ``spark.checkpoint.dir`` names; without it, a new folder in local mode, where there is one machine, and the
    warehouse on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master)
        folder = f"file://{tempfile.mkdtemp(prefix='tagloom-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/tagloom-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores at least: a small file is one partition, however much each row of it costs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def whole_files(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose scans of splittable files have one partition for each file, however large."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    # a split takes up to the first, and a file counts the second on top of its bytes
    for conf in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(conf, str(1 << 46))
    return own


def dealt(table: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """A table of files whose rows are dear to work on, in even partitions of up to ``piece`` bytes of its files.

    There is one for each core at least, and some for each where that makes no tiny ones.

    How many partitions a scan has tells nothing of its rows: a split of a Parquet file without the middle of a row group is empty.
    Filters on what is computed from a row should follow a generator: Spark moves others below the exchange, into the scan's few tasks.
    """
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, min(4 * cores, size // (piece >> 4)), -(-size // piece)))
