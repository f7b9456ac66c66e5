"""Tables written in the shared folder between the steps of an operator, so that lineage stays short.

Later readers survive the loss of any executor. The folder is the one named in spark.checkpoint.dir; only a local
session may leave that unset and gets an own one. Tables go when the driver ends, or by release().
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Staged tables are read by the session that wrote them, which knows whether a job ended well: no marker files.
_OPTIONS = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_written: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"/tmp/checkpoints/loomgraph-{spark.sparkContext.applicationId}"
    return root.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path, None))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back."""
    path = folder(df.sparkSession, name)
    df.write.options(**_OPTIONS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Like stage(), but dealt into buckets by a column: a join or grouping on it doesn't shuffle the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    table = f"loomgraph_{name}_{uuid.uuid4().hex}"
    _written.append((spark, path, table))
    df.write.format("parquet").options(**_OPTIONS).option("path", path).bucketBy(buckets, column).saveAsTable(table)
    return spark.table(table)


@atexit.register
def release() -> None:
    """Deletes all tables. DataFrames that were built on them can't be read any more."""
    while _written:
        spark, path, table = _written.pop()
        try:
            if table:
                spark.sql(f"drop table if exists {table}")
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone already; the others may still be there
            continue
