"""Shared-folder materialisation: the lineage cut that every executor can read again.

The folder is the one the cluster names in ``spark.checkpoint.dir``; a private one under the
warehouse is used only where that setting is absent (tests on a single machine). What is written
inside ``scratch`` is removed at its end, when the results made from it have been written elsewhere.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[list[tuple[str, str | None]]] = []  # of each open scratch: path, table


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet folder was written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Removes the tables that operators write meanwhile, also after a failure."""
    _written.append([])
    try:
        yield
    finally:
        for path, table in _written.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, path)


def _place(spark: SparkSession, name: str, table: bool = False) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    if _written:
        _written[-1].append((path, name if table else None))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back (lost executors reread files)."""
    spark = df.sparkSession
    path = _place(spark, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Write ``df`` into the shared folder, bucketed and sorted by ``keys``: joins and aggregations on them do not move it again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{tag}_{uuid.uuid4().hex}"
    path = _place(spark, name, table=True)
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)
