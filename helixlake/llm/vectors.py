"""Blocks of vectors for searches that hold a stated query set against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector: str, zero: bool) -> DataFrame:
    """(id, v, dim) of the rows whose vector is not null, has no null or non-finite component and, unless ``zero``, is not zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def dealt(queries: DataFrame, data: DataFrame, extra: list[str], query_block: int, data_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``pair``: every query meets every row of its dimension in exactly one pair of bounded blocks."""
    n_queries, n_rows = queries.count(), data.count()
    q_blocks, d_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_rows // data_block))
    mine = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key: Column = F.concat_ws(",", "dim", *extra, "qb", "db")
    q = queries.withColumn("qb", mine(q_blocks, 1)).withColumn("db", spread(d_blocks))
    d = data.withColumn("db", mine(d_blocks, 2)).withColumn("qb", spread(q_blocks))
    return q.withColumn("pair", key).drop("qb", "db"), d.withColumn("pair", key).drop("qb", "db")


def best(found: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(kind).alias("score"))
