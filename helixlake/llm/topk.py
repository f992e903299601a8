"""Exact top-k by integer inner product: norm-bucketed retrieval with local cosine thresholds.

Rows are grouped by length: quantiles of the lengths make ``buckets`` buckets, cut into blocks of
bounded size where many rows share a length. A query starts from a threshold theta, its k-th best score in a
bounded sample of rows (a lower bound of the final one). A bucket whose greatest length l gives
|q| * l < theta is skipped before any row moves. In the others the local cosine threshold is
c = theta / (|q| * l):

* if c is at least ``coordinate_from``, coordinate pruning: a unit vector p with <q, p> >= c has
  p_f within q_f * c +- sqrt((1 - c^2)(1 - q_f^2)) for each focus coordinate f of the query, but
  no upper limit if q_f >= c and no lower one if q_f <= -c (the axis is then nearer than the angle);
* else length pruning: rows shorter than theta / |q| are left out.

What is left is verified by the exact product. Theta stays what the sample gave: buckets are searched
at the same time, by tasks that share nothing. Both bounds carry a relative slack, so rounding never
drops a row; ties with theta are kept. Where all lengths are nearly equal and directions have no
structure, neither bound prunes much (share measured in the README).

Edge cases: null vectors and those with null or non-finite components take no part; zero vectors
do; rows with the query's id are not its candidates; repeated rows are candidates each; fewer than
``k`` candidates are all returned; a score beyond 64 bits is held at the bound; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import top
from .vectors import best, dealt, matrix, usable

SLACK = 1e-6
EXACT = float(1 << 53)  # sums of products up to this are exact in double precision


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    if np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * len(query) <= EXACT:
        return (rows @ query).astype(np.int64)
    own = [int(x) for x in query]
    exact = [sum(a * int(b) for a, b in zip(own, row, strict=True)) for row in rows]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], dtype=np.int64)


class Bucket:
    """Rows sorted by falling length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        order = np.lexsort((ids, -length))
        self.ids, self.rows, self.length = ids[order], rows[order], length[order]
        self.unit = np.asfortranarray(self.rows / np.maximum(self.length, 1e-300)[:, None])

    def search(self, q_id: int, query: np.ndarray, theta: float, k: int, coordinate_from: float, focus: int = 3):
        """(ids, scores) of up to k rows with scores of at least theta."""
        size = float(np.sqrt(query @ query))
        some = slice(None)
        if size and theta > 0:
            if size * self.length[0] * (1 + SLACK) < theta:
                return self.ids[:0], np.zeros(0, dtype=np.int64)
            end = int(np.searchsorted(-self.length, -(theta / size) * (1 - SLACK), side="right"))
            cosine = min(1.0, theta / (size * self.length[0]))
            some = slice(0, end)
            if cosine >= coordinate_from:
                keep, unit = np.ones(end, dtype=bool), query / size
                for f in np.argsort(-np.abs(unit))[:focus]:
                    reach = np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[f] ** 2))) + SLACK
                    if unit[f] < cosine:  # else the axis itself is within the angle
                        keep &= self.unit[:end, f] <= unit[f] * cosine + reach
                    if unit[f] > -cosine:
                        keep &= self.unit[:end, f] >= unit[f] * cosine - reach
                some = np.flatnonzero(keep)
        ids, rows = self.ids[some], self.rows[some]
        own = ids != q_id
        scores = products(rows, query)[own]
        ids = ids[own]
        at = top(ids, scores, k)
        at = at[scores[at] >= theta]
        return ids[at], scores[at]


def _theta(sample: np.ndarray, ids: np.ndarray, k: int):
    """Adds theta: the k-th best product of a query with the sample (none: minus infinity)."""

    def run(batches):
        for batch in batches:
            found = []
            same = batch.column("dim").to_numpy() == sample.shape[1]
            vectors = iter(matrix(batch.filter(pa.array(same)).column("v")) if same.any() else ())
            for q_id, fits in zip(batch.column("id").to_numpy(zero_copy_only=False), same, strict=True):
                scores = products(sample, next(vectors))[ids != q_id] if fits else []
                found.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "theta"])

    return run


def exact_top(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256,
    buckets: int = 16, sample_rows: int = 4096, coordinate_from: float = 0.3, data_block: int = 16384, query_block: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score) over floor(scale * x) of the components."""
    whole = lambda d: usable(d, id_col, vector, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    data = whole(df).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    queries = whole(df.where(is_query))
    # A bounded sample, drawn by hash: it only raises the starting threshold, no row depends on being in it.
    drawn = data.orderBy(F.xxhash64("id", "v")).limit(sample_rows).select("id", "v").collect()
    width = len(drawn[0]["v"]) if drawn else 0
    drawn = [r for r in drawn if len(r["v"]) == width]
    sample, ids = np.array([r["v"] for r in drawn]).reshape(len(drawn), width), np.array([r["id"] for r in drawn])
    queries = queries.mapInArrow(_theta(sample, ids, k), "id long, v array<double>, dim int, theta double")
    cuts = data.agg(F.percentile_approx("length", [i / buckets for i in range(1, buckets)])).first()[0] or []
    bucket = F.expr("size(filter(array(" + ", ".join(f"{c!r}D" for c in sorted(set(cuts))) + "), c -> c < length))") if cuts else F.lit(0)
    data = data.withColumn("bucket", bucket)
    longest = {r["bucket"]: r["l"] for r in data.groupBy("bucket").agg(F.max("length").alias("l")).collect()}  # one row per bucket
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    reach = F.array(*(F.struct(F.lit(b).alias("bucket"), F.lit(float(top_length)).alias("l")) for b, top_length in sorted(longest.items()))) if longest else F.expr("array(named_struct('bucket', 0, 'l', 0D))")
    live = queries.withColumn("size", size).withColumn("b", F.explode(reach)).where((F.col("theta") <= 0) | (F.col("size") * F.col("b.l") * (1 + SLACK) >= F.col("theta")))
    left, right = dealt(live.select("id", "v", "dim", "theta", F.col("b.bucket").alias("bucket")), data.drop("length"), ["bucket"], query_block * buckets, data_block * buckets)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [[], [], []]
        if a.num_rows and b.num_rows:
            block = Bucket(b.column("id").to_numpy(), matrix(b.column("v")))
            for q_id, query, theta in zip(a.column("id").to_numpy(), matrix(a.column("v")), a.column("theta").to_numpy(), strict=True):
                near, scores = block.search(q_id, query, theta, k, coordinate_from)
                for to, x in zip(found, (np.full(len(near), q_id), near, scores), strict=True):
                    to.append(x)
        columns = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return best(left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(search, "query_id long, vec_id long, score long"), k, "long")
