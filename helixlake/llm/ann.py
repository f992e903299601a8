"""Approximate nearest neighbours by inner product: a forest of hash-prefix trees over the whole table.

A tree has 2 * ``directions`` random unit vectors. The hash string of a row is the list of these
in falling order of their product with the row; rows that share the first symbol form a cell of
the tree, a sorted range that is kept together. A query descends in every tree to the cell its own
string begins with, then ascends in all trees at once: step s adds, in each tree, the cell of its
s-th symbol, until the cells hold ``factor`` * rows ** ``exponent`` entries (counted with repeats
over trees). Their union is scored exactly. Symbols of the nearest directions stand in for sign
bits, and the next symbol for a prefix cut by one bit: on vectors without structure a prefix of
signs must shrink to a few bits before it holds the neighbours (measured: 85 % of all rows).

Rows of unequal length are reduced to angles by one more coordinate, sqrt(longest^2 - length^2),
which is zero for queries. Directions come from fixed seeds; nothing is fitted. The law of growth
is the same at every size: a query meets a falling share of the table (README).

Plan: equal vectors are folded, with the k + 1 smallest of their ids. One pass counts the rows of
each cell (at most ``trees`` * 2 * ``directions`` numbers a dimension reach the driver). Cells are
put into groups of about ``group_rows`` rows; each row goes to one group a tree, each query to the
groups that hold cells it probes, once each. A cell above that size is dealt to tiles that its
queries all visit, and the queries of a group above ``query_rows`` to blocks.

Edge cases: null, zero and non-finite vectors and rows without an id take no part; vectors of
different dimension never meet; rows with the query's id are not its candidates; repeated rows are
candidates each; ties go to the smaller id; fewer candidates than ``k`` are all returned; an empty
table or query set gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .vectors import best, matrix, usable


@functools.lru_cache(maxsize=64)
def tree_directions(width: int, tree: int, directions: int) -> np.ndarray:
    """Random directions in orthogonal sets of up to ``width``."""
    rng, sets, left = np.random.default_rng([tree, width]), [], directions
    while left > 0:
        n = min(left, width)
        sets.append(np.linalg.qr(rng.standard_normal((width, n)))[0])
        left -= n
    return np.hstack(sets)


def products_with(rows: np.ndarray, lift: np.ndarray, tree: int, directions: int) -> np.ndarray:
    """The products of the lifted rows with all 2 * ``directions`` vectors of a tree."""
    half = np.column_stack([rows, lift]) @ tree_directions(rows.shape[1] + 1, tree, directions)
    return np.hstack([half, -half])


def first_symbols(rows: np.ndarray, squares_most: float, trees: int, directions: int) -> np.ndarray:
    """(rows x trees) numbers of cells: tree * 2 * directions + the nearest direction."""
    lift = np.sqrt(np.maximum(0, squares_most - np.einsum("ij,ij->i", rows, rows)))
    out = np.empty((len(rows), trees), dtype=np.int64)
    for t in range(trees):
        for lo in range(0, len(rows), 4096):
            out[lo : lo + 4096, t] = products_with(rows[lo : lo + 4096], lift[lo : lo + 4096], t, directions).argmax(axis=1) + t * 2 * directions
    return out


def probes(query: np.ndarray, counts: np.ndarray, trees: int, directions: int, least: float) -> np.ndarray:
    """The cells a query visits: the first symbols of its strings, one more in all trees at a time, until they hold ``least`` rows."""
    cells = 2 * directions
    order = np.stack([np.argsort(-products_with(query[None], np.zeros(1), t, directions)[0], kind="stable") + t * cells for t in range(trees)])
    held = np.cumsum(counts[order].sum(axis=0))
    steps = min(cells, int(np.searchsorted(held, least)) + 1)
    taken = order[:, :steps].reshape(-1)
    return taken[counts[taken] > 0]


class Cells:
    """Numbers of rows of the cells of one dimension, the groups that hold them, and what queries need to find them."""

    def __init__(self, counts: np.ndarray, rows: int, squares_most: float, group_rows: int, k: int, trees: int, factor: float, exponent: float) -> None:
        self.counts, self.squares_most = counts, squares_most
        self.least = max(factor * rows**exponent, trees * (k + 1))
        self.tiles = np.maximum(1, -(-counts // group_rows))
        self.group = np.zeros(len(counts), dtype=np.int64)
        group, held = 0, 0
        for cell, n in enumerate(counts.tolist()):
            if held and (held + n > group_rows or cell % (len(counts) // trees) == 0):  # no group has cells of two trees
                group, held = group + 1, 0
            self.group[cell] = group
            held += n
            if n > group_rows:  # a hot cell is alone, so that its tiles are its own
                group, held = group + 1, 0


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def nearest_rows(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the k highest products; equal rows tie wherever they stand.

    A matrix product may round equal rows differently, so it only preselects, with room for its
    error; the scores that rank are summed row by row.
    """
    rough = rows @ query
    some = np.arange(len(rough))
    if len(rough) > k:
        room = 4 * np.finfo(float).eps * rows.shape[1] * np.sqrt(query @ query) * np.sqrt(np.einsum("ij,ij->i", rows, rows).max())
        some = np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - room)
    scores = (rows[some] * query).sum(axis=1)
    at = np.lexsort((ids[some], -scores))[:k]
    return some[at], scores[at]


def nearest(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
    trees: int = 8, directions: int = 512, factor: float = 4.0, exponent: float = 0.75, group_rows: int = 32768, query_rows: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows marked by ``is_query`` against all rows."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector, zero=False).where("id is not null")
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    data = smallest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("dim").alias("dim"))
    data = materialize(data.withColumn("uid", F.xxhash64("v")), "vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = {r["dim"]: (r["n"], r["s"]) for r in data.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("s")).collect()}  # one row per dimension

    def by_dim(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                some = batch.filter(pa.array(dim == d))
                yield int(d), some, matrix(some.column("v"))

    def counted(batches):
        for d, _, x in by_dim(batches):
            cell, n = np.unique(first_symbols(x, sizes[d][1], trees, directions), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), d), pa.int32()), pa.array(cell), pa.array(n)], names=["dim", "cell", "n"])

    counts: dict[int, np.ndarray] = {d: np.zeros(trees * 2 * directions, dtype=np.int64) for d in sizes}
    for r in data.mapInArrow(counted, "dim int, cell long, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect():  # a fixed number of rows per dimension
        counts[r["dim"]][r["cell"]] = r["n"]
    cells = {d: Cells(counts[d], n, s, group_rows, k, trees, factor, exponent) for d, (n, s) in sizes.items()}

    def sought(batches):
        """A row per query and group with the cells it probes there."""
        for d, some, x in by_dim(batches):
            if d not in cells:
                continue
            table, ids = cells[d], some.column("id").to_numpy()
            source, groups, probed = [], [], []
            for i, query in enumerate(x):
                cell = np.sort(probes(query, table.counts, trees, directions, table.least))
                cut = np.flatnonzero(np.diff(table.group[cell])) + 1
                for part in np.split(cell, cut):
                    source.append(i)
                    groups.append(table.group[part[0]])
                    probed.append(part)
            source = np.array(source, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(source), d), pa.int32()), pa.array(groups, pa.int64()), pa.array([int(table.tiles[p[0]]) for p in probed], pa.int32()), pa.array(ids[source]), some.column("v").take(pa.array(source)), pa.array(probed, pa.list_(pa.int64()))],
                names=["dim", "grp", "tiles", "id", "v", "cells"],
            )

    queries = usable(df.where(is_query), id_col, vector, zero=False).where("id is not null")
    queries = materialize(queries.mapInArrow(sought, "dim int, grp long, tiles int, id long, v array<double>, cells array<long>"), "probes")
    blocks = {(r["dim"], r["grp"]): r["blocks"] for r in queries.groupBy("dim", "grp").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks")).collect()}  # one row per group of cells

    def placed(batches):
        """A row per vector and tree with its group, and how many blocks of queries visit that; groups that no query visits get no rows."""
        for d, some, x in by_dim(batches):
            table = cells[d]
            cell = first_symbols(x, table.squares_most, trees, directions).reshape(-1)
            group, source = table.group[cell], np.repeat(np.arange(len(x)), trees)
            times = np.array([blocks.get((d, int(g)), 0) for g in group], dtype=np.int32)
            live = np.flatnonzero(times)
            at = pa.array(source[live])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(live), d), pa.int32()), pa.array(group[live]), pa.array(table.tiles[cell][live].astype(np.int32)), pa.array(times[live]), pa.array(cell[live]), some.column("ids").take(at), some.column("uid").take(at), some.column("v").take(at)],
                names=["dim", "grp", "tiles", "blocks", "cell", "ids", "uid", "v"],
            )

    right = data.mapInArrow(placed, "dim int, grp long, tiles int, blocks int, cell long, ids array<long>, uid long, v array<double>")
    right = right.withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("tiles", "blocks")
    dealt = spark.createDataFrame([(d, g, n) for (d, g), n in blocks.items()], "dim int, grp long, blocks int")
    left = queries.join(F.broadcast(dealt), ["dim", "grp"]).withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    left = left.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.col("blocks")).cast("int")).drop("tiles", "blocks")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [[], [], [], [], []]
        if a.num_rows and b.num_rows:
            b = b.sort_by("cell").combine_chunks()
            cell, x = b.column("cell").to_numpy(), matrix(b.column("v"))
            lists = b.column("ids").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            first, ids, uid = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), b.column("uid").to_numpy()
            probed = a.column("cells").combine_chunks()
            for q_id, query, wanted in zip(a.column("id").to_numpy(), matrix(a.column("v")), probed.to_pylist(), strict=True):
                lo, hi = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, side="right")
                some = np.concatenate([np.arange(l, h) for l, h in zip(lo, hi, strict=True)])
                if not len(some):
                    continue
                # k + 1 vectors: one of them may be the query's own row alone
                at, scores = nearest_rows(ids[first[some]], x[some], query, k + 1)
                n = first[some[at] + 1] - first[some[at]]
                nth = np.concatenate([np.arange(x) for x in n])  # tells rows of one vector and one id apart
                all_ids, scores, of = ids[np.repeat(first[some[at]], n) + nth], np.repeat(scores, n), np.repeat(uid[some[at]], n)
                order = np.lexsort((nth, all_ids, -scores))
                order = order[all_ids[order] != q_id][:k]
                for to, values in zip(found, (np.full(len(order), q_id), all_ids[order], of[order], nth[order], scores[order]), strict=True):
                    to.append(values)
        columns = (np.concatenate(c) if c else np.zeros(0) for c in found)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "uid", "nth", "score"])

    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    key = ["dim", "grp", "tile", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, uid long, nth long, score double")
    return best(found.dropDuplicates(["query_id", "vec_id", "uid", "nth"]), k, "double")  # a row is found in several trees, with one score
