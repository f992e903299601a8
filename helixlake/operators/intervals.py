"""Interval operators on half-open [s, e) rows: joins, unions, clusters, lift-over, classification.

Overlap joins are binned equi-joins: each side is dealt to bins of ``width`` positions, and a pair
is emitted only in the bin of the greater start, so no distinct is needed. An interval makes a row
for each bin it meets, length / width + 1 of them, so ``width`` should be near the usual length of
the longer side; the default suits genes and exons, and a chain over a chromosome of 250 million
positions makes some 120 000 narrow rows under it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from helixlake.operators.graphs import merge_labels, unite
from helixlake.operators.sorted_groups import by_groups, starts

BIN, CELL, LINK_CELL = 2048, 1 << 20, 1 << 17


def _binned(df: DataFrame, s: str, e: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e) - 1, F.col(s))) / width)
    return df.withColumn("__bin", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], a_span=("s", "e"), b_span=("s", "e"), width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs with ``a.s < b.e and b.s < a.e`` and equal ``on``; columns of b but the keys carry the suffix ``_b``; adds ``bp``."""
    b = b.select(*on, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in on))
    (s, e), (s2, e2) = a_span, (f"{b_span[0]}_b", f"{b_span[1]}_b")
    pairs = _binned(a, s, e, width).join(_binned(b, s2, e2, width), [*on, "__bin"])
    pairs = pairs.where((F.col(s) < F.col(e2)) & (F.col(s2) < F.col(e)) & (F.col("__bin") == F.floor(F.greatest(s, s2) / width))).drop("__bin")
    pairs = pairs.withColumn("bp", F.least(e, e2) - F.greatest(s, s2))
    if how == "inner":
        return pairs
    # what a row overlaps depends on its key and interval alone, so these tell the rows without a hit
    rest = a.join(pairs.select(*on, s, e).distinct(), [*on, s, e], "left_anti")
    return pairs.unionByName(rest.select(*a.columns), allowMissingColumns=True)


def overlap_semi(a: DataFrame, b: DataFrame, on: list[str], pad: int = 0, width: int = BIN, anti: bool = False) -> DataFrame:
    """Rows of a within ``pad`` of some row of b (or of none). Only distinct keys and intervals are shuffled and binned, not whole rows."""
    b = b.select(*on, (F.col("s") - pad).alias("s2"), (F.col("e") + pad).alias("e2")).distinct()
    spans = a.select(*on, "s", "e").distinct()
    hit = _binned(spans, "s", "e", width).join(_binned(b, "s2", "e2", width), [*on, "__bin"]).where("s < e2 and s2 < e").select(*on, "s", "e").distinct()
    return a.join(hit, [*on, "s", "e"], "left_anti" if anti else "left_semi").select(*a.columns)


def _carried(df: DataFrame, summary: DataFrame, on: list[str]) -> DataFrame:
    """Adds what a summary (on, __cell, ...) says of each row's cell; keys may be null."""
    other = summary.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate([*on, "__cell"])), *(c for c in summary.columns if c not in (*on, "__cell")))
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate([*on, "__cell"])]
    return df.join(other, reduce(Column.__and__, same), "left").drop(*(f"__k{i}" for i in range(len(on) + 1)))


def with_groups(df: DataFrame, on: list[str], gap: int = 0, touching: bool = False, name: str = "grp", cell: int = CELL) -> DataFrame:
    """Numbers, per key, the runs of intervals that overlap (or touch, or lie within ``gap``), in order of start.

    Two levels, so that a key with a large share of all rows is many tasks: rows are ordered within
    cells of ``cell`` positions, and running maxima and group numbers are carried over from cell to
    cell by windows over one row per cell.
    """
    rows = df.withColumn("__cell", F.floor(F.col("s") / cell))
    inside = Window.partitionBy(*on, "__cell").orderBy("s", "e")
    earlier = Window.partitionBy(*on).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*on, "__cell").agg(F.max("e").alias("__top"))
    rows = _carried(rows, tops.select(*on, "__cell", F.max("__top").over(earlier).alias("__carry")), on)
    reach = F.greatest("__carry", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))) + gap
    new = reach.isNull() | (F.col("s") > reach if touching else F.col("s") >= reach)
    rows = rows.withColumn("__new", new.cast("bigint")).withColumn("__nth", F.sum("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    starts = rows.groupBy(*on, "__cell").agg(F.sum("__new").alias("__starts"))
    rows = _carried(rows.drop("__new", "__carry"), starts.select(*on, "__cell", F.coalesce(F.sum("__starts").over(earlier), F.lit(0)).alias("__before")), on)
    return rows.withColumn(name, F.col("__nth") + F.col("__before")).drop("__cell", "__nth", "__before")


def merge(df: DataFrame, on: list[str], gap: int = 0, touching: bool = False) -> DataFrame:
    """Union of the intervals of each key: (on, s, e, n)."""
    grouped = with_groups(df.select(*on, "s", "e"), on, gap, touching)
    return grouped.groupBy(*on, "grp").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("grp")


def cluster(df: DataFrame, on: list[str], gap: int = 0, touching: bool = True) -> DataFrame:
    """Members with the bounds of their cluster: adds grp, cluster_s, cluster_e."""
    grouped = with_groups(df, on, gap, touching)
    w = Window.partitionBy(*on, "grp")
    return grouped.withColumns({"cluster_s": F.min("s").over(w), "cluster_e": F.max("e").over(w)})


def blocks_of(df: DataFrame, on: list[str]) -> DataFrame:
    """Merged blocks of each key, nested in order."""
    merged = merge(df, on, touching=True)
    return merged.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("blocks"))


def _linked(group: np.ndarray, s: np.ndarray, e: np.ndarray, min_bp: int, min_share: float) -> np.ndarray:
    """Component of each row, named by one of its rows; rows are sorted by group, start and end."""
    label = np.arange(len(s))
    same = np.zeros(len(s), dtype=bool)
    same[1:] = (group[1:] == group[:-1]) & (s[1:] == s[:-1]) & (e[1:] == e[:-1])
    apart = np.flatnonzero(~same)  # rows with the interval of the row before them are linked to it or to none
    size = e - s
    if same.any():
        linked = same & (size > 0) & (size >= min_bp) & (size >= size * min_share)
        label = np.where(linked, apart[np.cumsum(~same) - 1], label)
    g, s, e, size = group[apart], s[apart], e[apart], size[apart]
    i, step, held, count = np.arange(len(apart)), 0, [], 0
    while len(i):  # row i against the step-th row after it, as long as that begins before row i ends
        step += 1
        i = i[i + step < len(apart)]
        j = i + step
        near = (g[i] == g[j]) & (s[j] < e[i])
        i, j = i[near], j[near]
        bp = np.minimum(e[i], e[j]) - s[j]
        link = (s[i] < e[j]) & (bp >= min_bp) & (bp >= np.minimum(size[i], size[j]) * min_share)
        held.append((apart[i[link]], apart[j[link]]))
        count += len(held[-1][0])
        if count > 1 << 20 or not len(i):
            label = unite(label, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    return label


def overlap_components(df: DataFrame, on: list[str], id_col: str, min_bp: int = 20, min_share: float = 0.5, cell: int = LINK_CELL) -> DataFrame:
    """(id, label): intervals linked when they share min_bp and min_share of the shorter; label is the least id linked.

    The intervals of a key and a cell of ``cell`` positions are linked in one task, without rows for
    pairs or links: an interval is in every cell it meets, so each link is found in some cell, and
    components of several cells or keys are joined by the ids they share. Equal intervals count once
    there. Rows with a null stand alone. ``min_bp`` is 1 at least.
    """
    if min_bp < 1:
        raise ValueError("min_bp is 1 at least")
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*on, id_col, "s", "e")])
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("label", df.schema[id_col].dataType)])
    keys = [*on, "__bin"]

    def run(batches):
        for table in by_groups(batches, keys, 1 << 18):
            s, e = (table.column(c).to_numpy() for c in ("s", "e"))
            label = _linked(np.cumsum(starts(table, keys)), s, e, min_bp, min_share)
            ids = table.column(id_col).combine_chunks()
            many = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            if len(many):  # the least id of each component instead of its row
                order = many[pc.sort_indices(ids.take(many)).to_numpy()]
                least = np.arange(len(label))
                least[label[order[::-1]]] = order[::-1]
                label = least[label]
            yield from pa.Table.from_arrays([ids, ids.take(label)], names=[id_col, "label"]).to_batches(max_chunksize=1 << 15)

    rows = _binned(df.where(known).select(*on, id_col, F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")), "s", "e", cell)
    linked = rows.repartition(*keys).sortWithinPartitions(*keys, "s", "e").mapInArrow(run, schema)
    alone = df.where(~known).select(id_col, F.col(id_col).alias("label"))
    return merge_labels(linked.unionByName(alone), id_col)


def best_overlap(a: DataFrame, b: DataFrame, on: list[str], a_id: str, b_id: str) -> DataFrame:
    """For each a the b with the most shared bp over all its blocks; ties to the smaller id."""
    total = overlap_join(a, b, on).groupBy(a_id, f"{b_id}_b").agg(F.sum("bp").alias("bp"))
    w = Window.partitionBy(a_id).orderBy(F.col("bp").desc(), f"{b_id}_b")
    return total.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(a_id, F.col(f"{b_id}_b").alias(b_id), "bp")


def strand_class(a: DataFrame, b: DataFrame, on: list[str], a_id: str, b_id: str, partners: int = 5) -> DataFrame:
    """intergenic, antisense, sense_overlapping or antisense+sense, with the number of hits and up to ``partners`` partners."""
    pairs = overlap_join(a, b, on)
    same = F.col("strand") == F.col("strand_b")
    hits = pairs.groupBy(a_id).agg(
        F.max(same).alias("sense"), F.max(~same).alias("anti"), F.count(F.lit(1)).alias("n_hits"), F.slice(F.sort_array(F.collect_set(f"{b_id}_b")), 1, partners).alias("partners")
    )
    found = a.select(a_id).distinct().join(hits, a_id, "left")
    kind = F.when(F.col("anti") & F.col("sense"), "antisense+sense").when(F.col("anti"), "antisense").when(F.col("sense"), "sense_overlapping").otherwise("intergenic")
    return found.select(a_id, kind.alias("kind"), F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"), F.array_join("partners", ",").alias("partners"))


def flank(df: DataFrame, before: Column | int, after: Column | int, size: Column | None = None) -> DataFrame:
    """Padded intervals, held within [0, size]."""
    b, a = (x if isinstance(x, Column) else F.lit(x) for x in (before, after))
    end = F.col("e") + a
    return df.withColumns({"s": F.greatest(F.lit(0), F.col("s") - b), "e": F.least(end, size) if size is not None else end})


def lift_over(df: DataFrame, blocks: DataFrame, id_cols: list[str], max_ratio: float = 25.0) -> DataFrame:
    """Piecewise-linear projection through aligned blocks (chain_id, chrom, s, e, q_s, q_size, q_strand).

    Pieces are mapped one by one; the result is their span. Statuses: ok, and expanded where the
    result is longer than ``max_ratio`` times the source. Intervals without a block give no row.
    """
    hit = overlap_join(df, blocks, ["chrom"])
    lo, hi = F.greatest("s", "s_b"), F.least("e", "e_b")
    a, b = F.col("q_s_b") + lo - F.col("s_b"), F.col("q_s_b") + hi - F.col("s_b")
    minus = F.col("q_strand_b") < 0
    hit = hit.withColumns({"q0": F.when(minus, F.col("q_size_b") - b).otherwise(a), "q1": F.when(minus, F.col("q_size_b") - a).otherwise(b)})
    lifted = hit.groupBy(*id_cols, F.col("chain_id_b").alias("chain_id")).agg(F.min("q0").alias("q_s"), F.max("q1").alias("q_e"), F.first("s").alias("s"), F.first("e").alias("e"))
    status = F.when((F.col("q_e") - F.col("q_s")) > (F.col("e") - F.col("s")) * F.lit(max_ratio), "expanded").otherwise("ok")
    return lifted.withColumn("status", status).drop("s", "e")


def split_at_gaps(blocks: DataFrame, id_col: str, most: int) -> DataFrame:
    """Numbers the children of each chain by a grid of ``most`` positions from the chain's first block.

    A block belongs to the child in whose cell it begins, so chains are cut at the gaps between
    blocks, never within one. The grid makes the cut independent of the order of evaluation; it
    stands for the reference's splitter, an outside library, and like it only bounds a child's extent.
    """
    w = Window.partitionBy(id_col)
    return blocks.withColumn("child", F.floor((F.col("s") - F.min("s").over(w)) / most))


def spliced_to_genomic(ranges: DataFrame, exons: DataFrame, id_col: str) -> DataFrame:
    """Ranges [a, b) on the spliced sequence as genomic segments, in exon order of the strand.

    ``segment`` numbers the segments of each range (id, a, b) from 0. Exons that share an id are one
    transcript, spliced in order of start, then end; a range given twice gives its segments twice.
    """
    order = F.when(F.col("strand") > 0, F.col("s")).otherwise(-F.col("s"))
    w = Window.partitionBy(id_col).orderBy(order, "e")
    length = F.col("e") - F.col("s")
    placed = exons.withColumn("off", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = ranges.join(placed, id_col).where((F.col("a") < F.col("off") + length) & (F.col("off") < F.col("b")))
    x, y = F.greatest(F.col("a") - F.col("off"), F.lit(0)), F.least(F.col("b") - F.col("off"), length)
    plus = F.col("strand") > 0
    hit = hit.select(id_col, "a", "b", "off", F.when(plus, F.col("s") + x).otherwise(F.col("e") - y).alias("g_s"), F.when(plus, F.col("s") + y).otherwise(F.col("e") - x).alias("g_e"))
    return hit.withColumn("segment", F.row_number().over(Window.partitionBy(id_col, "a", "b").orderBy("off")) - 1).drop("off")


def fuzzy_match(a: DataFrame, b: DataFrame, on: list[str], a_id: str, b_id: str, slack: int = 50) -> DataFrame:
    """Exact coordinates first; what has none takes the nearest within ``slack`` at both ends."""
    exact = a.join(b.select(*on, "s", "e", F.col(b_id)), [*on, "s", "e"]).groupBy(a_id).agg(F.min(b_id).alias(b_id)).withColumn("kind", F.lit("exact"))
    rest = a.join(exact, a_id, "left_anti")
    near = overlap_join(flank(rest, slack, slack).withColumns({"s0": F.col("s") + slack, "e0": F.col("e") - slack}), b, on)
    near = near.withColumn("d", F.greatest(F.abs(F.col("s0") - F.col("s_b")), F.abs(F.col("e0") - F.col("e_b")))).where(F.col("d") <= slack)
    w = Window.partitionBy(a_id).orderBy("d", f"{b_id}_b")
    near = near.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(a_id, F.col(f"{b_id}_b").alias(b_id), F.lit("near").alias("kind"))
    return exact.unionByName(near)
