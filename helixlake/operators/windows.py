"""Ranking, ordering, smoothing, runs and deterministic sampling over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key (argmin dedupe, top-k, drop duplicates keep first)."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", rn).where(F.col("__rn") <= n).drop("__rn")


def ordinal(df: DataFrame, by: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """Position from 0 within the key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))


def box_smooth(df: DataFrame, by: list[str], order: list, value: str, width: int = 5, name: str = "smooth") -> DataFrame:
    """Sum of the ``width`` values around each row over ``width``, zeros beyond the ends."""
    half = width // 2
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-half, half)) / float(width))


def mask_runs(df: DataFrame, by: list[str], pos: str, on: Column, stride: int, window: int, values: str | None = None) -> DataFrame:
    """Runs of consecutive positions (numbered from 0) that are on: (by, run, s, e, n[, top, mean])."""
    w = Window.partitionBy(*by).orderBy(pos)
    picked = df.where(on).withColumn("run", F.col(pos) - F.row_number().over(w))
    extra = [F.max(values).alias("top"), F.avg(values).alias("mean")] if values else []
    return picked.groupBy(*by, "run").agg((F.min(pos) * stride).alias("s"), (F.max(pos) * stride + window).alias("e"), F.count(F.lit(1)).alias("n"), *extra)


def next_overlaps(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``clash``: the next interval of the key begins before this one ends.

    The next one is looked for within a cell of positions; the last row of a cell takes the first
    start of the next cell from a window over one row per cell.
    """
    from helixlake.operators.intervals import CELL, _carried

    rows = df.withColumn("__cell", F.floor(F.col("s") / CELL))
    firsts = rows.groupBy(*by, "__cell").agg(F.min("s").alias("__first"))
    rows = _carried(rows, firsts.select(*by, "__cell", F.lead("__first").over(Window.partitionBy(*by).orderBy("__cell")).alias("__next")), by)
    nxt = F.coalesce(F.lead("s").over(Window.partitionBy(*by, "__cell").orderBy("s", "e")), F.col("__next"))
    return rows.withColumn("clash", F.coalesce(nxt < F.col("e"), F.lit(False))).drop("__cell", "__next")


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, strata: list[str], key: Column, cap: int, seed: int = 42, total: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each stratum in hash order, then at most ``total`` of all."""
    h = hash_order(key, seed)
    picked = df.withColumn("__h", h).withColumn("__rn", F.row_number().over(Window.partitionBy(*strata).orderBy("__h"))).where(F.col("__rn") <= cap)
    picked = picked.orderBy("__h").limit(total) if total is not None else picked
    return picked.drop("__h", "__rn")


def split(df: DataFrame, strata: list[str], key: Column, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``part``: train for the first ``share`` of each stratum in hash order, else test."""
    w = Window.partitionBy(*strata).orderBy("__h")
    ranked = df.withColumn("__h", hash_order(key, seed)).withColumn("__p", F.percent_rank().over(w))
    return ranked.withColumn("part", F.when(F.col("__p") < share, "train").otherwise("test")).drop("__h", "__p")


def upsert(versions: DataFrame, key: list[str], seq: list[str], merged: list[str] | None = None) -> DataFrame:
    """Latest row of each key; columns in ``merged`` keep their latest value that is not null."""
    order = F.struct(*seq)
    columns = [c for c in versions.columns if c not in key]
    pick = [(F.max_by(c, F.when(F.col(c).isNotNull(), order)) if merged and c in merged else F.max_by(c, order)).alias(c) for c in columns]
    return versions.groupBy(*key).agg(*pick)


def random_windows(df: DataFrame, key: Column, length: Column, width: int, n: int, seed: int = 42) -> DataFrame:
    """``n`` windows (k, s) of each row's sequence at places that a seeded hash of (key, k) gives; none for shorter sequences."""
    at = df.where(length >= width).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.col("k"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return at.withColumn("s", drawn % (length - (width - 1)))
