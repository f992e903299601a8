"""Relational analytics: funnels, crosstabs, pivots, quantiles, bins, rank statistics, classifier metrics."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stages(df: DataFrame, conditions: dict[str, Column], name: str = "stage") -> DataFrame:
    """One pass: (ord, stage, n) of nested conditions."""
    passed, aggs = F.lit(True), []
    for i, (label, condition) in enumerate(conditions.items()):
        passed = passed & F.coalesce(condition, F.lit(False))
        aggs.append(F.struct(F.lit(i).alias("ord"), F.lit(label).alias(name), F.count_if(passed).alias("n")))
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def funnel(counts: DataFrame) -> DataFrame:
    """Adds the share of the first stage and the loss against the stage before."""
    w = Window.orderBy("ord")  # one row per stage
    first, before = F.first("n").over(w), F.lag("n").over(w)
    return counts.withColumns({"pct_first": F.lit(100.0) * F.col("n") / first, "lost": F.coalesce(before - F.col("n"), F.lit(0))})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) without the null group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("t")).alias("share"))  # total is one row


def crosstab(df: DataFrame, a: str, b: str, total: str = "All") -> DataFrame:
    """Counts for every pair with margins."""
    cube = df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    return cube.select(F.when(F.col("ga") == 1, total).otherwise(F.col(a)).alias(a), F.when(F.col("gb") == 1, total).otherwise(F.col(b)).alias(b), "n")


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*by).agg(*(F.percentile(value, F.lit(p)).alias(n) for n, p in points.items()))


def binned_rates(df: DataFrame, value: str, edges: list[float], labels: list[str], hit: Column) -> DataFrame:
    """Left-closed bins, empty ones kept: (bin, label, n, hits, rate)."""
    spark = df.sparkSession
    index = reduce(lambda acc, i: acc.when((F.col(value) >= edges[i]) & (F.col(value) < edges[i + 1]), i), range(len(labels)), F.when(F.lit(False), -1))
    counts = df.withColumn("bin", index).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    dim = spark.createDataFrame(list(enumerate(labels)), "bin int, label string")
    zero = F.lit(0).cast("bigint")
    joined = dim.join(counts, "bin", "left").select("bin", "label", F.coalesce("n", zero).alias("n"), F.coalesce("hits", zero).alias("hits"))
    return joined.withColumn("rate", F.when(F.col("n") > 0, F.col("hits") / F.col("n")))


def right_closed(value: Column, edges: list[float]) -> Column:
    """Index of the bin (edge, next]; null outside."""
    return reduce(lambda acc, i: acc.when((value > edges[i]) & (value <= edges[i + 1]), i), range(len(edges) - 1), F.when(F.lit(False), -1))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts of equal bins over [lo, hi]; the last bin holds hi."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / ((hi - lo) / bins)))
    return df.where(F.col(value).between(lo, hi)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def reach_curve(df: DataFrame, per: str, member: str, most: int) -> DataFrame:
    """Share of ``per`` keys that are seen with at least k distinct members, k = 1..most."""
    # more than ``most`` members count as ``most``, so the broadcast side has at most that many rows
    n = df.groupBy(per).agg(F.least(F.countDistinct(member), F.lit(most)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    k = df.sparkSession.range(1, most + 1).select(F.col("id").alias("k"))
    return k.join(F.broadcast(n), F.lit(True), "cross").groupBy("k").agg((F.sum(F.when(F.col("n") >= F.col("k"), F.col("keys")).otherwise(0)) / F.sum("keys")).alias("share"))


def sweep(df: DataFrame, thresholds: dict[str, Column]) -> DataFrame:
    """(setting, n): rows that pass each condition, in one pass."""
    return df.agg(F.array(*(F.struct(F.lit(k).alias("setting"), F.count_if(c).alias("n")) for k, c in thresholds.items())).alias("all")).select(F.inline("all"))


def confusion(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1."""
    c = df.agg(F.count_if(label & predicted).alias("tp"), F.count_if(~label & predicted).alias("fp"), F.count_if(label & ~predicted).alias("fn"), F.count_if(~label & ~predicted).alias("tn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return c.select("*", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


def _score_counts(df: DataFrame, score: str, label: Column) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))


def running_sums(df: DataFrame, order: str, columns: list[str], ranges: int = 64) -> DataFrame:
    """Adds {c}_before and {c}_total: the sums of each column over all rows of smaller ``order``, and over all rows.

    ``order`` must be distinct. Rows are dealt to ranges by approximate quantiles, summed up within
    each range, and the ranges' totals (``ranges`` rows at most) carry over; no task sees all rows.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    rows = df.withColumn("__range", F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(order).cast("double"))), F.lit(0)))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    totals = totals.select(
        "__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns), *(F.sum(f"__{c}").over(Window.partitionBy()).alias(f"{c}_total") for c in columns)
    )
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(totals), "__range")  # at most ``ranges`` rows
    return rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{c}") for c in columns}).drop("__range", *(f"__{c}" for c in columns))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """Rank-sum area under the curve; ties share their rank. Rows are counted per distinct score before they are ordered."""
    terms = running_sums(_score_counts(df, score, label), "score", ["neg"])
    return terms.agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0).cast("double"))) / (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def roc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """(score, tpr, fpr) at each distinct threshold, highest first."""
    c = running_sums(_score_counts(df, score, label), "score", ["pos", "neg"])
    rate = lambda x: (F.col(f"{x}_total") - F.col(f"{x}_before")) / F.col(f"{x}_total")
    return c.select("score", rate("pos").alias("tpr"), rate("neg").alias("fpr"))


def average_rank(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho) over average ranks."""
    ranked = df.withColumns({"rx": average_rank(x, by), "ry": average_rank(y, by)})
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c, d = 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or 1e-300)
            c = 1.0 + step / c or 1e-300
            h *= c * d
        if abs(c * d - 1.0) < 1e-13:
            break
    return h


def rank_correlation_p(rho: float | None, n: int) -> float | None:
    """Two-sided p-value of a rank correlation by the t approximation."""
    if rho is None or n < 3 or math.isnan(rho):
        return None
    if abs(rho) >= 1:
        return 0.0
    free = n - 2
    t2 = rho * rho * free / (1 - rho * rho)
    x, a, b = free / (free + t2), free / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p(df: DataFrame) -> DataFrame:
    """Adds p to (rho, n) rows with an Arrow function: one row per group."""
    @F.pandas_udf("double")
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([rank_correlation_p(None if pd.isna(r) else float(r), int(k)) for r, k in zip(rho, n, strict=True)], dtype="float64")

    return df.withColumn("p", p("rho", "n"))


def decay_class(n: Column, rho: Column, p: Column, near: Column, far: Column) -> Column:
    """too_few, flat, gradual, sharp or sporadic."""
    change = far - near
    return (
        F.when(n < 4, "too_few")
        .when(F.abs(change) < 0.10, "flat")
        .when((p < 0.05) & (rho > 0.5), "gradual")
        .when(change > 0.08, "sharp")
        .otherwise("sporadic")
    )


def remap(df: DataFrame, rules: dict) -> DataFrame:
    """Replaces columns by what each rule (a function of a Column) makes of them; rules stay in the JVM."""
    return df.withColumns({name: rule(F.col(name)) for name, rule in rules.items()})
