"""Vector analytics: projection, logistic scoring, kernels and two-sample distances, sequence embedding.

Pair sums run in the JVM over exploded pairs inside a group where groups are small, and in NumPy
blocks (``mmd_matrix``) where two groups of windows meet.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from helixlake.functions.scalar import dot, logistic, squared_distance
from helixlake.operators.graphs import _cut

FAR, SKIPPED = 3.0, 1.0


def project(vector: str, mean: list[float], components: list[list[float]]) -> Column:
    """(x - mean) times each component."""
    centred = F.zip_with(F.col(vector), F.array(*map(F.lit, mean)), lambda x, m: x.cast("double") - m)
    return F.array(*(F.aggregate(F.zip_with(centred, F.array(*map(F.lit, c)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for c in components))


def logistic_score(vector: str, weights: list[float], intercept: float) -> Column:
    return logistic(dot(vector, F.array(*map(F.lit, weights))) + F.lit(intercept))


def fit_pca(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained variance ratio), in one pass.

    Each partition adds up its count, sums and products and gives one row; these are added in two
    levels, so the driver holds one matrix of d x d values whatever the input.
    """

    def partial(batches):
        n, total, products = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(np.float64)
                if total is None:
                    total, products = np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [total], "p": [products.ravel()]})

    def added(batches):
        rows = [r for b in batches for r in b.itertuples(index=False)]
        if rows:
            yield pd.DataFrame({"n": [sum(r.n for r in rows)], "s": [np.sum([r.s for r in rows], axis=0)], "p": [np.sum([r.p for r in rows], axis=0)]})

    schema = "n long, s array<double>, p array<double>"
    sums = df.where(F.col(vector).isNotNull()).select(vector).mapInPandas(partial, schema)
    for width in (64, 1):  # one row a partition, then 64 rows, then one
        sums = sums.repartition(width).mapInPandas(added, schema)
    got = sums.first()
    if got is None:
        raise ValueError("no vectors to fit")
    n, mean = got["n"], np.array(got["s"]) / got["n"]
    cov = (np.array(got["p"]).reshape(len(mean), -1) - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    comp = vectors[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
    return mean, comp, values[order] / values.sum()


def fit_logistic(df: DataFrame, features: list[str], label: str, balanced: bool = True, c: float = 1.0):
    """Logistic regression with classes weighted evenly; the penalty equals that of an inverse strength c."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col(label) == 1, n / (2.0 * counts.get(1, 1))).otherwise(n / (2.0 * counts.get(0, 1)))
    data = VectorAssembler(inputCols=features, outputCol="__features").transform(df).withColumn("__weight", weight)
    return LogisticRegression(featuresCol="__features", labelCol=label, weightCol="__weight", regParam=1.0 / (c * n), standardization=False).fit(data)


def pair_distances(a: DataFrame, b: DataFrame, on: list[str], vector: str = "v") -> DataFrame:
    """Squared distances of all pairs of a group; windows of one group only, so sizes are those of a sequence."""
    right = b.select(*on, F.col("pos").alias("pos_b"), F.col(vector).alias("__w"))
    return a.join(right, on).select(*on, "pos", "pos_b", squared_distance(vector, "__w").alias("d2"))


def squared_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed coordinate by coordinate as ``squared_distance`` does."""
    out = np.zeros((len(x), len(y)))
    columns = np.ascontiguousarray(y.T)
    for lo in range(0, len(x), 64):  # a block stays in the cache
        part = out[lo : lo + 64]
        for k, column in enumerate(columns):
            d = x[lo : lo + 64, k, None] - column
            d *= d
            part += d
    return out


def gamma(df: DataFrame, by: str, pos: str, vector: str, positive_only: bool = False, tile_rows: int = 1024) -> DataFrame:
    """(by, gamma): median heuristic 1 / (2 median^2 + 1e-10) over the distances of all pairs of a group with different ``pos``.

    The median is exact and no pair becomes a row: tiles of a group meet pairwise and count their
    distances by the leading bits (exponent and 12 bits of the mantissa), then the distances that
    share these bits with the middle ones are counted one by one. Vectors that are null or hold null
    take no part; groups without a pair give no row.
    """
    usable = F.col(by).isNotNull() & F.col(pos).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    rows = df.where(usable).select(F.col(by).alias("key"), F.size(vector).alias("width"), F.xxhash64(pos).alias("h"), F.col(pos).alias("pos"), F.col(vector).cast("array<double>").alias("v"))
    tiles = rows.groupBy("key", "width").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("n"))
    dealt = rows.join(tiles, ["key", "width"]).withColumn("t", F.pmod("h", "n").cast("int"))
    at, other = ["key", "width", "p", "q"], ["key_b", "width_b", "p_b", "q_b"]
    kind = df.schema[by].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the pairs: small inputs are not put together
    right = dealt.select(F.col("key").alias("key_b"), F.col("width").alias("width_b"), F.explode(F.sequence(F.lit(0), "t")).alias("p_b"), F.col("t").alias("q_b"), F.col("pos").alias("pos_b"), F.col("v").alias("w"))
    right = right.repartition(parts, *other)

    def counted(names: str, count, targets: DataFrame | None = None) -> DataFrame:
        left = dealt.select("key", "width", F.col("t").alias("p"), F.explode(F.sequence("t", F.col("n") - 1)).alias("q"), "pos", "v")
        left = (left if targets is None else left.join(targets, "key")).repartition(parts, *at)

        def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"key": [], names: [], "n": []})
            d = squared_block(np.stack(a["v"].to_numpy()), np.stack(b["w"].to_numpy()))
            d = np.abs(d[a["pos"].to_numpy()[:, None] != b["pos_b"].to_numpy()[None]])
            values, n = count(d[d > 0] if positive_only else d, a)
            return pd.DataFrame({"key": [key[0]] * len(n), names: values, "n": n if key[2] == key[3] else 2 * n})

        found = left.groupBy(*at).cogroup(right.groupBy(*other)).applyInPandas(run, f"key {kind}, {names} {'long' if targets is None else 'double'}, n long")
        order = Window.partitionBy("key").orderBy(names)
        return found.groupBy("key", names).agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy("key"))})

    def leading(d, a):
        return np.unique(d.view(np.int64) >> 40, return_counts=True)

    def near_middle(d, a):
        bits = d.view(np.int64) >> 40
        return np.unique(d[(bits == a["low"].iloc[0]) | (bits == a["high"].iloc[0])], return_counts=True)

    def middle(total):  # the middle ranks, from 0; one twice if the number is odd
        return F.floor((total - 1) / 2), F.floor(total / 2)

    def holding(rank, value):
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col(value)))

    low, high = middle(F.col("total"))
    first = F.min(F.when(F.col("upto") > low, F.col("upto") - F.col("n")))  # distances before the middle ones' bits
    targets = _cut(counted("bits", leading).groupBy("key").agg(holding(low, "bits").alias("low"), holding(high, "bits").alias("high"), first.alias("before"), F.first("total").alias("pairs")))
    values = counted("d2", near_middle, targets.select("key", "low", "high")).drop("total").join(targets.select("key", "before", "pairs"), "key")
    values = values.withColumn("upto", F.col("upto") + F.col("before"))
    low, high = middle(F.col("pairs"))
    median = values.groupBy("key").agg(((F.sqrt(holding(low, "d2")) + F.sqrt(holding(high, "d2"))) / 2).alias("med"))
    return median.select(F.col("key").alias(by), (F.lit(1.0) / (F.lit(2.0) * F.col("med") * F.col("med") + F.lit(1e-10))).alias("gamma"))


def whole(df: DataFrame, key: str, pos: str, vector: str) -> DataFrame:
    """Rows with a key, a position and a vector without null."""
    return df.where(F.col(key).isNotNull() & F.col(pos).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))


def cross_distances(a: DataFrame, b: DataFrame, key: str, tile_rows: int = 512, a_rows: int | None = None, reduced: tuple | None = None) -> DataFrame:
    """(key, i, j, d2): squared distances of each vector of a (key, i, x) to each of b (key, j, y) of its key.

    Tiles of both sides (``tile_rows``, for a ``a_rows``) meet in tasks of their own, so one key is many
    tasks. Pairs with a vector that is null or holds null give no row. ``reduced`` is (columns, function):
    what the function makes of (i, j, matrix of d2) of a tile takes the place of its pairs.
    """
    a, b = whole(a, key, "i", "x"), whole(b, key, "j", "y")
    tiles = lambda df, name, rows: df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = _cut(tiles(a, "__m", a_rows or tile_rows).join(tiles(b, "__n", tile_rows), key))

    def dealt(df, n, v, mine, other, name):
        at = df.join(sizes, key).withColumn("__t", F.pmod(F.xxhash64(n), mine).cast("int"))
        return at.select(F.col(key).alias(f"{name}k"), F.col("__t").alias(f"{name}t"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{name}u"), F.col(n).alias(n), F.col(v).cast("array<double>").alias(v))

    schema = StructType([a.schema[key], StructField("i", a.schema["i"].dataType), StructField("j", b.schema["j"].dataType), StructField("d2", DoubleType())])
    if reduced:
        schema = StructType([a.schema[key], *StructType.fromDDL(reduced[0])])
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(k, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = (t.column(c).to_numpy() for t, c in ((left, "i"), (right, "j")))
        if not len(i) or not len(j):
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=schema.names)
        x, y = (np.stack(t.column(c).to_pylist()) for t, c in ((left, "x"), (right, "y")))
        if reduced:
            made = reduced[1](i, j, squared_block(x, y))
            return pa.Table.from_arrays([pa.repeat(k[0], len(made[0])), *(pa.array(c, t) for c, t in zip(made, types[1:], strict=True))], names=schema.names)
        columns = [pa.repeat(k[0], len(i) * len(j)), np.repeat(i, len(j)), np.tile(j, len(i)), squared_block(x, y).ravel()]
        return pa.Table.from_arrays([c if n == 0 else pa.array(c, types[n]) for n, c in enumerate(columns)], names=schema.names)

    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = dealt(a, "i", "x", F.col("__m"), "__n", "l").repartition(parts, "lk", "lt", "lu")
    right = dealt(b, "j", "y", F.col("__n"), "__m", "r").repartition(parts, "rk", "ru", "rt")
    return left.groupBy("lk", "lt", "lu").cogroup(right.groupBy("rk", "ru", "rt")).applyInArrow(run, schema)


def mmd2(df: DataFrame, group: str, a, b, id_col: str, vector: str, gamma_value: float, tiles: int = 8) -> DataFrame:
    """Unbiased squared two-sample distance of two groups: within terms leave out the diagonal."""
    x = df.where(F.col(group) == a).select(F.col(id_col).alias("i"), F.col(vector).alias("x"))
    y = df.where(F.col(group) == b).select(F.col(id_col).alias("i"), F.col(vector).alias("x"))
    kernel = F.exp(F.lit(-gamma_value) * squared_distance("l.x", "r.x"))

    def dealt(df, mine, other):
        at = df.withColumn(mine, F.pmod(F.xxhash64("i"), F.lit(tiles)).cast("int"))
        return at.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def mean(p, q, diagonal):
        # each pair meets in the one tile (u, v) of its two rows, so tiles * tiles tasks share the work evenly
        pairs = dealt(p, "u", "v").alias("l").join(dealt(q, "v", "u").alias("r"), ["u", "v"])
        return (pairs if diagonal else pairs.where("l.i <> r.i")).agg(F.avg(kernel).alias("k"))

    parts = [mean(x, x, False).select(F.col("k").alias("xx")), mean(y, y, False).select(F.col("k").alias("yy")), mean(x, y, True).select(F.col("k").alias("xy"))]
    joined = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return joined.select((F.col("xx") + F.col("yy") - F.lit(2.0) * F.col("xy")).alias("mmd2"))


def mmd_numpy(x: np.ndarray, y: np.ndarray, g: float | None = None) -> float:
    """sqrt(max(0, unbiased MMD^2)); infinite for fewer than two rows on either side."""
    if len(x) < 2 or len(y) < 2:
        return float("inf")
    d = lambda a, b: np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)
    xx, yy, xy = d(x, x), d(y, y), d(x, y)
    if g is None:
        whole = np.sqrt(np.concatenate([xx.ravel(), xy.ravel(), xy.ravel(), yy.ravel()]))
        g = 1 / (2 * np.median(whole) ** 2 + 1e-10)
    kx, ky, kxy = np.exp(-g * xx), np.exp(-g * yy), np.exp(-g * xy)
    n, m = len(x), len(y)
    value = (kx.sum() - np.trace(kx)) / (n * (n - 1)) + (ky.sum() - np.trace(ky)) / (m * (m - 1)) - 2 * kxy.mean()
    return float(np.sqrt(max(0.0, value)))


def mmd_matrix(left: DataFrame, right: DataFrame, key: str, g: float | None = None, far: float = FAR) -> DataFrame:
    """(key, i, j, mmd) for every window of the left against every one of the right, per key.

    A window is a row (key, i, rows: array of vectors). Pairs whose means lie further apart than
    ``far`` get 1 without a kernel (the reference's rule); without ``g`` the median of the positive
    distances between every n // 8-th window of each side sets it (all windows of fewer than 16).
    """

    def run(k, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        xs = [np.stack(r).astype(float) for r in a.sort_values("i")["rows"]]
        ys = [np.stack(r).astype(float) for r in b.sort_values("i")["rows"]]
        gg = g
        if gg is None:
            some = np.concatenate([*xs[:: max(1, len(xs) // 8)], *ys[:: max(1, len(ys) // 8)]])
            d = np.sqrt(np.maximum(0, (some * some).sum(1)[:, None] + (some * some).sum(1)[None] - 2 * some @ some.T))
            d = d[d > 0]
            gg = 1 / (2 * np.median(d) ** 2 + 1e-10) if len(d) else 1.0
        rows = []
        for i, x in zip(sorted(a["i"]), xs, strict=True):
            for j, y in zip(sorted(b["i"]), ys, strict=True):
                apart = np.linalg.norm(x.mean(0) - y.mean(0)) > far or min(len(x), len(y)) < 2
                rows.append((k[0], i, j, SKIPPED if apart else mmd_numpy(x, y, gg)))
        return pd.DataFrame(rows, columns=[key, "i", "j", "mmd"])

    kind = left.schema[key].dataType.simpleString()
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(run, f"{key} {kind}, i long, j long, mmd double")


def kernel_sums(df: DataFrame, by: str, vector: str, g: float, kernel: str | None = None, tile_rows: int = 2048) -> DataFrame:
    """(by, total): the sum of exp(-g * squared distance) over all ordered pairs of a group, pairs with itself included.

    ``kernel`` is "numpy" (matrix products over tiles of a group) or "jvm" (an expression per pair);
    without it the environment variable HELIXLAKE_KERNEL decides, numpy by default. A group above
    ``tile_rows`` rows is dealt to tiles, each pair of which meets in one task.
    """
    kernel = kernel or os.environ.get("HELIXLAKE_KERNEL", "numpy")
    rows = df.where(F.col(vector).isNotNull()).select(by, F.col(vector).cast("array<double>").alias("v"))
    if kernel == "jvm":
        pairs = rows.join(rows.withColumnRenamed("v", "w"), by)
        return pairs.groupBy(by).agg(F.sum(F.exp(F.lit(-g) * squared_distance("v", "w"))).alias("total"))
    if kernel != "numpy":
        raise ValueError(f"no kernel {kernel}")
    tiles = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("n"))
    dealt = rows.join(tiles, by).withColumn("t", F.pmod(F.xxhash64("v"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = dealt.select(F.col(by).alias("key"), F.col("t").alias("p"), other.alias("q"), F.col("v").alias("x"))
    right = dealt.select(F.col(by).alias("key"), other.alias("p"), F.col("t").alias("q"), F.col("v").alias("y"))
    kind = df.schema[by].dataType.simpleString()

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({by: [], "part": []})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["y"].to_numpy())
        d = np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)
        return pd.DataFrame({by: [key[0]], "part": [float(np.exp(-g * d).sum())]})

    parts = left.groupBy("key", "p", "q").cogroup(right.groupBy("key", "p", "q")).applyInPandas(run, f"{by} {kind}, part double")
    return parts.groupBy(by).agg(F.sum("part").alias("total"))


def infer(df: DataFrame, column: str, load, name: str, kind: str) -> DataFrame:
    """Adds ``name``: the answers of a model to Arrow batches of ``column``. ``load`` runs once a task and gives a function of a Series."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch))

    return df.withColumn(name, run(F.col(column)))


def displacement(df: DataFrame, by: list[str], pos: str, vector: str) -> DataFrame:
    """Mean distance of each position's vector to its neighbours on both sides (ends have one)."""
    other = df.select(*by, F.col(pos).alias("__p"), F.col(vector).alias("__v"))
    near = df.withColumn("__p", F.explode(F.array(F.col(pos) - 1, F.col(pos) + 1))).join(other, [*by, "__p"])
    return near.groupBy(*by, pos).agg(F.avg(F.sqrt(squared_distance(vector, "__v"))).alias("shift"))


@functools.lru_cache(maxsize=1 << 16)
def _kmer(kmer: str) -> tuple[int, int]:
    h = hashlib.md5(kmer.encode(), usedforsecurity=False).digest()
    return h[0], 1 if h[1] & 1 else -1


def kmer_embedding(seq: str, k: int = 4, width: int = 16) -> list[float]:
    """A deterministic stand-in for model embeddings: signed hashed k-mer frequencies, unit length."""
    v = np.zeros(width)
    for kmer, n in Counter(map("".join, zip(*(seq[i:] for i in range(k)), strict=False))).items():
        at, sign = _kmer(kmer)
        v[at % width] += sign * n
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, seq: str, embedder=kmer_embedding, name: str = "v") -> DataFrame:
    """Adds the embedding of each sequence; any picklable str -> list of floats serves as the model (Arrow batches)."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: embedder(x) if x is not None else None)

    return df.withColumn(name, run(F.col(seq)))
