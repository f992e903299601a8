"""Queries that SQL does not express, against plain versions of their own in NumPy and pandas."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pytest

from helixlake.operators import alignment as al
from helixlake.operators import analytics as an
from helixlake.operators import intervals as iv
from helixlake.operators import vectors as vx
from helixlake.plans import catalog
from helixlake.streaming import monitor


def run(spark, sf, name):
    return catalog.queries()[name](spark, sf).toPandas()


@pytest.fixture(scope="module")
def embeddings(sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    return e.assign(x=[np.array(v, float) for v in e["embedding"]])


@pytest.fixture(scope="module")
def cells(embeddings):
    """By label, the matrix of distances of the even and the odd vectors in order."""
    out = {}
    for label, g in embeddings.sort_values("vec_id").groupby("label"):
        a, b = (np.stack(g[g["vec_id"] % 2 == k]["x"].to_list()) for k in (0, 1))
        out[label] = ((a[:, None] - b[None]) ** 2).sum(axis=2) / 20
    return out


def best_from(gain, blocked, drift, gap_open, gap_extend):
    """The best score of any path, by recursion from each cell onwards: a path is never worth less than nothing."""
    n, m = gain.shape

    @functools.cache
    def onwards(i, j):
        if i >= n or j >= m or blocked[i, j]:
            return -math.inf
        tails = [0.0, onwards(i + 1, j + 1)]
        for d in range(2, drift + 1):
            cost = gap_open + gap_extend * (d - 2)
            tails += [onwards(i + 1, j + d) - cost, onwards(i + d, j + 1) - cost]
        return gain[i, j] + max(tails)

    return max((onwards(i, j) for i in range(n) for j in range(m)), default=0.0)


def worth(gain, path, gap_open, gap_extend):
    total = sum(gain[p] for p in path)
    for (i, j), (k, m) in zip(path[:-1], path[1:], strict=True):
        step = sorted((k - i, m - j))
        assert step[0] == 1 and step[1] <= 3
        total -= gap_open + gap_extend * (step[1] - 2) if step[1] > 1 else 0
    return total


def check_paths(d, found, chains):
    gain, blocked, first = 0.15 - d, np.zeros(d.shape, bool), None
    for score, path in found:
        best = best_from(gain, blocked, 3, 0.03, 0.01)
        assert score == pytest.approx(best) == pytest.approx(worth(gain, path, 0.03, 0.01))
        assert not any(blocked[p] for p in path)
        first = first or score
        assert score >= 0.3 * first
        for i, j in path:
            blocked[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2] = True
    if len(found) < chains:
        left = best_from(gain, blocked, 3, 0.03, 0.01)
        assert left <= 0 or left < 0.3 * first


def test_local_paths_against_recursion():
    rng = np.random.default_rng(4)
    for _ in range(60):
        d = rng.uniform(0, 0.4, size=rng.integers(1, 9, 2))
        check_paths(d, al.local_paths(d, chains=3), 3)
    assert al.local_paths(np.zeros((0, 0)), chains=3) == [] and al.local_paths(np.ones((3, 3))) == []


def test_a_step_is_at_most_the_drift():
    d = np.ones((5, 2))
    d[0, 0] = d[4, 1] = 0.0
    assert [p for _, p in al.local_paths(d)] == [[(0, 0)]]  # four rows on is too far
    d = np.ones((4, 2))
    d[0, 0] = d[3, 1] = 0.0
    (score, path), = al.local_paths(d)
    assert path == [(0, 0), (3, 1)] and score == pytest.approx(0.3 - 0.04)


@pytest.mark.parametrize(("name", "chains"), [("aln2_local_alignment", 1), ("aln3_many_chains", 3)])
def test_alignment_queries(spark, sf, cells, name, chains):
    got = run(spark, sf, name)
    rows = 0
    for label, d in cells.items():
        mine = got[got["label"] == label].sort_values("chain")
        found = al.local_paths(d, chains=chains)
        check_paths(d, found, chains)
        rows += len(found)
        for (score, path), r in zip(found, mine.itertuples(), strict=True):
            assert r.score == pytest.approx(score * 4 / 96, abs=1e-6) and r.nt == 92 + 4 * len(path)
            if chains == 1:
                assert r.mmd == pytest.approx(np.mean([d[p] for p in path]), abs=1e-6)
                assert (r.i_from, r.i_to, r.j_from, r.j_to) == (path[0][0] * 4, path[-1][0] * 4 + 96, path[0][1] * 4, path[-1][1] * 4 + 96)
    assert len(got) == rows


def longest(values):
    """Length of a longest non-strictly rising subsequence, quadratically."""
    n = []
    for i, v in enumerate(values):
        n.append(1 + max((n[k] for k in range(i) if values[k] <= v), default=0))
    return max(n, default=0)


def test_collinear_matches_query(spark, sf, cells):
    got = run(spark, sf, "aln5_collinear_matches")
    for label, d in cells.items():
        left = sorted((round(float(d[i, j]), 6), i, j) for i in range(d.shape[0]) for j in range(d.shape[1]))
        taken, rows, columns = [], [0] * d.shape[0], [0] * d.shape[1]
        for mmd, i, j in left:
            if rows[i] < 2 and columns[j] < 1:
                rows[i], columns[j] = rows[i] + 1, columns[j] + 1
                taken.append((i, j, mmd))
        mine = got[got["label"] == label].sort_values(["r", "q"])
        kept = list(mine[["r", "q", "mmd"]].itertuples(index=False, name=None))
        assert {(r, q) for r, q, _ in kept} <= {(i, j) for i, j, _ in taken}
        assert all(a[1] <= b[1] for a, b in zip(kept, kept[1:], strict=False))
        assert len(kept) == longest([j for _, j, _ in sorted(taken)])
    assert set(got["label"]) == set(cells)


def test_crossers_query(spark, sf, cells):
    got = run(spark, sf, "aln7_drop_crossers")
    for label, d in cells.items():
        best = [(j, min((d[i, j], i) for i in range(d.shape[0]) if d[i, j] < 5)[1]) for j in range(d.shape[1]) if (d[:, j] < 5).any()]
        kept = list(got[got["label"] == label].sort_values("j")[["j", "i"]].itertuples(index=False, name=None))
        assert set(kept) <= set(best) and all(a[1] <= b[1] for a, b in zip(kept, kept[1:], strict=False))
        assert len(kept) == longest([i for _, i in best])


def test_fallback_query(spark, sf, cells):
    got = run(spark, sf, "aln8_rows_with_fallback").set_index("label")
    for label, d in cells.items():
        d, r = d / 40, got.loc[label]
        found = al.local_paths(d)
        if found:
            path = found[0][1]
            want = ("path", np.mean([d[p] for p in path]), path[0][0], path[-1][0], path[0][1], path[-1][1])
        else:
            runs = [
                (round(np.mean([d[i + k, i + k + g] for k in range(n)]), 9), g, i, i + n - 1)
                for g in range(-d.shape[0] + 1, d.shape[1]) for i in range(max(0, -g), d.shape[0]) for n in range(3, min(d.shape[0] - i, d.shape[1] - i - g) + 1)
            ]
            mean, g, i0, i1 = min(runs)
            want = ("diagonal", mean, i0, i1, i0 + g, i1 + g)
        assert r["kind"] == want[0] and r["mmd"] == pytest.approx(want[1], abs=1e-6)
        assert (r["i_from"], r["i_to"], r["j_from"], r["j_to"]) == (want[2] * 4, want[3] * 4 + 96, want[4] * 4, want[5] * 4 + 96)
    assert len(got) == len(cells)


def test_pca_query(spark, sf, embeddings):
    x = np.stack(embeddings["x"].to_list())
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    got = run(spark, sf, "emb3_pca_fit").sort_values("component")
    assert got["ratio"].to_numpy() == pytest.approx(values[:16] / values.sum(), abs=2e-6)


def test_logistic_fit_query(spark, sf, embeddings):
    x, y = np.stack(embeddings["x"].to_list()), (embeddings["label"] < 5).to_numpy(float)
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty, w = np.append(np.ones(64), 0.0), np.zeros(65)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
    got = run(spark, sf, "emb5_logistic_fit").sort_values("term")
    assert got["weight"].to_numpy() == pytest.approx(w, abs=5e-3)


def test_decay_query(spark, sf):
    e = pd.read_parquet(f"{sf}/events.parquet")
    got = run(spark, sf, "agg24_decay_classes").set_index("user_id")
    assert set(got.index) == set(e["user_id"])
    for user, g in e.groupby("user_id"):
        n, rho = len(g), g["event_id"].rank().corr(g["value"].rank())
        r = got.loc[user]
        assert r["n"] == n
        if n >= 3 and abs(rho) < 1:
            assert r["rho"] == pytest.approx(rho, abs=1e-6)
            t = abs(rho) * math.sqrt((n - 2) / (1 - rho * rho))
            angle = np.linspace(math.atan(t / math.sqrt(n - 2)), math.pi / 2, 20001)  # the tail of Student's density, by t = sqrt(free) tan
            density = np.cos(angle) ** (n - 3)
            tail = ((density[1:] + density[:-1]) / 2 * np.diff(angle)).sum() * math.gamma((n - 1) / 2) / (math.sqrt(math.pi) * math.gamma((n - 2) / 2))
            assert r["p"] == pytest.approx(2 * tail, abs=2e-5)
        g = g.sort_values("ts")
        change = (g["value"].iloc[-1] - g["value"].iloc[0]) / 100
        p = an.rank_correlation_p(None if math.isnan(rho) else rho, n)
        rising = p is not None and p < 0.05 and rho > 0.5
        want = "too_few" if n < 4 else "flat" if abs(change) < 0.1 else "gradual" if rising else "sharp" if change > 0.08 else "sporadic"
        assert r["kind"] == want


def test_kernels_agree(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    sums = [dict(tuple(r) for r in vx.kernel_sums(e, "label", "embedding", 0.5, kernel, tile_rows=7).collect()) for kernel in ("numpy", "jvm")]
    assert sums[0].keys() == sums[1].keys() and all(sums[0][k] == pytest.approx(sums[1][k]) for k in sums[0])
    with pytest.raises(ValueError):
        vx.kernel_sums(e, "label", "embedding", 0.5, "other")


def test_shared_transcript_ids(spark):
    """Two transcripts of one id: exons are spliced together, and segments are numbered within each range."""
    exons = spark.createDataFrame([("t", 0, 10, 1), ("t", 20, 30, 1), ("t", 20, 25, 1), ("u", 5, 9, -1)], "tid string, s bigint, e bigint, strand int")
    ranges = spark.createDataFrame([("t", 5, 12), ("t", 5, 20), ("u", 1, 3)], "tid string, a int, b int")
    got = sorted(tuple(r) for r in iv.spliced_to_genomic(ranges, exons, "tid").collect())
    assert got == [("t", 5, 12, 5, 10, 0), ("t", 5, 12, 20, 22, 1), ("t", 5, 20, 5, 10, 0), ("t", 5, 20, 20, 25, 1), ("t", 5, 20, 20, 25, 2), ("u", 1, 3, 6, 8, 0)]


def test_left_overlap_keeps_rows_without_a_hit(spark):
    a = spark.createDataFrame([("x", 0, 5, 1), ("x", 50, 60, 2), (None, 0, 5, 3), ("x", 50, 60, 4)], "k string, s bigint, e bigint, i int")
    b = spark.createDataFrame([("x", 3, 9)], "k string, s bigint, e bigint")
    got = {(r["i"], r["s_b"], r["bp"]) for r in iv.overlap_join(a, b, ["k"], how="left").collect()}
    assert got == {(1, 3, 2), (2, None, None), (3, None, None), (4, None, None)}
    assert {r["i"] for r in iv.overlap_semi(a, b, ["k"], anti=True).collect()} == {2, 3, 4}


def test_batch_sweep_stops_at_the_first_failure():
    calls = []

    def work(size):
        calls.append(size)
        if size > 200:
            raise MemoryError

    tried, suggested = monitor.sweep_batches(work, range(64, 1025, 64), warm_ups=1)
    assert tried == [(64, True), (128, True), (192, True), (256, False)] and suggested == 128 and calls.count(64) == 2


@pytest.mark.parametrize(("gap", "touching"), [(0, False), (0, True), (3, True)])
def test_groups_over_cells(spark, gap, touching):
    """Group numbers do not depend on the cells that rows are ordered in; null keys are a key."""
    rng = np.random.default_rng(6)
    rows = [(k, int(s), int(s + n)) for k in ("a", "b", None) for s, n in zip(rng.integers(-50, 300, 40), rng.choice([1, 2, 5, 60], 40), strict=True)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    want = []
    for key in ("a", "b", None):
        reach, number = None, 0
        for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if reach is None or (s > reach + gap if touching else s >= reach + gap):
                number += 1
            reach = e if reach is None else max(reach, e)
            want.append((key, s, e, number))
    for cell in (8, 64, 1 << 20):
        got = [tuple(r) for r in iv.with_groups(df, ["k"], gap, touching, cell=cell).select("k", "s", "e", "grp").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_next_overlap_over_cells(spark, monkeypatch):
    from helixlake.operators import windows as wn

    monkeypatch.setattr(iv, "CELL", 16)
    rows = [("a", 0, 40), ("a", 30, 31), ("a", 90, 95), ("a", 95, 99), ("b", 5, 200), ("b", 199, 300), (None, 1, 9), (None, 8, 10)]
    got = wn.next_overlaps(spark.createDataFrame(rows, "k string, s bigint, e bigint"), ["k"]).collect()
    assert {(r["k"], r["s"]) for r in got if r["clash"]} == {("a", 0), ("b", 5), (None, 1)} and len(got) == 8


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(8)
    score = np.unique(rng.normal(size=300))
    df = spark.createDataFrame([(float(x), int(n)) for x, n in zip(score, rng.integers(0, 9, len(score)), strict=True)], "score double, n bigint")
    for ranges in (1, 7, 64):
        got = sorted(tuple(r) for r in an.running_sums(df, "score", ["n"], ranges).select("score", "n", "n_before", "n_total").collect())
        n = np.array([r[1] for r in got])
        assert [r[2] for r in got] == list(np.cumsum(n) - n) and {r[3] for r in got} == {n.sum()}
    assert an.running_sums(df.limit(0), "score", ["n"]).count() == 0


def test_chains_of_any_store(spark, tmp_path):
    from helixlake.sources import readers

    chain = "chain 30000 chr1 1000 + 10 60 q 900 - 5 50 7\n20 10 5\n20\n"
    (tmp_path / "a.chain").write_text(f"# a note\n\n{chain}\nchain 10 chr1 1000 + 0 5 q 9 + 0 5 8\n5\n\n\n{chain.replace(' 7', ' 9')}")
    got = sorted(tuple(r) for r in readers.read_chains(spark, str(tmp_path)).select("chain_id", "block", "s", "e", "q_s", "q_strand", "score").collect())
    assert got == [(c, b, s, s + 20, q, -1, 30000) for c in (7, 9) for b, s, q in ((0, 10, 5), (1, 40, 30))]
    assert readers.read_chains(spark, str(tmp_path), 0).where("chain_id = 8").count() == 1
