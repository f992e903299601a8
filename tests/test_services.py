"""Small cases of job services, raw scans and collinear chains."""

from __future__ import annotations

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.functions import scalar as sc
from helixlake.operators import alignment as al
from helixlake.operators import vectors as vx
from helixlake.operators import windows as wn
from helixlake.sources import readers
from helixlake.streaming import monitor


def test_bed_lengths_of_odd_lines(spark):
    lines = ["", "# note", "c\t1\t9\ta", "c\t1\t9\tb\t0\t+\t1\t9\t0\t2\t3,4,\t0,5,", "c\t1\t9\tz\t0\t+\t1\t9\t0\t1\t0,\t0,", "c\tx\t9\tbad", "c\t1"]
    got = readers.bed_lengths(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {(r["name"], r["length"]) for r in got} == {("a", 8), ("b", 7), ("z", 8)}


def test_failed_jobs_become_rows(spark):
    jobs = spark.createDataFrame([(1, "2.5"), (2, "x"), (3, None)], "id int, arg string")
    got = {r["id"]: (r["result"], r["status"]) for r in monitor.guarded(jobs, "arg", float).collect()}
    assert got == {1: (2.5, "ok"), 2: (None, "error: ValueError"), 3: (None, "error: TypeError")}


def test_micro_batches_hold_the_limit(spark):
    sizes = monitor.micro_batches(spark.range(0, 25, 1, 2), lambda p: p.assign(id=len(p)), "id long", 4)
    assert sizes.agg(F.max("id"), F.count("*")).first() == (4, 25)


def test_progress():
    assert monitor.progress_due(100, 1000, 0.0) and monitor.progress_due(7, 1000, 30.0) and monitor.progress_due(901, 1000, 0.0)
    assert not monitor.progress_due(7, 1000, 29.0) and not monitor.progress_due(900 - 1, 1000, 0.0)


def test_elapsed_and_matched_region(spark):
    row = spark.range(1).select(sc.elapsed(F.lit(3723)).alias("t"), sc.matched_region(F.lit(2), F.lit(5), F.lit(100), 4, 96).alias("r")).first()
    assert tuple(row["t"]) == (1, 2, 3) and tuple(row["r"]) == (8, 100)


def test_random_windows_fit_and_repeat(spark):
    df = spark.createDataFrame([(1, 72), (2, 500), (3, 71)], "id long, n int")
    first = wn.random_windows(df, F.col("id"), F.col("n"), 72, 5).collect()
    assert first == wn.random_windows(df, F.col("id"), F.col("n"), 72, 5).collect()
    assert len(first) == 10 and all(0 <= r["s"] <= r["n"] - 72 for r in first)


@given(st.lists(st.integers(0, 9), max_size=12))
def test_least_tails_give_the_length(values):
    tails: list[int] = []
    for v in values:  # the rule that the JVM expression follows
        above = [t for t in tails if t > v]
        tails = [t for t in tails if t <= v] + [v] + above[1:]
    assert len(tails) == len(al.longest_run(values))


def test_run_length_column(spark):
    rows = [([],), ([3.0],), ([1.0, 1.0, 0.0, 2.0],), ([5.0, 4.0, 3.0],), ([2.0, 9.0, 3.0, 8.0, 4.0, 5.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(al.longest_run_length("v")).collect()]
    assert got == [len(al.longest_run(v)) for (v,) in rows]


def test_crossers_go_and_groups_without_path_fall_back(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 9), ("a", 2, 1), ("a", 3, 2)], "g string, j long, i long")
    assert sorted(r["i"] for r in al.drop_crossers(df, "g", "j", "i").collect()) == [0, 1, 2]
    cells = [("near", i, j, 0.01 if i == j else 1.0) for i in range(4) for j in range(4)] + [("far", i, j, 0.9 - 0.1 * (j - i == 1)) for i in range(4) for j in range(4)]
    cells = spark.createDataFrame(cells, "g string, i long, j long, mmd double")
    got = {r["g"]: r for r in al.with_fallback(al.align(cells, "g"), al.best_diagonal(cells, "g", 3), "g").collect()}
    assert got["near"]["kind"] == "path" and got["far"]["kind"] == "diagonal"
    assert (got["far"]["i_from"], got["far"]["j_from"]) == (0, 4) and round(got["far"]["mmd"], 6) == 0.8


def test_two_sample_distance_by_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(9, 3)), rng.normal(1.0, size=(7, 3))
    rows = [(i, 0, v.tolist()) for i, v in enumerate(x)] + [(i + 100, 1, v.tolist()) for i, v in enumerate(y)]
    got = vx.mmd2(spark.createDataFrame(rows, "id long, g int, v array<double>"), "g", 0, 1, "id", "v", 0.5).first()[0]
    k = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(-1))
    want = (k(x, x).sum() - 9) / 72 + (k(y, y).sum() - 7) / 42 - 2 * k(x, y).mean()
    assert abs(got - want) < 1e-9


def test_logistic_fit_learns_every_component(spark):
    from helixlake.plans.catalog import queries

    got = [r["weight"] for r in queries()["emb5_logistic_fit"](spark, "/root/testdata/sf0.001").orderBy("term").collect()]
    assert len(got) == 65 and all(got)
