"""Small fixtures, traps and properties of operators that SQL does not cover."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.functions import scalar as sc
from helixlake.operators import alignment as al
from helixlake.operators import analytics as an
from helixlake.operators import intervals as iv
from helixlake.operators import vectors as vx
from helixlake.operators import windows as wn
from helixlake.sources import readers, writers
from helixlake.streaming import monitor


def test_merge_touching_and_strict(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 8, 12), ("b", 1, 2)], "k string, s bigint, e bigint")
    strict = sorted(tuple(r) for r in iv.merge(df, ["k"]).collect())
    touch = sorted(tuple(r) for r in iv.merge(df, ["k"], touching=True).collect())
    assert strict == [("a", 0, 5, 1), ("a", 5, 12, 2), ("b", 1, 2, 1)]
    assert touch == [("a", 0, 12, 3), ("b", 1, 2, 1)]
    again = iv.merge(iv.merge(df, ["k"]).drop("n"), ["k"])
    assert sorted(tuple(r)[:3] for r in again.collect()) == [x[:3] for x in strict]


def test_overlap_join_spans_bins_and_ignores_nulls(spark):
    a = spark.createDataFrame([("x", 0, 10000, 1), ("x", 9999, 10001, 2), (None, 0, 5, 3)], "k string, s bigint, e bigint, i int")
    got = sorted((r["i"], r["i_b"], r["bp"]) for r in iv.overlap_join(a, a, ["k"], width=64).collect())
    assert got == [(1, 1, 10000), (1, 2, 1), (2, 1, 1), (2, 2, 2)]


def test_identity_lift_over(spark):
    df = spark.createDataFrame([("t", "c", 100, 200)], "tid string, chrom string, s bigint, e bigint")
    for strand, want in ((1, (100, 200)), (-1, (800, 900))):
        b = spark.createDataFrame([(1, "c", 0, 500, 0, 1000, strand)], "chain_id int, chrom string, s bigint, e bigint, q_s bigint, q_size bigint, q_strand int")
        r = iv.lift_over(df, b, ["tid"]).first()
        assert (r["q_s"], r["q_e"], r["status"]) == (*want, "ok")


def test_components_are_transitive_with_thresholds(spark):
    df = spark.createDataFrame([("g", "a", 0, 100), ("g", "b", 50, 150), ("g", "c", 100, 200), ("g", "d", 190, 300), ("g", "e", 181, 281)], "k string, i string, s bigint, e bigint")
    got = dict(tuple(r) for r in iv.overlap_components(df, ["k"], "i").collect())
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}


def test_mask_runs_and_short_inputs(spark):
    df = spark.createDataFrame([(1, i, 1.0 if i in (0, 1, 5) else 0.0) for i in range(7)], "u int, pos bigint, p double")
    got = sorted((r["s"], r["e"], r["n"]) for r in wn.mask_runs(df, ["u"], "pos", F.col("p") > 0.5, 16, 72).collect())
    assert got == [(0, 88, 2), (80, 152, 1)]
    one = wn.box_smooth(df.where("pos = 0"), ["u"], ["pos"], "p").first()
    assert one["smooth"] == pytest.approx(0.2)


def test_windows_of_short_sequences(spark):
    df = spark.createDataFrame([("ACGT",), ("ACGTACGTAC",), ("",), (None,)], "q string")
    got = [r[0] for r in df.select(sc.windows("q", 8, 1)).collect()]
    assert got[:3] == [[], ["ACGTACGT", "CGTACGTA", "GTACGTAC"], []]


def test_upsert_keeps_latest_non_null(spark):
    df = spark.createDataFrame([("k", 1, 5.0, "ok"), ("k", 2, None, "failed")], "id string, seq int, score double, status string")
    assert tuple(wn.upsert(df, ["id"], ["seq"], merged=["score"]).select("score", "status").first()) == (5.0, "failed")
    assert tuple(wn.upsert(df, ["id"], ["seq"]).select("score", "status").first()) == (None, "failed")


def test_bed_score_rounds_half_even(spark):
    got = [r[0] for r in spark.createDataFrame([(0.9375,), (0.8125,), (None,), (-1.0,), (2.0,)], "d double").select(sc.bed_score("d")).collect()]
    assert got[2:] == [0, 1000, 0]
    assert got[:2] == [62, 188]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=9), st.booleans())
def test_longest_run_is_optimal(values, falling):
    got = al.longest_run(values, falling)
    ordered = all((values[a] >= values[b]) if falling else (values[a] <= values[b]) for a, b in itertools.pairwise(got))
    best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(range(len(values)), n) if all((values[a] >= values[b]) if falling else (values[a] <= values[b]) for a, b in itertools.pairwise(c))), default=0)
    assert ordered and len(got) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 3), st.integers(0, 3)), max_size=12))
def test_greedy_respects_caps(pairs):
    taken = [pairs[i] for i in al.greedy(pairs)]
    assert all(sum(r == x for _, r, _ in taken) <= 2 for x in range(4))
    assert all(sum(q == x for _, _, q in taken) <= 1 for x in range(4))


def test_local_path_follows_the_cheap_diagonal():
    d = np.ones((4, 5))
    for i in range(4):
        d[i, i + 1] = 0.05
    score, path = al.local_paths(d)[0]
    assert path == [(0, 1), (1, 2), (2, 3), (3, 4)] and score == pytest.approx(0.4)


def test_second_path_keeps_clear_of_the_first():
    d = np.ones((6, 6))
    d[0, 0] = d[1, 1] = 0.0
    d[4, 4] = d[5, 5] = 0.05
    found = al.local_paths(d, chains=2)
    assert [p for _, p in found] == [[(0, 0), (1, 1)], [(4, 4), (5, 5)]]


def test_mmd_of_equal_and_far_samples():
    x = np.random.default_rng(0).normal(size=(30, 3))
    assert vx.mmd_numpy(x, x.copy()) < 0.2
    assert vx.mmd_numpy(x, x + 5) > 0.8
    assert vx.mmd_numpy(x[:1], x) == float("inf")


def test_rank_correlation_p():
    assert an.rank_correlation_p(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert an.rank_correlation_p(1.0, 5) == 0.0
    assert an.rank_correlation_p(None, 5) is None


def test_readers(spark, tmp_path):
    bed = tmp_path / "a.bed"
    bed.write_text("#c\nchr1\t10\t60\tt.1\t0\t-\t10\t60\t0\t2\t10,20,\t0,30,\nchr1\t5\n")
    got = readers.read_bed12(spark, str(bed)).collect()
    assert len(got) == 1 and got[0]["strand"] == -1 and [tuple(b) for b in got[0]["blocks"]] == [(10, 20), (40, 60)]
    tsv = tmp_path / "m.tsv"
    tsv.write_text("id\tname\na\tx\na\ty\nb\tz\n")
    assert {tuple(r) for r in readers.read_lookup(spark, str(tsv), "id", "name").collect()} == {("a", "x"), ("b", "z")}
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tsv), ["absent"])
    assert [r["g"] for r in readers.read_metadata(spark, str(tsv), {"g": 1}).collect()] == ["x", "y", "z"]
    sizes = tmp_path / "s.tsv"
    sizes.write_text("chr1\t100\n")
    assert tuple(readers.read_chrom_sizes(spark, str(sizes)).first()) == ("chr1", 100)
    doc = tmp_path / "d.json"
    doc.write_text('{"a": {"n": 1}, "b": {"n": 2}}')
    assert {(r["id"], r["value"]["n"]) for r in readers.read_nested(spark, str(doc), "struct<n:int>").collect()} == {("a", 1), ("b", 2)}
    gtf = tmp_path / "g.gtf"
    gtf.write_text('chr1\tx\ttranscript\t11\t20\t.\t+\t.\tgene_id "G"; transcript_id "T"; gene_type "lncRNA"; tag "basic"; tag "CCDS";\nchr1\tx\texon\t11\t20\t.\t+\t.\tgene_id "G";\n')
    row = readers.read_gtf(spark, str(gtf), gene_types=["lncRNA"]).first()
    assert (row["start"], row["transcript_id"], row["tags"]) == (10, "T", ["basic", "CCDS"])
    psl = tmp_path / "p.psl"
    psl.write_text("\t".join(["0"] * 14 + ["chr2", "9", "100", "180", "2", "10,20,", "0,0,", "100,160,"]) + "\n")
    row = readers.read_psl(spark, str(psl)).first()
    assert (row["t_name"], [tuple(b) for b in row["blocks"]]) == ("chr2", [(100, 110), (160, 180)])


def test_chain_source(spark, tmp_path):
    path = tmp_path / "c.chain"
    path.write_text("chain 30000 chr1 1000 + 10 60 q 900 - 5 50 7\n20 10 5\n20\n\nchain 10 chr1 1000 + 0 5 q 9 + 0 5 8\n5\n")
    readers.register(spark)
    got = spark.read.format("chains").option("path", str(path)).load().collect()
    assert [(r["chain_id"], r["block"], r["s"], r["e"], r["q_s"], r["q_strand"]) for r in got] == [(7, 0, 10, 30, 5, -1), (7, 1, 40, 60, 30, -1)]


def test_sequence_fetch_over_chunks(spark):
    seq = "ACGTTGCA" * 10
    chunks = readers.sequence_chunks(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 16)
    ranges = spark.createDataFrame([(1, "c", 3, 40), (2, "c", 16, 32), (3, "c", 79, 80)], "i int, chrom string, s bigint, e bigint")
    assert {r["i"]: r["seq"] for r in readers.fetch(ranges, chunks, "i", 16).collect()} == {1: seq[3:40], 2: seq[16:32], 3: seq[79:80]}


def test_manifest_skips_and_rebuilds(spark, tmp_path):
    m, built = writers.Manifest(spark, str(tmp_path)), []
    build = lambda: built.append(1) or spark.range(3)
    assert m.run("a", {"v": 1}, build).count() == m.run("a", {"v": 1}, build).count() == 3
    m.run("a", {"v": 2}, build)
    assert len(built) == 2
    assert set(writers.layout("/x")) >= {"manifest", "query_islands"}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp_seconds(id) ts, id % 3 k, id seq, double(id) value from range(30)").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k bigint, seq bigint, value double").parquet(str(src))
    q = monitor.throughput(stream).writeStream.format("memory").queryName("tp").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tp").agg(F.sum("n")).first()[0] == 30
    target = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(monitor.merge_into(target, ["k"], ["seq"])).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["seq"]) for r in spark.read.parquet(f"{target}/gen=0").collect()} == {(0, 27), (1, 28), (2, 29)}
    assert monitor.safe_batch(512, 64) == 384


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fits(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    _, comp, ratio = vx.fit_pca(e, "embedding", 8)
    assert comp.shape == (8, 64) and np.allclose(comp @ comp.T, np.eye(8), atol=1e-8) and 0 < ratio.sum() < 1
    df = spark.createDataFrame([(float(i), 1 if i > 10 else 0) for i in range(40)], "x double, y int")
    model = vx.fit_logistic(df, ["x"], "y")
    assert model.coefficients[0] > 0
