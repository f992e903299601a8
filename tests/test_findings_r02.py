"""Queries that failed at size in round 2: whole results against plain versions, with work in proportion."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest

from helixlake.operators import alignment as al
from helixlake.operators import intervals as iv
from helixlake.operators import vectors as vx


def vectors(spark, n, width=4, groups=2, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k % groups, k, rng.integers(0, 9, width).astype(float).tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "g int, id long, v array<double>")


@pytest.mark.parametrize("n,tile_rows", [(3, 1024), (31, 4), (40, 7)])
@pytest.mark.parametrize("positive", [False, True])
def test_gamma_is_the_exact_median_over_tiles(spark, n, tile_rows, positive):
    rows, df = vectors(spark, n)
    more = spark.createDataFrame([(0, 900, None), (0, 901, [1.0, None, 1.0, 1.0]), (None, 902, [1.0] * 4), (7, 903, [1.0] * 4)], df.schema)
    got = {r["g"]: r["gamma"] for r in vx.gamma(df.unionByName(more), "g", "id", "v", positive, tile_rows).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        d = [float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) for (x, _, a), (y, _, b) in itertools.permutations(rows, 2) if x == y == g]
        d = [x for x in d if x > 0 or not positive]
        if d:
            want[g] = 1 / (2 * np.median(d) ** 2 + 1e-10)
    assert got == pytest.approx(want)


def plain_diagonal(cells, min_run):
    best = None
    by_diag = {}
    for (i, j), d in cells.items():
        by_diag.setdefault(j - i, {})[i] = d
    for diag, row in by_diag.items():
        for a in row:
            total, b = 0.0, a
            while b in row:
                total += row[b]
                if b - a + 1 >= min_run:
                    found = (round(total / (b - a + 1), 9), diag, a, b)
                    best = min(best, found) if best else found
                b += 1
    return best


@pytest.mark.parametrize("min_run", [1, 2, 3])
def test_best_diagonal_equals_all_runs(spark, min_run):
    rng, rows, want = random.Random(3), [], {}
    for g in range(25):
        cells = {(i, j): rng.choice([0.0, 0.25, 0.5, 1.0]) for i in range(7) for j in range(9) if rng.random() < 0.85}
        rows += [(g, i, j, d) for (i, j), d in cells.items()]
        best = plain_diagonal(cells, min_run)
        if best:
            want[g] = best
    got = al.best_diagonal(spark.createDataFrame(rows, "g int, i long, j long, mmd double"), "g", min_run).collect()
    assert {r["g"]: (r["mean"], r["diag"], r["i0"], r["i1"]) for r in got} == want


def test_best_diagonal_takes_a_longer_run_that_begins_earlier(spark):
    # 3 cells of 0 mean 0, and so do, in 9 digits, all 9; the first three alone do not
    values = [6e-10, 6e-10, 6e-10, 6e-10, 0.0, 0.0, 0.0, 0.0, 0.0]
    got = al.best_diagonal(spark.createDataFrame([("a", k, k, d) for k, d in enumerate(values)], "g string, i long, j long, mmd double"), "g", 3).first()
    assert (got["i0"], got["i1"], got["mean"]) == plain_diagonal({(k, k): d for k, d in enumerate(values)}, 3)[2:] + (0.0,)


def test_best_diagonal_on_long_diagonals(spark):
    n = 60_000
    pdf = pd.DataFrame({"g": 1, "i": np.arange(n), "j": np.arange(n) + 5, "mmd": 1.0 + (np.arange(n) % 97) / 97})
    began = time.time()
    got = al.best_diagonal(spark.createDataFrame(pdf), "g", 3).first()
    assert (got["diag"], got["i0"], got["i1"]) == (5, 0, 2)
    assert time.time() - began < 60  # pairs of ends would be 1.8e9


def test_collinear_matches_stream_equals_the_plain_greedy(spark):
    rng, rows = random.Random(5), []
    for g in range(12):
        rows += [(g, r, q, rng.choice([0.1, 0.2, 0.3, 0.4]), g % 2 == 0) for r in range(9) for q in range(8) if rng.random() < 0.8]
    rows += [(0, 0, 0, None, True), (50, 1, 1, None, True)]
    got = sorted(tuple(r) for r in al.collinear_matches(spark.createDataFrame(rows, "g int, r long, q long, mmd double, same boolean"), "g").collect())
    want = []
    for g in range(12):
        pairs = [(d, r, q) for k, r, q, d, _ in rows if k == g and d is not None]
        taken = sorted((pairs[at][1], pairs[at][2], pairs[at][0]) for at in al.greedy(pairs))
        want += [(g, *taken[at]) for at in al.longest_run([q for _, q, _ in taken], falling=g % 2 == 1)]
    assert got == sorted(want)


def test_collinear_matches_of_many_pairs(spark):
    n = 1000
    r, q = np.divmod(np.arange(n * n), n)
    pdf = pd.DataFrame({"g": 1, "r": r, "q": q, "mmd": np.abs(r - q) / n, "same": True})
    began = time.time()
    got = al.collinear_matches(spark.createDataFrame(pdf), "g").collect()
    assert [(x["r"], x["q"]) for x in got] == [(k, k) for k in range(n)]
    assert time.time() - began < 60


def plain_components(rows, min_bp=20, share=0.5):
    label = {r[1]: r[1] for r in rows if r[1] is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for (k, x, s, e), (k2, y, s2, e2) in itertools.combinations([r for r in rows if None not in r], 2):
        bp = min(e, e2) - max(s, s2)
        if k == k2 and s < e2 and s2 < e and bp >= min_bp and bp >= share * min(e - s, e2 - s2):
            a, b = sorted((root(x), root(y)))
            label[b] = a
    return {x: root(x) for x in label}


@pytest.mark.parametrize("cell", [64, 300, 1 << 17])
def test_overlap_components_over_cells_keys_and_copies(spark, cell):
    rng, rows = random.Random(7), []
    for _ in range(400):
        s = rng.randrange(3000)
        rows.append((f"k{rng.randrange(3)}", f"t{rng.randrange(300)}", s, s + rng.choice([0, 5, 19, 20, 40, 40, 41, 200])))
    rows += [("k0", f"copy{k}", 5000, 5100) for k in range(50)] + [("k0", f"short{k}", 5000, 5010) for k in range(5)]
    rows += [(None, "t1", 0, 100), ("k1", "lone", None, 5), (None, "other", 0, 100)]
    got = {r["id"]: r["label"] for r in iv.overlap_components(spark.createDataFrame(rows, "k string, id string, s long, e long"), ["k"], "id", cell=cell).collect()}
    assert got == plain_components(rows)


def test_overlap_components_make_no_rows_of_pairs(spark):
    # 3000 intervals over one place: 4.5 million links
    rows = [("c", k, 10 * (k % 700), 10 * (k % 700) + 20_000) for k in range(3000)]
    df = iv.overlap_components(spark.createDataFrame(rows, "k string, id long, s long, e long"), ["k"], "id")
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"], r["label"]) for r in df.collect()} == {(k, 0) for k in range(3000)}


def test_cross_distances_over_tiles(spark):
    rows, df = vectors(spark, 23)
    got = vx.cross_distances(df.where("id % 3 = 0").toDF("g", "i", "x"), df.where("id % 3 <> 0").toDF("g", "j", "y"), "g", tile_rows=3)
    want = {(x, i, j): sum((p - q) ** 2 for p, q in zip(a, b, strict=True)) for (x, i, a), (y, j, b) in itertools.product(rows, rows) if x == y and i % 3 == 0 and j % 3}
    assert {(r["g"], r["i"], r["j"]): r["d2"] for r in got.collect()} == want


def test_fallback_on_long_diagonals(spark):
    n = 60_000
    cells = spark.createDataFrame(pd.DataFrame({"g": 1, "i": np.arange(n), "j": np.arange(n) + 5, "mmd": 1.0 + (np.arange(n) % 97) / 97}))
    none = spark.createDataFrame([], "g long, mmd double, i_from long, i_to long, j_from long, j_to long")
    got = al.with_fallback(none, al.best_diagonal(cells, "g", 3), "g").collect()
    assert [(r["kind"], r["i_from"], r["i_to"], r["j_from"], r["j_to"]) for r in got] == [("diagonal", 0, 104, 20, 124)]


def test_hot_substring_groups_meet_by_aggregation_only(spark):
    import hashlib

    from helixlake.llm import substring_dedup

    common = [f"c{k}" for k in range(60)]
    rows = [(d, " ".join([f"a{d}", *common[d % 7 :], *(f"b{d}x{k}" for k in range(40))])) for d in range(60)]
    rows += [(100, " ".join([f"e{k}" for k in range(30)] + common[:8] + [f"f{k}" for k in range(40)])), (101, None), (102, "short text")]
    df = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=1)
    assert "path" not in "".join(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
    windows = {}
    split = {d: (t or "").split() for d, t in rows}
    for w in split.values():
        for k in range(len(w) - 34):
            windows[tuple(w[k : k + 35])] = windows.get(tuple(w[k : k + 35]), 0) + 1
    want = set()
    for d, w in split.items():
        gone = {k + x for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for x in range(35)}
        want.add((d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert {tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == want


def test_encoder_memo_keeps_a_large_vocabulary_in_little_memory():
    import pyarrow as pa

    from helixlake.llm import bpe, queries

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 9))) for _ in range(260_000)})
    texts = pa.array([" ".join(words[k : k + 500]) for k in range(0, len(words), 500)])
    encoder, made = bpe.WordBpe(queries.vocabulary_path()), []
    make = encoder.memo.make
    encoder.memo.make = lambda piece: made.append(piece) or make(piece)
    first = list(encoder.encode_column(texts))
    assert len(made) == len(words)
    assert list(encoder.encode_column(texts)) == first and len(made) == len(words)  # nothing is merged twice
    assert sum(x.nbytes for x in vars(encoder.memo.new).values() if isinstance(x, np.ndarray)) < 64 * len(words)
    small = bpe.WordBpe(queries.vocabulary_path())
    small.memo.most = 700  # generations change all the time
    assert list(small.encode_column(texts.slice(0, 40))) == first[:40]


def test_toxicity_is_learned_from_all_labelled_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from helixlake.llm import labelled, toxicity

    monkeypatch.setattr(toxicity, "COUNTED", 400)
    rng, rows, labels = random.Random(4), [], []
    common = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90)]
    for d in range(7000):
        bad = [rng.choice(["zorken", "zorkar", "zorkix", "zorkum", "viled"])] if d % 2 and d > 6800 else []
        text = [*rng.choices(common, k=3), *bad, *rng.choices(common, k=3)]
        rows.append((d, " ".join(text) + rng.choice(["", ".", "!"])))
        labels.append((d, d % 2))
    docs, marks = spark.createDataFrame([*rows, (None, "zorken"), (9000, None)], "doc_id long, text string"), spark.createDataFrame([*labels, (9000, 0), (None, 1)], "doc_id long, toxic int")
    all_known = labelled.known(docs, marks, "toxic", F.lit(True))
    assert all_known.count() == 7001  # not 3000 a class
    got = toxicity.fit(all_known, least_ratio=3.0)
    want = toxicity.Model([(y, t) for (_, t), (_, y) in zip(rows, labels, strict=True)] + [(0, "")], least_ratio=3.0)
    assert want.words and want.starts
    assert (got.words, got.starts, got.price, got.unseen, got.blank) == (want.words, want.starts, want.price, want.unseen, want.blank)


def test_leaves_of_a_hot_node_are_one_row_a_task():
    import pyarrow as pa

    from helixlake.llm import substring_dedup

    texts = [b"a b c d e"] * 500 + [b"a b c d x", b"q r s t"]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * (n - 1) + [8], pa.int64()), pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([3] * n, pa.int32()), pa.array([1] * (n - 1) + [2], pa.int8()), pa.array(texts, pa.binary())],
        names=["part", "k1", "k2", "start", "w", "words"],
    )
    whole = [r for out in substring_dedup._leaves(4)([batch.slice(0, 200), batch.slice(200)]) for r in out.to_pylist()]
    assert len({r["path"] for r in whole}) == len(whole) == 4  # abcd, bcde, bcdx, qrst: not two rows a text
    assert sorted((r["part"], r["w"]) for r in whole) == [(7, 1), (7, 2), (7, 2), (8, 2)]
    assert [(r["k1"], r["start"]) for r in whole if r["w"] == 1] == [(500, 4)]
    cut = [r for out in substring_dedup._leaves(4, most=1)([batch]) for r in out.to_pylist()]
    total = {}
    for r in cut:
        total[r["path"]] = total.get(r["path"], 0) + r["w"]
    assert {p for p, w in total.items() if w == 1} == {r["path"] for r in whole if r["w"] == 1}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_known_moves_labelled_texts_only_and_by_one_plan(spark, kind):
    from pyspark.sql import functions as F

    from helixlake.llm import labelled

    ids = F.col("id").cast(kind).alias("doc_id")
    docs = spark.range(20_000).select(ids, F.concat(F.lit("t"), "id").alias("text")).unionByName(spark.createDataFrame([(None, "none")], f"doc_id {kind}, text string"))
    labels = spark.range(25_000).where("id % 10 < 3").select(ids, F.when(F.col("id") % 10 == 2, 5).otherwise(F.col("id") % 10).cast("int").alias("toxic"))
    got = labelled.known(docs, labels, "toxic", F.lit(True))
    assert {(r["y"], r["text"]) for r in got.collect()} == {(k % 10, f"t{k}") for k in range(20_000) if k % 10 < 2}
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
    marks = labels.where("toxic < 2")
    some = labelled._marked(docs, marks, "doc_id")
    assert some.join(marks, "doc_id").count() == 4000 and some.count() < 8000  # of 20 001
    assert labelled._marked(docs, marks.limit(0), "doc_id").count() == 0


def test_streamed_path_equals_the_whole_matrix():
    rng = np.random.default_rng(8)
    for n, m, block in [(1, 1, 4), (1, 9, 1), (17, 23, 4), (30, 8, 3), (25, 25, 100), (40, 31, 1)] * 4:
        d = rng.choice([0.0, 0.05, 0.1, 0.15, 0.2, 0.5, 1.0], (n, m))
        want = al.local_paths(d)
        got = al.streamed_path(lambda lo, hi, d=d: d[lo:hi], n, block=block)
        assert (got and got[:2]) == (want[0] if want else None)
        assert not got or got[2] == [d[p] for p in got[1]]
    assert al.streamed_path(lambda lo, hi: np.ones((hi - lo, 5)), 9) is None


def test_align_vectors_equals_align_of_cells(spark):
    rng = np.random.default_rng(9)
    rows = [(g, k, (rng.random(3) * (9 if g == 2 else 1)).tolist()) for g in range(4) for k in range(20)]
    rows += [(0, 20, None), (1, 21, [None, 1.0, 1.0]), (None, 3, [1.0] * 3), (7, 2, [1.0] * 3)]
    df = spark.createDataFrame(rows, "g int, n long, v array<double>")
    a, b = df.where("n % 2 = 0 and n <> 6").toDF("g", "i", "x"), df.where("n % 2 = 1").toDF("g", "j", "y")
    from pyspark.sql import functions as F

    cells = vx.cross_distances(a, b, "g").select("g", "i", "j", (F.col("d2") / 2 / 3).alias("mmd"))
    got = al.align_vectors(a, b, "g", (2.0, 3.0)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, al.align(cells, "g").collect())) and len(got) >= 3


def test_rows_with_fallback_make_cells_only_without_a_path(spark, sf, monkeypatch):
    from helixlake.plans import catalog

    monkeypatch.setattr(al, "align", None)
    assert catalog.queries()["aln8_rows_with_fallback"](spark, sf).count() == 10


@pytest.mark.parametrize("nearest", [(64, 1024), (2, 5), (1,), ()])
def test_collinear_vectors_equal_the_greedy_over_all_pairs(spark, nearest):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(11)
    rows = [(g, k, [1.0, 2.0, 3.0] if g == 2 else rng.integers(0, 3 if g == 1 else 50, 3).astype(float).tolist()) for g in range(4) for k in range(41)]
    rows += [(0, 50, None), (1, 51, [None, 1.0, 1.0]), (None, 3, [1.0] * 3), (7, 2, [1.0] * 3), (0, 61, [float("nan")] * 3)]
    df = spark.createDataFrame(rows, "g int, n long, v array<double>")
    a, b = df.where("n % 3 = 0").toDF("g", "i", "x"), df.where("n % 3 <> 0").toDF("g", "j", "y")
    pairs = vx.cross_distances(a, b, "g").select("g", F.col("i").alias("r"), F.col("j").alias("q"), F.round(F.col("d2") / 7, 3).alias("mmd"), F.lit(True).alias("same"))
    plain = lambda x: sorted((r["g"], r["r"], r["q"], repr(r["mmd"])) for r in x.collect())
    assert plain(al.collinear_vectors(a, b, "g", 7.0, 3, nearest=nearest)) == plain(al.collinear_matches(pairs, "g"))


def test_rounded_as_spark_rounds(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(12)
    x = np.concatenate([rng.random(2000), np.arange(2000) / 1e6 + 5e-7, (2 * np.arange(500) + 1) / 2.0**7 / 1e4, [0.0, 1e12 + 0.5, 1e17, 2.5e-6, np.inf, np.nan]])
    want = [r["y"] for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x double").select("k", F.round("x", 6).alias("y")).orderBy("k").collect()]
    assert list(map(repr, al.rounded(x, 6).tolist())) == list(map(repr, want))


def test_collinear_query_makes_no_row_of_every_pair(spark, sf, monkeypatch):
    from helixlake.plans import catalog

    monkeypatch.setattr(al, "collinear_matches", None)  # all pairs, sorted
    assert catalog.queries()["aln5_collinear_matches"](spark, sf).count() > 0
