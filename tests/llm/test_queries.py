"""The registered queries and the pipeline's stages, as registered, against plain versions; models against plain arithmetic."""

from __future__ import annotations

import hashlib
import itertools
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixlake.llm import quality, queries, textops, toxicity
from tests.llm.test_llm import SF, brute_simhash, check_packing, pairs, tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, name):
    return queries.QUERIES[name](spark, SF)


@pytest.fixture(scope="module")
def docs(spark):
    return pairs(spark.read.parquet(f"{SF}/documents.parquet"))


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_nearest_query(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x, ids = np.stack([np.array(v, float) for v in e["embedding"]]), e["vec_id"].to_numpy()
    got, hits = run(spark, "op3_hash_prefix_forest").toPandas(), []
    assert set(got["query_id"]) == set(ids[ids % 20 == 0])
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        others = np.flatnonzero(ids != q)
        want = others[np.lexsort((ids[others], -s[others]))[:20]]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g["vec_id"])
        assert [(-a, b) for a, b in zip(g["score"], g["vec_id"], strict=True)] == sorted((-a, b) for a, b in zip(g["score"], g["vec_id"], strict=True))
        assert g["score"].to_numpy() == pytest.approx(s[[np.flatnonzero(ids == v)[0] for v in g["vec_id"]]], abs=1e-12)
        hits.append(len(set(ids[want]) & set(g["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9


@pytest.mark.parametrize(("name", "n", "out"), [("op4_quality_classifier", 3, 1), ("op5_toxicity", 5, 0)])
def test_classifier_queries(spark, docs, name, n, out):
    got = run(spark, name).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in docs)
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"], n) == out) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    scores = {}
    for (d, text), r in zip(sorted(docs, key=lambda x: x[0]), sorted(got, key=lambda r: r["doc_id"]), strict=True):
        assert scores.setdefault(text, r["score"]) == r["score"], d  # nothing but the text decides


def test_pack_query(spark, docs):
    check_packing(run(spark, "op7_pack").collect(), docs, 2048, tokenizer())


def test_encode_query(spark, docs):
    t, want = tokenizer(), Counter()
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, run(spark, "op8_bpe").collect())) == want


def test_encoder_equals_the_library_on_odd_characters():
    from helixlake.llm import bpe

    import pyarrow as pa

    t, b = tokenizer(), bpe.load(queries.vocabulary_path())
    points = [*range(0x0, 0x3100), *range(0xA000, 0xAD00), *range(0xF900, 0x10000), *range(0x10000, 0x11000, 7), *range(0x1D400, 0x1FAFF, 5)]
    texts = [f"a{chr(c)}b É{chr(c)}'s" for c in points if not 0xD800 <= c < 0xE000] + ["a" * 70_000, "x<|endoftext|>y<|startoftext|>", "<|endoftext|" * 3]
    got = list(b.encode_column(pa.array(texts, pa.string())))
    for text, ids, e in zip(texts, got, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, ascii(text)


def test_shard_query(spark, docs):
    got = run(spark, "op9_shard").collect()
    size = lambda x: len((x or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(x) + 8, zlib.crc32((x or "").encode())) for d, x in docs)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    load, slots = Counter(), {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(load) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 2 * max(size(x) + 8 for _, x in docs)


def test_simhash_query(spark, docs):
    fp = np.array(brute_simhash(docs), np.uint64)
    group = {d: d for d, _ in docs}
    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = group[docs[i][0]], group[docs[j][0]]
        if a != b and int(fp[i] ^ fp[j]).bit_count() <= 3:
            group = {d: min(a, b) if g in (a, b) else g for d, g in group.items()}
    assert {tuple(r) for r in run(spark, "op10_simhash").collect()} == {(d, f"{int(f):016x}", group[d]) for (d, _), f in zip(docs, fp, strict=True)}


def plain_ftrl(rows, size, alpha=2.0, beta=1.0, l1=1e-3, l2=1e-3):
    """Follow the regularised leader, one coordinate at a time."""
    z, n = [0.0] * size, [0.0] * size

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, y, importance in rows:
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        w = {i: weight(i) for i in x}
        for i, v in x.items():
            g = (p - y) * v * importance
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - s * w[i]
            n[i] += g * g
    return [weight(i) for i in range(size)]


def test_ftrl_against_plain_arithmetic():
    rng = np.random.default_rng(9)
    rows = [({int(i): float(rng.normal()) for i in rng.choice(20, 6, replace=False)}, int(rng.integers(0, 2)), float(rng.uniform(0.5, 2))) for _ in range(200)]
    model = quality.Ftrl(19)
    for x, y, importance in rows:
        model.learn(np.array(list(x)), np.array(list(x.values())), y, importance)
    assert model.weights() == pytest.approx(plain_ftrl(rows, 20))


def test_quality_scores_are_sparse_dots():
    """The score of a block of texts is, text by text, the sum over kinds of the mean weight of its n-grams."""
    texts = [b"", b"One two  three!!", b"a", b"x y z x y z " * 40, "Ünï cödé 12 34".encode()]
    weights = np.random.default_rng(2).normal(size=1 << 10)
    want = []
    for t in texts:
        total = 0.0
        for index, _ in quality.features(textops.Block([t]), 10):
            total += sum(weights[i] for i in index.tolist()) / max(1, len(index))
        want.append(total)
    assert quality.dots(textops.Block(texts), weights, 10) == pytest.approx(want)


def readings(model, token):
    """Every reading of a token with its least cost, by trying all paths."""
    best = {}

    def go(at, read, cost):
        if at == len(token):
            best[read] = min(cost, best.get(read, math.inf))
            return
        c = token[at]
        ways = [(c, 0.0)] if c.isalpha() else [(c, toxicity.KEEP_SIGN_COST)] if c.isdigit() else []
        ways += [(x, toxicity.SWAP_COST) for x in toxicity.LOOKALIKES.get(c, "")]
        for x, price in ways:
            go(at + 1, read + x, cost + price + model._price(("^^" + read)[-2:], x))
            if read.endswith(x):
                go(at + 1, read, cost + price + toxicity.REPEAT_COST)
        if not c.isalnum():
            go(at + 1, read, cost + toxicity.DROP_COST)

    go(0, "", 0.0)
    return {r: c + model._price(("^^" + r)[-2:], "~") for r, c in best.items()}


def test_viterbi_finds_the_cheapest_of_all_readings():
    words = ["stupid", "idiot", "moron", "loser", "cats", "sit", "soon", "gas", "bass", "little"]
    m = toxicity.Model([(i % 2, " ".join(words[i % 5 :])) for i in range(40)])
    rng = np.random.default_rng(3)
    signs = "abdegilmorstu" + "".join(toxicity.LOOKALIKES) + ".-* "
    for _ in range(400):
        token = "".join(rng.choice(list(signs), rng.integers(1, 8)))
        costs = readings(m, token)
        assert costs[m.decode(token)] == pytest.approx(min(costs.values())), token


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables with null ids and texts, repeated rows and a very long text; and empty ones."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "one", base, base, f"{base} tail", " ".join(f"q{i % 977}" for i in range(30000)), "Ends well. This is a plain line."]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(4, base, "en", "s", len(base)), (None, "no id here", None, None, None), (None, None, None, None, None)]
    labels = [(i, i % 2, i // 2 % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)]
    made = {}
    for name, some, marks in (("odd", rows, labels), ("empty", [], []), ("unlabelled", rows, [])):
        made[name] = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(some, COLUMNS).write.parquet(f"{made[name]}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{made[name]}/labels.parquet")
    return made


@pytest.mark.parametrize("which", ["odd", "empty", "unlabelled"])
def test_stages_on_odd_tables(spark, odd_tables, which):
    import corpus_pipeline as p

    sf = odd_tables[which]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == p.COLUMNS and got.count() <= n, name
        if which == "unlabelled" and name in ("toxicity", "quality classifier"):
            assert got.count() == n, name
        if name == "SimHash near-dedup":
            assert len(set(got.select("text").distinct().collect())) == got.count()
        if name == "substring dedup":
            assert got.count() == n and got.where("text is null").count() == 0
    assert p.run(spark, sf).count() >= (0 if which != "unlabelled" else 5)


def test_pipeline_goes_on_where_it_stopped(spark, odd_tables, tmp_path, monkeypatch):
    import corpus_pipeline as p

    sf, ran = odd_tables["unlabelled"], []

    def noted(name, stage, fail):
        def call(*args):
            ran.append(name)
            if fail and name == "substring dedup" and ran.count(name) == 1:
                raise RuntimeError("lost")
            return stage(*args)

        return name, call

    whole = sorted(map(tuple, p.run(spark, sf).collect()), key=str)
    monkeypatch.setattr(p, "STAGES", [noted(name, stage, True) for name, stage in p.STAGES])
    with pytest.raises(RuntimeError):
        p.run(spark, sf, str(tmp_path))
    got = p.run(spark, sf, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == whole
    assert Counter(ran) == {"toxicity": 1, "quality classifier": 1, "SimHash near-dedup": 1, "substring dedup": 2, "packing": 1}


def test_queries_without_the_subpackage(monkeypatch):
    """An import error in the subpackage leaves the other queries."""
    import sys

    import __spark_entry__ as e

    monkeypatch.setitem(sys.modules, "helixlake.llm.queries", None)
    monkeypatch.delattr("helixlake.llm.queries", raising=False)
    assert e._llm() == (None, None) and "jon1_overlap_join" in e.queries() and "op1_chat_format" not in e.queries()


def test_long_texts_and_hot_rows(spark):
    """Very long texts of their own and rows repeated with one id, for chat, sharding and packing."""
    from helixlake.llm import chat, packing, sharding

    long = "x<|y " * 200_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    made = chat.format_chat(turns).select(chat.read_chat(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).first()
    assert [tuple(t) for t in made["t"]] == [("user", long), ("assistant", long)] and made["l"] == long
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text of many rows").alias("text"))
    shards = sharding.shard_by_bytes(same).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()
    assert sorted(r["n"] for r in shards) == [125] * 24 and all(r["top"] == 124 for r in shards)
    pieces = packing.pack(same.unionByName(spark.createDataFrame([(8, long)], "doc_id long, text string")), queries.vocabulary_path())
    assert pieces.where("doc_id = 7").count() == 3000
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
