"""The ten operators and the pipeline: brute force, exact round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixlake.llm import ann, bpe, chat, labelled, near_dup, packing, quality, queries, sharding, simhash, substring_dedup, topk, toxicity
from helixlake.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, fp string, score string, part string, k1 string, id string, size string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a very long text, and columns whose names clash."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " \t\n", "one", base, base, base + " tail", "x " + base, "rep " * 80, "ß İ Σ ς <|endoftext|> \x1c　 z", " ".join(f"q{i % 977}" for i in range(30000)), "a b", "A  B"]
    rows = [(i, t, "en", "f", "s", "p", "k", "i", "z") for i, t in enumerate(texts)] + [(4, base, "en", "f", "s", "p", "k", "i", "z"), (None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert Counter(map(tuple, got[cols].values.tolist())) == Counter(map(tuple, want[cols].values.tolist()))


def test_chat_round_trip(spark, empty):
    rows = [(1, 0, "user", "a<|b<\\|c"), (1, 1, "user", None), (1, 2, "assistant", "<|im_part|>"), (1, 2, "assistant", "<|im_part|>"), (None, 5, None, "x\n"), (2, None, "as\n\\nx<|", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_chat(df).select("*", chat.read_chat(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "a<|b<\\|c"), ("user", ""), ("assistant", "<|im_part|>"), ("assistant", "<|im_part|>")]
    assert got[1]["l"] == "<|im_part|>" * 2 and got[1]["formatted"].count("<|im_start|>") == 2
    assert [tuple(t) for t in got[None]["t"]] == [("", "x\n")] and [tuple(t) for t in got[2]["t"]] == [("as\n\\nx<|", "")]
    assert chat.format_chat(df.limit(0)).count() == 0


def brute_windows(docs, n):
    seen = Counter(tuple(w[i : i + n]) for w in docs for i in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_subtrees_tell_words_not_hashes():
    """Windows of one part (as if their word hashes met) repeat only where their words do; nodes against brute force at all depths."""
    import pyarrow as pa

    texts = [b"a b c d e f", b"a b  c d x f", b"q a b c\td", b"z z z z z z"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 4, pa.int64()), pa.array([0, 1, 2, 3]), pa.array([0] * 4), pa.array([5, 0, 0, 0], pa.int32()), pa.array([1] * 4, pa.int8()), pa.array(texts, pa.binary())],
        names=["part", "k1", "k2", "start", "w", "words"],
    )
    got = {(r["k1"], r["start"]): r["mask"] for out in substring_dedup._subtrees(4)([batch]) for r in out.to_pylist()}
    assert got == {(0, 5): 0b001, (1, 0): 0b001, (2, 0): 0b10, (3, 0): 0b111}
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400)
    for depth in (1, 2, 3, 5, 8, 13):
        at = np.arange(len(words) - depth + 1)
        node = substring_dedup.nodes_at_depth(words, at, depth)
        assert len({(n, tuple(words[i : i + depth])) for n, i in zip(node.tolist(), at.tolist(), strict=True)}) == len(set(node.tolist())) == len({tuple(words[i : i + depth]) for i in at})


@pytest.mark.parametrize("part_rows", [4096, 3, 1])
def test_substring_dedup(spark, odd, empty, part_rows):
    docs = pairs(odd)
    want = Counter((d, *x) for (d, _), x in zip(docs, brute_windows([words(t) for _, t in docs], 35), strict=True))
    got = substring_dedup.substring_dedup(odd, part_rows=part_rows)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def vectors(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 16)) * rng.uniform(0.2, 3, size=(n, 1))
    x[10:60] = x[9]
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None), (n + 1, [None] * 16), (n + 2, [float("nan")] * 16), (n + 3, [0.0] * 16), (n + 4, [1.0, 2.0])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))


@pytest.mark.parametrize(("group_rows", "query_rows"), [(32768, 16384), (150, 16384), (20, 3)])
def test_forest_recall_and_order(spark, group_rows, query_rows):
    x, df = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, group_rows=group_rows, query_rows=query_rows).collect()
    whole = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, whole))  # groups, tiles and blocks change nothing
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine) and len(mine) == 20
        s = x @ x[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        hits += sum(s[r["vec_id"]] >= s[want[-1]] - 1e-9 for r in mine)
    assert hits / (20 * 30) >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_scores_a_falling_share(spark):
    """What a query meets grows by the stated law: the counts of its cells, without repeats over trees, hold the least."""
    rng = np.random.default_rng(7)
    shares = []
    for n in (500, 2000, 8000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        symbols = ann.first_symbols(x, 1.0, 8, 512)
        counts = np.bincount(symbols.reshape(-1), minlength=8 * 1024)
        table = ann.Cells(counts, n, 1.0, 32768, 20, 8, 4.0, 0.75)
        met, hit = [], []
        for q in range(0, n, n // 25):
            cells = ann.probes(x[q], counts, 8, 512, table.least)
            seen = np.isin(symbols, cells).any(axis=1)
            s = x @ x[q]
            s[q] = -9
            met.append(seen.mean())
            hit.append(seen[np.argsort(-s)[:20]].mean())
        assert np.mean(hit) >= 0.9
        shares.append(np.mean(met))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.33


def test_forest_keeps_repeated_rows_and_short_tables(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [0.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 5, 1.0), (0, 4, 20, 0.0), (20, 1, 5, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 1, 0.0)]
    assert ann.nearest(df, F.lit(False)).count() == 0 and ann.nearest(df.where("vec_id = 20"), F.lit(True)).count() == 0
    copies = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))  # one vector only
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(copies, F.col("vec_id") == 3, k=4).collect())
    assert got == [(3, 1, 0), (3, 2, 1), (3, 3, 2), (3, 4, 4)]


def test_equal_rows_tie_wherever_they_stand():
    rng = np.random.default_rng(5)
    rows = np.repeat(rng.standard_normal((40, 67)), 9, axis=0)[rng.permutation(360)]
    query = rng.standard_normal(67)
    ids = rng.permutation(360)
    at, scores = ann.nearest_rows(ids, rows, query, 25)
    exact = (rows * query).sum(axis=1)
    want = np.lexsort((ids, -exact))[:25]
    assert list(at) == list(want) and list(scores) == list(exact[want]) and len(set(scores)) == 3


def test_exact_top(spark):
    x, df = vectors(spark)
    v = np.floor(256 * x).astype(np.int64)
    v = np.vstack([v, np.zeros((1, 16), np.int64)])
    ids = [*range(600), 603]
    got = {}
    for r in topk.exact_top(df, F.col("vec_id") % 50 == 0, data_block=32, sample_rows=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 600, 50):
        s = v @ v[q]
        want = sorted(((int(-s[i]), ids[i]) for i in range(601) if ids[i] != q))[:5]
        assert [got[q][k + 1] for k in range(5)] == [(i, -m) for m, i in want]
    assert topk.exact_top(df.limit(0), F.lit(True)).count() == 0


def test_exact_top_along_an_axis(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    for i in range(0, 400, 4):  # one coordinate rules, of either sign; some have no other
        x[i] *= 0 if i % 40 == 0 else 0.1
        x[i, i // 40 % 4] = 3 if i % 8 else -3
    x[1::40] = x[::40]  # exact copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    v = np.floor(256 * x).astype(np.int64)
    got = {}
    for r in topk.exact_top(df, F.col("vec_id") % 4 == 0, data_block=64, sample_rows=200).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 400, 4):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(400) if i != q)[:5]
        assert [got[q].get(k + 1) for k in range(5)] == [(i, -m) for m, i in want]


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_learn(spark, odd, empty, which):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n, out = (3, 1) if which == "quality" else (5, 0)
    rest = labelled.remainder("doc_id", n)
    sample = labelled.sample(docs, labels, which, rest != out, 1000)
    model, score = (quality.fit(sample), quality.score) if which == "quality" else (toxicity.fit(sample), toxicity.score)
    got = score(docs, model, name="p").join(labels, "doc_id").where(rest == out).select("p", which).collect()
    right = sum((r["p"] >= 0.5) == bool(r[which]) for r in got) / len(got)
    assert right > 0.93
    some = score(odd, model, name="p").collect()
    assert len(some) == odd.count() and all(0 <= r["p"] <= 1 for r in some)
    assert score(empty, model).count() == 0
    assert score(odd, quality.fit(sample.limit(0)) if which == "quality" else toxicity.fit(sample.limit(0))).count() == odd.count()


def test_deobfuscation():
    clean = ["the cat sat on a mat and it was warm", "an idle day in the sun with tea", "we read of ships and stars"]
    rows = [(0, f"{clean[i % 3]} n{i}") for i in range(60)] + [(1, f"{clean[i % 3]} you {w} {chr(97 + i % 26)}{i} moron z{i} stupid y{i}") for i in range(60) for w in ("loser",)]
    m = toxicity.Model(rows)
    for t in ("l0ser", "m0r0n", "stup1d", "s t u p i d", "s.t.u.p.i.d", "stuuupid", "$tupid"):
        assert m.score(f"a {t} b", {}) >= 0.5, t
    assert m.score("the cat sat 10 times", {}) < 0.5
    assert "stupid" in m.restore("a s t u p i d cat")
    far = " ".join("xqzv" * 60)  # a spaced run and a token are read whole, however long
    assert m.score(f"a {far} s t u p i d b", {}) >= 0.5 and m.score(f"a {far} b", {}) < 0.5
    assert m.score("so stupi" + "i" * 200 + "d b", {}) >= 0.5
    assert len(m.decode("ab" * 5000)) == 10_000


def test_deobfuscation_of_doubled_letters_and_short_spaced_words():
    clean = ["the cat sat on a mat and it was warm", "an idle day in the sun with tea", "we read of ships and stars in a book"]
    rows = [(0, f"{clean[i % 3]} n{i}") for i in range(60)] + [(1, f"{clean[i % 3]} idiot {chr(97 + i % 26)}{i} moron z{i} stupid y{i} die v{i}") for i in range(60)]
    m = toxicity.Model(rows)
    for t in ("stuupid", "idioot", "iidioott", "mooron", "Stuppid,", "d i e", "d.i.e", "d-1-e", "diie"):
        assert m.score(f"the {t} cat", {}) >= 0.5, t
    assert m.score("read a d i e b cat", {}) >= 0.5 and "die" in m.restore("the d i e cat") and "stupid" in m.restore("so stuupid")
    for t in ("book", "a b c", "d i", "d i n e t", "moor", "see"):
        assert m.score(f"the {t} cat", {}) < 0.5, t


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def test_bpe_matches_the_library(spark, odd, empty):
    t = tokenizer()
    docs = pairs(odd) + pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    b = bpe.load(queries.vocabulary_path())
    for _, text in docs + [(0, "it's 'S ’s don't!!! 12ab½Ⅷ é  x"), (0, "a" * 5000), (0, "<|startoftext|>hi<|endoftext|>")]:
        want = t.encode(text or "", add_special_tokens=False).ids
        ids = b.encode(text or "")
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert b.decode(ids) == t.decode(want, skip_special_tokens=False)
    got = bpe.encode_documents(odd, queries.vocabulary_path(), with_output=True).collect()
    assert len(got) == odd.count() and bpe.encode_documents(empty, queries.vocabulary_path()).count() == 0


def check_packing(rows, docs, length, t):
    ids = Counter()
    left = {}
    for d, text in docs:
        left.setdefault(d, []).append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    for r in rows:
        mine = [a for a in left[r["doc_id"]] if len(a) == r["doc_tokens"] and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert mine
        ids[r["doc_id"]] += r["length"]
    assert all(ids[d] == sum(map(len, a)) for d, a in left.items())
    at = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= length and sorted(at) == list(range(len(at)))
    return sum(length - n for n in at.values() if n & (n - 1))


@pytest.mark.parametrize("part_rows", [packing.PART_ROWS, 3])
def test_packing(spark, odd, empty, part_rows, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", part_rows)
    t = tokenizer()
    check_packing(packing.pack(odd, queries.vocabulary_path()).collect(), pairs(odd), 2048, t)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, queries.vocabulary_path()).collect()
    assert check_packing(rows, pairs(docs), 2048, t) < 0.03 * sum(r["length"] for r in rows)
    assert packing.pack(empty, queries.vocabulary_path()).count() == 0


def test_shortest_pack_first_uses_each_length():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 500, 30), strict=True)}
    used = Counter()
    for n, lengths in packing.shortest_pack_first(histogram, 64):
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += n
    assert used == histogram


def test_sharding(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = docs.unionByName(docs.limit(1).crossJoin(spark.range(600)).withColumn("doc_id", F.col("id") + 10**6).drop("id"))
    for df in (odd, docs, hot):
        got, want = sharding.shard_by_bytes(df).collect(), pairs(df)
        size = lambda x: len((x or "").encode())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(x) + 8, zlib.crc32((x or "").encode())) for d, x in want)
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
        if df is not odd:
            load = Counter()
            for r in got:
                load[r["shard"]] += r["size"]
            assert len(load) == 24 and max(load.values()) - min(load.values()) <= 2 * max(size(x) + 8 for _, x in want)
    assert sharding.shard_by_bytes(empty).count() == 0


def brute_simhash(docs, shingle=3):
    out = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[j : j + shingle]) for j in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    return out


@pytest.mark.parametrize("block_rows", [2048, 3])
def test_simhash_components(spark, odd, empty, block_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("n_chars < 4000").unionByName(odd.select("doc_id", "text").where("doc_id is not null and doc_id <> 10").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = pairs(docs)
    fp = np.array(brute_simhash(rows), np.uint64)
    ids = [d for d, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3):
            a, b = group[i], group[int(j)]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for d, g in zip(ids, group, strict=True):
        least[g] = min(d, least.get(g, d))
    got = simhash.simhash_components(docs, block_rows=block_rows).collect()
    assert Counter((r["doc_id"], r["fp"], r["component_id"]) for r in got) == Counter((d, int(np.int64(np.uint64(f))), least[g]) for d, f, g in zip(ids, fp.astype(np.int64), group, strict=True))
    assert simhash.simhash_components(odd).count() == odd.count() and simhash.simhash_components(empty).count() == 0


def test_hamming_index_finds_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    bits = np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 60), base[:9]])
    block = rng.integers(0, 3, len(bits))
    got = sorted({(min(i, j), max(i, j)) for a, b in simhash.HammingIndex(block, bits).pairs(3, 50) for i, j in zip(a.tolist(), b.tolist(), strict=True)})
    want = [(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if block[i] == block[j] and int(bits[i] ^ bits[j]).bit_count() <= 3]
    assert got == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + k) for k in range(1, 30)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {1000 + k: 1000 for k in range(30)}


def test_near_dup_keeps_one_of_each_group(spark, odd, empty):
    rng = np.random.default_rng(3)
    rows, kept = [], set()
    for g in range(12):
        w = [f"{rng.integers(0, 5000)}" for _ in range(300)]
        kept.add(100 * g)
        for k in range(8):
            c = list(w)
            for p in rng.choice(300, k % 4, replace=False):
                c[p] = "changed"
            rows.append((100 * g + k, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_rows in (1024, 3):
        assert {r["doc_id"] for r in near_dup.keep_one(df, block_rows=block_rows).collect()} == kept
    left = near_dup.keep_one(odd)
    assert left.columns == odd.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, 4, 10, 11, None} <= set(ids) and not {1, 2, 5} & set(ids)
    assert near_dup.keep_one(empty).count() == 0


def word_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("rows", [512, 7])
def test_near_dup_verifies_the_similarity(spark, rows):
    """Pairs on both sides of the limit, of all lengths, with repeated lines, and chains: as brute force."""
    rng = np.random.default_rng(8)
    texts = []
    for g in range(240):
        n = int(rng.integers(8, 60)) if g % 4 == 0 else int(rng.integers(60, 500))
        w = [f"{g}_{rng.integers(0, 5000)}" for _ in range(n)]
        line = [f"line{g}", "of", "five", "or", "six", "words"] * (30 if g % 5 == 0 else 0)
        texts.append(" ".join(w + line))
        for k in range(3 if g % 10 == 0 else 1):  # cut at the front and longer at the end: a similarity from 0.65 to 0.95
            cut = max(1, round(n * rng.uniform(0.025, 0.2)))
            w = w[cut:] + [f"new{g}_{k}_{i}" for i in range(cut)]
            texts.append(" ".join(w + line[: 6 * 3]))
    sets, group = [word_shingles(t) for t in texts], list(range(len(texts)))
    near, just_below = 0, 0
    for i in range(len(texts)):
        for j in range(i + 1, min(i + 4, len(texts))):
            jaccard = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near, just_below = near + (0.8 <= jaccard < 0.87), just_below + (0.7 < jaccard < 0.8)
            if jaccard >= 0.8 and group[i] != group[j]:
                group = [group[i] if x == group[j] else x for x in group]
    assert near > 30 and just_below > 30
    want = {min(i for i in range(len(texts)) if group[i] == g) for g in set(group)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_dup.keep_one(df, block_rows=rows, **({"group_rows": rows} if rows < 512 else {})).collect()} == want


def test_near_dup_large_group_by_tiles(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k:]) for k in range(60)] + [" ".join(base[:100] + [f"y{k}_{i}" for i in range(60)]) for k in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_dup.keep_one(df, group_rows=8).collect()} == {0, *range(60, 69)}


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in p.STAGES[:-1]:
        kept = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == p.COLUMNS, name
        counts.append(docs.count())
        if name == "quality classifier":
            left = {r["doc_id"] for r in docs.collect()}
            bad = [d for d, r in labels.items() if r["quality"] == 0]
            assert sum(d not in left for d in bad) > 0.9 * len(bad)
    assert counts == sorted(counts, reverse=True)
    before, after = {r["doc_id"]: words(r["text"]) for r in kept.collect()}, {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    assert before.keys() == after.keys()
    for (d, w), (n, removed, digest) in zip(before.items(), brute_windows(list(before.values()), 35), strict=True):
        assert (len(w), len(w) - len(after[d])) == (n, removed) and hashlib.sha256(b" ".join(after[d])).hexdigest() == digest
    check_packing(p.STAGES[-1][1](spark, docs, sf).collect(), pairs(docs), 2048, tokenizer())
    assert p.ORACLE_SQL is None
