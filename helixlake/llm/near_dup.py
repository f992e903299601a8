"""SimHash near-dedup at a word-shingle similarity: groups of documents with a Jaccard similarity of 0.8 or more.

The similarity is that of the sets of five-word shingles (A-Z lowered), and every link is verified by it:
a group is tied only by pairs whose exact Jaccard similarity is at least ``least``.

Candidates come from a wide SimHash (``WIDE`` times 64 bits) of the distinct shingles, whose distance
estimates the angle between two documents: 78 of 512 bits at 0.8 (standard error 8), so the loose
radius ``max_bits`` of 128 loses hardly a pair at 0.8. No set of bit blocks can promise that radius,
so documents meet in blocks named by ``BANDS`` bands of ``BAND`` smallest shingle hashes each: two
documents of similarity 0.8 share one with probability 0.998. Within a block the Gray-order index
finds the pairs (on the first 64 bits, within ``radius``), the wide distance thins them, and a
spanning forest leaves the task. A block above ``block_rows`` rows is dealt into tiles, every pair
of which meets in one task. Texts that are equal are one node from the start.

Each component of candidates then meets once with its texts (dealt into tiles above ``group_rows``):
pairs within ``max_bits`` that no verified links tie yet are verified, and verified links make the groups.

Edge cases: null and empty texts are equal texts without words, so they form one group; fewer than
five words are one shingle; a very long text is sketched and verified whole, in one task; a null id
stays only where its whole group has null ids; of rows that share id and text one stays, the least
by a hash of its columns; an empty table gives an empty result; all other columns are carried along,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .simhash import HammingIndex, bit_counts, forest, grouped
from .store import materialize
from .textops import Block, encoded, gram_hashes, in_blocks, mix, text_blocks, trimmed

WIDE, BANDS, BAND, SHINGLE = 8, 12, 4, 5
_U = np.uint64
_MULTIPLIERS = mix(np.arange(1, BANDS * BAND + 1, dtype=_U)) | _U(1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts end to end, sorted within each text, and where each text begins."""
    block = Block([t.lower() for t in texts])
    words, count = block.word_hashes(), np.diff(block.first)
    grams = [gram_hashes(words, k) for k in range(1, SHINGLE + 1)]
    k = np.minimum(count, SHINGLE)  # shorter texts are one shingle of all their words
    shingles = np.where(count > 0, count - np.maximum(k, 1) + 1, 1)
    begin = np.cumsum(shingles) - shingles
    h = np.zeros(shingles.sum(), dtype=_U)
    long = count >= SHINGLE
    source = np.repeat(block.first[:-1] - begin, shingles) + np.arange(len(h))
    of_long = np.repeat(long, shingles)
    h[of_long] = grams[-1][source[of_long]]
    for i in np.flatnonzero(~long & (count > 0)):
        h[begin[i]] = grams[count[i] - 1][block.first[i]]
    sets = [np.unique(h[i : i + n]) for i, n in zip(begin.tolist(), shingles.tolist(), strict=True)]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    return np.concatenate(sets), np.cumsum(size) - size


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(documents x WIDE fingerprint words, documents x BANDS band hashes)."""
    n = len(texts)
    h, begin = shingle_sets(texts)
    shingles = np.diff(np.append(begin, len(h)))
    wide = np.empty((n, WIDE), dtype=_U)
    for w in range(WIDE):
        bits = bit_counts(mix(h + _U(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), begin) * 2 > shingles[:, None]
        wide[:, w] = np.packbits(bits, axis=1, bitorder="little").view(_U)[:, 0]
    bands = np.zeros((n, BANDS), dtype=_U)
    for b in range(BANDS):
        for r in range(BAND):
            bands[:, b] = mix(bands[:, b] + np.minimum.reduceat(h * _MULTIPLIERS[b * BAND + r], begin))
    return wide, bands


def _sketched(batches):
    for batch in batches:
        for lo, hi, texts in text_blocks(batch.column("text")):
            wide, bands = sketches(texts)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (wide, bands)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("node").slice(lo, hi - lo), *lists], names=["id", "node", "wide", "bands"])


def _taken(node: pa.Array, at: np.ndarray) -> pa.Array:
    taken = node.take(pa.array(at))
    return taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken


def _pairs(radius: int, max_bits: int):
    def run(batches):
        for table in grouped(batches, rows=20_000):
            node, block = table.column("node").combine_chunks(), table.column("block").to_numpy()
            wide = table.column("wide").combine_chunks().flatten().to_numpy().view(_U).reshape(len(node), -1)
            label = np.arange(len(node))
            for i, j in HammingIndex(block, wide[:, 0].copy()).pairs(radius, 1_000_000):
                apart = np.zeros(len(i), dtype=np.int64)
                for w in range(wide.shape[1]):
                    apart += np.bitwise_count(wide[i, w] ^ wide[j, w])
                near = apart <= max_bits
                label = forest(len(node), i[near], j[near], label)
            tied = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([_taken(node, tied), _taken(node, label[tied])], names=["a", "b"])

    return run


def verified_links(wide: np.ndarray, sets: list[np.ndarray], max_bits: int, least: float) -> list[tuple[int, int]]:
    """Links that tie just the documents that pairs of a Jaccard similarity of at least ``least`` (and within ``max_bits``) tie."""
    n, label, links = len(sets), np.arange(len(sets)), []
    size = np.array([len(x) for x in sets])
    for i in range(n - 1):
        apart = np.bitwise_count(wide[i + 1 :] ^ wide[i]).sum(axis=1, dtype=np.int64)
        other = size[i + 1 :]
        able = (apart <= max_bits) & (np.minimum(other, size[i]) / np.maximum(other, size[i]) >= least) & (label[i + 1 :] != label[i])
        at = np.flatnonzero(able)
        for j in (at[np.argsort(apart[at], kind="stable")] + i + 1).tolist():
            if label[i] == label[j]:
                continue
            few, many = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            common = int(np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few))
            if common / (len(few) + len(many) - common) >= least:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def _verified(max_bits: int, least: float, rows: int):
    def run(batches):
        for table in grouped(batches, rows=rows):
            node, block = table.column("node").combine_chunks(), table.column("block").to_numpy()
            wide = table.column("wide").combine_chunks().flatten().to_numpy().view(_U).reshape(len(node), -1)
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            found = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    sets, texts = [], encoded(table.column("text").slice(lo, hi - lo))
                    for a, b in in_blocks([len(t) for t in texts]):
                        h, begin = shingle_sets(texts[a:b])
                        sets += np.split(h, begin[1:])
                    found += [(lo + i, lo + j) for i, j in verified_links(wide[lo:hi], sets, max_bits, least)]
            at = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([_taken(node, at[:, 0]), _taken(node, at[:, 1])], names=["a", "b"])

    return run


def _dealt(blocks: DataFrame, block_rows: int, broadcast_rows: int, tag: str) -> DataFrame:
    """(node, wide, block): blocks above ``block_rows`` rows as tiles, every pair of which makes a block."""
    held = blocks.groupBy("block").count()
    large = materialize(held.where(F.col("count") > block_rows).select("block", F.ceil(F.col("count") / block_rows).cast("int").alias("tiles")), tag)
    n_large = large.count()
    if not n_large:
        return blocks
    tiled = blocks.join(F.broadcast(large) if n_large <= broadcast_rows else large, "block", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.expr("cast(pmod(xxhash64(node), tiles) as int)")).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    return tiled.select("node", "wide", F.when(F.col("tiles") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("tile", "other"), F.greatest("tile", "other"))).alias("block"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.8, max_bits: int = 128, radius: int = 24,
    block_rows: int = 1024, group_rows: int = 512, broadcast_rows: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each group of near copies (similarity ``least`` or more, directly or over others)."""
    body = F.coalesce(F.col(text), F.lit(""))
    node = F.unhex(F.md5(body.cast("binary")))  # 128 bits: different texts do not share one
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), node.alias("node"), body.alias("text"))
    found = materialize(rows.mapInArrow(trimmed(_sketched), f"id {id_type}, node binary, wide array<long>, bands array<long>"), "sketches")
    texts = found.groupBy("node").agg(F.min("id").alias("least"), F.first("wide").alias("wide"), F.first("bands").alias("bands"))
    texts = materialize(texts, "texts")
    blocks = texts.select("node", "wide", F.posexplode("bands").alias("band", "value")).select("node", "wide", F.xxhash64("band", "value").alias("block"))
    blocks = _dealt(blocks, block_rows, broadcast_rows, "large")
    links = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_pairs(radius, max_bits)), "a binary, b binary")
    loose = materialize(components(links), "candidates")
    members = loose.select("node")
    members = F.broadcast(members) if members.count() <= broadcast_rows else members
    bodies = rows.select("node", "text").join(members, "node").groupBy("node").agg(F.first("text").alias("text"))
    groups = _dealt(loose.join(texts.select("node", "wide"), "node").select("node", "wide", F.xxhash64("root").alias("block")), group_rows, broadcast_rows, "large_groups")
    links = groups.join(bodies, "node").repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_verified(max_bits, least, group_rows)), "a binary, b binary")
    tied = components(links)
    root = texts.select("node", "least").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = root.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "node")).alias("kept"))
    first = first.select(F.col("kept.node").alias("__node"), F.col("kept.id").alias("__id"))
    repeated = found.groupBy("node", "id").count().where("count > 1").limit(1).count()
    names = [c for c in docs.columns]
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), node.alias("node"), F.col(id_col).alias("id"))
    kept = kept.join(first, (kept["node"] == first["__node"]) & kept["id"].eqNullSafe(first["__id"]), "left_semi")
    if repeated:  # the least of the rows that share id and text, by a hash of all their columns
        order = F.xxhash64(*(F.col("row")[c] for c in names if "map<" not in docs.schema[c].dataType.simpleString()))
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(order))).where("nth = 1")
    return kept.select("row.*")
