"""SimHash near-dedup over a Gray-order hierarchical index.

``fingerprints``: 64-bit SimHash of word shingles (XXH64, majority of bits).
``HammingIndex``: fingerprints of one block sorted by Gray rank. Runs of FANOUT neighbours form
nodes that hold the bits all members share (mask and pattern), level upon level up to a root.
A self-join walks pairs of nodes downwards; each step adds the differences in the bits that are
newly shared below and drops the pair, with everything under it, once the sum passes the radius.
All blocks of a partition are walked together, level by level, in NumPy.

``link_fingerprints``: all links within 3 bits, whole at any size. Two fingerprints that differ in
at most 3 bits agree in at least one of 4 blocks of 16 bits (pigeonhole), so each distinct
fingerprint goes to 4 blocks. A block above ``block_rows`` rows is split by the same argument over
4 pieces of 12 of its other 48 bits, and if such a piece is still too large, it is dealt into
tiles, every pair of which meets in one task. Within a task, links are reduced to a spanning
forest, which loses no connection; components follow from alternating stars (``components.py``).

Edge cases: null text means no words; no words give fingerprint zero, which links like any other;
fewer words than a shingle give one shingle of all words; repeated rows share a component; a null
id takes part in links, but a component's id is its smallest non-null id; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize
from .textops import encoded, mix

FANOUT = 4
_U = np.uint64


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of the A-Z-lowered words, joined by one space; repeats included."""
    words = text.lower().split()  # on bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, dtype=_U)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], dtype=_U)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = np.concatenate(([0], ends[:-1]))
    spans = zip(begins[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=_U, count=len(words) - shingle + 1)


#: For each byte, its eight bits as the eight byte-wide lanes of a 64-bit word, so that up to 255 hashes add without carry.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(_U)[:, 0]


def bit_counts(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits, for each range that starts at ``begin`` (none may be empty)."""
    size = np.diff(np.append(begin, len(hashes)))
    runs = -(-size // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(begin, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * 255
    lanes = np.add.reduceat(_LANES[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)], at, axis=0)
    return np.add.reduceat(lanes.view(np.uint8).reshape(len(at), 64), first, axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        count += bit_counts(hashes[lo : lo + (1 << 16)], np.zeros(1, dtype=np.int64))[0]
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(_U)[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> _U(s)
    return x


class HammingIndex:
    """Hierarchical index over the fingerprints of many blocks; ``pairs`` yields links within a radius."""

    def __init__(self, block: np.ndarray, bits: np.ndarray) -> None:
        self.order = np.lexsort((gray_rank(bits), block))
        block, bits = block[self.order], bits[self.order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = block[1:] != block[:-1]
        self.begin = np.flatnonzero(new)
        self.size = np.diff(np.append(self.begin, len(block)))
        first, size = self.begin, self.size
        self.levels = [(first, size, bits, np.full(len(bits), ~_U(0)))]
        while len(size) and size.max() > 1:
            _, _, pattern, mask = self.levels[-1]
            above = -(-size // FANOUT)
            start = np.concatenate(([0], np.cumsum(above)))
            within = np.arange(start[-1]) - np.repeat(start[:-1], above)
            child = np.repeat(first, above) + within * FANOUT
            shared = np.bitwise_and.reduceat(mask, child) & ~(np.bitwise_or.reduceat(pattern, child) ^ np.bitwise_and.reduceat(pattern, child))
            pattern = np.bitwise_and.reduceat(pattern, child) & shared
            first, size = start[:-1], above
            self.levels.append((first, size, pattern, shared))

    def pairs(self, radius: int, budget: int = 2_000_000):
        """(i, j) index arrays into the input, i != j, each link once; blocks go in groups whose squares sum to ``budget``."""
        cost, group = 0, []
        for b, n in enumerate(self.size.tolist()):
            if n > 1:
                group.append(b)
                cost += n * n
                if cost >= budget:
                    yield from self._walk(np.array(group), radius)
                    cost, group = 0, []
        if group:
            yield from self._walk(np.array(group), radius)

    def _walk(self, blocks: np.ndarray, radius: int):
        owner = blocks
        u = v = self.levels[-1][0][blocks]  # the roots
        met = self.levels[-1][3][u]
        sums = np.zeros(len(u), dtype=np.int64)
        for level in range(len(self.levels) - 2, -1, -1):
            first, size, pattern, mask = self.levels[level]
            up = self.levels[level + 1][0]
            a, b = (first[owner] + (x - up[owner]) * FANOUT for x in (u, v))
            end = first[owner] + size[owner]
            nodes = [[], [], [], [], []]
            for i in range(FANOUT):
                for j in range(FANOUT):
                    x, y = a + i, b + j
                    ok = np.flatnonzero((x < end) & (y < end) & ((u != v) | (x <= y)))
                    x, y = x[ok], y[ok]
                    both = mask[x] & mask[y]
                    total = sums[ok] + np.bitwise_count((pattern[x] ^ pattern[y]) & both & ~met[ok])
                    near = total <= radius
                    for to, z in zip(nodes, (owner[ok], x, y, both, total), strict=True):
                        to.append(z[near])
            owner, u, v, met, sums = (np.concatenate(z) for z in nodes)
        link = u != v
        yield self.order[u[link]], self.order[v[link]]


def forest(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while (label[label] != label).any():
            label = label[label]
        if (before == label).all():
            return label


def grouped(batches, column: str = "block", rows: int = 50_000):
    """Tables of whole groups of a stream that is sorted by ``column``."""
    held, have = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        have += batch.num_rows
        if have >= rows:
            table = pa.Table.from_batches(held)
            key = table.column(column).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
                held, have = table.slice(cut).to_batches(), len(key) - cut
    if have:
        yield pa.Table.from_batches(held)


def _links(radius: int):
    def run(batches):
        for table in grouped(batches):
            block, bits = table.column("block").to_numpy(), table.column("fp").to_numpy().view(_U)
            label = np.arange(len(bits))
            for i, j in HammingIndex(block, bits).pairs(radius):
                label = forest(len(bits), i, j, label)
            tied = np.flatnonzero(label != np.arange(len(bits)))
            signed = bits.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[tied]), pa.array(signed[label[tied]])], names=["a", "b"])

    return run


def _bits(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def blocks(distinct: DataFrame, block_rows: int) -> DataFrame:
    """(block, fp): every two fingerprints within 3 bits share a block; blocks hold about block_rows rows at most."""
    fp = F.col("fp")
    first = distinct.select("fp", F.explode(F.array(*(F.shiftleft(F.lit(b), 16).bitwiseOR(_bits(fp, 16 * b, 16).cast("int")) for b in range(4)))).alias("top"))
    large = first.groupBy("top").count().where(F.col("count") > block_rows).select("top", F.lit(True).alias("large"))
    first = first.join(F.broadcast(large), "top", "left")  # at most 4 * 65536 keys, whatever the input
    plain = first.where("large is null").select(F.xxhash64("top").alias("block"), "fp")
    # Rotated so that the shared 16 bits come lowest, the other 48 are bits 16..63.
    turn = F.expr("16 * (top div 65536)")
    turned = F.when(turn == 0, fp).otherwise(F.expr("shiftrightunsigned(fp, 16 * (top div 65536))").bitwiseOR(F.expr("shiftleft(fp, 64 - 16 * (top div 65536))")))
    second = first.where("large").select("fp", "top", F.posexplode(F.array(*(_bits(turned, 16 + 12 * p, 12) for p in range(4)))).alias("piece", "bits"))
    second = second.select("fp", F.xxhash64("top", "piece", "bits").alias("sub"))
    count = second.groupBy("sub").count().select("sub", F.ceil(F.col("count") / block_rows).cast("int").alias("tiles"))
    tiled = second.join(count, "sub").withColumn("tile", F.expr("cast(pmod(xxhash64(fp), tiles) as int)"))
    tiled = tiled.select("fp", "sub", "tile", F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    return plain.unionByName(tiled.select(F.xxhash64("sub", F.least("tile", "other"), F.greatest("tile", "other")).alias("block"), "fp"))


def link_fingerprints(distinct: DataFrame, radius: int = 3, block_rows: int = 2048) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` that differ in at most ``radius`` <= 3 bits."""
    if radius > 3:
        raise ValueError("four blocks can only promise a radius of 3")
    return blocks(distinct, block_rows).repartition("block").sortWithinPartitions("block").mapInArrow(_links(radius), "a long, b long")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """All columns of docs but the text, and ``name``: the fingerprint as a signed long."""
    others = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        for batch in batches:
            fp = np.array([majority(shingle_hashes(t, shingle)) for t in encoded(batch.column(text))], dtype=_U)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(fp.view(np.int64))], names=[*others, name])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.select(*others, text).mapInArrow(run, StructType([*(docs.schema[c] for c in others), StructField(name, LongType())]))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, block_rows: int = 2048) -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints link, directly or over others, share a component."""
    fps = materialize(fingerprints(docs.select(id_col, text), text, shingle), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    tied = components(link_fingerprints(distinct.select("fp"), radius, block_rows))
    group = distinct.join(tied.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(group.join(least, "root").select("fp", "component_id"), "fp", "left").select(id_col, "fp", "component_id")
