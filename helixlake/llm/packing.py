"""Packing documents into fixed-length training sequences, shortest pack first over the length histogram.

1. Each document is encoded (``bpe.py``), closed with id ``end_id`` and cut into pieces of ``length``
   ids and one remainder; a piece row holds its place, length and CRC-32, not its ids.
2. Pieces are counted by length: at most ``length`` rows go to the driver, whatever the input.
3. Lengths are placed longest first. Each goes to the open packing pattern that is filled least
   (the shortest pack) and has room; patterns carry counts and are split when only some of their
   copies take the length. What fits nowhere opens a pattern.
4. Each piece gets its rank among pieces of its length (two-level: local row numbers in hashed
   parts of about ``PART_ROWS`` rows plus offsets), and the rank gives pattern, sequence and offset by binary search.

A sequence is padded to ``length``; one whose content is a power of two is left as it is. Only
sequences that no piece could fill are padded, a handful whatever the input.

Edge cases: a null text is the lone end id; an empty table gives an empty result; repeated rows are
packed one by one; equal lengths are ranked by a hash of (id, start); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load, no_cycles
from .store import materialize
from .textops import trimmed

PART_ROWS = 1 << 18


def pieces(docs: DataFrame, path: str, id_col: str, text: str, length: int, end_id: int) -> DataFrame:
    from pyspark.sql.types import LongType, StructField, StructType

    made = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        bpe, end = load(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            source, rows = [], []
            with no_cycles():
                for i, ids in enumerate(bpe.encode_column(batch.column(text))):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        part = ids[4 * at : 4 * (at + length)]
                        source.append(i)
                        rows.append((at, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows, strict=True) if rows else ([] for _ in made)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *made])

    return docs.select(id_col, text).mapInArrow(trimmed(run), StructType([docs.schema[id_col], *(StructField(c, LongType()) for c in made)]))


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(copies, lengths in the order placed)] that use each length as often as ``histogram`` says."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # by fill: [copies, lengths]
    full = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        if size > length:
            raise ValueError(f"{size} is longer than a sequence")
        while left:
            fill = min((f for f, packs in open_packs.items() if packs), default=length)
            if fill + size > length:
                # Every open pack is too full: open as many as the rest of this length needs, with one piece each.
                fresh = -(-left // (length // size))
                (full if size == length else open_packs[size]).append([fresh, (size,)])
                left -= fresh
                continue
            pack = open_packs[fill].pop()
            use = min(left, pack[0])
            if use < pack[0]:
                open_packs[fill].append([pack[0] - use, pack[1]])
            left -= use
            (full if fill + size == length else open_packs[fill + size]).append([use, (*pack[1], size)])
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for copies, lengths in [*full, *(p for packs in open_packs.values() for p in packs)]:
        merged[lengths] += copies
    return [(n, lengths) for lengths, n in sorted(merged.items(), reverse=True)]


def _places(patterns: list[tuple[int, tuple[int, ...]]]):
    """Arrays (key of first rank, per pattern, first sequence, start of the first slot) sorted by key = length << 40 | rank."""
    ranked: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for copies, lengths in patterns:
        at = 0
        for size in sorted(set(lengths), reverse=True):
            times = lengths.count(size)
            rows.append(((size << 40) + ranked[size], times, sequence, at))
            ranked[size] += times * copies
            at += times * size
        sequence += copies
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else ()


def _ranked(table: DataFrame, histogram: dict[int, int], *order: str) -> DataFrame:
    """``rank`` from 0 within ``length`` without bringing a length's rows to one task."""
    parts = [-(-histogram.get(n, 0) // PART_ROWS) or 1 for n in range(max(histogram, default=0) + 1)]
    mine = F.expr(f"array({', '.join(map(str, parts))})[cast(length AS INT)]")
    parted = table.withColumn("__part", F.pmod(F.xxhash64(*order), mine).cast("int"))
    counts = parted.groupBy("length", "__part").count()
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order)) - 1
    # bounded: one row per length and one per PART_ROWS pieces (some 50 000 rows for 100 TB of text)
    return parted.join(F.broadcast(offsets), ["length", "__part"]).withColumn("rank", local + F.col("__before")).drop("__part", "__before")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece."""
    cut = materialize(pieces(docs, path, id_col, text, length, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``length`` rows
    key, times, first, begin = _places(shortest_pack_first(histogram, length)) or (np.zeros(0, np.int64),) * 4
    ranked = _ranked(cut, histogram, "start", id_col, "ids_crc32")

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (size << 40) + rank, side="right") - 1
            slot = (size << 40) + rank - key[at]
            sequence, offset = first[at] + slot // times[at], begin[at] + slot % times[at] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    schema = StructType([*(cut.schema[c] for c in names), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)
