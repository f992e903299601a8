"""Substring dedup: remove every word covered by a window of words that also starts elsewhere.

Method: the suffixes of all texts, in groups split by variable-length prefixes, and in each group
the subtree of its suffixes down to the depth of one window (``window`` words), whose internal
nodes at that depth are the repeats.

* Prefixes of ``gram`` words. Each suffix of at least one window's length goes to the group named by
  the smallest ``gram``-word prefix hash met in its first window: a prefix of one of the suffixes in
  that window. Equal windows meet in the same group, and neighbouring suffixes share theirs, so that
  a group has one row per *run* of suffixes, not one per suffix. Groups with a single leaf are
  pruned here: nothing below them repeats. That leaves the copied share of the corpus.
* A group of up to ``part_rows`` rows (of a run's up to ROW suffixes each) fits in a task's memory. Its
  rows carry the words themselves.
  The subtree is built level by level: the nodes at depth 2d are the distinct pairs of nodes at depth
  d, so the nodes at depth ``window`` are told apart by their words, not by hashes. Each of them
  with two leaves or more marks its leaves as repeated; a longer repeat is a chain of such nodes.
* Groups above ``part_rows`` rows (a passage that a large share of all documents holds) get the
  longest prefix, the whole window: their nodes are (group, 128-bit hash of the window's words) keys
  counted where the leaves are read and then with map-side combining, so no task holds a hot node's leaves. Nodes with one leaf give it
  back; every other leaf of the group repeats, so that leaves need not meet their nodes again.

Exact copies are folded first (one text and a count, told apart by 128 bits), which also folds
their suffixes.

Edge cases: a null text has no words; a text under ``window`` words loses nothing; a very long text
is one row of the folded table and is cut whole, in one task; repeated rows are separate documents
whose windows repeat; a null id is returned like any other; an empty table gives an empty result;
other columns are carried along, but the text, and any that is named like an output column, are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import grouped
from .store import bucketed, materialize
from .textops import Block, gram_hashes, sliding_min, text_blocks, trimmed

ROW = 32  # suffixes in a row of a run


def _runs(block: Block, window: int, gram: int):
    """Runs of consecutive windows of a document with the same part: part, first, last window, twice.

    ``twice``: the part's prefix stands at two places of the run. Last the document of each run.
    """
    words = block.word_hashes()
    last = block.first[1:] - window  # last window of each document
    if len(words) < window:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none, none.astype(bool), none
    doc = block.doc_of_word()[: len(words) - window + 1]
    fits = np.arange(len(doc)) <= last[doc]
    grams = gram_hashes(words, gram)
    width = window - gram + 1
    part = sliding_min(grams, width)
    at = np.flatnonzero(fits)
    value, of = part[at], doc[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    first, final, value, of = at[begin], at[end], value[begin], of[begin]
    place = np.empty(len(first), dtype=np.int64)
    for lo in range(0, len(first), 1 << 15):
        hi = lo + (1 << 15)
        place[lo:hi] = first[lo:hi] + (grams[first[lo:hi, None] + np.arange(width)] == value[lo:hi, None]).argmax(axis=1)
    return value, first, final, final > place, of


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Block]]:
    for lo, hi, texts in text_blocks(batch.column("text")):
        yield lo, hi, Block(texts)


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            copies = batch.column("copies").to_numpy()
            for lo, _, block in _blocks(batch):
                part, first, final, twice, of = _runs(block, window, gram)
                leaves, rows = 1 + (twice | (copies[lo + of] > 1)), (final - first) // ROW + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.view(np.int64)), pa.array(k1[lo + of]), pa.array(k2[lo + of]), pa.array(leaves.astype(np.int8)), pa.array(rows.astype(np.int32))],
                    names=["part", "k1", "k2", "w", "rows"],
                )

    return trimmed(run)


def _suffixes(window: int, gram: int):
    """Rows of up to ROW consecutive suffixes for the parts listed in ``parts``, with the words that their first windows span."""

    def run(batches):
        for batch in batches:
            k1, k2, copies = (batch.column(c).to_numpy() for c in ("k1", "k2", "copies"))
            wanted = batch.column("parts")
            for lo, hi, block in _blocks(batch):
                part, first, final, _, of = _runs(block, window, gram)
                keep = np.zeros(len(part), dtype=bool)
                at = np.searchsorted(of, np.arange(hi - lo + 1))
                signed = part.view(np.int64)
                for i in range(hi - lo):
                    if at[i] < at[i + 1]:
                        keep[at[i] : at[i + 1]] = np.isin(signed[at[i] : at[i + 1]], wanted[lo + i].values.to_numpy())
                part, first, final, of = signed[keep], first[keep], final[keep], of[keep]
                if not len(part):
                    continue
                rows = (final - first) // ROW + 1  # a long run takes several rows
                source = np.repeat(np.arange(len(part)), rows)
                begin = first[source] + (np.arange(len(source)) - np.repeat(np.cumsum(rows) - rows, rows)) * ROW
                last = np.minimum(final[source], begin + ROW - 1) + window - 1
                of = of[source]
                spans = zip(block.start[begin].tolist(), block.end[last].tolist(), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[source]),
                        pa.array(k1[lo + of]),
                        pa.array(k2[lo + of]),
                        pa.array((begin - block.first[of]).astype(np.int32)),
                        pa.array(np.where(copies[lo + of] > 1, 2, 1).astype(np.int8)),
                        pa.array([block.data[a:b] for a, b in spans], pa.binary()),
                    ],
                    names=["part", "k1", "k2", "start", "w", "words"],
                )

    return trimmed(run)


def nodes_at_depth(words: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """The node that each suffix passes at ``depth`` words: equal numbers for equal first ``depth`` words.

    Levels 1, 2, 4, ... of the tree: a node at depth 2d is a pair of nodes at depth d, so the last
    level is the pair of nodes that cover the first and the last words of the window.
    """
    level, d = words.astype(np.int64), 1
    while 2 * d <= depth:
        _, level = np.unique(level[:-d] * (level.max(initial=0) + 1) + level[d:], return_inverse=True)
        d *= 2
    pair = level[suffixes] * (level.max(initial=0) + 1) + level[suffixes + depth - d]
    return np.unique(pair, return_inverse=True)[1]


def _subtrees(window: int, rows_at_once: int = 5_000):
    """Input sorted by part. Marks the leaves of nodes at full depth with two leaves or more."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        start, w = (table.column(c).to_numpy() for c in ("start", "w"))
        lists = pc.ascii_split_whitespace(table.column("words").cast(pa.string()).combine_chunks())
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        begin = lists.offsets.to_numpy().astype(np.int64)
        begin -= begin[0]
        words = lists.flatten().dictionary_encode().indices.to_numpy()
        count = np.diff(begin) - window + 1
        row = np.repeat(np.arange(len(start)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        node = nodes_at_depth(words, begin[row] + step, window)
        repeated = np.bincount(node, weights=w[row])[node] >= 2
        mask = np.zeros(len(start), dtype=np.int64)
        np.bitwise_or.at(mask, row[repeated], np.left_shift(np.int64(1), step[repeated]))
        some = mask != 0
        return pa.RecordBatch.from_arrays(
            [pa.array(table.column("k1").to_numpy()[some]), pa.array(table.column("k2").to_numpy()[some]), pa.array(start[some]), pa.array(mask[some])],
            names=["k1", "k2", "start", "mask"],
        )

    def run(batches):
        for table in grouped(batches, "part", rows_at_once):
            yield solve(table)

    return trimmed(run)


def _all_marked(window: int):
    """The marks of all suffixes of each row."""

    def run(batches):
        for batch in batches:
            count = np.fromiter((len(x.split()) for x in batch.column("words").to_pylist()), dtype=np.int64, count=len(batch)) - window + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "start")), pa.array(np.left_shift(np.int64(1), count) - 1)], names=["k1", "k2", "start", "mask"])

    return trimmed(run)


def _leaves(window: int, most: int = 1 << 17):
    """A row per node met (a group, the 128-bit hash of a window's words) with one of its leaves; ``w`` is 2 if it is not the only one.

    Leaves are counted as they are read, up to ``most`` nodes at once, so that the copies of a hot
    passage within a task are one row.
    """

    def rows(met: dict) -> pa.RecordBatch:
        columns = zip(*((part, *leaf, path) for (part, path), leaf in met.items()), strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "k1", "k2", "start", "w", "path"])

    def run(batches):
        met: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        for batch in batches:
            for part, k1, k2, begin, w, text in zip(*(batch.column(c).to_pylist() for c in ("part", "k1", "k2", "start", "w", "words")), strict=True):
                words = text.split()
                for j in range(len(words) - window + 1):
                    node = part, hashlib.blake2b(b" ".join(words[j : j + window]), digest_size=16).digest()
                    met[node] = (k1, k2, begin + j, 2 if node in met else w)
                if len(met) >= most:
                    yield rows(met)
                    met = {}
        if met:
            yield rows(met)

    return trimmed(run)


def _kept(window: int, with_text: bool):
    def run(batches):
        for batch, texts in ((whole.slice(lo, hi - lo), texts) for whole in batches for lo, hi, texts in text_blocks(whole.column("text"))):
            copies, found, alone = batch.column("copies").to_pylist(), batch.column("found"), batch.column("alone")
            n_words, n_removed, digest, kept = [], [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                n = len(words)
                cover = np.zeros(n + 1, dtype=np.int32)
                if copies[i] > 1 and n >= window:
                    cover[0] += 1
                elif found[i].is_valid:
                    rows = found[i].values
                    mask = rows.field("mask").to_numpy()
                    hit = (mask[:, None] >> np.arange(ROW)) & 1 != 0
                    at = (rows.field("start").to_numpy()[:, None] + np.arange(ROW))[hit]
                    if alone[i].is_valid:
                        at = np.setdiff1d(at, alone[i].values.to_numpy())
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + window, 1)
                gone = np.cumsum(cover[:n]) > 0
                removed = int(gone.sum())
                left = b" ".join(words if not removed else [words[j] for j in np.flatnonzero(~gone)])
                n_words.append(n)
                n_removed.append(removed)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append((text if not removed else left).decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                names=["k1", "k2", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return trimmed(run)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__k1": F.xxhash64(body), "__k2": F.xxhash64(F.lit(1), body)})


def substring_dedup(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 8, part_rows: int = 4096, with_text: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    ``kept_text`` is the untouched text where no word is removed, else the kept words joined by one space.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    folded = (
        _keyed(docs.select(text), text)
        .select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), body.alias("text"))
        .groupBy("k1", "k2")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    folded = bucketed(folded, ["k1", "k2"], "folded")  # read three times, moved once
    anchors = materialize(folded.mapInArrow(_anchors(window, gram), "part long, k1 long, k2 long, w byte, rows int"), "anchors")
    parts = anchors.groupBy("part").agg(F.sum("w").alias("leaves"), F.sum("rows").alias("total")).where("leaves > 1")
    wanted = anchors.join(parts, "part").groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("total") <= part_rows, F.col("part"))).alias("cold"), F.collect_set(F.when(F.col("total") > part_rows, F.col("part"))).alias("hot")
    )
    wanted = materialize(wanted, "parts")
    shape = "part long, k1 long, k2 long, start int, w byte, words binary"

    def suffixes(kind: str) -> DataFrame:
        some = wanted.where(F.size(kind) > 0).select("k1", "k2", F.col(kind).alias("parts"))
        return folded.join(some, ["k1", "k2"]).mapInArrow(_suffixes(window, gram), shape)

    found = suffixes("cold").repartition("part").sortWithinPartitions("part").mapInArrow(_subtrees(window), "k1 long, k2 long, start int, mask long")
    if not wanted.where(F.size("hot") > 0).isEmpty():
        hot = materialize(suffixes("hot"), "hot")
        leaves = hot.mapInArrow(_leaves(window), "part long, k1 long, k2 long, start int, w byte, path binary")
        single = leaves.groupBy("part", "path").agg(F.sum("w").alias("leaves"), *(F.min(c).alias(c) for c in ("k1", "k2", "start"))).where("leaves = 1")
        found = found.unionByName(hot.mapInArrow(_all_marked(window), found.schema)).unionByName(single.select("k1", "k2", "start", F.lit(0).cast("long").alias("mask")))
    # a mask of 0: the one leaf of its node in a hot group
    marks = found.groupBy("k1", "k2").agg(F.collect_list(F.when(F.col("mask") != 0, F.struct("start", "mask"))).alias("found"), F.collect_list(F.when(F.col("mask") == 0, F.col("start"))).alias("alone"))
    kept = (
        folded.join(marks, ["k1", "k2"], "left")
        .mapInArrow(_kept(window, with_text), "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept_text string")
        .select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
    )
    clash = [c for c in docs.columns if c in kept.columns]
    rows = _keyed(docs, text).drop(text, *clash)
    return rows.join(kept, ["__k1", "__k2"], "left").drop("__k1", "__k2")
