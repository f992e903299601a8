"""Arrow batches of sorted rows as whole groups, for functions under ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in tables of ``least`` rows or more, cut between groups only."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = [table.column(k)[n - 1].as_py() for k in keys]
        same = [pc.is_null(table.column(k)) if v is None else pc.fill_null(pc.equal(table.column(k), v), False) for k, v in zip(keys, last, strict=True)]
        cut = pc.index(reduce(pc.and_, same), True).as_py()  # sorted: the last group is the tail
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
        least = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row begins a group of ``keys``."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new
