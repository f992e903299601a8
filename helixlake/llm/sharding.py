"""Sharding by sampled splitters: near-equal bytes, in DataFrame expressions only.

Records are ordered by (hash of the text, hash of the id). Copies of a text are neighbours, so a
group of copies stays together as far as equal shards allow.

1. Splitters: each record is drawn with probability size / step (a hash of its key decides, so a
   repeated task draws the same records); quantiles of the drawn keys cut the key range.
2. Records are dealt to the ranges; counts and bytes of each range are exact. A range of more than
   twice the mean (a hot group of copies) is subdivided by the id's hash into even pieces.
3. Running bytes within a piece plus the bytes of all pieces before give each record its place in
   the total order; shard = place * shards / total. Slots are places counted in rows.

Only the splitters (``shards * fine - 1`` longs), the pieces' sums and each shard's first row are
gathered, the latter two by Spark itself in broadcasts whose row count is fixed by the parameters.

Edge cases: null text has no bytes; a null id sorts first; repeated rows fill slots of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text", fine: int = 8, draws: int = 64, piece_bytes: int = 4 << 30) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard); sizes of any two shards differ by less than two records."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
        F.xxhash64(body).alias("k"),
        F.xxhash64(F.lit(7), F.col(id_col), body).alias("r"),
    )
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0]
    ranges = shards * fine
    step = max(1.0, (total or 1) / (ranges * draws))
    luck = F.xxhash64(F.lit(11), "k", "r").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    # a record of several steps counts as often, so that quantiles weigh bytes
    drawn = rows.where(luck < F.col("size") / F.lit(step)).select("k", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("size") / F.lit(step)).cast("int")))))
    cuts = drawn.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10000).alias("cuts"))
    splitters = sorted(set(cuts.first()[0] or []))
    table = "array(" + ", ".join(f"{s}L" if s != -(1 << 63) else "(-9223372036854775807L - 1L)" for s in splitters) + ")"
    spot = F.expr(f"size(filter({table}, s -> s <= k))") if splitters else F.lit(0)
    dealt = rows.withColumn("range", spot.cast("int"))
    # Subdivide overfull ranges: even pieces of the id hash, as many as the range exceeds the limit.
    most = max(1.0, min(2.0 * (total or 1) / ranges, float(piece_bytes)))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("held"))
    sums = sums.select("range", F.ceil(F.col("held") / most).cast("int").alias("pieces"))
    parts = dealt.join(F.broadcast(sums), "range")  # one row per range
    leading = F.shiftrightunsigned(F.col("r").bitwiseXOR(F.lit(-(1 << 63))), 33)  # 31 bits, in the order of r
    parts = parts.withColumn("piece", F.floor(leading * F.col("pieces") / float(1 << 31)).cast("int"))
    parts = parts.withColumn("lead", F.when(F.col("pieces") == 1, F.col("k")).otherwise(F.col("r")))
    held = parts.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"))
    inside = Window.partitionBy("range", "piece").orderBy("lead", "r", "k", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(held), ["range", "piece"]).select(
        "id", "size", "crc",
        (F.col("bytes0") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"),
        (F.col("rows0") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))).alias("row"),
    )
    middle = F.col("at") + F.col("size") / 2.0
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / float(total or 1))).cast("int"))
    placed = materialize(placed, "placed")
    begin = placed.groupBy("shard").agg(F.min("row").alias("row0"))  # one row per shard
    return placed.join(F.broadcast(begin), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("row0")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
