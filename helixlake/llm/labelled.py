"""The labelled documents that the classifiers learn from: all of them, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def _labels(labels: DataFrame, label: str, learn: Column, id_col: str) -> DataFrame:
    return labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(id_col).agg(F.max(label).alias("y"))


def _marked(docs: DataFrame, ids: DataFrame, id_col: str, most: int = 1 << 14) -> DataFrame:
    """The rows of docs whose id may be in ``ids``: all that are and, by hashes that meet, few others.

    A bit of a map for each hash, 8 to 16 bits an id, in pieces of 4 KB; ``most`` pieces are broadcast at most.
    """
    bits = 1 << 15
    pieces = min(most, 1 << max(0, 8 * ids.count() // bits).bit_length())
    at = F.pmod(F.xxhash64(id_col), F.lit(pieces * bits))
    maps = ids.select(at.alias("__at")).groupBy(F.expr(f"__at div {bits}").alias("__piece")).agg(F.bitmap_construct_agg(F.expr(f"__at % {bits}")).alias("__map"))
    found = docs.withColumn("__at", at).withColumn("__piece", F.expr(f"__at div {bits}")).join(F.broadcast(maps), "__piece")
    byte = f"cast(conv(hex(substring(__map, cast(__at % {bits} div 8 + 1 AS int), 1)), 16, 10) AS int)"
    return found.where(F.expr(f"getbit({byte}, cast(__at % 8 AS int)) = 1")).select(*docs.columns)


def known(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, text): every labelled document that ``learn`` admits; ids that repeat as in ``sample``.

    The labels grow with the documents, so they are not broadcast, at small sizes neither: one plan at
    all sizes. Of the texts, those without a label are left behind before they are moved.
    """
    marks = _labels(labels, label, learn, id_col)
    some = _marked(docs.select(id_col, text).where(learn), marks, id_col).join(marks.hint("merge"), id_col)
    return some.select(F.col("y").cast("int").alias("y"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(y, text): up to ``per_class`` labelled documents of each class, chosen by a hash of the id.

    Only the ids and labels of the sample (2 * per_class rows at most) are broadcast. An id that is
    labelled more than once counts with its greater label; one that stands on several documents
    may give several rows.
    """
    known = _labels(labels, label, learn, id_col)
    order = F.xxhash64(F.lit(3), id_col)
    some = known.where("y = 1").orderBy(order, id_col).limit(per_class).unionByName(known.where("y = 0").orderBy(order, id_col).limit(per_class))
    return docs.select(id_col, text).join(F.broadcast(some), id_col).select(F.col("y").cast("int").alias("y"), F.coalesce(F.col(text), F.lit("")).alias("text"))
