"""Scalar column functions: regions, names, sequences, scores, blocks. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_region(region: Column | str, swap: bool = False) -> Column:
    """``chrom:start-end`` as (chrom, start, end); ``swap`` orders the two coordinates. Null if malformed."""
    r = _c(region)
    part = lambda i: F.regexp_extract(r, r"^(.*):(\d+)-(\d+)$", i)
    a, b = part(2).try_cast("bigint"), part(3).try_cast("bigint")
    lo, hi = (F.least(a, b), F.greatest(a, b)) if swap else (a, b)
    return F.when(a.isNotNull(), F.struct(part(1).alias("chrom"), lo.alias("start"), hi.alias("end")))


def format_region(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(_c(chrom), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(end).cast("string"))


def rsplit_once(x: Column | str, sep: str = ".") -> Column:
    """(head, tail) around the last separator; head is null without one."""
    at = F.length(_c(x)) - F.locate(sep, F.reverse(_c(x))) + 1
    has = F.contains(_c(x), F.lit(sep))
    return F.struct(F.when(has, F.substring(_c(x), F.lit(1), at - 1)).alias("head"), F.substring_index(_c(x), sep, -1).alias("tail"))


def strip_version(x: Column | str, mode: str = "first") -> Column:
    """``first``: up to the first dot; ``last``: up to the last dot; ``number``: without a trailing .digits; ``union``: without U_."""
    x = _c(x)
    return {
        "first": F.substring_index(x, ".", 1),
        "last": F.coalesce(rsplit_once(x)["head"], x),
        "number": F.regexp_replace(x, r"\.\d+$", ""),
        "union": F.regexp_replace(x, r"^U_", ""),
    }[mode]


def is_rna_biotype(biotype: Column | str) -> Column:
    """Normalised biotype is not protein_coding and mentions rna or is ribozyme; null is false."""
    b = F.translate(F.lower(F.trim(_c(biotype))), "- ", "__")
    return F.coalesce((b != "protein_coding") & (F.contains(b, F.lit("rna")) | (b == "ribozyme")), F.lit(False))


def reverse_complement(seq: Column | str, rna: bool = True) -> Column:
    """Upper-cased reverse complement; letters other than ACGTU become N."""
    s = F.regexp_replace(F.upper(_c(seq)), "[^ACGTU]", "N")
    return F.reverse(F.translate(s, "ACGTUN", "UGCAAN" if rna else "TGCAAN"))


def to_rna(seq: Column | str) -> Column:
    return F.translate(F.upper(_c(seq)), "T", "U")


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bed_score(distance: Column | str) -> Column:
    """round(1000 (1 - d)) half to even, within 0..1000; null is 0."""
    d = _c(distance)
    return F.when(d.isNull(), 0).when(d <= 0, 1000).when(d >= 1, 0).otherwise(F.bround(F.lit(1000.0) * (F.lit(1.0) - d), 0)).cast("int")


def int_list(text: Column | str) -> Column:
    """A comma list of integers as an array; a trailing comma is fine, words that are no integers are left out."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())


def absolute_blocks(start: Column | str, sizes: Column | str, starts: Column | str) -> Column:
    """BED12 block lists as absolute (start, end)."""
    zipped = F.arrays_zip(int_list(sizes).alias("n"), int_list(starts).alias("at"))
    return F.transform(zipped, lambda b: F.struct((_c(start) + b["at"]).alias("start"), (_c(start) + b["at"] + b["n"]).alias("end")))


def block_length(start: Column | str, end: Column | str, sizes: Column | str) -> Column:
    """Sum of the blocks, or the span where that is 0."""
    total = F.aggregate(int_list(sizes), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(F.coalesce(total, F.lit(0)) == 0, _c(end) - _c(start)).otherwise(total)


def flip(start: Column | str, end: Column | str, length: Column | str) -> Column:
    """The interval seen from the other strand."""
    return F.struct((_c(length) - _c(end)).alias("start"), (_c(length) - _c(start)).alias("end"))


def first_rule(rules: dict[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds for a row (a rule that is null does not hold)."""
    found = F.when(F.lit(False), otherwise)
    for name, holds in rules.items():
        found = found.when(holds, name)
    return found.otherwise(otherwise)


def spliced(seq: Column | str, blocks: Column | str, minus: Column, per_block: bool = False) -> Column:
    """Concatenated block sequences; on the minus strand reverse-complemented as a whole, or block by block in block order."""
    piece = lambda b: F.substring(_c(seq), b["start"].cast("int") + 1, (b["end"] - b["start"]).cast("int"))
    whole = F.array_join(F.transform(_c(blocks), piece), "")
    if per_block:
        return F.when(minus, F.array_join(F.transform(_c(blocks), lambda b: reverse_complement(piece(b))), "")).otherwise(to_rna(whole))
    return F.when(minus, reverse_complement(whole)).otherwise(to_rna(whole))


def windows(seq: Column | str, width: int, stride: int, whole_if_short: bool = False) -> Column:
    """All full windows; a shorter sequence gives none, or itself."""
    s = _c(seq)
    many = F.transform(F.sequence(F.lit(0), F.length(s) - width, F.lit(stride)), lambda i: F.substring(s, i + 1, F.lit(width)))
    none = F.array(s) if whole_if_short else F.array().cast("array<string>")
    return F.when(F.length(s) >= width, many).otherwise(none)


def finite(values: Column | str) -> Column:
    return F.coalesce(F.forall(_c(values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def biotype_colour(biotype: Column | str, colours: dict[str, str], default: str = "0,0,0") -> Column:
    pairs = [F.lit(x) for kv in colours.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(biotype)), F.lit(default))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.greatest(F.lit(0.0), F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def elapsed(seconds: Column | str) -> Column:
    """Whole hours, minutes and seconds."""
    x = _c(seconds).cast("bigint")
    return F.struct(F.floor(x / 3600).alias("hours"), F.floor(x % 3600 / 60).alias("minutes"), (x % 60).alias("seconds"))


def matched_region(first: Column | str, last: Column | str, length: Column | str, stride: int, window: int) -> Column:
    """The bases under windows ``first`` to ``last``, clipped to the sequence."""
    return F.struct((_c(first) * stride).alias("start"), F.least(_c(last) * stride + window, _c(length)).alias("end"))
