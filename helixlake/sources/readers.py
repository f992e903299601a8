"""Readers: BED, TSV, GTF, PSL, JSON, chrom sizes, alignment chains (DataSource), sequence chunks, array files."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from helixlake.functions.scalar import absolute_blocks, block_length

BED12 = (
    "chrom string, start bigint, end bigint, name string, score int, strand string, thick_start bigint, thick_end bigint, rgb string, "
    "block_count int, block_sizes string, block_starts string"
)
BED9 = "chrom string, start bigint, end bigint, name string, score int, strand string, thick_start bigint, thick_end bigint, rgb string"


def strand_sign(strand: Column) -> Column:
    return F.when(strand.isin("-", "-1"), -1).otherwise(1).cast("tinyint")


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts with absolute blocks; rows with missing columns are left out."""
    rows = spark.read.schema(BED12).csv(path, sep="\t", comment="#", mode="PERMISSIVE").where("block_starts is not null")
    return rows.withColumns({"strand": strand_sign(F.col("strand")), "blocks": absolute_blocks("start", "block_sizes", "block_starts")})


def bed_lengths(lines: DataFrame) -> DataFrame:
    """(name, length) of raw BED lines (column ``value``): summed blocks, or the span where they sum to nothing; notes and blanks are skipped."""
    f = F.split("value", "\t")
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#") & (F.size(f) >= 4))
    rows = rows.select(f[3].alias("name"), f[1].try_cast("bigint").alias("s"), f[2].try_cast("bigint").alias("e"), F.get(f, F.lit(10)).alias("sizes"))
    return rows.where("s is not null and e is not null").select("name", F.coalesce(block_length("s", "e", "sizes"), F.col("e") - F.col("s")).alias("length"))


def read_bed(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(BED9).csv(path, sep="\t", comment="#")
    return rows.select(*columns) if columns else rows


def read_species(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """BED9 files of several species with their lineage in ``species``."""
    frames = [read_bed(spark, p).withColumn("species", F.lit(s)) for s, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_table(spark: SparkSession, path: str, required: list[str], sep: str = "\t") -> DataFrame:
    """Header-addressed text table; fails when a required column is missing; rows without them are left out."""
    rows = spark.read.csv(path, sep=sep, header=True)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return rows.dropna(subset=required) if required else rows


def read_metadata(spark: SparkSession, path: str, columns: dict[str, str | int]) -> DataFrame:
    """A TSV with header whose columns are addressed by name or position and renamed."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(*(F.col(f"`{rows.columns[c] if isinstance(c, int) else c}`").alias(n) for n, c in columns.items()))


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """First value of each key in file order."""
    rows = spark.read.csv(path, sep="\t", header=True).withColumn("__at", F.monotonically_increasing_id())
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(value, "__at").alias(value))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, size bigint").csv(path, sep="\t")


def gtf_attribute(attributes: Column | str, name: str) -> Column:
    got = F.regexp_extract(attributes, rf'(?:^|;)\s*{name} "([^"]*)"', 1)
    return F.when(got != "", got)


def gtf_tags(attributes: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(attributes, F.lit(r'tag "([^"]*)"'), 1))


def read_gtf(spark: SparkSession, path: str, feature: str = "transcript", gene_types: list[str] | None = None) -> DataFrame:
    schema = "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string"
    rows = spark.read.schema(schema).csv(path, sep="\t", comment="#", quote="").where(F.col("feature") == feature)
    names = ["transcript_id", "gene_id", "gene_name", "gene_type", "transcript_type", "level", "transcript_support_level"]
    rows = rows.select("chrom", (F.col("start") - 1).alias("start"), "end", "strand", *(gtf_attribute("attributes", n).alias(n) for n in names), gtf_tags("attributes").alias("tags"))
    return rows.where(F.col("gene_type").isin(gene_types)) if gene_types else rows


def read_psl(spark: SparkSession, path: str, bin_column: bool = True) -> DataFrame:
    """Aligned blocks of a headerless PSL: (t_name, t_start, t_end, blocks)."""
    at = 1 if bin_column else 0
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f[13 + at].alias("t_name"), f[15 + at].cast("bigint").alias("t_start"), f[16 + at].cast("bigint").alias("t_end"), f[18 + at].alias("n"), f[20 + at].alias("s"))
    zipped = lambda: F.arrays_zip(F.split("n", ",").alias("n"), F.split("s", ",").alias("s"))
    blocks = F.transform(F.filter(zipped(), lambda b: b["n"] != ""), lambda b: F.struct(b["s"].cast("bigint").alias("start"), (b["s"].cast("bigint") + b["n"].cast("bigint")).alias("end")))
    return rows.select("t_name", "t_start", "t_end", blocks.alias("blocks")).where("t_start is not null")


def read_nested(spark: SparkSession, path: str, value_schema: str, lines: bool = False) -> DataFrame:
    """JSON objects of id -> value, one per file or one per line, as rows (id, value)."""
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("id", "value"))


def read_arrays(path: str) -> dict:
    """Arrays of an .npz file on the driver (models: small by nature)."""
    import numpy as np

    with np.load(path) as z:
        return {k: z[k] for k in z.files}


def scan_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, i, j, value): the cells of the one- and two-dimensional arrays of .npz files, read by Spark's binary reader."""
    import io

    import numpy as np
    import pandas as pd

    def cells(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for name in z.files:
                        x = z[name].reshape(len(z[name]), -1).astype(float)
                        i, j = np.divmod(np.arange(x.size), max(1, x.shape[1]))
                        yield pd.DataFrame({"file": file, "name": name, "i": i, "j": j, "value": x.ravel()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(cells, "file string, name string, i long, j long, value double")


def read_report(spark: SparkSession, path: str, schema: StructType, kind: str) -> DataFrame:
    """A report written by ``write_report``."""
    if kind == "json":
        return spark.read.schema(schema).json(path)
    return spark.read.schema(schema).csv(path, sep="\t" if kind == "tsv" else ",", header=True)


CHAIN_BLOCKS = "chain_id long, score long, chrom string, t_size long, q_chrom string, q_size long, q_strand int, block int, s long, e long, q_s long"


def read_chains(spark: SparkSession, path: str, min_score: int = 25_000) -> DataFrame:
    """Alignment chains as block rows, from any store that Spark reads.

    Records are split at blank lines by Spark's text reader, so a large file is read by many tasks
    (a gz file by one); chains below ``min_score`` are dropped by their header before they are parsed.
    """
    import numpy as np
    import pandas as pd

    def parse(frames):
        for frame in frames:
            heads, cells, counts = [], [], []
            for record in frame["value"]:
                lines = [x for x in record.split("\n") if x.strip() and not x.startswith("#")]
                f = lines[0].split()
                heads.append((int(f[12]), int(f[1]), f[2], int(f[3]), f[7], int(f[8]), -1 if f[9] == "-" else 1, int(f[5]), int(f[10])))
                counts.append(len(lines) - 1)
                cells += [[*map(int, x.split()), 0, 0][:3] for x in lines[1:]]  # the last block has no gap
            if not cells:
                continue
            size, t_gap, q_gap = np.array(cells, dtype=np.int64).T
            of = np.repeat(np.arange(len(counts)), counts)
            begin = np.cumsum(counts) - counts  # the first block of each chain

            def before(step):
                total = np.cumsum(step) - step  # of all chains of the frame, so that of the chain's first block is taken off
                return total - total[np.minimum(begin, len(step) - 1)][of]

            columns = [np.array(c, dtype=object if isinstance(c[0], str) else np.int64)[of] for c in zip(*heads, strict=True)]
            t, q = columns[7] + before(size + t_gap), columns[8] + before(size + q_gap)
            yield pd.DataFrame(dict(zip(names, [*columns[:7], np.arange(len(of)) - begin[of], t, t + size, q], strict=True)))

    names = [c.split()[0] for c in CHAIN_BLOCKS.split(", ")]
    records = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", r"\A(?:\s|#[^\n]*\n)*", "").alias("value"))
    score = F.split(F.substring_index("value", "\n", 1), r"\s+")[1].try_cast("bigint")
    return records.where(F.col("value").startswith("chain") & (score >= min_score)).mapInPandas(parse, CHAIN_BLOCKS)


class ChainSource(DataSource):
    """Alignment chains of files that every executor can open, as block rows; ``read_chains`` reads any store. Options: path, minScore (25000 by default; chains below it are skipped while reading)."""

    @classmethod
    def name(cls) -> str:
        return "chains"

    def schema(self) -> str:
        return CHAIN_BLOCKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChainReader(self.options)


class ChainReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.least = options["path"].split(","), int(options.get("minScore", 25_000))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        opener = gzip.open if partition.value.endswith(".gz") else open
        head, block = None, 0
        with opener(partition.value, "rt") as lines:
            for line in lines:
                f = line.split()
                if line.startswith("chain"):
                    head = None
                    if int(f[1]) >= self.least:
                        head = (int(f[12]), int(f[1]), f[2], int(f[3]), f[7], int(f[8]), -1 if f[9] == "-" else 1)
                        t, q, block = int(f[5]), int(f[10]), 0
                elif f and head and not line.startswith("#"):
                    n = int(f[0])
                    yield (*head, block, t, t + n, q)
                    block += 1
                    if len(f) == 3:
                        t, q = t + n + int(f[1]), q + n + int(f[2])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChainSource)


CHUNK = 1 << 16


def sequence_chunks(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, seq) as (chrom, chunk, seq) rows for random access by join."""
    at = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / chunk).cast("int"))
    return sequences.where(F.length("seq") > 0).select("chrom", "seq", F.explode(at).alias("chunk")).select("chrom", "chunk", F.substring("seq", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("seq"))


def fetch(ranges: DataFrame, chunks: DataFrame, id_col: str, chunk: int = CHUNK) -> DataFrame:
    """(id, seq) of the ranges (id, chrom, s, e), put together from the chunks they meet."""
    met = ranges.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("s") / chunk).cast("int"), F.floor((F.col("e") - 1) / chunk).cast("int")))).join(chunks, ["chrom", "chunk"])
    at = F.greatest(F.lit(0), F.col("s") - F.col("chunk") * chunk).cast("int")
    to = F.least(F.lit(chunk), F.col("e") - F.col("chunk") * chunk).cast("int")
    piece = met.select(id_col, "chunk", F.substring("seq", at + 1, to - at).alias("piece"))
    joined = piece.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("chunk", "piece"))).alias("p"))
    return joined.select(id_col, F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("seq"))


def validate_bed(df: DataFrame) -> DataFrame:
    """Counts of records, bad coordinates, reversed intervals and short rows of a raw BED12 text frame (column ``value``)."""
    f = F.split("value", "\t")
    real = (F.trim("value") != "") & ~F.col("value").startswith("#")
    a, b = f[1].try_cast("bigint"), f[2].try_cast("bigint")
    full = F.size(f) >= 12
    return df.where(real).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~full).alias("short"), F.count_if(full & (a.isNull() | b.isNull())).alias("bad"), F.count_if(full & (a >= b)).alias("reversed")
    )


def chrom_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many chromosomes of a are missing in b, and how many of them a version strip or a chr prefix would fix."""
    left, right = a.select("chrom").distinct(), b.select("chrom").distinct()
    missing = left.join(right, "chrom", "left_anti")
    keyed = right.select(F.regexp_replace(F.regexp_replace("chrom", r"\.\d+$", ""), "^chr", "").alias("k")).distinct()
    fix = missing.withColumn("k", F.regexp_replace(F.regexp_replace("chrom", r"\.\d+$", ""), "^chr", "")).join(keyed.withColumn("hit", F.lit(True)), "k", "left")
    return fix.agg(F.count(F.lit(1)).alias("missing"), F.count_if("hit").alias("fixable"), (F.count_if("hit") * 2 > F.count(F.lit(1))).alias("naming_problem"))
