"""Writers: BED9, BED12, detail tables, wide chains, nested JSON; output layout and stage manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.scalar import bed_score, biotype_colour


def bed12_lines(df: DataFrame) -> DataFrame:
    """(value) lines from (chrom, name, strand, blocks sorted by start)."""
    s, e = F.array_min(F.transform("blocks", lambda b: b["s"])), F.array_max(F.transform("blocks", lambda b: b["e"]))
    text = lambda c: c.cast("string")
    parts = [
        F.col("chrom"), text(s), text(e), F.col("name"), F.lit("1000"), F.when(F.col("strand") < 0, "-").otherwise("+"), text(s), text(s), F.lit("0"),
        text(F.size("blocks")), F.concat(F.array_join(F.transform("blocks", lambda b: text(b["e"] - b["s"])), ","), F.lit(",")),
        F.concat(F.array_join(F.transform("blocks", lambda b: text(b["s"] - s)), ","), F.lit(",")),
    ]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def bed9(df: DataFrame, colours: dict[str, str]) -> DataFrame:
    """BED9 columns from results (chrom, s, e, strand, transcript_id, chain_id, biotype, mmd, status); only ok ones with a region."""
    ok = df.where((F.col("status") == "ok") & F.col("chrom").isNotNull())
    return ok.select(
        "chrom", F.col("s").alias("start"), F.col("e").alias("end"), F.concat_ws(".", "transcript_id", F.col("chain_id").cast("string")).alias("name"), bed_score("mmd").alias("score"),
        F.when(F.col("strand") < 0, "-").otherwise("+").alias("strand"), F.col("s").alias("thick_start"), F.col("e").alias("thick_end"), biotype_colour("biotype", colours).alias("rgb"),
    )


def fixed(value: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def wide_chains(df: DataFrame, chains: str, n: int) -> DataFrame:
    """Expands an array of chain structs into chain{k}_{field} columns, null where there are fewer."""
    fields = df.schema[chains].dataType.elementType.fieldNames()
    return df.select(*(c for c in df.columns if c != chains), *(F.get(chains, F.lit(k - 1))[f].alias(f"chain{k}_{f}") for k in range(1, n + 1) for f in fields))


def nested(df: DataFrame, key: str, columns: list[str], name: str) -> DataFrame:
    """One JSON document per key with its rows in order."""
    return df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias(name))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A tsv or csv table with a header, or json lines."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind in ("tsv", "csv"):
        df.write.mode("overwrite").csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    else:
        raise ValueError(f"no report of kind {kind}")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file (a model) in any store that Spark writes to."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_model(spark: SparkSession, path: str, model: dict) -> None:
    write_file(spark, path, json.dumps(model, sort_keys=True).encode())


def write_arrays(spark: SparkSession, path: str, arrays: dict) -> None:
    """An .npz file of a model's arrays."""
    import io

    import numpy as np

    held = io.BytesIO()
    np.savez(held, **arrays)
    write_file(spark, path, held.getvalue())


def entries(spark: SparkSession, root: str) -> list[str]:
    """Names directly below a folder."""
    fs, p = _file_system(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove_temporaries(spark: SparkSession, root: str, prefix: str = "tmp_") -> list[str]:
    """Removes what a run leaves besides its outputs: entries whose name begins with ``prefix``. Returns their names."""
    gone = [name for name in entries(spark, root) if name.startswith(prefix)]
    for name in gone:
        fs, p = _file_system(spark, f"{root}/{name}")
        fs.delete(p, True)
    return gone


def layout(root: str) -> dict[str, str]:
    """Canonical places of a run's outputs."""
    names = ("union_transcripts", "orthologous_regions", "short_jobs", "short_results", "reference_islands", "query_clusters", "query_islands", "island_matches", "aligned_islands")
    return {n: f"{root}/{n}" for n in names} | {"manifest": f"{root}/_manifest"}


class Manifest:
    """Skips stages whose output for the same input fingerprint is complete."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def run(self, stage: str, fingerprint: dict, build) -> DataFrame:
        """Reads the stage's output if its mark matches, else builds, writes and marks it."""
        out, mark = f"{self.root}/{stage}", f"{self.root}/_marks/{stage}"
        fs, p = _file_system(self.spark, mark)
        wanted = json.dumps(fingerprint, sort_keys=True)
        if fs.exists(p) and self.spark.read.text(mark).first()[0] == wanted:
            return self.spark.read.parquet(out)
        build().write.mode("overwrite").parquet(out)
        self.spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(mark)
        return self.spark.read.parquet(out)

    def cleanup(self) -> None:
        fs, p = _file_system(self.spark, f"{self.root}/_marks")
        fs.delete(p, True)
