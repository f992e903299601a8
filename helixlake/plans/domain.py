"""Domain views over the driver's tables: transcripts, exons, chains and their blocks, signals, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx(spark: SparkSession, d: str, distinct: bool = True) -> DataFrame:
    li = table(spark, d, "lineitem")
    s = F.col("l_partkey") * 997 + F.col("l_orderkey") % 500
    rows = li.select(
        F.concat_ws("_", F.lit("U"), "l_orderkey", F.col("l_linenumber").cast("string"), "l_partkey", "l_suppkey").alias("tid"),
        F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 7).cast("string")).alias("chrom"),
        s.alias("s"), (s + F.floor("l_quantity") * 4 + 20).alias("e"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"),
    )
    return rows.distinct() if distinct else rows


def chain(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderkey") * 133
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("chain_id"), F.concat(F.lit("chr"), (F.col("o_custkey") % 7).cast("string")).alias("chrom"), s.alias("s"),
        (s + F.floor("o_totalprice") % 1500 + 50).alias("e"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"),
    )


def exons(spark: SparkSession, d: str) -> DataFrame:
    """Two exons per transcript: its first half and its last quarter."""
    t = tx(spark, d)
    first = t.select("tid", "gene", "chrom", "strand", "s", (F.col("s") + F.expr("(e - s) div 2")).alias("e"))
    last = t.select("tid", "gene", "chrom", "strand", (F.col("e") - F.expr("(e - s) div 4")).alias("s"), "e")
    return first.unionByName(last)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Three aligned blocks per chain with gaps between them, and their place in the query genome."""
    c = chain(spark, d).select("chain_id", "chrom", "strand", "s", "e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    s = F.expr("s + k * ((e - s) div 3)")
    return c.select("chain_id", "chrom", "k", s.alias("s"), (s + F.expr("(e - s) div 4")).alias("e"), (s + 500 + F.col("k") * 10).alias("q_s"), F.lit(1_000_000_000).cast("bigint").alias("q_size"), F.col("strand").alias("q_strand"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    """Events as a per-user signal: (user_id, pos, p)."""
    from helixlake.operators.windows import ordinal

    return ordinal(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "pos").select("user_id", "pos", "event_id", "ts", F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("p"))


def views(*names: str) -> str:
    """A WITH prefix for DuckDB over the named views."""
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n]})" for n in names)


_SQL = {
    "tx": """SELECT DISTINCT concat('U_',l_orderkey,'_',l_linenumber,'_',l_partkey,'_',l_suppkey) AS tid, concat('G',l_partkey) AS gene, concat('chr',l_suppkey%7) AS chrom,
      l_partkey*997+l_orderkey%500 AS s, l_partkey*997+l_orderkey%500+CAST(floor(l_quantity) AS BIGINT)*4+20 AS e, CASE WHEN l_orderkey%2=0 THEN 1 ELSE -1 END AS strand FROM lineitem""",
    "chain": """SELECT o_orderkey AS chain_id, concat('chr',o_custkey%7) AS chrom, o_orderkey*133 AS s, o_orderkey*133+CAST(floor(o_totalprice) AS BIGINT)%1500+50 AS e,
      CASE WHEN o_orderkey%2=0 THEN 1 ELSE -1 END AS strand FROM orders""",
    "exon": "SELECT tid, gene, chrom, strand, s, s+(e-s)//2 AS e FROM tx UNION ALL SELECT tid, gene, chrom, strand, e-(e-s)//4 AS s, e FROM tx",
    "block": """SELECT chain_id, chrom, k, s+k*((e-s)//3) AS s, s+k*((e-s)//3)+(e-s)//4 AS e, s+k*((e-s)//3)+500+k*10 AS q_s, 1000000000 AS q_size, strand AS q_strand
      FROM chain, (VALUES (0),(1),(2)) v(k)""",
    "sig": """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id, ts, least(value/100.0, 1.0) AS p FROM events""",
    "pair": """SELECT t.*, c.chain_id, c.s AS cs, c.e AS ce, c.strand AS cstrand, least(t.e,c.e)-greatest(t.s,c.s) AS bp FROM tx t JOIN chain c ON t.chrom=c.chrom AND t.s<c.e AND c.s<t.e""",
}
