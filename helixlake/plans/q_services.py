"""Queries that write and read files in the shared folder, and the services around jobs: batches, statuses, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixlake.functions import scalar as sc
from helixlake.operators import alignment as al
from helixlake.operators import intervals as iv
from helixlake.operators import vectors as vx
from helixlake.operators import windows as wn
from helixlake.operators.graphs import _cut
from helixlake.plans.catalog import query
from helixlake.plans.domain import blocks, chain, exons, signal, table, tx, views
from helixlake.plans.q_scalar import _SEQ, _seq
from helixlake.plans.q_vectors import _cells, _cells_of, _sides
from helixlake.sources import readers, writers
from helixlake.streaming import monitor


def _scratch(spark, name: str) -> str:
    """A fresh place in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{root}/files/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _transcripts(spark, d):
    joined = exons(spark, d).groupBy("tid", "chrom", "strand").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("blocks"))
    return joined.withColumnRenamed("tid", "name")


@query("src1_bed12_scan", views("tx", "exon") + " SELECT tid AS name, chrom, strand::INTEGER AS strand, s, e FROM exon")
def bed12_scan(spark, d):
    path = _scratch(spark, "bed12")
    writers.write_lines(writers.bed12_lines(_transcripts(spark, d)), path)
    rows = readers.read_bed12(spark, path).select("name", "chrom", F.col("strand").cast("int").alias("strand"), F.explode("blocks").alias("b"))
    return rows.select("name", "chrom", "strand", F.col("b.start").alias("s"), F.col("b.end").alias("e"))


@query("snk1_bed12_lines", views("tx", "exon") + """, g AS (SELECT tid, chrom, strand, list({'s': s, 'e': e} ORDER BY s, e) AS b, min(s) AS s, max(e) AS e FROM exon GROUP BY 1, 2, 3)
  SELECT concat_ws(chr(9), chrom, s, e, tid, '1000', CASE WHEN strand<0 THEN '-' ELSE '+' END, s, s, '0', len(b),
    array_to_string(list_transform(b, lambda x: x.e-x.s), ',') || ',', array_to_string(list_transform(b, lambda x: x.s-s), ',') || ',') AS value FROM g""")
def bed12_out(spark, d):
    return writers.bed12_lines(_transcripts(spark, d))


@query("src2_bed_columns", views("chain") + " SELECT chrom, s AS start, e AS \"end\", concat('c', chain_id) AS name FROM chain")
def bed_columns(spark, d):
    path = _scratch(spark, "bed9")
    line = F.concat_ws("\t", "chrom", "s", "e", F.concat(F.lit("c"), F.col("chain_id").cast("string")), F.lit("0"), F.lit("+"), "s", "s", F.lit("0,0,0"))
    writers.write_lines(chain(spark, d).select(line.alias("value")), path)
    return readers.read_bed(spark, path, ["chrom", "start", "end", "name"])


@query("src3_bed_lengths", """SELECT concat('o', o_orderkey) AS name, CASE WHEN o_orderkey%3=2 THEN o_custkey+5 ELSE o_custkey END AS length FROM orders WHERE o_orderkey%7<>0""")
def bed_lengths(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    sizes = F.when(k % 3 == 1, F.lit("0,")).when(k % 3 == 2, F.concat(n.cast("string"), F.lit(",5,"))).otherwise(F.lit("x,"))
    line = F.concat_ws("\t", F.lit("chr1"), k, k + n, F.concat(F.lit("o"), k.cast("string")), F.lit("0"), F.lit("+"), k, k, F.lit("0"), F.lit("1"), sizes, F.lit("0,"))
    lines = table(spark, d, "orders").select(F.when(k % 14 == 0, "# note").when(k % 7 == 0, "").otherwise(line).alias("value"))
    return readers.bed_lengths(lines)


_TSV = "SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN NULL ELSE o_orderpriority END AS p FROM orders"


def _tsv(spark, d, sep):
    path = _scratch(spark, "table.tsv")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    o.write.csv(path, sep=sep, header=True)
    return path


@query("src4_required_columns", f"SELECT o_orderkey, p FROM ({_TSV}) WHERE p IS NOT NULL")
def required(spark, d):
    return readers.read_table(spark, _tsv(spark, d, "\t"), ["order id", "p"]).select(F.col("order id").cast("bigint").alias("o_orderkey"), "p")


@query("src5_metadata", _TSV)
def metadata(spark, d):
    return readers.read_metadata(spark, _tsv(spark, d, "\t"), {"o_orderkey": 0, "p": "p"}).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "p")


@query("src6_csv_named_tsv", _TSV)
def named_tsv(spark, d):
    return readers.read_table(spark, _tsv(spark, d, ","), [], sep=",").select(F.col("order id").cast("bigint").alias("o_orderkey"), "p")


@query("src7_chain_scan", views("chain", "block") + " SELECT b.chain_id, b.k AS block, b.s, b.e, b.q_s, b.q_strand FROM block b JOIN orders ON o_orderkey=b.chain_id WHERE floor(o_totalprice)>=25000")
def chain_scan(spark, d):
    path = _scratch(spark, "chains")
    c = chain(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("chain_id"), F.floor("o_totalprice").alias("score")), "chain_id")
    c = c.withColumns({"quarter": F.expr("(e - s) div 4"), "third": F.expr("(e - s) div 3")})
    head = F.concat_ws(" ", F.lit("chain"), "score", "chrom", F.lit("1000000000"), F.lit("+"), "s", F.expr("s + 2 * third + quarter"), F.lit("q"), F.lit("1000000000"),
                       F.when(F.col("strand") < 0, "-").otherwise("+"), F.expr("s + 500"), F.expr("s + 520 + 2 * third + quarter"), "chain_id")
    step = F.concat_ws(" ", "quarter", F.expr("third - quarter"), F.expr("third - quarter + 10"))
    writers.write_lines(c.select(F.concat_ws("\n", head, step, step, F.col("quarter").cast("string"), F.lit("")).alias("value")), path)
    return readers.read_chains(spark, path, 25_000).select("chain_id", "block", "s", "e", "q_s", "q_strand")


@query("src8_random_access", f"WITH s AS (SELECT doc_id, {_SEQ} AS q FROM documents) SELECT doc_id, substring(q, length(q)//3+1, length(q)//2) AS seq FROM s WHERE length(q)>1")
def random_access(spark, d):
    s = _seq(spark, d).select(F.col("doc_id").cast("string").alias("chrom"), "doc_id", "seq")
    ranges = s.where("length(seq) > 1").select("doc_id", "chrom", F.expr("length(seq) div 3").alias("s"), F.expr("length(seq) div 3 + length(seq) div 2").alias("e"))
    return readers.fetch(ranges, readers.sequence_chunks(s.select("chrom", "seq"), 128), "doc_id", 128)


@query("src10_nested_scan", "SELECT user_id, event_id, event_type FROM events")
def nested_scan(spark, d):
    path = _scratch(spark, "nested")
    doc = writers.nested(table(spark, d, "events"), "user_id", ["event_id", "event_type"], "doc")
    writers.write_lines(doc.select(F.concat(F.lit('{"'), F.col("user_id").cast("string"), F.lit('":'), "doc", F.lit("}")).alias("value")), path)
    rows = readers.read_nested(spark, path, "array<struct<event_id:bigint,event_type:string>>", lines=True).select("id", F.explode("value").alias("v"))
    return rows.select(F.col("id").cast("bigint").alias("user_id"), "v.event_id", "v.event_type")


@query("src12_filtered_scan", views("chain", "block") + " SELECT chrom AS t_name, s, e FROM block WHERE chrom IN ('chr1', 'chr2')")
def filtered_scan(spark, d):
    path = _scratch(spark, "psl")
    b = blocks(spark, d).groupBy("chain_id", "chrom").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("b"))
    listed = lambda f: F.concat(F.array_join(F.transform("b", lambda x: f(x).cast("string")), ","), F.lit(","))
    none = [F.lit("0")] * 8
    line = F.concat_ws("\t", F.lit("585"), *none, F.lit("+"), F.lit("q"), *none[:3], "chrom", F.lit("0"), F.array_min("b")["s"], F.array_max("b")["e"], F.size("b"), listed(lambda x: x["e"] - x["s"]), listed(lambda x: x["s"] * 0), listed(lambda x: x["s"]))
    writers.write_lines(b.select(line.alias("value")), path)
    rows = readers.read_psl(spark, path).where(F.col("t_name").isin("chr1", "chr2")).select("t_name", F.explode("blocks").alias("x"))
    return rows.select("t_name", F.col("x.start").alias("s"), F.col("x.end").alias("e"))


@query("src15_chrom_sizes", views("tx") + " SELECT chrom, max(e) AS size FROM tx GROUP BY 1")
def chrom_sizes(spark, d):
    path = _scratch(spark, "sizes")
    writers.write_lines(tx(spark, d).groupBy("chrom").agg(F.max("e").alias("size")).select(F.concat_ws("\t", "chrom", "size").alias("value")), path)
    return readers.read_chrom_sizes(spark, path)


@query("snk3_detail_table", "SELECT o_orderkey, printf('%.6f', o_totalprice/1000) AS mmd, coalesce(c_name,'') AS gene FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal>0) ON o_custkey=c_custkey")
def detail(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", writers.fixed(F.col("o_totalprice") / 1000, 6).alias("mmd"), F.coalesce("c_name", F.lit("")).alias("gene"))


@query("flt2_prefix_and_biotype", views("tx") + " SELECT (count(*) FILTER (starts_with(tid,'U_') AND p_size>20))::BIGINT AS kept, count(*)::BIGINT AS total FROM tx LEFT JOIN part ON concat('G',p_partkey)=gene")
def prefix_filter(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene"), "p_size")
    keep = F.col("tid").startswith("U_") & (F.col("p_size") > 20)
    return tx(spark, d).join(p, "gene", "left").agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("total"))


@query("flt6_chain_skip", views("tx", "chain", "pair") + " SELECT chain_id FROM pair GROUP BY chain_id HAVING max(ce-cs)>=100 AND sum(bp)*1.0/max(ce-cs)<=0.95")
def chain_skip(spark, d):
    p = iv.overlap_join(tx(spark, d), chain(spark, d), ["chrom"]).groupBy(F.col("chain_id_b").alias("chain_id"))
    p = p.agg(F.max(F.col("e_b") - F.col("s_b")).alias("q_len"), F.sum("bp").alias("bp"))
    return p.where((F.col("q_len") >= 100) & (F.col("bp") / F.col("q_len") <= 0.95)).select("chain_id")


@query("str7_rna_normalise", "SELECT p_partkey, translate(upper(p_name),'T','U') AS rna FROM part")
def rna(spark, d):
    return table(spark, d, "part").select("p_partkey", sc.to_rna(F.upper("p_name")).alias("rna"))


@query("mth4_elapsed", "WITH t AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS x FROM orders) SELECT o_orderkey, x//3600 AS hours, x%3600//60 AS minutes, x%60 AS seconds FROM t")
def elapsed(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", sc.elapsed(F.floor("o_totalprice")).alias("t"))
    return t.select("o_orderkey", "t.hours", "t.minutes", "t.seconds")


@query("int14_matched_region", views("sig") + " SELECT user_id, min(pos)*4 AS s, least(max(pos)*4+96, n) AS e FROM (SELECT *, count(*) OVER (PARTITION BY user_id)*4+60 AS n FROM sig) WHERE p>0.25 GROUP BY user_id, n")
def matched_region(spark, d):
    sig = signal(spark, d).select("user_id", "pos", "p")
    g = sig.groupBy("user_id").agg(F.min(F.when(F.col("p") > 0.25, F.col("pos"))).alias("i0"), F.max(F.when(F.col("p") > 0.25, F.col("pos"))).alias("i1"), (F.count(F.lit(1)) * 4 + 60).alias("n"))
    r = g.where("i0 is not null").select("user_id", sc.matched_region("i0", "i1", "n", 4, 96).alias("r"))
    return r.select("user_id", F.col("r.start").cast("bigint").alias("s"), F.col("r.end").cast("bigint").alias("e"))


@query("seq6_random_windows", """WITH s AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text)>=72)
  SELECT doc_id, k::INTEGER AS k, ('0x' || substring(md5(concat(doc_id,':',k,':42')),1,8))::BIGINT % (n-71) AS s FROM s, range(0,3) r(k)""")
def random_windows(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    return wn.random_windows(s, F.col("doc_id"), F.col("n"), 72, 3).select("doc_id", "k", "s")


@query("emb5_logistic_fit")
def logistic_fit(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") < 5).cast("int").alias("y"), "embedding")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{k}" for k in range(width)]
    model = vx.fit_logistic(e.select("y", *(F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names))), names, "y")
    return spark.createDataFrame([(k, round(float(c), 6)) for k, c in enumerate([*model.coefficients, model.intercept])], "term int, weight double")


@query("aln6_collinear_length", """WITH g AS (SELECT user_id, list([value] ORDER BY ts, event_id) AS v, list([-value] ORDER BY ts, event_id) AS w FROM events GROUP BY 1),
  f AS (SELECT user_id, v, w, lambda_free FROM (SELECT *, []::DOUBLE[] AS lambda_free FROM g))
  SELECT user_id, len(list_reduce(v, lambda a, x: list_filter(a, lambda y: y<=x[1]) || x || list_filter(a, lambda y: y>x[1])[2:], lambda_free))::INTEGER AS rising,
    len(list_reduce(w, lambda a, x: list_filter(a, lambda y: y<=x[1]) || x || list_filter(a, lambda y: y>x[1])[2:], lambda_free))::INTEGER AS falling FROM f""")
def collinear_length(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return g.select("user_id", al.longest_run_length("v").alias("rising"), al.longest_run_length(F.transform("v", lambda x: -x)).alias("falling"))


@query("aln7_drop_crossers")
def crossers(spark, d):
    return al.drop_crossers(_cells(spark, d).where("mmd < 5").groupBy("label", "j").agg(F.min_by("i", F.struct("mmd", "i")).alias("i")), "label", "j", "i")


@query("aln8_rows_with_fallback")
def rows_with_fallback(spark, d):
    e = table(spark, d, "embeddings")
    paths = _cut(al.align_vectors(*_sides(e), "label", (20.0, 40.0)))
    bare = e.join(paths.select("label"), "label", "left_anti")  # only these need a diagonal
    diagonals = al.best_diagonal(_cells_of(bare).withColumn("mmd", F.col("mmd") / 40), "label", 3)
    return al.with_fallback(paths, diagonals, "label").withColumn("mmd", F.round("mmd", 6))


@query("stm1_micro_batches", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def micro(spark, d):
    return monitor.micro_batches(table(spark, d, "documents").select("doc_id", "text"), lambda p: p[["doc_id"]].assign(n=p["text"].str.len()), "doc_id long, n long", 160)


@query("stm3_job_statuses", "SELECT CASE WHEN o_orderkey%9=0 THEN 'error: ValueError' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def statuses(spark, d):
    jobs = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "x").otherwise("1").alias("arg"))
    return monitor.status_counts(monitor.guarded(jobs, "arg", float))


@query("stm7_merge_by_key", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def merged(spark, d):
    target = _scratch(spark, "merged")
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    merge = monitor.merge_into(target, ["user_id", "event_type"], ["event_id"])
    for epoch, half in enumerate((e.where("value <= 20"), e.where("value > 20 or value is null"))):
        merge(half, epoch)
    return spark.read.parquet(f"{target}/gen=1").select("user_id", "event_type", "event_id", "value")


@query("udf4_remap", "SELECT o_orderkey, concat('U_', o_custkey) AS id FROM orders")
def remap(spark, d):
    from helixlake.operators.analytics import remap as apply

    return apply(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")), {"id": lambda c: F.concat(F.lit("U_"), c.cast("string"))})
