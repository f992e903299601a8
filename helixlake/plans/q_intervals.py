"""Queries over intervals: joins, unions, clusters, lift-over and the orthology slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions.scalar import logistic
from helixlake.operators import analytics as an
from helixlake.operators import intervals as iv
from helixlake.operators import windows as wn
from helixlake.plans.catalog import query
from helixlake.plans.domain import blocks, chain, exons, signal, table, tx, views

SYNTENY, GL_EXO, FLANK_COV, INTERCEPT = 0.7724763306482143, -7.735897763403996, 14.177840240763341, 0.07766190115042029


def _merged_sql(op: str, gap: int = 0, base: str = "tx", key: str = "chrom") -> str:
    return f"""m AS (SELECT *, CASE WHEN s {op} max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {base}),
    g AS (SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM m)"""


@query("jon1_overlap_join", views("tx", "chain", "pair") + " SELECT tid, chain_id, bp FROM pair")
def overlap_join(spark, d):
    return iv.overlap_join(tx(spark, d), chain(spark, d), ["chrom"]).select("tid", F.col("chain_id_b").alias("chain_id"), "bp")


@query(
    "jon2_block_overlap",
    views("tx", "chain", "exon", "block") + """ SELECT x.tid, b.chain_id, sum(least(x.e,b.e)-greatest(x.s,b.s))::BIGINT AS bp
    FROM exon x JOIN block b ON x.chrom=b.chrom AND x.s<b.e AND b.s<x.e GROUP BY ALL""",
)
def block_overlap(spark, d):
    return iv.overlap_join(exons(spark, d), blocks(spark, d), ["chrom"]).groupBy("tid", F.col("chain_id_b").alias("chain_id")).agg(F.sum("bp").alias("bp"))


@query(
    "jon3_best_overlap",
    views("tx", "chain", "exon", "block") + """, o AS (SELECT x.tid, b.chain_id, sum(least(x.e,b.e)-greatest(x.s,b.s))::BIGINT AS bp FROM exon x JOIN block b ON x.chrom=b.chrom AND x.s<b.e AND b.s<x.e GROUP BY ALL)
    SELECT tid, chain_id, bp FROM o QUALIFY row_number() OVER (PARTITION BY tid ORDER BY bp DESC, chain_id)=1""",
)
def best_overlap(spark, d):
    return iv.best_overlap(exons(spark, d), blocks(spark, d), ["chrom"], "tid", "chain_id")


@query(
    "jon4_two_source_best",
    views("tx", "chain", "pair") + """, b AS (SELECT tid, max(CASE WHEN cstrand=1 THEN bp END) AS x, max(CASE WHEN cstrand=-1 THEN bp END) AS y FROM pair GROUP BY tid)
    SELECT tid, CASE WHEN x IS NULL THEN 'second' WHEN y IS NULL OR x>=y THEN 'first' ELSE 'second' END AS source, greatest(coalesce(x,0),coalesce(y,0)) AS bp FROM b""",
)
def two_sources(spark, d):
    t, c = tx(spark, d), chain(spark, d)
    best = lambda s, n: iv.overlap_join(t, c.where(F.col("strand") == s), ["chrom"]).groupBy("tid").agg(F.max("bp").alias(n))
    both = best(1, "x").join(best(-1, "y"), "tid", "full")
    source = F.when(F.col("x").isNull(), "second").when(F.col("y").isNull() | (F.col("x") >= F.col("y")), "first").otherwise("second")
    return both.select("tid", source.alias("source"), F.greatest(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("bp"))


@query(
    "jon5_overlap_counts",
    views("tx", "chain", "pair") + " SELECT chain_id, count(DISTINCT tid)::BIGINT AS n_tx, count(DISTINCT gene)::BIGINT AS n_gene, max(bp) AS best FROM pair GROUP BY chain_id",
)
def overlap_counts(spark, d):
    p = iv.overlap_join(chain(spark, d), tx(spark, d), ["chrom"])
    return p.groupBy("chain_id").agg(F.countDistinct("tid_b").alias("n_tx"), F.countDistinct("gene_b").alias("n_gene"), F.max("bp").alias("best"))


@query(
    "jon6_strand_class",
    views("tx", "chain", "pair") + """, h AS (SELECT tid, bool_or(strand=cstrand) AS same, bool_or(strand<>cstrand) AS opp, count(*)::BIGINT AS n, list_sort(list(DISTINCT chain_id))[1:5] AS p FROM pair GROUP BY tid)
    SELECT t.tid, CASE WHEN opp AND same THEN 'antisense+sense' WHEN opp THEN 'antisense' WHEN same THEN 'sense_overlapping' ELSE 'intergenic' END AS kind,
    coalesce(n,0)::BIGINT AS n_hits, array_to_string(p, ',') AS partners FROM (SELECT DISTINCT tid FROM tx) t LEFT JOIN h USING (tid)""",
)
def strand_class(spark, d):
    return iv.strand_class(tx(spark, d), chain(spark, d), ["chrom"], "tid", "chain_id")


@query(
    "jon7_proximity",
    views("tx", "chain") + """, rest AS (SELECT * FROM tx t WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.chrom=t.chrom AND t.s<c.e AND c.s<t.e))
    SELECT tid FROM rest t WHERE EXISTS (SELECT 1 FROM chain c WHERE c.chrom=t.chrom AND t.s<c.e+100 AND c.s-100<t.e)""",
)
def proximity(spark, d):
    t, c = tx(spark, d), chain(spark, d)
    return iv.overlap_semi(iv.overlap_semi(t, c, ["chrom"], anti=True), c, ["chrom"], pad=100).select("tid")


@query(
    "jon8_pairs_with_fallback",
    views("tx", "chain", "pair") + """, hit AS (SELECT DISTINCT tid, s, e FROM pair)
    SELECT tid, chain_id FROM pair
    UNION ALL SELECT t.tid, c.chain_id FROM tx t ANTI JOIN hit USING (tid, s, e) JOIN chain c ON t.chrom=c.chrom AND t.s//5000=c.s//5000""",
)
def fallback(spark, d):
    locus = F.expr("s div 5000").alias("locus")
    t, c = tx(spark, d), chain(spark, d)
    hit = iv.overlap_join(t, c, ["chrom"]).select("tid", F.col("chain_id_b").alias("chain_id"))
    return hit.unionByName(iv.overlap_semi(t, c, ["chrom"], anti=True).select("tid", "chrom", locus).join(c.select("chrom", locus, "chain_id"), ["chrom", "locus"]).select("tid", "chain_id"))


@query(
    "jon16_fuzzy_match",
    views("chain") + """, a AS (SELECT chain_id, chrom, s+chain_id%3 AS s, e+chain_id%3 AS e FROM chain), b AS (SELECT chain_id AS bid, chrom, s, e FROM chain),
    x AS (SELECT a.chain_id, min(bid) AS bid FROM a JOIN b USING (chrom,s,e) GROUP BY 1),
    n AS (SELECT a.chain_id, b.bid, greatest(abs(a.s-b.s),abs(a.e-b.e)) AS dd FROM a JOIN b ON a.chrom=b.chrom AND abs(a.s-b.s)<=50 AND abs(a.e-b.e)<=50 WHERE a.chain_id NOT IN (SELECT chain_id FROM x))
    SELECT chain_id, bid, 'exact' AS kind FROM x UNION ALL (SELECT chain_id, bid, 'near' FROM n QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY dd, bid)=1)""",
)
def fuzzy(spark, d):
    c = chain(spark, d).select("chain_id", "chrom", "s", "e")
    a = c.withColumns({"s": F.col("s") + F.col("chain_id") % 3, "e": F.col("e") + F.col("chain_id") % 3})
    return iv.fuzzy_match(a, c.withColumnRenamed("chain_id", "bid"), ["chrom"], "chain_id", "bid")


@query(
    "jon18_evidence",
    views("tx", "chain", "pair", "exon", "block") + """, sp AS (SELECT DISTINCT tid FROM pair), bl AS (SELECT DISTINCT x.tid FROM exon x JOIN block b ON x.chrom=b.chrom AND x.s<b.e AND b.s<x.e)
    SELECT CASE WHEN sp.tid IS NULL THEN 'desert' ELSE 'covered' END AS place, CASE WHEN bl.tid IS NULL THEN 'no' ELSE 'yes' END AS support, count(*)::BIGINT AS n
    FROM (SELECT DISTINCT tid FROM tx) t LEFT JOIN sp USING (tid) LEFT JOIN bl USING (tid) GROUP BY ALL""",
)
def evidence(spark, d):
    t = tx(spark, d)
    span = iv.overlap_semi(t, chain(spark, d), ["chrom"]).select("tid", F.lit("covered").alias("place")).distinct()
    block = iv.overlap_semi(exons(spark, d), blocks(spark, d), ["chrom"]).select("tid", F.lit("yes").alias("support")).distinct()
    all3 = t.select("tid").distinct().join(span, "tid", "left").join(block, "tid", "left")
    return all3.groupBy(F.coalesce("place", F.lit("desert")).alias("place"), F.coalesce("support", F.lit("no")).alias("support")).agg(F.count(F.lit(1)).alias("n"))


for _name, _touching, _op in (("int1_merge_strict", False, "<"), ("int1_merge_touching", True, "<=")):

    @query(_name, views("tx") + ", " + _merged_sql(_op) + " SELECT chrom, min(s) AS s, max(e) AS e, count(*)::BIGINT AS n FROM g GROUP BY chrom, grp")
    def merged(spark, d, _touching=_touching):
        return iv.merge(tx(spark, d), ["chrom"], touching=_touching)


@query("int2_exon_union", views("tx", "exon") + ", " + _merged_sql("<=", base="exon") + ", u AS (SELECT chrom, grp, max(e)-min(s) AS bp FROM g GROUP BY ALL) SELECT chrom, count(*)::BIGINT AS n, sum(bp)::BIGINT AS bp FROM u GROUP BY chrom")
def exon_union(spark, d):
    m = iv.merge(exons(spark, d), ["chrom"], touching=True)
    return m.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") - F.col("s")).alias("bp"))


@query(
    "int3_union_transcript",
    views("tx", "exon") + ", " + _merged_sql("<=", base="exon", key="gene, chrom") + """, u AS (SELECT gene, chrom, min(s) AS s, max(e) AS e FROM g GROUP BY gene, chrom, grp)
    SELECT gene, chrom, string_agg(concat(s,'-',e), ';' ORDER BY s) AS blocks, count(*)::BIGINT AS n FROM u GROUP BY ALL""",
)
def union_transcript(spark, d):
    b = iv.blocks_of(exons(spark, d), ["gene", "chrom"])
    return b.select("gene", "chrom", F.array_join(F.transform("blocks", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ";").alias("blocks"), F.size("blocks").cast("bigint").alias("n"))


@query(
    "int4_proximity_clusters",
    views("tx") + ", " + _merged_sql("<=", gap=30, key="chrom, strand") + " SELECT tid, chrom, strand, grp, min(s) OVER w AS cluster_s, max(e) OVER w AS cluster_e FROM g WINDOW w AS (PARTITION BY chrom, strand, grp)",
)
def clusters(spark, d):
    return iv.cluster(tx(spark, d), ["chrom", "strand"], gap=30).select("tid", "chrom", "strand", "grp", "cluster_s", "cluster_e")


@query("int5_bridge", views("tx") + ", " + _merged_sql("<=", key="chrom, strand") + " SELECT DISTINCT gene, concat('query_merged_region_',chrom,'_',strand,'_',grp) AS region FROM g")
def bridge(spark, d):
    g = iv.with_groups(tx(spark, d), ["chrom", "strand"], touching=True)
    return g.select("gene", F.concat(F.lit("query_merged_region_"), F.concat_ws("_", "chrom", F.col("strand").cast("string"), F.col("grp").cast("string"))).alias("region")).distinct()


@query(
    "int6_overlap_components",
    views("tx").replace("WITH ", "WITH RECURSIVE ", 1) + """, l AS (SELECT a.tid AS x, b.tid AS y FROM tx a JOIN tx b ON a.gene=b.gene AND a.chrom=b.chrom AND a.tid<>b.tid AND a.s<b.e AND b.s<a.e
      WHERE least(a.e,b.e)-greatest(a.s,b.s)>=20 AND least(a.e,b.e)-greatest(a.s,b.s)>=least(a.e-a.s,b.e-b.s)*0.5),
    r AS (SELECT tid AS root, tid FROM tx UNION SELECT r.root, l.y FROM r JOIN l ON r.tid=l.x)
    SELECT tid, min(root) AS label FROM r GROUP BY tid""",
)
def components(spark, d):
    return iv.overlap_components(tx(spark, d, distinct=False), ["gene", "chrom"], "tid")  # a row that stands twice is one interval there


@query("int7_flank_clamp", views("chain") + ", z AS (SELECT chrom, max(e) AS size FROM chain GROUP BY 1) SELECT chain_id, greatest(0,s-144) AS s, least(e+256,size) AS e FROM chain JOIN z USING (chrom)")
def flank(spark, d):
    c = chain(spark, d)
    sizes = c.groupBy("chrom").agg(F.max("e").alias("size"))  # one row per chromosome
    return iv.flank(c.join(F.broadcast(sizes), "chrom"), 144, 256, F.col("size")).select("chain_id", "s", "e")


@query(
    "int8_lift_over",
    views("tx", "chain", "block") + """, h AS (SELECT t.tid, b.chain_id, t.s, t.e, CASE WHEN q_strand<0 THEN q_size-(b.q_s+least(t.e,b.e)-b.s) ELSE b.q_s+greatest(t.s,b.s)-b.s END AS q0,
      CASE WHEN q_strand<0 THEN q_size-(b.q_s+greatest(t.s,b.s)-b.s) ELSE b.q_s+least(t.e,b.e)-b.s END AS q1 FROM tx t JOIN block b ON t.chrom=b.chrom AND t.s<b.e AND b.s<t.e)
    SELECT tid, chain_id, min(q0) AS q_s, max(q1) AS q_e, CASE WHEN max(q1)-min(q0)>any_value(e-s)*25.0 THEN 'expanded' ELSE 'ok' END AS status FROM h GROUP BY tid, chain_id""",
)
def lift(spark, d):
    return iv.lift_over(tx(spark, d), blocks(spark, d), ["tid"])


@query(
    "int9_lift_reasons",
    views("tx", "chain", "block") + """, o AS (SELECT t.tid, max(CASE WHEN b.chain_id IS NULL THEN 0 ELSE 1 END) AS hit, count(DISTINCT b.chain_id) AS n FROM tx t LEFT JOIN block b ON t.chrom=b.chrom AND t.s<b.e AND b.s<t.e GROUP BY 1)
    SELECT CASE WHEN hit=0 THEN 'unmapped' WHEN n>1 THEN 'many' ELSE 'one' END AS reason, count(*)::BIGINT AS n FROM o GROUP BY 1""",
)
def lift_reasons(spark, d):
    t = tx(spark, d)
    n = iv.lift_over(t, blocks(spark, d), ["tid"]).groupBy("tid").agg(F.count(F.lit(1)).alias("k"))
    reason = F.when(F.col("k").isNull(), "unmapped").when(F.col("k") > 1, "many").otherwise("one")
    return t.select("tid").distinct().join(n, "tid", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("int10_chain_split", views("chain", "block") + " SELECT chain_id, k, ((s-min(s) OVER (PARTITION BY chain_id))//400)::BIGINT AS child FROM block")
def chain_split(spark, d):
    return iv.split_at_gaps(blocks(spark, d), "chain_id", 400).select("chain_id", "k", "child")


@query(
    "int11_annotated_regions",
    views("tx", "exon").replace("exon AS", "exon AS") + """ SELECT tid, 'CDS' AS region_type, s, e FROM exon UNION ALL SELECT tid, 'FLANK_LEFT', greatest(0,s-10000), s FROM tx UNION ALL SELECT tid, 'FLANK_RIGHT', e, least(e+10000,100000000) FROM tx""",
)
def annotated(spark, d):
    t, x = tx(spark, d), exons(spark, d)
    part = lambda df, kind, s, e: df.select("tid", F.lit(kind).alias("region_type"), s.alias("s"), e.alias("e"))
    return (
        part(x, "CDS", F.col("s"), F.col("e"))
        .unionByName(part(t, "FLANK_LEFT", F.greatest(F.lit(0), F.col("s") - 10000), F.col("s")))
        .unionByName(part(t, "FLANK_RIGHT", F.col("e"), F.least(F.col("e") + 10000, F.lit(100_000_000))))
    )


@query(
    "int12_spliced_to_genomic",
    views("tx", "exon") + """, o AS (SELECT *, coalesce(sum(e-s) OVER (PARTITION BY tid ORDER BY CASE WHEN strand>0 THEN s ELSE -s END, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS off FROM exon),
    r AS (SELECT DISTINCT tid, 5 AS a, (e-s)//2+3 AS b FROM tx)
    SELECT r.tid, a, b, CASE WHEN strand>0 THEN s+greatest(a-off,0) ELSE e-least(b-off,e-s) END AS g_s, CASE WHEN strand>0 THEN s+least(b-off,e-s) ELSE e-greatest(a-off,0) END AS g_e,
    (row_number() OVER (PARTITION BY r.tid, a, b ORDER BY off)-1)::INTEGER AS segment FROM r JOIN o ON r.tid=o.tid AND a<off+e-s AND off<b""",
)
def spliced(spark, d):
    ranges = tx(spark, d).select("tid", F.lit(5).alias("a"), (F.expr("(e - s) div 2") + 3).alias("b")).distinct()
    return iv.spliced_to_genomic(ranges, exons(spark, d), "tid")


@query("int13_run_to_genomic", views("tx") + " SELECT tid, CASE WHEN strand=1 THEN s+7 ELSE e-19 END AS g_s, CASE WHEN strand=1 THEN s+19 ELSE e-7 END AS g_e FROM tx")
def run_to_genomic(spark, d):
    plus = F.col("strand") == 1
    return tx(spark, d).select("tid", F.when(plus, F.col("s") + 7).otherwise(F.col("e") - 19).alias("g_s"), F.when(plus, F.col("s") + 19).otherwise(F.col("e") - 7).alias("g_e"))


@query("int15_covered_locus", views("tx", "chain") + ", b AS (SELECT chrom, min(s) AS lo, max(e) AS hi FROM chain GROUP BY 1) SELECT tid FROM tx JOIN b USING (chrom) WHERE s>=lo AND e<=hi")
def covered(spark, d):
    b = chain(spark, d).groupBy("chrom").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    return tx(spark, d).join(F.broadcast(b), "chrom").where("s >= lo and e <= hi").select("tid")  # one row per chromosome


@query("int16_canonical", views("tx") + " SELECT gene, arg_max(tid, (e-s, tid)) AS tid FROM tx GROUP BY gene")
def canonical(spark, d):
    return tx(spark, d).groupBy("gene").agg(F.max_by("tid", F.struct(F.col("e") - F.col("s"), "tid")).alias("tid"))


@query(
    "agg26_gene_locus",
    views("tx") + " SELECT gene, min(chrom) AS chrom, min(s) AS s, max(e) AS e, arg_min(strand, (s,tid)) AS strand FROM tx GROUP BY gene",
)
def locus(spark, d):
    return tx(spark, d).groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("strand", F.struct("s", "tid")).alias("strand"))


_ISLANDS = """, sm AS (SELECT user_id, pos, round(sum(p) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5.0, 9) AS smooth FROM sig),
  o AS (SELECT *, pos-row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM sm WHERE smooth>=0.25),
  r AS (SELECT user_id, run, min(pos)*16 AS s, max(pos)*16+72 AS e, count(*)::BIGINT AS n FROM o GROUP BY ALL)"""


@query("win4_box_smooth", views("sig") + _ISLANDS + " SELECT user_id, pos, smooth FROM sm")
def smooth(spark, d):
    return _smooth(spark, d).select("user_id", "pos", "smooth")


def _smooth(spark, d):
    return wn.box_smooth(signal(spark, d), ["user_id"], ["pos"], "p").withColumn("smooth", F.round("smooth", 9))


@query("win5_signal_runs", views("sig") + _ISLANDS + " SELECT user_id, s, e, n FROM r")
def runs(spark, d):
    return wn.mask_runs(_smooth(spark, d), ["user_id"], "pos", F.col("smooth") >= 0.25, 16, 72).select("user_id", "s", "e", "n")


@query("win5_islands", views("sig") + _ISLANDS + ", " + _merged_sql("<", base="r", key="user_id") + " SELECT user_id, min(s) AS s, max(e) AS e, count(*)::BIGINT AS n FROM g GROUP BY user_id, grp")
def islands(spark, d):
    return iv.merge(wn.mask_runs(_smooth(spark, d), ["user_id"], "pos", F.col("smooth") >= 0.25, 16, 72), ["user_id"])


@query("win6_next_overlap", views("chain") + " SELECT chain_id, coalesce(lead(s) OVER (PARTITION BY chrom ORDER BY s, e) < e, false) AS clash FROM chain")
def next_overlap(spark, d):
    return wn.next_overlaps(chain(spark, d), ["chrom"]).select("chain_id", "clash")


_FEATURES = """, f AS (SELECT tid, min(gene) AS gene, chain_id, sum(bp)::BIGINT AS bp, max(e-s) AS n, any_value(ce-cs) AS cn FROM pair GROUP BY tid, chain_id),
  syn AS (SELECT chain_id, count(DISTINCT gene)::BIGINT AS synteny FROM f GROUP BY 1),
  ft AS (SELECT f.tid, f.chain_id, synteny, bp/cn AS gl_exo, n/cn AS exlen_to_qlen, bp/n AS exon_perc, least(1.0, bp/(n+100.0)) AS flank_cov FROM f JOIN syn USING (chain_id))"""


def features(spark, d):
    p = iv.overlap_join(tx(spark, d), chain(spark, d), ["chrom"])
    f = p.groupBy("tid", F.col("chain_id_b").alias("chain_id")).agg(F.min("gene").alias("gene"), F.sum("bp").alias("bp"), F.max(F.col("e") - F.col("s")).alias("n"), F.first(F.col("e_b") - F.col("s_b")).alias("cn"))
    syn = f.groupBy("chain_id").agg(F.countDistinct("gene").alias("synteny"))
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    return f.join(syn, "chain_id").select(
        "tid", "chain_id", "synteny", ratio(F.col("bp"), F.col("cn")).alias("gl_exo"), ratio(F.col("n"), F.col("cn")).alias("exlen_to_qlen"),
        ratio(F.col("bp"), F.col("n")).alias("exon_perc"), F.least(F.lit(1.0), F.col("bp") / (F.col("n") + F.lit(100.0))).alias("flank_cov"),
    )


_ROUNDED = "round(gl_exo,6) AS gl_exo, round(exlen_to_qlen,6) AS exlen_to_qlen, round(exon_perc,6) AS exon_perc, round(flank_cov,6) AS flank_cov"


@query("agg3_ratio_features", views("tx", "chain", "pair") + _FEATURES + f" SELECT tid, chain_id, synteny, {_ROUNDED} FROM ft")
def ratio_features(spark, d):
    return features(spark, d).select("tid", "chain_id", "synteny", *(F.round(c, 6).alias(c) for c in ("gl_exo", "exlen_to_qlen", "exon_perc", "flank_cov")))


@query("agg2_synteny", views("tx", "chain", "pair") + " SELECT chain_id, count(DISTINCT gene)::BIGINT AS synteny FROM pair GROUP BY 1")
def synteny(spark, d):
    return iv.overlap_join(tx(spark, d), chain(spark, d), ["chrom"]).groupBy(F.col("chain_id_b").alias("chain_id")).agg(F.countDistinct("gene").alias("synteny"))


def classified(spark, d):
    f = features(spark, d)
    score = logistic(F.lit(SYNTENY) * F.log1p("synteny") + F.lit(GL_EXO) * F.col("gl_exo") + F.lit(FLANK_COV) * F.col("flank_cov") + F.lit(INTERCEPT))
    pred = F.when((F.col("exon_perc") < 0.05) & (F.col("synteny") > 1), -1.0).when(
        (F.col("synteny") == 1) & (F.col("exlen_to_qlen") > 0.95) & (F.col("exon_perc") > 0.65) & (score < 0.5), -2.0
    ).otherwise(F.round(score, 6))
    label = F.when(F.col("pred") == -1.0, "SPAN").when(F.col("pred") == -2.0, "P_PGENES").when(F.col("pred") >= 0.5, "ORTH").otherwise("PARA")
    return f.withColumn("pred", pred).withColumn("label", label)


_CLASSIFIED = _FEATURES + f""", sc AS (SELECT *, 1.0/(1.0+exp(-({SYNTENY}*ln(1+synteny)+({GL_EXO})*gl_exo+{FLANK_COV}*flank_cov+{INTERCEPT}))) AS p FROM ft),
  pr AS (SELECT *, CASE WHEN exon_perc<0.05 AND synteny>1 THEN -1.0 WHEN synteny=1 AND exlen_to_qlen>0.95 AND exon_perc>0.65 AND p<0.5 THEN -2.0 ELSE round(p,6) END::DOUBLE AS pred FROM sc),
  cl AS (SELECT *, CASE WHEN pred=-1 THEN 'SPAN' WHEN pred=-2 THEN 'P_PGENES' WHEN pred>=0.5 THEN 'ORTH' ELSE 'PARA' END AS label FROM pr)"""


@query("flt9_rule_labels", views("tx", "chain", "pair") + _CLASSIFIED + " SELECT tid, chain_id, pred, label FROM cl")
def rule_labels(spark, d):
    return classified(spark, d).select("tid", "chain_id", "pred", "label")


@query("slice_orthology", views("tx", "chain", "pair") + _CLASSIFIED + " SELECT label, count(*)::BIGINT AS n, count(DISTINCT tid)::BIGINT AS n_tx, count(DISTINCT chain_id)::BIGINT AS n_chain FROM cl GROUP BY label")
def orthology(spark, d):
    """The flagship: overlap join, features, logistic score, ordered rules, summary."""
    return classified(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tid").alias("n_tx"), F.countDistinct("chain_id").alias("n_chain"))


@query("agg27_inside_outside", views("tx", "chain", "pair") + """, o AS (SELECT tid, max(bp) AS bp, e-s AS n FROM pair GROUP BY tid, s, e)
  SELECT CASE WHEN bp*100.0/n<50 THEN '1-50' WHEN bp*100.0/n<99 THEN '50-99' ELSE '99+' END AS category, count(*)::BIGINT AS n, sum(n-bp)::BIGINT AS outside_bp FROM o GROUP BY 1""")
def inside_outside(spark, d):
    o = iv.overlap_join(tx(spark, d), chain(spark, d), ["chrom"]).groupBy("tid", "s", "e").agg(F.max("bp").alias("bp")).withColumn("len", F.col("e") - F.col("s"))
    pct = F.col("bp") * 100.0 / F.col("len")
    return o.groupBy(F.when(pct < 50, "1-50").when(pct < 99, "50-99").otherwise("99+").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - F.col("bp")).alias("outside_bp"))


@query("agg28_chrom_rates", views("tx", "chain", "pair") + """, h AS (SELECT DISTINCT tid FROM pair)
  SELECT chrom, count(*)::BIGINT AS n, count(h.tid)::BIGINT AS hits, round(count(h.tid)*100.0/count(*),6) AS pct FROM tx LEFT JOIN h USING (tid) GROUP BY chrom""")
def chrom_rates(spark, d):
    t = tx(spark, d)
    hit = iv.overlap_semi(t, chain(spark, d), ["chrom"]).select("tid", F.lit(1).alias("hit")).distinct()  # two transcripts may share a tid
    g = t.join(hit, "tid", "left").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return g.withColumn("pct", F.round(F.col("hits") * 100.0 / F.col("n"), 6))


@query("agg14_loss_by_group", views("tx", "chain", "pair") + """, h AS (SELECT DISTINCT tid FROM pair)
  SELECT strand, count(*)::BIGINT AS total, count(h.tid)::BIGINT AS hit, (count(*)-count(h.tid))::BIGINT AS lost, round((count(*)-count(h.tid))*100.0/count(*),6) AS pct FROM tx LEFT JOIN h USING (tid) GROUP BY strand""")
def loss_by_group(spark, d):
    t = tx(spark, d)
    hit = iv.overlap_semi(t, chain(spark, d), ["chrom"]).select("tid", F.lit(1).alias("h")).distinct()  # two transcripts may share a tid
    g = t.join(hit, "tid", "left").groupBy("strand").agg(F.count(F.lit(1)).alias("total"), F.count("h").alias("hit"))
    return g.withColumn("lost", F.col("total") - F.col("hit")).withColumn("pct", F.round(F.col("lost") * 100.0 / F.col("total"), 6))


@query("agg1_union_collapse", views("tx") + """ SELECT gene, CASE WHEN bool_or(contains(tid,'_1_')) THEN 'protein_coding' WHEN bool_or(strand=1) THEN 'lncRNA' ELSE arg_min(chrom, tid) END AS biotype,
  count(*)::BIGINT AS n, string_agg(tid, ',' ORDER BY tid) AS isoforms FROM tx GROUP BY gene""")
def collapse(spark, d):
    b = F.when(F.max(F.contains("tid", F.lit("_1_"))), "protein_coding").when(F.max(F.col("strand") == 1), "lncRNA").otherwise(F.min_by("chrom", "tid"))
    return tx(spark, d).groupBy("gene").agg(b.alias("biotype"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("tid")), ",").alias("isoforms"))


@query("flt4_reason_cascade", views("chain") + """ SELECT CASE WHEN e-s<128 THEN 'short' WHEN e-s>1500 THEN 'long' WHEN chain_id%11=0 THEN 'no_reference' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM chain GROUP BY 1""")
def reasons(spark, d):
    n = F.col("e") - F.col("s")
    r = F.when(n < 128, "short").when(n > 1500, "long").when(F.col("chain_id") % 11 == 0, "no_reference").otherwise("kept")
    return chain(spark, d).groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("agg13_funnel", views("tx", "chain", "pair") + """, k AS (SELECT 0 AS ord, 'all' AS stage, count(*) AS n FROM tx UNION ALL SELECT 1, 'long', count(*) FROM tx WHERE e-s>=100 UNION ALL SELECT 2, 'plus', count(*) FROM tx WHERE e-s>=100 AND strand=1)
  SELECT ord, stage, n::BIGINT AS n, round(100.0*n/first_value(n) OVER (ORDER BY ord),6) AS pct_first, coalesce(lag(n) OVER (ORDER BY ord)-n,0)::BIGINT AS lost FROM k""")
def funnel(spark, d):
    counts = an.stages(tx(spark, d), {"all": F.lit(True), "long": F.col("e") - F.col("s") >= 100, "plus": F.col("strand") == 1})
    return an.funnel(counts).withColumn("pct_first", F.round("pct_first", 6))


@query("aln9_aligned_bed", views("tx", "exon") + ", " + _merged_sql("<=", base="exon", key="gene, chrom") + """, u AS (SELECT gene, chrom, min(s) AS s, max(e) AS e FROM g GROUP BY gene, chrom, grp),
  b AS (SELECT gene, chrom, min(s) AS s0, max(e) AS e0, count(*) AS n, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM u GROUP BY ALL)
  SELECT concat_ws(chr(9), chrom, s0, e0, gene || '_aligned', '1000', '+', s0, s0, '0', n, array_to_string(list_transform(range(1,n+1), lambda i: es[i]-ss[i]), ',') || ',', array_to_string(list_transform(ss, lambda x: x-s0), ',') || ',') AS value FROM b""")
def aligned_bed(spark, d):
    from helixlake.sources.writers import bed12_lines

    b = iv.blocks_of(exons(spark, d), ["gene", "chrom"])
    return bed12_lines(b.select("chrom", F.concat("gene", F.lit("_aligned")).alias("name"), F.lit(1).alias("strand"), "blocks"))


@query("src18_chrom_mismatch", """WITH a AS (SELECT DISTINCT concat('chr',o_custkey%7) AS chrom FROM orders), b AS (SELECT DISTINCT concat(l_suppkey%5,'.1') AS chrom FROM lineitem),
  m AS (SELECT * FROM a WHERE chrom NOT IN (SELECT chrom FROM b)), f AS (SELECT m.chrom, regexp_replace(regexp_replace(m.chrom,'\\.\\d+$',''),'^chr','') IN (SELECT regexp_replace(regexp_replace(chrom,'\\.\\d+$',''),'^chr','') FROM b) AS hit FROM m)
  SELECT count(*)::BIGINT AS missing, (count(*) FILTER (hit))::BIGINT AS fixable, (count(*) FILTER (hit))*2>count(*) AS naming_problem FROM f""".replace("\\\\", "\\"))
def mismatch(spark, d):
    from helixlake.sources.readers import chrom_mismatch

    b = table(spark, d, "lineitem").select(F.concat((F.col("l_suppkey") % 5).cast("string"), F.lit(".1")).alias("chrom"))
    return chrom_mismatch(chain(spark, d), b)
