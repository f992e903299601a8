"""Vector and alignment queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.operators import alignment as al
from helixlake.operators import vectors as vx
from helixlake.plans.catalog import query
from helixlake.plans.domain import table

MEAN = [round(0.01 * ((i * 7) % 13 - 6), 4) for i in range(64)]
COMPONENTS = [[round(0.1 * ((i * (k + 3) + k) % 11 - 5), 4) for i in range(64)] for k in range(4)]
WEIGHTS = [round(0.2 * ((i * 5) % 9 - 4), 4) for i in range(64)]


def _list(x) -> str:
    return "[" + ",".join(repr(float(v)) for v in x) + "]::DOUBLE[]"


@query("emb2_projection", "SELECT vec_id, " + ", ".join(f"round(list_dot_product(list_transform(list_zip(embedding::DOUBLE[], {_list(MEAN)}), lambda p: p[1]-p[2]), {_list(c)}),6) AS pc{k}" for k, c in enumerate(COMPONENTS)) + " FROM embeddings")
def projection(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", vx.project("embedding", MEAN, COMPONENTS).alias("p"))
    return p.select("vec_id", *(F.round(F.get("p", F.lit(k)), 6).alias(f"pc{k}") for k in range(4)))


@query("emb4_logistic", f"SELECT vec_id, round(1.0/(1.0+exp(-(list_dot_product(embedding::DOUBLE[], {_list(WEIGHTS)})+0.1))),6) AS p FROM embeddings")
def logistic(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.logistic_score("embedding", WEIGHTS, 0.1), 6).alias("p"))


@query("emb6_squared_distances", "SELECT a.label, a.vec_id AS pos, b.vec_id AS pos_b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])**2,6) AS d2 FROM embeddings a JOIN embeddings b ON a.label=b.label AND a.vec_id<b.vec_id")
def squared(spark, d):
    a = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    return vx.pair_distances(a, a, ["label"]).where("pos < pos_b").select("label", "pos", "pos_b", F.round("d2", 6).alias("d2"))


@query("emb7_gamma", "WITH p AS (SELECT a.label, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id<>b.vec_id) SELECT label, round(1.0/(2.0*quantile_cont(dist,0.5)**2+1e-10),6) AS gamma FROM p GROUP BY 1")
def gamma(spark, d):
    return vx.gamma(table(spark, d, "embeddings"), "label", "vec_id", "embedding").withColumn("gamma", F.round("gamma", 6))


@query("emb8_mmd", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IN (0,1)), k AS (SELECT a.label AS x, b.label AS y, a.vec_id=b.vec_id AS same, exp(-0.5*list_distance(a.e,b.e)**2) AS k FROM v a, v b)
  SELECT round(avg(k) FILTER (x=0 AND y=0 AND NOT same)+avg(k) FILTER (x=1 AND y=1 AND NOT same)-2.0*avg(k) FILTER (x=0 AND y=1),8) AS mmd2 FROM k""")
def mmd(spark, d):
    return vx.mmd2(table(spark, d, "embeddings"), "label", 0, 1, "vec_id", "embedding", 0.5).select(F.round("mmd2", 8).alias("mmd2"))


def _windows(spark, d, odd):
    """Windows of one of the two sequences of a label: the even vectors, or the odd ones."""
    e = table(spark, d, "embeddings").where(F.col("vec_id") % 2 == odd)
    e = e.select("label", F.floor(F.col("vec_id") / 40).cast("bigint").alias("i"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.groupBy("label", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "v"))), lambda x: x["v"]).alias("rows"))


@query("emb9_mmd_matrix", """WITH w AS (SELECT label, vec_id//40 AS i, vec_id%2 AS odd, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  n AS (SELECT label, i, odd, count(*) AS n FROM w GROUP BY ALL),
  m AS (SELECT label, i, odd, list(c ORDER BY k) AS c FROM (SELECT label, i, odd, k, avg(e[k]) AS c FROM w, range(1,65) r(k) GROUP BY ALL) GROUP BY ALL),
  s AS (SELECT a.label, a.i, a.odd, avg(exp(-0.5*list_distance(a.e,b.e)**2)) AS k FROM w a JOIN w b ON a.label=b.label AND a.i=b.i AND a.odd=b.odd AND a.vec_id<>b.vec_id GROUP BY ALL),
  x AS (SELECT a.label, a.i, b.i AS j, avg(exp(-0.5*list_distance(a.e,b.e)**2)) AS k FROM w a JOIN w b ON a.label=b.label AND a.odd=0 AND b.odd=1 GROUP BY ALL)
  SELECT x.label, x.i, x.j, CASE WHEN list_distance(p.c,q.c)>3 OR sp.k IS NULL OR sq.k IS NULL THEN 1.0 ELSE round(sqrt(greatest(0, sp.k+sq.k-2*x.k)),6) END AS mmd FROM x
  JOIN m p ON p.label=x.label AND p.i=x.i AND p.odd=0 JOIN m q ON q.label=x.label AND q.i=x.j AND q.odd=1
  LEFT JOIN s sp ON sp.label=x.label AND sp.i=x.i AND sp.odd=0 LEFT JOIN s sq ON sq.label=x.label AND sq.i=x.j AND sq.odd=1""")
def mmd_matrix(spark, d):
    m = vx.mmd_matrix(_windows(spark, d, 0), _windows(spark, d, 1), "label", g=0.5)
    return m.withColumn("mmd", F.round("mmd", 6))


@query("emb10_displacement", """WITH p AS (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON abs(a.vec_id-b.vec_id)=1) SELECT vec_id, round(avg(x),6) AS shift FROM p GROUP BY 1""")
def displacement(spark, d):
    e = table(spark, d, "embeddings").select(F.lit(1).alias("g"), "vec_id", "embedding")
    return vx.displacement(e, ["g"], "vec_id", "embedding").select("vec_id", F.round("shift", 6).alias("shift"))


@query("emb1_embed", """WITH k AS (SELECT doc_id, md5(substring(text, i, 4)) AS h FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text)-2, 1))) AS i FROM documents)),
  c AS (SELECT doc_id, ('0x' || h[1:2])::INTEGER % 16 AS k, sum(CASE WHEN ('0x' || h[3:4])::INTEGER % 2=1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM k GROUP BY 1, 2),
  n AS (SELECT doc_id, sqrt(sum(x*x)) AS n FROM c GROUP BY 1)
  SELECT doc_id, r.k::INTEGER AS k, CASE WHEN n>0 THEN round(coalesce(x,0)/n,6) ELSE 0 END AS x FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d CROSS JOIN range(0,16) r(k) LEFT JOIN c USING (doc_id, k) LEFT JOIN n USING (doc_id)""")
def embed(spark, d):
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("s"))
    return vx.embed(s, "s").select("doc_id", F.posexplode("v").alias("k", "x")).withColumn("x", F.round("x", 6))


def _sides(e):
    """The even and the odd vectors of each label, by position."""
    from helixlake.operators.windows import ordinal

    a = ordinal(e.where("vec_id % 2 = 0"), ["label"], ["vec_id"], "i").select("label", "i", F.col("embedding").alias("x"))
    b = ordinal(e.where("vec_id % 2 = 1"), ["label"], ["vec_id"], "j").select("label", "j", F.col("embedding").alias("y"))
    return a, b


def _cells_of(e):
    return vx.cross_distances(*_sides(e), "label").select("label", "i", "j", (F.col("d2") / 20).alias("mmd"))


def _cells(spark, d):
    """Distances between the even and the odd vectors of each label, by position."""
    return _cells_of(table(spark, d, "embeddings"))


_CELLS = """WITH a AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS i, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id%2=0), b AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS j, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id%2=1),
  c AS (SELECT label, i, j, list_distance(x,y)**2/20 AS mmd FROM a JOIN b USING (label))"""


@query("aln1_best_window", _CELLS + " SELECT label, arg_min(i*1000+j, (round(mmd,9), i*1000+j))::BIGINT AS start, round(min(mmd),6) AS distance FROM c GROUP BY 1")
def best_window(spark, d):
    c = _cells(spark, d).withColumn("at", F.col("i") * 1000 + F.col("j")).withColumn("mmd", F.round("mmd", 9))
    return al.best_window(c, "label", "at", "mmd").select("label", "start", F.round("distance", 6).alias("distance"))


@query("aln2_local_alignment")
def local_alignment(spark, d):
    return al.align(_cells(spark, d), "label").select("label", "chain", F.round("score", 6).alias("score"), F.round("mmd", 6).alias("mmd"), "i_from", "i_to", "j_from", "j_to", "nt")


@query("aln3_many_chains")
def many_chains(spark, d):
    return al.align(_cells(spark, d), "label", chains=3).select("label", "chain", F.round("score", 6).alias("score"), "nt")


@query("aln4_best_diagonal", _CELLS + """, r AS (SELECT label, j-i AS diag, i, i-row_number() OVER (PARTITION BY label, j-i ORDER BY i) AS run, mmd FROM c), p AS (SELECT *, sum(mmd) OVER (PARTITION BY label, diag, run ORDER BY i) AS t FROM r),
  m AS (SELECT a.label, a.diag, a.i AS i0, b.i AS i1, round((b.t-a.t+a.mmd)/(b.i-a.i+1),9) AS mean FROM p a JOIN p b ON a.label=b.label AND a.diag=b.diag AND a.run=b.run AND b.i-a.i>=2)
  SELECT label, diag::BIGINT AS diag, i0::BIGINT AS i0, i1::BIGINT AS i1, mean FROM m QUALIFY row_number() OVER (PARTITION BY label ORDER BY mean, diag, i0, i1)=1""")
def best_diagonal(spark, d):
    return al.best_diagonal(_cells(spark, d), "label", 3)


@query("aln5_collinear_matches")
def collinear(spark, d):
    return al.collinear_vectors(*_sides(table(spark, d, "embeddings")), "label", 20.0)


@query("emb3_pca_fit")
def pca_fit(spark, d):
    _, comp, ratio = vx.fit_pca(table(spark, d, "embeddings"), "embedding", 16)
    return spark.createDataFrame([(k, round(float(r), 6)) for k, r in enumerate(ratio)], "component int, ratio double")
