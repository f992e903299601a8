"""Queries over a run's services and files: array files, reports, cleanup, resume, progress, batch tuning, pluggable functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helixlake.functions import scalar as sc
from helixlake.operators import vectors as vx
from helixlake.plans.catalog import query
from helixlake.plans.domain import table
from helixlake.plans.q_services import _scratch
from helixlake.plans.q_vectors import WEIGHTS, _list
from helixlake.sources import readers, writers
from helixlake.streaming import monitor


@query("src16_array_scan", """WITH n AS (SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_nationkey)-1 AS i FROM nation)
  SELECT 'nation' AS name, i::BIGINT AS i, 0::BIGINT AS j, n_nationkey::DOUBLE AS value FROM n UNION ALL SELECT 'nation', i::BIGINT, 1, n_regionkey::DOUBLE FROM n
  UNION ALL SELECT 'region', (row_number() OVER (ORDER BY r_regionkey)-1)::BIGINT, 0, r_regionkey::DOUBLE FROM region""")
def array_scan(spark, d):
    # both tables have a fixed number of rows at any size
    nation = [[r["n_nationkey"], r["n_regionkey"]] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    region = [r["r_regionkey"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    path = _scratch(spark, "arrays")
    writers.write_arrays(spark, f"{path}/model.npz", {"nation": np.array(nation, dtype=float), "region": np.array(region, dtype=float)})
    return readers.scan_arrays(spark, path).select("name", "i", "j", "value")


@query("snk7_reports", """WITH r AS (SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, round(avg(c_acctbal),6) AS mean FROM customer GROUP BY 1)
  SELECT f AS format, segment, n, mean FROM r, (VALUES ('tsv'),('csv'),('json')) v(f)""")
def reports(spark, d):
    r = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    path, out = _scratch(spark, "reports"), None
    for kind in ("tsv", "csv", "json"):
        writers.write_report(r, f"{path}/{kind}", kind)
        rows = readers.read_report(spark, f"{path}/{kind}", r.schema, kind).select(F.lit(kind).alias("format"), "segment", "n", "mean")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("snk7_model_json", "SELECT r_name AS term, r_regionkey/8.0 AS weight, 0.5::DOUBLE AS threshold FROM region")
def model_json(spark, d):
    terms = {r["r_name"]: r["r_regionkey"] / 8.0 for r in table(spark, d, "region").collect()}  # a model's terms, five rows
    path = _scratch(spark, "model")
    writers.write_model(spark, f"{path}/model.json", {"coefficients": terms, "threshold": 0.5})
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "coefficients map<string,double>, threshold double").alias("m"))
    return rows.select(F.explode("m.coefficients").alias("term", "weight"), "m.threshold")


@query("snk8_cleanup", "SELECT * FROM (VALUES ('manifest', true), ('short_jobs', true), ('short_results', true), ('tmp_batches', false), ('tmp_windows', false)) v(name, kept)")
def cleanup(spark, d):
    root = _scratch(spark, "run")
    names = ["short_jobs", "short_results", "tmp_windows", "tmp_batches"]
    for name in names:
        table(spark, d, "region").write.parquet(f"{root}/{name}")
    writers.Manifest(spark, root).run("manifest", {}, lambda: table(spark, d, "region"))
    writers.remove_temporaries(spark, root)
    left = set(writers.entries(spark, root))
    return spark.createDataFrame([(n, n in left) for n in [*names, "manifest"]], "name string, kept boolean")


@query("stm2_correlated", "SELECT event_id, user_id % 4 AS worker, round(value+1,6) AS first, round(2*value,6) AS second FROM events")
def correlated(spark, d):
    jobs = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("worker"), F.array("value", F.col("value") * 2).alias("payload"))

    def serve(batch: pd.DataFrame) -> pd.Series:
        return batch["payload"].map(lambda x: [x[0] + 1, x[1]])

    got = monitor.answered(jobs, ["worker", "event_id"], "payload", serve, "array<double>", most=160)
    return got.select("event_id", "worker", F.round(F.col("answer")[0], 6).alias("first"), F.round(F.col("answer")[1], 6).alias("second"))


@query("stm5_progress", """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events),
  r AS (SELECT user_id, done, total, ts AS last, done%5=0 OR total-done<2 AS due FROM o WHERE done=1
    UNION ALL SELECT o.user_id, o.done, o.total, CASE WHEN o.done%5=0 OR o.total-o.done<2 OR o.ts-r.last>=INTERVAL 3600 SECONDS THEN o.ts ELSE r.last END, o.done%5=0 OR o.total-o.done<2 OR o.ts-r.last>=INTERVAL 3600 SECONDS
    FROM r JOIN o ON o.user_id=r.user_id AND o.done=r.done+1)
  SELECT user_id, count(*)::BIGINT AS jobs, count(*) FILTER (due)::BIGINT AS reports FROM r GROUP BY 1""")
def progress(spark, d):
    marks = monitor.progress_marks(table(spark, d, "events"), "user_id", ["ts", "event_id"], every=5, seconds=3600.0, tail=2)
    return marks.select("user_id", F.size("marks").cast("long").alias("jobs"), F.size(F.filter("marks", lambda x: x)).cast("long").alias("reports"))


@query("stm6_resume", """SELECT 'by_status' AS stage, 1 AS builds, count(DISTINCT o_orderstatus)::BIGINT AS n FROM orders UNION ALL SELECT 'totals', 2, count(DISTINCT o_orderpriority)::BIGINT FROM orders""")
def resume(spark, d):
    """Three runs: both stages, a resumed run that skips both, and one in which only the second stage's input has changed."""
    o, root, built = table(spark, d, "orders"), _scratch(spark, "resume"), {"by_status": 0, "totals": 0}

    def stage(name: str, column: str, version: int):
        def build():
            built[name] += 1
            return o.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.lit(version).alias("version"))

        return writers.Manifest(spark, root).run(name, {"input": "orders", "version": version}, build)

    rows = {}
    for version in (1, 1, 2):
        rows = {"by_status": stage("by_status", "o_orderstatus", 1), "totals": stage("totals", "o_orderpriority", version)}
    return spark.createDataFrame([(k, built[k], rows[k].count()) for k in built], "stage string, builds int, n long")


@query("stm8_batch_sweep", """WITH m AS (SELECT count(*)*100 AS most FROM region), s AS (SELECT size, size<=most AS ok FROM range(64, 1025, 64) r(size), m), f AS (SELECT min(size) AS fail FROM s WHERE NOT ok)
  SELECT size::INTEGER AS size, ok, ((SELECT max(size) FROM s WHERE ok)*8//10//64*64)::INTEGER AS suggested FROM s, f WHERE size<=fail""")
def batch_sweep(spark, d):
    most = table(spark, d, "region").count() * 100

    def work(size: int) -> None:
        if size > most:  # what a device's memory limit does to a model
            raise MemoryError(size)

    tried, suggested = monitor.sweep_batches(work, range(64, 1025, 64))
    return spark.createDataFrame([(size, ok, suggested) for size, ok in tried], "size int, ok boolean, suggested int")


@query("udf1_row_rules", "SELECT p_partkey, CASE WHEN p_size<10 AND p_retailprice>1500 THEN 'dense' WHEN p_size>=40 THEN 'bulky' WHEN contains(p_type,'STEEL') THEN 'steel' ELSE 'other' END AS label FROM part")
def row_rules(spark, d):
    rules = {"dense": (F.col("p_size") < 10) & (F.col("p_retailprice") > 1500), "bulky": F.col("p_size") >= 40, "steel": F.contains("p_type", F.lit("STEEL"))}
    return table(spark, d, "part").select("p_partkey", sc.first_rule(rules, "other").alias("label"))


@query("udf2_group_apply", "SELECT user_id, count(*)::BIGINT AS n, round(regr_slope(value, event_id),9) AS slope FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*)>1")
def group_apply(spark, d):
    def slope(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["event_id"].to_numpy(float), g["value"].to_numpy(float)
        x = x - x.mean()
        return pd.DataFrame({"user_id": g["user_id"].iloc[:1], "n": [len(g)], "slope": [round(float(x @ (y - y.mean()) / (x @ x)), 9)]}) if len(g) > 1 else pd.DataFrame({"user_id": [], "n": [], "slope": []})

    e = table(spark, d, "events").where("value is not null").select("user_id", "event_id", "value")
    return e.groupBy("user_id").applyInPandas(slope, "user_id long, n long, slope double")


@query("udf3_lambda_aggs", "SELECT l_returnflag, round(quantile_cont(l_quantity,0.9)-quantile_cont(l_quantity,0.1),6) AS spread, (count(*) FILTER (l_discount>0.05))::BIGINT AS high, round(avg(CASE WHEN l_tax>0 THEN l_quantity END),6) AS taxed FROM lineitem GROUP BY 1")
def lambda_aggs(spark, d):
    q = lambda c, p: F.percentile(c, F.lit(p))
    aggs = {
        "spread": lambda: F.round(q("l_quantity", 0.9) - q("l_quantity", 0.1), 6),
        "high": lambda: F.count_if(F.col("l_discount") > 0.05),
        "taxed": lambda: F.round(F.avg(F.when(F.col("l_tax") > 0, F.col("l_quantity"))), 6),
    }
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*(f().alias(n) for n, f in aggs.items()))


@query("udf5_kernel", "SELECT a.label, round(sum(exp(-0.5*list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])**2)),6) AS total FROM embeddings a JOIN embeddings b ON a.label=b.label GROUP BY 1")
def kernel(spark, d):
    return vx.kernel_sums(table(spark, d, "embeddings"), "label", "embedding", 0.5).select("label", F.round("total", 6).alias("total"))


@query("udf6_inference_service", f"SELECT vec_id, round(1.0/(1.0+exp(-(list_dot_product(embedding::DOUBLE[], {_list(WEIGHTS)})+0.1))),6) AS p FROM embeddings")
def inference(spark, d):
    weights = list(WEIGHTS)

    def load():  # runs once in a task, as a model's weights are loaded once
        w = np.array(weights)
        return lambda batch: 1 / (1 + np.exp(-(np.stack(batch.to_numpy()).astype(float) @ w + 0.1)))

    got = vx.infer(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", load, "p", "double")
    return got.select("vec_id", F.round("p", 6).alias("p"))
