"""Relational analytics queries: filters, sets, aggregates, ranks, upserts, samples, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.operators import analytics as an
from helixlake.operators import windows as wn
from helixlake.plans.catalog import query
from helixlake.plans.domain import table

R = "l_returnflag"


@query("agg4_named_aggs", """SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity),4) AS total, round(avg(l_quantity),6) AS mean, round(quantile_cont(l_quantity,0.5),6) AS med, round(stddev_samp(l_quantity),6) AS sd,
  min(l_quantity) AS lo, max(l_quantity) AS hi, bool_or(l_quantity>49) AS some, bool_and(l_quantity>0) AS every FROM lineitem GROUP BY 1""")
def named_aggs(spark, d):
    q = "l_quantity"
    return table(spark, d, "lineitem").groupBy(R).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(q), 4).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.round(F.percentile(q, F.lit(0.5)), 6).alias("med"),
        F.round(F.stddev_samp(q), 6).alias("sd"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.bool_or(F.col(q) > 49).alias("some"), F.bool_and(F.col(q) > 0).alias("every"),
    )


@query("agg5_conditional_counts", "SELECT event_type, (count(*) FILTER (value>50))::BIGINT AS high, (count(*) FILTER (value<=50))::BIGINT AS low FROM events GROUP BY 1")
def conditional(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"))


@query("agg6_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice,0.25),4) AS q25, round(quantile_cont(l_extendedprice,0.5),4) AS med, round(quantile_cont(l_extendedprice,0.75),4) AS q75, round(quantile_cont(l_extendedprice,0.99),4) AS q99,
  round(quantile_cont(l_extendedprice,0.75)-quantile_cont(l_extendedprice,0.25),4) AS iqr FROM lineitem GROUP BY 1""")
def quantiles(spark, d):
    q = an.quantiles(table(spark, d, "lineitem"), [R], "l_extendedprice", {"q25": 0.25, "med": 0.5, "q75": 0.75, "q99": 0.99})
    return q.withColumn("iqr", F.col("q75") - F.col("q25")).select(R, *(F.round(c, 4).alias(c) for c in ("q25", "med", "q75", "q99", "iqr")))


@query("agg7_distinct_of_distinct", "WITH a AS (SELECT o_custkey, count(DISTINCT o_orderstatus)::BIGINT AS k FROM orders GROUP BY 1) SELECT k, count(*)::BIGINT AS n FROM a GROUP BY 1")
def distinct2(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("agg8_value_counts", "SELECT event_type, count(*)::BIGINT AS n, round(count(*)/sum(count(*)) OVER (),9) AS share FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return an.value_counts(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 9))


@query("agg9_crosstab", """SELECT CASE WHEN grouping(l_returnflag)=1 THEN 'All' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus)=1 THEN 'All' ELSE l_linestatus END AS l_linestatus, count(*)::BIGINT AS n
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def crosstab(spark, d):
    return an.crosstab(table(spark, d, "lineitem"), R, "l_linestatus")


@query("agg10_pivot", """SELECT o_orderpriority, round(coalesce(min(o_totalprice) FILTER (o_orderstatus='F'),0),4) AS "F", round(coalesce(min(o_totalprice) FILTER (o_orderstatus='O'),0),4) AS "O", round(coalesce(min(o_totalprice) FILTER (o_orderstatus='P'),0),4) AS "P" FROM orders GROUP BY 1""")
def pivot(spark, d):
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.min("o_totalprice"), 4))
    return p.na.fill(0.0)


@query("agg11_element_counts", "WITH w AS (SELECT unnest(regexp_split_to_array(p_name, ' ')) AS w FROM part) SELECT w, count(*)::BIGINT AS n FROM w GROUP BY 1")
def elements(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("agg12_status_summary", """SELECT count(*)::BIGINT AS n, (count(*) FILTER (event_type LIKE 'c%'))::BIGINT AS c_like, (count(*) FILTER (value BETWEEN 10 AND 20))::BIGINT AS ranged, count(DISTINCT user_id)::BIGINT AS users FROM events""")
def status(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").startswith("c")).alias("c_like"), F.count_if(F.col("value").between(10, 20)).alias("ranged"), F.countDistinct("user_id").alias("users"))


@query("agg15_binned_rates", """WITH dim(bin,label,lo,hi) AS (VALUES (0,'tiny',0.0,10.0),(1,'small',10.0,25.0),(2,'large',25.0,60.0),(3,'none',60.0,90.0)),
  c AS (SELECT bin, count(*)::BIGINT AS n, (count(*) FILTER (l_returnflag='R'))::BIGINT AS hits FROM lineitem JOIN dim ON l_quantity>=lo AND l_quantity<hi GROUP BY bin)
  SELECT bin, label, coalesce(n,0)::BIGINT AS n, coalesce(hits,0)::BIGINT AS hits, round(CASE WHEN n>0 THEN hits/n END,9) AS rate FROM dim LEFT JOIN c USING (bin)""")
def binned(spark, d):
    b = an.binned_rates(table(spark, d, "lineitem"), "l_quantity", [0.0, 10.0, 25.0, 60.0, 90.0], ["tiny", "small", "large", "none"], F.col(R) == "R")
    return b.withColumn("rate", F.round("rate", 9))


@query("agg16_right_closed_strata", """SELECT CASE WHEN l_discount>0 AND l_discount<=0.03 THEN 0 WHEN l_discount>0.03 AND l_discount<=0.06 THEN 1 WHEN l_discount>0.06 AND l_discount<=0.2 THEN 2 END AS a,
  CASE WHEN l_tax>0 AND l_tax<=0.04 THEN 0 WHEN l_tax>0.04 AND l_tax<=0.2 THEN 1 END AS b, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def strata(spark, d):
    return table(spark, d, "lineitem").groupBy(an.right_closed(F.col("l_discount"), [0.0, 0.03, 0.06, 0.2]).alias("a"), an.right_closed(F.col("l_tax"), [0.0, 0.04, 0.2]).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("agg17_histogram", "SELECT least(19, CAST(floor((value-0.0)/((200.0-0.0)/20)) AS INTEGER)) AS bin, count(*)::BIGINT AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1")
def histogram(spark, d):
    return an.histogram(table(spark, d, "events"), "value", 0.0, 200.0, 20)


@query("agg18_reach_curve", "WITH a AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) SELECT k::BIGINT AS k, round(sum(CASE WHEN n>=k THEN 1 ELSE 0 END)/count(*),9) AS share FROM a, range(1,11) r(k) GROUP BY 1")
def reach(spark, d):
    return an.reach_curve(table(spark, d, "events"), "user_id", "event_type", 10).withColumn("share", F.round("share", 9))


@query("agg19_threshold_sweep", "SELECT concat('q',k) AS setting, (count(*) FILTER (l_quantity<k))::BIGINT AS n FROM lineitem, (VALUES (5),(10),(20),(40)) t(k) GROUP BY 1")
def sweep(spark, d):
    return an.sweep(table(spark, d, "lineitem"), {f"q{k}": F.col("l_quantity") < k for k in (5, 10, 20, 40)})


@query("agg20_detection_rate", """WITH t AS (SELECT c_nationkey, c_mktsegment, c_custkey FROM customer), o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus='F'),
  r AS (SELECT c_nationkey, c_mktsegment, count(o_custkey)/count(*) AS rate FROM t LEFT JOIN o ON c_custkey=o_custkey GROUP BY ALL) SELECT c_mktsegment, round(avg(rate),9) AS rate FROM r GROUP BY 1""")
def detection(spark, d):
    hit = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    r = table(spark, d, "customer").join(hit, "c_custkey", "left").groupBy("c_nationkey", "c_mktsegment").agg((F.count("hit") / F.count(F.lit(1))).alias("rate"))
    return r.groupBy("c_mktsegment").agg(F.round(F.avg("rate"), 9).alias("rate"))


@query("agg21_describe", """SELECT count(l_tax)::BIGINT AS n, round(avg(l_tax),9) AS mean, round(stddev_samp(l_tax),9) AS sd, min(l_tax) AS lo, round(quantile_cont(l_tax,0.25),9) AS q25, round(quantile_cont(l_tax,0.5),9) AS q50, round(quantile_cont(l_tax,0.75),9) AS q75, max(l_tax) AS hi FROM lineitem""")
def describe(spark, d):
    c = "l_tax"
    q = lambda p: F.round(F.percentile(c, F.lit(p)), 9)
    return table(spark, d, "lineitem").agg(F.count(c).alias("n"), F.round(F.avg(c), 9).alias("mean"), F.round(F.stddev_samp(c), 9).alias("sd"), F.min(c).alias("lo"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(c).alias("hi"))


@query("agg22_confusion", """WITH c AS (SELECT (count(*) FILTER (l_returnflag='R' AND l_quantity>25))::BIGINT AS tp, (count(*) FILTER (l_returnflag<>'R' AND l_quantity>25))::BIGINT AS fp, (count(*) FILTER (l_returnflag='R' AND NOT l_quantity>25))::BIGINT AS fn, (count(*) FILTER (l_returnflag<>'R' AND NOT l_quantity>25))::BIGINT AS tn FROM lineitem)
  SELECT *, round((tp+tn)/(tp+fp+fn+tn),9) AS accuracy, round(tp/(tp+fp),9) AS precision, round(tp/(tp+fn),9) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/(tp/(tp+fp)+tp/(tp+fn)),9) AS f1 FROM c""")
def confusion(spark, d):
    c = an.confusion(table(spark, d, "lineitem"), F.col(R) == "R", F.col("l_quantity") > 25)
    return c.select("tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in ("accuracy", "precision", "recall", "f1")))


@query("agg23_auc", """WITH c AS (SELECT l_quantity AS s, count(*) FILTER (l_returnflag='R') AS pos, count(*) FILTER (l_returnflag<>'R') AS neg FROM lineitem GROUP BY 1),
  b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM c) SELECT round(sum(pos*(below+neg/2.0))/(sum(pos)::DOUBLE*sum(neg)),9)::DOUBLE AS auc FROM b""")
def auc(spark, d):
    return an.auc(table(spark, d, "lineitem"), "l_quantity", F.col(R) == "R").select(F.round("auc", 9).alias("auc"))


@query("agg23_roc", """WITH c AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag='R') AS pos, count(*) FILTER (l_returnflag<>'R') AS neg FROM lineitem GROUP BY 1)
  SELECT score, round(sum(pos) OVER (ORDER BY score DESC)/sum(pos) OVER (),9) AS tpr, round(sum(neg) OVER (ORDER BY score DESC)/sum(neg) OVER (),9) AS fpr FROM c""")
def roc(spark, d):
    return an.roc(table(spark, d, "lineitem"), "l_quantity", F.col(R) == "R").select("score", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query("agg24_spearman", """WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2.0 AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)+(count(*) OVER (PARTITION BY l_returnflag, l_extendedprice)-1)/2.0 AS ry FROM lineitem) SELECT l_returnflag, count(*)::BIGINT AS n, round(corr(rx,ry),6) AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    return an.spearman(table(spark, d, "lineitem"), [R], "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


@query("agg24_decay_classes")
def decay(spark, d):
    e = table(spark, d, "events")
    s = an.with_p(an.spearman(e.select("user_id", "value", F.col("event_id").cast("double").alias("x")), ["user_id"], "x", "value"))
    ends = e.groupBy("user_id").agg(F.min_by("value", "ts").alias("near"), F.max_by("value", "ts").alias("far"))
    return s.join(ends, "user_id").select("user_id", "n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"), an.decay_class(F.col("n"), F.col("rho"), F.col("p"), F.col("near") / 100, F.col("far") / 100).alias("kind"))


@query("agg25_feature_table", """WITH m AS (SELECT l_returnflag='R' AS r, avg(l_quantity) AS q, avg(l_discount) AS x FROM lineitem GROUP BY 1), u AS (SELECT 'quantity' AS feature, r, q AS v FROM m UNION ALL SELECT 'discount', r, x FROM m)
  SELECT feature, round(max(v) FILTER (r),9) AS yes, round(max(v) FILTER (NOT r),9) AS no, round(max(v) FILTER (r)-max(v) FILTER (NOT r),9) AS diff FROM u GROUP BY 1""")
def feature_table(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col(R) == "R").alias("r")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("x"))
    u = m.selectExpr("r", "stack(2, 'quantity', q, 'discount', x) as (feature, v)")
    p = u.groupBy("feature").agg(F.max(F.when(F.col("r"), F.col("v"))).alias("yes"), F.max(F.when(~F.col("r"), F.col("v"))).alias("no"))
    return p.select("feature", F.round("yes", 9).alias("yes"), F.round("no", 9).alias("no"), F.round(F.col("yes") - F.col("no"), 9).alias("diff"))


@query("flt10_scenarios", """SELECT scenario, n::BIGINT AS n, k::BIGINT AS k FROM (SELECT 'returned' AS scenario, count(*) AS n, count(DISTINCT l_partkey) AS k FROM lineitem WHERE l_returnflag='R' UNION ALL SELECT 'bulk', count(*), count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity>40
  UNION ALL SELECT 'bulk_returned', count(*), count(DISTINCT l_partkey) FROM lineitem WHERE l_quantity>40 AND l_returnflag='R')""")
def scenarios(spark, d):
    c = {"returned": F.col(R) == "R", "bulk": F.col("l_quantity") > 40, "bulk_returned": (F.col("l_quantity") > 40) & (F.col(R) == "R")}
    aggs = [x for k, v in c.items() for x in (F.count_if(v).alias(f"n_{k}"), F.countDistinct(F.when(v, F.col("l_partkey"))).alias(f"k_{k}"))]
    one = table(spark, d, "lineitem").agg(*aggs)
    return one.selectExpr("stack(3, " + ", ".join(f"'{k}', n_{k}, k_{k}" for k in c) + ") as (scenario, n, k)")


@query("flt11_text_filters", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'gr|bl') AND p_size BETWEEN 5 AND 30 AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1')")
def text_filters(spark, d):
    return table(spark, d, "part").where(F.col("p_name").rlike("(?i)gr|bl") & F.col("p_size").between(5, 30) & F.col("p_brand").endswith("1")).select("p_partkey")


@query("flt7_quality_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount>0 AND l_tax<=0.05 AND l_quantity>=40")
def quality_filter(spark, d):
    return table(spark, d, "lineitem").where("l_discount > 0 and l_tax <= 0.05 and l_quantity >= 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("flt5_status_codes", "SELECT CASE WHEN l_quantity>45 THEN 'too_long' WHEN l_extendedprice IS NULL THEN 'empty' WHEN l_quantity<5 THEN 'short' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def status_codes(spark, d):
    from helixlake.streaming.monitor import status_counts

    s = F.when(F.col("l_quantity") > 45, "too_long").when(F.col("l_extendedprice").isNull(), "empty").when(F.col("l_quantity") < 5, "short").otherwise("ok")
    return status_counts(table(spark, d, "lineitem").select(s.alias("status")))


@query("flt3_strand_xor", "SELECT c.c_custkey, o.o_orderkey, CASE WHEN c_nationkey%2=o_orderkey%2 THEN 1 ELSE -1 END AS strand FROM customer c JOIN orders o ON c_custkey=o_custkey WHERE o_totalprice<=160000 AND c_acctbal>0")
def strand_xor(spark, d):
    j = table(spark, d, "orders").where("o_totalprice <= 160000").join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_custkey", "o_orderkey", F.when(F.col("c_nationkey") % 2 == F.col("o_orderkey") % 2, 1).otherwise(-1).alias("strand"))


@query("flt8_min_length_sides", """WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice>200000 GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS n FROM events WHERE value>50 GROUP BY 1) SELECT k, a.n::BIGINT AS na, b.n::BIGINT AS nb FROM a JOIN b USING (k)""")
def sides(spark, d):
    a = table(spark, d, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("na"))
    return a.join(table(spark, d, "events").where("value > 50").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("nb")), "k")


@query("jon9_left_enrich", "SELECT o_orderkey, coalesce(c_mktsegment,'unknown') AS segment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal>0) ON o_custkey=c_custkey")
def enrich(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("jon10_inner_suffixes", "SELECT a.n_nationkey, a.n_name AS n_name_x, b.n_name AS n_name_y FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey")
def suffixes(spark, d):
    n = table(spark, d, "nation")
    b = n.select("n_regionkey", F.col("n_nationkey").alias("k"), F.col("n_name").alias("n_name_y"))
    return n.join(b, "n_regionkey").where("n_nationkey < k").select("n_nationkey", F.col("n_name").alias("n_name_x"), "n_name_y")


@query("jon11_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jon12_anti_composite", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey, o_custkey) NOT IN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey%3=0)")
def anti(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(o.where("o_orderkey % 3 = 0"), ["o_orderkey", "o_custkey"], "left_anti")


@query("jon13_reverse_map", "WITH b AS (SELECT p_brand AS g, p_partkey AS k FROM part UNION ALL SELECT p_type, p_partkey FROM part) SELECT k, min(g) AS gene FROM b GROUP BY 1")
def reverse_map(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), F.explode(F.array("p_brand", "p_type")).alias("g")).groupBy("k").agg(F.min("g").alias("gene"))


@query("jon14_prefix_key", "WITH a AS (SELECT concat('G',p_partkey,'.',p_size) AS id FROM part) SELECT id, p_retailprice FROM a JOIN part ON p_partkey=CAST(regexp_extract(id,'^G(\\d+)\\.',1) AS BIGINT)".replace("\\\\", "\\"))
def prefix_key(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.concat(F.lit("G"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("id"))
    return a.withColumn("p_partkey", F.regexp_extract("id", r"^G(\d+)\.", 1).cast("bigint")).join(p, "p_partkey").select("id", "p_retailprice")


@query("jon15_lookup_counter", "SELECT count(*)::BIGINT AS n, (count(*) FILTER (c_custkey IS NULL))::BIGINT AS missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey<12) ON o_custkey=c_custkey")
def lookup_counter(spark, d):
    c = table(spark, d, "customer").where("c_nationkey < 12").select("c_custkey")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_custkey").isNull()).alias("missing"))


@query("jon17_pairs", "SELECT a.n_regionkey, a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey AND a.n_nationkey<b.n_nationkey")
def pairs(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_regionkey", F.col("n_nationkey").alias("i")).join(n.select("n_regionkey", F.col("n_nationkey").alias("j")), "n_regionkey").where("i < j")


@query("set1_set_ops", """SELECT 'both' AS kind, count(*)::BIGINT AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT 'only_left', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)
  UNION ALL SELECT 'either', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT user_id FROM events)""")
def set_ops(spark, d):
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k"))
    frames = {"both": a.intersect(b), "only_left": a.subtract(b), "either": a.union(b).distinct()}
    out = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, f in frames.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("set2_concat", "SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def concat(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")).unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")))


@query("set3_drop_duplicates", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)=1")
def drop_duplicates(spark, d):
    return wn.first_per(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("set4_division", """SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type)=(SELECT count(DISTINCT event_type) FROM events) AND user_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice>400000)""")
def division(spark, d):
    e = table(spark, d, "events")
    n = e.agg(F.countDistinct("event_type").alias("all"))
    every = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("k")).join(F.broadcast(n), F.col("k") == F.col("all"), "left_semi")  # n is one row
    return every.join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("user_id") == F.col("o_custkey"), "left_anti").select("user_id")


@query("win1_argmin_dedupe", "SELECT l_orderkey, l_returnflag, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber)=1")
def argmin(spark, d):
    return wn.first_per(table(spark, d, "lineitem"), ["l_orderkey", R], ["l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber"]).select("l_orderkey", R, "l_partkey", "l_extendedprice")


@query("win2_ordinal", "SELECT event_id, concat('R', row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1) AS label FROM events")
def ordinal(spark, d):
    return wn.ordinal(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", F.concat(F.lit("R"), F.col("ordinal").cast("string")).alias("label"))


@query("win3_top_k", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)<=5")
def top_k(spark, d):
    return wn.first_per(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], 5).select("o_custkey", "o_orderkey")


@query("win7_mixed_sort", "SELECT row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey)::BIGINT AS n, c_custkey FROM customer QUALIFY n<=100")
def mixed_sort(spark, d):
    first = table(spark, d, "customer").orderBy("c_nationkey", F.col("c_acctbal").desc(), "c_custkey").limit(100).select("c_nationkey", "c_acctbal", "c_custkey")
    return wn.ordinal(first, [], ["c_nationkey", F.col("c_acctbal").desc(), "c_custkey"], "n").select((F.col("n") + 1).alias("n"), "c_custkey")


@query("win8_nlargest_all", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC)<=10")
def nlargest(spark, d):
    p = table(spark, d, "part")
    edge = p.orderBy(F.col("p_size").desc()).limit(10).agg(F.min("p_size").alias("edge"))
    return p.join(F.broadcast(edge), F.col("p_size") >= F.col("edge"), "left_semi").select("p_partkey", "p_size")


@query("win9_stratified_sample", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat(o_orderkey,':42')))<=20")
def sample(spark, d):
    return wn.stratified_sample(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_orderkey"), 20).select("o_orderkey")


@query("win10_split", "SELECT c_custkey, CASE WHEN percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(c_custkey,':42')))<0.8 THEN 'train' ELSE 'test' END AS part FROM customer")
def split(spark, d):
    return wn.split(table(spark, d, "customer"), ["c_mktsegment"], F.col("c_custkey")).select("c_custkey", "part")


@query("win11_trim_with_forced", "(SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 100) UNION ALL SELECT p_partkey FROM part WHERE p_size=1")
def trim(spark, d):
    p = table(spark, d, "part")
    return p.orderBy("p_partkey").limit(100).select("p_partkey").unionByName(p.where("p_size = 1").select("p_partkey"))


@query("snk6_upsert", """SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(CASE WHEN value>20 THEN props END, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY ALL""")
def upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.when(F.col("value") > 20, F.col("props")).alias("props"))
    return wn.upsert(e, ["user_id", "event_type"], ["event_id"], merged=["props"]).select("user_id", "event_type", "value", "props", "event_id")


@query("stm4_throughput", "SELECT time_bucket(INTERVAL 3 SECONDS, ts) AS start, count(*)::BIGINT AS n, round(sum(value),6) AS total FROM events GROUP BY 1")
def throughput(spark, d):
    from helixlake.streaming.monitor import throughput as tp

    return tp(table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query("src14_first_wins", "SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1")
def first_wins(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))


@query("src13_fan_in", "SELECT species, count(*)::BIGINT AS n FROM (SELECT 'orders' AS species FROM orders UNION ALL SELECT 'events' FROM events) GROUP BY 1")
def fan_in(spark, d):
    a = table(spark, d, "orders").select(F.lit("orders").alias("species")).unionByName(table(spark, d, "events").select(F.lit("events").alias("species")))
    return a.groupBy("species").agg(F.count(F.lit(1)).alias("n"))


@query("src11_ordered_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus='P'")
def ordered_scan(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")


@query("snk4_wide_chains", "WITH a AS (SELECT user_id, list({'v': event_id, 't': event_type} ORDER BY event_id) AS c FROM events GROUP BY 1) SELECT user_id, c[1].v AS chain1_v, c[1].t AS chain1_t, c[2].v AS chain2_v, c[2].t AS chain2_t FROM a")
def wide(spark, d):
    from helixlake.sources.writers import wide_chains

    a = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("v"), F.col("event_type").alias("t")))).alias("c"))
    return wide_chains(a, "c", 2)


@query("snk5_nested_json", "SELECT user_id, concat('[', string_agg(concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}'), ',' ORDER BY event_id), ']') AS doc FROM events GROUP BY 1")
def nested_json(spark, d):
    from helixlake.sources.writers import nested

    return nested(table(spark, d, "events"), "user_id", ["event_id", "event_type"], "doc")
