"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixlake.functions import scalar as sc
from helixlake.plans.catalog import query
from helixlake.plans.domain import table, tx, views
from helixlake.sources import readers

_REGION = "concat('chr', o_custkey%7, ':', CASE WHEN o_orderkey%5=0 THEN 9 ELSE 1 END*o_orderkey, '-', 3*o_orderkey)"


def _regions(spark, d):
    o = table(spark, d, "orders")
    a = F.when(F.col("o_orderkey") % 5 == 0, 9).otherwise(1) * F.col("o_orderkey")
    return o.select("o_orderkey", sc.format_region(F.concat(F.lit("chr"), (F.col("o_custkey") % 7).cast("string")), a, F.col("o_orderkey") * 3).alias("region"))


@query("str1_parse_region", f"""WITH r AS (SELECT o_orderkey, {_REGION} AS region FROM orders), p AS (SELECT *, regexp_extract(region,'^(.*):(\\d+)-(\\d+)$',1) AS chrom, regexp_extract(region,'^(.*):(\\d+)-(\\d+)$',2)::BIGINT AS a, regexp_extract(region,'^(.*):(\\d+)-(\\d+)$',3)::BIGINT AS b FROM r)
  SELECT o_orderkey, chrom, a AS start, b AS "end", least(a,b) AS lo, greatest(a,b) AS hi FROM p""")
def parse(spark, d):
    r = _regions(spark, d).select("o_orderkey", sc.parse_region("region").alias("p"), sc.parse_region("region", swap=True).alias("q"))
    return r.select("o_orderkey", "p.chrom", "p.start", "p.end", F.col("q.start").alias("lo"), F.col("q.end").alias("hi"))


@query("str2_format_keys", f"SELECT o_orderkey, {_REGION} AS region, concat(o_custkey,'.',o_orderkey) AS k FROM orders")
def formats(spark, d):
    return _regions(spark, d).join(table(spark, d, "orders").select("o_orderkey", "o_custkey").distinct(), "o_orderkey").select("o_orderkey", "region", F.concat_ws(".", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("k"))


_ID = "concat('U_ENSG', p_partkey, '.', p_size, '.', p_partkey%4)"


def _ids(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("U_ENSG"), F.col("p_partkey").cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string")).alias("id"))


@query("str3_rsplit", f"WITH i AS (SELECT p_partkey, {_ID} AS id FROM part) SELECT p_partkey, regexp_extract(id,'^(.*)\\.([^.]*)$',1) AS head, regexp_extract(id,'^(.*)\\.([^.]*)$',2) AS tail FROM i")
def rsplit(spark, d):
    return _ids(spark, d).select("p_partkey", sc.rsplit_once("id").alias("r")).select("p_partkey", "r.head", "r.tail")


@query("str4_versions", f"WITH i AS (SELECT p_partkey, {_ID} AS id FROM part) SELECT p_partkey, split_part(id,'.',1) AS f, regexp_extract(id,'^(.*)\\.([^.]*)$',1) AS l, regexp_replace(id,'\\.\\d+$','') AS n, regexp_replace(id,'^U_','') AS u FROM i")
def versions(spark, d):
    return _ids(spark, d).select("p_partkey", *(sc.strip_version("id", m).alias(m[0]) for m in ("first", "last", "number", "union")))


@query("str5_lookup_substitution", f"WITH i AS (SELECT p_partkey, {_ID} AS id, p_name FROM part) SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN regexp_replace(id,'U_ENSG\\d+', p_name) ELSE id END AS label, p_partkey%3=0 AS resolved FROM i")
def substitution(spark, d):
    p = table(spark, d, "part")
    names = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("U_ENSG"), F.col("p_partkey").cast("string")).alias("token"), "p_name")
    i = _ids(spark, d).withColumn("token", F.regexp_extract("id", r"(U_ENSG\d+)", 1)).join(names, "token", "left")
    return i.select("p_partkey", F.coalesce(F.replace("id", F.col("token"), F.col("p_name")), "id").alias("label"), F.col("p_name").isNotNull().alias("resolved"))


_SEQ = "upper(regexp_replace(translate(text,'eioubdfhjklmnpqrsvwxyz .,','acgtacgtacgtacgtacgtacgtn'),'[^a-zA-Z]','n','g'))"


def _seq(spark, d):
    return table(spark, d, "documents").select("doc_id", F.upper(F.regexp_replace(F.translate("text", "eioubdfhjklmnpqrsvwxyz .,", "acgtacgtacgtacgtacgtacgtn"), "[^a-zA-Z]", "n")).alias("seq"))


@query("str6_reverse_complement", f"SELECT doc_id, reverse(translate(regexp_replace({_SEQ},'[^ACGTU]','N','g'),'ACGTUN','UGCAAN')) AS rc, translate({_SEQ},'T','U') AS rna FROM documents")
def revcomp(spark, d):
    return _seq(spark, d).select("doc_id", sc.reverse_complement("seq").alias("rc"), sc.to_rna("seq").alias("rna"))


@query("str8_text_formats", "SELECT o_custkey, printf('%.6f', sum(o_totalprice)/1000) AS total, string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS list FROM orders GROUP BY 1")
def text_formats(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.format_string("%.6f", F.sum("o_totalprice") / 1000).alias("total"), F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ";").alias("list"))


@query("str9_capture", f"WITH i AS (SELECT p_partkey, concat('g.', p_size, '_island_', p_partkey%9) AS id FROM part) SELECT p_partkey, regexp_extract(id,'\\.(\\d+)_island_',1) AS n FROM i")
def capture(spark, d):
    i = table(spark, d, "part").select("p_partkey", F.concat(F.lit("g."), F.col("p_size").cast("string"), F.lit("_island_"), (F.col("p_partkey") % 9).cast("string")).alias("id"))
    return i.select("p_partkey", F.regexp_extract("id", r"\.(\d+)_island_", 1).alias("n"))


@query("str10_name_match", "SELECT n_nationkey FROM nation WHERE lower(n_name) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey%2=0)")
def name_match(spark, d):
    n = table(spark, d, "nation")
    return n.join(n.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("k")), F.lower("n_name") == F.col("k"), "left_semi").select("n_nationkey")


@query("mth1_logistic", "SELECT o_orderkey, round(1.0/(1.0+exp(-(0.5*ln(1+o_totalprice)-6.0))),9) AS p FROM orders")
def logit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(sc.logistic(F.lit(0.5) * F.log1p("o_totalprice") - F.lit(6.0)), 9).alias("p"))


@query("mth2_bed_score", "SELECT event_id, CASE WHEN value IS NULL THEN 0 WHEN value/80-0.1<=0 THEN 1000 WHEN value/80-0.1>=1 THEN 0 ELSE round_even(1000.0*(1.0-(value/80-0.1)),0) END::INTEGER AS score FROM events")
def score(spark, d):
    return table(spark, d, "events").select("event_id", sc.bed_score(F.col("value") / 80 - 0.1).alias("score"))


@query("mth3_truncated", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, floor(l_quantity*1.1)::INTEGER AS hi, floor(l_quantity*0.8)::INTEGER AS lo FROM lineitem")
def truncated(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.floor(F.col("l_quantity") * F.lit(1.1)).cast("int").alias("hi"), F.floor(F.col("l_quantity") * F.lit(0.8)).cast("int").alias("lo"))


@query("flt1_rna_biotype", "WITH b AS (SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN ' Protein-Coding ' WHEN 1 THEN 'lncRNA' WHEN 2 THEN 'ribozyme' WHEN 3 THEN 'misc RNA' WHEN 4 THEN 'TEC' END AS b FROM part) SELECT p_partkey, coalesce(translate(lower(trim(b)),'- ','__')<>'protein_coding' AND (contains(translate(lower(trim(b)),'- ','__'),'rna') OR translate(lower(trim(b)),'- ','__')='ribozyme'),false) AS rna FROM b")
def biotype(spark, d):
    m = F.col("p_partkey") % 6
    b = F.when(m == 0, " Protein-Coding ").when(m == 1, "lncRNA").when(m == 2, "ribozyme").when(m == 3, "misc RNA").when(m == 4, "TEC")
    return table(spark, d, "part").select("p_partkey", sc.is_rna_biotype(b).alias("rna"))


@query("flt12_chromosomes", "WITH c AS (SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'chrM' WHEN 1 THEN 'chr1_alt' WHEN 2 THEN 'scaffold' ELSE concat('chr',p_size) END AS c FROM part) SELECT p_partkey, c FROM c WHERE starts_with(c,'chr') AND NOT contains(c,'_') AND c<>'chrM'")
def chromosomes(spark, d):
    m = F.col("p_partkey") % 5
    c = F.when(m == 0, "chrM").when(m == 1, "chr1_alt").when(m == 2, "scaffold").otherwise(F.concat(F.lit("chr"), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", c.alias("c")).where(F.col("c").startswith("chr") & ~F.contains("c", F.lit("_")) & (F.col("c") != "chrM"))


@query("flt13_finite", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x)))=0")
def finite(spark, d):
    return table(spark, d, "embeddings").where(sc.finite("embedding")).select("vec_id")


_BED = "SELECT l_orderkey*100000000+l_partkey*1000+l_suppkey*10+l_linenumber AS k, l_partkey AS s, l_partkey+CAST(l_quantity AS BIGINT) AS e, concat(CAST(floor(l_quantity) AS BIGINT)%4*5, ',', l_linenumber*2, ',') AS sizes, '0,20,' AS starts FROM lineitem"


def _bed(spark, d):
    k = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    sizes = F.concat((F.floor("l_quantity") % 4 * 5).cast("string"), F.lit(","), (F.col("l_linenumber") * 2).cast("string"), F.lit(","))
    return table(spark, d, "lineitem").select(k.alias("k"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.round("l_quantity").cast("bigint")).alias("e"), sizes.alias("sizes"), F.lit("0,20,").alias("starts"))


@query("arr1_blocks", f"WITH b AS ({_BED}), p AS (SELECT *, list_filter(list_transform(string_split(sizes,','), lambda x: try_cast(trim(x) AS BIGINT)), lambda x: x IS NOT NULL) AS n FROM b) SELECT k, CASE WHEN coalesce(list_sum(n),0)=0 THEN e-s ELSE list_sum(n)::BIGINT END AS len, s+20+n[2] AS last FROM p")
def arr_blocks(spark, d):
    b = _bed(spark, d)
    return b.select("k", sc.block_length("s", "e", "sizes").alias("len"), F.element_at(sc.absolute_blocks("s", "sizes", "starts"), -1)["end"].alias("last"))


@query("arr2_flip", views("tx") + " SELECT tid, 2000000-e AS s, 2000000-s AS e FROM tx WHERE strand<0")
def flip(spark, d):
    f = tx(spark, d).where("strand < 0").select("tid", sc.flip("s", "e", F.lit(2_000_000)).alias("f"))
    return f.select("tid", F.col("f.start").alias("s"), F.col("f.end").alias("e"))


@query("arr3_tags", "WITH t AS (SELECT p_partkey, string_split(p_name,' ') AS t, string_split(p_type,' ') AS u FROM part) SELECT p_partkey, list_contains(t, t[1]) AS has, list_has_any(t,u) AS meet, len(list_intersect(t,t))>0 AS some FROM t")
def tags(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("t"), F.split("p_type", " ").alias("u"))
    return t.select("p_partkey", F.array_contains("t", F.get("t", F.lit(0))).alias("has"), F.arrays_overlap("t", "u").alias("meet"), (F.size(F.array_intersect("t", "t")) > 0).alias("some"))


@query("jsn1_json", "SELECT event_id, json_extract_string(props,'$.k')::BIGINT AS k FROM events")
def jsn(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("map1_colours", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '255,0,0' WHEN 1 THEN '0,255,0' ELSE '0,0,0' END AS rgb FROM nation")
def colours(spark, d):
    return table(spark, d, "nation").select("n_nationkey", sc.biotype_colour(F.col("n_regionkey").cast("string"), {"0": "255,0,0", "1": "0,255,0"}).alias("rgb"))


@query("nul1_defaults", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey%4=0 THEN NULL ELSE o_orderpriority END,'unknown') AS p FROM orders")
def defaults(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p")).na.fill("unknown", ["p"])


@query("cst1_try_cast", "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN 'x1' ELSE o_custkey::VARCHAR END AS v FROM orders) SELECT o_orderkey, try_cast(v AS BIGINT) AS v FROM t")
def try_cast(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "x1").otherwise(F.col("o_custkey").cast("string")).try_cast("bigint").alias("v"))


def _two_blocks():
    """The second sixth of a sequence, and the third that begins at its middle."""
    block = lambda a, b: F.struct(F.expr(a).cast("int").alias("start"), F.expr(b).cast("int").alias("end"))
    return F.array(block("length(seq) div 6", "length(seq) div 6 * 2"), block("length(seq) div 2", "length(seq) div 2 + length(seq) div 3"))


@query("seq1_spliced", f"WITH s AS (SELECT doc_id, translate(regexp_replace({_SEQ},'[^ACGTU]','N','g'),'T','U') AS q FROM documents), x AS (SELECT doc_id, substring(q,length(q)//6+1,length(q)//6) || substring(q,length(q)//2+1,length(q)//3) AS w FROM s) SELECT doc_id, CASE WHEN doc_id%2=0 THEN w ELSE reverse(translate(w,'ACGUN','UGCAN')) END AS seq FROM x")
def spliced(spark, d):
    s = _seq(spark, d).withColumn("seq", F.regexp_replace("seq", "[^ACGTU]", "N"))
    blocks = _two_blocks()
    return s.select("doc_id", sc.spliced("seq", blocks, F.col("doc_id") % 2 != 0).alias("seq"))


@query("seq2_exonic", f"WITH s AS (SELECT doc_id, translate(regexp_replace({_SEQ},'[^ACGTU]','N','g'),'T','U') AS q FROM documents) SELECT doc_id, CASE WHEN doc_id%2=0 THEN substring(q,length(q)//6+1,length(q)//6) || substring(q,length(q)//2+1,length(q)//3) ELSE reverse(translate(substring(q,length(q)//6+1,length(q)//6),'ACGUN','UGCAN')) || reverse(translate(substring(q,length(q)//2+1,length(q)//3),'ACGUN','UGCAN')) END AS seq FROM s")
def exonic(spark, d):
    s = _seq(spark, d).withColumn("seq", F.regexp_replace("seq", "[^ACGTU]", "N"))
    blocks = _two_blocks()
    return s.select("doc_id", sc.spliced("seq", blocks, F.col("doc_id") % 2 != 0, per_block=True).alias("seq"))


@query("seq3_windows", "SELECT doc_id, CASE WHEN length(text)>=72 THEN (length(text)-72)//16+1 ELSE 0 END::INTEGER AS n FROM documents")
def windows(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", F.when(n >= 72, F.expr("(length(text) - 72) div 16 + 1")).otherwise(0).cast("int").alias("n"))


@query("seq3_window_rows", f"WITH s AS (SELECT doc_id, {_SEQ} AS q FROM documents) SELECT doc_id, (i//4)::INTEGER AS pos, substring(q, i+1, 96) AS w FROM (SELECT doc_id, q, unnest(range(0, greatest(length(q)-95, 0), 4)) AS i FROM s)")
def window_rows(spark, d):
    return _seq(spark, d).select("doc_id", F.posexplode(sc.windows("seq", 96, 4)).alias("pos", "w"))


@query("seq4_end_candidates", views("tx") + ", z AS (SELECT chrom, max(e) AS size FROM tx GROUP BY 1) SELECT tid, p::INTEGER AS shift, e+p AS e FROM tx JOIN z USING (chrom), range(-5,6) r(p) WHERE e-s+p>=floor((e-s)*0.97) AND e-s+p<=floor((e-s)*1.02) AND e+p<=size")
def end_candidates(spark, d):
    from helixlake.operators.alignment import end_candidates as candidates

    t = tx(spark, d)
    sizes = t.groupBy("chrom").agg(F.max("e").alias("limit"))  # one row per chromosome
    t = t.join(F.broadcast(sizes), "chrom").withColumns({"len": F.col("e") - F.col("s"), "ref_len": F.col("e") - F.col("s")})
    return candidates(t, "len", "e", "limit", 5, 0.97, 1.02).select("tid", "shift", (F.col("e") + F.col("shift")).alias("e"))


@query("seq5_multi_size", f"WITH s AS (SELECT doc_id, {_SEQ} AS q FROM documents), w AS (SELECT doc_id, z, i*greatest(1,(length(q)-z)//5) AS p FROM s, (VALUES (50),(100)) v(z), range(0,5) r(i) WHERE length(q)>=z AND i*greatest(1,(length(q)-z)//5)+z<=length(q)) SELECT doc_id, z, p::INTEGER AS p FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY z, p)<=5")
def multi_size(spark, d):
    from helixlake.operators.windows import first_per

    s = _seq(spark, d).select("doc_id", F.length("seq").alias("n"), F.explode(F.array(F.lit(50), F.lit(100))).alias("z")).where("n >= z")
    s = s.withColumn("p", F.explode(F.expr("transform(sequence(0, 4), i -> i * greatest(1, (n - z) div 5))"))).where("p + z <= n")
    return first_per(s, ["doc_id"], ["z", "p"], 5).select("doc_id", "z", F.col("p").cast("int").alias("p"))


@query("src9_gtf", """WITH g AS (SELECT p_partkey, concat('gene_id "G', p_partkey, '"; transcript_id "T', p_partkey, '.1"; gene_type "', p_type, '"; tag "basic"; tag "', p_brand, '";') AS a FROM part)
  SELECT p_partkey, regexp_extract(a,'(?:^|;)\\s*gene_id "([^"]*)"',1) AS gene_id, regexp_extract(a,'(?:^|;)\\s*transcript_id "([^"]*)"',1) AS tid, array_to_string(regexp_extract_all(a,'tag "([^"]*)"',1),',') AS tags FROM g""")
def gtf(spark, d):
    p = table(spark, d, "part")
    a = p.select("p_partkey", F.format_string('gene_id "G%d"; transcript_id "T%d.1"; gene_type "%s"; tag "basic"; tag "%s";', "p_partkey", "p_partkey", "p_type", "p_brand").alias("a"))
    return a.select("p_partkey", readers.gtf_attribute("a", "gene_id").alias("gene_id"), readers.gtf_attribute("a", "transcript_id").alias("tid"), F.array_join(readers.gtf_tags("a"), ",").alias("tags"))


@query("src17_validation", """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey%10=0 THEN 3 WHEN o_orderkey%10=1 THEN 12 ELSE 12 END AS n, CASE WHEN o_orderkey%10=2 THEN NULL ELSE o_orderkey END AS a, CASE WHEN o_orderkey%10=3 THEN o_orderkey-5 ELSE o_orderkey+5 END AS b FROM orders)
  SELECT count(*)::BIGINT AS records, (count(*) FILTER (n<12))::BIGINT AS short, (count(*) FILTER (n>=12 AND a IS NULL))::BIGINT AS bad, (count(*) FILTER (n>=12 AND a>=b))::BIGINT AS reversed FROM r""")
def validation(spark, d):
    m, k = F.col("o_orderkey") % 10, F.col("o_orderkey")
    a = F.when(m == 2, "x").otherwise(k.cast("string"))
    b = F.when(m == 3, k - 5).otherwise(k + 5).cast("string")
    line = F.when(m == 0, F.concat_ws("\t", F.lit("chr1"), a, b)).otherwise(F.concat_ws("\t", F.lit("chr1"), a, b, *(F.lit("0") for _ in range(9))))
    return readers.validate_bed(table(spark, d, "orders").select(line.alias("value")))


@query("snk2_bed9", "SELECT concat(o_custkey,'.',o_orderkey) AS name, CASE WHEN o_totalprice/500000<=0 THEN 1000 WHEN o_totalprice/500000>=1 THEN 0 ELSE round_even(1000.0*(1.0-o_totalprice/500000),0) END::INTEGER AS score, CASE WHEN o_orderkey%2=0 THEN '+' ELSE '-' END AS strand FROM orders WHERE o_orderstatus='F'")
def bed9(spark, d):
    from helixlake.sources.writers import bed9 as write

    o = table(spark, d, "orders").select(
        F.lit("chr1").alias("chrom"), F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 9).alias("e"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"), F.col("o_custkey").cast("string").alias("transcript_id"),
        F.col("o_orderkey").alias("chain_id"), F.lit("lncRNA").alias("biotype"), (F.col("o_totalprice") / 500000).alias("mmd"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("bad").alias("status"),
    )
    return write(o, {"lncRNA": "1,2,3"}).select("name", "score", "strand")
