"""Queries of profiling, joins, set operations, windows, sampling and contract checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R
from .registry import Tables, query

# --- projections and predicates


@query("o_p1", r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]+$', '') AS stem, regexp_extract(url, '\.([^./]+)$', 1) AS ext FROM pages")
def o_p1(t: Tables):
    return t.pages.select("page_id", R.stem(F.col("url")).alias("stem"), R.extension(F.col("url")).alias("ext"))


@query("o_p2", "SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice / 1e6 AS mp, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS aspect FROM lineitem")
def o_p2(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice") / 1e6).alias("mp"), F.floor(F.col("l_extendedprice") / F.col("l_quantity")).alias("aspect"))


@query("o_p3", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def o_p3(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("o_p4", "SELECT doc_id, regexp_full_match(text, '[0-9]{6}') AS v FROM texts")
def o_p4(t: Tables):
    return t.texts.select("doc_id", F.col("text").rlike("^[0-9]{6}$").alias("v"))


@query("o_p5", r"SELECT doc_id, nullif(trim(regexp_replace(text, '[\x00-\x08\x0A-\x1F]', '', 'g')), '') AS v FROM documents")
def o_p5(t: Tables):
    return t.documents.select("doc_id", R.clean(F.col("text")).alias("v"))


@query("o_p6", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 8 + 1 IN (5, 6, 7, 8) THEN l_tax ELSE l_discount END AS w, CASE WHEN l_partkey % 8 + 1 IN (5, 6, 7, 8) THEN l_discount ELSE l_tax END AS h FROM lineitem")
def o_p6(t: Tables):
    w, h = R.oriented(F.col("l_discount"), F.col("l_tax"), F.col("l_partkey") % 8 + 1)
    return t.lineitem.select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"))


@query("o_p7", "SELECT CASE WHEN p_size <= 10 THEN 'sq640' WHEN p_size >= 40 THEN 'hires' ELSE 'mid' END AS cluster, count(*) AS n FROM part GROUP BY ALL")
def o_p7(t: Tables):
    s = F.col("p_size")
    return t.part.groupBy(F.when(s <= 10, "sq640").when(s >= 40, "hires").otherwise("mid").alias("cluster")).agg(F.count("*").alias("n"))


@query("o_p8", "SELECT i AS missing FROM (SELECT unnest(range(1, (SELECT max(doc_id) + 1 FROM labels))) AS i) x WHERE i NOT IN (SELECT doc_id FROM labels)")
def o_p8(t: Tables):
    return R.missing_ids(t.labels, "doc_id")


@query("o_p9", r"SELECT count(*) FILTER (WHERE regexp_extract(url, '\.([^./]+)$', 1) <> CASE WHEN contains(lower(html), '<html') THEN 'html' ELSE 'txt' END) AS mismatch, count(*) AS n FROM pages")
def o_p9(t: Tables):
    kind = F.when(F.contains(F.lower("html"), F.lit("<html")), "html").otherwise("txt")
    return t.pages.agg(F.count_if(R.extension(F.col("url")) != kind).alias("mismatch"), F.count("*").alias("n"))


@query("o_p10", "SELECT CASE WHEN w = h THEN 'square' WHEN l_suppkey % 3 = 0 THEN 'same' WHEN l_suppkey % 3 = 1 THEN 'swap' ELSE 'other' END AS cls, count(*) AS n FROM (SELECT l_suppkey, l_quantity AS w, CAST(l_partkey % 50 AS DOUBLE) AS h FROM lineitem) x GROUP BY ALL")
def o_p10(t: Tables):
    x = t.lineitem.select("l_suppkey", F.col("l_quantity").alias("w"), (F.col("l_partkey") % 50).cast("double").alias("h"))
    s = F.col("l_suppkey") % 3
    return x.groupBy(F.when(F.col("w") == F.col("h"), "square").when(s == 0, "same").when(s == 1, "swap").otherwise("other").alias("cls")).agg(F.count("*").alias("n"))


@query("o_p11", "SELECT event_type, count(*) FILTER (WHERE value < 10) AS blurred, count(*) FILTER (WHERE value < 20) AS dark, count(*) FILTER (WHERE value > 80) AS bright FROM events GROUP BY event_type")
def o_p11(t: Tables):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count_if(v < 10).alias("blurred"), F.count_if(v < 20).alias("dark"), F.count_if(v > 80).alias("bright"))


@query("o_p12", "SELECT rung, count(*) FILTER (WHERE TRY_CAST(substr(pred, 1, 4) AS INTEGER) BETWEEN 2015 AND 2035) AS plausible FROM rungs GROUP BY rung")
def o_p12(t: Tables):
    return t.rungs.groupBy("rung").agg(F.count_if(F.substring("pred", 1, 4).try_cast("int").between(2015, 2035)).alias("plausible"))


@query("o_p13", "SELECT split, count(*) AS n FROM (SELECT DISTINCT doc_id, split FROM rungs WHERE pred <> 'NONE' AND rung_ord <= 2) x GROUP BY split")
def o_p13(t: Tables):
    return t.rungs.filter("rung_ord <= 2").groupBy("doc_id", "split").agg(F.max(F.when(F.col("pred") != "NONE", 1)).alias("x")).filter("x is not null").groupBy("split").agg(F.count("*").alias("n"))


@query("o_p14", "SELECT rung, CASE WHEN pred = 'NONE' THEN 'none' WHEN contains(pred, 'NONE') THEN 'partial' ELSE 'full' END AS kind, count(*) AS n FROM rungs GROUP BY ALL")
def o_p14(t: Tables):
    p = F.col("pred")
    return t.rungs.groupBy("rung", F.when(p == "NONE", "none").when(F.contains(p, F.lit("NONE")), "partial").otherwise("full").alias("kind")).agg(F.count("*").alias("n"))


@query("o_p15", "SELECT doc_id, rung, CAST(CASE WHEN pred = 'NONE' THEN 0 ELSE len(list_filter(string_split(pred, '-'), lambda x: x <> 'NONE')) END AS INTEGER) AS filled FROM rungs")
def o_p15(t: Tables):
    s = T.split3(F.col("pred"))
    return t.rungs.select("doc_id", "rung", sum((F.when(s[k] != "NONE", 1).otherwise(0) for k in "ymd"), F.lit(0)).alias("filled"))


@query("o_p16", "SELECT doc_id FROM truths WHERE CAST(substr(ty, 3, 2) AS INTEGER) BETWEEN 20 AND 35 AND CAST(td AS INTEGER) BETWEEN 20 AND 35")
def o_p16(t: Tables):
    return t.truths.filter(F.substring("ty", 3, 2).cast("int").between(20, 35) & F.col("td").cast("int").between(20, 35)).select("doc_id")


@query("o_p17", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > l_discount * 1.15 THEN 90 ELSE 0 END AS best FROM lineitem")
def o_p17(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > F.col("l_discount") * 1.15, 90).otherwise(0).alias("best"))


@query("o_p18", "SELECT doc_id, CASE WHEN contains(text, '까지') THEN 'limit' WHEN contains(upper(text), 'EXP') THEN 'expiry' WHEN regexp_matches(text, '[0-9]') THEN 'digits' ELSE 'none' END AS stage FROM texts")
def o_p18(t: Tables):
    c = F.col("text")
    return t.texts.select("doc_id", F.when(F.contains(c, F.lit("까지")), "limit").when(F.contains(F.upper(c), F.lit("EXP")), "expiry").when(c.rlike("[0-9]"), "digits").otherwise("none").alias("stage"))


@query("o_p19", "SELECT rung, CASE WHEN doc_id % 11 = 0 THEN 'unlabeled' WHEN pred = 'NONE' THEN 'miss' WHEN pred = truth THEN '3of3' WHEN contains(pred, 'NONE') THEN 'partial' ELSE 'wrong' END AS verdict, count(*) AS n FROM rungs GROUP BY ALL")
def o_p19(t: Tables):
    p = F.col("pred")
    v = F.when(F.col("doc_id") % 11 == 0, "unlabeled").when(p == "NONE", "miss").when(p == F.col("truth"), "3of3").when(F.contains(p, F.lit("NONE")), "partial").otherwise("wrong")
    return t.rungs.groupBy("rung", v.alias("verdict")).agg(F.count("*").alias("n"))


# --- joins


@query("o_j1", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'BUILDING'")
def o_j1(t: Tables):
    c = t.customer.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("o_j2", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def o_j2(t: Tables):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")


@query("o_j3", "SELECT l_orderkey, l_linenumber, p_brand, s_name, o_orderpriority FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey")
def o_j3(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "p_brand", "s_name", "o_orderpriority")


@query("o_j4", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def o_j4(t: Tables):
    return t.documents.select("doc_id", "source").join(t.labels.filter("toxic = 1"), "doc_id", "left_semi")


@query("o_j5", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def o_j5(t: Tables):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("o_j6", "SELECT k, CASE WHEN e IS NOT NULL THEN 'ok' WHEN s IS NOT NULL THEN 'fixed' ELSE 'unresolved' END AS state, coalesce(e, s) AS file FROM (SELECT a.k, max(b.f) FILTER (WHERE b.f = a.k) AS e, min(b.f) AS s FROM (SELECT CAST(o_orderkey AS VARCHAR) || CASE o_orderkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.gif' END AS k, CAST(o_orderkey AS VARCHAR) AS st FROM orders) a LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) || '.jpg' AS f, CAST(o_orderkey AS VARCHAR) AS st FROM orders WHERE o_orderkey % 5 <> 0) b ON a.st = b.st GROUP BY a.k) x")
def o_j6(t: Tables):
    k = F.col("o_orderkey").cast("string")
    left = t.orders.select(F.concat(k, F.expr("case o_orderkey % 3 when 0 then '.jpg' when 1 then '.png' else '.gif' end")).alias("k"))
    right = t.orders.filter("o_orderkey % 5 <> 0").select(F.concat(k, F.lit(".jpg")).alias("file"))
    return R.repair_join(left, "k", right, "file")


@query("o_j7", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def o_j7(t: Tables):
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")  # five regions


@query("o_j8", "SELECT a.doc_id, a.pos AS pa, b.pos AS pb FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.x0 < b.x1 + 20 AND b.x0 < a.x1 + 20")
def o_j8(t: Tables):
    return R.overlaps(t.boxes.withColumn("x1", F.col("x1") + 20), "doc_id", "pos", "x0", "x1")


@query("o_j9", "SELECT a.doc_id, a.pos AS pa, b.pos AS pb FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.pos < b.pos AND abs(a.cy - b.cy) <= 0.6 * greatest(a.h, b.h) AND b.h / a.h BETWEEN 0.5 AND 2.0")
def o_j9(t: Tables):
    a, b = t.boxes.alias("a"), t.boxes.alias("b")
    near = (F.abs(F.col("a.cy") - F.col("b.cy")) <= 0.6 * F.greatest("a.h", "b.h")) & (F.col("b.h") / F.col("a.h")).between(0.5, 2.0)
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.pos") < F.col("b.pos")) & near).select("a.doc_id", F.col("a.pos").alias("pa"), F.col("b.pos").alias("pb"))


@query("o_j10", "SELECT n_name, s.setting FROM nation CROSS JOIN (VALUES ('a'), ('b'), ('c')) s(setting)")
def o_j10(t: Tables):
    return t.nation.select("n_name", F.explode(F.array(*map(F.lit, "abc"))).alias("setting"))


@query("o_j11", "SELECT a.rung AS a, b.rung AS b, c.rung AS c FROM (SELECT DISTINCT rung_ord, rung FROM rungs) a JOIN (SELECT DISTINCT rung_ord, rung FROM rungs) b ON a.rung_ord < b.rung_ord JOIN (SELECT DISTINCT rung_ord, rung FROM rungs) c ON b.rung_ord < c.rung_ord")
def o_j11(t: Tables):
    return R.combinations(t.rungs.select("rung_ord", "rung").distinct(), "rung_ord", "rung", 3)


@query("o_j12", "SELECT doc_id, v FROM (SELECT doc_id, lang AS v, 1 AS src FROM documents UNION ALL SELECT doc_id, 'relabeled', 2 FROM labels) x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY src DESC) = 1")
def o_j12(t: Tables):
    return R.upsert(t.documents.select("doc_id", F.col("lang").alias("v")), t.labels.select("doc_id", F.lit("relabeled").alias("v")), "doc_id")


@query("o_j13", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 4 = 0")
def o_j13(t: Tables):
    return R.insert_absent(t.labels.select("doc_id", "quality"), t.documents.filter("doc_id % 4 = 0").select("doc_id", F.lit(9).alias("quality")), "doc_id")


@query("o_j14", "SELECT doc_id, pos, text || lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS pair FROM fragments QUALIFY pair IS NOT NULL")
def o_j14(t: Tables):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return t.fragments.select("doc_id", "pos", F.concat("text", F.lead("text").over(w)).alias("pair")).filter("pair is not null")


@query("o_j15", "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS extra, b.k IS NULL AS missing, coalesce(b.n, 0) > 1 AS duplicate FROM (SELECT doc_id AS k FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT item % 700 AS k, count(*) AS n FROM (SELECT doc_id + 100 AS item FROM documents) y GROUP BY ALL) b ON a.k = b.k")
def o_j15(t: Tables):
    tasks = t.documents.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"))
    return R.reconcile(tasks, t.documents.select(((F.col("doc_id") + 100) % 700).alias("k")), "k")


@query("o_j16", "SELECT p.rate, s.stores, round(p.rate * s.stores * 365 * CAST(0.05 AS DOUBLE), 6) AS saved FROM (VALUES (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) p(rate) CROSS JOIN (VALUES (1), (10), (100)) s(stores)")
def o_j16(t: Tables):
    g = t.spark.sql("select rate, stores from values (0.8D), (0.9D), (0.95D) as p(rate) cross join values (1), (10), (100) as s(stores)")
    return g.withColumn("saved", F.round(F.col("rate") * F.col("stores") * 365 * 0.05, 6))


@query("o_j17", "SELECT doc_id, pos, round(max(iou), 6) AS iou FROM (SELECT a.doc_id, a.pos, greatest(0, least(a.x1, b.x1 + 3) - greatest(a.x0, b.x0 + 3)) / (a.x1 - a.x0 + b.x1 - b.x0 - greatest(0, least(a.x1, b.x1 + 3) - greatest(a.x0, b.x0 + 3))) AS iou FROM boxes a JOIN boxes b USING (doc_id)) x GROUP BY doc_id, pos HAVING max(iou) >= 0.7")
def o_j17(t: Tables):
    other = t.boxes.select("doc_id", (F.col("x0") + 3).alias("u0"), (F.col("x1") + 3).alias("u1"))
    both = t.boxes.join(other, "doc_id")
    inter = F.greatest(F.lit(0.0), F.least("x1", "u1") - F.greatest("x0", "u0"))
    iou = inter / (F.col("x1") - F.col("x0") + F.col("u1") - F.col("u0") - inter)
    return both.groupBy("doc_id", "pos").agg(F.round(F.max(iou), 6).alias("iou")).filter("iou >= 0.7")


# --- aggregates


@query("o_a1", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC")
def o_a1(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("o_a2", "SELECT o_orderkey // 250 * 250 AS bucket, round(median(o_totalprice), 6) AS mid, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 6) AS share, max(o_orderpriority) AS top FROM orders GROUP BY ALL")
def o_a2(t: Tables):
    bucket = (F.floor(F.col("o_orderkey") / 250) * 250).alias("bucket")
    return t.orders.groupBy(bucket).agg(F.round(F.percentile("o_totalprice", 0.5), 6).alias("mid"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)), 6).alias("share"), F.max("o_orderpriority").alias("top"))


@query("o_a3", "SELECT l_returnflag, round(min(l_extendedprice), 6) AS lo, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(max(l_extendedprice), 6) AS hi FROM lineitem GROUP BY ALL")
def o_a3(t: Tables):
    q = lambda p: F.round(F.percentile("l_extendedprice", p), 6)
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.min("l_extendedprice"), 6).alias("lo"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.max("l_extendedprice"), 6).alias("hi"))


@query("o_a4", "SELECT event_type, list_sort(list(value))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90 FROM events GROUP BY event_type")
def o_a4(t: Tables):
    return R.floor_quantile(t.events, "event_type", "value", 0.9).withColumnRenamed("q", "p90")


@query("o_a5", "SELECT CASE WHEN l_quantity <= 10 THEN '(0,10]' WHEN l_quantity <= 25 THEN '(10,25]' WHEN l_quantity <= 50 THEN '(25,50]' END AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def o_a5(t: Tables):
    return t.lineitem.groupBy(R.right_closed_bin(F.col("l_quantity"), (0, 10, 25, 50)).alias("bin")).agg(F.count("*").alias("n"))


@query("o_a6", "SELECT CASE WHEN l_quantity <= 10 THEN '(0,10]' WHEN l_quantity <= 25 THEN '(10,25]' WHEN l_quantity <= 50 THEN '(25,50]' END AS bin, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 6) AS rate FROM lineitem GROUP BY ALL")
def o_a6(t: Tables):
    return t.lineitem.groupBy(R.right_closed_bin(F.col("l_quantity"), (0, 10, 25, 50)).alias("bin")).agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("rate"))


@query("o_a7", "SELECT doc_id, n_chars FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def o_a7(t: Tables):
    return R.duplicates(t.documents.select("doc_id", "n_chars", F.md5("text").alias("h")), "h").select("doc_id", "n_chars")


@query("o_a8", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS O, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) AS total FROM lineitem GROUP BY ALL")
def o_a8(t: Tables):
    w = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().fillna(0)
    return w.withColumn("total", F.col("O") + F.col("F"))


@query("o_a9", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM texts) x GROUP BY w")
def o_a9(t: Tables):
    return t.texts.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("o_a10", "SELECT least(n, 6) AS n, count(*) AS docs FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) x GROUP BY ALL")
def o_a10(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.least(F.count("*"), F.lit(6)).alias("n")).groupBy("n").agg(F.count("*").alias("docs"))


@query("o_a11", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def o_a11(t: Tables):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("o_a12", "SELECT doc_id, CAST(count(DISTINCT pred) AS INTEGER) AS n FROM rungs WHERE pred <> 'NONE' GROUP BY doc_id")
def o_a12(t: Tables):
    return t.rungs.filter("pred <> 'NONE'").groupBy("doc_id").agg(F.size(F.collect_set("pred")).alias("n"))


@query("o_a13", "SELECT doc_id, string_agg(pred, '|' ORDER BY rung_ord) AS preds FROM rungs GROUP BY doc_id")
def o_a13(t: Tables):
    return t.rungs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rung_ord", "pred"))), lambda x: x["pred"]), "|").alias("preds"))


@query("o_a14", "SELECT rung, round(avg(CASE WHEN pred <> 'NONE' THEN 1.0 ELSE 0 END), 6) AS coverage FROM rungs GROUP BY rung")
def o_a14(t: Tables):
    return t.rungs.groupBy("rung").agg(F.round(F.avg(F.when(F.col("pred") != "NONE", 1.0).otherwise(0.0)), 6).alias("coverage"))


@query("o_a15", "SELECT round(avg(CASE WHEN TRY_CAST(substr(pred, 1, 4) AS INTEGER) BETWEEN 2015 AND 2035 THEN 1.0 ELSE 0 END), 6) AS share FROM (SELECT DISTINCT doc_id, pred FROM rungs WHERE pred <> 'NONE') x")
def o_a15(t: Tables):
    d = t.rungs.filter("pred <> 'NONE'").select("doc_id", "pred").distinct()
    return d.agg(F.round(F.avg(F.when(F.substring("pred", 1, 4).try_cast("int").between(2015, 2035), 1.0).otherwise(0.0)), 6).alias("share"))


@query("o_a16", "SELECT split, round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END), 6) AS agree FROM (SELECT doc_id, split, count(DISTINCT pred) AS d FROM rungs WHERE pred <> 'NONE' AND rung_ord <= 3 GROUP BY ALL) x GROUP BY split")
def o_a16(t: Tables):
    d = t.rungs.filter("pred <> 'NONE' and rung_ord <= 3").groupBy("doc_id", "split").agg(F.count_distinct("pred").alias("d"))
    return d.groupBy("split").agg(F.round(F.avg(F.when(F.col("d") == 1, 1.0).otherwise(0.0)), 6).alias("agree"))


@query("o_a25", "SELECT rung, round(avg(CASE WHEN TRY_CAST(substr(pred, 1, 4) AS INTEGER) BETWEEN 2015 AND 2035 THEN 1.0 ELSE 0 END), 6) AS precision_proxy, count(*) AS n FROM rungs WHERE pred <> 'NONE' GROUP BY rung")
def o_a25(t: Tables):
    return t.rungs.filter("pred <> 'NONE'").groupBy("rung").agg(F.round(F.avg(F.when(F.substring("pred", 1, 4).try_cast("int").between(2015, 2035), 1.0).otherwise(0.0)), 6).alias("precision_proxy"), F.count("*").alias("n"))


@query("o_a35", "SELECT count(*) FILTER (WHERE contains(text, '까지')) AS until, count(*) FILTER (WHERE contains(text, '제조')) AS made, count(*) FILTER (WHERE contains(upper(text), 'EXP')) AS exp, count(*) AS n FROM texts")
def o_a35(t: Tables):
    c = F.col("text")
    return t.texts.agg(F.count_if(F.contains(c, F.lit("까지"))).alias("until"), F.count_if(F.contains(c, F.lit("제조"))).alias("made"), F.count_if(F.contains(F.upper(c), F.lit("EXP"))).alias("exp"), F.count("*").alias("n"))


@query("o_a36", "SELECT round(count(DISTINCT label) / 20.0, 6) AS coverage FROM embeddings")
def o_a36(t: Tables):
    return t.embeddings.agg(F.round(F.count_distinct("label") / 20.0, 6).alias("coverage"))


DIFF = "rungs a JOIN (SELECT doc_id, rung_ord, pred FROM rungs) b ON a.doc_id = b.doc_id AND a.rung_ord = 1 AND b.rung_ord = 2 WHERE a.pred IS DISTINCT FROM b.pred"


def _diff(t: Tables):
    pick = lambda r: F.max(F.when(F.col("rung_ord") == r, F.col("pred")))
    w = t.rungs.filter("rung_ord in (1, 2)").groupBy("doc_id").agg(pick(1).alias("before"), pick(2).alias("after"))
    return w.filter(~F.col("before").eqNullSafe(F.col("after")))


@query("o_i19", f"SELECT a.doc_id, a.pred AS before, b.pred AS after FROM {DIFF}")
def o_i19(t: Tables):
    return _diff(t)


@query("o_a38", f"SELECT count(*) AS changed FROM {DIFF}")
def o_a38(t: Tables):
    return _diff(t).agg(F.count("*").alias("changed"))


@query("o_a39", "SELECT s_suppkey, round(s_acctbal * 0.05 * 365 / 100 - 1200, 6) AS yearly, round((s_acctbal * 0.05 * 365 / 100 - 1200) * 30, 6) AS chain FROM supplier")
def o_a39(t: Tables):
    y = F.col("s_acctbal") * 0.05 * 365 / 100 - 1200
    return t.supplier.select("s_suppkey", F.round(y, 6).alias("yearly"), F.round(y * 30, 6).alias("chain"))


@query("o_a44", r"SELECT branch, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(['ymd', 'dmy', 'my']) AS branch, unnest([regexp_matches(b, '<20[0-9]{2}>[.\-/]<[0-9]{2}>[.\-/]<[0-9]{2}>'), regexp_matches(b, '<[0-9]{2}>[.\-/]<[0-9]{2}>[.\-/]<20[0-9]{2}>'), regexp_matches(b, '<[0-9]{2}>[.\-/]<20[0-9]{2}>')]) AS hit FROM (SELECT doc_id, regexp_replace(text, '([0-9]+)', '<\1>', 'g') AS b FROM texts) x) y WHERE hit GROUP BY branch")
def o_a44(t: Tables):
    return R.branches(t.texts, "doc_id", F.col("text")).groupBy("branch").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("o_s27", r"SELECT doc_id, branch FROM (SELECT doc_id, unnest(['ymd', 'dmy', 'my']) AS branch, unnest([regexp_matches(b, '<20[0-9]{2}>[.\-/]<[0-9]{2}>[.\-/]<[0-9]{2}>'), regexp_matches(b, '<[0-9]{2}>[.\-/]<[0-9]{2}>[.\-/]<20[0-9]{2}>'), regexp_matches(b, '<[0-9]{2}>[.\-/]<20[0-9]{2}>')]) AS hit FROM (SELECT doc_id, regexp_replace(text, '([0-9]+)', '<\1>', 'g') AS b FROM texts) x) y WHERE hit")
def o_s27(t: Tables):
    return R.branches(t.texts, "doc_id", F.col("text"))


# --- windows


@query("o_w1", "SELECT doc_id, pos, lead(text) OVER w AS n1, lead(text, 2) OVER w AS n2 FROM fragments WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def o_w1(t: Tables):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return t.fragments.select("doc_id", "pos", F.lead("text").over(w).alias("n1"), F.lead("text", 2).over(w).alias("n2"))


@query("o_w2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) <= 3")
def o_w2(t: Tables):
    return R.top_n(t.orders, ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("o_w3", "SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY h DESC, pos) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM boxes) x WHERE n <= 4 OR r <= greatest(4, round_even(n * 0.3, 0))")
def o_w3(t: Tables):
    return R.keep_share(t.boxes, "doc_id", [F.desc("h"), F.col("pos")], 0.3, 4).select("doc_id", "pos")


@query("o_w4", "SELECT min(r) AS needed FROM (SELECT row_number() OVER (ORDER BY value DESC, event_id) AS r, sum(value) OVER (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS c, sum(value) OVER () AS t FROM events) x WHERE c >= 0.9 * t")
def o_w4(t: Tables):
    return R.rows_for_share(t.events, "value", 0.9)


@query("o_w5", "SELECT event_type, round(avg(CASE WHEN value >= q THEN 1.0 ELSE 0 END), 6) AS kept FROM events CROSS JOIN (SELECT quantile_cont(value, 0.7) AS q FROM events) z GROUP BY event_type")
def o_w5(t: Tables):
    q = R.exact_quantile(t.events, "value", 0.7).withColumnRenamed("value", "q")
    return t.events.join(F.broadcast(q)).groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") >= F.col("q"), 1.0).otherwise(0.0)), 6).alias("kept"))  # one row


@query("o_w9", "SELECT user_id, event_id, round(m, 6) AS m FROM (SELECT user_id, event_id, avg(value) OVER w AS m, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) x WHERE n % 10 = 0")
def o_w9(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.events.select("user_id", "event_id", F.avg("value").over(w.rowsBetween(-29, 0)).alias("m"), F.row_number().over(w).alias("n"))
    return x.filter("n % 10 = 0").select("user_id", "event_id", F.round("m", 6).alias("m"))


@query("o_w10", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) x WHERE floor(n * 0.25) > floor((n - 1) * 0.25)")
def o_w10(t: Tables):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.withColumn("n", n).filter("floor(n * 0.25D) > floor((n - 1) * 0.25D)").select("o_custkey", "o_orderkey")


@query("o_w11", "SELECT text, min(doc_id) AS doc_id FROM texts GROUP BY text")
def o_w11(t: Tables):
    return t.texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"))


# --- sorts, samples


@query("o_k1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o_k1(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("o_k2", "SELECT doc_id, string_agg(pred, '|' ORDER BY k, pred) AS best FROM (SELECT DISTINCT doc_id, pred, CASE WHEN TRY_CAST(substr(pred, 1, 4) AS INTEGER) BETWEEN 2015 AND 2035 THEN 0 ELSE 1 END AS k FROM rungs QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY k, pred) <= 3) x GROUP BY doc_id")
def o_k2(t: Tables):
    k = F.when(F.substring("pred", 1, 4).try_cast("int").between(2015, 2035), 0).otherwise(1)
    best = F.slice(F.sort_array(F.collect_set(F.struct(k.alias("k"), F.col("pred").alias("pred")))), 1, 3)
    return t.rungs.groupBy("doc_id").agg(F.array_join(F.transform(best, lambda x: x["pred"]), "|").alias("best"))


@query("o_k3", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id DESC) = 1")
def o_k3(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.struct("value", "ts", "event_id")).alias("b")).select("user_id", "b.event_id")


@query("o_k4", "SELECT rung, round(cov / s, 6) AS efficiency FROM (SELECT rung, avg(CASE WHEN pred = truth THEN 1.0 ELSE 0 END) AS cov, avg(sec) AS s FROM rungs GROUP BY rung) x ORDER BY cov / s DESC LIMIT 1")
def o_k4(t: Tables):
    e = t.rungs.groupBy("rung").agg((F.avg(F.when(F.col("pred") == F.col("truth"), 1.0).otherwise(0.0)) / F.avg("sec")).alias("e"))
    return e.orderBy(F.desc("e")).limit(1).select("rung", F.round("e", 6).alias("efficiency"))


@query("o_k5", "SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42' || CAST(doc_id AS VARCHAR))) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) x WHERE r <= greatest(1, round_even(n * 0.1, 0))")
def o_k5(t: Tables):
    return R.stratified(t.documents, ["lang"], "doc_id", 0.1, "42", least=1).select("doc_id")


@query("o_k6", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7' || CAST(doc_id AS VARCHAR))) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) x WHERE r <= greatest(2, round_even(n * 0.01, 0))")
def o_k6(t: Tables):
    return R.stratified(t.documents, ["source"], "doc_id", 0.01, "7", least=2).select("doc_id")


@query("o_k7", "SELECT doc_id FROM documents ORDER BY md5('1' || CAST(doc_id AS VARCHAR)) LIMIT 50")
def o_k7(t: Tables):
    return R.hash_sample(t.documents, "doc_id", 50, "1").select("doc_id")


@query("o_k8", "WITH a AS (SELECT doc_id FROM documents ORDER BY md5('1' || CAST(doc_id AS VARCHAR)) LIMIT 30) SELECT doc_id, 'representative' AS part FROM a UNION ALL SELECT doc_id, 'targeted' FROM (SELECT doc_id FROM documents WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY md5('2' || CAST(doc_id AS VARCHAR)) LIMIT 20) b")
def o_k8(t: Tables):
    a = R.hash_sample(t.documents, "doc_id", 30, "1").select("doc_id")
    b = R.hash_sample(t.documents.filter("lang = 'fr'").join(a, "doc_id", "left_anti"), "doc_id", 20, "2").select("doc_id")
    return a.withColumn("part", F.lit("representative")).unionByName(b.withColumn("part", F.lit("targeted")))


@query("o_k9", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 6 = 1")
def o_k9(t: Tables):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.withColumn("n", n).filter("n % 6 = 1").select("o_custkey", "o_orderkey")


@query("o_k10", "SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6))::BIGINT % 5 AS fold FROM documents")
def o_k10(t: Tables):
    return t.documents.select("doc_id", R.fold(F.col("doc_id"), 5).alias("fold"))


@query("o_k11", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations UNION SELECT page_id FROM pages)")
def o_k11(t: Tables):
    seen = [t.labels.select("doc_id"), t.conversations.select(F.col("conv_id").alias("doc_id")), t.pages.select(F.col("page_id").alias("doc_id"))]
    return R.unseen(t.documents.select("doc_id"), seen, "doc_id")


@query("o_k12", "SELECT n_regionkey, g, string_agg(n_name, ',' ORDER BY n_nationkey) AS members FROM (SELECT *, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) // 4 AS g FROM nation) x GROUP BY ALL")
def o_k12(t: Tables):
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    x = t.nation.withColumn("g", F.floor((n - 1) / 4))
    return x.groupBy("n_regionkey", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: r["n_name"]), ",").alias("members"))


@query("o_i14", "SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 4 AS shard FROM orders")
def o_i14(t: Tables):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", ((n - 1) % 4).cast("long").alias("shard"))


# --- set operations


@query("o_u1", "SELECT doc_id, text FROM fragments UNION ALL SELECT doc_id, text FROM texts")
def o_u1(t: Tables):
    return t.fragments.select("doc_id", "text").unionAll(t.texts.select("doc_id", "text"))


@query("o_u2", "SELECT doc_id, pred FROM rungs WHERE rung_ord = 1 UNION SELECT doc_id, pred FROM rungs WHERE rung_ord = 2")
def o_u2(t: Tables):
    return t.rungs.filter("rung_ord in (1, 2)").select("doc_id", "pred").distinct()


@query("o_u3", "SELECT doc_id, pred FROM rungs WHERE rung_ord = 1 INTERSECT SELECT doc_id, pred FROM rungs WHERE rung_ord = 3")
def o_u3(t: Tables):
    one = lambda r: t.rungs.filter(F.col("rung_ord") == r).select("doc_id", "pred")
    return one(1).intersect(one(3))


@query("o_u4", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def o_u4(t: Tables):
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query("o_u6", "SELECT doc_id, count(*) AS keys, min_by(kind, src) AS first_kind FROM (SELECT doc_id, pred, min(rung_ord) AS src, min_by(rung, rung_ord) AS kind FROM rungs GROUP BY doc_id, pred) x GROUP BY doc_id")
def o_u6(t: Tables):
    first = t.rungs.groupBy("doc_id", "pred").agg(F.min("rung_ord").alias("src"), F.min_by("rung", "rung_ord").alias("kind"))
    return first.groupBy("doc_id").agg(F.count("*").alias("keys"), F.min_by("kind", "src").alias("first_kind"))


# --- contracts, arithmetic of boxes and models


@query("o_v1", "SELECT rule, n FROM (SELECT unnest(['unique_id', 'month', 'day']) AS rule, unnest([(SELECT count(*) - count(DISTINCT doc_id) FROM rungs WHERE rung_ord = 1), (SELECT count(*) FROM rungs WHERE rung_ord = 1 AND NOT regexp_full_match(split_part(pred, '-', 2), '[0-9]{2}|NONE')), (SELECT count(*) FROM rungs WHERE rung_ord = 1 AND NOT regexp_full_match(split_part(pred, '-', 3), '[0-9]{2}|NONE'))]) AS n) x")
def o_v1(t: Tables):
    p = F.split(F.col("pred"), "-")
    part = lambda i: F.coalesce(F.get(p, i), F.lit(""))
    rows = t.rungs.filter("rung_ord = 1").select("doc_id", part(1).alias("month"), part(2).alias("day"))
    return R.contract(rows, "doc_id", {"month": "^([0-9]{2}|NONE)$", "day": "^([0-9]{2}|NONE)$"})


@query("o_v2", "SELECT count(*) FILTER (WHERE ty || '-' || tm || '-' || td <> truth) AS inconsistent, count(*) AS n FROM rungs")
def o_v2(t: Tables):
    return t.rungs.agg(F.count_if(T.final_date(F.col("ty"), F.col("tm"), F.col("td")) != F.col("truth")).alias("inconsistent"), F.count("*").alias("n"))


@query("o_v3", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM rungs WHERE rung_ord = 1 GROUP BY doc_id HAVING count(*) > 1) a) AS duplicates, (SELECT count(*) FROM truths WHERE doc_id NOT IN (SELECT doc_id FROM rungs WHERE rung_ord = 1)) AS missing, (SELECT count(*) FROM rungs WHERE rung_ord = 1 AND NOT regexp_full_match(pred, 'NONE|([0-9]{4}|NONE)-([0-9]{2}|NONE)-([0-9]{2}|NONE)')) AS bad_format")
def o_v3(t: Tables):
    return R.label_problems(t.truths.select("doc_id"), t.rungs.filter("rung_ord = 1").select("doc_id", F.col("pred").alias("label")), "doc_id")


@query("o_m1", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def o_m1(t: Tables):
    return t.embeddings.select("vec_id", F.round(R.norm2(F.col("embedding")), 4).alias("norm"))


@query("o_m4", "SELECT l_orderkey, l_linenumber, round(0.5 * ln(1 + greatest(0, l_quantity)) - 0.2 * l_discount + 0.1 * l_tax + 0.05, 6) AS score FROM lineitem")
def o_m4(t: Tables):
    x = F.array("l_quantity", "l_discount", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(R.linear_score(x, (0.5, -0.2, 0.1), 0.05, (0,)), 6).alias("score"))


@query("o_m6", "SELECT round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0 END), 6) AS kept FROM (SELECT doc_id, count(*) FILTER (WHERE pred = truth AND rung_ord <= 2) AS f FROM rungs GROUP BY doc_id HAVING count(*) FILTER (WHERE pred = truth) > 0) x")
def o_m6(t: Tables):
    ok = F.col("pred") == F.col("truth")
    v = t.rungs.groupBy("doc_id").agg(F.count_if(ok & (F.col("rung_ord") <= 2)).alias("f"), F.count_if(ok).alias("all")).filter(F.col("all") > 0)
    return v.agg(F.round(F.avg(F.when(F.col("f") > 0, 1.0).otherwise(0.0)), 6).alias("kept"))


@query("o_g9", "SELECT doc_id, pos, round((x0 - 5) * 640 / 400, 6) AS u0, round(x0 * 640 / 400, 6) AS back FROM boxes")
def o_g9(t: Tables):
    return t.boxes.select("doc_id", "pos", F.round((F.col("x0") - 5) * 640 / 400, 6).alias("u0"), F.round(F.col("x0") * 640 / 400, 6).alias("back"))


@query("o_g11", "SELECT user_id, min(event_id) AS a, max(event_id) AS b, count(*) AS n FROM (SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS band FROM (SELECT user_id, event_id, hot, CASE WHEN hot AND NOT coalesce(lag(hot) OVER (PARTITION BY user_id ORDER BY event_id), false) THEN 1 ELSE 0 END AS new FROM (SELECT user_id, event_id, value > 50 AS hot FROM events) x) y WHERE hot) z GROUP BY user_id, band")
def o_g11(t: Tables):
    return R.bands(t.events.select("user_id", "event_id", (F.col("value") > 50).alias("hot")), "user_id", "event_id", "hot")


@query("o_g13", "SELECT th, count(*) FILTER (WHERE value >= th) AS boxes, count(DISTINCT user_id) FILTER (WHERE value >= th) AS hits FROM events CROSS JOIN (VALUES (10), (25), (50), (75), (90)) v(th) GROUP BY th")
def o_g13(t: Tables):
    e = t.events.withColumn("th", F.explode(F.array(*map(F.lit, (10, 25, 50, 75, 90))))).filter("value >= th")
    return e.groupBy("th").agg(F.count("*").alias("boxes"), F.count_distinct("user_id").alias("hits"))


@query("o_g14", "SELECT event_type, round(median(value), 6) AS mid, round(median(value) / (SELECT median(value) FROM events), 6) AS ratio FROM events GROUP BY event_type")
def o_g14(t: Tables):
    every = R.exact_quantile(t.events, "value", 0.5).withColumnRenamed("value", "m")
    g = t.events.groupBy("event_type").agg(F.percentile("value", 0.5).alias("mid"))
    return g.join(F.broadcast(every)).select("event_type", F.round("mid", 6).alias("mid"), F.round(F.col("mid") / F.col("m"), 6).alias("ratio"))  # one row


@query("o_g18", "SELECT doc_id, pos FROM boxes WHERE (x1 - x0) * h BETWEEN 150 AND 350 AND (x1 - x0) >= 12")
def o_g18(t: Tables):
    w = F.col("x1") - F.col("x0")
    return t.boxes.filter((w * F.col("h")).between(150, 350) & (w >= 12)).select("doc_id", "pos")


@query("o_i15", "SELECT doc_id, pos, '0 ' || CAST(CAST(round((x0 + x1) / 2 / 400 * 1000) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(h / 100 * 1000) AS BIGINT) AS VARCHAR) AS line FROM boxes")
def o_i15(t: Tables):
    mille = lambda c: F.round(c * 1000).cast("long").cast("string")
    return t.boxes.select("doc_id", "pos", F.concat_ws(" ", F.lit("0"), mille((F.col("x0") + F.col("x1")) / 2 / 400), mille(F.col("h") / 100)).alias("line"))


@query("o_i16", "SELECT doc_id, rung, CASE WHEN pred = truth THEN 'right' ELSE 'wrong' END || '/' || CAST(doc_id AS VARCHAR) || '_' || truth || '_' || pred || '.jpg' AS target FROM rungs")
def o_i16(t: Tables):
    kind = F.when(F.col("pred") == F.col("truth"), "right").otherwise("wrong")
    return t.rungs.select("doc_id", "rung", F.concat(kind, F.lit("/"), F.col("doc_id").cast("string"), F.lit("_"), "truth", F.lit("_"), "pred", F.lit(".jpg")).alias("target"))


@query("o_d32", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(hour(o_orderdate) AS INTEGER) AS hour, count(*) AS n FROM orders GROUP BY ALL")
def o_d32(t: Tables):
    s = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    ts = F.try_to_timestamp(s, F.lit("yyyy:MM:dd HH:mm:ss"))
    return t.orders.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
