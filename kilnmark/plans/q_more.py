"""Queries of the fallback date rules, boxes, budgets, event windows and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fallback as B
from ..functions import text as T
from ..functions.spans import find_spans
from ..operators import boxes as X
from ..operators import cascade as C
from ..operators import models as M
from ..operators import relational as R
from ..streaming import budget
from .q_text import BARE, KIND_SQL, has_sql
from .registry import Tables, query


@query("o_s17", "SELECT doc_id, CAST(instr(text, r) - 1 AS INTEGER) AS s, CAST(instr(text, r) - 1 + length(r) AS INTEGER) AS e FROM (SELECT doc_id, text, regexp_extract(text, '[0-9]{9,}') AS r FROM texts) x WHERE r <> ''")
def o_s17(t: Tables):
    return t.texts.select("doc_id", F.explode(find_spans(F.col("text"), r"\d{9,}")).alias("x")).select("doc_id", "x.s", "x.e")


@query("o_d18")
def o_d18(t: Tables):
    found = t.texts.select("doc_id", F.explode(B.find_dates(F.col("text"))).alias("x"))
    return found.select("doc_id", "x.s", "x.e", "x.kind", F.col("x.dt").cast("string").alias("dt"))


@query("o_d19", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (kr AND eu AND latin) OR (eu AND NOT kr) THEN TRY_CAST('20' || lpad(c, 2, '0') || '-' || lpad(b, 2, '0') || '-' || lpad(a, 2, '0') AS DATE) ELSE TRY_CAST('20' || lpad(a, 2, '0') || '-' || lpad(b, 2, '0') || '-' || lpad(c, 2, '0') AS DATE) END AS VARCHAR) AS dt FROM (SELECT *, CAST(a AS INTEGER) BETWEEN 15 AND 35 AND CAST(c AS INTEGER) BETWEEN 1 AND 31 AS kr, CAST(c AS INTEGER) BETWEEN 15 AND 35 AND CAST(a AS INTEGER) BETWEEN 1 AND 31 AS eu FROM (SELECT l_orderkey, l_linenumber, CAST(1 + l_partkey % 40 AS VARCHAR) AS a, CAST(1 + l_partkey % 12 AS VARCHAR) AS b, CAST(1 + l_suppkey % 31 AS VARCHAR) AS c, l_linenumber % 2 = 0 AS latin FROM lineitem) x) y")
def o_d19(t: Tables):
    a, b, c = (1 + F.col("l_partkey") % 40).cast("int"), (1 + F.col("l_partkey") % 12).cast("int"), (1 + F.col("l_suppkey") % 31).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", B.order_two_digit(a, b, c, F.col("l_linenumber") % 2 == 0).cast("string").alias("dt"))


@query("o_d20", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN a > 12 AND b > 12 THEN NULL WHEN b > 12 THEN TRY_CAST('2024-' || lpad(CAST(a AS VARCHAR), 2, '0') || '-' || lpad(CAST(b AS VARCHAR), 2, '0') AS DATE) ELSE TRY_CAST('2024-' || lpad(CAST(b AS VARCHAR), 2, '0') || '-' || lpad(CAST(a AS VARCHAR), 2, '0') AS DATE) END AS VARCHAR) AS dt FROM (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 31 AS a, 1 + l_suppkey % 31 AS b FROM lineitem) x")
def o_d20(t: Tables):
    a, b = (1 + F.col("l_partkey") % 31).cast("int"), (1 + F.col("l_suppkey") % 31).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", B.day_month(a, b, F.lit(2024)).cast("string").alias("dt"))


@query("o_d21")
def o_d21(t: Tables):
    return t.texts.select("doc_id", F.explode(B.find_dates_with_tail(F.col("text"))).alias("x")).select("doc_id", "x.kind", F.col("x.dt").cast("string").alias("dt"))


@query("o_d22")
def o_d22(t: Tables):
    c = F.concat("text", F.lit(" 11:30"))
    return t.texts.select("doc_id", F.explode(B.find_dates(c, drop_times=True)).alias("x")).select("doc_id", "x.kind", F.col("x.dt").cast("string").alias("dt"))


_BR = r"(SELECT doc_id, regexp_replace(text, '([0-9]+)', '<\1>', 'g') AS b FROM texts)"


@query("o_d23", rf"SELECT doc_id, z[1] || '-' || z[2] AS md FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(b, p, 1), regexp_extract_all(b, p, 2), regexp_extract_all(b, p, 3))) AS z FROM (SELECT *, '<(1[0-2]|0[1-9])>\s*[.\-/]\s*<(3[01]|[12][0-9]|0[1-9])>([.\-/:])?' AS p FROM {_BR} x0) x) y WHERE coalesce(z[3], '') = ''")
def o_d23(t: Tables):
    return t.texts.select("doc_id", F.explode(B.find_month_day(F.col("text"))).alias("md"))


@query("o_d24", rf"SELECT doc_id, z[2] || '-' || z[1] AS ym FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(b, p, 1), regexp_extract_all(b, p, 2))) AS z FROM (SELECT *, '<(1[0-2]|0[1-9])>\s*[.\-/]\s*<(19[0-9]{{2}}|20[0-4][0-9])>' AS p FROM {_BR} x0) x) y UNION ALL SELECT doc_id, z[1] || '-' || z[2] FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(b, p, 1), regexp_extract_all(b, p, 2), regexp_extract_all(b, p, 3))) AS z FROM (SELECT *, '<(19[0-9]{{2}}|20[0-4][0-9])>\s*[.\-/년]\s*<(1[0-2]|0[1-9])>([.\-/])?' AS p FROM {_BR} x0) x) y WHERE coalesce(z[3], '') = ''")
def o_d24(t: Tables):
    return t.texts.select("doc_id", F.explode(B.find_year_month(F.col("text"))).alias("ym"))


@query("o_d25")
def o_d25(t: Tables):
    return t.texts.select("doc_id", B.made_only(F.expr(BARE), F.to_date(F.concat_ws("-", "ty", "tm", "td"))).alias("v"))


#: Each text beside a word of the kind that makes it a pair for some.
_PAIRED = f"({BARE}) || CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN ' 까지' WHEN 1 THEN ' 제조' ELSE ' EXPIRY' END"


@query("o_d26", f"SELECT doc_id, variant % 4 < 3 AND (({has_sql(['부터'], _PAIRED)} AND {has_sql(['까지'], _PAIRED)}) OR ({has_sql(KIND_SQL['neg'], _PAIRED)} AND {has_sql(KIND_SQL['pos'], _PAIRED)})) AS v FROM texts")
def o_d26(t: Tables):
    return t.texts.select("doc_id", B.needs_more(F.when(F.col("variant") % 4 < 3, 1).otherwise(2), T.find_anchors(F.expr(_PAIRED))).alias("v"))


@query("o_d27")
def o_d27(t: Tables):
    # dealt to the full number of partitions, as the patterns cost far more than the few bytes of a file's texts suggest
    texts = t.texts.select("doc_id", "text").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return texts.select("doc_id", B.select_date(F.col("text")).alias("p")).select("doc_id", "p.*")


@query("o_d28", "SELECT l_orderkey, l_linenumber, CAST(TRY_CAST('20' || lpad(CAST(l_partkey % 50 AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_suppkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS dt FROM lineitem")
def o_d28(t: Tables):
    n = lambda c, k: (F.col(c) % k).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", B.century_date(n("l_partkey", 50), n("l_suppkey", 14), n("l_orderkey", 33)).cast("string").alias("dt"))


@query("o_d29")
def o_d29(t: Tables):
    """By place, flagged instead of dropped: whether a date lies within a long run of digits."""
    c = F.col("text")
    found = F.array_sort(B.find_dates(c))
    return t.texts.select("doc_id", F.posexplode(found).alias("i", "x"), F.exists(find_spans(c, r"\d{9,}"), lambda r: r["s"] >= 0).alias("has_long")).select("doc_id", "i", "x.s", "x.kind", F.col("x.dt").cast("string").alias("dt"), "has_long")


@query("o_d30")
def o_d30(t: Tables):
    return t.texts.select("doc_id", F.explode(B.interpretations(F.col("text"))).alias("d")).select("doc_id", F.col("d").cast("string").alias("dt"))


@query("o_d31", "SELECT rule, coalesce(v, 'abstain') AS v, count(*) AS n FROM (SELECT unnest(['R0_dmy', 'R1_ymd', 'R2_latin', 'R5_abstain']) AS rule, unnest(['dmy', 'ymd', CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^가-힣]', '', 'g')) THEN 'dmy' ELSE 'ymd' END, NULL]) AS v FROM texts) x GROUP BY ALL")
def o_d31(t: Tables):
    rules = {k: v for k, v in B.order_rules(F.col("text")).items() if k in ("R0_dmy", "R1_ymd", "R2_latin", "R5_abstain")}
    rows = t.texts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit("abstain")).alias("v")) for k, v in rules.items()])).alias("x"))
    return rows.groupBy("x.rule", "x.v").agg(F.count("*").alias("n"))


@query("o_d35", "SELECT variant, count(*) AS n, count(DISTINCT text) AS kinds FROM texts GROUP BY variant")
def o_d35(t: Tables):
    return t.texts.groupBy("variant").agg(F.count("*").alias("n"), F.count_distinct("text").alias("kinds"))


@query("o_w6")
def o_w6(t: Tables):
    return X.merge_lines(t.boxes)


@query("o_g8")
def o_g8(t: Tables):
    b = t.boxes.select("doc_id", F.struct((F.col("h") / 20).alias("score"), F.col("x0"), F.col("cy").alias("y0"), F.col("x1"), (F.col("cy") + F.col("h")).alias("y1")).alias("b"))
    return b.groupBy("doc_id").agg(F.collect_list("b").alias("bs")).select("doc_id", F.size(X.non_maximum(F.col("bs"), "array<struct<score:double,x0:double,y0:double,x1:double,y1:double>>")).alias("kept"))


@query("o_c8", "SELECT doc_id, string_agg(text, '' ORDER BY pos, text) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, text) AS r FROM boxes) x WHERE r <= 5 GROUP BY doc_id")
def o_c8(t: Tables):
    best = F.slice(F.array_sort(F.collect_list(F.struct("pos", "text"))), 1, 5)
    return t.boxes.groupBy("doc_id").agg(F.array_join(F.transform(best, lambda x: x["text"]), "").alias("line"))


_SC = "SELECT doc_id, CASE WHEN a IS NOT NULL THEN 'one' WHEN b IS NOT NULL THEN 'two' ELSE 'none' END AS stage FROM (SELECT doc_id, max(pred) FILTER (WHERE rung_ord = 1 AND pred = truth) AS a, max(pred) FILTER (WHERE rung_ord = 2 AND pred = truth) AS b FROM rungs GROUP BY doc_id) x"


def _staged(t: Tables):
    pick = lambda r: F.max(F.when((F.col("rung_ord") == r) & (F.col("pred") == F.col("truth")), F.col("pred")))
    todo = t.rungs.filter("rung_ord <= 2").groupBy("doc_id").agg(pick(1).alias("a"), pick(2).alias("b"))
    return C.staged(todo, [("one", lambda d: d.withColumn("v", F.col("a"))), ("two", lambda d: d.withColumn("v", F.col("b")))], "doc_id", "v")


@query("o_x1", _SC)
def o_x1(t: Tables):
    """Stages run only on what is left; equal to evaluating all of them."""
    return _staged(t).select("doc_id", "stage")


@query("o_c6", f"SELECT stage, count(*) AS n FROM ({_SC}) s GROUP BY stage")
def o_c6(t: Tables):
    return _staged(t).groupBy("stage").agg(F.count("*").alias("n"))


@query("o_c7", "SELECT doc_id, CASE WHEN a <> 'NONE' THEN a ELSE b END AS pred, a = 'NONE' AS second_pass FROM (SELECT doc_id, max(pred) FILTER (WHERE rung_ord = 1) AS a, max(pred) FILTER (WHERE rung_ord = 2) AS b FROM rungs GROUP BY doc_id) x")
def o_c7(t: Tables):
    pick = lambda r: F.max(F.when(F.col("rung_ord") == r, F.col("pred")))
    w = t.rungs.filter("rung_ord <= 2").groupBy("doc_id").agg(pick(1).alias("a"), pick(2).alias("b"))
    return w.select("doc_id", F.when(F.col("a") != "NONE", F.col("a")).otherwise(F.col("b")).alias("pred"), (F.col("a") == "NONE").alias("second_pass"))


@query("o_t1")
def o_t1(t: Tables):
    return budget.levels(t.rungs.select("rung", "doc_id", "sec"), "rung", "doc_id", "sec", 1000.0)


@query("o_t2", "SELECT rung, count(*) AS n FROM (SELECT rung, row_number() OVER (PARTITION BY rung ORDER BY doc_id) AS k FROM rungs) x WHERE floor(k * 0.4) > floor((k - 1) * 0.4) GROUP BY rung")
def o_t2(t: Tables):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("rung").orderBy("doc_id"))
    return t.rungs.select("rung", k.alias("k")).filter("floor(k * 0.4BD) > floor((k - 1) * 0.4BD)").groupBy("rung").agg(F.count("*").alias("n"))


@query("o_t3", "SELECT event_type AS stage, count(*) AS n FROM events GROUP BY event_type")
def o_t3(t: Tables):
    return budget.stage_counts(t.events, "event_type").withColumnRenamed("event_type", "stage")


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(t: Tables):
    return budget.windowed(t.events, "ts", "1 hour", None, None, "event_type").select("start", "event_type", "n")


@query("window_session", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, g")
def window_session(t: Tables):
    return budget.sessions(t.events, "ts", "30 minutes", "user_id").select("user_id", "start", "n")


@query("o_m1_nearest", "SELECT label, vec_id FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY round(list_sum(list_transform(list_zip(e.embedding, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6), e.vec_id) AS r FROM embeddings e JOIN (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) x GROUP BY ALL) y GROUP BY label) c USING (label)) z WHERE r = 1")
def o_m1_nearest(t: Tables):
    return M.nearest_to_centroid(t.embeddings, "label", "vec_id", "embedding")


@query("o_m1_kmeans")
def o_m1_kmeans(t: Tables):
    return M.kmeans(t.embeddings, "vec_id", "embedding", 8)


@query("o_m2")
def o_m2(t: Tables):
    return M.out_of_fold(t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_discount", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y")), "k", ["l_quantity", "l_discount"], "y", 3)


@query("o_m3", "SELECT l_returnflag, round(avg(0.1 + 0.5 * (l_quantity - mq) / sq - 1.0 * (l_tax - mt) / st), 6) AS z FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem) s GROUP BY l_returnflag")
def o_m3(t: Tables):
    """A model of scaled features applied to unscaled ones: the same scores without a scaler."""
    s = t.lineitem.agg(*[f(c).alias(f"{n}_{c}") for c in ("l_quantity", "l_tax") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    w, b = R.fold_scaler([0.5, -1.0], 0.1, [s["m_l_quantity"], s["m_l_tax"]], [s["s_l_quantity"], s["s_l_tax"]])
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_quantity") * w[0] + F.col("l_tax") * w[1] + b), 6).alias("z"))


@query("o_m5")
def o_m5(t: Tables):
    return M.boosted_importance(t.lineitem.select("l_quantity", "l_discount", "l_tax", F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("y")), ["l_quantity", "l_discount", "l_tax"], "y")
