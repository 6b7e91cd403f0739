"""Queries of scoring, tests, taxonomies, cascades and ensembles over the rung predictions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import cascade as C
from ..operators import evals as E
from .q_text import FULL_DATES, PARTIAL_DATES
from .registry import Tables, query

P = "split_part(pred, '-', {i})"


def parts_sql(source: str, extra: str = "*") -> str:
    """t_y.. and p_y.. of a (truth, pred) table, with hits."""
    cols = []
    for s, c in (("t", "truth"), ("p", "pred")):
        for i, k in enumerate("ymd", 1):
            cols.append(f"CASE WHEN len(string_split(coalesce({c}, 'NONE'), '-')) = 3 THEN string_split({c}, '-')[{i}] ELSE 'NONE' END AS {s}_{k}")
    hits = " + ".join(f"CASE WHEN t_{k} = p_{k} THEN 1 ELSE 0 END" for k in "ymd")
    return f"(SELECT *, {hits} AS hits FROM (SELECT {extra}, {', '.join(cols)} FROM {source}) p0)"


MISS_P, MISS_T = "(p_y = 'NONE' AND p_m = 'NONE' AND p_d = 'NONE')", "(t_y = 'NONE' AND t_m = 'NONE' AND t_d = 'NONE')"
FILL = {s: "(" + " + ".join(f"CASE WHEN {s}_{k} <> 'NONE' THEN 1 ELSE 0 END" for k in "ymd") + ")" for s in "tp"}


def score_sql(source: str, *by: str) -> str:
    keys = ", ".join(by) + ", " if by else ""
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""SELECT {keys}count(*) AS n, CAST(sum(CASE WHEN t_y = p_y THEN 1 ELSE 0 END) AS BIGINT) AS year_hits, CAST(sum(CASE WHEN t_m = p_m THEN 1 ELSE 0 END) AS BIGINT) AS month_hits,
      CAST(sum(CASE WHEN t_d = p_d THEN 1 ELSE 0 END) AS BIGINT) AS day_hits, round(sum(hits) / (3.0 * count(*)), 6) AS score, count(*) FILTER (WHERE hits = 3) AS exact,
      count(*) FILTER (WHERE {MISS_P} AND NOT {MISS_T}) AS miss, count(*) FILTER (WHERE {MISS_T} AND NOT {MISS_P}) AS false_positive, round(sum({FILL['p']}) / (3.0 * count(*)), 6) AS fill FROM {parts_sql(source)} s {group}"""


@query("o_a17", score_sql("rungs", "rung"))
def o_a17(t: Tables):
    return E.field_score(t.rungs, "rung")


@query("o_a18", score_sql("rungs", "split", "rung"))
def o_a18(t: Tables):
    return E.field_score(t.rungs, "split", "rung")


@query("o_a40", f"SELECT split, rung_ord, count(*) AS n, round(sum(hits) / (3.0 * count(*)), 6) AS score FROM {parts_sql('rungs')} s GROUP BY ROLLUP (split, rung_ord)")
def o_a40(t: Tables):
    return E.with_parts(t.rungs).rollup("split", "rung_ord").agg(F.count("*").alias("n"), F.round(F.sum("hits") / (3 * F.count("*")), 6).alias("score"))


HITS = f"(SELECT doc_id, split, rung_ord, hits FROM {parts_sql('rungs')} s)"


def _pairs(t: Tables, a: int = 1, b: int = 4):
    """Hits of two rungs side by side: one pass, no self-join."""
    h = E.with_parts(t.rungs.filter(F.col("rung_ord").isin(a, b)))
    pick = lambda r: F.max(F.when(F.col("rung_ord") == r, F.col("hits")))
    return h.groupBy("doc_id", "split").agg(pick(a).alias("old"), pick(b).alias("new"))


MCN = "CASE WHEN up + down = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * 0.6931471805599453)))), 6) END AS p_value"


@query("o_a19", f"SELECT split, up, down, {MCN} FROM (SELECT a.split, count(*) FILTER (WHERE b.hits > a.hits) AS up, count(*) FILTER (WHERE b.hits < a.hits) AS down FROM {HITS} a JOIN {HITS} b ON a.doc_id = b.doc_id AND a.rung_ord = 1 AND b.rung_ord = 4 GROUP BY a.split) c")
def o_a19(t: Tables):
    return E.mcnemar(_pairs(t), "old", "new", "split")


COV = "(SELECT split, count(*) FILTER (WHERE a.pred = 'NONE' AND b.pred <> 'NONE') AS up, count(*) FILTER (WHERE a.pred <> 'NONE' AND b.pred = 'NONE') AS down, count(*) FILTER (WHERE a.pred <> 'NONE' AND b.pred <> 'NONE') AS both_found, count(*) FILTER (WHERE a.pred = 'NONE' AND b.pred = 'NONE') AS neither FROM rungs a JOIN (SELECT doc_id, rung_ord, pred FROM rungs) b USING (doc_id) WHERE a.rung_ord = 1 AND b.rung_ord = 2 GROUP BY split)"


def _coverage(t: Tables):
    has = lambda r: F.max(F.when(F.col("rung_ord") == r, F.when(F.col("pred") == "NONE", 0).otherwise(1)))
    w = t.rungs.filter("rung_ord in (1, 2)").groupBy("doc_id", "split").agg(has(1).alias("a"), has(2).alias("b"))
    return w.groupBy("split").agg(F.count_if(F.col("a") < F.col("b")).alias("up"), F.count_if(F.col("a") > F.col("b")).alias("down"), F.count_if(F.col("a") + F.col("b") == 2).alias("both_found"), F.count_if(F.col("a") + F.col("b") == 0).alias("neither"))


@query("o_a20", f"SELECT split, up, down, {MCN} FROM {COV} c")
def o_a20(t: Tables):
    return _coverage(t).select("split", "up", "down", F.round(E.binomial_two_sided(F.col("up"), F.col("down")), 6).alias("p_value"))


@query("o_u5", f"SELECT split, up AS gained, down AS lost, both_found, neither FROM {COV} c")
def o_u5(t: Tables):
    return _coverage(t).select("split", F.col("up").alias("gained"), F.col("down").alias("lost"), "both_found", "neither")


W = "k, n, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)) END, 6) AS lo, round(CASE WHEN n = 0 THEN 0 ELSE least(1, (p + 1.96*1.96/(2*n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n)))/(1+1.96*1.96/n)) END, 6) AS hi"


def _exact(t: Tables):
    return E.with_parts(t.rungs).groupBy("split", "rung").agg(F.count_if(F.col("hits") == 3).alias("k"), F.count("*").alias("n"))


EXACT = f"(SELECT split, rung, count(*) FILTER (WHERE hits = 3) AS k, count(*) AS n FROM {parts_sql('rungs')} s GROUP BY split, rung)"


@query("o_a21", f"SELECT split, rung, {W} FROM (SELECT *, k * 1.0 / n AS p FROM {EXACT} e) x")
def o_a21(t: Tables):
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    return _exact(t).select("split", "rung", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("o_a22", f"SELECT split, rung, round(1.96 * sqrt(0.25 / n), 6) AS half FROM {EXACT} e")
def o_a22(t: Tables):
    return _exact(t).select("split", "rung", F.round(1.96 * F.sqrt(0.25 / F.col("n")), 6).alias("half"))


@query("o_a23", "SELECT split, round(3.0 / count(*), 8) AS upper_bound FROM truths GROUP BY split")
def o_a23(t: Tables):
    return t.truths.groupBy("split").agg(F.round(3.0 / F.count("*"), 8).alias("upper_bound"))


@query("o_a24", "SELECT split, round(avg(CASE WHEN list_contains(c, truth) THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN len(list_filter(c, lambda x: x <> 'NONE')) > 0 THEN 1.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN first = truth THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (SELECT doc_id, split, truth, list(pred) AS c, min_by(pred, rung_ord) AS first FROM rungs GROUP BY ALL) x GROUP BY split")
def o_a24(t: Tables):
    c = t.rungs.groupBy("doc_id", "split", "truth").agg(F.collect_list("pred").alias("c"), F.min_by("pred", "rung_ord").alias("first"))
    share = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6)
    return c.groupBy("split").agg(share(F.array_contains("c", F.col("truth"))).alias("recall"), share(F.exists("c", lambda x: x != "NONE")).alias("coverage"), share(F.col("first") == F.col("truth")).alias("accuracy"))


@query("o_a26", "SELECT doc_id, pred, votes FROM (SELECT doc_id, pred, count(*) AS votes, min(rung_ord) AS f FROM rungs GROUP BY doc_id, pred) x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, f) = 1")
def o_a26(t: Tables):
    return E.majority(t.rungs)


WIDE3 = "(SELECT doc_id, max(pred) FILTER (WHERE rung_ord = 1) AS a, max(pred) FILTER (WHERE rung_ord = 2) AS b, max(pred) FILTER (WHERE rung_ord = 3) AS c, max(truth) AS truth, max(split) AS split FROM rungs GROUP BY doc_id)"


def _wide(t: Tables):
    pick = lambda r: F.max(F.when(F.col("rung_ord") == r, F.col("pred")))
    return t.rungs.groupBy("doc_id").agg(pick(1).alias("a"), pick(2).alias("b"), pick(3).alias("c"), F.max("truth").alias("truth"), F.max("split").alias("split"))


@query("o_a27", f"SELECT doc_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE c END AS pred FROM {WIDE3} w")
def o_a27(t: Tables):
    a, b, c = (F.col(x) for x in "abc")
    return _wide(t).select("doc_id", F.when((a == b) | (a == c), a).when(b == c, b).otherwise(c).alias("pred"))


@query("o_a28", "SELECT doc_id, round(1 - max(n) / CAST(sum(n) AS DOUBLE), 6) AS disagree FROM (SELECT doc_id, pred, count(*) AS n FROM rungs GROUP BY ALL) x GROUP BY doc_id")
def o_a28(t: Tables):
    return t.rungs.groupBy("doc_id", "pred").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.round(1 - F.max("n") / F.sum("n"), 6).alias("disagree"))


@query("o_a29", "SELECT cat, count(*) AS n FROM (SELECT doc_id, CASE WHEN d = 0 THEN 'D' WHEN d = 1 AND f = 8 THEN 'A' WHEN d = 1 THEN 'B' ELSE 'C' END AS cat FROM (SELECT doc_id, count(DISTINCT pred) FILTER (WHERE pred <> 'NONE') AS d, count(*) FILTER (WHERE pred <> 'NONE') AS f FROM rungs GROUP BY doc_id) x) y GROUP BY cat")
def o_a29(t: Tables):
    found = F.filter("p", lambda x: x != "NONE")
    v = t.rungs.groupBy("doc_id").agg(F.collect_list("pred").alias("p")).select(F.size(F.array_distinct(found)).alias("d"), F.size(found).alias("f"))
    return v.groupBy(F.when(F.col("d") == 0, "D").when((F.col("d") == 1) & (F.col("f") == 8), "A").when(F.col("d") == 1, "B").otherwise("C").alias("cat")).agg(F.count("*").alias("n"))


@query("o_a30", f"SELECT doc_id, pred, hits FROM {parts_sql('rungs')} s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, rung_ord) = 1")
def o_a30(t: Tables):
    return E.best_of(t.rungs)


@query("o_a31", "SELECT rung, round(avg(sec), 6) AS mean_sec, round(sum(sec), 6) AS total_sec, round(avg(sec) * 500, 6) AS sec_500, round(avg(sec) * 500 / 2400 * 100, 6) AS percent_of_limit FROM rungs GROUP BY rung")
def o_a31(t: Tables):
    m = F.avg("sec")
    return t.rungs.groupBy("rung").agg(F.round(m, 6).alias("mean_sec"), F.round(F.sum("sec"), 6).alias("total_sec"), F.round(m * 500, 6).alias("sec_500"), F.round(m * 500 / 2400 * 100, 6).alias("percent_of_limit"))


@query("o_a32", "SELECT rung, round(s / t, 6) AS share FROM (SELECT rung, sum(sec) AS s, sum(sum(sec)) OVER () AS t FROM rungs GROUP BY rung) x")
def o_a32(t: Tables):
    s = t.rungs.groupBy("rung").agg(F.sum("sec").alias("s"))
    return s.select("rung", F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


def _taxonomy(name: str, cases: str):
    @query(name, f"SELECT class, count(*) AS n, CAST(sum(3 - hits) AS BIGINT) AS lost FROM (SELECT *, {cases} AS class FROM {parts_sql('rungs')} s) x GROUP BY class")
    def run(t: Tables):
        return E.taxonomy(t.rungs, name)


_BASE = f"CASE WHEN hits = 3 THEN 'right' WHEN {MISS_P} THEN '%s' WHEN {MISS_T} THEN '%s' "
_YEAR, _SWAP = "t_y <> p_y AND t_m = p_m AND t_d = p_d", "t_y = p_y AND t_m = p_d AND t_d = p_m"
_YD = "substr(t_y, 3, 2) = p_d AND t_d = substr(p_y, 3, 2)"
_taxonomy("o_e1", _BASE % ("A_miss", "F_false_positive") + f"WHEN {FILL['t']} < 3 OR {FILL['p']} < 3 THEN 'E_partial' WHEN {_YEAR} THEN 'B_year' WHEN t_y = p_y THEN 'C_month_day' ELSE 'D_different' END")
_taxonomy("o_e2", _BASE % ("miss", "fp") + f"WHEN {FILL['p']} < {FILL['t']} THEN 'partial_short' WHEN {FILL['p']} > {FILL['t']} THEN 'partial_over' WHEN {_YEAR} THEN 'year_only' WHEN t_y = p_y THEN 'md_only' WHEN TRY_CAST(pred AS DATE) < TRY_CAST(truth AS DATE) THEN 'mfg_picked' ELSE 'other' END")
_taxonomy("o_e3", _BASE % ("miss", "fp") + f"WHEN {_YEAR} THEN 'year' WHEN {_SWAP} THEN 'month_day_swap' WHEN {_YD} THEN 'year_day_swap' WHEN hits = 2 THEN 'one_field' WHEN {FILL['p']} < 3 THEN 'partly_read' ELSE 'all_differ' END")
_taxonomy("o_e4", _BASE % ("miss", "fp") + f"WHEN t_m = p_m AND {_YD} THEN 'year_day_swap' WHEN {_SWAP} THEN 'month_day_swap' WHEN hits = 2 THEN 'one_field' ELSE 'all_differ' END")


@query("o_a33", f"SELECT class, n, lost, round(lost * 1.0 / sum(lost) OVER (), 6) AS share, round(lost * 100.0 / (3 * sum(n) OVER ()), 6) AS points FROM (SELECT {_BASE % ('miss', 'fp')} WHEN t_m = p_m AND {_YD} THEN 'year_day_swap' WHEN {_SWAP} THEN 'month_day_swap' WHEN hits = 2 THEN 'one_field' ELSE 'all_differ' END AS class, count(*) AS n, CAST(sum(3 - hits) AS BIGINT) AS lost FROM {parts_sql('rungs')} s GROUP BY class) x")
def o_a33(t: Tables):
    w = Window.partitionBy()  # one row a class
    return E.taxonomy(t.rungs, "o_e4").select("class", "n", "lost", F.round(F.col("lost") / F.sum("lost").over(w), 6).alias("share"), F.round(F.col("lost") * 100 / (3 * F.sum("n").over(w)), 6).alias("points"))


@query("o_e13", f"SELECT CASE WHEN b.hits > a.hits THEN 'improved' WHEN b.hits < a.hits THEN 'worse' ELSE 'same' END AS class, count(*) AS n FROM {HITS} a JOIN {HITS} b ON a.doc_id = b.doc_id AND a.rung_ord = 1 AND b.rung_ord = 5 GROUP BY class")
def o_e13(t: Tables):
    p = _pairs(t, 1, 5).withColumnsRenamed({"old": "base_hits", "new": "hits"})
    return p.groupBy(E.TAXONOMIES["o_e13"]().alias("class")).agg(F.count("*").alias("n"))


@query("o_e5", "SELECT CASE WHEN d = 0 THEN 'miss' WHEN top = truth THEN 'right' WHEN d > 1 THEN 'multi_wrong_pick' WHEN substr(top, 1, 4) <> substr(truth, 1, 4) AND substr(top, 5) = substr(truth, 5) THEN 'year' WHEN substr(top, 1, 4) = substr(truth, 1, 4) THEN 'month_day' ELSE 'single_wrong' END AS class, count(*) AS n FROM (SELECT doc_id, truth, count(DISTINCT pred) FILTER (WHERE pred <> 'NONE') AS d, min_by(pred, rung_ord) FILTER (WHERE pred <> 'NONE') AS top FROM rungs WHERE rung_ord <= 2 GROUP BY doc_id, truth) x GROUP BY class")
def o_e5(t: Tables):
    p = F.when(F.col("pred") != "NONE", F.col("pred"))
    v = t.rungs.filter("rung_ord <= 2").groupBy("doc_id", "truth").agg(F.count_distinct(p).alias("d"), F.min_by(p, F.when(p.isNotNull(), F.col("rung_ord"))).alias("top"))
    year = F.substring("top", 1, 4) == F.substring("truth", 1, 4)
    rest = F.substring("top", 5, 20) == F.substring("truth", 5, 20)
    cls = F.when(F.col("d") == 0, "miss").when(F.col("top") == F.col("truth"), "right").when(F.col("d") > 1, "multi_wrong_pick").when(~year & rest, "year").when(year, "month_day").otherwise("single_wrong")
    return v.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


_READ = "contains(regexp_replace(text, '[^0-9]', '', 'g'), ty || tm || td)"


@query("o_e6", f"SELECT split, CASE WHEN {_READ} THEN 'miss_readable' WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 THEN 'miss_unreadable' ELSE 'no_digits' END AS class, count(*) AS n FROM texts GROUP BY ALL")
def o_e6(t: Tables):
    c = F.col("text")
    cls = F.when(F.contains(T.digits(c), F.concat("ty", "tm", "td")), "miss_readable").when(T.digit_rich(c), "miss_unreadable").otherwise("no_digits")
    return t.texts.groupBy("split", cls.alias("class")).agg(F.count("*").alias("n"))


@query("o_e7", r"SELECT variant, CASE WHEN trim(text) = '' THEN 'no_text' WHEN NOT regexp_matches(text, '[0-9]{2,4}\s*[.\-/년]\s*[0-9]{1,2}|[0-9]{6,8}') THEN 'no_date_shape' WHEN " + _READ + " THEN 'rule_unused' ELSE 'misread' END AS why, count(*) AS n FROM texts GROUP BY ALL")
def o_e7(t: Tables):
    c = F.col("text")
    why = F.when(F.trim(c) == "", "no_text").when(~T.dateish(c), "no_date_shape").when(F.contains(T.digits(c), F.concat("ty", "tm", "td")), "rule_unused").otherwise("misread")
    return t.texts.groupBy("variant", why.alias("why")).agg(F.count("*").alias("n"))


@query("o_e8", "SELECT why, count(*) AS n FROM (SELECT doc_id, CASE WHEN count(*) FILTER (WHERE pred <> 'NONE') = 0 THEN 'none' WHEN count(*) FILTER (WHERE pred = truth) > 0 AND min_by(pred, rung_ord) <> min(truth) THEN 'rule_picked_wrong' WHEN count(*) FILTER (WHERE pred = truth) = 0 THEN 'stage_could_not_read' ELSE 'right' END AS why FROM rungs GROUP BY doc_id) x GROUP BY why")
def o_e8(t: Tables):
    v = t.rungs.groupBy("doc_id").agg(F.count_if(F.col("pred") != "NONE").alias("f"), F.count_if(F.col("pred") == F.col("truth")).alias("r"), F.min_by("pred", "rung_ord").alias("p"), F.min("truth").alias("t"))
    why = F.when(F.col("f") == 0, "none").when((F.col("r") > 0) & (F.col("p") != F.col("t")), "rule_picked_wrong").when(F.col("r") == 0, "stage_could_not_read").otherwise("right")
    return v.groupBy(why.alias("why")).agg(F.count("*").alias("n"))


@query("o_e9", f"SELECT rung, count(*) AS n FROM {parts_sql('rungs')} s WHERE {_YD} AND t_y <> p_y GROUP BY rung")
def o_e9(t: Tables):
    return E.with_parts(t.rungs).filter(E._two_digit_swap("y", "d") & E._wrong("y")).groupBy("rung").agg(F.count("*").alias("n"))


@query("o_e10", "SELECT CASE WHEN n = 0 THEN 'E' WHEN n = 1 AND pos THEN 'A' WHEN n = 1 THEN 'B' WHEN pos THEN 'C' ELSE 'D' END AS grade, count(*) AS c FROM (SELECT doc_id, count(DISTINCT pred) FILTER (WHERE NOT contains(pred, 'NONE')) AS n, max(rung_ord) FILTER (WHERE pred = truth) >= 4 AS pos FROM rungs GROUP BY doc_id) x GROUP BY grade")
def o_e10(t: Tables):
    v = t.rungs.groupBy("doc_id").agg(F.count_distinct(F.when(C.is_full(F.col("pred")), F.col("pred"))).alias("n"), (F.max(F.when(F.col("pred") == F.col("truth"), F.col("rung_ord"))) >= 4).alias("pos"))
    g = F.when(F.col("n") == 0, "E").when((F.col("n") == 1) & F.col("pos"), "A").when(F.col("n") == 1, "B").when(F.col("pos"), "C").otherwise("D")
    return v.groupBy(g.alias("grade")).agg(F.count("*").alias("c"))


@query("o_e11", "SELECT priority, count(*) AS n FROM (SELECT doc_id, CASE WHEN count(DISTINCT pred) >= 4 THEN 0 WHEN count(DISTINCT pred) >= 2 THEN 1 ELSE 2 END AS priority FROM rungs GROUP BY doc_id) x GROUP BY priority")
def o_e11(t: Tables):
    d = F.col("d")
    return t.rungs.groupBy("doc_id").agg(F.count_distinct("pred").alias("d")).groupBy(F.when(d >= 4, 0).when(d >= 2, 1).otherwise(2).alias("priority")).agg(F.count("*").alias("n"))


@query("o_e12", r"SELECT variant, CASE WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) = 0 THEN 'none' WHEN NOT regexp_matches(text, '[0-9]{2,4}\s*[.\-/년]\s*[0-9]{1,2}|[0-9]{6,8}') THEN 'no_date_shape' ELSE 'rule' END AS cause, count(*) AS n FROM texts GROUP BY ALL")
def o_e12(t: Tables):
    c = F.col("text")
    return t.texts.groupBy("variant", F.when(F.length(T.digits(c)) == 0, "none").when(~T.dateish(c), "no_date_shape").otherwise("rule").alias("cause")).agg(F.count("*").alias("n"))


CASCADE = "SELECT {k}doc_id, coalesce(min_by(pred, ord) FILTER (WHERE NOT contains(pred, 'NONE')), min_by(pred, ord) FILTER (WHERE contains(pred, 'NONE') AND pred <> 'NONE'), 'NONE') AS pred, CASE WHEN min(ord) FILTER (WHERE NOT contains(pred, 'NONE')) IS NOT NULL THEN 'rung' || CAST(min(ord) FILTER (WHERE NOT contains(pred, 'NONE')) AS VARCHAR) WHEN count(*) FILTER (WHERE pred <> 'NONE') > 0 THEN 'partial' ELSE 'none' END AS stage, round(sum(sec) FILTER (WHERE ord <= coalesce(stop, last)), 6) AS sec FROM (SELECT *, min(CASE WHEN NOT contains(pred, 'NONE') THEN ord END) OVER (PARTITION BY {k}doc_id) AS stop, max(ord) OVER (PARTITION BY {k}doc_id) AS last FROM {s}) x GROUP BY {k}doc_id"
ONE = CASCADE.format(k="", s="(SELECT *, rung_ord AS ord FROM rungs)")


@query("o_c1", ONE)
def o_c1(t: Tables):
    return C.cascade(t.rungs, ["doc_id"])


@query("o_w7", f"SELECT doc_id, pred FROM ({ONE}) c")
def o_w7(t: Tables):
    return C.cascade(t.rungs, ["doc_id"]).select("doc_id", "pred")


@query("o_w8", f"SELECT doc_id, sec FROM ({ONE}) c")
def o_w8(t: Tables):
    return C.cascade(t.rungs, ["doc_id"]).select("doc_id", "sec")


@query("o_a37", f"SELECT stage, count(*) AS n FROM ({ONE}) c GROUP BY stage")
def o_a37(t: Tables):
    return C.cascade(t.rungs, ["doc_id"]).groupBy("stage").agg(F.count("*").alias("n"))


CONFIGS = {"forward": (1, 2, 3, 4), "backward": (4, 3, 2, 1), "short": (2, 5), "long": (8, 7, 6, 5, 1)}
_CFG = ", ".join(f"('{c}', {r}, {i})" for c, rs in CONFIGS.items() for i, r in enumerate(rs, 1))
SIM = CASCADE.format(k="config, ", s=f"(SELECT c.config, c.ord, r.* EXCLUDE (truth), r.truth AS truth FROM rungs r JOIN (VALUES {_CFG}) c(config, rung_ord, ord) USING (rung_ord))")


@query("o_c5", f"SELECT config, round(avg(sec), 6) AS mean_sec, count(*) FILTER (WHERE pred = truth) AS exact FROM ({SIM}) s JOIN (SELECT DISTINCT doc_id, truth FROM rungs) t USING (doc_id) GROUP BY config")
def o_c5(t: Tables):
    configs = t.spark.createDataFrame([(c, r, i) for c, rs in CONFIGS.items() for i, r in enumerate(rs, 1)], "config string, rung_ord int, ord int")
    runs = t.rungs.join(F.broadcast(configs), "rung_ord")  # a few rows that the caller gives
    out = C.cascade(runs, ["config", "doc_id", "truth"], "ord")
    return out.groupBy("config").agg(F.round(F.avg("sec"), 6).alias("mean_sec"), F.count_if(F.col("pred") == F.col("truth")).alias("exact"))


@query("o_c2", f"SELECT doc_id, CASE WHEN a = 'NONE' THEN b ELSE a END AS pred FROM {WIDE3} w")
def o_c2(t: Tables):
    return _wide(t).select("doc_id", F.when(C.is_none(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("pred"))


def _part(c: str, i: int) -> str:
    return f"CASE WHEN len(string_split({c}, '-')) = 3 THEN string_split({c}, '-')[{i}] ELSE 'NONE' END"


@query("o_c3", "SELECT doc_id, " + ", ".join(f"CASE WHEN {_part('a', i)} = 'NONE' THEN {_part('b', i)} ELSE {_part('a', i)} END AS {k}" for i, k in enumerate("ymd", 1)) + f" FROM {WIDE3} w")
def o_c3(t: Tables):
    w = _wide(t).select("doc_id", T.split3(F.col("a")).alias("a"), T.split3(F.col("b")).alias("b"))
    made = C.fill_fields({k: F.col(f"a.{k}") for k in "ymd"}, {k: F.col(f"b.{k}") for k in "ymd"})
    return w.select("doc_id", *[v.alias(k) for k, v in made.items()])


@query("o_c4", f"SELECT doc_id, CASE WHEN a = b THEN a ELSE 'NONE' END AS pred FROM {WIDE3} w")
def o_c4(t: Tables):
    return _wide(t).select("doc_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("NONE").alias("pred"))


@query("o_c9", "SELECT stage, cause, count(*) AS n FROM (SELECT CASE WHEN variant = 20 THEN 'lot' ELSE 'label' END AS stage, CASE WHEN trim(text) = '' THEN 'no_text' WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) = 0 THEN 'text_no_digits' WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) < 6 THEN 'digits_no_date' ELSE 'ok' END AS cause FROM texts) x GROUP BY ALL")
def o_c9(t: Tables):
    n = F.length(T.digits(F.col("text")))
    cause = F.when(F.trim("text") == "", "no_text").when(n == 0, "text_no_digits").when(n < 6, "digits_no_date").otherwise("ok")
    return t.texts.groupBy(F.when(F.col("variant") == 20, "lot").otherwise("label").alias("stage"), cause.alias("cause")).agg(F.count("*").alias("n"))


@query("o_a41", "SELECT rung_ord, n, CAST(sum(n) OVER (ORDER BY rung_ord) AS BIGINT) AS cumulative FROM (SELECT f AS rung_ord, count(*) AS n FROM (SELECT doc_id, min(rung_ord) AS f FROM rungs WHERE pred = truth GROUP BY doc_id) x GROUP BY f) y")
def o_a41(t: Tables):
    first = t.rungs.filter("pred = truth").groupBy("doc_id").agg(F.min("rung_ord").alias("rung_ord"))
    return first.groupBy("rung_ord").agg(F.count("*").alias("n")).withColumn("cumulative", F.sum("n").over(Window.orderBy("rung_ord")))


@query("o_a42", "SELECT rung, count(*) FILTER (WHERE pred = truth) AS ok, round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0 END), 6) AS rate, count(*) FILTER (WHERE pred = truth AND NOT base) AS fresh FROM (SELECT r.*, max(CASE WHEN rung_ord = 1 AND pred = truth THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 1 AS base FROM rungs r) x GROUP BY rung")
def o_a42(t: Tables):
    base = t.rungs.withColumn("base", F.max(F.when((F.col("rung_ord") == 1) & (F.col("pred") == F.col("truth")), 1).otherwise(0)).over(Window.partitionBy("doc_id")))
    ok = F.col("pred") == F.col("truth")
    return base.groupBy("rung").agg(F.count_if(ok).alias("ok"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("rate"), F.count_if(ok & (F.col("base") == 0)).alias("fresh"))


@query("o_a43", "SELECT split, " + ", ".join(f"count(*) FILTER (WHERE rung_ord = {r} AND pred = truth) AS r{r}" for r in range(1, 9)) + ", count(*) FILTER (WHERE rung_ord = 8 AND pred = truth AND good = 1) AS only_r8 FROM (SELECT *, count(*) FILTER (WHERE pred = truth) OVER (PARTITION BY doc_id) AS good FROM rungs) x GROUP BY split")
def o_a43(t: Tables):
    ok = F.col("pred") == F.col("truth")
    g = t.rungs.withColumn("good", F.count_if(ok).over(Window.partitionBy("doc_id")))
    return g.groupBy("split").agg(*[F.count_if(ok & (F.col("rung_ord") == r)).alias(f"r{r}") for r in range(1, 9)], F.count_if(ok & (F.col("rung_ord") == 8) & (F.col("good") == 1)).alias("only_r8"))


@query("o_a34", "SELECT rule, count(*) FILTER (WHERE v = truth) AS hit, count(*) FILTER (WHERE v <> truth) AS miss, count(*) FILTER (WHERE v IS NULL) AS abstain FROM (SELECT truth, unnest(['first', 'second', 'agree']) AS rule, unnest([a, b, CASE WHEN a = b THEN a END]) AS v FROM " + WIDE3 + " w) x GROUP BY rule")
def o_a34(t: Tables):
    w = _wide(t).selectExpr("truth", "stack(3, 'first', a, 'second', b, 'agree', case when a = b then a end) as (rule, v)")
    return w.groupBy("rule").agg(F.count_if(F.col("v") == F.col("truth")).alias("hit"), F.count_if(F.col("v") != F.col("truth")).alias("miss"), F.count_if(F.col("v").isNull()).alias("abstain"))


@query("o_d33", f"SELECT diff, count(*) AS n FROM (SELECT TRY_CAST(p_y AS INTEGER) - TRY_CAST(t_y AS INTEGER) AS diff FROM {parts_sql('rungs')} s) x GROUP BY diff")
def o_d33(t: Tables):
    p = E.with_parts(t.rungs)
    return p.groupBy((F.col("p_y").try_cast("int") - F.col("t_y").try_cast("int")).alias("diff")).agg(F.count("*").alias("n"))


@query("o_d34", "SELECT rung, count(*) FILTER (WHERE TRY_CAST(pred AS DATE) < TRY_CAST(truth AS DATE)) AS earlier FROM rungs GROUP BY rung")
def o_d34(t: Tables):
    return t.rungs.groupBy("rung").agg(F.count_if(F.expr("try_to_date(pred) < try_to_date(truth)")).alias("earlier"))


_FOUND = "SELECT split, ty || '-' || tm || '-' || td AS truth, coalesce(f.dt, p.y || '-' || p.m || '-' || p.d, 'NONE') AS pred FROM truths JOIN full_dates f USING (doc_id) LEFT JOIN part_dates p USING (doc_id)"


@query("flagship_extract_score", f"WITH full_dates AS ({FULL_DATES}), part_dates AS ({PARTIAL_DATES}), found AS ({_FOUND}) {score_sql('found', 'split')}")
def flagship(t: Tables):
    """Extraction of one date a document from its fragments, scored by split."""
    return E.field_score(D.extract(t.fragments).join(t.truths, "doc_id").select("split", F.concat_ws("-", "ty", "tm", "td").alias("truth"), F.col("final_date").alias("pred")), "split")
