"""Scoring, tests and taxonomies over (truth, pred) triples, as aggregates and CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

PARTS = ("y", "m", "d")


def with_parts(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Adds t_y..t_d, p_y..p_d (NONE where missing) and hits, the number of equal parts; NONE equals NONE."""
    out = df.withColumn("__t", T.split3(F.col(truth))).withColumn("__p", T.split3(F.col(pred)))
    out = out.select("*", *[F.col(f"__{s}.{c}").alias(f"{s}_{c}") for s in "tp" for c in PARTS]).drop("__t", "__p")
    return out.withColumn("hits", sum((hit(c) for c in PARTS), F.lit(0)))


def hit(c: str) -> Column:
    return F.when(F.col(f"t_{c}") == F.col(f"p_{c}"), 1).otherwise(0)


def missing(side: str) -> Column:
    return (F.col(f"{side}_y") == "NONE") & (F.col(f"{side}_m") == "NONE") & (F.col(f"{side}_d") == "NONE")


def filled(side: str) -> Column:
    return sum((F.when(F.col(f"{side}_{c}") != "NONE", 1).otherwise(0) for c in PARTS), F.lit(0))


def field_score(df: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, hits of each part, share of parts right, exact rows, misses, false positives, share filled."""
    p = with_parts(df)
    n = F.count("*")
    return p.groupBy(*by).agg(
        n.alias("n"), *[F.sum(hit(c)).alias(f"{w}_hits") for c, w in zip(PARTS, ("year", "month", "day"), strict=True)],
        F.round(F.sum("hits") / (3 * n), 6).alias("score"), F.count_if(F.col("hits") == 3).alias("exact"),
        F.count_if(missing("p") & ~missing("t")).alias("miss"), F.count_if(missing("t") & ~missing("p")).alias("false_positive"), F.round(F.sum(filled("p")) / (3 * n), 6).alias("fill"),
    )


def binomial_two_sided(up: Column, down: Column) -> Column:
    """Exact two-sided test of an even split: min(1, 2 * P(X <= min)); 1 where there is nothing to split."""
    n, k = (up + down).cast("double"), F.least(up, down)
    step = lambda a, i: F.struct((a["s"] + F.exp(a["c"] - n * F.lit(0.6931471805599453))).alias("s"), (a["c"] + F.log(F.greatest(n - i, F.lit(1e-300))) - F.log(i + 1.0)).alias("c"))
    tail = F.aggregate(F.sequence(F.lit(0), k), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame, old: str, new: str, *by: str) -> DataFrame:
    """Rows on which ``new`` has more or fewer hits than ``old``, and the exact test."""
    c = pairs.groupBy(*by).agg(F.count_if(F.col(new) > F.col(old)).alias("up"), F.count_if(F.col(new) < F.col(old)).alias("down"))
    return c.withColumn("p_value", F.round(binomial_two_sided(F.col("up"), F.col("down")), 6))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share, within 0 and 1; (0, 0) of nothing."""
    p = k / n
    mid, half, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (mid - half) / below)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), (mid + half) / below))


def _swap(a: str, b: str) -> Column:
    return (F.col(f"t_{a}") == F.col(f"p_{b}")) & (F.col(f"t_{b}") == F.col(f"p_{a}"))


def _full(side: str) -> Column:
    return filled(side) == 3


def _cases(*pairs, other: str) -> Column:
    out = None
    for cond, name in pairs:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(other)


def _wrong(c: str) -> Column:
    return F.col(f"t_{c}") != F.col(f"p_{c}")


def _two_digit_swap(a: str, b: str) -> Column:
    return (F.substring(f"t_{a}", 3, 2) == F.col(f"p_{b}")) & (F.col(f"t_{b}") == F.substring(f"p_{a}", 3, 2))


#: Taxonomies of (truth, pred) after with_parts; the order of the tests counts.
TAXONOMIES = {
    "o_e1": lambda: _cases((F.col("hits") == 3, "right"), (missing("p"), "A_miss"), (missing("t"), "F_false_positive"), ((filled("t") < 3) | (filled("p") < 3), "E_partial"), (_wrong("y") & ~_wrong("m") & ~_wrong("d"), "B_year"), (~_wrong("y"), "C_month_day"), other="D_different"),
    "o_e2": lambda: _cases((F.col("hits") == 3, "right"), (missing("p"), "miss"), (missing("t"), "fp"), (filled("p") < filled("t"), "partial_short"), (filled("p") > filled("t"), "partial_over"), (_wrong("y") & ~_wrong("m") & ~_wrong("d"), "year_only"), (~_wrong("y"), "md_only"), (F.expr("try_to_date(pred) < try_to_date(truth)"), "mfg_picked"), other="other"),
    "o_e3": lambda: _cases((F.col("hits") == 3, "right"), (missing("p"), "miss"), (missing("t"), "fp"), (_wrong("y") & ~_wrong("m") & ~_wrong("d"), "year"), (~_wrong("y") & _swap("m", "d"), "month_day_swap"), (_two_digit_swap("y", "d"), "year_day_swap"), (F.col("hits") == 2, "one_field"), (filled("p") < 3, "partly_read"), other="all_differ"),
    "o_e4": lambda: _cases((F.col("hits") == 3, "right"), (missing("p"), "miss"), (missing("t"), "fp"), (~_wrong("m") & _two_digit_swap("y", "d"), "year_day_swap"), (~_wrong("y") & _swap("m", "d"), "month_day_swap"), (F.col("hits") == 2, "one_field"), other="all_differ"),
    "o_e13": lambda: _cases((F.col("hits") > F.col("base_hits"), "improved"), (F.col("hits") < F.col("base_hits"), "worse"), other="same"),
}


def taxonomy(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Rows, lost parts, share of all lost parts and points of accuracy of each class."""
    p = df if "hits" in df.columns else with_parts(df)
    c = p.withColumn("class", TAXONOMIES[name]()).groupBy(*by, "class").agg(F.count("*").alias("n"), F.sum(3 - F.col("hits")).alias("lost"))
    return c


def majority(votes: DataFrame, key: str = "doc_id", value: str = "pred", order: str = "rung_ord") -> DataFrame:
    """The most common value of each key; of those as common the one that came first."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max(F.struct(F.col("votes"), (-F.col("first")).alias("f"), F.col(value))).alias("b")).select(key, F.col(f"b.{value}").alias(value), F.col("b.votes").alias("votes"))


def best_of(votes: DataFrame, key: str = "doc_id", value: str = "pred", order: str = "rung_ord") -> DataFrame:
    """The oracle: of each key the value with the most hits, the first of those."""
    p = votes if "hits" in votes.columns else with_parts(votes)
    return p.groupBy(key).agg(F.max_by(value, F.struct(F.col("hits"), -F.col(order))).alias(value), F.max("hits").alias("hits"))
