"""Cascades over rungs: the first full reading wins, else the first partial one; and what a run of rungs costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_full(c: Column) -> Column:
    return ~F.contains(c, F.lit("NONE"))


def is_none(c: Column) -> Column:
    return c.isNull() | c.isin("NONE", "NONE-NONE-NONE")


def cascade(rungs: DataFrame, by: list[str], order: str = "rung_ord", pred: str = "pred", sec: str = "sec") -> DataFrame:
    """Per key the chosen reading, the rung it stopped at, its stage and the seconds up to that rung.

    One aggregation: map-side partial, a key's rungs are few and fixed in number."""
    p = F.col(pred)
    full = F.min(F.when(is_full(p), F.col(order)))
    first_full = F.min_by(F.when(is_full(p), p), F.when(is_full(p), F.col(order)))
    partial = ~is_full(p) & ~is_none(p)
    first_part = F.min_by(F.when(partial, p), F.when(partial, F.col(order)))
    agg = rungs.groupBy(*by).agg(full.alias("stop"), first_full.alias("f"), first_part.alias("q"), F.max(order).alias("last"), F.collect_list(F.struct(order, sec)).alias("costs"))
    spent = F.aggregate(F.array_sort(F.filter("costs", lambda x: x[order] <= F.coalesce(F.col("stop"), F.col("last")))), F.lit(0.0), lambda a, x: a + x[sec])
    stage = F.when(F.col("stop").isNotNull(), F.concat(F.lit("rung"), F.col("stop").cast("string"))).when(F.col("q").isNotNull(), "partial").otherwise("none")
    return agg.select(*by, F.coalesce("f", "q", F.lit("NONE")).alias("pred"), stage.alias("stage"), F.round(spent, 6).alias("sec"))


def offered(rungs: DataFrame, rejected: set[str], asked: tuple[str, ...] = (), rung: str = "rung") -> DataFrame:
    """The rungs that a cascade climbs: rejected ones stay known but are off unless they are asked for by name."""
    off = sorted(rejected - set(asked))
    return rungs.filter(~F.col(rung).isin(off)) if off else rungs


def staged(todo: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: str, result: str, cut: Callable[[DataFrame, str], DataFrame] = lambda d, n: d) -> DataFrame:
    """Costly stages one after the other, each only on rows that none before resolved (non-null ``result``).

    Spark runs a Python function in a CASE for every row, so the filter has to come first. ``cut`` may write each
    stage's result, so that a later one doesn't run it again."""
    done = None
    for name, stage in stages:
        out = cut(stage(todo), name)
        hit = out.filter(F.col(result).isNotNull()).withColumn("stage", F.lit(name))
        done = hit if done is None else done.unionByName(hit)
        todo = out.filter(F.col(result).isNull()).drop(result)
    return done.unionByName(todo.withColumn(result, F.lit(None).cast(done.schema[result].dataType)).withColumn("stage", F.lit("none")))


def fill_fields(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Per part: the first reading's, or the second's where that is NONE."""
    return {k: F.when(a[k] == "NONE", b[k]).otherwise(a[k]) for k in a}
