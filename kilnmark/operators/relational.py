"""Profiling, joins, windows, samples and checks as functions of DataFrames and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def clean(c: Column) -> Column:
    """Control characters dropped, blanks trimmed, nothing left as null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"[\x00-\x08\x0A-\x1F]", "")), F.lit(""))


def oriented(w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    turned = orientation.isin(5, 6, 7, 8)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def missing_ids(df: DataFrame, key: str) -> DataFrame:
    """Numbers from 1 to the largest id that no row has."""
    last = df.agg(F.max(key).alias("m")).first()["m"] or 0
    every = df.sparkSession.range(1, last + 1).select(F.col("id").alias("missing"))
    return every.join(df.select(F.col(key).alias("missing")), "missing", "left_anti")


def repair_join(left: DataFrame, key: str, right: DataFrame, name: str) -> DataFrame:
    """Files by exact name, or else by stem: ok, fixed or unresolved."""
    a = left.withColumn("__s", stem(F.col(key)))
    b = right.groupBy(stem(F.col(name)).alias("__s")).agg(F.collect_set(name).alias("__f"))
    j = a.join(b, "__s", "left")
    exact = F.coalesce(F.array_contains("__f", F.col(key)), F.lit(False))
    file = F.when(exact, F.col(key)).otherwise(F.array_min("__f"))
    return j.select(key, F.when(exact, "ok").when(F.col("__f").isNotNull(), "fixed").otherwise("unresolved").alias("state"), file.alias("file"))


def overlaps(spans: DataFrame, key: str, pos: str, start: str, end: str) -> DataFrame:
    """Pairs of spans of one key that overlap: an equi-join on the key with a range condition."""
    a, b = spans.alias("a"), spans.alias("b")
    cond = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{pos}") < F.col(f"b.{pos}")) & (F.col(f"a.{start}") < F.col(f"b.{end}")) & (F.col(f"b.{start}") < F.col(f"a.{end}"))
    return a.join(b, cond).select(f"a.{key}", F.col(f"a.{pos}").alias("pa"), F.col(f"b.{pos}").alias("pb"))


def combinations(settings: DataFrame, order: str, name: str, k: int) -> DataFrame:
    """All k-subsets of a few settings."""
    names = "abcdefgh"[:k]
    cols = [settings.select(F.col(order).alias(f"__{x}"), F.col(name).alias(x)) for x in names]
    out = reduce(lambda acc, x: acc.join(F.broadcast(x[1]), F.col(f"__{names[x[0]]}") < F.col(f"__{names[x[0] + 1]}")), enumerate(cols[1:]), cols[0])  # settings are few
    return out.select(*names)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win over old ones of their key."""
    return old.join(new, key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def reconcile(tasks: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Keys that are extra, missing or given twice."""
    b = given.groupBy(key).agg(F.count("*").alias("n"))
    j = tasks.withColumn("__t", F.lit(True)).join(b, key, "full")
    return j.select(key, F.col("__t").isNull().alias("extra"), F.col("n").isNull().alias("missing"), (F.coalesce("n", F.lit(0)) > 1).alias("duplicate"))


def floor_quantile(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """The value at floor(n * p) of each key in order: by rank, so that no group is gathered."""
    w = Window.partitionBy(key)
    x = df.select(key, value, (F.row_number().over(w.orderBy(value)) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return x.filter(F.col("r") == F.floor(F.col("n") * p)).select(key, F.col(value).alias("q"))


def right_closed_bin(c: Column, edges) -> Column:
    out = None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        name = f"({a},{b}]"
        out = F.when((c > a) & (c <= b), name) if out is None else out.when((c > a) & (c <= b), name)
    return out


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key comes more than once; counts are pre-aggregated, so a key with many rows is split by the join."""
    twice = df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).select(key)
    return df.join(twice, key, "left_semi")


BRANCHES = {
    "ymd": r"(?<!\d)20\d{2}[.\-/]\d{2}[.\-/]\d{2}(?!\d)",
    "dmy": r"(?<!\d)\d{2}[.\-/]\d{2}[.\-/]20\d{2}(?!\d)",
    "my": r"(?<!\d)\d{2}[.\-/]20\d{2}(?!\d)",
}


def branches(df: DataFrame, key: str, c: Column) -> DataFrame:
    """One row for each pattern that a text matches."""
    hits = F.array_compact(F.array(*[F.when(c.rlike(p), n) for n, p in BRANCHES.items()]))
    return df.select(key, F.explode(hits).alias("branch"))


def top_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def keep_share(df: DataFrame, by: str, order: list, share: float, least: int) -> DataFrame:
    """The first round-half-even(n * share) rows of each key, ``least`` or all of fewer at least."""
    w = Window.partitionBy(by)
    x = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    keep = (F.col("__n") <= least) | (F.col("__r") <= F.greatest(F.lit(least), F.bround(F.col("__n") * share, 0).cast("int")))
    return x.filter(keep).drop("__r", "__n")


#: Cuts at quantiles by which a column's order is first looked at; then only the rows between two of them.
CUTS = 200


def _cuts(df: DataFrame, value: str) -> list[float]:
    """Estimated quantiles; the summaries merge, so no task sees all values."""
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / CUTS for i in range(1, CUTS)], 20 * CUTS).alias("q")).first()["q"]
    return sorted(set(found or []))


def _part(value: str, cuts: list[float]) -> Column:
    """The number of cuts that a value is above."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda q: q < F.col(value))) if cuts else F.lit(0)


def exact_quantile(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row with the exact quantile of a column, between neighbours by their distance; null without values.

    Estimated cuts and the counts between them tell which part holds the ranks; only that part is sorted, by shuffle,
    and two of its rows are taken."""
    df = df.select(F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull())
    cuts = _cuts(df, value)
    sizes = {r["p"]: r["n"] for r in df.groupBy(_part(value, cuts).alias("p")).agg(F.count("*").alias("n")).collect()}  # CUTS rows
    n = sum(sizes.values())
    if not n:
        return df.agg(F.max(value).alias(value))
    at = (n - 1) * share

    def ranked(k: int) -> float:
        before = 0
        for p in sorted(sizes):
            if before + sizes[p] > k:
                return df.filter(_part(value, cuts) == p).orderBy(value).offset(k - before).limit(1).first()[value]
            before += sizes[p]
        raise IndexError(k)

    low = ranked(int(at))
    high = ranked(int(at) + 1) if at > int(at) else low
    return df.sparkSession.range(1).select(F.lit(low + (high - low) * (at - int(at))).alias(value))


def rows_for_share(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: how many of the largest rows hold a share of the total.

    Sums between estimated cuts tell where the share is reached; only the values between two cuts are added up one by
    one, each distinct value once."""
    cuts = _cuts(df, value)
    sums = df.groupBy(_part(value, cuts).alias("p")).agg(F.sum(value).alias("s"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()  # CUTS rows
    total, before, rows, part = sum(r["s"] or 0 for r in sums), 0.0, 0, 0
    for r in sums:
        part = r["p"]
        if before + (r["s"] or 0) >= share * total:
            break
        before, rows = before + (r["s"] or 0), rows + r["n"]
    per = df.filter(_part(value, cuts) == part).groupBy(value).agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    w = Window.orderBy(F.desc(value))  # the values of one part
    sofar = w.rowsBetween(Window.unboundedPreceding, -1)
    run = per.select(value, "c", "s", (F.coalesce(F.sum("s").over(sofar), F.lit(0.0)) + before).alias("before"), (F.coalesce(F.sum("c").over(sofar), F.lit(0)) + rows).alias("rows"), F.lit(total).alias("t"))
    run = run.filter((F.col("before") < share * F.col("t")) & (F.col("before") + F.col("s") >= share * F.col("t")))
    need = F.greatest(F.lit(1), F.ceil(F.round((share * F.col("t") - F.col("before")) / F.col(value), 9)))
    return run.agg(F.min(F.col("rows") + need).alias("needed"))


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def stratified(df: DataFrame, by: list[str], key: str, share: float, seed: str, least: int = 1) -> DataFrame:
    return keep_rows(df, by, hash_order(key, seed), share, least)


def keep_rows(df: DataFrame, by: list[str], order: Column, share: float, least: int) -> DataFrame:
    w = Window.partitionBy(*by)
    x = df.withColumn("__r", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    return x.filter(F.col("__r") <= F.greatest(F.lit(least), F.bround(F.col("__n") * share, 0).cast("int"))).drop("__r", "__n")


def hash_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in an order that a seed fixes: a top-k, no full sort."""
    return df.orderBy(hash_order(key, seed)).limit(n)


def fold(key: Column, k: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long") % k


def unseen(pool: DataFrame, seen: list[DataFrame], key: str) -> DataFrame:
    """Rows of the pool that none of the others has."""
    return pool.join(reduce(DataFrame.unionByName, seen), key, "left_anti")


def contract(df: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """(rule, n): violations of each rule."""
    sums = df.agg((F.count("*") - F.count_distinct(key)).alias("unique_id"), *[F.count_if(~F.col(c).rlike(p)).alias(c) for c, p in patterns.items()])
    names = ["unique_id", *patterns]
    return sums.selectExpr(f"stack({len(names)}, " + ", ".join(f"'{n}', {n}" for n in names) + ") as (rule, n)")


def label_problems(tasks: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Counts of duplicate, missing and ill-formed labels, of which a build accepts none."""
    per = labels.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~F.col("label").rlike(r"^(NONE|(\d{4}|NONE)-(\d{2}|NONE)-(\d{2}|NONE))$")).alias("bad"))
    j = tasks.withColumn("__t", F.lit(True)).join(per, key, "full")
    return j.agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("n").isNull()).alias("missing"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_format"))


def norm2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    n = norm2(v)
    return F.transform(v, lambda x: x.cast("double") / n)


def linear_score(x: Column, weights, bias: float, logs=()) -> Column:
    """Bias and weighted sum; the features numbered in ``logs`` as log1p of what is above zero."""
    out = F.lit(float(bias))
    for i, w in enumerate(weights):
        v = F.get(x, i)
        out = out + float(w) * (F.log1p(F.greatest(F.lit(0.0), v)) if i in logs else v)
    return out


def fold_scaler(weights, bias: float, means, deviations) -> tuple[list[float], float]:
    """Weights and bias that take unscaled features."""
    w = [a / s for a, s in zip(weights, deviations, strict=True)]
    return w, bias - sum(a * m for a, m in zip(w, means, strict=True))


def bands(df: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """Runs of neighbouring rows with the flag: first, last and number."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False)), 1).otherwise(0)
    x = df.withColumn("__new", new).withColumn("__band", F.sum("__new").over(w)).filter(F.col(flag))
    return x.groupBy(key, "__band").agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).drop("__band")
