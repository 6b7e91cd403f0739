"""Dates in label text: a table of patterns, and the rules that choose among what they find.

Everything is a column expression. Patterns are data, so that each becomes one ``regexp_extract_all`` per group; a
match that is no calendar date or lies outside the plausible years is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .spans import once

FIRST_YEAR, LAST_YEAR = 2015, 2035
_MON = "(" + "|".join(T.MONTHS) + ")"
# The shapes of dates and which group is (year, month, day); a two-digit year is of this century.
PATTERNS = {
    "a": (r"(?<!\d)(20\d{2})[.\-/\s]+(\d{1,2})[.\-/\s]+(\d{1,2})(?!\d)(?!\s*:\s*\d)", (1, 2, 3)),
    "a1": (r"(?<!\d)(20\d{2})\s*[.\-/]\s*(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    "a2": (r"(?<!\d)(20\d{2})(\d{2})\s*[.\-/]\s*(\d{1,2})(?!\d)", (1, 2, 3)),
    "b": (r"(?<!\d)(\d{1,2})\s*[.\-/]+\s*(\d{1,2})\s*[.\-/]+\s*(20\d{2})(?!\d)", (3, 2, 1)),
    "b2": (r"(?<!\d)(\d{1,2})\s+(\d{1,2})\s+(20\d{2})(?!\d)", (3, 2, 1)),
    "c": (rf"(20\d{{2}})[.\-/\s]+{_MON}[.\-/\s]+(\d{{1,2}})", (1, 2, 3)),
    "d": (rf"{_MON}[\s.\-/]+(\d{{1,2}})[\s,.\-/]+(20\d{{2}})", (3, 1, 2)),
    "e": (rf"(?<!\d)(\d{{1,2}})[\s.\-/]*{_MON}[\s.\-/]*(\d{{2}})(?!\d)", (3, 2, 1)),
    "e2": (rf"(?<!\d)(\d{{1,2}})[\s.\-/]*{_MON}[\s.\-/,]*(20\d{{2}})(?!\d)", (3, 2, 1)),
    "e3": (rf"{_MON}[\s.\-/]*(\d{{1,2}})[\s,.\-/]+(\d{{2}})(?!\d)", (3, 1, 2)),
    "f": (r"(?<!\d)(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{2})(?!\d)", (1, 2, 3)),
    "g": (r"(?<!\d)(\d{1,2})\s+(\d{1,2})\s+(\d{2})(?!\d)", (3, 2, 1)),
    "h8": (r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    "h9": (r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
}
# Words around a date that speak for it or against it, for each family of patterns.
CONTEXT = ("EXP", "EXPIRY", "BEST", "USE BY", "BB", "소비기한", "유통기한")
COMPACT_FOR = ("EXP", "EXPIRY", "EXP DATE", "BEST", "BEST BEFORE", "BEST BY", "USE BY", "BB", "소비기한", "유통기한", "까지")
COMPACT_AGAINST = ("제조일", "제조일자", "생산일", "생산일자", "포장일", "MFG", "PROD", "PRODUCTION", "PACK", "PD:", "P.D.", "LOT", "LOTTO")
PARTIAL_FOR = ("소비기한", "유통기한", "EXPIRY", "EXP DATE", "BEST BEFORE", "BEST BY", "BEST IF USED BY", "USE BY", "EXP", "BB", "까지")
# The shapes of dates without a year, or without a day.
PARTIAL = {
    "my": r"(?<!\d)(\d{1,2})[.\-/](20\d{2})(?!\d)",
    "my2": r"(?<!\d)(\d{1,2})\s*[.\-/]\s*(\d{2})(?!\d)",
    "m_y": r"(?<!\d)(\d{1,2})\s+(20\d{2})(?!\d)",
    "md": r"(?<!\d)(\d{1,2})\s*[.\-/]\s*(\d{1,2})(?!\d)",
    "md2": r"(?<!\d)(\d{2})\s*[.\-/]\s*(\d{2})(?!\d)",
}


def make_date(y: Column, m: Column, d: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """Date of three integers; null if it isn't one or its year is outside."""
    y = F.when(y < 100, y + 2000).otherwise(y)
    stamp = F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))
    return F.when(y.between(first, last), stamp.cast("date"))


def matches(c: Column, name: str) -> Column:
    """Array of the dates that one pattern finds in prepared (upper-case, repaired) text.

    The text is searched once; groups are read from the few matches."""
    pattern, (y, m, d) = PATTERNS[name]
    p = "(?U)" + pattern
    named = _MON in pattern

    def dated(x):
        text = lambda g: F.regexp_extract(x, p, g)
        part = lambda g: text(g).try_cast("int")
        if name == "f":  # two two-digit years are possible: the first order that is a date
            return F.coalesce(make_date(part(1), part(2), part(3)), make_date(part(3), part(2), part(1)))
        return make_date(part(y), T.month_number(text(m)) if named else part(m), part(d))

    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), dated), lambda x: x.isNotNull())


def prepared(c: Column) -> Column:
    return T.repair_digit(F.upper(c))


def gate(name: str, c: Column) -> Column:
    """Whether a pattern is tried on a text at all."""
    if name == "g":
        return T.any_of(c, CONTEXT)
    if name in ("h8", "h9"):
        return (T.any_of(c, COMPACT_FOR) | c.rlike(r"^\s*(20\d{6}|\d{6})\s*$")) & ~T.any_of(c, COMPACT_AGAINST)
    return F.lit(True)


def extract_prepared(t: Column) -> Column:
    """All dates of all patterns in prepared text.

    One without a digit isn't searched; patterns of a four-digit year or of a month's name only where there is one."""
    none = F.array().cast("array<date>")
    open_ = [n for n in PATTERNS if n not in ("g", "h8", "h9")]
    named = [n for n in open_ if _MON in PATTERNS[n][0]]
    yearly = [n for n in open_ if "20" in PATTERNS[n][0] and n not in named]
    rest = [n for n in open_ if n not in named and n not in yearly]
    year, month = t.rlike(r"(?U)20\d{2}"), t.rlike(_MON)
    found = lambda names: [matches(t, n) for n in names]
    compact = F.concat(F.when(year, matches(t, "h8")).otherwise(none), matches(t, "h9"))
    every = F.concat(
        F.when(year, F.concat(*found(yearly))).otherwise(none),
        F.when(month, F.concat(*found(named))).otherwise(none),
        *found(rest),
        F.when(gate("g", t), matches(t, "g")).otherwise(none),
        F.when(t.rlike(r"(?U)\d{6}"), F.when(gate("h8", t), compact).otherwise(none)).otherwise(none),
    )
    return F.when(t.rlike("[0-9]"), every).otherwise(none)


def extract_dates(c: Column) -> Column:
    """All dates of all patterns in a text; a null has none."""
    return once(prepared(F.coalesce(c, F.lit(""))), extract_prepared)


def with_ngrams(fragments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidate texts of each document: every non-blank fragment, and it with the next one and the next two.

    One shuffle on the key; a document's fragments are its own, not the corpus's, so the array is small. The shuffle
    keeps its full number of partitions, as the patterns that follow cost far more than their few bytes suggest."""
    wide = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fragments.select(key, "pos", "text").filter("trim(text) <> ''").repartition(wide, key)
    lists = dealt.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.trim(x["text"])).alias("t"))
    grams = F.transform(F.col("t"), lambda x, i: F.array_compact(F.array(x, F.when(i + 1 < F.size("t"), F.concat(x, F.lit(" "), F.get("t", i + 1))), F.when(i + 2 < F.size("t"), F.concat(x, F.lit(" "), F.get("t", i + 1), F.lit(" "), F.get("t", i + 2))))))
    return lists.select(key, F.flatten(grams).alias("grams"))


def choose_date(grams: Column) -> Column:
    """The latest date of the best-scored candidate text; null if none or its score is negative."""
    # of one text the latest date is enough, for all of them have its score; texts without any aren't scored
    dated = F.transform(grams, lambda g: F.struct(g.alias("g"), F.array_max(extract_dates(g)).alias("dt")))
    scored = F.transform(F.filter(dated, lambda r: r["dt"].isNotNull()), lambda r: F.struct(once(F.upper(r["g"]), lambda up: T.keyword_score(r["g"], up)).alias("score"), r["dt"].alias("dt")))
    return once(F.array_max(scored), lambda best: F.when(best["score"] >= 0, best["dt"]))


def partials(g: Column) -> Column:
    """Scored partial dates of one candidate text, in the order in which they are tried."""
    kinds = lambda up: F.struct(up.alias("up"), T.any_of(up, PARTIAL_FOR).alias("positive"), T.any_of(up, T.AGAINST).alias("negative"))
    return once(F.upper(g), lambda up: once(kinds(up), lambda k: _partials(g, k["up"], k["positive"], k["negative"])))


def _partials(g: Column, up: Column, positive: Column, negative: Column) -> Column:
    score = F.when(positive, 10).otherwise(0) + F.when(F.contains(g, F.lit("까지")), 5).otherwise(0)
    pair = lambda n: F.arrays_zip(F.regexp_extract_all(up, F.lit("(?U)" + PARTIAL[n]), F.lit(1)).alias("0"), F.regexp_extract_all(up, F.lit("(?U)" + PARTIAL[n]), F.lit(2)).alias("1"))
    two = lambda x: F.lpad(x, 2, "0")
    none = F.lit("NONE")

    def row(s, y, m, d):
        return F.struct(s.cast("int").alias("score"), y.alias("y"), m.alias("m"), d.alias("d"))

    def my(n, extra=0):
        year = lambda x: F.when(F.length(x["1"]) == 2, F.concat(F.lit("20"), x["1"])).otherwise(x["1"])
        ok = lambda x: year(x).between(str(FIRST_YEAR), str(LAST_YEAR)) & two(x["0"]).between("01", "12")
        return F.transform(F.filter(pair(n), ok), lambda x: row(score + extra, year(x), two(x["0"]), none))

    empty = F.array().cast("array<struct<score:int,y:string,m:string,d:string>>")
    # any year that a full date check would take: a leap one
    ok_md = lambda x: make_date(F.lit(2024), x["0"].cast("int"), x["1"].cast("int")).isNotNull()
    md = lambda n: F.transform(F.filter(pair(n), ok_md), lambda x: row(score, none, two(x["0"]), two(x["1"])))
    every = F.concat(my("my"), F.when(positive, my("my2", 2)).otherwise(empty), my("m_y"), F.when(positive, md("md")).otherwise(md("md2")))
    return F.when(negative | ~up.rlike(r"(?U)\d"), empty).otherwise(every)


def choose_partial(grams: Column) -> Column:
    """The best-scored partial date, the first found of those as good; null if none."""
    every = F.flatten(F.transform(grams, partials))
    ranked = F.transform(every, lambda x, i: F.struct(x["score"].alias("score"), (-i).alias("first"), x["y"].alias("y"), x["m"].alias("m"), x["d"].alias("d")))
    return F.array_max(ranked)


def extract(fragments: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: year, month, day and final_date, from a full date or else a partial one."""
    grams = with_ngrams(fragments, key).withColumn("full", choose_date(F.col("grams"))).withColumn("part", F.when(F.col("full").isNull(), choose_partial(F.col("grams"))))
    pick = lambda fmt, p: F.coalesce(F.date_format("full", fmt), F.nullif(F.col(f"part.{p}"), F.lit("NONE")))
    out = grams.select(key, pick("yyyy", "y").alias("year"), pick("MM", "m").alias("month"), pick("dd", "d").alias("day"))
    return out.withColumn("final_date", T.final_date(F.col("year"), F.col("month"), F.col("day"))).fillna("NONE", ["year", "month", "day"])
