"""The second family of date rules: ordered patterns that claim their place in the text, and a choice among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .dates import make_date
from .spans import find_spans, first_claims, inside, once

# The shapes in order of precedence; Y is a year of 1900 to 2049.
_S, _Y, _M, _D = r"[^\d\n]{0,2}", r"(19\d{2}|20[0-4]\d)", r"(1[0-2]|0[1-9])", r"(3[01]|[12]\d|0[1-9])"
_D1, _M1 = r"(3[01]|[12]\d|0?[1-9])", r"(1[0-2]|[1-9])"
PATTERNS = (
    ("Y4_sep", rf"(?<!\d){_Y}{_S}{_M}{_S}{_D}(?!\d)"),
    ("Y4_sep1", rf"(?<!\d){_Y}\s*[.\-/년]\s*{_M1}\s*[.\-/월]\s*(3[01]|[12]\d|[1-9])\s*일?(?!\d)"),
    ("Y2_sep", rf"(?<!\d)([0-4]\d){_S}{_M}{_S}{_D}(?!\d)"),
    ("D_MON_Y", rf"(?<!\d){_D1}[^\dA-Za-z]{{0,2}}([A-Za-z0-9]{{2,5}})[^\dA-Za-z]{{0,2}}{_Y}(?!\d)"),
    ("MON_D_Y", rf"(?<![A-Za-z])([A-Za-z]{{3,4}})[^\dA-Za-z]{{0,2}}{_D1}[^\dA-Za-z]{{0,2}}{_Y}(?!\d)"),
    ("D_M_Y4", rf"(?<!\d){_D1}{_S}{_D1}{_S}{_Y}(?!\d)"),
)
TAIL = (("Y4_tail", rf"(?<!\d)(20[0-4]\d){_S}{_M}{_S}{_D}"), ("Y2_tail", rf"(?<!\d)([0-4]\d){_S}{_M}{_S}{_D}"))
MONTH_DAY = rf"(?<!\d){_M}\s*[.\-/]\s*{_D}(?![\d.\-/:])"
YEAR_MONTH = (rf"(?<!\d){_M}\s*[.\-/]\s*{_Y}(?!\d)", rf"(?<!\d){_Y}\s*[.\-/년]\s*{_M}(?![\d.\-/])")
_MADE_WORDS = r"(?i)(제\s*조|생\s*산|포\s*장|mfg|mfd|prod|born)"
MADE = rf"{_MADE_WORDS}[^\d]{{0,6}}$"
TIME_AFTER = r"^\s*\d{1,2}\s*[:,;*]\s*\d{2}(?!\d)"
_KIND = "array<struct<s:int,e:int,kind:string,dt:date>>"
_PARTS = "struct<y:string,m:string,d:string>"


def century_date(y: Column, m: Column, d: Column) -> Column:
    """Date of 1990 to 2049; a year of two digits is of this century."""
    return make_date(y, m, d, 1990, 2049)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def order_two_digit(a: Column, b: Column, c: Column, latin: Column, country: Column | None = None) -> Column:
    """Date of a.b.c with a two-digit year first (Korean) or last (European), as far as years are plausible."""
    korean = (2000 + a).between(2015, 2035) & c.between(1, 31)
    european = (2000 + c).between(2015, 2035) & a.between(1, 31)
    use = F.when(korean & european, latin if country is None else (F.coalesce(country == "dmy", F.lit(False)) | latin)).otherwise(european & ~korean)
    out = F.when(use, century_date(c, b, a)).otherwise(century_date(a, b, c))
    if country is not None:
        american = (2000 + c).between(2015, 2035) & a.between(1, 12) & b.between(1, 31)
        out = F.when(F.coalesce(country == "mdy", F.lit(False)) & american, century_date(c, a, b)).otherwise(out)
    return out


def day_month(a: Column, b: Column, y: Column) -> Column:
    """Date of a.b.year: what is over 12 is the day, else the first; none if both are."""
    return F.when((a > 12) & (b <= 12) | (a <= 12) & (b <= 12), century_date(y, b, a)).when((b > 12) & (a <= 12), century_date(y, a, b))


def _dated(kind: str, g: Column, latin: Column, country: Column | None) -> Column:
    part = lambda i: F.get(g, i)
    n = lambda i: _int(part(i))
    month = lambda i: F.coalesce(T.month_number(F.regexp_replace(part(i), r"\.+$", "")), T.fuzzy_month(part(i)))
    if kind.startswith("Y2"):
        return order_two_digit(n(0), n(1), n(2), latin, country)
    if kind == "D_M_Y4":
        return day_month(n(0), n(1), n(2))
    if kind == "D_MON_Y":
        return century_date(n(2), month(1), n(0))
    if kind == "MON_D_Y":
        return century_date(n(2), month(0), n(1))
    return century_date(n(0), n(1), n(2))


def _rows(c: Column, kind: str, pattern: str, latin: Column, country: Column | None) -> Column:
    dated = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), _dated(kind, x["g"], latin, country).alias("dt"))
    return F.transform(find_spans(c, pattern, 3), dated)


def find_dates(c: Column, barcode: bool = False, drop_times: bool = False, patterns=PATTERNS) -> Column:
    """Array of (s, e, kind, dt): matches in order of pattern and place, without those that overlap an earlier one, are no date,
    or lie within nine digits or more. Options: the order of two-digit dates by barcode, dates that a clock time follows dropped."""
    latin, country = T.latin_dominant(c), T.barcode_order(c) if barcode else None

    def found(long):
        every = []
        for kind, p in patterns:
            rows = _rows(c, kind, p, latin, country)
            rows = F.filter(rows, lambda x: x["dt"].isNotNull() & ~inside(x, long))
            if drop_times and kind == "Y2_sep":
                rows = F.filter(rows, lambda x: ~F.substring(c, x["e"] + 1, F.lit(12)).rlike(TIME_AFTER))
            every.append(rows)
        return first_claims(F.concat(*every), _KIND)

    return once(find_spans(c, r"\d{9,}"), found)


def find_dates_with_tail(c: Column) -> Column:
    """find_dates, or where that finds none the looser tail patterns outside runs of more than ten digits."""
    found = find_dates(c)
    long = find_spans(c, r"\d{11,}")
    ok = lambda x: F.year(x["dt"]).between(2015, 2035) & ~F.exists(long, lambda r: (r["s"] <= x["s"]) & (x["s"] < r["e"]))
    tails = [F.filter(_rows(c, k, p, T.latin_dominant(c), None), ok) for k, p in TAIL]
    return F.when(F.size(found) > 0, found).otherwise(first_claims(F.concat(*tails), _KIND))


def find_month_day(c: Column) -> Column:
    """Array of MM-DD strings without a year."""
    return F.transform(find_spans(c, MONTH_DAY, 2), lambda x: F.concat_ws("-", F.get(x["g"], 0), F.get(x["g"], 1)))


def find_year_month(c: Column) -> Column:
    """Array of YYYY-MM strings without a day."""
    first = F.transform(find_spans(c, YEAR_MONTH[0], 2), lambda x: F.concat_ws("-", F.get(x["g"], 1), F.get(x["g"], 0)))
    return F.concat(first, F.transform(find_spans(c, YEAR_MONTH[1], 2), lambda x: F.concat_ws("-", F.get(x["g"], 0), F.get(x["g"], 1))))


def made_only(c: Column, dt: Column) -> Column:
    """Whether a date stands in the text, and each time right behind a word of manufacture."""
    y, m, d = (F.date_format(dt, f) for f in ("yyyy", "MM", "dd"))
    out = F.lit(False)
    fine = F.lit(True)
    for year in (y, F.substring(y, 3, 2)):
        p = F.concat(F.lit(r"(?<!\d)"), year, F.lit(r"\D{0,2}"), m, F.lit(r"\D{0,2}"), d, F.lit(r"(?!\d)"))
        before = F.split(c, p, -1)
        seen = F.slice(before, 1, F.size(before) - 1)
        out = out | (F.size(before) > 1)
        fine = fine & F.forall(seen, lambda x: F.substring(x, -12, 12).rlike(MADE))
    # most texts have no such word at all
    return F.when(dt.isNull() | ~c.rlike(_MADE_WORDS), False).otherwise(out & fine)


def needs_more(n: Column, anchors: Column) -> Column:
    """Whether one date found may be the wrong one of two that the label prints."""
    has = lambda *w: F.arrays_overlap(anchors, F.array(*map(F.lit, w)))
    return (n < 2) & ((has("부터") & has("까지")) | (has(*T.NEGATIVE) & has(*T.POSITIVE)))


def select_date(c: Column) -> Column:
    """(y, m, d) chosen for a text: the best-scored full date, the latest of those; else the latest year and month, else month and day."""
    found = F.filter(find_dates(c), lambda x: x["kind"].startswith("Y4") | F.year(x["dt"]).between(2015, 2035))
    # partial dates are only searched for where there is no full one
    return once(found, lambda found: once(F.array_distinct(F.transform(found, lambda x: x["dt"])), lambda days: F.when(_made(c, days), F.lit(None).cast(_PARTS)).otherwise(once(_best(found, days), lambda best: F.when(best.isNotNull(), _whole(best)).otherwise(_part(c))))))


def _made(c: Column, days: Column) -> Column:
    """Whether the only date is one of manufacture, and the label doesn't say that the other one is elsewhere."""
    trap = once(T.norm(c), lambda n: T.any_of(n, T.ANCHORS["별도표기"]))
    return (F.size(days) == 1) & made_only(c, F.get(days, 0)) & ~trap


def _best(found: Column, days: Column) -> Column:
    kind_of = lambda d: F.get(F.filter(found, lambda x: x["dt"] == d), 0)["kind"]  # noqa: E731  the first that gave it
    score = lambda d: F.when(kind_of(d).startswith("Y4"), 3).otherwise(0) + F.when(F.year(d).between(2015, 2035), 2).otherwise(-5)
    return F.array_max(F.transform(days, lambda d: F.struct(score(d).alias("score"), d.alias("dt"))))["dt"]


def _whole(best: Column) -> Column:
    return F.struct(F.date_format(best, "yyyy").alias("y"), F.date_format(best, "MM").alias("m"), F.date_format(best, "dd").alias("d"))


def _part(c: Column) -> Column:
    nul = F.lit(None).cast("string")
    month_day = lambda md: F.when(md.isNotNull(), F.struct(nul.alias("y"), F.substring(md, 1, 2).alias("m"), F.substring(md, 4, 2).alias("d")))
    year_month = lambda ym: F.when(ym.isNotNull(), F.struct(F.substring(ym, 1, 4).alias("y"), F.substring(ym, 6, 2).alias("m"), nul.alias("d"))).otherwise(once(F.array_max(find_month_day(c)), month_day))
    return once(F.array_max(find_year_month(c)), year_month)


def interpretations(c: Column) -> Column:
    """All dates that three numbers in a row can mean: year first, year last, year last with the month first."""
    spans = find_spans(c, r"(?<!\d)(\d{1,4})[.\-/\s](\d{1,2})[.\-/\s](\d{1,4})(?!\d)", 3)
    n = lambda x, i: _int(F.get(x["g"], i))
    year = lambda v: F.when(v < 70, v + 2000).when(v < 100, v + 1900).otherwise(v)

    def three(x):
        a, b, d = n(x, 0), n(x, 1), n(x, 2)
        return F.array(make_date(year(a), b, d, 1990, 2049), make_date(year(d), b, a, 1990, 2049), make_date(year(d), a, b, 1990, 2049))

    return F.array_distinct(F.filter(F.flatten(F.transform(spans, three)), lambda d: d.isNotNull()))


def order_rules(c: Column) -> dict[str, Column]:
    """Order of a two-digit date by several rules; null abstains."""
    anchors = T.find_anchors(c)
    return {
        "R0_dmy": F.lit("dmy"), "R1_ymd": F.lit("ymd"), "R2_latin": F.when(T.latin_dominant(c), "dmy").otherwise("ymd"),
        "R3_anchor": F.when(F.arrays_overlap(anchors, F.array(F.lit("소비기한"), F.lit("유통기한"), F.lit("까지"))), "ymd").when(F.arrays_overlap(anchors, F.array(F.lit("BEST_BEFORE"), F.lit("EXP"))), "dmy"),
        "R4_barcode": T.barcode_order(c), "R5_abstain": F.lit(None).cast("string"),
    }
