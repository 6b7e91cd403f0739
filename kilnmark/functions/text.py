"""String functions of label text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: words by which a label says what kind of date it prints, as norm() leaves them.
ANCHORS = {
    "소비기한": ["소비기한", "소비기힌", "비기한"],
    "유통기한": ["유통기한", "유통기힌", "통기한"],
    "품질유지기한": ["품질유지기한", "품질유지"],
    "제조일자": ["제조일자", "제조년월일", "제조일", "제조년", "제조"],
    "생산일자": ["생산일자", "생산일"],
    "포장일자": ["포장일자", "포장일", "포장년월일"],
    "賞味期限": ["賞味期限", "賞味期"],
    "消費期限": ["消費期限", "消費期"],
    "BEST_BEFORE": ["bestbefore", "bestbefor", "bestbe", "bbe", "bestbefend"],
    "EXP": ["exp.", "expiry", "expdate", "expirydate", "useby", "usebefore"],
    "MFG": ["mfg", "mfd", "manufactur", "proddate", "productiondate"],
    "까지": ["까지"],
    "부터": ["부터"],
    "별도표기": ["별도표기", "별도표시", "표기일까지", "하단표기", "상단표기", "제품별도", "별도기재", "우측표기", "전면표기", "표시일까지", "표시된일자", "아래에표시", "후면표시"],
}
POSITIVE = ("소비기한", "유통기한", "품질유지기한", "賞味期限", "消費期限", "BEST_BEFORE", "EXP")
NEGATIVE = ("제조일자", "생산일자", "포장일자", "MFG")
STRONG = ("소비기한", "유통기한", "EXPIRY", "EXP DATE", "EXP:", "BEST BEFORE", "BEST BY", "BEST IF USED BY", "USE BY", "BB:")
WEAK = ("EXP", "BB", "까지")
AGAINST = ("제조일", "제조일자", "제조일시", "생산일", "생산일자", "포장일", "포장일자", "포장년", "MFG", "PROD", "PROD DATE", "PRODUCTION DATE", "PACK DATE", "PACKED", "PACKING DATE", "PD:", "P.D.", "P.D:")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
LETTERS_AS_DIGITS = ("OoDQIil|ZSBGbT", "00001111258667")
DIGITS_AS_LETTERS = ("01345689", "oleasgbg")
_FULL, _HALF = "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " "


def norm(c: Column) -> Column:
    """Full-width forms to ASCII, separators dropped, lower case."""
    return F.lower(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _FULL, _HALF), r"(?U)[\s·:;,_()\[\]/\\|]+", ""))


def any_of(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def count_of(c: Column, words) -> Column:
    """How many of the words the text holds, each once."""
    return sum((F.when(F.contains(c, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def find_anchors(c: Column) -> Column:
    n = norm(c)
    return F.array_compact(F.array(*[F.when(any_of(n, ws), F.lit(k)) for k, ws in ANCHORS.items()]))


def polarity(anchors: Column) -> Column:
    pos = F.arrays_overlap(anchors, F.array(*map(F.lit, POSITIVE)))
    neg = F.arrays_overlap(anchors, F.array(*map(F.lit, NEGATIVE)))
    return F.struct(pos.alias("has_pos"), neg.alias("has_neg"), F.array_contains(anchors, "까지").alias("soft"), F.array_contains(anchors, "별도표기").alias("trap"))


def keyword_score(c: Column, up: Column | None = None) -> Column:
    """Words for a date of expiry less words against it; ``up`` is the text in upper case, where that is known."""
    up = F.upper(c) if up is None else up
    return (10 * count_of(up, STRONG) + 4 * count_of(up, WEAK) - 12 * count_of(up, AGAINST) + F.when(F.contains(c, F.lit("까지")), 15).otherwise(0) - F.when(F.contains(c, F.lit("부터")), 8).otherwise(0)).cast("int")


def repair_digit(c: Column) -> Column:
    """A C, O or Q read for the zero of a month."""
    return F.regexp_replace(c, r"(?<!\d)(20\d{2})[.\-/:]?\s*[COQ](\d)[.\-/:](\d{1,2})(?!\d)", "$1.0$2.$3")


def letters_as_digits(c: Column) -> Column:
    return F.translate(c, *LETTERS_AS_DIGITS)


def digits_as_letters(c: Column) -> Column:
    return F.translate(c, *DIGITS_AS_LETTERS)


def month_number(c: Column) -> Column:
    """Of an English month name or its first three letters (and ``sept``); else null."""
    at = F.instr(F.lit("".join(MONTHS)), F.upper(F.substring(c, 1, 3)))
    return F.when((F.length(c) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def fuzzy_month(c: Column) -> Column:
    """A month name in the token, as it is or with digits read as letters; else two of its first three letters in place."""
    t = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    u = digits_as_letters(t)
    first = [F.when(F.contains(t, F.lit(m.lower())) | F.contains(u, F.lit(m.lower())), i + 1) for i, m in enumerate(MONTHS)]
    near = [F.when((F.length(u) >= 3) & (sum((F.when(F.substring(u, j + 1, 1) == m[j].lower(), 1).otherwise(0) for j in range(3)), F.lit(0)) >= 2), i + 1) for i, m in enumerate(MONTHS)]
    return F.when(~t.rlike("^[0-9]*$"), F.coalesce(*first, *near))


def hangul(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^가-힣]", ""))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def latin_dominant(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^A-Za-z]", "")) > 2 * hangul(c)


def digit_rich(c: Column) -> Column:
    return F.length(digits(c)) >= 4


def digit_like(c: Column) -> Column:
    n = F.length(digits(c))
    return (n >= 3) & (n >= hangul(c))


def ean13_ok(c: Column) -> Column:
    """Thirteen digits whose check digit is right."""
    digit = lambda i: F.substring(c, i + 1, 1).cast("int")
    total = sum((digit(i) * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return F.when(c.rlike("^[0-9]{13}$"), (10 - total % 10) % 10 == digit(12)).otherwise(False)


def barcode_order(c: Column) -> Column:
    """Order of a two-digit date by the country of the first valid barcode whose country has one: mdy, dmy or null."""
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: ean13_ok(x))

    def order(x):
        p = F.substring(x, 1, 3).cast("int")
        own = (p == 880) | p.between(450, 459) | p.between(490, 499) | p.between(690, 699)
        return F.when((p <= 139) | p.between(754, 755), "mdy").when(own, "none").when(p.between(200, 899), "dmy")

    return F.nullif(F.get(F.filter(F.transform(runs, order), lambda x: x.isNotNull()), 0), F.lit("none"))


def windows13(c: Column) -> Column:
    """Every 13 neighbouring digits of runs of eight or more."""
    runs = F.filter(F.regexp_extract_all(c, F.lit(r"\d{8,}"), F.lit(0)), lambda x: F.length(x) >= 13)
    return F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 12), lambda i: F.substring(x, i, F.lit(13)))))


#: Name and pattern of things that look like dates and aren't.
DISTRACTORS = {
    "digits14": r"(?<!\d)\d{14,}(?!\d)", "digits13": r"(?<!\d)\d{13}(?!\d)", "digits9_12": r"(?<!\d)\d{9,12}(?!\d)", "phone": r"(?<!\d)0\d{1,2}-\d{3,4}-\d{4}(?!\d)",
    "report": r"(?<!\d)1399(?!\d)", "percent": r"\d+(?:\.\d+)?%", "amount": r"\d+(?:\.\d+)?(?:kcal|ml|g)", "lot": r"LOT", "clock": r"(?<!\d)\d{1,2}:\d{2}(?!\d)", "hour": r"(?<!\d)\d{1,2}시",
}


def distractors(c: Column) -> dict[str, Column]:
    return {k: F.regexp_count(c, F.lit(p)) for k, p in DISTRACTORS.items()}


def truth_readable(text: Column, y: Column, m: Column, d: Column) -> Column:
    """Whether some order of the date's digits is among the text's digits."""
    t, yy = digits(text), F.substring(y, 3, 2)
    out = F.lit(False)
    for parts in ((y, m, d), (yy, m, d), (d, m, y), (d, m, yy), (m, d, y), (m, d, yy)):
        out = out | F.contains(t, F.concat(*parts))
    return out


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|\s]+', "_")


def manual_label(c: Column) -> Column:
    """Digits of a typed label: eight as YYYYMMDD of 1990 to 2049, six as YYMMDD; else null."""
    t = digits(c)
    y, m, d = (F.substring(t, a, n) for a, n in ((1, 4), (5, 2), (7, 2)))
    ok = lambda m, d: m.between("01", "12") & d.between("01", "31")
    six = F.concat_ws("-", F.concat(F.lit("20"), F.substring(t, 1, 2)), F.substring(t, 3, 2), F.substring(t, 5, 2))
    return F.when((F.length(t) == 8) & y.between("1990", "2049") & ok(m, d), F.concat_ws("-", y, m, d)).when((F.length(t) == 6) & ok(F.substring(t, 3, 2), F.substring(t, 5, 2)), six)


def label_state(c: Column) -> Column:
    return F.when(F.upper(c) == "SKIP", "skip").when(c.rlike(r"^(NONE|(\d{4}|NONE)-(\d{2}|NONE)-(\d{2}|NONE))$"), "ok").otherwise("bad")


def final_date(y: Column, m: Column, d: Column) -> Column:
    """One NONE if all parts are missing, else the parts with NONE where one is."""
    none = F.lit("NONE")
    parts = [F.coalesce(y, none), F.coalesce(F.lpad(m, 2, "0"), none), F.coalesce(F.lpad(d, 2, "0"), none)]
    return F.when(y.isNull() & m.isNull() & d.isNull(), none).otherwise(F.concat_ws("-", *parts))


def split3(c: Column) -> Column:
    """Year, month, day of a final date; three NONE for a null, NONE, or anything without three parts."""
    p = F.split(F.coalesce(c, F.lit("NONE")), "-")
    part = lambda i: F.when(F.size(p) == 3, F.get(p, i)).otherwise("NONE")
    return F.struct(part(0).alias("y"), part(1).alias("m"), part(2).alias("d"))


def ctc_decode(ids: Column, alphabet: str = "0123456789./-:") -> Column:
    """Repeats collapsed, blanks (0) dropped, the rest as characters."""
    kept = F.filter(ids, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(ids, i - 1))))
    return F.array_join(F.transform(kept, lambda x: F.substring(F.lit(alphabet), x, F.lit(1))), "")


#: Ever looser shapes of a date, the tightest first.
PROBES = (
    ("P1", r"(?<!\d)20\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}(?!\d)"), ("P2", r"(?<!\d)\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}(?!\d)"), ("P3", r"(?<!\d)(20)?\d{6}(?!\d)"),
    ("P4", r"\d{1,4}\s*[.\-/]\s*\d{1,2}"), ("P5", r"\d"),
)


def probe(c: Column) -> Column:
    out = None
    for name, p in PROBES:
        out = F.when(c.rlike(p), name) if out is None else out.when(c.rlike(p), name)
    return out.otherwise("P6")


def dateish(c: Column) -> Column:
    return c.rlike(r"\d{2,4}\s*[.\-/년]\s*\d{1,2}|\d{6,8}")


def usefulness(lines: Column) -> Column:
    """Sum over (t, c) of confidence times the number of Hangul and digit characters."""
    return F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["c"] * F.length(F.regexp_replace(x["t"], "[^가-힣0-9]", "")))
