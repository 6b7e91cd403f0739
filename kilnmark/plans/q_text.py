"""Queries of string and date functions over the label texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from .registry import Tables, query

ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


def _sum(words, weight, col="upper(text)") -> str:
    return " + ".join(f"CASE WHEN contains({col}, '{w}') THEN {weight} ELSE 0 END" for w in words)


def _any(words, col="upper(text)") -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


SCORE = f"({_sum(T.STRONG, 10)} + {_sum(T.WEAK, 4)} + {_sum(T.AGAINST, -12)} + {_sum(['까지'], 15, 'text')} + {_sum(['부터'], -8, 'text')})"
NORM = r"lower(regexp_replace(text, '[\s·:;,_()\[\]/\\|]+', '', 'g'))"


#: For the other engine, written for it: what each kind of word looks like in normalised text.
ANCHOR_SQL = {
    "소비기한": "비기한|소비기힌", "유통기한": "통기한|유통기힌", "품질유지기한": "품질유지", "제조일자": "제조", "생산일자": "생산일", "포장일자": "포장(일|년월일)",
    "賞味期限": "賞味期", "消費期限": "消費期", "BEST_BEFORE": "bestbe|bbe", "EXP": r"exp\.|expiry|expdate|use(by|before)", "MFG": "mfg|mfd|manufactur|prod(uction)?date", "까지": "까지", "부터": "부터",
    "별도표기": "별도표[기시]|표기일까지|[하상]단표기|제품별도|별도기재|우측표기|전면표기|표시일까지|표시된일자|아래에표시|후면표시",
}
KIND_SQL = {"pos": ("소비기한", "유통기한", "품질유지기한", "賞味期限", "消費期限", "BEST_BEFORE", "EXP"), "neg": ("제조일자", "생산일자", "포장일자", "MFG")}


def has_sql(keys, text):
    """SQL: whether a text has a word of one of the kinds."""
    return f"regexp_matches({NORM.replace('text', text)}, '{'|'.join(ANCHOR_SQL[k] for k in keys)}')"


#: Every other text with the short word for manufacture, which stands alone or before a date.
BARE = "CASE WHEN doc_id % 2 = 1 THEN replace(text, '제조일', '제조') ELSE text END"


def simple(name, column, sql, source="texts", key="doc_id"):
    """A query that adds one computed column v to a source's key."""

    @query(name, f"SELECT {key}, {sql} AS v FROM {source}")
    def run(t: Tables, column=column):
        return getattr(t, source).select(key, column().alias("v"))


simple("o_s1", lambda: T.norm(F.col("text")), NORM)
simple("o_s2", lambda: F.array_join(T.find_anchors(F.expr(BARE)), ","), "concat_ws(',', " + ", ".join(f"CASE WHEN {has_sql([k], BARE)} THEN '{k}' END" for k in ANCHOR_SQL) + ")")
simple("o_s4", lambda: T.keyword_score(F.col("text")), f"CAST({SCORE} AS INTEGER)")
simple("o_s5", lambda: T.repair_digit(F.upper(F.col("text"))), r"regexp_replace(upper(text), '(20[0-9]{2})[.\-/:]?\s*[COQ]([0-9])[.\-/:]([0-9]{1,2})', '\1.0\2.\3', 'g')")
simple("o_s6", lambda: T.letters_as_digits(F.col("text")), "translate(text, 'OoDQIil|ZSBGbT', '00001111258667')")
simple("o_s7", lambda: T.digits_as_letters(F.col("p_name")), "translate(p_name, '01345689', 'oleasgbg')", "part", "p_partkey")
simple("o_s9", lambda: T.month_number(F.regexp_extract(F.upper(F.col("text")), "([A-Z]{3,4})", 1)), "CASE WHEN regexp_extract(upper(text), '[A-Z]{3,4}') <> '' AND instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', substr(regexp_extract(upper(text), '[A-Z]{3,4}'), 1, 3)) % 3 = 1 THEN CAST((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', substr(regexp_extract(upper(text), '[A-Z]{3,4}'), 1, 3)) + 2) // 3 AS INTEGER) END")
simple("o_s10", lambda: T.latin_dominant(F.col("text")), "length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 2 * length(regexp_replace(text, '[^가-힣]', '', 'g'))")
simple("o_s11", lambda: T.digit_rich(F.col("text")), "length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4")
simple("o_s12", lambda: T.digit_like(F.col("text")), "length(regexp_replace(text, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(text, '[^0-9]', '', 'g')) >= length(regexp_replace(text, '[^가-힣]', '', 'g'))")
_EAN = "lpad(CAST(o_orderkey * 7919 % 10000000 AS VARCHAR), 13, '880')"
simple("o_s13", lambda: T.ean13_ok(F.expr("lpad(cast(o_orderkey * 7919 % 10000000 as string), 13, '880')")), "(10 - (" + " + ".join(f"CAST(substr({_EAN}, {i + 1}, 1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(12)) + f") % 10) % 10 = CAST(substr({_EAN}, 13, 1) AS INTEGER)", "orders", "o_orderkey")
_B = f"substr({_EAN}, 1, 12) || CAST((10 - (" + " + ".join(f"CAST(substr({_EAN}, {i + 1}, 1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(12)) + ") % 10) % 10 AS VARCHAR)"


@query("o_s14", f"SELECT o_orderkey, CASE WHEN p <= 139 OR p BETWEEN 754 AND 755 THEN 'mdy' WHEN p = 880 OR p BETWEEN 450 AND 459 OR p BETWEEN 490 AND 499 OR p BETWEEN 690 AND 699 THEN NULL WHEN p BETWEEN 200 AND 899 THEN 'dmy' END AS v FROM (SELECT o_orderkey, CAST(substr(b, 1, 3) AS INTEGER) AS p FROM (SELECT o_orderkey, {_B.replace('o_orderkey * 7919 % 10000000', '100000000000 + o_orderkey * 7919777 % 890000000000')} AS b FROM orders) x) y")
def o_s14(t: Tables):
    base = F.expr("lpad(cast(100000000000 + o_orderkey * 7919777 % 890000000000 as string), 13, '880')")
    digit = lambda i: F.substring("s", i + 1, 1).cast("int")
    check = (10 - sum((digit(i) * (3 if i % 2 else 1) for i in range(12)), F.lit(0)) % 10) % 10
    return t.orders.select("o_orderkey", base.alias("s")).select("o_orderkey", T.barcode_order(F.concat(F.lit("lot 12345 "), F.substring("s", 1, 12), check.cast("string"), F.lit(" x"))).alias("v"))


@query("o_s15", "SELECT doc_id, substr(r, CAST(i AS INTEGER), 13) AS v FROM (SELECT doc_id, r, unnest(range(1, length(r) - 11)) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{8,}')) AS r FROM texts) a WHERE length(r) >= 13) b")
def o_s15(t: Tables):
    return t.texts.select("doc_id", F.explode(T.windows13(F.col("text"))).alias("v"))


@query("o_s16", r"SELECT variant, CAST(sum(len(regexp_extract_all(b, '<[0-9]{14,}>'))) AS BIGINT) AS digits14, CAST(sum(len(regexp_extract_all(b, '[0-9]>%'))) AS BIGINT) AS percent, CAST(sum(len(regexp_extract_all(b, '[0-9]>(kcal|ml|g)'))) AS BIGINT) AS amount, CAST(sum(len(regexp_extract_all(b, 'LOT'))) AS BIGINT) AS lot, CAST(sum(len(regexp_extract_all(b, '<[0-9]{1,2}>:<[0-9]{2}>'))) AS BIGINT) AS clock FROM (SELECT variant, regexp_replace(text, '([0-9]+)', '<\1>', 'g') AS b FROM texts) x GROUP BY variant")
def o_s16(t: Tables):
    cols = T.distractors(F.col("text"))
    return t.texts.groupBy("variant").agg(*[F.sum(cols[k]).alias(k) for k in ("digits14", "percent", "amount", "lot", "clock")])


_DG = "regexp_replace(text, '[^0-9]', '', 'g')"
simple("o_s18", lambda: T.truth_readable(F.col("text"), F.col("ty"), F.col("tm"), F.col("td")), "(" + " OR ".join(f"contains({_DG}, {p})" for p in ("ty || tm || td", "substr(ty, 3, 2) || tm || td", "td || tm || ty", "td || tm || substr(ty, 3, 2)", "tm || td || ty", "tm || td || substr(ty, 3, 2)")) + ")")
simple("o_s19", lambda: T.safe_name(F.col("text")), r"""regexp_replace(text, '[\\/:*?"<>|\s]+', '_', 'g')""")
simple("o_s20", lambda: T.manual_label(F.col("text")), f"CASE WHEN length({_DG}) = 8 AND substr({_DG}, 1, 4) BETWEEN '1990' AND '2049' AND substr({_DG}, 5, 2) BETWEEN '01' AND '12' AND substr({_DG}, 7, 2) BETWEEN '01' AND '31' THEN substr({_DG}, 1, 4) || '-' || substr({_DG}, 5, 2) || '-' || substr({_DG}, 7, 2) WHEN length({_DG}) = 6 AND substr({_DG}, 3, 2) BETWEEN '01' AND '12' AND substr({_DG}, 5, 2) BETWEEN '01' AND '31' THEN '20' || substr({_DG}, 1, 2) || '-' || substr({_DG}, 3, 2) || '-' || substr({_DG}, 5, 2) END")
simple("o_s21", lambda: T.label_state(F.when(F.col("rung_ord") == 8, "SKIP").otherwise(F.col("pred"))), "CASE WHEN rung_ord = 8 THEN 'skip' WHEN regexp_full_match(pred, 'NONE|([0-9]{4}|NONE)-([0-9]{2}|NONE)-([0-9]{2}|NONE)') THEN 'ok' ELSE 'bad' END", "rungs")


@query("o_s3", f"SELECT {has_sql(KIND_SQL['pos'], BARE)} AS has_pos, {has_sql(KIND_SQL['neg'], BARE)} AS has_neg, {has_sql(['까지'], BARE)} AS soft, {has_sql(['별도표기'], BARE)} AS trap, count(*) AS n FROM texts GROUP BY ALL")
def o_s3(t: Tables):
    return t.texts.select(T.polarity(T.find_anchors(F.expr(BARE))).alias("p")).select("p.*").groupBy("has_pos", "has_neg", "soft", "trap").agg(F.count("*").alias("n"))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: Month names of all texts, as they are, with letters read as digits, or with one letter wrong; and the texts themselves.
_NAME = "substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(doc_id * 7 % 12 * 3 + 1 AS INTEGER), 3)"
WORN = f"CASE CAST(doc_id % 5 AS INTEGER) WHEN 0 THEN {_NAME} || ' 12' WHEN 1 THEN translate({_NAME}, 'OLEASGB', '0134568') || '.' WHEN 2 THEN substr({_NAME}, 1, 1) || 'x' || substr({_NAME}, 3, 1) WHEN 3 THEN 'q' || substr({_NAME}, 2, 2) || '/24' ELSE text END"
_EXACT = " ".join(f"WHEN contains(t, '{m}') OR contains(u, '{m}') THEN {i}" for i, m in enumerate(_MONTHS, 1))
_NEAR = " ".join(f"WHEN length(u) >= 3 AND (substr(u, 1, 1) = '{m[0]}')::INT + (substr(u, 2, 1) = '{m[1]}')::INT + (substr(u, 3, 1) = '{m[2]}')::INT >= 2 THEN {i}" for i, m in enumerate(_MONTHS, 1))


@query("o_s8", f"SELECT doc_id, CASE WHEN regexp_full_match(t, '[0-9]*') THEN NULL {_EXACT} {_NEAR} END AS v FROM (SELECT doc_id, t, translate(t, '01345689', 'oleasgbg') AS u FROM (SELECT doc_id, regexp_replace(lower({WORN}), '[^a-z0-9]', '', 'g') AS t FROM texts) a) b")
def o_s8(t: Tables):
    return t.texts.select("doc_id", T.fuzzy_month(F.expr(WORN)).alias("v"))


@query("o_s22", "SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN 'NONE' ELSE CASE WHEN doc_id % 2 = 1 THEN 'NONE' ELSE ty END || '-' || CASE WHEN doc_id % 4 >= 2 THEN 'NONE' ELSE tm END || '-' || CASE WHEN doc_id % 8 >= 4 THEN 'NONE' ELSE td END END AS v FROM truths")
def o_s22(t: Tables):
    k = F.col("doc_id")
    y, m, d = F.when(k % 2 == 0, F.col("ty")), F.when(k % 4 < 2, F.col("tm").cast("int").cast("string")), F.when(k % 8 < 4, F.col("td").cast("int").cast("string"))
    return t.truths.select("doc_id", T.final_date(y, m, d).alias("v"))


@query("o_s23", "SELECT doc_id, rung_ord, CASE WHEN len(string_split(pred, '-')) = 3 THEN string_split(pred, '-')[1] ELSE 'NONE' END AS y, CASE WHEN len(string_split(pred, '-')) = 3 THEN string_split(pred, '-')[2] ELSE 'NONE' END AS m, CASE WHEN len(string_split(pred, '-')) = 3 THEN string_split(pred, '-')[3] ELSE 'NONE' END AS d FROM rungs")
def o_s23(t: Tables):
    return t.rungs.select("doc_id", "rung_ord", T.split3(F.col("pred")).alias("s")).select("doc_id", "rung_ord", "s.*")


@query("o_s24", "SELECT o_orderkey, list_aggregate(list_transform(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0 AND (i = 1 OR ids[i] <> ids[i - 1])), lambda i: substr('0123456789./-:', CAST(ids[i] AS INTEGER), 1)), 'string_agg', '') AS v FROM (SELECT o_orderkey, list_transform(range(1, 13), lambda i: (o_orderkey // i + i) % 5) AS ids FROM orders) x")
def o_s24(t: Tables):
    ids = F.expr("transform(sequence(1, 12), i -> cast((o_orderkey div i + i) % 5 as int))")
    return t.orders.select("o_orderkey", ids.alias("ids")).select("o_orderkey", F.nullif(T.ctc_decode(F.col("ids")), F.lit("")).alias("v"))


@query("o_s25", r"SELECT variant, CASE WHEN regexp_matches(b, '<20[0-9]{2}>[.\-/]<[0-9]{1,2}>[.\-/]<[0-9]{1,2}>') THEN 'P1' WHEN regexp_matches(b, '<[0-9]{2}>[.\-/]<[0-9]{1,2}>[.\-/]<[0-9]{1,2}>') THEN 'P2' WHEN regexp_matches(b, '<(20)?[0-9]{6}>') THEN 'P3' WHEN regexp_matches(text, '[0-9]{1,4}\s*[.\-/]\s*[0-9]{1,2}') THEN 'P4' WHEN regexp_matches(text, '[0-9]') THEN 'P5' ELSE 'P6' END AS probe, count(*) AS n FROM (SELECT variant, text, regexp_replace(text, '([0-9]+)', '<\1>', 'g') AS b FROM texts) x GROUP BY ALL")
def o_s25(t: Tables):
    return t.texts.groupBy("variant", T.probe(F.col("text")).alias("probe")).agg(F.count("*").alias("n"))


simple("o_s26", lambda: T.dateish(F.col("text")), r"regexp_matches(text, '[0-9]{2,4}\s*[.\-/년]\s*[0-9]{1,2}|[0-9]{6,8}')")


@query("o_s28", "SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS v FROM fragments GROUP BY doc_id")
def o_s28(t: Tables):
    return t.fragments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("v"))


@query("o_s29", "SELECT doc_id, round(sum(pos / 4.0 * length(regexp_replace(text, '[^가-힣0-9]', '', 'g'))), 6) AS v FROM fragments GROUP BY doc_id")
def o_s29(t: Tables):
    lines = F.collect_list(F.struct(F.col("text").alias("t"), (F.col("pos") / 4.0).alias("c")))
    return t.fragments.groupBy("doc_id").agg(lines.alias("l")).select("doc_id", F.round(T.usefulness(F.col("l")), 6).alias("v"))


# The other engine has no look-around: there each run of digits is put in brackets first.
_M = "(JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)"
BRACKETED = {
    "a": (r"<(20[0-9]{2})>[.\-/\s]+<([0-9]{1,2})>[.\-/\s]+<([0-9]{1,2})>(\s*:\s*<)?", (1, 2, 3)),
    "a1": (r"<(20[0-9]{2})>\s*[.\-/]\s*<([0-9]{2})([0-9]{2})>()", (1, 2, 3)),
    "a2": (r"<(20[0-9]{2})([0-9]{2})>\s*[.\-/]\s*<([0-9]{1,2})>()", (1, 2, 3)),
    "b": (r"<([0-9]{1,2})>\s*[.\-/]+\s*<([0-9]{1,2})>\s*[.\-/]+\s*<(20[0-9]{2})>()", (3, 2, 1)),
    "b2": (r"<([0-9]{1,2})>\s+<([0-9]{1,2})>\s+<(20[0-9]{2})>()", (3, 2, 1)),
    "c": (rf"(20[0-9]{{2}})>[.\-/\s]+{_M}[.\-/\s]+<([0-9]{{1,2}})[0-9]*>()", (1, 2, 3)),
    "d": (rf"{_M}[\s.\-/]+<([0-9]{{1,2}})>[\s,.\-/]+<(20[0-9]{{2}})[0-9]*>()", (3, 1, 2)),
    "e": (rf"<([0-9]{{1,2}})>[\s.\-/]*{_M}[\s.\-/]*<([0-9]{{2}})>()", (3, 2, 1)),
    "e2": (rf"<([0-9]{{1,2}})>[\s.\-/]*{_M}[\s.\-/,]*<(20[0-9]{{2}})>()", (3, 2, 1)),
    "e3": (rf"{_M}[\s.\-/]*<([0-9]{{1,2}})>[\s,.\-/]+<([0-9]{{2}})>()", (3, 1, 2)),
    "f": (r"<([0-9]{1,2})>[.\-/]<([0-9]{1,2})>[.\-/]<([0-9]{2})>()", (1, 2, 3)),
    "g": (r"<([0-9]{1,2})>\s+<([0-9]{1,2})>\s+<([0-9]{2})>()", (3, 2, 1)),
    "h8": (r"<(20[0-9]{2})([0-9]{2})([0-9]{2})>()", (1, 2, 3)),
    "h9": (r"<([0-9]{2})([0-9]{2})([0-9]{2})>()", (1, 2, 3)),
}
_PREPARED = r"SELECT doc_id, text, u, regexp_replace(u, '([0-9]+)', '<\1>', 'g') AS b FROM (SELECT doc_id, text, regexp_replace(upper(text), '(20[0-9]{2})[.\-/:]?\s*[COQ]([0-9])[.\-/:]([0-9]{1,2})', '\1.0\2.\3', 'g') AS u FROM SOURCE) p0"


def _mon(x: str) -> str:
    return f"CASE WHEN instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', {x}) > 0 AND length({x}) = 3 THEN CAST((instr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', {x}) + 2) // 3 AS VARCHAR) ELSE {x} END"


def _date(y: str, m: str, d: str) -> str:
    year = f"CASE WHEN length({y}) <= 2 THEN '20' || lpad({y}, 2, '0') ELSE {y} END"
    return f"CASE WHEN {year} BETWEEN '2015' AND '2035' THEN TRY_CAST({year} || '-' || lpad({_mon(m)}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"


def matches_sql(name: str, source: str = "texts") -> str:
    """(doc_id, text, dt) of one pattern over a table with doc_id and text."""
    p, (y, m, d) = BRACKETED[name]
    gate = {
        "g": f"WHERE {_any(D.CONTEXT, 'u')}",
        "h8": f"WHERE ({_any(D.COMPACT_FOR, 'u')} OR regexp_matches(u, '^\\s*(20[0-9]{{6}}|[0-9]{{6}})\\s*$')) AND NOT {_any(D.COMPACT_AGAINST, 'u')}",
    }
    gate["h9"] = gate["h8"]
    alls = ", ".join(f"regexp_extract_all(b, '{p}', {k})" for k in (1, 2, 3, 4))
    dt = _date(f"z[{y}]", f"z[{m}]", f"z[{d}]")
    if name == "f":
        dt = f"COALESCE({dt}, {_date('z[3]', 'z[2]', 'z[1]')})"
    return f"SELECT doc_id, text, {dt} AS dt FROM (SELECT doc_id, text, unnest(list_zip({alls})) AS z FROM ({_PREPARED.replace('SOURCE', source)}) p1 {gate.get(name, '')}) p2 WHERE coalesce(z[4], '') = '' AND {dt} IS NOT NULL"


for _i, _name in enumerate(D.PATTERNS, 1):

    @query(f"o_d{_i:02d}", f"SELECT doc_id, CAST(dt AS VARCHAR) AS dt FROM ({matches_sql(_name)}) m")
    def _pattern(t: Tables, name=_name):
        u = D.prepared(F.col("text"))
        found = F.when(D.gate(name, u), D.matches(u, name))
        return t.texts.select("doc_id", F.explode(found).alias("dt")).select("doc_id", F.col("dt").cast("string").alias("dt"))


GRAMS = "SELECT doc_id, pos, k, g AS text FROM (SELECT doc_id, pos, text AS g1, text || ' ' || lead(text) OVER w AS g2, text || ' ' || lead(text) OVER w || ' ' || lead(text, 2) OVER w AS g3 FROM (SELECT doc_id, pos, trim(text) AS text FROM fragments WHERE trim(text) <> '') f WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) x, LATERAL (VALUES (1, g1), (2, g2), (3, g3)) v(k, g) WHERE g IS NOT NULL"


@query("o_d15", f"SELECT doc_id, text AS gram FROM ({GRAMS}) q")
def o_d15(t: Tables):
    return D.with_ngrams(t.fragments).select("doc_id", F.explode("grams").alias("gram"))


_ALL = " UNION ALL ".join(matches_sql(n, "grams") for n in D.PATTERNS)
_CHOSEN = f"SELECT doc_id, CASE WHEN max(s) >= 0 THEN CAST(max(dt) FILTER (WHERE s = top) AS VARCHAR) END AS dt FROM (SELECT doc_id, {SCORE} AS s, max({SCORE}) OVER (PARTITION BY doc_id) AS top, dt FROM ({_ALL}) a) b GROUP BY doc_id"


FULL_DATES = f"WITH grams AS ({GRAMS}) SELECT d.doc_id, c.dt FROM (SELECT DISTINCT doc_id FROM fragments) d LEFT JOIN ({_CHOSEN}) c ON c.doc_id = d.doc_id"


@query("o_d16", FULL_DATES)
def o_d16(t: Tables):
    return D.with_ngrams(t.fragments).select("doc_id", D.choose_date(F.col("grams")).cast("string").alias("dt"))


_POS = _any(D.PARTIAL_FOR)
_TWO = "lpad(z[1], 2, '0')"


def _partial(ord_: int, p: str, gate: str, ok: str, score: str, y: str, m: str, d: str) -> str:
    return f"SELECT doc_id, pos, k, {ord_} AS o, i, CAST((CASE WHEN {_POS} THEN 10 ELSE 0 END + CASE WHEN contains(text, '까지') THEN 5 ELSE 0 END {score}) AS INTEGER) AS score, {y} AS y, {m} AS m, {d} AS d FROM (SELECT *, unnest(list_zip(regexp_extract_all(b, '{p}', 1), regexp_extract_all(b, '{p}', 2))) AS z, unnest(range(len(regexp_extract_all(b, '{p}', 1)))) AS i FROM pb WHERE NOT {_any(T.AGAINST)} {gate}) w WHERE {ok}"


_YOK = "(CASE WHEN length(z[2]) = 2 THEN '20' || z[2] ELSE z[2] END) BETWEEN '2015' AND '2035' AND " + _TWO + " BETWEEN '01' AND '12'"
_YV = "CASE WHEN length(z[2]) = 2 THEN '20' || z[2] ELSE z[2] END"
_DOK = f"TRY_CAST('2024-' || {_TWO} || '-' || lpad(z[2], 2, '0') AS DATE) IS NOT NULL"
_PARTS = " UNION ALL ".join((
    _partial(1, r"<([0-9]{1,2})>[.\-/]<(20[0-9]{2})>", "", _YOK, "", _YV, _TWO, "'NONE'"),
    _partial(2, r"<([0-9]{1,2})>\s*[.\-/]\s*<([0-9]{2})>", f"AND {_POS}", _YOK, "+ 2", _YV, _TWO, "'NONE'"),
    _partial(3, r"<([0-9]{1,2})>\s+<(20[0-9]{2})>", "", _YOK, "", _YV, _TWO, "'NONE'"),
    _partial(4, r"<([0-9]{1,2})>\s*[.\-/]\s*<([0-9]{1,2})>", f"AND {_POS}", _DOK, "", "'NONE'", _TWO, "lpad(z[2], 2, '0')"),
    _partial(5, r"<([0-9]{2})>\s*[.\-/]\s*<([0-9]{2})>", f"AND NOT {_POS}", _DOK, "", "'NONE'", _TWO, "lpad(z[2], 2, '0')"),
))


PARTIAL_DATES = rf"WITH grams AS ({GRAMS}), pb AS (SELECT *, regexp_replace(upper(text), '([0-9]+)', '<\1>', 'g') AS b FROM grams) SELECT doc_id, score, y, m, d FROM ({_PARTS}) a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, k, o, i) = 1"


@query("o_d17", PARTIAL_DATES)
def o_d17(t: Tables):
    p = D.choose_partial(F.col("grams"))
    return D.with_ngrams(t.fragments).select("doc_id", p.alias("p")).filter("p is not null").select("doc_id", "p.score", "p.y", "p.m", "p.d")
