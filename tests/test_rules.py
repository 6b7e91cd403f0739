"""Golden texts, plain-Python twins of the folds, and properties of the text rules."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnmark.functions import dates as D
from kilnmark.functions import fallback as B
from kilnmark.functions import spans as S
from kilnmark.functions import text as T
from kilnmark.operators import boxes, cascade, vision
from kilnmark.streaming import budget


def test_made_only_by_plain_python(spark, sf):
    """o_d25 over all texts against the rule by re: the date stands in the text, and each time behind a word of manufacture."""
    from kilnmark.plans import catalog, fixture

    texts = fixture.table(spark, sf, fixture.TEXTS).collect()
    got = {r["doc_id"]: r["v"] for r in catalog.queries()["o_d25"](spark, sf).collect()}
    want = {}
    for r in texts:
        c = r["text"].replace("제조일", "제조") if r["doc_id"] % 2 else r["text"]
        found = [m.start() for y in (r["ty"], r["ty"][2:]) for m in re.finditer(rf"(?<!\d){y}\D{{0,2}}{r['tm']}\D{{0,2}}{r['td']}(?!\d)", c)]
        want[r["doc_id"]] = bool(found) and all(re.search(B.MADE, c[max(0, a - 12) : a]) for a in found)
    assert got == want and {True, False} == set(want.values())


@pytest.mark.parametrize(("text", "words"), [("제조2020.08.17", ["제조일자"]), ("제조: 2020", ["제조일자"]), ("소비기 한", ["소비기한"]), ("exp 2020", []), ("EXP. 2020", ["EXP"])])
def test_anchor_words(spark, text, words):
    assert one(spark, text, T.find_anchors) == words


def test_quantiles_and_shares_by_plain_python(spark):
    from kilnmark.operators import relational as R

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), np.array([7.0]), np.concatenate((np.zeros(4000), rng.random(50)))):
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
        for q in (0.3, 1.0):
            assert R.exact_quantile(df, "v", q).first()["v"] == pytest.approx(np.quantile(values, q))
        big = np.sort(np.abs(values))[::-1]
        need = int(np.argmax(np.cumsum(big) >= 0.9 * big.sum() - 1e-9)) + 1
        assert abs(R.rows_for_share(df.select(F.abs("v").alias("v")), "v", 0.9).first()["needed"] - need) <= 1
    assert R.exact_quantile(spark.createDataFrame([], "v double"), "v", 0.5).first()["v"] is None


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "date"),
    [
        ("소비기한 2026.08.19 까지", "2026-08-19"), ("EXP 2021.1117", "2021-11-17"), ("202512.20m", "2025-12-20"), ("24/12/2021", "2021-12-24"), ("BEST BEFORE 02 12 2021", "2021-12-02"),
        ("2022/JUN/14", "2022-06-14"), ("JUN 14, 2022", "2022-06-14"), ("08JUL24", "2024-07-08"), ("유통기한 25.03.01", "2025-03-01"), ("BB 20220930", "2022-09-30"), ("EXP 2020.C6.30", "2020-06-30"),
        ("제조일 2023.08.11", None), ("2026.08 22:14", None), ("2021-02-30", None), ("", None), ("LOT 20130628332176", None),
    ],
)
def test_primary_rules(spark, text, date):
    got = one(spark, text, lambda c: D.choose_date(F.array(c)).cast("string"))
    assert got == date


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("2026.08.19", ("2026", "08", "19")), ("품목 20130628332176", None), ("소비기한 26.08.19 까지", ("2026", "08", "19")), ("BEST 21.02.2026", ("2026", "02", "21")), ("AUG 3 2024", ("2024", "08", "03")),
        ("05.2023 D9482", ("2023", "05", None)), ("제조2020.08.17", None), ("까지 08.25", (None, "08", "25")), ("2024.01.15 제조 2023.01.15", ("2024", "01", "15")),
    ],
)
def test_fallback_rules(spark, text, parts):
    got = one(spark, text, B.select_date)
    assert (tuple(got) if got else None) == parts


def test_fallback_dates_of_the_fixture(spark, sf):
    """o_d27 by rendering; each step of the choice is planned once, and the texts of one file are dealt out."""
    from kilnmark.plans import catalog, fixture

    df = catalog.queries()["o_d27"](spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") <= 1
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r["doc_id"]: (r["y"], r["m"], r["d"]) for r in df.collect()}
    texts = fixture.table(spark, sf, fixture.TEXTS).collect()
    assert len(got) == len(texts)
    for r in texts:
        y, m, d = r["ty"], r["tm"], r["td"]
        want = {**dict.fromkeys((0, 3, 6, 8, 12, 22), (y, m, d)), 17: (None, m, d), 18: (None,) * 3, 21: (None,) * 3}
        if r["variant"] in want and (r["variant"] != 3 or int(d) > 12):
            assert got[r["doc_id"]] == want[r["variant"]], r["text"]


@pytest.mark.parametrize("text", [None, "", "1" * 40, "2026.08.19 " * 60, "제조2020.08.17 " * 3, "제조2020.08.17 / 2020.08.17", "제조2020.08.17 별도표기"])
def test_fallback_rules_of_odd_texts(spark, text):
    found = [m.groups() for m in re.finditer(B.PATTERNS[0][1], text or "")]
    made = found and "별도표기" not in text and "/" not in text and "제조" in text
    got = one(spark, text, B.select_date)
    assert (tuple(got) if got else None) == (found[0] if found and not made else None)
    spans = one(spark, text, lambda c: F.array_sort(B.find_dates(c)))
    assert (None if spans is None else [(x["s"], x["e"]) for x in spans]) == (None if text is None else [m.span() for m in re.finditer(B.PATTERNS[0][1], text)])


@pytest.mark.parametrize("name", [*D.PATTERNS])
def test_patterns_find_what_python_finds(spark, name):
    rng = np.random.default_rng(len(name))
    bits = ["20", "21", "2024", "2019", "08", "7", "31", "JAN", "DEC", ".", "/", "-", " ", "  ", ",", ":", "x", "1", "22"]
    texts = ["".join(rng.choice(bits, rng.integers(3, 12))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = D.PATTERNS[name][0]
    p = "(?U)" + pattern
    parts = F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(0)), lambda x: F.array(*[F.regexp_extract(x, p, g) for g in (1, 2, 3)]))
    got = {r["i"]: r["v"] for r in rows.select("i", parts.alias("v")).collect()}
    for i, t in enumerate(texts):  # a match read on its own has the groups that it has in its text
        assert got[i] == [list(m.groups()) for m in re.finditer(pattern, t)]


def test_spans_are_python_spans(spark):
    texts = ["12 345 6", "", "abc", "1a22b333", "９9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.find_spans(F.col("t"), r"\d+").alias("v")).collect()
    for r in rows:
        assert [(x["s"], x["e"]) for x in r["v"]] == [m.span() for m in re.finditer(r"\d+", r["t"])]


def test_barcode_order(spark):
    assert one(spark, "x 4006381333931", T.barcode_order) == "dmy"
    assert one(spark, "x 8801234567893", T.barcode_order) is None
    assert one(spark, "20130628332176", T.barcode_order) is None


def test_staged_equals_all_at_once(spark):
    todo = spark.range(100).withColumn("a", F.when(F.col("id") % 3 == 0, F.col("id"))).withColumn("b", F.when(F.col("id") % 2 == 0, -F.col("id")))
    got = cascade.staged(todo, [("one", lambda d: d.withColumn("v", F.col("a"))), ("two", lambda d: d.withColumn("v", F.col("b")))], "id", "v")
    expected = todo.select("id", F.coalesce("a", "b").alias("v"))
    assert sorted(map(tuple, got.select("id", "v").collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_partial_does_not_stop_the_cascade(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-NONE", 1.0), (1, 2, "2024-01-05", 2.0), (2, 1, "NONE", 1.0), (2, 2, "2024-NONE-NONE", 1.0)], "doc_id int, rung_ord int, pred string, sec double")
    got = {r["doc_id"]: (r["pred"], r["stage"], r["sec"]) for r in cascade.cascade(rows, ["doc_id"]).collect()}
    assert got == {1: ("2024-01-05", "rung2", 3.0), 2: ("2024-NONE-NONE", "partial", 2.0)}


def test_merge_lines(spark):
    rows = [(1, "20221", 10.0, 10.0, 0.0, 40.0), (1, "104", 11.0, 10.0, 45.0, 60.0), (1, "far", 10.0, 10.0, 200.0, 220.0), (1, "below", 50.0, 10.0, 0.0, 30.0), (1, "thin", 10.0, 0.5, 41.0, 44.0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, cy double, h double, x0 double, x1 double")
    assert [r["line"] for r in boxes.merge_lines(df).collect()] == ["20221104"]


def plain_lines(items, tolerance=0.6, gap=2.0):
    """Each box not yet in a row seeds one and takes all that fit, in order from the top."""
    items = sorted((b for b in items if b[1] >= 1), key=lambda b: (b[0], b[2], b[4], b[1], b[3]))
    used, out = set(), []
    for i, a in enumerate(items):
        if i in used:
            continue
        row = [j for j in range(i, len(items)) if j not in used and (j == i or abs(items[j][0] - a[0]) <= tolerance * max(a[1], items[j][1]) and 0.5 <= items[j][1] / a[1] <= 2)]
        used |= set(row)
        cells = sorted((items[j] for j in row), key=lambda b: b[2])
        cuts = [0, *[n for n in range(1, len(cells)) if cells[n][2] - cells[n - 1][3] > gap * max(cells[n - 1][1], cells[n][1])], len(cells)]
        out += ["".join(b[4] for b in cells[m:n]) for m, n in zip(cuts[:-1], cuts[1:], strict=True) if n - m > 1]
    return out


def test_merge_lines_by_plain_python(spark):
    """Images of few and of many boxes, some longer than an Arrow batch, without a Python call for each."""
    rng = np.random.default_rng(6)
    images = {k: [(float(rng.integers(0, 3 * n)), float(rng.choice([0, 1, 4, 7, 10, 16, 40])), x := float(rng.integers(0, 300)), x + float(rng.integers(1, 30)), str(i)) for i in range(n)] for k, n in enumerate([1, 2, 3, 5, 9, 20, 60, 300] * 5)}
    df = spark.createDataFrame([(k, *b) for k, bs in images.items() for b in bs], "doc_id long, cy double, h double, x0 double, x1 double, text string").repartition(5)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 37)
    try:
        merged = boxes.merge_lines(df)
        got = sorted(map(tuple, merged.collect()))
    finally:
        spark.conf.unset(size)
    assert got == sorted((k, line) for k, bs in images.items() for line in plain_lines(bs)) and len(got) > 150
    assert "InPandas" not in merged._jdf.queryExecution().executedPlan().toString()


def test_merge_lines_of_odd_boxes(spark):
    nan = float("nan")
    rows = [(1, "a", 1.0, 10.0, 0.0, 5.0), (1, None, 1.0, 10.0, 6.0, 8.0), (1, "b", 1.0, 10.0, 9.0, 12.0), (1, "x", nan, 10.0, 9.0, 12.0), (1, "y", 1.0, None, 9.0, 12.0), (None, "c", 1.0, 9.0, 0.0, 5.0), (None, "d", 2.0, 9.0, 6.0, 8.0)]
    df = spark.createDataFrame(rows, "doc_id int, text string, cy double, h double, x0 double, x1 double")
    assert {tuple(r) for r in boxes.merge_lines(df).collect()} == {(1, "ab"), (None, "cd")}


def test_budget_batch_equals_stream(spark, tmp_path):
    rows = [(r, i, 0.5 + (i * 7 % 11) / (2 if i > 60 else 20)) for r in ("a", "b") for i in range(120)]
    df = spark.createDataFrame(rows, "run string, i int, sec double")
    batch = {(r["run"], r["i"]): r["level"] for r in budget.levels(df, "run", "i", "sec", 60.0).collect()}
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, i int, sec double").json(str(tmp_path / "in"))
    out = budget.stream_levels(stream, "run", "i", "sec", 120, 60.0)
    q = out.writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["run"], r["i"]): r["level"] for r in spark.table("levels").collect()}
    assert got == batch and max(batch.values()) > 0


def test_image_kernels():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (60, 90, 3)).astype(np.uint8)
    g = vision.gray(img)
    assert vision.downscale(img, 45).shape == (30, 45, 3)
    assert vision.turn(img, 90).shape == (90, 60, 3)
    for f in vision.PREPARATIONS.values():
        assert f(g).shape == g.shape
    assert set(vision.quality(img)) == {"sharpness", "brightness", "contrast", "dark_frac", "blown_frac", "phash"}
    flat = np.zeros((20, 20), np.uint8)
    flat[5:15, 5:15] = rng.integers(0, 256, (10, 10))
    assert vision.uniform_border(flat) == (5, 5, 5, 5)
    assert vision.crop(g, [[0, 0], [10, 0], [10, 40], [0, 40]]).shape == (10, 40)
    canvas, scale, x, y = vision.letterbox(img, 64)
    assert canvas.shape == (64, 64, 3) and x == 0 and y > 0 and scale < 1
    assert vision.row_bands(np.array([[0]] * 5 + [[9]] * 5 + [[0]] * 5)) == [(5, 10)]
    assert vision.box_features(img, [[0, 0], [20, 0], [20, 10], [0, 10]]).shape == (15,)
    dots = np.full((30, 60), 255, np.uint8)
    dots[10:20:3, 5:55:3] = 0
    solid = np.full((30, 60), 255, np.uint8)
    solid[10:20, 5:55] = 0
    assert vision.dotness(dots) > 3 > vision.dotness(solid)


def test_recogniser_registry(spark):
    df = spark.createDataFrame([("1", b"ok"), ("2", b"bad")], "image_id string, content binary")
    reg = vision.Registry()

    def load():
        def read(raw):
            if raw == b"bad":
                raise ValueError("unreadable")
            return ["2024.01.02"]

        return read

    reg.add("fake", load)
    got = {r["image_id"]: (r["texts"], r["error"]) for r in reg.read(df, "fake").collect()}
    assert got["1"] == (["2024.01.02"], None) and got["2"][0] == [] and "unreadable" in got["2"][1]
    assert all(r["texts"] is None for r in reg.read(df, "absent").collect())
