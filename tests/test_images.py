"""Kernels on the rasters of whole tables against slow, plain versions."""

import math

import duckdb
import numpy as np
import pytest
from compare import same

from kilnmark.operators import vision
from kilnmark.plans import catalog, q_images


@pytest.fixture(scope="module")
def rasters(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return {r["vec_id"]: [[max(0, min(255, math.floor((r["embedding"][8 * y + x] + 0.5) * 255))) for x in range(8)] for y in range(8)] for r in rows}


def rows(spark, sf, name):
    return catalog.queries()[name](spark, sf).collect()


def pixels(text):
    return [int(x) for x in text.split(",")]


def plain_blur(g, sigma):
    r = max(1, int(3 * sigma))
    k = [math.exp(-i * i / (2 * sigma**2)) for i in range(-r, r + 1)]
    k = [x / sum(k) for x in k]
    at = lambda i: max(0, min(7, i))
    down = [[sum(k[j] * g[at(y + j - r)][x] for j in range(2 * r + 1)) for x in range(8)] for y in range(8)]
    return [[sum(k[j] * down[y][at(x + j - r)] for j in range(2 * r + 1)) for x in range(8)] for y in range(8)]


def test_preparations(spark, sf, rasters):
    got = {(r["vec_id"], r["name"]): pixels(r["px"]) for r in rows(spark, sf, "o_g3_preparations")}
    assert len(got) == len(rasters) * len(vision.PREPARATIONS)
    for k, g in list(rasters.items())[::25]:
        flat = [v for row in g for v in row]
        assert got[k, "gray"] == flat and got[k, "inverse"] == [255 - v for v in flat]
        soft = [v for row in plain_blur(g, 25) for v in row]
        assert all(abs(a - min(255, v / max(s, 1) * 128)) <= 1 for a, v, s in zip(got[k, "flatten"], flat, soft, strict=True))
        soft = [v for row in plain_blur(g, 2) for v in row]
        assert all(abs(a - max(0, min(255, 2 * v - s))) <= 1 for a, v, s in zip(got[k, "unsharp"], flat, soft, strict=True))


def plain_otsu(values):
    def between(t):
        low, high = [v for v in values if v <= t], [v for v in values if v > t]
        return len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2 if low and high else -1

    return max(range(256), key=lambda t: (round(between(t), 3), -t))


def test_box_features(spark, sf, rasters):
    for r in rows(spark, sf, "o_g7"):
        k, g = r["vec_id"], rasters[r["vec_id"]]
        (x, y), _, (x1, y1), _ = q_images._quad(k)[0]
        w, h = x1 - x, y1 - y
        c = [[g[b][a] for a in range(x, x1)] for b in range(y, y1)]
        if h >= 1.5 * w:
            c = [[c[b][w - 1 - a] for b in range(h)] for a in range(w)]
        flat = [v for row in c for v in row]
        mean = sum(flat) / len(flat)
        var = sum((v - mean) ** 2 for v in flat) / len(flat)
        across = [abs(a - b) for row in c for a, b in zip(row, row[1:])]
        along = [abs(a - b) for p, q in zip(c, c[1:]) for a, b in zip(p, q, strict=True)]
        cut = plain_otsu(flat)
        ink = [sum(row[i] <= cut for row in c) / len(c) for i in range(len(c[0]))]
        steps = [abs(a - b) for a, b in zip(ink, ink[1:])]
        want = [w, h, w / h, (x + x1) / 16, (y + y1) / 16, w * h / 64, mean, var**0.5, sum(across) / len(across), sum(along) / len(along), sum(v <= cut for v in flat) / len(flat), var, sum(steps) / len(steps), x / 8, y / 8]
        assert r["features"] == pytest.approx(want), k


def plain_parts(mask, corners):
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    left, parts = {(y, x) for y in range(len(mask)) for x in range(len(mask[0])) if mask[y][x]}, []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            hit = {(y + a, x + b) for a, b in near} & left
            left -= hit
            part |= hit
            todo += hit
        parts.append(part)
    return parts


def test_strokes_and_dots(spark, sf, rasters):
    dots = {r["vec_id"]: r["dotness"] for r in rows(spark, sf, "o_g12")}
    for r in rows(spark, sf, "o_g10"):
        g = rasters[r["vec_id"]]
        cut = plain_otsu([v for row in g for v in row])
        dark = [[v <= cut for v in row] for row in g]
        # closing by 7 over 8 pixels leaves nothing open but what no window of print covers
        grown = [[any(dark[b][a] for b in range(max(0, y - 3), min(8, y + 4)) for a in range(max(0, x - 3), min(8, x + 4))) for x in range(8)] for y in range(8)]
        closed = [[all(grown[b][a] for b in range(max(0, y - 3), min(8, y + 4)) for a in range(max(0, x - 3), min(8, x + 4))) or dark[y][x] for x in range(8)] for y in range(8)]
        assert dots[r["vec_id"]] == pytest.approx(len(plain_parts(dark, False)) / max(1, len(plain_parts(closed, False))))
        if sum(map(sum, dark)) > 32:
            dark = [[not v for v in row] for row in dark]
        blank = [(y, x) for y in range(8) for x in range(8) if not dark[y][x]]
        radii = sorted(max(min(math.dist(p, b) for b in blank) for p in part) for part in plain_parts(dark, True) if len(part) >= 4)
        assert r["stroke"] == pytest.approx(max(1.0, radii[len(radii) // 2]) if radii else 2.0)
        assert r["bands"] == 0 or sum(r["pieces"]) > 0


def test_characters():
    band = np.ones((10, 18), bool)
    band[:, 6] = band[:, 11] = False
    assert vision.split_wide(band, 0, 18, 10) == [(0, 6), (6, 5), (11, 7)]
    assert vision.split_wide(band, 2, 5, 10) == [(2, 5)]
    out = vision.fit_square(np.ones((20, 10), bool))
    assert out.shape == (48, 48) and np.flatnonzero(out.any(axis=1))[[0, -1]].tolist() == [4, 43] and np.flatnonzero(out.any(axis=0))[[0, -1]].tolist() == [14, 33]


def test_variants(spark, sf):
    got = rows(spark, sf, "o_g15")
    want = {k: (min(w, h) >= 3) for r in got for k in [r["vec_id"]] for _, w, h in [q_images._quad(k)]}
    assert all(want.values())
    flat = np.full((6, 4), 90, np.uint8)
    big, even = vision.crop_variants(flat)
    assert big.shape == (12, 8) and (big == 90).all() and even.shape == flat.shape
    sure = lambda v: ("2024", 0.9 if v.shape[0] > 6 else 0.5)
    assert vision.reread(flat, sure) is None and vision.reread(flat, sure, on=True) == "2024" and vision.reread(flat, sure, on=True, least=0.95) is None
    assert vision.crop_variants(flat[:2]) == []


def test_borders_at_the_limit(spark, tmp_path):
    """Rows and columns whose deviation is 30 itself, where the order of adding decides."""
    rng = np.random.default_rng(30)
    lines = rng.integers(60, 160, (800_000, 8))
    lines = lines[8 * (lines**2).sum(1) - lines.sum(1) ** 2 == 8 * 8 * 900]
    assert len(lines) > 50
    flat = [np.vstack([np.full((2, 8), 7), x[None], rng.integers(0, 256, (5, 8))]) for x in lines]
    vectors = [((g.ravel() + 0.5) / 255 - 0.5).tolist() for g in flat + [g.T for g in flat]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(catalog.queries()["o_g5"](spark, str(tmp_path)), db, catalog.oracle_sql()["o_g5"])
