"""Image sources and kernels over whole tables: each vector is an 8 by 8 raster, each nation a file. The SQL works out the pixels on its own."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cascade as C
from ..sources import files
from ..streaming import budget
from .q_files import _folder
from .registry import Tables, query

SIDE = 8
_RASTER = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS DOUBLE) + 0.5) * 255))) AS INTEGER)) AS v FROM embeddings) e"


def _kernel(t: Tables, f: Callable[[int, object], list[dict]], schema: str) -> DataFrame:
    """``f`` of each vector's number and raster gives that vector's rows."""
    names = [c.split()[0] for c in schema.split(", ")]
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255))).cast("int")

    def run(batches):
        import numpy as np

        for df in batches:
            rows = [{"vec_id": k, **r} for k, v in zip(df["vec_id"], df["v"], strict=True) for r in f(k, np.asarray(v, np.uint8).reshape(SIDE, SIDE))]
            yield pd.DataFrame(rows, columns=names)

    return t.embeddings.select("vec_id", F.transform("embedding", pixel).alias("v")).mapInPandas(run, schema)


def _px(img) -> str:
    return ",".join(str(int(x)) for x in img.ravel())


def _listed(count: str, value: str) -> str:
    """The other engine's text of the values at places k from 0."""
    return f"array_to_string(list_transform(range(0, {count}), lambda k: CAST({value} AS INTEGER)), ',')"


@query("o_g1", f"SELECT vec_id, {_listed('16', 'floor((v[(k // 4) * 16 + (k % 4) * 2 + 1] + v[(k // 4) * 16 + (k % 4) * 2 + 2] + v[(k // 4) * 16 + (k % 4) * 2 + 9] + v[(k // 4) * 16 + (k % 4) * 2 + 10]) / 4.0 + 0.5)')} AS px FROM {_RASTER}")
def o_g1(t: Tables):
    from ..operators import vision

    return _kernel(t, lambda k, g: [{"px": _px(vision.downscale(g, 4))}], "vec_id long, px string")


_TURNS = {90: "v[(7 - k % 8) * 8 + k // 8 + 1]", 180: "v[64 - k]", 270: "v[(k % 8) * 8 + 8 - k // 8]"}


@query("o_g2", " UNION ALL ".join(f"SELECT vec_id, {d} AS degrees, {_listed('64', v)} AS px FROM {_RASTER}" for d, v in _TURNS.items()))
def o_g2(t: Tables):
    from ..operators import vision

    return _kernel(t, lambda k, g: [{"degrees": d, "px": _px(vision.turn(g, d))} for d in _TURNS], "vec_id long, degrees int, px string")


# A window of 31 over 8 pixels, the edge repeated: how often a row or column at place j counts for one at place i.
_WEIGHT = "(CASE WHEN {j} = 0 THEN 16 - {i} WHEN {j} = 7 THEN 9 + {i} ELSE 1 END)"
_MEAN = f"list_sum(list_transform(range(0, 64), lambda q: v[q + 1] * {_WEIGHT.format(i='(k // 8)', j='(q // 8)')} * {_WEIGHT.format(i='(k % 8)', j='(q % 8)')})) / 961.0"


@query("o_g3", f"SELECT vec_id, {', '.join(_listed('64', f'CASE WHEN v[k + 1] > {_MEAN} - {c} THEN 255 ELSE 0 END') + f' AS px{c}' for c in (11, 10))} FROM {_RASTER}")
def o_g3(t: Tables):
    from ..operators import vision

    return _kernel(t, lambda k, g: [{f"px{c}": _px(vision.PREPARATIONS[f"threshold_{c}"](g)) for c in (11, 10)}], "vec_id long, px11 string, px10 string")


@query("o_g3_preparations")
def o_g3_preparations(t: Tables):
    """All preparations by name."""
    from ..operators import vision

    return _kernel(t, lambda k, g: [{"name": n, "px": _px(f(g))} for n, f in vision.PREPARATIONS.items()], "vec_id long, name string, px string")


_ROWS = "list_transform(range(0, 8), lambda r: list_stddev_pop(v[r * 8 + 1:r * 8 + 8]) >= 30)"
_COLS = "list_transform(range(0, 8), lambda c: list_stddev_pop(list_transform(range(0, 8), lambda r: v[r * 8 + c + 1])) >= 30)"
_RUN = "CAST(coalesce(nullif(list_position({x}, true), 0) - 1, 8) AS INTEGER)"


@query("o_g5", f"SELECT vec_id, {_RUN.format(x='a')} AS up, {_RUN.format(x='list_reverse(a)')} AS down, {_RUN.format(x='b')} AS l, {_RUN.format(x='list_reverse(b)')} AS r FROM (SELECT vec_id, {_ROWS} AS a, {_COLS} AS b FROM {_RASTER}) x")
def o_g5(t: Tables):
    from ..operators import vision

    return _kernel(t, lambda k, g: [dict(zip(("up", "down", "l", "r"), vision.uniform_border(g, 30.0), strict=True))], "vec_id long, up int, down int, l int, r int")


def _quad(k: int) -> tuple[list[list[int]], int, int]:
    """A box whose place and size depend on the number."""
    x, y, w, h = k % 3, k % 2, 2 + k % 4, 2 + k % 5
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]], w, h


_CROPPED = f"(SELECT *, vec_id % 3 AS x, vec_id % 2 AS y, 2 + vec_id % 4 AS w, 2 + vec_id % 5 AS h FROM {_RASTER})"


@query("o_g6", f"SELECT vec_id, CAST(CASE WHEN h >= 1.5 * w THEN w ELSE h END AS INTEGER) AS high, {_listed('w * h', 'CASE WHEN h >= 1.5 * w THEN v[(y + k % h) * 8 + x + w - k // h] ELSE v[(y + k // w) * 8 + x + k % w + 1] END')} AS px FROM {_CROPPED} c")
def o_g6(t: Tables):
    from ..operators import vision

    def cut(k, g):
        out = vision.crop(g, _quad(k)[0])
        return [{"high": out.shape[0], "px": _px(out)}]

    return _kernel(t, cut, "vec_id long, high int, px string")


@query("o_g7")
def o_g7(t: Tables):
    from ..operators import vision

    return _kernel(t, lambda k, g: [{"features": vision.box_features(g, _quad(k)[0]).tolist()}], "vec_id long, features array<double>")


@query("o_g10")
def o_g10(t: Tables):
    """Stroke width of the print on each raster, its bands of rows and the pieces a wide band is cut into."""
    from ..operators import vision

    def cut(k, g):
        ink = vision.printed(g)
        bands = vision.row_bands(ink)
        return [{"stroke": vision.stroke_width(ink), "bands": len(bands), "pieces": [n for a, b in bands for _, n in vision.split_wide(ink[a:b], 0, SIDE, b - a)]}]

    return _kernel(t, cut, "vec_id long, stroke double, bands int, pieces array<int>")


@query("o_g12")
def o_g12(t: Tables):
    from ..operators import vision

    return _kernel(t, lambda k, g: [{"dotness": vision.dotness(g)}], "vec_id long, dotness double")


@query("o_g15")
def o_g15(t: Tables):
    """Variants of each box, as they are read once more if that rung is asked for."""
    from ..operators import vision

    return _kernel(t, lambda k, g: [{"i": i, "high": x.shape[0], "px": _px(x)} for i, x in enumerate(vision.crop_variants(vision.crop(g, _quad(k)[0])))], "vec_id long, i int, high int, px string")


def _png(g) -> bytes:
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(r) for r in g)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(g[0]), len(g), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


_ENDINGS = [".jpg", ".JPEG", ".png", ".bmp", ".webp", ".tif", ".TIFF", ".txt"]


def _image_files(t: Tables) -> str:
    """A folder with one file for each of the 25 nations: a raster for the even ones, text for the others."""
    base = _folder(t)
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    for r in t.nation.select("n_nationkey", "n_name").collect():  # 25 rows
        k = r["n_nationkey"]
        raw = _png([[(k * 7 + i) % 256] * (k + 1) for i in range(k + 2)]) if k % 2 == 0 else r["n_name"].encode()
        at = jvm.org.apache.hadoop.fs.Path(f"{base}/{'a' if k % 3 else 'b'}/{k:06d}{_ENDINGS[k % 8]}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(raw))
        out.close()
    return base


@query("o_i1", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS image_id, n_nationkey % 2 = 1 AS same FROM nation WHERE n_nationkey % 8 < 7")
def o_i1(t: Tables):
    found = files.images(t.spark, _image_files(t)).select("image_id", "content", F.col("image_id").cast("int").alias("n_nationkey"))
    return found.join(t.nation, "n_nationkey").select("image_id", (F.col("content") == F.encode("n_name", "UTF-8")).alias("same"))


@query("o_i2", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS image_id, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 2 END AS INTEGER) AS height, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 END AS INTEGER) AS width, CAST(CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey + 1) * (n_nationkey + 2) END AS INTEGER) AS n FROM nation WHERE n_nationkey % 8 < 7")
def o_i2(t: Tables):
    """A file that can't be read keeps its row, without an image."""
    return files.decoded(t.spark, _image_files(t)).select("image_id", "height", "width", F.length("data").alias("n"))


@query("o_i11", "SELECT line, CASE line WHEN 0 THEN '# Regions' WHEN 2 THEN '| r_regionkey | r_name |' WHEN 3 THEN '| --- | --- |' ELSE '' END AS value FROM range(0, 4) r(line) UNION ALL SELECT 4 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def o_i11(t: Tables):
    text = files.markdown(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey"), "Regions")
    return t.spark.createDataFrame(list(enumerate(text.splitlines())), "line long, value string")


@query("o_i12", "SELECT n_nationkey, n_name || '</script>' AS name FROM nation")
def o_i12(t: Tables):
    """The rows read back from the page's payload; text that would end its script doesn't."""
    page = files.gallery(t.nation.select("n_nationkey", F.concat("n_name", F.lit("</script>")).alias("name")), "Nations")
    payload = F.regexp_extract(F.lit(page), r"const rows=(\[.*?\]);g\.inner", 1)
    return t.spark.range(1).select(F.inline(F.from_json(payload, "array<struct<n_nationkey:bigint,name:string>>")))


@query("o_i17", "SELECT split, count(*) AS n FROM truths WHERE split = 'holdout4' GROUP BY split")
def o_i17(t: Tables):
    """A setting that the environment overrides, and one that it doesn't."""
    read = files.settings({"split": "tuning", "unit": "doc_id"}, environment={"KILNMARK_SPLIT": "holdout4"})
    return t.truths.filter(F.col("split") == read["split"]).groupBy("split").agg(F.count(read["unit"]).alias("n"))


@query("o_i18", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS n, c_custkey % 7 = 0 AS failed, true AS absent FROM customer")
def o_i18(t: Tables):
    """One recogniser that reads, and fails on some; one that can't be loaded, whose stage gives nulls."""
    from ..operators import vision

    def load():
        def read(raw: bytes) -> list[str]:
            if int(raw) % 7 == 0:
                raise ValueError("unreadable")
            return [raw.decode()]

        return read

    known = vision.Registry()
    known.add("digits", load)
    rows = t.customer.select("c_custkey", F.col("c_custkey").cast("string").cast("binary").alias("content"))
    found = known.read(rows, "digits", "c_custkey").select("c_custkey", F.size("texts").alias("n"), F.col("error").isNotNull().alias("failed"))
    return found.join(known.read(rows, "not there", "c_custkey").select("c_custkey", F.col("texts").isNull().alias("absent")), "c_custkey")


_LEFT = "(SELECT doc_id, arg_min(pred, rung_ord) FILTER (WHERE NOT contains(pred, 'NONE')) AS f, arg_min(pred, rung_ord) FILTER (WHERE contains(pred, 'NONE') AND pred NOT IN ('NONE', 'NONE-NONE-NONE')) AS q FROM rungs WHERE {0} GROUP BY doc_id)"


@query("o_c10", f"SELECT a.doc_id, coalesce(a.f, a.q, 'NONE') AS pred, coalesce(b.f, b.q, 'NONE') AS asked FROM {_LEFT.format('rung_ord NOT IN (1, 3)')} a JOIN {_LEFT.format('rung_ord <> 3')} b USING (doc_id)")
def o_c10(t: Tables):
    """Two rungs that were rejected: off, and one of them asked for."""
    off = {"r1", "r3"}
    read = lambda on, name: C.cascade(C.offered(t.rungs, off, on), ["doc_id"]).select("doc_id", F.col("pred").alias(name))
    return read((), "pred").join(read(("r1",), "asked"), "doc_id")


@query("o_t4", "SELECT rung, k AS done, round(s, 6) AS elapsed FROM (SELECT rung, row_number() OVER w AS k, sum(sec) OVER w AS s FROM rungs WINDOW w AS (PARTITION BY rung ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) x WHERE k % 200 = 0")
def o_t4(t: Tables):
    return budget.snapshots(t.rungs, "rung", "doc_id", "sec")

