"""Queries that write and read files, below the session's shared folder, and run kernels on rasters made from tables."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..sources import files
from .registry import Tables, query


def _folder(t: Tables) -> str:
    """A folder of its own in the shared one; a temporary one only where none is set and the session is local."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kilnmark-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("o_i4", "SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') AS image_id, coalesce(nullif(pred, 'NONE'), 'NONE') AS final_date FROM rungs WHERE rung_ord = 1")
def o_i4(t: Tables):
    rows = t.rungs.filter("rung_ord = 1").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("image_id"), F.nullif("pred", F.lit("NONE")).alias("final_date"))
    path = f"{_folder(t)}/csv"
    files.write_csv(rows, path)
    return files.csv(t.spark, path, files.strings("image_id", "final_date"), fill="NONE")


@query("o_i3", "SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name AS name FROM region")
def o_i3(t: Tables):
    path = f"{_folder(t)}/csv"
    files.write_csv(t.region.select(F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("name")), path, bom=True)
    return files.csv(t.spark, path, files.strings("k", "name"))


@query("o_i5", "SELECT CAST(n_nationkey AS VARCHAR) AS file, n_name AS value FROM nation")
def o_i5(t: Tables):
    path = f"{_folder(t)}/json"
    one = t.nation.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.col("n_name")))).alias("labels"))  # 25 rows
    files.write_json(one, path)
    return files.json_map(t.spark, path, "labels")


@query("o_i6", "SELECT doc_id, quality FROM labels WHERE toxic = 1")
def o_i6(t: Tables):
    path = f"{_folder(t)}/jsonl"
    files.write_json(t.labels.withColumn("ok", F.col("toxic") == 1), path)
    return files.json_lines(t.spark, path, "doc_id long, quality int, ok boolean", only_ok=True).select("doc_id", "quality")


@query("o_i7", "SELECT doc_id, quality FROM labels")
def o_i7(t: Tables):
    path = f"{_folder(t)}/jsonl"
    t.labels.select(F.concat(F.lit(files.BOM), F.to_json(F.struct("doc_id", "quality"))).alias("value")).write.text(path)
    return files.json_lines(t.spark, path, "doc_id long, quality int")


@query("o_i8", "SELECT c_name, c_mktsegment FROM customer")
def o_i8(t: Tables):
    path = f"{_folder(t)}/csv"
    files.write_csv(t.customer.select("c_name", "c_mktsegment"), path)
    return files.csv(t.spark, path, files.strings("c_name", "c_mktsegment"))


@query("o_i9", "SELECT doc_id, text FROM texts")
def o_i9(t: Tables):
    path = f"{_folder(t)}/json"
    files.write_json(t.texts.select("doc_id", "text"), path)
    return t.spark.read.schema("doc_id bigint, text string").json(path)


@query("o_i10", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def o_i10(t: Tables):
    path = f"{_folder(t)}/cache"
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    files.scan_once(counts, path)
    return files.scan_once(counts, path)


@query("o_i13", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def o_i13(t: Tables):
    path = f"{_folder(t)}/vectors"
    t.embeddings.select("vec_id", F.col("embedding").cast("array<float>").alias("v")).write.parquet(path)
    return t.spark.read.schema("vec_id bigint, v array<float>").parquet(path).select("vec_id", F.size("v").alias("n"))


@query("o_i20", "SELECT 'f' || CAST(r_regionkey AS VARCHAR) || '.jpg' AS file FROM region")
def o_i20(t: Tables):
    path = f"{_folder(t)}/report"
    t.region.select(F.concat(F.lit("| `f"), F.col("r_regionkey").cast("string"), F.lit(".jpg` | x |")).alias("value")).write.text(path)
    return files.report_keys(t.spark, path)


@query("o_g4")
def o_g4(t: Tables):
    """Quality of an 8 by 8 raster for each vector."""
    import numpy as np

    from ..operators.vision import quality

    def run(batches):
        for df in batches:
            rows = []
            for k, v in zip(df["vec_id"], df["embedding"], strict=True):
                x = np.resize(np.asarray(v, float), 64)
                x = ((x - x.min()) / max(1e-9, x.max() - x.min()) * 255).astype(np.uint8).reshape(8, 8)
                rows.append({"vec_id": k, **quality(x)})
            yield pd.DataFrame(rows)

    return t.embeddings.select("vec_id", "embedding").mapInPandas(run, "vec_id long, sharpness double, brightness double, contrast double, dark_frac double, blown_frac double, phash string")
