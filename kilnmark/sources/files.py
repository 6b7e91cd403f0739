"""Readers and writers of images, label tables, JSON documents and reports; every schema is explicit."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
BOM = "﻿"


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LABELS = strings("image_id", "year", "month", "day", "final_date", "split", "source_file")
SUBMISSION = strings("image_id", "year", "month", "day", "final_date")


#: Each ending in any case.
_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in IMAGE_TYPES) + "}"


def _name(path: Column | str) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def _stem(path: Column | str) -> Column:
    return F.regexp_replace(_name(path), r"\.[^.]+$", "")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, image_id (file stem, as text), length, content of image files of known types, dot files left out, by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", _GLOB).option("recursiveFileLookup", "true").load(folder)
    return files.filter(~_name("path").startswith(".")).select("path", _stem("path").alias("image_id"), "length", "content").orderBy("path")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, image_id, height, width, channels, data (rows of pixels, blue first) of the same files, decoded by the JVM;
    one that can't be read keeps its row, with nulls."""
    files = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", _GLOB).option("recursiveFileLookup", "true").load(folder)
    path, good = F.col("image.origin"), F.col("image.height") > 0
    parts = [F.when(good, F.col(f"image.{c}")).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    return files.filter(~_name(path).startswith(".")).select(path.alias("path"), _stem(path).alias("image_id"), *parts)


def _without_bom(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip(BOM))


def csv(spark: SparkSession, path: str, schema: T.StructType, fill: str | None = None) -> DataFrame:
    """CSV with a header, all columns as given (text stays text, so that 000001 isn't 1); a byte order mark is dropped."""
    df = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("encoding", "UTF-8").csv(path)
    first = df.columns[0]
    df = _without_bom(df).withColumn(first, F.ltrim(F.regexp_replace(first, BOM, "")))
    return df.fillna(fill) if fill is not None else df


def json_map(spark: SparkSession, path: str, field: str, value: str = "string") -> DataFrame:
    """(file, value) rows of an object keyed by file in one field of a JSON document."""
    schema = f"{field} map<string,{value}>"
    doc = spark.read.option("multiLine", "true").schema(schema).json(path)
    return doc.select(F.explode(field).alias("file", "value"))


def membership(spark: SparkSession, path: str, field: str = "membership") -> DataFrame:
    """(set, file) rows."""
    return json_map(spark, path, field, "array<string>").select(F.col("file").alias("set"), F.explode("value").alias("file"))


def json_lines(spark: SparkSession, path: str, schema: str, only_ok: bool = False) -> DataFrame:
    """JSON lines, a byte order mark and blank lines dropped; with ``only_ok`` the rows whose ok is true."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", BOM, "")).alias("v")).filter("v <> ''")
    rows = lines.select(F.from_json("v", schema).alias("r")).select("r.*")
    return rows.filter("ok") if only_ok else rows


def report_keys(spark: SparkSession, path: str, ending: str = ".jpg") -> DataFrame:
    """File names in the first, back-quoted cell of a Markdown report's table rows."""
    cell = F.get(F.split("value", "`"), 1)
    return spark.read.text(path).filter(F.col("value").rlike(r"^\|\s*`")).select(cell.alias("file")).filter(F.col("file").endswith(ending))


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """A folder of CSV files with headers; with ``bom`` the first header begins with a byte order mark."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scan_once(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` if there is one, else ``df`` written there: what is costly is computed once."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Rows dealt by a hash of the key into ``shard=0..`` folders; the same key always goes to the same one."""
    df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards))).write.mode("overwrite").partitionBy("shard").parquet(path)


def markdown(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A report table of a small result, at most ``limit`` rows."""
    found = rows.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in found]) + "\n"


def gallery(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A page with the rows as a JSON payload, which can't end its script element."""
    payload = json.dumps([r.asDict(recursive=True) for r in rows.limit(limit).collect()], ensure_ascii=False, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><div id='g'></div><script>const rows={payload};g.innerHTML=rows.map(r=>'<pre></pre>').join('');[...g.children].forEach((e,i)=>e.textContent=JSON.stringify(rows[i],null,1))</script>"


def settings(defaults: dict[str, str], prefix: str = "KILNMARK_", environment: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Defaults, overridden by environment variables of the same names in upper case behind the prefix."""
    return {k: environment.get(prefix + k.upper(), v) for k, v in defaults.items()}


def file_target(kind: Column, key: Column, truth: Column, pred: Column, ending: str = ".jpg") -> Column:
    """Relative path under which a copy of a file is filed."""
    return F.concat(kind, F.lit("/"), key.cast("string"), F.lit("_"), truth, F.lit("_"), pred, F.lit(ending))
