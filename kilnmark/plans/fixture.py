"""Label texts, rung predictions and boxes derived from the ``orders`` table by arithmetic.

The SQL is in the common subset of Spark and DuckDB, so that both sides of a comparison start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRUTH = """
SELECT k AS doc_id, lpad(CAST(year(t) AS VARCHAR(4)), 4, '0') AS ty, lpad(CAST(month(t) AS VARCHAR(2)), 2, '0') AS tm, lpad(CAST(day(t) AS VARCHAR(2)), 2, '0') AS td,
  substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(3 * month(t) - 2 AS INTEGER), 3) AS mon, k % 24 AS variant, CASE k % 6 WHEN 0 THEN 'tuning' WHEN 1 THEN 'holdout1' WHEN 2 THEN 'holdout2' WHEN 3 THEN 'holdout3' WHEN 4 THEN 'holdout4' ELSE 'holdout5' END AS split, p AS price
FROM (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) + INTERVAL 300 MONTH AS DATE) AS t, o_totalprice AS p FROM {orders}) q
"""

#: One label text a document: 24 renderings of its date.
TEXTS = f"""
SELECT doc_id, ty, tm, td, split, variant, CASE variant
  WHEN 0 THEN '소비기한 ' || ty || '.' || tm || '.' || td || ' 까지' WHEN 1 THEN 'EXP ' || ty || '.' || tm || td WHEN 2 THEN ty || tm || '.' || td || 'm'
  WHEN 3 THEN 'BEST BEFORE ' || td || '/' || tm || '/' || ty WHEN 4 THEN 'BEST BEFORE ' || td || ' ' || tm || ' ' || ty WHEN 5 THEN ty || '/' || mon || '/' || td
  WHEN 6 THEN mon || ' ' || td || ', ' || ty WHEN 7 THEN 'USE BY ' || td || mon || substr(ty, 3, 2) WHEN 8 THEN td || ' ' || mon || ' ' || ty
  WHEN 9 THEN mon || td || ' ' || substr(ty, 3, 2) WHEN 10 THEN '유통기한 ' || substr(ty, 3, 2) || '.' || tm || '.' || td WHEN 11 THEN 'EXP ' || td || ' ' || tm || ' ' || substr(ty, 3, 2)
  WHEN 12 THEN 'BB ' || ty || tm || td WHEN 13 THEN substr(ty, 3, 2) || tm || td WHEN 14 THEN 'EXP: ' || tm || '/' || ty WHEN 15 THEN 'BEST BY ' || tm || '/' || substr(ty, 3, 2)
  WHEN 16 THEN tm || ' ' || ty WHEN 17 THEN '까지 ' || tm || '.' || td WHEN 18 THEN '제조일 ' || ty || '.' || tm || '.' || td
  WHEN 19 THEN ty || '.C' || substr(tm, 2, 1) || '.' || td WHEN 20 THEN 'LOT 20130628332176 880' || td || '123' WHEN 21 THEN '내용량 500g 355kcal 12%'
  WHEN 22 THEN '부터 ' || ty || '-' || tm || '-' || td || ' MFG' ELSE ty || '.' || tm || ' 22:14' END AS text
FROM ({TRUTH}) v
"""

#: One to three ordered fragments a document, so that neighbours have to be joined again.
FRAGMENTS = f"""
SELECT doc_id, CAST(1 AS INTEGER) AS pos, substr(text, 1, 6) AS text FROM ({TEXTS}) x WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, CAST(2 AS INTEGER), substr(text, 7) FROM ({TEXTS}) x WHERE doc_id % 5 = 0 AND length(text) > 6
UNION ALL SELECT doc_id, CAST(1 AS INTEGER), text FROM ({TEXTS}) x WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, CAST(3 AS INTEGER), '제조일자 ' || CAST(CAST(ty AS INTEGER) - 1 AS VARCHAR(4)) || '.' || tm || '.' || td FROM ({TEXTS}) x WHERE doc_id % 7 = 0
"""

#: Predictions of eight rungs with their seconds: right, nothing, or wrong in one of several ways.
RUNGS = f"""
SELECT doc_id, split, rung_ord, 'r' || CAST(rung_ord AS VARCHAR(2)) AS rung, ty, tm, td, ty || '-' || tm || '-' || td AS truth,
  CASE o WHEN 0 THEN ty || '-' || tm || '-' || td WHEN 1 THEN 'NONE' WHEN 2 THEN CAST(CAST(ty AS INTEGER) + 1 AS VARCHAR(4)) || '-' || tm || '-' || td
    WHEN 3 THEN ty || '-' || td || '-' || tm WHEN 4 THEN ty || '-' || tm || '-NONE' WHEN 5 THEN 'NONE-' || tm || '-' || td WHEN 6 THEN ty || '-' || tm || '-01' ELSE '20' || td || '-' || tm || '-' || substr(ty, 3, 2) END AS pred,
  CAST((doc_id * (rung_ord + 3)) % 97 AS DOUBLE) / 50.0 AS sec
FROM (SELECT v.*, rung_ord, CASE WHEN (doc_id * (rung_ord + 7) + rung_ord) % 10 < 4 + rung_ord % 4 THEN 0 ELSE 1 + (doc_id / 3 * 3 % 100 + rung_ord) % 7 END AS o
  FROM (SELECT doc_id, split, ty, tm, td FROM ({TRUTH}) w) v CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) r(rung_ord)) z
"""

#: Text boxes in rows of an image, ten images for each hundred line items.
BOXES = """
SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(l_partkey % 90 AS VARCHAR(4)) AS text, CAST(l_partkey % 4 AS DOUBLE) * 30 + CAST(l_suppkey % 5 AS DOUBLE) AS cy, CAST(10 + l_quantity % 7 AS DOUBLE) AS h,
  CAST(l_linenumber AS DOUBLE) * 40 + CAST(l_partkey % 11 AS DOUBLE) AS x0, CAST(l_linenumber AS DOUBLE) * 40 + 25 + CAST(l_suppkey % 13 AS DOUBLE) AS x1 FROM {lineitem}
"""


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the above over the Parquet tables of ``sf_dir``."""
    names = [n for n in ("orders", "lineitem") if "{" + n + "}" in sql]
    return spark.sql(sql.replace("doc_id / 3 * 3", "doc_id div 3 * 3"), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def cte(sql: str) -> str:
    """The same as text for the other engine, whose views have the tables' names."""
    return sql.replace("{orders}", "orders").replace("{lineitem}", "lineitem").replace("doc_id / 3 * 3", "doc_id // 3 * 3")
