"""The registered queries of the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import round_trip

    return round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir), 3, Fraction(9, 10))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines removed, and length and hash of the text that is left."""
    from .linededup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    return predict(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir))


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def queries() -> dict:
    found = (
        op1_fingerprints, op2_best_fit_packing, op3_token_files, op4_benchmark_decontamination, op5_ngram_jaccard,
        op6_quality, op7_line_dedup, op8_language_id, op9_toxicity, op10_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of the ten, SQL can express the exact join alone: the others hash, tokenize, sample or learn."""
    return {"op5_ngram_jaccard": JACCARD_SQL}
