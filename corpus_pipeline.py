"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, packing.

Each stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnmark.llm import decontaminate, linededup, toxicity
from kilnmark.llm._shared import Scratch
from kilnmark.llm.jaccard import jaccard_components
from kilnmark.llm.packing import packed_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; n_chars follows the text. A document that loses its whole text goes too:
    every line of it is in the corpus already. Documents that lost nothing stay as they are, empty ones included."""
    out = linededup.dedup_lines(docs)
    left = out.filter("n_removed = 0 or length(trim(BOTH ' \t\n\r' FROM text)) > 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard 0.8 over five-word shingles the one with the least doc_id stays.

    Documents without words, and rows without a doc_id, are in no group and stay; rows of one doc_id go or stay together."""
    members = jaccard_components(docs.filter("doc_id is not null"))
    gone = members.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a benchmark text was found go, whatever their doc_id is; null and empty texts stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their place in a sequence of 4096; a null or empty text is its end id alone."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the model nor the tokenizer; tests/llm holds the stages and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again as the next one's input,
    and goes when that one's result is written."""
    scratch = Scratch(spark, "pipeline")
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if held is not None:
            scratch.drop(held)
        held = docs
    return docs
