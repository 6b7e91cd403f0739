"""Document fingerprints: bottom-k sketches of word-shingle hashes, with native column expressions only.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's shingles. Sketches merge by union,
and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Hashes in a sketch, words in a shingle; rows in a block of the neighbour search, about.
K, WIDTH, BLOCK = 128, 5, 512
#: Blocks are cut at quantiles of quantiles; so many of each at most, so FAN * FAN blocks.
FAN = 256
_BLANK = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words of a text; none for a null or blank one."""
    trimmed = F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, r"[ \t-\r]+"), lambda w: F.xxhash64(w)))


def sketch_of_hashes(hashes: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of an array of word hashes; fewer words than ``width`` are one shingle."""
    n = F.size(hashes)
    rolled = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))
    short = F.array(F.xxhash64(hashes))
    every = F.when(n >= width, rolled).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def with_sketch(df: DataFrame, text: str, into: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of ``text``; a null text is an empty one, with an empty sketch. Other columns stay."""
    held = f"__{into}_words"
    return df.withColumn(held, word_hashes(F.col(text))).withColumn(into, sketch_of_hashes(F.col(held), k, width)).drop(held)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1: the share of the union's sketch that both have. Two empty texts have 1."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th least hash as a share of the range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    union = distinct_count(merged(a, b, k), k)
    inter = resemblance(a, b, k) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inter / distinct_count(a, k)))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, ascending; empty for an empty text."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merge_sketches(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch) of the union of each key's sketches, e.g. of a table's parts.

    Hashes are made distinct before the k least of each key are kept, first within each task; a key with any number
    of rows brings a task at most k hashes from each other task. Null sketches count as empty; a null key is a group."""
    hashes = df.select(F.col(key).alias("key"), F.explode_outer(sketch).alias("h")).groupBy("key", "h").agg(F.lit(1).alias("x"))
    kept = hashes.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("h")))).filter(F.col("r") <= k)
    return kept.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list("h")).alias(sketch))  # a null h is left out


def order_value(key: Column, tie: Column) -> Column:
    """A double that never falls as (key, tie) rises: equal ones are told apart by ``tie`` (0 to 2**60) where a double can."""
    exact = key.between(-(2**53), 2**53)
    return key.cast("double") * F.lit(2.0**60) + F.when(exact, tie.cast("double")).otherwise(F.lit(0.0))


def _above(bounds: Column, value: Column) -> Column:
    """How many of the bounds are at or below the value."""
    return F.size(F.filter(bounds, lambda b: b <= value))


def blocks(keys: DataFrame) -> tuple[DataFrame, list[float]]:
    """Block bounds from a written table of order values (v): (cut, bounds) rows, one for each of FAN first cuts, and
    the bounds of these. Quantile sketches merge, so no task sees all values; both results have FAN entries a row at most."""
    n = keys.count()
    fan = max(1, min(FAN, round((n / BLOCK) ** 0.5)))
    shares = [i / fan for i in range(1, fan)]
    if not shares:
        return keys.sparkSession.range(1).select(F.lit(0).alias("cut"), F.array().cast("array<double>").alias("bounds")), []
    coarse = sorted(set(keys.agg(F.percentile_approx("v", shares, 8 * FAN).alias("b")).first()["b"]))
    cut = _above(F.array(*map(F.lit, coarse)), F.col("v"))
    fine = keys.groupBy(cut.alias("cut")).agg(F.array_distinct(F.percentile_approx("v", shares, 8 * FAN)).alias("bounds"))
    return fine, coarse


def next_texts(docs: DataFrame, k: int = K, width: int = WIDTH, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with sketch, next_text and next_sketch, those of the next row by ascending doc_id.

    Ids are taken to be unique; rows of one id go by the hash of their text. A null id counts as -1. The last row's
    next is the first; a sole row is its own next. Rows are dealt once, by blocks of neighbours cut at quantiles of
    the ids as they are (and within an id that very many rows have, by the texts' hashes), so that ids of any spread
    make blocks of like size; only the first row of each block is looked up besides, for the last row of the one before."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-1).cast("long"))).withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 4))
    docs = docs.withColumn("v", order_value(F.col("key"), F.col("tie")))
    scratch = scratch or Scratch(docs.sparkSession, "neighbours")
    keys = scratch.cut(docs.select("key", "tie", "v"), "keys")
    fine, coarse = blocks(keys)
    cut = _above(F.array(*map(F.lit, coarse)), F.col("v")) if coarse else F.lit(0)
    fine = F.broadcast(scratch.cut(fine, "bounds"))  # FAN rows of FAN bounds

    def placed(df):
        return df.withColumn("cut", cut).join(fine, "cut").withColumn("block", F.col("cut") * FAN + _above(F.col("bounds"), F.col("v"))).drop("cut", "bounds", "v")

    docs = placed(docs)
    w = Window.orderBy("block")  # FAN * FAN rows at most, as are the tables that follow from it
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = placed(keys).groupBy("block").agg(F.min(F.struct("key", "tie")).alias("head"))
    heads = scratch.cut(heads.select("block", F.coalesce(F.lead("head").over(w), F.min("head").over(whole)).alias("after")), "heads")
    first = docs.join(F.broadcast(heads.select(F.col("after.key").alias("key"), F.col("after.tie").alias("tie"))), ["key", "tie"], "left_semi").groupBy("key", "tie").agg(F.min("text").alias("text"))
    first = with_sketch(first, "text", "sketch", k, width)
    wraps = heads.select("block", "after.key", "after.tie").join(first, ["key", "tie"]).select("block", F.struct("text", "sketch").alias("wraps"))
    inner = with_sketch(docs, "text", "sketch", k, width)
    inner = inner.withColumn("follows", F.lead(F.struct("text", "sketch")).over(Window.partitionBy("block").orderBy("key", "tie", "text")))
    full = inner.join(wraps, "block", "left").withColumn("follows", F.coalesce("follows", "wraps"))
    return full.select("doc_id", "text", "sketch", F.col("follows.text").alias("next_text"), F.col("follows.sketch").alias("next_sketch"))


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct.
    Null and empty texts have empty fingerprints; two empty texts have likeness 1, an empty and another one 0. Extra
    columns are ignored; an empty table gives an empty result; repeated rows come out as often."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = next_texts(rows, k, width).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch", k, width)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), distinct_count(F.col("sketch"), k).alias("n_distinct"),
    )
