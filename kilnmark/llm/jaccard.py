"""N-gram Jaccard join with multiple-global-order prefix filters.

Every document is its set of distinct word shingles. Two sets with Jaccard likeness of at least t share a token
within their prefixes of ``n - ceil(t*n) + 1`` tokens under *any* global token order. Three orders are used: exact
rarity, rarity by powers of two, and one that has nothing to do with rarity. The prefix tokens of the first are the
buckets; a pair that meets there must have common bits in the maps of its prefixes under the other two, and a common
token under all three, before it is verified.

How the plan scales:

* Equal sets are one *class* (key: a 64-bit hash of the set); classes are told apart from the start, so that copies
  cost one row per task and never meet as pairs.
* A fixed-size table of counts (2**16 buckets, from all documents) finds very common tokens before anything is
  shuffled by token; those keep that count as their place in the orders and never become a shuffle key.
* Other tokens go once through a shuffle as sorted arrays, dealt by ranges of the hash; what returns to a class are
  its tokens that some other class has too. A token that no other class has can't be shared: classes whose prefix
  holds only such tokens are done, and overlaps of the others are exact on the shared tokens alone.
* Within the bucket of a prefix token, pairs are compared in blocks of bounded size by bit-parity sketches: the
  number of differing bits never exceeds the symmetric difference, so a pair that differs in too many can't link.
  Sketches grow with the sets, so that they tell long texts apart as well as short ones.
  What a block emits at first is a spanning forest over the classes, not its pairs; these are verified exactly and
  links merge components. Then only pairs between different components are left, and of those all whose sketches can't
  tell are verified: components are those of all links.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._links import linked
from ._shared import Scratch, join_by_size
from ._text import U, mix

#: Fixed parameters: buckets of the count table, bits of the shortest parity sketch and of a map of prefix tokens.
LOG_BUCKETS, SKETCH_BITS, MAP_BITS = 16, 1024, 512
SLOTS = 16
_ORDERS = 3


def _least_overlap_size(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t * n), exactly."""
    return -((-n.astype(np.int64) * t.numerator) // t.denominator)


def class_key(tokens: np.ndarray) -> int:
    """Of a sorted distinct set; 0 is kept for the empty set."""
    if not len(tokens):
        return 0
    h = mix((tokens * (mix(np.arange(len(tokens), dtype=U)) | U(1))).sum(dtype=U, keepdims=True) + U(len(tokens)))
    return int(h.view(np.int64)[0]) or 1


def _scan(width: int):
    """Per document its class and set size; per task the bucket counts of the tokens of its distinct classes."""

    def run(batches):
        counts = np.zeros(1 << LOG_BUCKETS, np.int64)
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            keys, sizes = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for lo, hi, data, offsets in _text.chunks(texts):
                fresh = []
                for i, s in enumerate(_text.shingle_sets(data, offsets, width), lo):
                    keys[i], sizes[i] = class_key(s), len(s)
                    if len(s) and keys[i] not in seen:
                        seen.add(int(keys[i]))
                        fresh.append(s)
                if fresh:
                    counts += np.bincount((np.concatenate(fresh) >> U(64 - LOG_BUCKETS)).astype(np.int64), minlength=1 << LOG_BUCKETS)
            none = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int32()), ids, pa.array(keys), pa.array(sizes), none], names=["slot", "doc_id", "class", "n", "counts"])
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLOTS, -1)] if counts.any() else []
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), none, none, none, pa.array(parts, pa.binary())], names=["slot", "doc_id", "class", "n", "counts"])

    return run


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
    return pa.table({"slot": table.column("slot").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _bucket_counts(scan: DataFrame, spark) -> np.ndarray:
    """The counts over all tasks, added in two steps; 512 KB whatever the input."""
    parts = scan.filter("slot is not null").select("slot", "counts", (F.spark_partition_id() % 32).alias("lane"))
    first = parts.groupBy("slot", "lane").applyInArrow(_add_counts, "slot int, counts binary")
    rows = first.groupBy("slot").applyInArrow(_add_counts, "slot int, counts binary").collect()
    counts = np.zeros((SLOTS, (1 << LOG_BUCKETS) // SLOTS), np.int64)
    for r in rows:
        counts[r["slot"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return counts.reshape(-1)


def _deal(width: int, ranges: int, blocks: int, common: np.ndarray):
    """Tokens of each distinct class of a task: by hash range, or, if common, at once by the class's block.

    Rows: key (range, or -1 - block), tokens, classes, and for a range the places of each token's class in classes,
    for a block the set size of each header (else 0)."""

    def rows_of(key, toks, classes, each, cuts):
        out = []
        for r in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[r], cuts[r + 1]
            out.append((int(key(r)), toks[a:b].tobytes(), classes(r, a, b), each[a:b].tobytes()))
        return out

    def run(batches):
        seen: set[int] = set()
        shift = np.zeros(0)
        for batch in batches:
            texts = batch.column(1)
            for _, _, data, offsets in _text.chunks(texts, 2 << 20):
                sets, keys = [], []
                for s in _text.shingle_sets(data, offsets, width):
                    k = class_key(s)
                    if len(s) and k not in seen:
                        seen.add(k)
                        sets.append(s)
                        keys.append(k)
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets])
                toks, own = np.concatenate(sets), np.array(keys, np.int64).view(U)
                cls = np.repeat(own, sizes)
                hot = common[(toks >> U(64 - LOG_BUCKETS)).astype(np.int64)]
                out = []
                rest, rest_cls = toks[~hot], np.repeat(np.arange(len(own)), sizes)[~hot]
                order = np.argsort(rest, kind="stable")
                rest, rest_cls = rest[order], rest_cls[order]
                place = (((rest >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)
                # a row names only the classes that it refers to
                used, back = np.unique((place << 32) | rest_cls, return_inverse=True)
                first = np.searchsorted(used >> 32, np.arange(ranges + 1))
                names, back = own[used & 0xFFFFFFFF], (back - first[place]).astype("<u2" if len(own) < 1 << 16 else "<u4")
                out += rows_of(lambda r: r, rest, lambda r, a, b: names[first[r] : first[r + 1]].tobytes(), back, np.searchsorted(place, np.arange(ranges + 1)))
                # the headers (token 0 with n) and the common tokens, by class
                to = np.concatenate((np.zeros(len(own), U), toks[hot]))
                tc = np.concatenate((own, cls[hot]))
                tn = np.concatenate((sizes, np.zeros(int(hot.sum()), np.int64))).astype("<i4")
                block = (tc % U(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                to, tc, tn = to[order], tc[order], tn[order]
                out += rows_of(lambda r: -1 - r, to, lambda r, a, b, tc=tc: tc[a:b].tobytes(), tn, np.searchsorted(block[order], np.arange(blocks + 1)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["key", "tokens", "classes", "ns"])
                del out, cols, sets, toks, cls, rest, rest_cls, order, to, tc, tn
            _text.trim()

    return run


def _cat(column, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _shared(blocks: int):
    """Tokens of one range that two classes or more have, with their number of classes, dealt by the classes' blocks."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        toks = _cat(table.column("tokens"), U)
        if key < 0:
            cls, ns = _cat(table.column("classes"), U), _cat(table.column("ns"), "<i4")
            return pa.table({"block": pa.array([-1 - key], pa.int64()), "tokens": pa.array([toks.tobytes()], pa.binary()), "classes": pa.array([cls.tobytes()], pa.binary()), "ns": pa.array([ns.tobytes()], pa.binary())})
        parts = []
        for t, names, at in zip(*(table.column(c).to_pylist() for c in ("tokens", "classes", "ns")), strict=True):
            parts.append(np.frombuffer(names, U)[np.frombuffer(at, "<u2" if len(at) * 4 == len(t) else "<u4")])
        cls = np.concatenate(parts)
        order = np.lexsort((cls, toks))
        toks, cls = toks[order], cls[order]
        keep = np.ones(len(toks), bool)
        keep[1:] = (toks[1:] != toks[:-1]) | (cls[1:] != cls[:-1])
        toks, cls = toks[keep], cls[keep]
        starts = np.flatnonzero(np.concatenate(([True], toks[1:] != toks[:-1]))) if len(toks) else np.zeros(0, np.int64)
        df = np.diff(np.append(starts, len(toks)))
        each = np.repeat(df, df)
        keep = each > 1
        toks, cls, each = toks[keep], cls[keep], -each[keep].astype("<i4")
        block = (cls % U(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        toks, cls, each, block = toks[order], cls[order], each[order], block[order]
        del parts, keep, starts, df, order
        _text.trim()
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        full = np.flatnonzero(np.diff(cuts))
        part = lambda x: pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary())
        return pa.table({"block": pa.array(full, pa.int64()), "tokens": part(toks), "classes": part(cls), "ns": part(each)})

    return run


def sketch(tokens: np.ndarray, n: int) -> np.ndarray:
    """Parity of the tokens that fall on each bit; two bits or more for each of a set's n tokens."""
    bits = max(SKETCH_BITS, 1 << (2 * n - 1).bit_length())
    odd = np.bincount((mix(tokens) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def token_map(tokens: np.ndarray) -> np.ndarray:
    """The bits that some token falls on: sets with a token in common have a bit in common."""
    return np.packbits(np.bincount((mix(tokens + U(1)) & U(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) > 0)


def prefixes(tokens: np.ndarray, df: np.ndarray, n: int, t: Fraction) -> list[np.ndarray]:
    """The shared tokens in the prefix under each order; ``tokens`` are those that other classes may have."""
    p = n - int(_least_overlap_size(np.array([n]), t)[0]) + 1 - (n - len(tokens))
    if p <= 0:
        return []
    coarse = np.log2(np.maximum(df, 1)).astype(np.int64)
    ranks = (df, coarse, np.zeros(len(df), np.int64))
    out = []
    for i, rank in enumerate(ranks):
        out.append(tokens[np.lexsort((mix(tokens + U(i * 0x51ED27)), rank))[:p]])
    return out


def _classes(t: Fraction, counts: np.ndarray):
    """Classes that may link: size, shared tokens, prefixes under each order, parity sketch."""

    def run(table: pa.Table) -> pa.Table:
        toks, cls, ns = _cat(table.column("tokens"), U), _cat(table.column("classes"), U), _cat(table.column("ns"), "<i4").astype(np.int64)
        order = np.lexsort((toks, cls))
        toks, cls, ns = toks[order], cls[order], ns[order]
        keep = np.ones(len(toks), bool)
        keep[1:] = (toks[1:] != toks[:-1]) | (cls[1:] != cls[:-1])
        toks, cls, ns = toks[keep], cls[keep], ns[keep]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))), len(cls)) if len(cls) else np.zeros(1, np.int64)
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n, tk = int(ns[a]), toks[a + 1 : b]  # the first is the header, token 0
            df = np.where(ns[a + 1 : b] < 0, -ns[a + 1 : b], counts[(tk >> U(64 - LOG_BUCKETS)).astype(np.int64)])
            found = prefixes(tk, df, n, t)
            if found:
                rows.append((int(cls[a].view(np.int64)), n, tk.view(np.int64), *(np.sort(x).view(np.int64) for x in found), sketch(tk, n).tobytes(), b"".join(token_map(x).tobytes() for x in found[1:])))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + _ORDERS)
        lists = pa.list_(pa.int64())
        kinds = [pa.int64(), pa.int64(), lists, *[lists] * _ORDERS, pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["class", "n", "tokens", *(f"prefix{i}" for i in range(_ORDERS)), "sketch", "orders"])

    return run


def _verify(pairs: DataFrame, cand: DataFrame, t: Fraction) -> DataFrame:
    """Each pair with ``shares`` (a prefix token in common under every order) and ``link`` (exact)."""
    side = lambda s: cand.select(F.col("class").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "tokens", *(f"prefix{i}" for i in range(_ORDERS)))))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    shares = F.lit(True)
    for i in range(_ORDERS):
        shares = shares & F.arrays_overlap(f"a_prefix{i}", f"b_prefix{i}")
    inter = F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long")
    link = F.when(shares, inter * t.denominator >= t.numerator * (F.col("a_n") + F.col("b_n") - inter)).otherwise(False)
    return met.select("a", "b", link.alias("link"))


def _joined(docs: DataFrame, width: int, threshold: Fraction, scratch: Scratch, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (doc_id, class, n), classes with words (class, least doc_id, size in documents, component) and links."""
    spark = docs.sparkSession
    t = Fraction(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = scratch.cut(docs.mapInArrow(_scan(width), "slot int, doc_id long, class long, n long, counts binary"), "scan")
    members = scan.filter("slot is null").select("doc_id", "class", "n")
    counts = _bucket_counts(scan, spark)
    common = counts > 4 * max(16.0, counts.mean())
    tasks = docs.rdd.getNumPartitions()
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * tasks, 8)
    dealt = docs.mapInArrow(_deal(width, wide, wide, common), "key long, tokens binary, classes binary, ns binary")
    returned = dealt.groupBy("key").applyInArrow(_shared(wide), "block long, tokens binary, classes binary, ns binary")
    schema = "class long, n long, tokens array<long>, " + ", ".join(f"prefix{i} array<long>" for i in range(_ORDERS)) + ", sketch binary, orders binary"
    cand = scratch.cut(returned.groupBy("block").applyInArrow(_classes(t, counts), schema), "classes")
    entries = cand.select("class", F.explode("prefix0").alias("token"))
    payload = cand.select("class", "n", "sketch", "orders", F.col("prefix0").alias("tokens"))
    state, links = linked(entries, payload, t, lambda pairs: _verify(pairs, cand, t), scratch, wide, every)
    classes = members.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    classes = classes.join(state, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return members, scratch.cut(classes, "grouped"), links


def jaccard_classes(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), scratch: Scratch | None = None, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Self-join of ``docs`` (doc_id, text) on the Jaccard likeness of word shingles.

    Returns (members, links): members has a row for each document: doc_id, class, n (set size), component (a class
    key; null for an empty set); links has the verified links between classes that span the components (a, b), or
    with ``every`` all links between different classes. A null or empty text has no set and no links; equal sets are
    one class; rows repeat as they do in the input; a null doc_id is carried along. An empty table gives empty results."""
    members, classes, links = _joined(docs, width, threshold, scratch or Scratch(docs.sparkSession, "jaccard"), every)
    full = join_by_size(members, classes.select("class", "component", "size"), "class", "size", "left")
    return full.select("doc_id", "class", "n", "component"), links


def jaccard_components(docs: DataFrame, width: int = 5, threshold: Fraction = Fraction(4, 5), scratch: Scratch | None = None, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links, itself included. See jaccard_classes.

    With ``count_links`` also n_links, the number of other rows that a row is linked with, equal sets included; all
    links between classes are verified then, and counted by class."""
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    members, classes, links = _joined(docs, width, threshold, scratch, count_links)
    groups = classes.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("classes"), F.sum("size").alias("rows"))
    heads = join_by_size(classes, scratch.cut(groups.filter("rows > 1"), "groups"), "component", "classes").select("class", "size", "head")
    if count_links:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        sums = both.join(classes.select(F.col("class").alias("b"), F.col("size").alias("of")), "b").groupBy(F.col("a").alias("class")).agg(F.sum("of").alias("near"))
        heads = heads.join(sums, "class", "left").withColumn("n_links", F.col("size") - 1 + F.coalesce("near", F.lit(0)))
    full = join_by_size(members, scratch.cut(heads, "heads"), "class", "size", "left")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"), *more)
