"""Line dedup by a segment-partition edit join.

A line may have an edit for every SHARE characters of the shorter one of a pair, K at most; shorter lines than SHARE
are compared as a whole, by their hash. A line within k edits of another one keeps at least one of that one's k + 1
segments unchanged, at a place that its length and the segment's number bound. Every distinct line gives its own
segments as an index, keyed by length, segment number and hash, and probes the segments of lines as long as itself or
up to k shorter. Lines that meet under a key are compared by a character histogram and then by banded bit-parallel edit
distance on their texts.
A line is removed exactly if an earlier line that is kept is within its edits, in the order of doc_id and line: what is
kept in a bucket is worked out there line by line, and what buckets say of each other in rounds over the lines that are
still open, until none is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import Scratch, join_by_size
from ._text import INVERSE, U, mix, powers

#: Edits that still are the same line, at most; characters of the shortest line that is looked at; classes of the histogram.
K, LEAST, CLASSES = 2, 1, 24
#: Characters for each edit that is allowed; lines of blanks alone stay if they are shorter than K edits' worth.
SHARE = 8
_BITS = 1 << 24
#: Lines of a block: buckets with more are compared block by block.
BLOCK = 256


def limit(n):
    """Edits allowed between lines of which the shorter one has n characters; n may be an array."""
    return np.minimum(np.asarray(n) // SHARE, K)


def within(a: str, b: str, k: int = K) -> bool:
    """Whether the edit distance is k at most: k + 1 bit vectors over the 2k + 1 diagonals, one step a character."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    width = 2 * k + 1
    every = (1 << width) - 1
    # bit d + k of rows[e]: the first i characters of a become the first i + d of b with e edits
    rows = [sum(1 << (d + k) for d in range(e + 1) if d <= len(b)) for e in range(k + 1)]
    for i, x in enumerate(a):
        equal = 0
        for d in range(max(-k, -i), min(k, len(b) - 1 - i) + 1):
            if b[i + d] == x:
                equal |= 1 << (d + k)
        inside = every
        if len(b) - 1 - i < k:  # no character of b at i + d
            inside = (1 << max(0, len(b) - i + k)) - 1
        new = [rows[0] & equal]
        for e in range(1, k + 1):
            new.append((rows[e] & equal) | (rows[e - 1] & inside) | (rows[e - 1] >> 1) | ((new[e - 1] << 1) & every))
        rows = new
        if not any(rows):
            return False
    d = len(b) - len(a) + k
    return bool(rows[k] >> d & 1) if 0 <= d < width else False


def segments(length: int, k: int = K) -> list[tuple[int, int]]:
    """(place, size) of the k + 1 segments of a line of that length, the longer ones last."""
    size, more = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i >= k + 1 - more)
        out.append((at, n))
        at += n
    return out


def _lines(texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows: first row, code points, starts and ends of the lines that count, their row, number, place in bytes and end."""
    for lo, _, data, offsets in _text.chunks(texts):
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
        starts = starts[starts < len(data)]
        if not len(starts):
            continue
        rows = np.searchsorted(offsets, starts, "right") - 1
        after = np.searchsorted(breaks, starts, "left")
        ends = np.minimum(np.append(breaks, len(data))[after], offsets[rows + 1])
        number = np.arange(len(starts)) - np.searchsorted(starts, offsets[rows], "left")
        head = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=head[1:])
        a, b = head[starts], head[ends]
        ink = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~_text.SPACE[data], out=ink[1:])
        keep = (b - a >= LEAST) & ((ink[ends] > ink[starts]) | (b - a >= K * SHARE))
        yield lo, data, a[keep], b[keep], rows[keep], number[keep], starts[keep], ends[keep]


def _hashes(data, starts, ends) -> np.ndarray:
    return _text.range_hash(data, starts, ends).view(np.int64)


def _occurrences(batches):
    """Every line that counts: hash, doc_id, line number."""
    for batch in batches:
        ids = batch.column(0)
        for lo, data, _, _, rows, number, starts, ends in _lines(batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(data, starts, ends)), ids.take(pa.array(rows + lo)), pa.array(number.astype(np.int32))], names=["class", "doc_id", "line"])


def _keys(ranges: int):
    """Index and probe keys of the distinct lines of a task, as arrays dealt by key range.

    Rows: range, keys, refs (place in lines * 2 + whether it is a probe), lines (hashes), lengths and histograms."""
    shape = np.dtype("<u4")

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, data, a, b, _, _, starts, ends in _lines(batch.column(1)):
                h = _hashes(data, starts, ends)
                fresh = []
                edits = limit(b - a) > 0  # others are found by their hash alone
                for i, x in zip(np.flatnonzero(edits).tolist(), h[edits].tolist(), strict=True):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if not fresh:
                    continue
                a, b, h = a[fresh], b[fresh], h[fresh]
                points = code_points(data)
                n = len(points)
                total = np.zeros(n + 1, U)
                np.cumsum((points.astype(U) * U(0x9FB21C651E98DF25) + U(0x1234567)) * powers(n), out=total[1:])
                inverse = powers(n + 1, INVERSE)
                length = b - a
                keys, refs = [], []

                def add(at, size, of, number, ref, probe, total=total, inverse=inverse, keys=keys, refs=refs):
                    raw = (total[at + size] - total[at]) * inverse[at]
                    keys.append(mix(raw + mix((of * (K + 1) + number).astype(U) + U(1))))
                    refs.append((ref * 2 + probe).astype(shape))

                every = np.arange(len(h))
                for k, short in ((k, short) for k in range(1, K + 1) for short in range(k + 1)):  # lines with k edits, shorter by so much
                    of = length - short
                    size, more = of // (k + 1), of % (k + 1)
                    for i in range(k + 1):
                        extra = np.maximum(0, i - (k + 1 - more))
                        at, n_seg = i * size + extra, size + (i >= k + 1 - more)
                        for shift in range(max(-i, short - (k - i)), min(i, short + (k - i)) + 1):
                            place = at + shift
                            ok = (place >= 0) & (place + n_seg <= length) & (limit(of) == k)
                            probe = int(bool(short or shift))  # unshifted ones of its own length are its index
                            add((a + place)[ok], n_seg[ok], of[ok], i, every[ok], probe)
                key, ref = np.concatenate(keys), np.concatenate(refs)
                order = np.argsort(key, kind="stable")
                key, ref = key[order], ref[order]
                hist = histograms(points, a, b)
                cuts = np.searchsorted(((key >> U(32)) * U(ranges)) >> U(32), np.arange(ranges + 1, dtype=U))
                full = np.flatnonzero(np.diff(cuts))
                part = lambda x: pa.array([x[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary())  # noqa: B023, E731
                # each row carries only the lines it refers to
                names, sizes, hists, refs_out = [], [], [], []
                for r in full:
                    own = ref[cuts[r] : cuts[r + 1]]
                    used, back = np.unique(own >> 1, return_inverse=True)
                    refs_out.append((back.astype(shape) * 2 + (own & 1)).tobytes())
                    names.append(h[used].tobytes())
                    sizes.append(length[used].astype(shape).tobytes())
                    hists.append(hist[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), part(key), *(pa.array(x, pa.binary()) for x in (refs_out, names, sizes, hists))], names=["range", "keys", "refs", "lines", "lengths", "hists"])

    return run


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")


def histograms(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Characters of each class, modulo 256; one edit changes two classes by one at most."""
    of = (points * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(CLASSES)
    line = np.zeros(len(points) + 1, np.int64)
    line[starts] += 1
    owner = np.cumsum(line)[:-1] - 1
    inside = np.zeros(len(points) + 1, np.int64)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    on = np.cumsum(inside)[:-1] > 0
    # starts ascend, so lines are numbered as they come
    return np.bincount(owner[on] * CLASSES + of[on], minlength=len(starts) * CLASSES).reshape(-1, CLASSES).astype(np.uint8)


def _near(hist, others, n, ns) -> np.ndarray:
    """Which of the others the histograms and lengths leave as possible within limit() edits."""
    most = limit(np.minimum(n, ns))
    return (np.abs((others - hist).view(np.int8).astype(np.int16)).sum(axis=1) <= 2 * most) & (np.abs(ns - n) <= most)


def _met(table: pa.Table) -> pa.Table:
    """Of one key range the keys under which an index meets another line that may be linked."""
    keys, lines, kinds, sizes, hists = [], [], [], [], []
    for k, r, l, s, h in zip(*(table.column(c).to_pylist() for c in ("keys", "refs", "lines", "lengths", "hists")), strict=True):
        ref = np.frombuffer(r, "<u4")
        at = ref >> 1
        keys.append(np.frombuffer(k, U))
        kinds.append((ref & 1).astype(np.int32))
        lines.append(np.frombuffer(l, np.int64)[at])
        sizes.append(np.frombuffer(s, "<u4")[at].astype(np.int64))
        hists.append(np.frombuffer(h, np.uint8).reshape(-1, CLASSES)[at])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.concatenate(([False], key[1:] == key[:-1], [False]))
    busy = same[:-1] | same[1:]
    order, key = order[busy], key[busy]
    line, kind, size, hist = np.concatenate(lines)[order], np.concatenate(kinds)[order], np.concatenate(sizes)[order], np.concatenate(hists)[order]
    order = np.lexsort((kind, line, key))
    key, line, kind, size, hist = key[order], line[order], kind[order], size[order], hist[order]
    keep = np.ones(len(key), bool)  # a line once a key, as an index if it is one
    keep[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line, kind, size, hist = key[keep], line[keep], kind[keep], size[keep], hist[keep]
    starts = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key)) if len(key) else np.zeros(1, np.int64)
    good = np.zeros(len(key), bool)
    many = np.diff(starts)
    two = starts[:-1][many == 2]
    if len(two):
        ok = (np.abs((hist[two + 1] - hist[two]).view(np.int8).astype(np.int16)).sum(axis=1) <= 2 * limit(np.minimum(size[two], size[two + 1]))) & ((kind[two] == 0) | (kind[two + 1] == 0))
        good[two[ok]] = good[two[ok] + 1] = True
    for g in np.flatnonzero(many > 2):
        x, y = starts[g], starts[g + 1]
        if y - x > BLOCK:  # compared in blocks later on
            good[x:y] = True
            continue
        for i in range(x, y - 1):
            ok = _near(hist[i], hist[i + 1 : y], size[i], size[i + 1 : y]) & ((kind[i] == 0) | (kind[i + 1 : y] == 0))
            if ok.any():
                good[i] = True
                good[i + 1 : y] |= ok
    return pa.table([pa.array(x[good]) for x in (key.view(np.int64), line, kind)], names=["token", "class", "kind"])


def _line_texts(bits: bytes):
    """Distinct lines of a task whose hash may be wanted: hash, line."""
    wanted = np.frombuffer(bits, np.uint8)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, data, _, _, _, _, starts, ends in _lines(batch.column(1)):
                h = _hashes(data, starts, ends)
                at = (h.view(U) % U(_BITS)).astype(np.int64)
                raw, out = data.tobytes(), {}
                for i in np.flatnonzero(wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                    if (x := int(h[i])) not in seen:
                        seen.add(x)
                        out[x] = raw[starts[i] : ends[i]].decode("utf-8", "replace")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())], names=["class", "line_text"])

    return run


def _wanted(entries: DataFrame) -> bytes:
    """A bit for each value of hash modulo 2**24 that is among the entries: 2 MB whatever the input."""
    x = F.expr(f"pmod(class, {_BITS}L) + 1")  # 2**24 divides 2**64, so the signed remainder is that of the bits
    rows = entries.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("m")).collect()
    out = np.zeros((_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out.tobytes()


def _earlier(table: pa.Table) -> pa.Table:
    """Of each block of a bucket, or pair of blocks: for each open line an earlier one, kept or open, that it is within
    limit() edits of, if there is one (a: the line, b: the earlier one).

    Lines are taken in order as if there were no other bucket. Of several earlier ones a line that is kept here is
    named, for that settles most lines at once; else the first."""
    token, pair, cls, doc, line, kind, part, cross, kept = (table.column(c).to_numpy() for c in ("token", "pair", "class", "doc_id", "line", "kind", "own", "cross", "kept"))
    texts = table.column("line_text").to_pylist()
    order = np.lexsort((line, doc, pair, token))
    joint = "".join(texts)
    length = np.array([len(t) for t in texts])
    ends = np.cumsum(length)
    hist = histograms(np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), "<u4"), ends - length, ends)
    cuts = np.append(np.flatnonzero(np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (pair[order][1:] != pair[order][:-1])))), len(order))
    a: list[int] = []
    b: list[int] = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[x:y]
        stays = np.zeros(len(at), bool)  # by what this block knows
        for i, own in enumerate(at.tolist()):
            before = at[:i]
            if kept[own]:
                stays[i] = True
                continue
            ok = _near(hist[own], hist[before], length[own], length[before]) & ((kind[own] == 0) | (kind[before] == 0))
            if cross[own]:  # pairs of one block have their own group
                ok &= part[before] != part[own]
            near = np.flatnonzero(ok)
            met = -1
            for j in near[np.argsort(~stays[near], kind="stable")].tolist():
                if within(texts[at[j]], texts[own], int(limit(min(length[own], length[at[j]])))):
                    met = j
                    break
            if met < 0:
                stays[i] = True
            else:
                a.append(int(cls[own]))
                b.append(int(cls[at[met]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _settle(entries: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
    """(class, kept) of every class in ``entries`` (token, class, kind, doc_id, line, line_text).

    Each round names for the open lines of each bucket an earlier kept or open line that they are within edits of. A
    line without any is kept; one of whose are kept goes; one whose are all gone, or open, is asked again. The first
    open line of each bucket always has none in it, so that every round settles some."""
    spark = entries.sparkSession
    done = spark.createDataFrame([], "class long, kept boolean")
    while True:
        state = entries.select("class").distinct().join(done, "class", "left")
        live = entries.join(done, "class", "left").filter("kept is null or kept") if not done.isEmpty() else entries.withColumn("kept", F.lit(None).cast("boolean"))
        sizes = live.groupBy("token").agg(F.count("*").alias("members"), F.max(F.col("kept").isNull()).alias("open")).filter("members > 1 and open")
        live = live.join(sizes.select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "token").withColumn("own", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
        ij = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own")))
        live = live.withColumn("pair", F.explode(ij)).withColumn("cross", F.floor(F.col("pair") / F.col("blocks")) != F.col("pair") % F.col("blocks"))
        live = live.withColumn("lane", F.pmod(F.xxhash64("token", "pair"), F.lit(groups))).withColumn("kept", F.coalesce("kept", F.lit(False)))
        named = live.select("lane", "token", "pair", "class", "doc_id", "line", "kind", "own", "cross", "kept", "line_text").groupBy("lane").applyInArrow(_earlier, "a long, b long")
        named = scratch.cut(named.distinct(), "named")
        blocked = named.select(F.col("a").alias("class")).distinct().withColumn("blocked", F.lit(True))
        kept = scratch.cut(state.join(blocked, "class", "left").filter("kept or kept is null and blocked is null").select("class", F.lit(True).alias("kept")), "kept")
        gone = named.join(kept.select(F.col("class").alias("b")), "b", "left_semi").select(F.col("a").alias("class"), F.lit(False).alias("kept")).distinct()
        done = scratch.cut(kept.unionByName(gone).unionByName(state.filter("not kept").select("class", "kept")), "settled")
        if state.select("class").join(done, "class", "left_anti").isEmpty():
            return done


def removed_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, line) of every line, counted from 0, for which an earlier line that is kept is equal or within limit() edits.

    Earlier is by (doc_id, line). So every line that goes is like one that stays, and lines that are only joined by a
    chain of others stay. Empty lines stay, and blank ones of fewer than K * SHARE characters. A row without a doc_id is
    left alone. Of rows with the same doc_id the first place of a line counts as one place, so that none of them loses
    it there. An empty table gives an empty result; extra columns are ignored."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    places = scratch.cut(rows.mapInArrow(_occurrences, "class long, doc_id long, line int"), "places")
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions(), 8)
    dealt = rows.mapInArrow(_keys(wide), "range long, keys binary, refs binary, lines binary, lengths binary, hists binary")
    entries = scratch.cut(dealt.groupBy("range").applyInArrow(_met, "token long, class long, kind int"), "entries")
    bits = spark.sparkContext.broadcast(_wanted(entries))
    texts = rows.mapInArrow(lambda it: _line_texts(bits.value)(it), "class long, line_text string")
    texts = texts.join(entries.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    first = scratch.cut(places.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("head"), F.count("*").alias("n")), "first")
    full = entries.join(texts, "class").join(first.select("class", "head.doc_id", "head.line"), "class")
    state = _settle(scratch.cut(full, "members"), scratch, wide)
    verdict = first.join(state, "class", "left").withColumn("kept", F.coalesce("kept", F.lit(True))).filter("n > 1 or not kept")
    lost = join_by_size(places, scratch.cut(verdict, "verdict"), "class", "n")
    return lost.filter("not kept or not (doc_id = head.doc_id and line = head.line)").select("doc_id", "line").distinct()


def _rewrite(batches):
    for batch in batches:
        gone = batch.column(batch.schema.get_field_index("__kilnmark_gone")).to_pylist()
        at = batch.schema.get_field_index("text")
        texts, n = batch.column(at).to_pylist(), []
        for i, g in enumerate(gone):
            if g:
                drop = set(g)
                texts[i] = "\n".join(x for j, x in enumerate(texts[i].split("\n")) if j not in drop)
            n.append(len(g or ()))
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_removed"])


def dedup_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the text that is left and n_removed, the number of lines that went; see removed_lines.

    All other columns stay as they are; one that is called n_removed is replaced. A null text stays null; empty and short blank lines stay; a text whose lines all
    went becomes empty. An empty table gives an empty result."""
    docs = docs.drop("n_removed")
    gone = removed_lines(docs, scratch).groupBy(F.col("doc_id").alias("__kilnmark_id")).agg(F.collect_list("line").alias("__kilnmark_gone"))  # no more than the document's lines
    full = docs.join(gone, docs["doc_id"] == F.col("__kilnmark_id"), "left").select(*[docs[c] for c in docs.columns], "__kilnmark_gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_removed long"
    return full.mapInArrow(_rewrite, schema)
