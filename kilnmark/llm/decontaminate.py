"""Benchmark decontamination by q-gram lemma filtering over diagonal bands, verified by banded alignment.

Both sides are brought to one normal form: lower case, each run of white space as one space. Each benchmark text is cut
into overlapping patterns. A region of a document that is within e edits of a pattern of m characters shares at least
m - q + 1 - q * e of its q-grams, all on diagonals (document place - pattern place) that differ by e at most, so within
one of the overlapping bands of 2 * (e + 1) diagonals. Shared q-grams are looked up by rolling hashes of whole texts;
places too sparse in hits for any pattern are dropped, then bands below their bound; what is left is aligned exactly in
the band. Any passage of PATTERN + STRIDE - 1 characters of a benchmark text holds a whole pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._text import INVERSE, U, mix, powers

#: Characters of a q-gram; of a pattern, at most, and between pattern starts; share of a pattern's characters that may be edited.
Q, PATTERN, STRIDE, EDITS = 8, 64, 16, 0.08
#: Shared q-grams that a pattern must be owed at least; shorter items are compared with whole documents.
LEAST = 4
#: Bytes of benchmark text that one index holds; more are searched in further blocks.
BLOCK_BYTES = 2 << 20
#: Meetings of q-grams that are sorted at a time; texts with more are halved, with an overlap.
MEETINGS = 1 << 20
_BLANK = np.zeros(0x3002, bool)
_BLANK[[i for i in range(0x3001) if chr(i).isspace()]] = True


def _lower(text: str) -> str:
    """Lower case, one character each."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("ς", "σ")  # by itself, not by its place in a word


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normal form of some texts: code points, where each text begins in them, the place that each was at, and where
    each text began by those places."""
    head = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=head[1:])
    points = np.frombuffer(_lower(data.tobytes().decode("utf-8", "replace")).encode("utf-32-le", "surrogatepass"), "<u4")
    blank = _BLANK[np.minimum(points, len(_BLANK) - 1)]
    first = head[offsets]
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[first[first < len(points)]] = True
    places = np.flatnonzero(keep)
    return np.where(blank, np.uint32(32), points)[keep], np.searchsorted(places, first), places, first


def normal(text: str | None) -> np.ndarray:
    """Normal form of one text, without blanks at its ends."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return _trimmed(fold(raw, np.array([0, len(raw)]))[0])


def _trimmed(points: np.ndarray) -> np.ndarray:
    a, b = 0, len(points)
    if b and points[0] == 32:
        a = 1
    if b > a and points[b - 1] == 32:
        b -= 1
    return points[a:b]


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = len(points)
    if n < q:
        return np.zeros(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum((points.astype(U) * U(0x9FB21C651E98DF25) + U(0x1234567)) * powers(n), out=total[1:])
    return mix((total[q:] - total[: n - q + 1]) * powers(n + 1, INVERSE)[: n - q + 1])


def lemma(m: int, edits: int, q: int = Q) -> int:
    return m - q + 1 - q * edits


def budget(m: int) -> int:
    """Edits of a pattern of m characters that leave it LEAST shared q-grams."""
    return max(0, min(int(EDITS * m), (lemma(m, 0) - LEAST) // Q))


class Index:
    """Patterns of some benchmark texts, and the texts' q-grams by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short: dict[bytes, list[int]] = {}
        texts, hashes, spots, first, many = [], [], [], [], []
        self.items, at, sizes = [], [], []
        base = 0
        for item, text in items:
            points = normal(text)
            n = len(points)
            if not n:
                continue
            if lemma(min(n, PATTERN), 0) < LEAST:
                self.short.setdefault(points.tobytes(), []).append(item)
                continue
            m = min(n, PATTERN)
            begins = np.unique(np.append(np.arange(0, n - m, STRIDE), n - m))
            grams = np.arange(n - Q + 1)
            low = np.searchsorted(begins, grams - (m - Q), "left")
            hashes.append(gram_hashes(points))
            spots.append(base + grams)
            first.append(len(self.items) + low)
            many.append(np.searchsorted(begins, grams, "right") - low)
            self.items += [item] * len(begins)
            at.append(base + begins)
            sizes.append(np.full(len(begins), m))
            texts.append(points)
            base += n
        self.longest = max((len(x) // 4 for x in self.short), default=0)
        if not self.items:
            return
        self.points, self.at, self.sizes = np.concatenate(texts), np.concatenate(at), np.concatenate(sizes)
        of = {m: (budget(m), lemma(m, budget(m))) for m in np.unique(self.sizes).tolist()}
        self.edits, self.need = (np.array([of[m][i] for m in self.sizes.tolist()]) for i in (0, 1))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        h, self.spot = h[order], np.concatenate(spots)[order].astype(np.int32)
        self.first, self.many = np.concatenate(first)[order].astype(np.int32), np.concatenate(many)[order].astype(np.int8)
        self.keys, begin = np.unique(h, return_index=True)
        self.begin = np.append(begin, len(h))
        bits = min(26, max(20, int(len(self.keys)).bit_length() + 4))
        self.shift = U(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True
        self.least, self.width = int(self.need.min()), int((self.sizes + self.edits).max())

    def whole(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """Texts that equal an item too short for a pattern, as ``search`` gives them."""
        out = []
        if self.short:
            for r in np.flatnonzero(np.diff(starts) <= self.longest + 2).tolist():
                a, b = int(starts[r]), int(starts[r + 1])
                out += [(r, i, a, b, 0, 1) for i in self.short.get(_trimmed(points[a:b]).tobytes(), ())]
        return out

    def search(self, points: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start, end, edits, patterns) of every text and item that share a region: the regions' first
        and last place, the least edits, and how many patterns there are."""
        return self.whole(points, starts) + self._regions(points, starts)

    def _regions(self, points, starts):
        if not self.items:
            return []
        h = gram_hashes(points)
        hit = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        if len(hit) < self.least:
            return []
        k = np.searchsorted(self.keys, h[hit])
        k[k == len(self.keys)] = 0
        real = self.keys[k] == h[hit]
        hit, k = hit[real], k[real]
        # a place counts if some window of the largest pattern's width around it has enough hits
        ahead = np.searchsorted(hit, hit + self.width, "left") - np.arange(len(hit))
        dense = np.zeros(len(hit) + 1, np.int64)
        begin = np.flatnonzero(ahead >= self.least)
        np.add.at(dense, begin, 1)
        np.add.at(dense, begin + ahead[begin], -1)
        row = np.searchsorted(starts, hit, "right") - 1
        ok = (np.cumsum(dense)[:-1] > 0) & (hit + Q <= starts[row + 1])
        hit, k, row = hit[ok], k[ok], row[ok]
        if not len(hit):
            return []
        many = self.begin[k + 1] - self.begin[k]
        if many.sum() > MEETINGS:
            if len(starts) > 2:
                half = len(starts) // 2
                a, cut = self._regions(points[: starts[half]], starts[: half + 1]), int(starts[half])
                b = self._regions(points[cut:], starts[half:] - cut)
                return a + [(r + half, i, x + cut, y + cut, e, n) for r, i, x, y, e, n in b]
            if len(points) > 8 * self.width:
                cut = len(points) // 2
                a = self._regions(points[: cut + self.width], np.array([0, cut + self.width]))
                b = self._regions(points[cut:], np.array([0, len(points) - cut]))
                return _merged(a + [(r, i, x + cut, y + cut, e, n) for r, i, x, y, e, n in b])
        spread = lambda count: np.repeat(np.arange(len(count)), count)
        within = lambda count: np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        of = spread(many)
        at = self.begin[k][of] + within(many)
        x, row, spot, own, count = hit[of], row[of], self.spot[at].astype(np.int64), self.first[at].astype(np.int64), self.many[at].astype(np.int64)
        of = spread(count)
        x, row, own, spot = x[of], row[of], own[of] + within(count), spot[of]
        place = spot - self.at[own]
        band = (x - place + PATTERN) // (self.edits[own] + 1)
        own, row, band, place = np.tile(own, 2), np.tile(row, 2), np.concatenate((band, band - 1)), np.tile(place, 2)
        order = np.lexsort((place, band, own, row))
        own, row, band, place = own[order], row[order], band[order], place[order]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (band[1:] != band[:-1])))
        # q-grams of the pattern that are found in the band, each once
        once = new | np.concatenate(([True], place[1:] != place[:-1]))
        heads = np.flatnonzero(new)
        shared = np.add.reduceat(once.astype(np.int64), heads)
        heads = heads[shared >= self.need[own[heads]]]
        own, row, lo = own[heads], row[heads], band[heads] * (self.edits[own[heads]] + 1) - PATTERN
        out = []
        for m in np.unique(self.sizes[own]).tolist():
            e = budget(m)
            some = np.flatnonzero(self.sizes[own] == m)
            for part in np.array_split(some, -(-len(some) // 2048)):
                pattern = self.points[self.at[own[part]][:, None] + np.arange(m)]
                a, b, cost = align(pattern, points, lo[part], 2 * (e + 1), e, starts[row[part]], starts[row[part] + 1])
                good = np.flatnonzero(cost <= e)
                out += [(int(row[part[g]]), int(own[part[g]]), int(a[g]), int(b[g]), int(cost[g])) for g in good]
        best: dict[tuple[int, int], tuple] = {}
        for r, p, a, b, e in out:
            key = r, p
            h = best.get(key, (a, b, e))
            best[key] = min(h[0], a), max(h[1], b), min(h[2], e)
        return _merged([(r, self.items[p], *v, 1) for (r, p), v in best.items()])


def _merged(found: list[tuple]) -> list[tuple]:
    """One row for each text and item."""
    best: dict[tuple[int, int], tuple] = {}
    for r, i, a, b, e, n in found:
        h = best.get((r, i))
        best[r, i] = (a, b, e, n) if h is None else (min(h[0], a), max(h[1], b), min(h[2], e), h[3] + n)
    return [(*k, *v) for k, v in best.items()]


def align(patterns: np.ndarray, points: np.ndarray, lo: np.ndarray, width: int, most: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (start, end, edits) of each pattern, a row, in its text points[begin:end] along the diagonals lo to
    lo + width; edits above ``most`` say that there is none.

    Cells are (pattern place, diagonal), all patterns at once; the region may begin and end anywhere in the band."""
    count, m = patterns.shape
    lo, size = lo - most, width + 2 * most  # the path may leave the band of its q-grams by that much
    big = most + 1
    j = np.arange(size)
    every = lo[:, None] + np.arange(m + size)
    inside = (every >= begin[:, None]) & (every < end[:, None])
    text = points[np.clip(every, 0, max(0, len(points) - 1))]
    origin = lo[:, None] + j
    cost = np.where((origin >= begin[:, None]) & (origin <= end[:, None]), 0, big)
    wall = np.full((count, 1), big)
    for i in range(m):
        differ = ~inside[:, i : i + size] | (text[:, i : i + size] != patterns[:, i : i + 1])
        through = np.where(inside[:, i : i + size], cost + differ, big)
        skip = np.concatenate((cost[:, 1:], wall), axis=1) + 1  # a pattern character left out
        take = skip < through
        best, come = np.where(take, skip, through), np.where(take, np.concatenate((origin[:, 1:], wall), axis=1), origin)
        run = np.minimum.accumulate(best - j, axis=1)  # extra text characters
        side = np.maximum.accumulate(np.where(best - j == run, j, 0), axis=1)
        cost, origin = np.minimum(run + j, big), np.take_along_axis(come, side, axis=1)
    k = cost.argmin(axis=1)
    rows = np.arange(count)
    return np.maximum(begin, origin[rows, k]), np.minimum(end, m + lo + k), cost[rows, k]


def _indexes(benchmark: DataFrame) -> list[Broadcast]:
    """An index for each block of about BLOCK_BYTES of ``benchmark`` (item_id, text), as broadcasts."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = []
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        out.append(spark.sparkContext.broadcast(Index(sorted((r["item_id"], r["text"]) for r in part))))
    return out


def _found(column: pa.Array, index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, start, end, edits, patterns) with places by characters of the texts as they are."""
    out = []
    for lo, _, data, offsets in _text.chunks(column, 1 << 19):
        points, starts, places, first = fold(data, offsets)
        for r, i, a, b, e, n in index.search(points, starts):
            out.append((lo + r, i, int(places[a] - first[r]), int(places[b - 1] + 1 - first[r]), e, n))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Regions of ``docs`` (doc_id, text) that repeat a passage of ``benchmark`` (item_id, text).

    Returns doc_id, item_id, start, end (characters of the text), edits, n_patterns: one row for each item found in a
    document, from the first place found to the last (edits: the least of a pattern). Null and empty texts have none,
    on either side. An item with too few characters for the lemma is found only where it is a whole text. Rows of a
    repeated or null doc_id come out once for each doc_id and item; repeated items count once. Extra columns are
    ignored; an empty table on either side gives an empty result. The benchmark is read in blocks of BLOCK_BYTES, each
    searched against all documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits int, n_patterns int"
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _indexes(benchmark):

        def run(batches, index=index):
            for batch in batches:
                got = _found(batch.column(1), index.value)
                ids = batch.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                cols = list(zip(*got, strict=True))[1:] if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True))], names=["doc_id", "item_id", "start", "end", "edits", "n_patterns"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found.groupBy("doc_id", "item_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"), F.max("n_patterns").alias("n_patterns"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in whose text a benchmark text was found; every column as it was.

    Each row goes or stays by its own text, whatever its doc_id is, null or repeated; null and empty texts stay.
    Against one block of the benchmark rows are filtered as they are read; with more blocks, so that no task holds
    more than one index, the texts found are taken out by their digest."""
    found = _indexes(benchmark)
    if not found:
        return docs
    if len(found) == 1:
        at, index = docs.columns.index("text"), found[0]

        def clean(batches):
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[g[0] for g in _found(batch.column(at), index.value)]] = False
                yield batch.filter(pa.array(stay))

        return docs.mapInArrow(clean, docs.schema)
    gone = None
    texts = docs.select(F.col("text").cast("string").alias("text"))
    for index in found:

        def leaking(batches, index=index):
            for batch in batches:
                rows = sorted({g[0] for g in _found(batch.column(0), index.value)})
                yield batch.take(pa.array(rows, pa.int64()))

        part = texts.mapInArrow(leaking, "text string").select(F.sha2("text", 256).alias("__digest"))
        gone = part if gone is None else gone.unionByName(part)
    return docs.join(gone.distinct(), F.sha2(docs["text"], 256) == F.col("__digest"), "left_anti")
