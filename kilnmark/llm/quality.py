"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation over the counts of
vote patterns of all documents estimates how each labeller votes on good and on bad documents, and so the posterior of
each pattern. A linear scorer over hashed words and word shapes is trained on posteriors of a bounded sample and scores
every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import Scratch, hash_sample

#: Hash buckets of the scorer; documents that it is trained on, at most (least hash of doc_id and text); passes over them.
LOG_DIM, SAMPLE, PASSES = 16, 4000, 8
#: Common words of some languages, by which running text is told.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "le", "la", "les", "de", "des", "et", "un", "une", "que", "pour",
    "der", "die", "das", "und", "ist", "nicht", "mit", "den", "von", "el", "los", "las", "en", "es", "por", "con", "para", "del",
)
LABELLERS = ("length", "word_length", "marks", "common", "upper", "repeats", "word_variety", "digits", "endings")
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*+/<=>@[]^_`{|}~\\"]] = True


def _common() -> np.ndarray:
    data = np.frombuffer(" ".join(COMMON).encode(), np.uint8)
    return np.unique(_text.words(data, np.array([0, len(data)]))[3])


_COMMON = _common()


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Votes (1 good, 0 bad, 2 abstain) of each labeller on each text, and the words found."""
    n = len(offsets) - 1
    starts, ends, rows, hashes = _text.words(data, offsets)
    per = lambda w=None: np.bincount(rows, weights=w, minlength=n).astype(float)
    words, letters = per(), per((ends - starts).astype(float))

    def of_bytes(mask):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    size, some = np.maximum(1, np.diff(offsets)).astype(float), np.maximum(1, words)
    marks, digits = of_bytes(_MARK[data]) / size, of_bytes((data >= 48) & (data < 58)) / size
    upper = of_bytes((data >= 65) & (data < 91)) / np.maximum(1, of_bytes((data >= 65) & (data < 91) | (data >= 97) & (data < 123) | (data >= 128)))
    common = per(np.isin(hashes, _COMMON).astype(float)) / some
    pairs = np.unique(np.column_stack((rows, hashes.view(np.int64))), axis=0)[:, 0] if len(rows) else rows
    variety = np.bincount(pairs, minlength=n) / np.sqrt(some)
    closing = per(np.isin(data[ends - 1], (33, 46, 63)).astype(float)) if len(ends) else np.zeros(n)
    breaks = of_bytes(data == 10) + 1
    lines = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
    lines = lines[lines < len(data)]
    repeats = np.zeros(n)
    if len(lines):
        stops = np.minimum(np.append(lines[1:], len(data)), offsets[np.minimum(np.searchsorted(offsets, lines, "right"), n)])
        keys = np.column_stack((np.searchsorted(offsets, lines, "right") - 1, _text.range_hash(data, lines, stops).view(np.int64)))
        repeats = 1 - np.bincount(np.unique(keys, axis=0)[:, 0], minlength=n) / np.maximum(1, np.bincount(keys[:, 0], minlength=n))
    vote = lambda good, bad: np.where(bad, 0, np.where(good, 1, 2))
    mean = letters / some
    votes = np.column_stack((
        vote(words >= 40, words < 8), vote((mean > 3) & (mean < 10), (mean < 2) | (mean > 16)), vote(marks < 0.005, marks > 0.04), vote(common > 0.12, common < 0.04),
        vote(upper < 0.1, upper > 0.3), vote(repeats < 0.1, repeats > 0.3), vote(variety > 3, variety < 1.2), vote(digits < 0.02, digits > 0.1),
        vote(closing / breaks > 0.8, (closing / breaks < 0.2) & (words > 20)),
    ))
    return votes.astype(np.int8), (starts, ends, rows, hashes)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """EM over patterns (votes of each labeller) with their counts: (rates[labeller, class, vote], share of good).

    Starts from the majority of votes; a little weight on the assumption that labellers are right keeps the classes in place."""
    patterns, counts = np.asarray(patterns), np.asarray(counts, float)
    good = np.where((patterns == 1).sum(axis=1) >= 2 * (patterns == 0).sum(axis=1) + 1, 0.9, 0.1)
    n = patterns.shape[1]
    prior = np.array([[2.0, 1.0, 1.0], [1.0, 2.0, 1.0]])
    for _ in range(rounds):
        rates = np.empty((n, 2, 3))
        for k in range(n):
            for c, w in enumerate((1 - good, good)):
                rates[k, c] = np.bincount(patterns[:, k], weights=w * counts, minlength=3) + prior[c]
        rates /= rates.sum(axis=2, keepdims=True)
        share = ((good * counts).sum() + 1) / (counts.sum() + 2)
        new = posterior(patterns, rates, share)
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return rates, float(share)


def posterior(patterns: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    k = np.arange(patterns.shape[1])
    log = np.log(rates[k, :, :][:, :, :])
    bad, good = (log[k, c, patterns].sum(axis=1) for c in (0, 1))
    z = np.clip(good - bad + np.log(share / (1 - share)), -50, 50)
    return 1 / (1 + np.exp(-z))


def hashed(data: np.ndarray, offsets: np.ndarray, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the scorer's features: each text's words and word shapes, one in all for each kind."""
    starts, ends, rows, hashes = found
    dim = np.uint64(64 - LOG_DIM)
    shapes = _text.range_hash(_SHAPE[data], starts, np.minimum(ends, starts + 12))
    words = np.maximum(1, np.bincount(rows, minlength=len(offsets) - 1))
    return np.tile(rows, 2), (np.concatenate((hashes, _text.mix(shapes + np.uint64(1)))) >> dim).astype(np.int64), np.tile(1.0 / words[rows], 2)


class Scorer:
    def __init__(self, rates, share):
        self.rates, self.share = rates, share
        self.w, self.bias = np.zeros(1 << LOG_DIM), 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, passes: int = PASSES, rate: float = 0.2) -> Scorer:
        """AdaGrad on the cross entropy with the posteriors; ``rows``: (distinct buckets, weights) in a fixed order."""
        square, base = np.full(1 << LOG_DIM, 1e-3), 1e-3
        for _ in range(passes):
            for (b, v), y in zip(rows, targets, strict=True):
                z = float(self.w[b] @ v) + self.bias
                g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                if abs(g) < 1e-3:
                    continue
                grad = g * v
                square[b] += grad * grad
                self.w[b] -= rate * grad / np.sqrt(square[b])
                base += g * g
                self.bias -= 0.1 * g / np.sqrt(base)
        return self

    def score(self, data, offsets, found) -> np.ndarray:
        r, b, v = hashed(data, offsets, found)
        z = np.bincount(r, weights=self.w[b] * v, minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes.astype(np.int64) @ 3 ** np.arange(votes.shape[1], dtype=np.int64)


def _patterns(batches):
    """Counts of each task's vote patterns."""
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for _, _, data, offsets in _text.chunks(batch.column(1)):
            total += np.bincount(_pattern(statistics(data, offsets)[0]), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pattern", "n"])


def _featured(batches):
    """Votes and features of each text: 2**LOG_DIM buckets at most, whatever its length."""
    for batch in batches:
        votes, buckets, weights = [], [], []
        for _, _, data, offsets in _text.chunks(batch.column(1)):
            v, found = statistics(data, offsets)
            votes += v.tolist()
            row, at, w = hashed(data, offsets, found)
            keys, back = np.unique((row << LOG_DIM) | at, return_inverse=True)
            total = np.bincount(back, weights=w, minlength=len(keys)).astype("<f4")
            cuts = np.searchsorted(keys >> LOG_DIM, np.arange(len(offsets)))
            low = (keys & ((1 << LOG_DIM) - 1)).astype("<i4")
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                buckets.append(low[x:y].tobytes())
                weights.append(total[x:y].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.list_(pa.int32())), pa.array(buckets, pa.binary()), pa.array(weights, pa.binary())], names=["doc_id", "votes", "buckets", "weights"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Scorer | None:
    """Labeller rates from the votes on all rows of ``docs``; the scorer from at most ``sample`` of them."""
    counts = docs.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3**9 at most
    if not counts:
        return None
    codes = np.array([r["pattern"] for r in counts])
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    order = np.argsort(codes)
    rates, share = estimate(patterns[order], np.array([r["n"] for r in counts])[order])
    scorer = Scorer(rates, share)
    known = hash_sample(docs.filter("doc_id is not null").select("doc_id", "text"), sample, Scratch(docs.sparkSession, "quality-sample"))
    rows = known.mapInArrow(_featured, "doc_id long, votes array<int>, buckets binary, weights binary").collect()  # ``sample`` rows at most
    rows.sort(key=lambda r: (_text.mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0], bytes(r["buckets"])))
    if rows:
        parts = [(np.frombuffer(bytes(r["buckets"]), "<i4"), np.frombuffer(bytes(r["weights"]), "<f4")) for r in rows]
        scorer.fit(parts, posterior(np.array([r["votes"] for r in rows]), rates, share))
    return scorer


def score(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, weak_label (posterior of good from the votes), score (of the linear scorer), keep (score of 0.5 or more).

    A null text is an empty one. Rows repeat as in the input; a null doc_id is kept. Extra columns are ignored; an
    empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scorer = fit(docs, sample)

    def run(batches):
        for batch in batches:
            weak, out = [np.zeros(0)], [np.zeros(0)]
            for _, _, data, offsets in _text.chunks(batch.column(1)):
                votes, found = statistics(data, offsets)
                weak.append(posterior(votes, scorer.rates, scorer.share))
                out.append(scorer.score(data, offsets, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(weak)), pa.array(np.concatenate(out))], names=["doc_id", "weak_label", "score"])

    found = docs.mapInArrow(run, "doc_id long, weak_label double, score double")
    return found.select("doc_id", "weak_label", "score", (F.col("score") >= 0.5).alias("keep"))
