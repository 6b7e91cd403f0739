"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are folded to classes, embedded, convolved with filters of several widths, rectified, pooled by maximum over each
window of a fixed length, and mapped to languages by a softmax. A text's probabilities are the means over its windows,
weighted by their bytes. For scoring, embedding and filters are multiplied out into tables over pairs of classes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import Scratch, hash_sample

#: Bytes of a window, width of the embedding, widths of filters and number of each.
WINDOW, EMBED, WIDTHS, FILTERS = 512, 8, (2, 3, 4), 16
#: Training: documents of each language, at most (those with the least hash), windows of each of these, at most, passes.
SAMPLE, PER_DOC, PASSES = 500, 4, 6
_FOLD = np.zeros(256, np.int64)  # 0: space and control; 1: digit; 2: mark; then letters and bytes from 128 on
_FOLD[33:127] = 2
_FOLD[48:58] = 1
_FOLD[97:123] = _FOLD[65:91] = np.arange(3, 29)
_FOLD[128:] = np.arange(29, 157)
SIZE = 157
_LETTER = re.compile(r"[^\W\d_]")


class Net:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (SIZE, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.zeros((len(WIDTHS) * FILTERS, len(languages)), np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.tables: list = []

    def _params(self):
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def train(self, windows: np.ndarray, labels: np.ndarray, passes: int = PASSES, rate: float = 0.01, batch: int = 64, seed: int = 1) -> Net:
        """``windows``: classes, one row each of WINDOW places, padded with 0. Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        params = self._params()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        share = np.bincount(labels, minlength=len(self.languages)).astype(np.float32)
        weight = (len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum())).astype(np.float32)
        for _ in range(passes):
            for at in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
                x, y = windows[at], labels[at]
                e = self.embed[x]
                pooled, arg, cols = [], [], []
                for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
                    n = x.shape[1] - w + 1
                    col = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
                    z = col @ f + b
                    k = z.argmax(axis=1)
                    arg.append(k)
                    cols.append(col)
                    pooled.append(np.take_along_axis(z, k[:, None], 1)[:, 0])
                h0 = np.concatenate(pooled, axis=1)
                h = np.maximum(h0, 0)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p
                d[np.arange(len(y)), y] -= 1
                d *= weight[y][:, None] / len(y)
                grads = [np.zeros_like(self.embed)]
                dh = (d @ self.out.T) * (h0 > 0)
                gf, gb = [], []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    rows = np.repeat(np.arange(len(y)), FILTERS)
                    best = cols[i][rows, arg[i].ravel()].reshape(len(y), FILTERS, -1)
                    gf.append(np.einsum("bfk,bf->kf", best, g))
                    gb.append(g.sum(axis=0))
                    back = (g[:, :, None] * f.T[None]).reshape(len(y), FILTERS, w, EMBED)
                    for j in range(w):
                        np.add.at(grads[0], x[np.arange(len(y))[:, None], arg[i] + j], back[:, :, j])
                grads += [*gf, *gb, h.T @ d, d.sum(axis=0)]
                step += 1
                for p_, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        return self

    def multiply_out(self) -> Net:
        """Tables of what each class, or pair of neighbour classes, adds to each filter."""
        self.tables = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            one = [self.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)]
            one[0] = one[0] + b
            pairs = [(one[j][:, None] + one[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
            self.tables.append((pairs, one[-1] if w % 2 else None))
        return self

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text over the languages; every byte is in one window."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        pad = 2 * max(WIDTHS)  # the places that count, half of it at most, read no byte of the next text
        starts = offsets[:-1] + pad * np.arange(n)
        x = np.zeros(len(data) + pad * n + pad, np.int64)
        x[np.arange(len(data)) + pad * np.repeat(np.arange(n), sizes)] = _FOLD[data]
        windows = np.maximum(1, -(-sizes // WINDOW))
        owner = np.repeat(np.arange(n), windows)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = starts[owner] + WINDOW * number
        spans = np.column_stack((begin, np.where(number + 1 < windows[owner], begin + WINDOW, starts[owner] + sizes[owner] + max(WIDTHS)))).ravel()
        most = len(data) + pad * n
        pair = x[:-1] * SIZE + x[1:]
        pooled = []
        for w, (pairs, single) in zip(WIDTHS, self.tables, strict=True):
            z = pairs[0][pair[:most]]
            for j, t in enumerate(pairs[1:], 1):
                z += t[pair[2 * j : 2 * j + most]]
            if single is not None:
                z += single[x[w - 1 : w - 1 + most]]
            pooled.append(np.maximum.reduceat(z, spans, axis=0)[::2])
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weight = np.maximum(1, np.minimum(WINDOW, sizes[owner] - WINDOW * number)).astype(np.float64)
        total = np.zeros((n, len(self.languages)))
        np.add.at(total, owner, p * weight[:, None])
        return total / total.sum(axis=1, keepdims=True)


def held_out(doc_id: str):
    """Column: rows that aren't learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _windows(per_doc: int):
    """Up to ``per_doc`` windows spread over each text: lang, window."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                last = max(0, len(raw) - WINDOW)
                out += [(lang, raw[at : at + WINDOW]) for at in sorted({last * i // max(1, per_doc - 1) for i in range(per_doc)})]
            cols = list(zip(*out, strict=True)) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], names=["lang", "part"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, per_doc: int = PER_DOC) -> Net | None:
    """The network from at most ``sample`` documents of each language that aren't held out, ``per_doc`` windows of each.

    Every value of lang that such a document has is a language."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out("doc_id"))
    chosen = hash_sample(rows.select("doc_id", "lang", "text"), sample, Scratch(docs.sparkSession, "language-sample"), "lang")
    parts = chosen.select("lang", "text").mapInArrow(_windows(per_doc), "lang string, part binary").toPandas().sort_values(["lang", "part"])  # sample * per_doc windows a language
    if not len(parts):
        return None
    langs = sorted(parts["lang"].unique().tolist())
    x = np.zeros((len(parts), WINDOW), np.int64)
    for i, raw in enumerate(parts["part"]):
        x[i, : len(raw)] = _FOLD[np.frombuffer(bytes(raw), np.uint8)]
    y = np.searchsorted(langs, parts["lang"].to_numpy(str))
    return Net(langs).train(x, y).multiply_out()


def _letters(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, lo: int) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122), out=ascii_letter[1:])
    has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = bool(_LETTER.search(texts[lo + int(i)].as_py() or ""))
    return has


def predict(docs: DataFrame, sample: int = SAMPLE, per_doc: int = PER_DOC) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    A null text and one without a letter are ``und`` with score 0, as is every text if no row can be learned from.
    Of languages with the same probability the first by name is taken. Rows repeat as in the input; a null doc_id is
    kept (held_out null). Extra columns are ignored; an empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit(docs, sample, per_doc)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi, data, offsets in _text.chunks(texts, 1 << 18):
                if net is None or not len(data):
                    continue
                p = net.probabilities(data, offsets)
                best = p.argmax(axis=1)
                for i in np.flatnonzero(_letters(texts, data, offsets, lo)).tolist():
                    lang[lo + i], score[lo + i] = net.languages[best[i]], min(1.0, p[i, best[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
