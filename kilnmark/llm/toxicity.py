"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around each term found.

The intersection is determinised once into a table (state, letter) -> state. All words of a chunk of texts run through
it at the same time, one array step a letter, so that misspelled terms cost no more than exact ones.
The lexicon is widened by word stems learned from labelled rows, in whatever language; they go through an automaton of
the same kind, which accepts words that start within a stem's edits. A term or stem in quotation marks, or near words
that speak about wording, counts as quoted; near words of address as aimed. A logistic model over these counts, fitted
on labelled rows, gives the score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import Scratch, hash_sample

#: Terms of abuse; words of quotation and of address looked for within WINDOW words of a term.
LEXICON = (
    "clown", "coward", "creep", "cretin", "dimwit", "disgusting", "dumbass", "filthy", "garbage", "idiot", "imbecile", "loser", "moron",
    "pathetic", "pervert", "scum", "scumbag", "stupid", "trash", "vermin", "worthless",
)
QUOTING = (
    "said", "says", "quote", "quoted", "word", "term", "called", "wrote", "insult", "means",
    "sagte", "sagt", "zitat", "zitiert", "wort", "begriff", "genannt", "schrieb", "beleidigung", "bedeutet",
    "disait", "cite", "citation", "mot", "terme", "appelé", "écrit", "insulte", "signifie",
    "dijo", "dice", "cita", "citado", "palabra", "término", "llamado", "escribió", "insulto", "significa",
)
AIMING = (
    "you", "your", "youre", "are", "such", "shut", "hate", "du", "dich", "dein", "deine", "bist", "ihr", "euch", "hasse",
    "tu", "toi", "ton", "vous", "votre", "êtes", "déteste", "tú", "tus", "eres", "usted", "ustedes", "odio",
)
WINDOW = 6
#: Labelled rows that the model is fitted on, at most, of each label: those with the least hash of doc_id.
SAMPLE = 4000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(48, 58), *range(128, 256)]] = True
_OPENING, _CLOSING = ('"', "“", "„", "«", "'", "‘"), ('"', "”", "“", "»", "'", "’")
#: Counts: exact or near hit of the lexicon, then of the stems, each aimed, plain or quoted; then stems of different kinds, hits in 100 words.
TERMS = 12
COUNTS = TERMS + 2
#: A learned stem is the start of a word in this share of the abusive sample rows at least, and so many times as
#: common there as in the others; stems have so many characters; so many, those of the greatest lift, make the model.
STEM_SHARE, STEM_LIFT, STEM_LENGTHS, STEMS = 0.005, 20, range(4, 9), 400


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


def stem_edits(stem: str) -> int:
    return 0 if len(stem) < 6 else 1


class Automaton:
    """Deterministic: the trie of ``terms`` times the Levenshtein automata of their edit limits.

    Works on UTF-8 bytes, of which those in no term are one class. ``table[state, class]`` is the next state (0: dead,
    1: start); ``edits[state]`` is the least distance to a term if the state accepts, else 99. With ``stems`` a word
    is accepted that starts within a term's edits."""

    def __init__(self, terms=LEXICON, limit=edits_allowed, stems: bool = False):
        raw = sorted({t.encode() for t in terms if t})
        letters = sorted({c for t in raw for c in t})
        self.classes = np.full(256, len(letters), np.int64)
        self.classes[letters] = np.arange(len(letters))
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        deep = [0]
        for term in raw:
            at, most = 0, limit(term.decode())
            for c in term:
                k = int(self.classes[c])
                if k not in children[at]:
                    children.append({})
                    deep.append(0)
                    children[at][k] = len(children) - 1
                deep[at] = max(deep[at], most)
                at = children[at][k]
            deep[at] = max(deep[at], most)
            ends[at] = max(ends.get(at, 0), most)

        def closed(pairs: dict[int, int]) -> tuple:
            todo = list(pairs.items())
            while todo:  # a letter of the term left out
                node, e = todo.pop()
                for child in children[node].values():
                    if e + 1 <= deep[child] and pairs.get(child, 99) > e + 1:
                        pairs[child] = e + 1
                        todo.append((child, e + 1))
            return tuple(sorted(pairs.items()))

        start = closed({0: 0})
        number = {(): 0, start: 1}
        size = len(letters) + 1
        table, edits = [[0] * size], [99]
        todo = [start]
        self.stems, self.longest = stems, max((len(t) + limit(t.decode()) for t in raw), default=0)
        while todo:
            state = todo.pop(0)
            edits.append(min((e for node, e in state if e <= ends.get(node, -1)), default=99))
            row = []
            for k in range(size):
                to: dict[int, int] = {}
                for node, e in state:
                    if stems and e <= ends.get(node, -1):
                        to[node] = min(e, to.get(node, 99))
                    for c, child in children[node].items():
                        cost = e + (c != k)
                        if cost <= deep[child] and to.get(child, 99) > cost:
                            to[child] = cost
                    if e + 1 <= deep[node] and to.get(node, 99) > e + 1:
                        to[node] = e + 1
                key = closed(to)
                if key not in number:
                    number[key] = len(number)
                    todo.append(key)
                row.append(number[key])
            table.append(row)
        self.table, self.edits = np.array(table, np.int32), np.array(edits, np.int64)

    def distances(self, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each word the least distance to a term within its limit, else 99. ``low``: folded bytes."""
        out = np.full(len(starts), 99, np.int64)
        if self.stems:  # what a word starts with is settled there
            lengths = np.minimum(lengths, self.longest)
        live = np.flatnonzero(lengths <= self.longest)
        state = np.ones(len(live), np.int32)
        i = 0
        while len(live):
            done = lengths[live] == i
            if done.any():
                out[live[done]] = self.edits[state[done]]
            keep = ~done & (state > 0)
            live, state = live[keep], state[keep]
            state = self.table[state, self.classes[low[starts[live] + i]]]
            i += 1
        return out


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _LETTER[data]
    two = np.flatnonzero(data[:-1] == 0xC2)  # U+0080 to U+00BF and U+2000 to U+203F are marks
    three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    for at in (two, two + 1, three, three + 1, three + 2):
        inside[at] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _beside(data: np.ndarray, at: np.ndarray, limits: np.ndarray, marks: tuple[str, ...], before: bool) -> np.ndarray:
    """Whether one of the marks ends at (``before``) or starts at each place, within the text's limit."""
    out = np.zeros(len(at), bool)
    for raw in (m.encode() for m in marks):
        first = at - len(raw) if before else at
        ok = first >= limits if before else first + len(raw) <= limits
        for k, c in enumerate(raw):
            ok[ok] = data[first[ok] + k] == c
        out |= ok
    return out


def _hashes(words) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(_text.words(data, np.array([0, len(data)]))[3])


_QUOTING, _AIMING = _hashes(QUOTING), _hashes(AIMING)


def features(automata: tuple[Automaton, Automaton], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, COUNTS))
    if not len(data):
        return out
    starts, ends = _bounds(data, offsets)
    low = _text.LOWER[data]
    rows = np.searchsorted(offsets, starts, "right") - 1
    head = np.searchsorted(rows, np.arange(n + 1))  # a text's first word
    counted = None
    for base, automaton in enumerate(automata):
        found = automaton.distances(low, starts, ends - starts)
        hits = np.flatnonzero(found < 99)
        if not len(hits):
            continue
        of = rows[hits]
        if counted is None:
            hashes = _text.range_hash(low, starts, ends)
            counted = [np.concatenate(([0], np.cumsum(np.isin(hashes, known)))) for known in (_QUOTING, _AIMING)]
        lo, hi = np.maximum(head[of], hits - WINDOW), np.minimum(head[of + 1], hits + WINDOW + 1)
        about, aimed = (c[hi] - c[lo] - (c[hits + 1] - c[hits]) > 0 for c in counted)
        marked = _beside(data, starts[hits], offsets[of], _OPENING, True) & _beside(data, ends[hits], offsets[of + 1], _CLOSING, False)
        kind = np.where(marked | about, 2, np.where(aimed, 0, 1)) + 3 * (found[hits] > 0) + 6 * base
        np.add.at(out, (of, kind), 1)
        if base:
            kinds = np.unique(np.column_stack((of, hashes[hits].view(np.int64))), axis=0)[:, 0]
            out[:, TERMS] = np.bincount(kinds, minlength=n)
    out[:, TERMS + 1] = 100 * out[:, :TERMS].sum(axis=1) / np.maximum(np.diff(head), 1)
    return out


def _shape(x: np.ndarray) -> np.ndarray:
    """Counts saturate, so that long texts don't outweigh."""
    return np.column_stack((np.minimum(x, 4), x[:, :TERMS] > 0, np.ones(len(x))))


class Model:
    """Logistic over the shaped features. Without labels of both kinds: an exact unquoted term is abuse."""

    def __init__(self):
        w = np.zeros(COUNTS + TERMS + 1)
        w[COUNTS : COUNTS + 6] = 6, 5, 1, 1.5, 1, 0
        w[-1] = -4
        self.w = w

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 60) -> Model:
        if len(set(y.tolist())) < 2:
            return self
        x = _shape(x)
        w, prior = self.w.copy(), self.w.copy()
        for _ in range(steps):  # Newton, pulled towards the start
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - y) + 0.1 * (w - prior)
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
            w -= np.clip(step, -2, 2)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_shape(x) @ self.w, -30, 30)))


def held_out(doc_id) -> object:
    """Column: rows that no label may be learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _starts(batches):
    """Of each task, for every word start: in how many abusive and other texts it is."""
    from collections import Counter

    counts = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {m.lower() for m in re.findall(r"[^\W\d_]+", text or "")}
            counts[toxic].update({w[:k] for w in words for k in STEM_LENGTHS if len(w) >= k})
    keys = [*{**counts[0], **counts[1]}]
    for at in range(0, len(keys), 50_000):
        part = keys[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[v][k] for k in part], pa.int64()) for v in (0, 1))], names=["stem", "clean", "toxic"])


def learn_stems(rows: DataFrame, most: int = STEMS) -> list[str]:
    """Word starts that are far more common in abusive texts of ``rows`` (toxic, text), the shortest of each kind; of
    these the ``most`` with the greatest lift."""
    of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not of.get(0) or not of.get(1):
        return []
    sums = rows.mapInArrow(_starts, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = (F.col("toxic") / of[1]) / ((F.col("clean") + 1) / of[0])
    found = sums.withColumn("lift", lift).filter((F.col("toxic") >= max(5, STEM_SHARE * of[1])) & (F.col("lift") >= STEM_LIFT))
    kept: dict[str, float] = {}
    for r in sorted(found.collect(), key=lambda r: (len(r["stem"]), -r["lift"], r["stem"])):  # word starts in a share of the sample
        x = r["stem"]
        if not any(x[:k] in kept for k in STEM_LENGTHS) and not any(t.startswith(x) for t in LEXICON):
            kept[x] = r["lift"]
    return sorted(sorted(kept, key=lambda x: (-kept[x], x))[:most])


class Scorer:
    """Automata and model; plain arrays, small enough to go with the tasks."""

    def __init__(self, terms=LEXICON, stems=()):
        self.automata = Automaton(terms), Automaton(stems, stem_edits, stems=True)
        self.stems = list(stems)
        self.model = Model()

    def features(self, texts) -> np.ndarray:
        parts = [features(self.automata, data, offsets) for _, _, data, offsets in _text.chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, COUNTS))


def fit(docs: DataFrame, labels: DataFrame | None, terms=LEXICON, sample: int = SAMPLE, stems: int = STEMS) -> Scorer:
    """Learned from at most ``sample`` labelled rows of each label that aren't held out, with ``stems`` stems at most.

    Of rows of one doc_id the least text is learned from."""
    if labels is None:
        return Scorer(terms)
    scratch = Scratch(docs.sparkSession, "toxic-sample")
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out("doc_id"))
    chosen = hash_sample(known, sample, scratch, "toxic")  # 2 * sample rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = scratch.cut(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text").repartition(8), "rows")
    scorer = Scorer(terms, learn_stems(rows, stems))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(scorer.features(batch.column(1))), pa.list_(pa.float64()))], names=["toxic", "x"])

    found = rows.mapInArrow(run, "toxic int, x array<double>").toPandas()
    if len(found):
        scorer.model.fit(np.array(found["x"].tolist(), float), found["toxic"].to_numpy(float))
    return scorer


def score(docs: DataFrame, labels: DataFrame | None, terms=LEXICON, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), n_terms for every row of ``docs`` (doc_id, text).

    A null text is an empty one; empty texts get the score of a text without terms. Rows repeat as in the input; a
    null doc_id is kept (held_out null). Extra columns are ignored; without labels, or with labels of one kind, a fixed
    model is used; an empty table gives an empty result."""
    scorer = fit(docs, labels, terms, sample)

    def run(batches):
        for batch in batches:
            x = scorer.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.model.score(x)), pa.array(x[:, :TERMS].sum(axis=1).astype(np.int64))], names=["doc_id", "score", "n_terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, n_terms long")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")


def keep_clean(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``docs`` without the rows whose text the model rejects; every column as it was.

    Each row goes or stays by its own text, whatever its doc_id is; null and empty texts stay, repeated rows go or stay
    together. An empty table gives an empty result."""
    scorer = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scorer.model.score(scorer.features(batch.column(at))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
