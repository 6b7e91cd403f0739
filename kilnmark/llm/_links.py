"""Verified links between classes that meet in buckets, and their components, without emitting all pairs of a bucket.

Each bucket's members are compared in blocks of bounded size by sketches that can rule a link out. At first a block
emits a spanning forest of what they can't rule out; these pairs are verified and merge components. Then only pairs
between different components are left, and all of these that the sketches can't rule out are verified: nothing is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch
from .components import components

#: Members of a block.
BLOCK = 512


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A parity sketch of fewer words: bit b of it is the parity of the bits that are b modulo its length."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


class _Sketches:
    """Parity sketches of a block's members, which are longer for larger sets; two are compared at the shorter length."""

    def __init__(self, raw: list[bytes]):
        parts = [np.frombuffer(x, np.uint64) for x in raw]
        self.words = np.array([len(p) for p in parts])
        self.levels, self.at = [], []
        for w in np.unique(self.words).tolist():
            has = np.flatnonzero(self.words >= w)
            at = np.full(len(parts), -1)
            at[has] = np.arange(len(has))
            self.levels.append((w, np.stack([folded(parts[i], w) for i in has.tolist()])))
            self.at.append(at)

    def differ(self, i: int) -> np.ndarray:
        """Bits in which member i differs from each later one."""
        rest = np.arange(i + 1, len(self.words))
        out = np.zeros(len(rest), np.int64)
        for (w, bits), at in zip(self.levels, self.at, strict=True):
            if w > self.words[i]:
                break
            now = np.flatnonzero(self.words[rest] >= w if w == self.words[i] else self.words[rest] == w)
            if len(now):
                out[now] = np.bitwise_count(bits[at[rest[now]]] ^ bits[at[i]]).sum(axis=1, dtype=np.int64)
        return out


def _pairs(t: Fraction, forest: bool, every: bool):
    """For the buckets (token, block pair) of one group: candidate pairs that join present components.

    A pair must have sizes within t, sketches that differ by less than a link allows, and common bits in the maps of
    its prefixes under each further order. ``forest``: a spanning forest of each block; else all such pairs, each in
    the bucket of the first prefix token that both have. ``every``: pairs within components too."""

    def run(table: pa.Table) -> pa.Table:
        token, blk, cls, comp, n, part, cross = (table.column(c).to_numpy() for c in ("token", "pair", "class", "component", "n", "own", "cross"))
        sketches, maps = table.column("sketch").to_pylist(), table.column("orders").to_pylist()
        tokens = table.column("tokens")
        order = np.lexsort((cls, blk, token))
        cuts = np.append(np.flatnonzero(np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (blk[order][1:] != blk[order][:-1])))), len(order))
        ra: list[int] = []
        rb: list[int] = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[x:y]
            c = comp[at]
            if y - x < 2 or not every and (c == c[0]).all():
                continue
            sketch = _Sketches([sketches[i] for i in at.tolist()])
            orders = np.frombuffer(b"".join(maps[i] for i in at.tolist()), np.uint64).reshape(len(at), _ORDERS, -1)
            size, lows, highs, diffs = n[at], [], [], []
            for i in range(len(at) - 1):
                rest = slice(i + 1, len(at))
                diff = sketch.differ(i)
                ok = diff * (t.denominator + t.numerator) <= (t.denominator - t.numerator) * (size[i] + size[rest])
                ok &= np.minimum(size[i], size[rest]) * t.denominator >= t.numerator * np.maximum(size[i], size[rest])
                ok &= (orders[rest] & orders[i]).any(axis=2).all(axis=1)
                if not every:
                    ok &= c[rest] != c[i]
                if cross[at[i]]:  # pairs of one block have their own group
                    ok &= part[at[rest]] != part[at[i]]
                j = np.flatnonzero(ok)
                if len(j):
                    lows.append(np.full(len(j), i))
                    highs.append(j + i + 1)
                    diffs.append(diff[j])
            if not lows:
                continue
            low, high, diff = np.concatenate(lows), np.concatenate(highs), np.concatenate(diffs)
            if not forest:
                own, heads = int(token[at[0]]), {i: set(tokens[i].as_py()) for i in {*at[low].tolist(), *at[high].tolist()}}
                for i, j in zip(at[low].tolist(), at[high].tolist(), strict=True):
                    if min(heads[i] & heads[j]) == own:  # in one bucket only
                        ra.append(int(cls[i]))
                        rb.append(int(cls[j]))
                continue
            rank = np.argsort(diff, kind="stable")
            root = {k: k for k in c.tolist()}

            def find(k, root=root):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            parts = len(root)
            for i, j in zip(low[rank].tolist(), high[rank].tolist(), strict=True):
                a, z = find(int(c[i])), find(int(c[j]))
                if a != z:
                    root[a] = z
                    ra.append(int(cls[at[i]]))
                    rb.append(int(cls[at[j]]))
                    parts -= 1
                    if parts == 1:
                        break
        return pa.table({"a": pa.array(ra, pa.int64()), "b": pa.array(rb, pa.int64())})

    return run


#: Orders beside the one whose prefix tokens are the buckets.
_ORDERS = 2


def _candidates(entries: DataFrame, payload: DataFrame, state: DataFrame, t: Fraction, groups: int, forest: bool, every: bool) -> DataFrame:
    rows = entries.join(state, "class")
    # buckets with one component are done; only the rows of others are joined with what comparing needs
    sizes = rows.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = sizes.filter("lo <> hi").select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "token").withColumn("own", F.expr("cast(pmod(xxhash64(class), blocks) as int)"))
    if forest:
        payload = payload.withColumn("tokens", F.lit(None).cast("array<bigint>"))
    rows = rows.join(payload, "class")
    ij = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own")))
    rows = rows.withColumn("pair", F.explode(ij))
    rows = rows.withColumn("cross", F.floor(F.col("pair") / F.col("blocks")) != F.col("pair") % F.col("blocks"))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("token", "pair"), F.lit(groups)))
    rows = rows.select("lane", "token", "pair", "class", "component", "n", "sketch", "orders", "own", "cross", "tokens")
    return rows.groupBy("lane").applyInArrow(_pairs(t, forest, every), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(entries: DataFrame, payload: DataFrame, t: Fraction, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, groups: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(state, links): class and component of every class in ``entries``, and the verified links that span them, or
    with ``every`` all links between classes.

    ``entries``: token (bucket), class. ``payload``, one row a class: class, n, sketch, orders (maps of the prefixes
    under the further orders), tokens (all its buckets). ``verify``: pairs (a, b) to (a, b, link)."""
    state = scratch.cut(entries.select("class", F.col("class").alias("component")).distinct(), "state")
    links = None
    for forest in (False,) if every else (True, False):
        tested = verify(_candidates(entries, payload, state, t, groups, forest, every))
        new = scratch.cut(tested.filter("link").select("a", "b"), "links")
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            of = lambda c: state.select(F.col("class").alias(c), F.col("component").alias(f"{c}_of"))
            joined = new.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))
            found = components(joined, scratch).select(F.col("id").alias("component"), F.col("component").alias("to"))
            state = scratch.cut(state.join(found, "component", "left").select("class", F.coalesce("to", "component").alias("component")), "state")
    return state, links
