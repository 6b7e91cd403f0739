"""Places of pattern matches in a text, and the greedy choice among overlapping ones, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f) -> Column:
    """f of a value that is worked out once: within a lambda the engine shares no common part of an expression."""
    return F.get(F.transform(F.array(c), f), 0)


def find_spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """Array of (s, e, g) of every match: start, end and the groups' texts.

    A match's start is the length of the gaps up to it and of the matches before it. A text without a match is searched once only."""
    p = F.lit("(?U)" + pattern)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    none = F.array().cast("array<struct<s:int,e:int,g:array<string>>>")

    def spans(whole):
        parts = [F.regexp_extract_all(text, p, F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)]

        def span(r, x, i):
            s = total(F.slice(r["gaps"], 1, i + 1)) + total(F.slice(whole, 1, i))
            g = F.array(*[F.get(r[f"g{n}"], i) for n in range(1, groups + 1)], F.lit(""))
            return once(s, lambda at: F.struct(at.alias("s"), (at + F.length(x)).alias("e"), g.alias("g")))

        return once(F.struct(F.split(text, "(?U)" + pattern, -1).alias("gaps"), *parts), lambda r: F.transform(whole, lambda x, i: span(r, x, i)))

    return once(F.regexp_extract_all(text, p, F.lit(0)), lambda whole: F.when(F.size(whole) == 0, none).otherwise(spans(whole)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def inside(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda x: (x["s"] <= a["s"]) & (a["e"] <= x["e"]))


def first_claims(candidates: Column, kind: str) -> Column:
    """Of structs with s and e, in order, those that don't overlap one kept before. ``kind``: the array's type."""
    empty = F.array().cast(kind)
    return F.aggregate(candidates, empty, lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
