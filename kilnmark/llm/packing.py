"""Best-fit packing: bounded-space online best-fit of token pieces into sequences.

A fixed number of bins is open at a time. A bitset has one bit for each amount of free space that some open bin has;
the best fit of a piece of length l is the lowest set bit at or above l, which one shift and one bit trick find.
If none fits and all places are taken, the fullest open bin closes first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, runs

#: Tokens of a sequence, bins open at a time.
CAPACITY, OPEN = 4096, 512


class BestFit:
    """Places pieces one by one; bins are numbered in the order in which they open."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN):
        self.capacity, self.most = capacity, bins
        self.free_bits, self.by_free = 0, {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        b = held.pop()
        if not held:
            del self.by_free[free]
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``capacity`` tokens."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            b, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(b)
            self.free_bits |= 1 << left
            self.open += 1
        return b, self.capacity - free


def pieces(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary).

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut. A null text is an empty one."""

    def run(batches):
        known = encoder(path, kind)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for ids, texts in runs(batch):
                out = []
                for doc, raw in zip(ids, known.encode(texts), strict=True):
                    raw += end
                    for p in range(0, len(raw), step):
                        part = raw[p : p + step]
                        out.append((doc, p // step, p // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=[f.split()[0] for f in schema.split(", ")])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(lengths: DataFrame, capacity: int = CAPACITY, bins: int = OPEN) -> DataFrame:
    """``lengths`` (doc_id, piece, length of 1 to capacity, further columns) with sequence_id and offset.

    Pieces are dealt by a hash of their document, so that a rerun task sees the same pieces in the same order; Spark
    joins small partitions, so that the few bins a task leaves open at its end count little at any size."""
    fields = [f for f in lengths.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    names = [f.name for f in fields]

    def run(batches):
        from pyspark import TaskContext

        base, packer = TaskContext.get().partitionId() << 40, BestFit(capacity, bins)
        for batch in batches:
            placed = [packer.place(x) for x in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            extra = [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *extra], names=[*names, "sequence_id", "offset"])

    dealt = lengths.select(*names).repartition(F.col("doc_id")).sortWithinPartitions(*[c for c in ("doc_id", "piece", "length", "ids_crc32") if c in names])
    return dealt.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, bins: int = OPEN) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed as often as they come; extra columns are
    ignored; an empty table gives an empty result."""
    return pack(pieces(docs, path, kind, end_id, capacity), capacity, bins)


def sequences(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, bins: int = OPEN) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (little-endian unsigned 32-bit), doc_ids."""
    placed = pack(pieces(docs, path, kind, end_id, capacity, with_ids=True), capacity, bins)
    each = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"), F.sum("length").alias("length"))
    return each.select("sequence_id", "length", F.expr("array_join(transform(parts, x -> hex(x.ids)), '')").alias("hex"), F.col("parts.doc_id").alias("doc_ids")).select("sequence_id", "length", F.unhex("hex").alias("ids"), "doc_ids")
