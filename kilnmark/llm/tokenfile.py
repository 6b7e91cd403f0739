"""Token-id files: concatenated ids of many documents, with Elias-Fano coded boundaries.

A table in the file format is a folder of Parquet rows written by Spark's own committer, so that it can be in any
store and a task that is run again leaves no second copy. Each row is one *shard*: a byte string that stands alone.

Shard, little-endian: ``b"KMEF1\\0"``, u16 bytes an id (2 or 4), u64 documents, u64 ids, u64 null doc_ids (which come
first), i64 least doc_id, then the Elias-Fano lists of document ends and of doc_ids above the least (u8 low bits, u64
bytes of the low part, u64 bytes of the high part, u64 bytes of the u32 select samples, the parts), then the ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch
from .tokens import encoder, runs

#: Every so many values a select sample; ids in a shard, about.
EVERY, SHARD_IDS = 64, 1_000_000
_HEAD = struct.Struct("<6sHQQQq")
_PART = struct.Struct("<BQQQ")


class EliasFano:
    """An ascending list of non-negative integers: l low bits each, the rest as gaps in unary, and sampled positions."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._low_view, self._high_view = memoryview(low), memoryview(high)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        if int(ones[-1]) >> 32:
            raise ValueError("too many values for 32-bit samples: write smaller shards")
        high = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, bits, low, high, ones[::EVERY].astype("<u4"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        b = a + self.low_bits
        whole = int.from_bytes(self._low_view[a >> 3 : (b + 7) >> 3], "little")
        return (whole >> (a & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, at most EVERY ones are counted."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, need = int(self.samples[i // EVERY]), i % EVERY
        high, byte = self._high_view, at >> 3
        first = high[byte] >> (at & 7) << (at & 7)
        while need >= (ones := first.bit_count()):
            need -= ones
            byte += 1
            first = high[byte]
        for _ in range(need):
            first &= first - 1
        one = 8 * byte + (first & -first).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1).astype(np.int64)
            out |= (bits << np.arange(self.low_bits)).sum(axis=1)
        return out

    def tobytes(self) -> bytes:
        parts = self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return _PART.pack(self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def frombytes(cls, data: bytes, at: int, n: int) -> tuple[EliasFano, int]:
        bits, *sizes = _PART.unpack_from(data, at)
        at += _PART.size
        parts = []
        for size, kind in zip(sizes, (np.uint8, np.uint8, np.dtype("<u4")), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, bits, *parts), at


def write_shard(doc_ids: list[int | None], ids: list[bytes], id_bytes: int) -> bytes:
    """``doc_ids`` ascending, nulls first; ``ids`` as little-endian unsigned 32-bit."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    flat = np.frombuffer(b"".join(ids), "<u4")
    if len(flat) and int(flat.max()) >> (8 * id_bytes):
        raise ValueError(f"an id does not fit {id_bytes} bytes")
    flat = flat.astype(f"<u{id_bytes}")
    head = _HEAD.pack(b"KMEF2\0", id_bytes, len(doc_ids), len(flat), nulls, least)
    above = (known.view(np.uint64) - np.int64(least).view(np.uint64)) if len(known) else known.view(np.uint64)
    return head + EliasFano.encode(ends).tobytes() + EliasFano.encode(above).tobytes() + flat.tobytes()


class Shard:
    """Reads a shard; ``ids(i)`` are those of the i-th document, found by two selects."""

    def __init__(self, data: bytes):
        magic, width, self.n, self.n_ids, self.nulls, self.least = _HEAD.unpack_from(data)
        if magic != b"KMEF2\0":
            raise ValueError("not a token-id shard")
        self.ends, at = EliasFano.frombytes(data, _HEAD.size, self.n)
        self.docs, at = EliasFano.frombytes(data, at, self.n - self.nulls)
        self.flat = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def ids(self, i: int) -> np.ndarray:
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + self.docs.select(i) for i in range(self.docs.n)]


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = 0, id_bytes: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, append ``end_id``, and write shards in ascending doc_id order to ``path``."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        known, end = encoder(tokenizer, kind), np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        held: list[int | None] = []
        size = 0

        def shard():
            nonlocal seq, ids, held, size
            data = write_shard(held, ids, id_bytes)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "data"])
            seq, ids, held, size = seq + 1, [], [], 0
            return row

        for batch in batches:
            for keys, texts in runs(batch):
                for d, raw in zip(keys, known.encode(texts), strict=True):
                    held.append(d)
                    ids.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= shard_ids:
                        yield shard()
        if held:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(run, "part long, seq long, n_docs long, n_ids long, data binary").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Places within a shard are found by select, one document after the other."""

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = Shard(data)
                ends = [s.ends.select(i) for i in range(s.n)]
                starts = [0, *ends[:-1]]
                flat = memoryview(s.flat.astype("<u4")).cast("B") if s.n_ids else b""
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * s.n, pa.int64()), pa.array([seq] * s.n, pa.int64()), pa.array(s.doc_ids(), pa.int64()), pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    shards = spark.read.schema("part long, seq long, n_docs long, n_ids long, data binary").parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_at")).join(parts, "part")
    docs = shards.select("part", "seq", "data").mapInArrow(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(at, ["part", "seq"]).select("doc_id", (F.col("part_at") + F.col("shard_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, id_bytes: int = 2) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone. Null doc_ids come first; rows of one doc_id go by their text. Extra
    columns are ignored; an empty table gives an empty result."""
    spark = docs.sparkSession
    path = f"{Scratch(spark, 'token-ids').path}/files"
    write(docs, path, tokenizer, kind, end_id, id_bytes)
    return read(spark, path)
