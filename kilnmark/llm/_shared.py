"""Shared-folder helpers: everything that cuts lineage is written where all executors can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``. Where that is unset a local session gets a folder of
    its own; on a cluster, where no local folder is shared, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kilnmark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found.rstrip("/")


class Scratch:
    """A folder of its own below the shared one, for written intermediate tables; deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        at, fs = self._at(self.path)
        fs.deleteOnExit(at)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> str:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return path

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: the lineage ends here and survives lost executors."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df, name))

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table of this folder that nothing reads any more."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at, fs = self._at(name)
            fs.delete(at, True)


#: A key with more than this share of the rows of a join is joined by a broadcast row; there can be 1 / SHARE of them.
SHARE = 1 / 2048


def join_by_size(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) on ``key`` with ``table``, which has one row a key and how many of ``rows`` have it.

    Keys of more than a SHARE of all these rows, 1 / SHARE keys at most, are broadcast, so that no task gets all rows
    of a common key; the others are shuffled. Both sides are read twice: they should be written tables."""
    total = table.agg(F.sum(size).alias("n")).first()["n"] or 0
    least = max(1000.0, total * SHARE)
    heavy, light = table.filter(F.col(size) > least), table.filter(F.col(size) <= least)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def hash_sample(rows: DataFrame, size: int, scratch: Scratch, by: str | None = None) -> DataFrame:
    """At most ``size`` distinct rows, or so many for each value of ``by``: those whose hash over all columns is least.

    An estimate of the distinct rows gives a bound on the hash that about a third more than ``size`` rows meet; only
    these are shuffled, so no task sorts more of them however many tasks there are, and repeated rows count once."""
    hashed = rows.withColumn("__h", F.xxhash64(*rows.columns))
    group = [by] if by else []
    counts = scratch.cut(hashed.groupBy(*group).agg(F.approx_count_distinct("__h", 0.02).alias("__n")), "counts")  # a row for each value of ``by``
    share = F.least(F.lit(1.0), F.lit(1.2 * size + 200) / F.col("__n"))
    bounds = F.broadcast(counts.select(*group, F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long")).alias("__most")))
    few = hashed.join(bounds, group) if by else hashed.crossJoin(bounds)  # one row of bounds
    few = few.filter("__h <= __most").drop("__most").dropDuplicates([*group, "__h"])
    few = scratch.cut(few, "few")
    rank = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("__h"))  # about 1.2 * size + 200 rows a group
    kept = few.select(*group, "__h").withColumn("__r", rank).filter(F.col("__r") <= size).select(*group, "__h")
    return few.join(F.broadcast(kept), [*group, "__h"]).select(*rows.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
