"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where it is unset, one of our own in a local session, or else an error."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: later stages survive lost executors without recomputing it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys of a join that may be hot.
MOST_HOT = 10_000


def spread(rows: DataFrame, keyed: DataFrame, counts: DataFrame, keys: list[str], total: int, by: Column) -> DataFrame:
    """`rows` joined to `keyed` (a row for each value of `keys`) with hot values dealt over several tasks, by the hash of `by`.

    counts: `keys` and n, the rows that have them; total: all rows. A value is hot above a MOST_HOT-th of all rows, so that there
    are never more than MOST_HOT of them to broadcast, whatever the table.
    """
    limit = max(64, -(-total // MOST_HOT))
    hot = F.broadcast(counts.filter(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("pieces")))
    dealt = rows.join(hot, keys, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64(by), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    copies = keyed.join(hot, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return dealt.join(copies, [*keys, "piece"]).drop("piece")


#: Statistics at or above this say that Spark doesn't know a plan's size.
UNKNOWN = 1 << 60


def input_bytes(docs: DataFrame) -> int:
    """Size of a documents plan: as Spark's statistics have it, or else the bytes of its texts, summed in one pass."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return size


def partitions_for(docs: DataFrame, bytes_each: int) -> int:
    """At least the session's shuffle partitions, and so many that none holds more than `bytes_each` of the input."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(docs) // bytes_each))


def id_and_text(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and text (null: empty), without whatever other columns the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values on end, and the offsets of each (one more than values). Nulls are empty."""
    values = column.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(ends) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most_bytes` of `column`; a longer value comes alone."""
    n = batch.num_rows
    if not n:
        return
    _, ends = packed(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + most_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield batch.slice(first, last - first)
        first = last


class Memo(dict):
    """Results of `fn` by argument, for the life of a Python worker; emptied when `limit` entries are reached."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


class Recent:
    """Results by key in two generations of at most `limit` entries: what a block of keys still uses outlives a full one."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Those of `keys` that aren't known; the others are in `new` from now on."""
        if len(self.new) + len(keys) > self.limit:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for key in keys:
            if key not in new:
                value = old.get(key)
                if value is None:
                    out.append(key)
                else:
                    new[key] = value
        return out
