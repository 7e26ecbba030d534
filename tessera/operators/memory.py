"""Session memories as a log of batches in a shared folder.

A batch is a folder of at most BUCKETS files, by hash of the session, so a million sessions make no more files than one. A batch
that is written again under its number replaces itself. A flush is a row of its own (a tombstone) in a batch: it hides the rows of its
session in earlier batches. Compaction writes the live rows of all batches up to one as a snapshot and then names it in the
catalogue; readers take the latest named snapshot and the batches after it, and never see half of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MEMORY = "session_id string, content string, embedding array<double>, ts timestamp"
BUCKETS = 256
ROW, FLUSH = "row", "flush"
CATALOGUE = "upto long, folder string"


def bucket_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, folder: str) -> None:
    # Files of a bucket come from one task, so a batch has as many files as it has buckets at most.
    rows.withColumn("bucket", bucket_of(F.col("session_id"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def add(memories: DataFrame, path: str, batch: int) -> None:
    """Write `memories` (session_id and any other columns; all batches alike) as a batch; batches have ascending numbers."""
    _write(memories.withColumn("kind", F.lit(ROW)), f"{path}/log/batch={batch}")


def flush(sessions: DataFrame, path: str, batch: int) -> None:
    """Write a batch of tombstones: earlier rows of these session_ids are gone."""
    _write(sessions.select("session_id").distinct().withColumn("kind", F.lit(FLUSH)), f"{path}/log/batch={batch}")


def _catalogue(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The latest snapshot and the batch that it goes up to."""
    try:
        last = spark.read.schema(CATALOGUE).parquet(f"{path}/catalogue").agg(F.max(F.struct("upto", "folder")).alias("x")).first()["x"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    return (-1, None) if last is None else (last["upto"], last["folder"])


def _log(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    full = StructType([*schema.fields, StructField("kind", spark.range(0).select(F.lit("").alias("x")).schema["x"].dataType), StructField("batch", LongType())])
    try:
        return spark.read.schema(full).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Live rows with their batch. schema: of the memories, by default MEMORY."""
    schema = schema or spark.createDataFrame([], MEMORY).schema
    upto, folder = _catalogue(spark, path)
    log = _log(spark, path, schema)
    names = [*schema.fieldNames(), "batch"]
    rows = spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())]))
    later = None
    if log is not None:
        later = log.filter(F.col("batch") > upto)
        rows = later.filter(F.col("kind") == ROW).select(*names)
    if folder is not None:
        kept = spark.read.schema(rows.schema).parquet(folder).select(*names)
        rows = kept.unionByName(rows)
    if later is None:
        return rows
    gone = later.filter(F.col("kind") == FLUSH).groupBy(F.col("session_id").alias("_s")).agg(F.max("batch").alias("_flushed"))
    live = rows.join(gone, F.col("session_id").eqNullSafe(F.col("_s")), "left")
    return live.filter(F.col("_flushed").isNull() | (F.col("batch") >= F.col("_flushed"))).select(*names)


def compact(spark: SparkSession, path: str, upto: int, schema: StructType | None = None) -> None:
    """Live rows of the batches up to `upto` as a snapshot of at most BUCKETS files; later batches stay as they are."""
    live = read(spark, path, schema).filter(F.col("batch") <= upto)
    folder = f"{path}/snapshot-{upto}"
    _write(live, folder)
    spark.createDataFrame([(upto, folder)], CATALOGUE).coalesce(1).write.mode("append").parquet(f"{path}/catalogue")


def reset(spark: SparkSession, path: str, upto: int, schema: StructType | None = None) -> None:
    """Nothing is live in the batches up to `upto` from now on."""
    schema = schema or spark.createDataFrame([], MEMORY).schema
    empty, folder = spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())])), f"{path}/snapshot-{upto}-empty"
    empty.write.mode("overwrite").parquet(folder)
    spark.createDataFrame([(upto, folder)], CATALOGUE).coalesce(1).write.mode("append").parquet(f"{path}/catalogue")


def flushed(memories: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """What stays without a session, and a row with how many go."""
    gone = F.coalesce(F.col("session_id") == session, F.lit(False))
    return memories.filter(~gone), memories.agg(F.count_if(gone).alias("removed"))


def seed(rows: DataFrame) -> DataFrame:
    """session_id and content from rows in any of the accepted forms: text, memory, content or doc."""
    names = [c for c in ("text", "memory", "content", "doc") if c in rows.columns]
    session = F.coalesce("session_id", F.lit("s1")) if "session_id" in rows.columns else F.lit("s1")
    content = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names])
    return rows.select(session.alias("session_id"), content.alias("content")).filter("content is not null")


def reindex(memories: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """All contents embedded anew by `embed` (a function from a column to a column)."""
    return memories.drop("embedding").withColumn("embedding", embed(F.col("content")))
