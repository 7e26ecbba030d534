"""The two append patterns as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import memory


def read_traces(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000, format: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def trace_summary(traces: DataFrame, key: str = "mode") -> DataFrame:
    """n, accuracy and mean latency by mode, as a running aggregate: its state is a row for each mode."""
    return traces.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("success"), 6).alias("accuracy"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"))


def run_available(df: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Run what there is into an in-memory table of aggregates and stop."""
    query = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_memories(stream: DataFrame, path: str, checkpoint: str, embed: Callable[[Column], Column]) -> StreamingQuery:
    """Embed each micro-batch and append it to the session log at `path`; a repeated batch replaces itself by its number."""

    def write(batch: DataFrame, number: int) -> None:
        memory.add(batch.withColumn("embedding", embed(F.col("content"))), path, number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
