"""Round trips through the readers and writers, and the streaming jobs, over the given tables."""

import uuid

from pyspark.sql import functions as F

from tessera.registry import register
from tessera.sources import files
from tessera.sources.shared import scratch
from tessera.sources.views import runs, table, with_views
from tessera.streaming import jobs

#: Rows of a file that ingest_files writes.
LINES_EACH = 10_000


@register("read_jsonl", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def read_jsonl(spark, d):
    path = scratch(spark, "jsonl")
    files.write_jsonl(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    back = files.read_jsonl(spark, path, "event_id long, event_type string, value double")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("write_jsonl", "SELECT count(*) AS n FROM benchmark, (SELECT unnest([1, 2]))")
def write_jsonl(spark, d):
    path, items = scratch(spark, "append"), table(spark, d, "benchmark")
    files.write_jsonl(items, path)
    files.write_jsonl(items, path, append=True)
    return files.read_jsonl(spark, path, "item_id long, text string", strict=True).agg(F.count("*").alias("n"))


@register("read_runs", with_views("SELECT mode, count(*) AS n, count(*) FILTER (WHERE mode = 'M1') * 0.5 AS defaulted FROM runs GROUP BY mode", "runs"))
def read_runs(spark, d):
    a, b, df = scratch(spark, "a"), scratch(spark, "b"), runs(spark, d)
    files.write_csv(df.filter("mode = 'M1'").select("id", "mode", "success"), a)
    files.write_csv(df.filter("mode <> 'M1'").select("id", "mode", "success", F.lit(0.0).alias("confidence")), b)
    back = files.read_runs(spark, [a, b], {"confidence": 0.5})
    return back.groupBy("mode").agg(F.count("*").alias("n"), F.sum("confidence").alias("defaulted"))


@register("write_csv", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def write_csv(spark, d):
    path = scratch(spark, "csv")
    files.write_csv(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), path)
    return spark.read.option("header", True).csv(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@register("append_trace", with_views("SELECT mode, count(*) AS n FROM runs GROUP BY mode", "runs"))
def append_trace(spark, d):
    path, df = scratch(spark, "trace"), runs(spark, d).select("id", "mode", "success", F.array(F.struct(F.lit("MEM").alias("source"))).alias("steps"))
    files.append_trace(df.filter("mode in ('M1', 'M2')"), path)
    files.append_trace(df.filter("mode not in ('M1', 'M2')"), path)
    return spark.read.parquet(path).groupBy("mode").agg(F.count("*").alias("n"))


@register("export_tables", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY n_regionkey")
def export_tables(spark, d):
    (path,) = files.export_tables({"nations": table(spark, d, "nation")}, scratch(spark, "export"))
    return spark.read.option("header", True).csv(path).groupBy(F.col("n_regionkey").cast("int").alias("region")).agg(F.count("*").alias("n"))


@register("read_text_docs", "SELECT count(*) AS n_files, CAST(sum(length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) AS BIGINT) AS n_chars FROM benchmark")
def read_text_docs(spark, d):
    path = scratch(spark, "docs")
    items = table(spark, d, "benchmark")
    items.select("text").write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return files.read_text_docs(spark, path, one_line=True).agg(F.count("*").alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


@register("ingest_files", "SELECT 'csv' AS kind, (SELECT count(*) FROM orders) AS n_lines UNION ALL SELECT 'json', (SELECT count(*) FROM events)")
def ingest_files(spark, d):
    """Tables that grow, in files of bounded size, since a file is a row to the reader."""
    path = scratch(spark, "ingest")
    table(spark, d, "orders").write.option("header", True).option("maxRecordsPerFile", LINES_EACH).csv(path)
    table(spark, d, "events").write.option("maxRecordsPerFile", LINES_EACH).mode("append").json(path)
    return _ingested_lines(spark, path)


def _ingested_lines(spark, path):
    """Lines with text by kind, of what ingest_files returns."""
    good, _ = files.ingest_files(spark, path)
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return good.groupBy("kind").agg(F.sum(lines).cast("long").alias("n_lines"))


@register("memory_persistence", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n FROM conversations GROUP BY conv_id")
def memory_persistence(spark, d):
    from tessera.operators import memory

    path, rows = scratch(spark, "memories"), _memories(spark, d)
    memory.add(rows.filter("turn % 2 = 0"), path, 1)
    memory.add(rows.filter("turn % 2 = 1"), path, 2)
    return memory.read(spark, path, rows.schema).groupBy("session_id").agg(F.count("*").alias("n"))


def _memories(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("content"), "turn")


@register("memory_log", """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n, CAST(sum(turn) AS BIGINT) AS turns FROM conversations WHERE conv_id % 5 <> 0 OR turn % 3 = 2 GROUP BY conv_id""")
def memory_log(spark, d):
    """Turns in three batches, one of them written twice; sessions are flushed before the last; the first two are compacted."""
    from tessera.operators import memory

    path, rows = scratch(spark, "memories"), _memories(spark, d)
    memory.add(rows.filter("turn % 3 = 0"), path, 1)
    for _ in range(2):
        memory.add(rows.filter("turn % 3 = 1"), path, 2)
    memory.flush(rows.filter("session_id % 5 = 0"), path, 3)
    memory.compact(spark, path, 3, rows.schema)
    memory.add(rows.filter("turn % 3 = 2"), path, 4)
    return memory.read(spark, path, rows.schema).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


@register("memory_reset", "SELECT count(*) AS n FROM conversations WHERE turn % 2 = 1")
def memory_reset(spark, d):
    from tessera.operators import memory

    path, rows = scratch(spark, "memories"), _memories(spark, d)
    memory.add(rows.filter("turn % 2 = 0"), path, 1)
    memory.reset(spark, path, 1, rows.schema)
    memory.add(rows.filter("turn % 2 = 1"), path, 2)
    return memory.read(spark, path, rows.schema).agg(F.count("*").alias("n"))


@register("stream_trace_summary", "SELECT event_type AS mode, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(value), 4) AS avg_latency_ms FROM events GROUP BY event_type")
def stream_trace_summary(spark, d):
    traces = _event_stream(spark, d)
    name = "traces_" + uuid.uuid4().hex
    jobs.run_available(jobs.trace_summary(traces), name, scratch(spark, "stream"))
    return spark.table(name)


def _event_stream(spark, d):
    path = scratch(spark, "events")
    e = table(spark, d, "events").select(F.col("event_type").alias("mode"), (F.col("value") > 50).cast("int").alias("success"), F.col("value").alias("latency_ms"))
    e.repartition(4).write.json(path)
    return jobs.read_traces(spark, path, "mode string, success int, latency_ms double", files_per_trigger=2)


@register("stream_memory_append", "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def stream_memory_append(spark, d):
    from tessera.operators import memory

    source, out = scratch(spark, "in"), scratch(spark, "out")
    _memories(spark, d).select("session_id", "content").repartition(3).write.json(source)
    stream = jobs.read_traces(spark, source, "session_id string, content string", files_per_trigger=1)
    jobs.append_memories(stream, out, scratch(spark, "stream"), lambda c: F.array(F.length(c).cast("double")))
    rows = memory.read(spark, out, spark.createDataFrame([], "session_id string, content string, embedding array<double>").schema)
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.get("embedding", F.lit(0)).cast("long")).alias("n_chars"))
