"""Which run and trace files of a folder to read, chosen from their names and times alone: no data file is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of run files: eval_joined, then maybe a domain or `pooled`, a time stamp, and whatever follows it (fixed form).
RUN_NAME = r"^eval_joined_(?:(?:(.+?)_)?(\d{8}_\d{6}).*|.*)\.csv$"
TRACE_NAME = r"^trace_(\d{8}_\d{6})?.*\.jsonl$"
POOLED, CALIBRATED = "pooled", "_calibrated"


def files_of(spark: SparkSession, folder: str, names: str = "*", nested: bool = False) -> DataFrame:
    """path and changed (time of change) of a folder's files; their contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", nested).load(folder)
    return listed.select("path", F.col("modificationTime").alias("changed"))


def catalogue(files: DataFrame) -> DataFrame:
    """path, changed, kind (run or trace), domain (null: none in the name), stamp and calibrated of the files whose names are known."""
    name = F.substring_index("path", "/", -1)
    run, trace = name.rlike(RUN_NAME), name.rlike(TRACE_NAME)
    given = lambda c: F.nullif(c, F.lit(""))
    stamp = F.when(run, F.regexp_extract(name, RUN_NAME, 2)).otherwise(F.regexp_extract(name, TRACE_NAME, 1))
    parts = [F.when(run, "run").when(trace, "trace").alias("kind"), F.when(run, given(F.regexp_extract(name, RUN_NAME, 1))).alias("domain"), given(stamp).alias("stamp"), F.contains(name, F.lit(CALIBRATED)).alias("calibrated")]
    return files.select("path", "changed", *parts).filter("kind is not null")


NEWEST = "struct(changed, path)"


def newest(files: DataFrame, *keys: str) -> DataFrame:
    """The last changed file of each key, of equals the last by path; an aggregate of one row a key."""
    rest = [c for c in files.columns if c not in keys]
    latest = files.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.expr(NEWEST)).alias("_f"))
    return latest.filter("_f is not null").select(*keys, "_f.*")


def joined_runs(files: DataFrame) -> DataFrame:
    """The newest pooled run file that isn't calibrated; where there is none, all others that aren't calibrated."""
    raw = files.filter("kind = 'run' and not calibrated")
    is_pooled = F.coalesce(F.col("domain").contains(POOLED), F.lit(False))
    pooled = newest(raw.filter(is_pooled)).select(*files.columns)
    none = raw.agg(F.coalesce(F.bool_or(is_pooled), F.lit(False)).alias("_pooled")).filter("not _pooled")
    return pooled.unionByName(raw.crossJoin(F.broadcast(none)).drop("_pooled"))


def calibrated_first(files: DataFrame) -> DataFrame:
    """The newest calibrated run file, or else the newest, with the name of its confidence column."""
    order = F.struct("calibrated", "changed", "path")
    best = files.filter("kind = 'run'").agg(F.max_by(F.struct(*files.columns), order).alias("_f")).filter("_f is not null").select("_f.*")
    return best.withColumn("column", F.when(F.col("calibrated"), "confidence_cal").otherwise("confidence"))


def newest_by_domain(files: DataFrame) -> DataFrame:
    """The newest run file of each domain that a name gives, pooled ones apart."""
    return newest(files.filter(F.col("domain").isNotNull() & ~F.col("domain").contains(POOLED) & (F.col("kind") == "run")), "domain").select(*files.columns)


def with_traces(runs: DataFrame, files: DataFrame) -> DataFrame:
    """`runs` (rows of a catalogue) with the path of their trace: of the same stamp, or else the newest there is, or null."""
    traces = files.filter("kind = 'trace'")
    same = newest(traces.filter("stamp is not null"), "stamp").select("stamp", F.col("path").alias("_same"))
    any_trace = traces.agg(F.max_by("path", F.expr(NEWEST)).alias("_any"))
    return runs.join(same, "stamp", "left").crossJoin(F.broadcast(any_trace)).select(*runs.columns, F.coalesce("_same", "_any").alias("trace"))
