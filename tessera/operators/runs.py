"""Run tables: repeats, latest runs, pairs of modes, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _nth(keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by `order`."""
    return df.withColumn("_nth", _nth(keys, [F.desc(c) for c in order])).filter("_nth = 1").drop("_nth")


def dedup_keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str], keep_blank: str | None = None) -> DataFrame:
    """The first row of each key by `order`; with `keep_blank`, rows whose value there is null or blank all stay."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.asc(c) for c in order]))
    blank = F.lit(False) if keep_blank is None else F.coalesce(F.trim(F.col(keep_blank)) == "", F.lit(True))
    return df.withColumn("_nth", first).withColumn("_blank", blank).filter("_nth = 1 or _blank").drop("_nth", "_blank")


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """At most `cap` rows of each group, the first by `order`."""
    return df.withColumn("_nth", _nth(keys, [F.asc(c) for c in order])).filter(F.col("_nth") <= cap).drop("_nth")


def sample_per_group(df: DataFrame, keys: Sequence[str], key: str, k: int, seed: str = "13") -> DataFrame:
    """k rows of each group in the order of md5(key, seed): the same rows whatever the partitioning."""
    return df.withColumn("_nth", _nth(keys, [F.md5(F.concat(F.col(key), F.lit(seed))), F.col(key)])).filter(F.col("_nth") <= k).drop("_nth")


def latest_run_per_domain(df: DataFrame) -> DataFrame:
    """Rows of each domain's greatest run_id: a small aggregate joined back, so a large domain isn't one window task."""
    latest = df.groupBy(F.col("domain").alias("_d")).agg(F.max("run_id").alias("_r"))
    return df.join(latest, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("_r").isNull() | (F.col("run_id") == F.col("_r"))), "left_semi")


def latest_run(df: DataFrame, priority: Column) -> DataFrame:
    """The one run of greatest (priority, run_id)."""
    best = df.agg(F.max_by("run_id", F.struct(priority.alias("p"), F.col("run_id").alias("r"))).alias("_r"))
    return df.join(F.broadcast(best), F.col("run_id") == F.col("_r"), "left_semi")


def paired_modes(df: DataFrame, a: str, b: str, keys: Sequence[str] = ("domain", "id")) -> DataFrame:
    """success of modes a and b by key, where both have one: one aggregation in place of a self-join."""
    each = [F.max(F.when(F.col("mode") == m, F.col("success"))).alias(n) for m, n in ((a, "success_a"), (b, "success_b"))]
    return df.filter(F.col("mode").isin(a, b)).groupBy(*keys).agg(*each).dropna(subset=["success_a", "success_b"])


def complete_cases(df: DataFrame, modes: Sequence[str]) -> DataFrame:
    """success by id, a column for each mode; ids that lack a mode are left out."""
    return df.groupBy("id").pivot("mode", list(modes)).agg(F.max("success")).dropna(subset=list(modes))


def failure_sample(df: DataFrame, n: int = 20) -> DataFrame:
    """The first n failures by id and mode."""
    return df.filter("success = 0").orderBy("id", "mode").limit(n)


def round_robin_sessions(memories: DataFrame, target: int, sessions: Sequence[str]) -> DataFrame:
    """Memories repeated in order up to `target` rows; sessions in turn, repeats named in the text.

    memories: content and position (0, 1, ...). The base is a seed list, checked to be no larger than the target.
    """
    n = memories.count()
    if not 0 < n <= target:
        raise ValueError("the target must be at least the number of memories, of which there must be some")
    grid = memories.sparkSession.range(target).withColumnRenamed("id", "slot").withColumn("position", F.col("slot") % n)
    session = F.element_at(F.array(*map(F.lit, sessions)), (F.col("slot") % len(sessions) + 1).cast("int"))
    content = F.when(F.col("slot") < n, F.col("content")).otherwise(F.concat("content", F.lit(" [dup "), F.col("slot").cast("string"), F.lit("]")))
    return grid.join(memories, "position").select("slot", session.alias("session_id"), content.alias("content"))
