"""Robustness runs: questions in altered forms and over memories of several sizes, searched, composed and scored.

All forms of all questions are asked at once by a scan of the texts in blocks (see `sparse`), so no row is made for a pair. Memory rows
carry the place at which they were added; a size is a prefix of these places. Each pair of form and memory is scored once, the best of
each stretch between two sizes are kept, and a size takes the best of its stretches, so that work grows with the largest size, not with the sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import sparse as S
from tessera.operators import text as T
from tessera.operators.faithfulness import contains
from tessera.operators.retrieval import tokens
from tessera.operators.routing import adaptive_route, compose_answer, compose_steps, episode_cost, ranked
from tessera.sources.shared import written

AUGMENT, MEMSCALE = "AUGMENT", "MEMSCALE"


def forms(questions: DataFrame, pool: Mapping[str, Sequence[str]], noise: Sequence[str], intensities: Sequence[int]) -> DataFrame:
    """id, kind, intensity and query: every question as it is (kind empty), and in every cell of the grid."""
    grid = T.augment_grid(questions, "id", "query", pool, noise, intensities).select("base", "kind", "intensity", "query")
    plain = questions.select(F.col("id").alias("base"), F.lit("").alias("kind"), F.lit(0).alias("intensity"), "query")
    return plain.unionByName(grid).withColumnRenamed("base", "id")


def with_terms(asked: DataFrame) -> DataFrame:
    return asked.withColumn("terms", F.array_distinct(tokens(F.col("query"))))


def shared_terms(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """id, key, at and shared: the terms that any form of a question and a text have in common, where there are any."""
    probes = asked.select("id", F.explode("terms").alias("term")).distinct()
    held = texts.select("key", "at", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return held.join(probes, "term").groupBy("id", "key", "at").agg(F.collect_list("term").alias("shared"))


def scores(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """id, kind, intensity, key, at and score: shared terms of each form, where there are any.

    asked: id, kind, intensity, terms; texts: key, at, text. The forms of a question are few, and join as one row.
    """
    cell = F.struct("kind", "intensity", "terms")
    together = asked.groupBy("id").agg(F.collect_list(cell).alias("forms"))
    pairs = shared_terms(asked, texts).join(together, "id").select("id", "key", "at", "shared", F.explode("forms").alias("form"))
    score = F.size(F.array_intersect("shared", "form.terms")).cast("double")
    return pairs.select("id", "form.kind", "form.intensity", "key", "at", score.alias("score")).filter("score > 0")


FORM = ["id", "kind", "intensity"]


def best_by_size(scored: DataFrame, sizes: Sequence[int], k: int = 1) -> DataFrame:
    """The k best of every prefix: FORM, size, key, score and rank, over rows with at < size; ties by key.

    A row belongs to the stretch that ends at the least size above its place; only k rows of each stretch go on to larger sizes.
    """
    sizes = sorted(set(sizes))
    stretch = F.lit(None).cast("int")
    for n, size in reversed(list(enumerate(sizes))):
        stretch = F.when(F.col("at") < size, n).otherwise(stretch)
    kept = ranked(scored.withColumn("stretch", stretch).filter("stretch is not null"), [*FORM, "stretch"], "score", "key", k).drop("rank")
    at_sizes = F.explode(F.slice(F.array(*map(F.lit, sizes)), F.col("stretch") + 1, len(sizes)))
    return ranked(kept.withColumn("size", at_sizes).drop("stretch"), [*FORM, "size"], "score", "key", k)


def evaluate(questions: DataFrame, passages: DataFrame, memory: DataFrame, sizes: Sequence[int], modes: Sequence[str], pool: Mapping[str, Sequence[str]], noise: Sequence[str], intensities: Sequence[int] = (1, 2)) -> DataFrame:
    """setting, param, mode, id, answer, success and cost: one row for each question, cell and mode.

    questions: id, query, expected; passages: key, text; memory: key, at (place of insertion), text. AUGMENT cells ask altered
    forms over the least memory; MEMSCALE cells ask the questions as they are over each size. Modes: BASE (search), MEM, and RL,
    which is routed by the share of the question's terms that the best hits hold. Work is one pass over passages and memory.
    """
    asked = with_terms(forms(questions, pool, noise, intensities)).withColumn("form", F.concat("kind", F.lit("@"), F.col("intensity").cast("string"), F.lit("|"), F.col("id").cast("string")))
    best = lambda texts: S.overlap_topk(asked.select("form", "query"), texts, 1, "form", "query", "key").drop("rank")
    named = lambda hits: hits.join(asked.select("form", *FORM), "form").drop("form")
    found = written(named(best(passages)), "found").join(passages.select("key", F.col("text").alias("found")), "key").select(*FORM, F.col("score").alias("search_score"), "found")
    steps = sorted(set(sizes))
    stretches = [best(memory.filter((F.col("at") >= low) & (F.col("at") < size))).withColumn("at", F.lit(size - 1)) for low, size in zip([0, *steps[:-1]], steps, strict=True)]
    remembered = written(best_by_size(named(reduce(DataFrame.unionByName, stretches)), steps).select(*FORM, "size", "key", "score"), "remembered")
    remembered = remembered.join(memory.select("key", F.col("text").alias("mem")), "key").select(*FORM, "size", F.col("score").alias("mem_score"), "mem")
    least = min(sizes)
    at_sizes = F.when(F.col("kind") == "", F.array(*map(F.lit, sorted(set(sizes))))).otherwise(F.array(F.lit(least)))
    cells = asked.select(*FORM, F.size("terms").alias("n_terms"), F.explode(at_sizes).alias("size"))
    df = cells.join(found, FORM, "left").join(remembered, [*FORM, "size"], "left")
    df = df.join(questions.select("id", "expected"), "id")
    share = lambda c: F.coalesce(F.col(c) / F.greatest(F.col("n_terms"), F.lit(1)), F.lit(0.0))
    routed = adaptive_route(share("mem_score"), share("search_score"), F.lit(False))
    df = df.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    action = F.when(F.col("mode") == "RL", routed).otherwise(F.col("mode"))
    df = df.withColumn("action", action)
    evidence = F.col("action"), F.col("mem"), F.col("found"), F.lit(None).cast("string")
    plain = F.col("kind") == ""
    return df.select(
        F.when(plain, MEMSCALE).otherwise(AUGMENT).alias("setting"),
        F.when(plain, F.concat(F.lit("mem@"), F.col("size").cast("string"))).otherwise(F.concat("kind", F.lit("@"), F.col("intensity").cast("string"))).alias("param"),
        "mode", "id", compose_answer(*evidence).alias("answer"),
        contains(compose_answer(*evidence), F.col("expected")).alias("success"), episode_cost(compose_steps(*evidence)).alias("cost"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """setting, param, mode with n, accuracy and avg_cost."""
    return rows.groupBy("setting", "param", "mode").agg(F.count("*").alias("n"), F.avg("success").alias("accuracy"), F.avg("cost").alias("avg_cost"))
