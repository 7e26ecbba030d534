"""Causal tests of composed answers: what is lost without memory, and without each rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kg as K
from tessera.operators.routing import compose_answer, compose_steps


def contains(answer: Column, expected: Column) -> Column:
    """1 where the answer holds the expected text, whatever the case; nothing expected counts as 0."""
    hit = F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(expected))
    return F.when((expected != "") & hit, 1).otherwise(0)


def knockouts(questions: DataFrame, memory: DataFrame, search: DataFrame, triples: DataFrame, rules: Sequence[K.Rule], mode: str = "MEMSYM") -> DataFrame:
    """id, type, used_mem, used_sym, delta_memory and deltas (array of rule, delta) of the questions that `mode` answers rightly.

    questions: id, type, product, expected; memory, search: id and text (at most one a question). delta_memory: 1 if the answer
    without memory is wrong. deltas: 1 for each rule without which the symbolic answer is wrong. All rules are knocked out by one
    pass of the rule engine; answers of a product are composed once for all of its questions.
    """
    symbolic = K.answers_in_worlds(K.apply_rules_in_worlds(triples, rules, K.single_knockouts(rules)), len(rules) + 1)
    df = questions.join(symbolic, "product", "left")
    for evidence, name in ((memory, "mem"), (search, "found")):
        df = df.join(evidence.select(F.col("id"), F.col("text").alias(name)), "id", "left")
    sym, mem, found, nothing = F.get("answers", F.lit(0)), F.col("mem"), F.col("found"), F.lit(None).cast("string")
    steps = compose_steps(F.lit(mode), mem, found, sym)
    df = df.withColumn("used_mem", F.array_contains(steps, "MEM").cast("int")).withColumn("used_sym", F.array_contains(steps, "SYM").cast("int"))
    right = df.filter(contains(compose_answer(F.lit(mode), mem, found, sym), F.col("expected")) == 1)
    without = compose_answer(F.lit(mode), nothing, found, sym)
    by_rule = [compose_answer(F.lit("SYM"), mem, found, F.get("answers", F.lit(k))) for k in range(1, len(rules) + 1)]
    deltas = F.array(*[F.struct(F.lit(r.name).alias("rule"), (1 - contains(a, F.col("expected"))).alias("delta")) for r, a in zip(rules, by_rule, strict=True)])
    return right.select("id", "type", "used_mem", "used_sym", (1 - contains(without, F.col("expected"))).alias("delta_memory"), deltas.alias("deltas"))


def summary(rows: DataFrame) -> DataFrame:
    """n, and the shares of questions that memory, and any one rule, was needed for (null without rows)."""
    any_rule = F.exists("deltas", lambda d: d["delta"] > 0).cast("int")
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("delta_memory") > 0).cast("int")).alias("mem_helped"), F.avg(any_rule).alias("sym_helped"))


def by_rule(rows: DataFrame) -> DataFrame:
    """rule, n, n_dropped and mean_drop over the questions of `knockouts`."""
    each = rows.select(F.explode("deltas").alias("d")).select("d.*")
    return each.groupBy("rule").agg(F.count("*").alias("n"), F.sum("delta").alias("n_dropped"), F.avg("delta").alias("mean_drop"))
