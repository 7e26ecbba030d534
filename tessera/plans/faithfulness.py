"""Knock-out queries: questions about orders, answered from memory, search and the battery rules."""

from pyspark.sql import functions as F

from tessera.operators import faithfulness as A
from tessera.operators import kg as K
from tessera.operators.routing import NOTHING
from tessera.operators.stats import rounded
from tessera.plans import kg
from tessera.registry import register
from tessera.sources.views import table, view, with_views

RULES = K.RULES["battery"]
NAMES = ", ".join(f"('{r.name}')" for r in RULES)

view(
    "order_questions",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'logic' ELSE 'open' END AS type, 'o' || CAST(o_orderkey AS VARCHAR) AS product,
    CASE o_orderkey % 4 WHEN 0 THEN 'batterysafetystandard' WHEN 1 THEN 'WirelessTestStep' WHEN 2 THEN 'RoHSStandard' ELSE o_orderpriority END AS expected,
    CASE WHEN o_orderkey % 3 = 0 THEN 'The priority of the order is ' || o_orderpriority || ', its standard RoHSStandard.' END AS mem, 'The state of the order is ' || o_orderstatus || '.' AS found FROM orders""",
)
view(
    "world_answers",
    f"""SELECT r.rule, s AS product, concat_ws(' ', 'Symbolic: standards for ' || s || ': ' || string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (WHERE p = 'requiresCompliance') || '.',
    'Required steps: ' || string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (WHERE p = 'requiresStep') || '.') AS answer FROM added a, (VALUES (''), {NAMES}) r(rule) WHERE a.rule <> r.rule GROUP BY r.rule, s""",
    "added",
)
view(
    "right_answers",
    """SELECT q.*, w.answer AS sym, CASE WHEN mem IS NOT NULL THEN 1 ELSE 0 END AS used_mem, CASE WHEN w.answer IS NOT NULL THEN 1 ELSE 0 END AS used_sym
    FROM order_questions q LEFT JOIN world_answers w ON w.product = q.product AND w.rule = '' WHERE contains(lower(coalesce(nullif(concat_ws(' ', 'Memory: ' || mem, w.answer), ''), 'Search: ' || found)), lower(expected))""",
    "order_questions",
    "world_answers",
)
view(
    "memory_drops",
    "SELECT id, type, expected, product, used_mem, used_sym, CASE WHEN contains(lower(coalesce(sym, 'Search: ' || found)), lower(expected)) THEN 0 ELSE 1 END AS delta_memory FROM right_answers",
    "right_answers",
)
view(
    "rule_drops",
    f"""SELECT a.id, r.rule, CASE WHEN contains(lower(coalesce(w.answer, '{NOTHING}')), lower(expected)) THEN 0 ELSE 1 END AS delta
    FROM right_answers a CROSS JOIN (VALUES {NAMES}) r(rule) LEFT JOIN world_answers w ON w.product = a.product AND w.rule = r.rule""",
    "right_answers",
)


def knockouts(spark, d):
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    kind = F.when(key % 3 == 0, "recall").when(key % 3 == 1, "logic").otherwise("open")
    expected = F.when(key % 4 == 0, "batterysafetystandard").when(key % 4 == 1, "WirelessTestStep").when(key % 4 == 2, "RoHSStandard").otherwise(priority)
    orders, name = table(spark, d, "orders"), key.cast("string").alias("id")
    questions = orders.select(name, kind.alias("type"), F.concat(F.lit("o"), key.cast("string")).alias("product"), expected.alias("expected"))
    memory = orders.filter(key % 3 == 0).select(name, F.concat(F.lit("The priority of the order is "), priority, F.lit(", its standard RoHSStandard.")).alias("text"))
    search = orders.select(name, F.concat(F.lit("The state of the order is "), "o_orderstatus", F.lit(".")).alias("text"))
    return A.knockouts(questions, memory, search, kg.triples(spark, d), RULES)


@register("knockout_join", with_views("SELECT m.id, type, used_mem, used_sym, delta_memory, rule, delta FROM memory_drops m JOIN rule_drops r ON r.id = m.id", "memory_drops", "rule_drops"))
def knockout_join(spark, d):
    return knockouts(spark, d).select("id", "type", "used_mem", "used_sym", "delta_memory", F.explode("deltas").alias("x")).select("id", "type", "used_mem", "used_sym", "delta_memory", "x.rule", "x.delta")


@register("faithfulness_summary", with_views("""SELECT count(*) AS n, round(avg(delta_memory), 6) AS mem_helped, round(avg(any_rule), 6) AS sym_helped
FROM memory_drops JOIN (SELECT id, max(delta) AS any_rule FROM rule_drops GROUP BY id) USING (id)""", "memory_drops", "rule_drops"))
def faithfulness_summary(spark, d):
    return A.summary(knockouts(spark, d)).withColumns({c: rounded(F.col(c)) for c in ("mem_helped", "sym_helped")})


@register("faithfulness_by_rule", with_views("SELECT rule, count(*) AS n, CAST(sum(delta) AS BIGINT) AS n_dropped, round(avg(delta), 6) AS mean_drop FROM rule_drops GROUP BY rule", "rule_drops"))
def faithfulness_by_rule(spark, d):
    return A.by_rule(knockouts(spark, d)).withColumn("mean_drop", rounded(F.col("mean_drop")))
