"""Logical inputs (runs, questions, triples, memories, ...) as views of the given tables, with their SQL twins.

The evaluation operators take run rows, the rule engine triples, and so on; these functions say how the star schema stands in
for them. SQL fragments are common table expressions; `with_views` puts those that a statement needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (needs, sql)


def with_views(sql: str, *names: str) -> str:
    """`sql` with the views it names, and those that they need, as common table expressions."""
    found: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in found:
            found.append(name)

    for name in names:
        add(name)
    body = sql.strip()
    glue = ", " if body[:5].upper() == "WITH " else " "
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in found) + glue + (body[5:] if glue == ", " else body)


view(
    "raw_runs",
    """SELECT CAST(l_orderkey AS VARCHAR) AS id, 'M' || CAST(l_linenumber AS VARCHAR) AS mode, o_orderstatus AS domain,
    CASE l_orderkey % 3 WHEN 0 THEN 'recall' WHEN 1 THEN 'logic' ELSE 'open' END AS type, l_quantity / 50 AS confidence,
    CASE WHEN (CAST(l_quantity AS INTEGER) * 7 + l_linenumber * 5 + l_partkey) % 10 < 2 + l_linenumber THEN 1 ELSE 0 END AS success,
    l_extendedprice / 100 AS latency_ms, CAST(1 + l_partkey % 6 AS INTEGER) AS steps, l_partkey AS product, l_suppkey AS source,
    strftime(date_trunc('month', o_orderdate), '%Y%m%d_000000') AS run_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
view(
    "runs",
    """SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY id, mode ORDER BY source DESC, latency_ms DESC, product DESC, confidence DESC) AS nth FROM raw_runs) WHERE nth = 1""",
    "raw_runs",
)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    item, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return item.join(order, item["l_orderkey"] == order["o_orderkey"])


def _as_runs(attempts: DataFrame, *more: Column) -> DataFrame:
    kind = F.when(F.col("l_orderkey") % 3 == 0, "recall").when(F.col("l_orderkey") % 3 == 1, "logic").otherwise("open")
    success = ((F.col("l_quantity").cast("int") * 7 + F.col("l_linenumber") * 5 + F.col("l_partkey")) % 10 < 2 + F.col("l_linenumber")).cast("int")
    return attempts.select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("mode"),
        F.col("o_orderstatus").alias("domain"),
        kind.alias("type"),
        (F.col("l_quantity") / 50).alias("confidence"),
        success.alias("success"),
        (F.col("l_extendedprice") / 100).alias("latency_ms"),
        (1 + F.col("l_partkey") % 6).cast("int").alias("steps"),
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("source"),
        F.date_format(F.date_trunc("month", "o_orderdate"), "yyyyMMdd'_000000'").alias("run_id"),
        *more,
    )


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (question, mode) attempt; repeats occur. Column pruning keeps the scans to what a query uses."""
    return _as_runs(_attempts(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`raw_runs` without repeats: the last by (source, latency) of each question and mode stays.

    Repeats go by the keys that question and mode are made of: rows joined by order are together already, so nothing is shuffled again.
    """
    return keyed_runs(spark, sf_dir).drop("key")


def keyed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`runs` with key, the number that id is the text of: rows lie together by it, so grouping by it shuffles nothing."""
    from tessera.operators.runs import dedup_keep_last

    return _as_runs(dedup_keep_last(_attempts(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_extendedprice", "l_partkey", "l_quantity"]), F.col("l_orderkey").alias("key"))


view(
    "questions",
    """SELECT 'q' || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'What is the brand of ' || p_name || ' ' || CAST(p_size AS VARCHAR) || '?' END AS query,
    CASE WHEN p_partkey % 7 = 0 THEN 'Which type has ' || p_name || '?' ELSE NULL END AS question, CASE p_partkey % 4 WHEN 0 THEN 'Recall' WHEN 1 THEN 'logic' WHEN 2 THEN 'OPEN' ELSE NULL END AS type,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS expected_contains, p_type AS answer, p_name AS product, CASE WHEN p_size % 2 = 0 THEN 's2' ELSE NULL END AS session,
    'd' || CAST(p_partkey % 3 AS VARCHAR) AS domain, p_partkey AS position FROM part""",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows in mixed forms: `question` in place of `query`, empty golds, missing types and sessions."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("q"), key.cast("string")).alias("id"),
        F.when(key % 7 != 0, F.concat(F.lit("What is the brand of "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("?"))).alias("query"),
        F.when(key % 7 == 0, F.concat(F.lit("Which type has "), "p_name", F.lit("?"))).alias("question"),
        F.when(key % 4 == 0, "Recall").when(key % 4 == 1, "logic").when(key % 4 == 2, "OPEN").alias("type"),
        F.when(key % 3 == 0, "").otherwise(F.col("p_brand")).alias("expected_contains"),
        F.col("p_type").alias("answer"),
        F.col("p_name").alias("product"),
        F.when(F.col("p_size") % 2 == 0, "s2").alias("session"),
        F.concat(F.lit("d"), (key % 3).cast("string")).alias("domain"),
        key.alias("position"),
    )
