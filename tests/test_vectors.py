"""Vector search against a comparison with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.operators import vectors as V


def table(spark, m, name, extra=()):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>").repartition(3)


def brute(m, q, k, digits):
    """Rows of (query, name, score, rank); null vectors have no row."""
    unit = lambda x: x / max(1e-12, np.linalg.norm(x))
    out = []
    for i, v in q:
        scores = sorted((-round(float(unit(np.array(v)) @ unit(np.array(w))), digits), j) for j, w in m)
        out += [(i, j, -s, n) for n, (s, j) in enumerate(scores[:k], 1)]
    return out


def clusters(n, seed=1, dim=12, kinds=40):
    """Vectors around `kinds` directions, whatever n is."""
    centers = np.random.default_rng(0).normal(size=(kinds, dim))
    r = np.random.default_rng(seed)
    return centers[r.integers(0, kinds, n)] + r.normal(size=(n, dim)) * 0.05


def same(got, want):
    got, want = sorted((a, b, d) for a, b, _, d in got), sorted((a, b, d) for a, b, _, d in want)
    assert got == want


@pytest.mark.parametrize("block", [7, 4096])
def test_index_finds_what_a_full_comparison_finds(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    r = np.random.default_rng(2)
    m = np.concatenate([clusters(150), r.normal(size=(30, 12)), np.repeat(r.normal(size=(1, 12)), 25, axis=0), np.zeros((2, 12))])
    asked = [(i, m[i]) for i in range(0, len(m), 5)]
    vectors = table(spark, m, "pid", [(900, None)])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in asked] + [(901, None), (0, m[0].tolist())], "qid long, embedding array<double>")
    for k in (1, 5):
        found, _ = V.search(V.build(vectors), queries, k)
        same([tuple(x) for x in found.select("qid", "pid", "score", "rank").collect()], brute(list(enumerate(m)), asked, k, 9))
    found, _ = V.search(V.build(vectors), queries.limit(1), 500)
    assert found.count() == len(m), "fewer vectors than were asked for"


def test_share_of_compared_pairs_falls_as_the_table_grows(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 64)
    shares = []
    for n in (300, 4800):
        m = clusters(n)
        queries = table(spark, clusters(20, seed=9), "qid")
        found, compared = V.search(V.build(table(spark, m, "pid")), queries, 3)
        same([tuple(x) for x in found.select("qid", "pid", "score", "rank").collect()], brute(list(enumerate(m)), list(enumerate(clusters(20, seed=9))), 3, 9))
        shares.append(compared.agg(F.sum("compared")).first()[0] / (n * 20))
    assert shares[1] < shares[0] / 2 and shares[1] < 0.1


def test_no_vectors_or_no_queries(spark):
    some = table(spark, clusters(5), "pid")
    asked = table(spark, clusters(3), "qid")
    assert R.dense_topk(some.limit(0), asked, 3).count() == 0
    assert R.dense_topk(some, asked.limit(0), 3).count() == 0
    assert R.dense_topk(some.withColumn("embedding", F.lit(None).cast("array<double>")), asked, 3).count() == 0
    assert V.session_grid(some.select(F.lit("s").alias("session_id"), F.col("pid").alias("memory_id"), "embedding").limit(0), asked.withColumn("session_id", F.lit("s")), 3).count() == 0


@pytest.mark.parametrize("block", [6, 4096])
def test_sessions_of_all_sizes(spark, monkeypatch, block):
    """One session holds more than a third of all rows, many hold one, one has no queries, one no memories."""
    monkeypatch.setattr(V, "BLOCK", block)
    m, q = clusters(120), clusters(60, seed=3)
    session = lambda i: "hot" if i % 5 < 3 else f"s{i % 17}"
    memories = [(session(i), i, v.tolist()) for i, v in enumerate(m)] + [(None, 500, m[0].tolist()), ("hot", 501, None), ("idle", 502, m[1].tolist()), ("hot", 503, m[0].tolist())]
    queries = [(session(i + 1), i, v.tolist()) for i, v in enumerate(q)] + [(None, 600, q[0].tolist()), ("absent", 601, q[0].tolist()), ("hot", 602, None)]
    a = spark.createDataFrame(memories, "session_id string, memory_id long, embedding array<double>").repartition(4)
    b = spark.createDataFrame(queries, "session_id string, qid long, embedding array<double>")
    got = [tuple(r) for r in R.session_topk(a, b, 4).select("qid", "memory_id", "score", "rank").collect()]
    want = []
    for s in {r[0] for r in queries if r[0]}:
        want += brute([(j, v) for t, j, v in memories if t == s and v], [(i, v) for t, i, v in queries if t == s and v], 4, 6)
    same(got, want)
    assert R.session_topk(a, b, 4, least=0.9).count() == sum(round(x[2], 6) >= 0.9 for x in want)


def test_a_large_session_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 10)
    m = clusters(200)
    a = table(spark, m, "memory_id").withColumn("session_id", F.lit("one"))
    b = table(spark, clusters(40, seed=4), "qid").withColumn("session_id", F.lit("one"))
    found = V.session_grid(a, b, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan.split("FlatMapCoGroupsInArrow")[0]
    assert found.count() == 80
