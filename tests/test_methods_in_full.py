"""Queries that once left out a step or kept too few of their results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans import evaluation
from tessera.plans import retrieval as plans

RUNS = "mode string, domain string, confidence double, success int, latency_ms double, steps int"


def effects_by_counting(data, baseline):
    """(domain, mode): risk reductions, AURC delta and utility delta by loops over the rows."""
    groups = {}
    for mode, domain, confidence, success, _, steps in data:
        for d in (domain, "pooled"):
            groups.setdefault((d, mode), []).append((0.0 if confidence is None else confidence, success, steps))
    each = {}
    for (d, mode), rows in groups.items():
        points = []
        for t in [round(0.02 * i, 4) for i in range(51)]:
            kept = [s for c, s, _ in rows if c >= t]
            points.append((len(kept) / len(rows), 1 - sum(kept) / len(kept) if kept else 1.0, t))
        risk = {t: r for _, r, t in points}
        x, y, _ = zip(*sorted(points), strict=True)
        cost = {m: np.mean([s for *_, s in r]) for (e, m), r in groups.items() if e == d}
        utility = np.mean([s for _, s, _ in rows]) - 0.3 * cost[mode] / max(1.0, *cost.values()) if d != "pooled" else None
        each[d, mode] = (risk[0.3], risk[0.5], risk[0.7], sum((b - a) * (u + v) / 2 for a, b, u, v in zip(x, x[1:], y, y[1:], strict=False)), utility)
    out = {}
    for (d, mode), e in each.items():
        if mode != baseline and (d, baseline) in each:
            b = each[d, baseline]
            out[d, mode] = [*(b[i] - e[i] for i in range(4)), None if e[4] is None else e[4] - b[4]]
    return out


def test_selective_effects_have_areas_steps_as_cost_and_pooled_rows(spark):
    r = random.Random(4)
    data = [(m, d, None if r.random() < 0.1 else round(r.random() * top, 2), int(r.random() < p), r.random() * 1e4, r.randint(1, 6) * (m == "B") or 1) for m, d, top, p in [("A", "x", 1, 0.5), ("B", "x", 0.6, 0.8), ("C", "x", 0.25, 0.3), ("A", "y", 1, 0.7), ("B", "y", 0.9, 0.2), ("B", "z", 1, 0.5)] for _ in range(80)]
    found = evaluation.selective_effects(spark.createDataFrame(data, RUNS), "A").collect()
    got = {(x["domain"], x["mode"]): [x["risk_reduction_30"], x["risk_reduction_50"], x["risk_reduction_70"], x["aurc_delta"], x["delta_utility"]] for x in found}
    want = effects_by_counting(data, "A")
    assert set(got) == set(want) == {("x", "B"), ("x", "C"), ("y", "B"), ("pooled", "B"), ("pooled", "C")}
    for k, v in want.items():
        assert got[k][:4] == pytest.approx(v[:4], abs=5e-6)
        assert (got[k][4], v[4]) == (None, None) if k[0] == "pooled" else got[k][4] == pytest.approx(v[4], abs=1e-5)
    assert {x["baseline"] for x in found} == {"A"}


def test_contexts_hold_eight_passages_and_a_missing_text_takes_no_part(spark, tmp_path):
    r = random.Random(2)
    docs = [(i, " ".join(r.choices("alpha beta gamma delta eps zeta".split(), k=6)), "" if i == 3 else f"s{i}") for i in range(12)]
    questions = [(1, "beta alpha"), (2, "zeta eta"), (3, None)]
    spark.createDataFrame([*docs, (99, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, plans.retrieve_context(spark, f"file://{tmp_path}").collect()), key=str)
    embed = lambda df, c: df.withColumn("embedding", R.hash_embed(F.col(c), plans.DIM))
    passages = plans.passages(spark, f"file://{tmp_path}")
    asked = plans.asks(spark, f"file://{tmp_path}").filter("query is not null")
    want = R.hybrid_topk(R.tfidf_scores(asked, R.tfidf_index(passages)), embed(passages.filter("text is not null"), "text"), embed(asked, "query"), 8).collect()
    assert len(want) == 16 and len({w["score"] for w in want}) > 4
    texts = {i: (title or str(i), text) for i, text, title in docs}
    rows = [(w["qid"], w["rank"], w["pid"], *texts[w["pid"]], round(w["score"] + 1e-9, 4), "hybrid") for w in want]
    assert got == sorted([*rows, (3, None, None, None, None, None, "search")], key=str)


def test_contexts_are_whole_lists_of_one_search(spark):
    hits = lambda rows: spark.createDataFrame(rows, "qid long, pid long, rank int, score double")
    queries, passages = spark.createDataFrame([(1,), (2,), (3,)], "qid long"), spark.createDataFrame([(i, f"t{i}", "a") for i in range(9)], "pid long, text string, title string")
    found = R.context(queries, hits([(1, 5, 1, 0.5), (1, 4, 2, 0.25)]), hits([(1, 6, 1, 0.9), *((2, i, i + 1, 0.9 - i / 10) for i in range(8))]), passages)
    assert sorted((r["qid"], r["rank"], r["pid"], r["text"], r["via"]) for r in found.collect() if r["qid"] < 3) == [(1, 1, 5, "t5", "hybrid"), (1, 2, 4, "t4", "hybrid"), *((2, i + 1, i, f"t{i}", "search") for i in range(8))]
    assert [tuple(r) for r in found.filter("qid = 3").collect()] == [(3, None, None, None, None, None, "search")]


def test_no_questions_have_no_contexts(spark, tmp_path):
    spark.createDataFrame([(1, "alpha", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert plans.retrieve_context(spark, f"file://{tmp_path}").count() == 0
