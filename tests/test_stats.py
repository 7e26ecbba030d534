"""Goldens and invariants of the evaluation statistics."""

import bisect
import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as E
from tessera.operators import routing as G
from tessera.operators import runs as R
from tessera.operators import stats as S

SCHEMA = "id string, mode string, domain string, type string, confidence double, success int, latency_ms double, steps int"


def rows(spark, n=300, seed=1):
    r = random.Random(seed)
    data = [(f"q{i}", m, r.choice("ab"), r.choice(["recall", "open"]), round(r.random(), 2) if r.random() > 0.05 else None, r.randint(0, 1), r.random() * 9, r.randint(1, 6)) for i in range(n) for m in ("A", "B", "C")]
    return spark.createDataFrame(data, SCHEMA)


def test_wilson_anchor(spark):
    low, high = S.wilson(F.col("n"), F.col("k"))
    got = spark.createDataFrame([(2297, 2297), (0, 0)], "n long, k long").select(low.alias("l"), high.alias("h")).collect()
    assert got[0]["l"] == pytest.approx(0.9983303500771196, abs=1e-12) and got[0]["h"] == 1.0
    assert tuple(got[1]) == (0.0, 0.0)


def test_mcnemar_anchor(spark):
    got = spark.createDataFrame([(266, 0), (0, 0), (3, 3)], "b long, c long").select(S.exact_binomial("b", "c").alias("p")).collect()
    assert got[0]["p"] == pytest.approx(1.6867516709168837e-80, rel=1e-9)
    assert got[1]["p"] == 1.0 and got[2]["p"] == 1.0


def test_coverage_anchor(spark):
    df = spark.range(3429).select(F.lit("X").alias("mode"), (F.col("id") < 273).alias("sym_fired"), F.lit(1).alias("success"))
    got = {r["mode"]: r for r in S.sym_coverage(df).collect()}
    assert got["X"]["coverage"] == pytest.approx(0.079615, abs=1e-6) and got["X"]["precision"] == 1.0 and got["ALL"]["fired_n"] == 273


def test_curve_is_monotone_and_aurc_in_range(spark):
    curve = S.selective_curve(rows(spark), "mode")
    for mode in "ABC":
        points = sorted((r for r in curve.collect() if r["mode"] == mode), key=lambda r: r["threshold"])
        assert len(points) == 51 and all(a["coverage"] >= b["coverage"] for a, b in zip(points, points[1:], strict=False))
    assert all(0 <= r["aurc"] <= 1 for r in S.aurc(curve, "mode").collect())


def test_curve_matches_counting(spark):
    df = rows(spark)
    data = [r for r in df.collect() if r["mode"] == "A" and r["confidence"] is not None]
    for p in S.selective_curve(df, "mode").filter("mode = 'A'").collect():
        kept = [r for r in data if r["confidence"] >= p["threshold"]]
        assert p["n"] == len(kept) and p["coverage"] == pytest.approx(len(kept) / len(data), abs=1e-6)


def test_quantile_bins_hold_equal_counts(spark):
    df = rows(spark, 97)
    for r in S.quantile_bins(df, "mode").groupBy("mode").agg(F.sum("n").alias("n"), F.max("n").alias("hi"), F.min("n").alias("lo")).collect():
        assert r["hi"] - r["lo"] <= 1
    few = S.ece_quantile(df.filter("id in ('q1', 'q2', 'q3')"), "mode").collect()
    assert all(r["n_bins"] <= 3 for r in few)


def test_isotonic_is_monotone_and_identity_for_one_class(spark):
    fitted = S.isotonic(rows(spark), "mode")
    for mode in "ABC":
        ys = [r["calibrated"] for r in sorted((r for r in fitted.collect() if r["mode"] == mode), key=lambda r: r["confidence"])]
        assert all(a <= b + 1e-9 for a, b in zip(ys, ys[1:], strict=False))
    ones = S.isotonic(rows(spark).filter("success = 1"), "mode").collect()
    assert all(r["calibrated"] == pytest.approx(r["confidence"]) for r in ones)


def test_dedup_is_idempotent_and_independent_of_partitions(spark):
    df = rows(spark).unionByName(rows(spark))
    once = R.dedup_keep_last(df.repartition(7), ["id", "mode"], ["confidence", "latency_ms"])
    assert once.count() == 900 and R.dedup_keep_last(once, ["id", "mode"], ["confidence", "latency_ms"]).count() == 900
    assert sorted(map(tuple, once.select("id", "mode", "success").collect())) == sorted(map(tuple, R.dedup_keep_last(df.coalesce(1), ["id", "mode"], ["confidence", "latency_ms"]).select("id", "mode", "success").collect()))


def test_empty_runs(spark):
    none = rows(spark).limit(0)
    assert S.acc_ci(none).count() == 0 and S.selective_curve(none, "mode").count() == 0 and S.mcnemar(none, "A").count() == 0
    assert S.ece_quantile(none, "mode").count() == 0 and S.isotonic(none, "mode").count() == 0


def test_median_is_exact(spark):
    r = random.Random(4)
    data = [("q", m, "a", "x", None, 1, v, 1) for m, vs in {"even": [r.random() for _ in range(5000)], "odd": [r.randint(0, 9) / 4 for _ in range(4001)], "one": [7.5], "two": [1.0, 4.0], None: [3.0, 1.0, 2.0], "none": [None, None], "tie": [2.0] * 999 + [3.0] * 999, "some": [None, 8.0]}.items() for v in vs]
    got = {x["mode"]: x["median_latency_ms"] for x in S.summary(spark.createDataFrame(data, SCHEMA).repartition(5), "mode").collect()}
    for mode in {x[1] for x in data}:
        values = [x[6] for x in data if x[1] == mode and x[6] is not None]
        assert got[mode] == (pytest.approx(statistics.median(values), abs=0.0051) if values else None)
    whole = S.summary(spark.createDataFrame(data, SCHEMA)).first()
    assert whole["n"] == len(data) and whole["median_latency_ms"] == pytest.approx(statistics.median(x[6] for x in data if x[6] is not None), abs=0.0051)


def test_exact_p_matches_whole_sums_and_takes_large_counts(spark):
    pairs = [(b, c) for b in range(0, 40, 3) for c in range(0, 40, 4)] + [(1200, 1100), (10**9, 10**9 + 10**5), (10**9, 0), (7, 7)]
    got = spark.createDataFrame(pairs, "b long, c long").withColumn("p", S.exact_binomial("b", "c")).collect()
    for b, c, p in got:
        if b + c < 10_000:
            tail = sum(math.comb(b + c, i) for i in range(min(b, c) + 1))
            assert p == pytest.approx(float(min(Fraction(1), Fraction(2 * tail, 2 ** (b + c)))), rel=1e-9)
    large = {(b, c): p for b, c, p in got}
    # normal tail with the continuity correction
    assert large[10**9, 10**9 + 10**5] == pytest.approx(math.erfc((10**5 - 1) / math.sqrt(2 * (2 * 10**9 + 10**5))), rel=1e-3) and large[10**9, 0] == 0.0


def fine(spark, n=3000):
    r = random.Random(8)
    data = [(f"q{i}", m, "a", "x", c, int(r.random() < c**2), 1.0, 1) for m in ("A", None) for i in range(n) for c in [r.choice([0.0, 1.0, 0.25, r.random(), r.random() / 700])]]
    return spark.createDataFrame(data, SCHEMA)


def test_ranks_over_slots_are_those_of_the_whole(spark):
    df = fine(spark)
    for mode in ("A", None):
        values = sorted(r["confidence"] for r in df.collect() if r["mode"] == mode)
        got = [r for r in S.confidence_rows(df, "mode").collect() if r["mode"] == mode]
        assert {r["confidence"]: (r["n"], r["before"], r["total"]) for r in got} == {v: (values.count(v), bisect.bisect_left(values, v), len(values)) for v in set(values)}
    assert S.confidence_rows(df).count() == len({r["confidence"] for r in df.collect()})


def test_isotonic_over_slots_is_the_greatest_lower_mean(spark):
    df = fine(spark, 150)
    for mode in ("A", None):
        rows = [r for r in df.collect() if r["mode"] == mode]
        xs = sorted({r["confidence"] for r in rows})
        k, n = [[sum(v for r in rows if r["confidence"] == x for v in [f(r)]) for x in xs] for f in (lambda r: r["success"], lambda r: 1)]
        mean = lambda j, i: sum(k[j : i + 1]) / sum(n[j : i + 1])  # noqa: B023, E731
        want = {x: max(min(mean(j, m) for m in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}
        got = {r["confidence"]: r["calibrated"] for r in S.isotonic(df, "mode").collect() if r["mode"] == mode}
        assert got == pytest.approx(want, abs=1e-6) and len(got) > 50


def test_calibration_map_interpolates_all_fitted_points(spark):
    r = random.Random(2)
    xs = sorted({*(r.random() for _ in range(400)), *(i / 100 for i in range(3, 60, 7))})
    fitted = spark.createDataFrame([("A", x, x**3) for x in xs], "mode string, confidence double, calibrated double")
    got = S.calibration_map(fitted, "mode").first()["map"]
    assert got == pytest.approx([float(v) for v in np.interp(np.arange(101) / 100, xs, np.array(xs) ** 3)], abs=1e-12)


def test_bootstraps_from_sums_agree_with_resampled_rows(spark):
    df = rows(spark, 400)
    draws = np.random.default_rng(5)
    by = {(r["id"], r["mode"]): r["success"] for r in df.collect()}
    got = {r["mode"]: r for r in S.bootstrap_ci(df, "mode").collect()}
    for mode in "ABC":
        values = np.array([v for (_, m), v in by.items() if m == mode])
        low, high = np.percentile(draws.choice(values, (4000, len(values))).mean(axis=1), [2.5, 97.5])
        assert got[mode]["n"] == len(values) and got[mode]["mean"] == pytest.approx(values.mean()) and (got[mode]["ci_low"], got[mode]["ci_high"]) == pytest.approx((low, high), abs=0.012)


def test_paired_bootstrap_agrees_with_resampled_pairs(spark):
    df = rows(spark, 400).withColumn("domain", F.lit("a"))
    by = {(r["id"], r["mode"]): r["success"] for r in df.collect()}
    differences = np.array([by[i, "A"] - by[i, "B"] for i, m in by if m == "A"])
    means = np.random.default_rng(6).choice(differences, (4000, len(differences))).mean(axis=1)
    r = S.paired_bootstrap(df, "A", "B").first()
    assert r["n"] == len(differences) and r["mean_diff"] == pytest.approx(differences.mean())
    assert (r["ci_low"], r["ci_high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=0.015)
    assert r["p_value"] == pytest.approx(min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean())), abs=0.05)


def test_router_training_reaches_the_optimum(spark):
    r = random.Random(9)
    data = [(str(i), x, y, r.choice("ab") if r.random() < 0.2 else "a" if x > y else "b") for i in range(300) for x, y in [(r.random(), r.random())]]
    weights, bias = G.router_train(spark.createDataFrame(data, "id string, x double, y double, label string"), ["x", "y"])
    x = np.array([d[1:3] for d in data])
    scale = x.std(axis=0, ddof=1)
    assert set(weights) == set(bias) == {"a", "b"}
    for k in "ab":
        truth = np.array([d[3] == k for d in data], float)
        # gradient of the mean log loss with the ridge on standardised weights, as Spark sets it
        residual = 1 / (1 + np.exp(-(x @ np.array(weights[k]) + bias[k]))) - truth
        assert abs(residual.mean()) < 1e-4 and np.abs(residual @ x / len(x) / scale + 0.01 * np.array(weights[k]) * scale).max() < 1e-4


def test_embedded_batches_are_the_encoders_unit_vectors(spark):
    data = [(i, t) for i, t in enumerate(["abc", "", "eee", "abc", "a long text"])]
    encoder = lambda texts: np.stack([texts.str.len(), texts.str.count("e")], axis=1)
    got = {r["id"]: r["embedding"] for r in E.embed_batch(spark.createDataFrame(data, "id int, text string").repartition(3), "text", encoder).collect()}
    for i, text in data:
        v = np.array([len(text), text.count("e")], float)
        assert got[i] == pytest.approx(list(v / max(np.linalg.norm(v), 1e-12)), abs=1e-6)


def test_bootstrap_covers_the_mean(spark):
    r = S.paired_bootstrap(rows(spark), "A", "B").first()
    assert r["ci_low"] <= r["mean_diff"] <= r["ci_high"] and 0 <= r["p_value"] <= 1


def test_confidences_within_a_thousandth_are_spread_over_slots(spark):
    close = [("a", 0.5 + i / 1e7, int(i % 3 == 0)) for i in range(5000)] + [("b", 0.25, 1), ("b", None, 1), ("b", 2.0, 0)]
    df = spark.createDataFrame(close, "mode string, confidence double, success int")
    sums = S.confidence_sums(df, "mode")
    slots = {r["slot"]: r["count"] for r in sums.filter("mode = 'a'").groupBy("slot").count().collect()}
    assert len(slots) > 900 and max(slots.values()) < 30
    order = [r["slot"] for r in sums.filter("mode = 'a'").orderBy("confidence").collect()]
    assert order == sorted(order)
    before = {(r["mode"], r["confidence"]): r["before"] for r in S.confidence_rows(df, "mode").collect()}
    assert [before["a", c] for _, c, _ in close[:5000]] == list(range(5000)) and before["b", 1.0] == 1
    assert S.confidence_rows(df.limit(0), "mode").count() == 0
