"""The session log, the store of embeddings, readers of files, and the closure by doubling."""

import glob
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding as E
from tessera.operators import kg as K
from tessera.operators import memory as M
from tessera.operators import normalize as N
from tessera.operators import retrieval as R
from tessera.operators import routing as G
from tessera.operators import stats as S
from tessera.sources import files

SCHEMA = "session_id string, content string"


def live_any(spark, path, schema):
    return {(r["session_id"], r["content"]) for r in M.read(spark, path, schema).collect()}


def test_a_log_of_batches_flushes_and_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda *data: spark.createDataFrame(list(data), SCHEMA)
    schema = spark.createDataFrame([], SCHEMA).schema
    assert live_any(spark, path, schema) == set()
    M.add(rows(("a", "1"), ("b", "2"), (None, "3")), path, 1)
    M.add(rows(("a", "4")), path, 2)
    M.add(rows(("a", "5")), path, 2)
    assert live_any(spark, path, schema) == {("a", "1"), ("b", "2"), ("a", "5"), (None, "3")}
    M.flush(spark.createDataFrame([("a",), ("absent",)], "session_id string"), path, 3)
    assert live_any(spark, path, schema) == {("b", "2"), (None, "3")}
    M.add(rows(("a", "6")), path, 4)
    assert live_any(spark, path, schema) == {("b", "2"), (None, "3"), ("a", "6")}
    M.compact(spark, path, 3, schema)
    assert live_any(spark, path, schema) == {("b", "2"), (None, "3"), ("a", "6")}
    M.flush(spark.createDataFrame([("b",)], "session_id string"), path, 5)
    M.compact(spark, path, 5, schema)
    M.compact(spark, path, 5, schema)
    assert live_any(spark, path, schema) == {(None, "3"), ("a", "6")}
    M.reset(spark, path, 6, schema)
    assert live_any(spark, path, schema) == set()
    M.add(rows(("c", "7")), path, 7)
    assert live_any(spark, path, schema) == {("c", "7")}


def test_many_sessions_make_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "BUCKETS", 8)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("session_id"), F.lit("x").alias("content"))
    for batch in (1, 2):
        M.add(rows, f"file://{tmp_path}/log", batch)
    found = glob.glob(f"{tmp_path}/log/log/**/*.parquet", recursive=True)
    assert 0 < len(found) <= 16
    M.compact(spark, f"file://{tmp_path}/log", 2, rows.schema)
    assert 0 < len(glob.glob(f"{tmp_path}/log/snapshot-2/**/*.parquet", recursive=True)) <= 8
    assert M.read(spark, f"file://{tmp_path}/log", rows.schema).count() == 40_000


def test_only_absent_contents_are_encoded(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda *texts: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    first, batch = E.embed_stored(rows("a", "b", "a", None, ""), "text", path, E.digest_encoder(4), "digest", 4)
    assert E.encoded(spark, path, batch) == 3 and first.count() == 5 and first.columns == ["id", "text", "embedding"]
    want = {r["id"]: r["v"] for r in rows("a", "b", "a", "", "").select("id", R.hash_embed(F.col("text"), 4).alias("v")).collect()}
    assert all(np.allclose(r["embedding"], want[r["id"]]) for r in first.collect())
    _, batch = E.embed_stored(rows("b", "c"), "text", path, E.digest_encoder(4), "digest", 4)
    assert E.encoded(spark, path, batch) == 1
    _, batch = E.embed_stored(rows("a", "b", "c"), "text", path, E.digest_encoder(6), "digest", 6)
    assert E.encoded(spark, path, batch) == 3
    other, batch = E.embed_stored(rows("a"), "text", path, lambda t: np.ones((len(t), 6)), "ones", 6)
    assert E.encoded(spark, path, batch) == 1 and np.allclose(other.first()["embedding"], 6**-0.5)
    none, batch = E.embed_stored(rows("a").limit(0), "text", path, E.digest_encoder(4), "digest", 4)
    assert none.count() == 0 and E.encoded(spark, path, batch) == 0
    with pytest.raises(Exception, match="dimension 5"):
        E.embed_stored(rows("new"), "text", path, E.digest_encoder(4), "digest", 5)


def test_bad_lines_are_dropped_and_rows_of_nulls_stay(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# note\n{"a": 1}\nnot json\n\n{"b": 2}\n{"a": "x"}\n  # more\n{"a": 3, "_c": 1}\n[1, 2]\n')
    got = files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a long", comments=True)
    assert got.columns == ["a"] and sorted((r["a"] is None, r["a"] or 0) for r in got.collect()) == [(False, 1), (False, 3), (True, 0)]
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a long", strict=True, comments=True).collect()


def test_quoted_cells_of_csv_files_stay_whole(spark, tmp_path):
    (tmp_path / "t.csv").write_text('h1,h2,h3\n"x, y",2,\n,"say ""hi""",z\nplain,b,c\n')
    good, _ = files.ingest_files(spark, f"file://{tmp_path}")
    assert good.first()["text"].split("\n") == ["x, y 2 ", ' say "hi" z', "plain b c"]


def test_many_run_files_are_one_scan_for_each_header(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"r{k}.csv").write_text(f"id,mode\n{k},M\n" if k % 2 else f'id,"mode, long",success\n{k},N,1\n')
    df = files.read_runs(spark, [f"file://{tmp_path}/r{k}.csv" for k in range(6)], {"success": 0, "mode": "none"})
    assert {(r["id"], r["mode"], r["success"], r["source_file"]) for r in df.collect()} == {(str(k), "M", 0.0, f"r{k}.csv") if k % 2 else (str(k), "none", 1.0, f"r{k}.csv") for k in range(6)}
    assert len(re.findall(r"FileScan csv|Relation .*csv", df._jdf.queryExecution().optimizedPlan().toString())) == 2


def test_an_object_without_keys_is_readable(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, "nope"), (3, '{"k": "v"}'), (4, None), (5, '{"k": "..."}'), (6, '{"z": 1}')], "id long, line string")
    got = {(r["id"], r["violation"], r["fatal"]) for r in N.validate_json(rows, "line", "id", "k string", ["k"]).collect()}
    assert got == {(1, "missing k", True), (2, "invalid json", True), (4, "invalid json", True), (5, "placeholder", False), (6, "missing k", True)}


def test_long_chains_and_cycles_close(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)] + [("x", "y"), ("y", "x"), ("x", "x")], "a string, b string")
    got = {tuple(r) for r in K.transitive(edges, "chain").collect()}
    assert got == {(str(i), str(j)) for i in range(20) for j in range(i + 1, 21)} | {("x", "y"), ("y", "x")}


def test_poisson_weights_and_bounds(spark):
    w = [r["w"] for r in spark.range(40_000).select(S.poisson_weight(F.col("id").cast("string")).alias("w")).collect()]
    assert abs(np.mean(w) - 1) < 0.02 and abs(np.var(w) - 1) < 0.05
    rows = spark.createDataFrame(pd.DataFrame({"g": ["a", "b"] * 2000, "id": range(4000), "x": [float(i % 3 == 0) for i in range(4000)]}))
    got = {r["g"]: r for r in S.poisson_bootstrap(rows.repartition(5), ("g",), "id", "x", 400).collect()}
    for r in got.values():
        assert r["n"] == 2000 and r["ci_low"] < r["mean"] < r["ci_high"] and abs((r["ci_high"] - r["ci_low"]) / (2 * 1.96) - (2 / 9 / 2000) ** 0.5) < 0.003 and r["p_value"] == 0
    again = {r["g"]: r for r in S.poisson_bootstrap(rows.coalesce(1), ("g",), "id", "x", 400).collect()}
    assert got == again
    assert S.poisson_bootstrap(rows.limit(0), ("g",), "id", "x", 10).count() == 0


def test_least_squares_are_those_of_the_whole_matrix(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 2))
    label = np.where(x[:, 0] > 0.3, "a", np.where(x[:, 1] > 0, "b", "c"))
    rows = [(float(p), float(q), str(k)) for (p, q), k in zip(x, label, strict=True)] + [(None, 1.0, "a"), (1.0, 1.0, None)]
    weights, bias, counts = G.router_least_squares(spark.createDataFrame(rows, "f double, g double, label string").repartition(4), ["f", "g"])
    for k in "abc":
        want = np.linalg.lstsq(np.c_[x, np.ones(500)], (label == k).astype(float), rcond=None)[0]
        assert np.allclose([*weights[k], bias[k]], want) and counts[k] == (label == k).sum()
    with pytest.raises(ValueError, match="no labelled rows"):
        G.router_least_squares(spark.createDataFrame(rows[-2:], "f double, g double, label string"), ["f", "g"])
    same, _, _ = G.router_least_squares(spark.createDataFrame([(a, a, k) for a, _, k in rows[:9]], "f double, g double, label string"), ["f", "g"])
    assert all(np.isclose(*w) for w in same.values()), "features that depend on each other share the weight"


def test_files_are_chosen_by_name_and_time_without_reading_them(spark, tmp_path):
    import os

    from tessera.sources import catalogue as C

    names = [
        ("eval_joined_battery_20250101_000000.csv", 5), ("eval_joined_battery_20250102_000000.csv", 4), ("eval_joined_hvac_20250103_000000_calibrated.csv", 9), ("eval_joined_hvac_20250103_000000.csv", 8),
        ("eval_joined_20250104_000000.csv", 7), ("trace_20250102_000000.jsonl", 1), ("trace_20250103_000000.jsonl", 2), ("selective_20250105_000000.csv", 99), ("eval_joined_other.csv", 3),
    ]

    def put(name, at):
        (tmp_path / name).write_bytes(b"\xff" * 10)
        os.utime(tmp_path / name, (at * 1000, at * 1000))

    for name, at in names:
        put(name, at)
    files = lambda: C.catalogue(C.files_of(spark, f"file://{tmp_path}"))
    short = lambda df, *more: {tuple([r["path"].rsplit("/", 1)[1], *(r[c] for c in more)]) for r in df.collect()}
    assert "content" not in files()._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert len(short(files())) == 8
    assert short(C.newest_by_domain(files()), "domain") == {("eval_joined_battery_20250101_000000.csv", "battery"), ("eval_joined_hvac_20250103_000000_calibrated.csv", "hvac")}
    assert short(C.calibrated_first(files()), "column") == {("eval_joined_hvac_20250103_000000_calibrated.csv", "confidence_cal")}
    assert short(C.joined_runs(files())) == {(n,) for n, _ in names if n.startswith("eval_joined") and "calibrated" not in n}
    traces = {r["path"].rsplit("/", 1)[1]: r["trace"].rsplit("/", 1)[1] for r in C.with_traces(files().filter("kind = 'run'"), files()).collect()}
    assert traces["eval_joined_battery_20250102_000000.csv"] == "trace_20250102_000000.jsonl"
    assert traces["eval_joined_hvac_20250103_000000_calibrated.csv"] == "trace_20250103_000000.jsonl"
    assert traces["eval_joined_20250104_000000.csv"] == "trace_20250103_000000.jsonl", "the newest, where the stamp has none"
    put("eval_joined_pooled_20250101_000000.csv", 1)
    put("eval_joined_pooled_20250102_000000.csv", 6)
    assert short(C.joined_runs(files())) == {("eval_joined_pooled_20250102_000000.csv",)}
    none = C.catalogue(C.files_of(spark, f"file://{tmp_path}", "selective*"))
    assert C.calibrated_first(none).count() == C.joined_runs(none).count() == C.newest_by_domain(none).count() == 0
