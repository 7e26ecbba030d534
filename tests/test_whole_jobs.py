"""Queries and operators that once did less than the whole job."""

import os

import pytest

from pyspark.sql import functions as F

import tessera.plans  # noqa: F401  (fills the registry)
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.registry import QUERIES
from tessera.sources import files

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_dense_search_asks_any_number_of_queries_in_blocks(spark, monkeypatch):
    e = spark.range(60).select(F.col("id").alias("pid"), F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("embedding"))
    asked = e.select(F.col("pid").alias("qid"), "embedding")
    want = sorted(map(tuple, R.dense_topk(e, asked, 3).collect()))
    monkeypatch.setattr(V, "BLOCK", 7)
    got = sorted(map(tuple, R.dense_topk(e, asked, 3).collect()))
    assert got == want and len(got) == 180 and {r[0] for r in got} == set(range(60))
    assert R.dense_topk(e, asked.limit(0), 3).count() == 0


@tables
@pytest.mark.parametrize("name", ["topk_dense", "topk_session"])
def test_searches_answer_every_stated_query(spark, name):
    want = {r[0] for r in rows(spark, "embeddings").filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert {r["qid"] for r in QUERIES[name](spark, SF).collect()} == want and len(want) > 1


@tables
def test_every_event_is_validated(spark, tmp_path):
    spark.createDataFrame([(1, '{"k": "..."}'), (2, '{"k": "v"}'), (3, "{}"), (5, '{"k": "v"}'), (6, "not json")], "event_id long, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["validate_questions"](spark, f"file://{tmp_path}").collect()}
    assert got == {(1, "placeholder"), (3, "missing k"), (6, "invalid json")}


@tables
def test_every_row_is_reported_and_traces_are_those_of_fired_rules(spark):
    assert QUERIES["domain_report_rows"](spark, SF).count() == rows(spark, "part").count()
    ids = sorted(str(r[0]) for r in rows(spark, "lineitem").select("l_orderkey").distinct().collect() if r[0] % 4 == 0 or r[0] % 5 == 0)
    assert [r["id"] for r in QUERIES["sym_trace_sample"](spark, SF).collect()] == ids[:10]


def test_passages_hold_the_whole_text(spark, tmp_path):
    texts = [(0, "x" * 1000), (3, "abcdefg\n" * 500), (4, "y" * 3000), (6, ""), (9, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["flatten_corpus"](spark, f"file://{tmp_path}").collect():
        got.setdefault(int(r["doc_id"]), []).append((int(r["pid"].split("#")[1].removeprefix("p")), r["text"]))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in got.items()} == {k: t for k, t in texts if t}


def test_ingested_json_lines_are_all_there(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    (tmp_path / "b.json").write_text('{"a": "x",\n "b": 2}\n')
    got = {r["doc_id"]: r["text"] for r in files.ingest_files(spark, f"file://{tmp_path}")[0].collect()}
    assert got["a.json"].split() == '{"a": 1} {"a": 2} {"a": 3}'.split() and got["b.json"].split() == '{ "a" : "x", "b" : "2" }'.split()


def test_hybrid_search_asks_in_blocks_and_takes_nulls_and_empty_tables(spark, monkeypatch):
    e = spark.range(40).select(F.col("id").alias("pid"), F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("embedding"))
    asked = e.select(F.col("pid").alias("qid"), "embedding").unionByName(spark.createDataFrame([(77, None)], "qid long, embedding array<double>"))
    pool = e.unionByName(spark.createDataFrame([(99, None)], "pid long, embedding array<double>"))
    sparse = e.select((F.col("pid") % 7).alias("qid"), "pid", (F.col("pid") / 40).alias("score"))
    want = sorted(map(tuple, R.hybrid_topk(sparse, pool, asked, 3).collect()))
    monkeypatch.setattr(R, "MOST_QUERIES", 11)
    assert sorted(map(tuple, R.hybrid_topk(sparse, pool, asked, 3).collect())) == want and len(want) == 120
    for none in (R.hybrid_topk(sparse, pool, asked.limit(0), 3), R.hybrid_topk(sparse, pool.limit(0), asked, 3), R.hybrid_topk(sparse, pool.filter("embedding is null"), asked, 3)):
        assert none.count() == 0


def test_each_fact_is_asked_by_all_four_templates(spark):
    facts = QUERIES["recall_facts"](spark, SF).count()
    asked = QUERIES["question_templates"](spark, SF)
    assert facts > 0 and asked.count() == 4 * facts == asked.select("product", "slot", "query").distinct().count()
