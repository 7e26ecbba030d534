"""Steps whose plans must not gather a table in few tasks, shuffle it twice or compute a vector for each of its elements."""

from pyspark.sql import functions as F

from tessera.operators import embedding as E
from tessera.operators import kg as K
from tessera.operators import retrieval as R
from tessera.operators import text as T
from tessera.sources import views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_of_runs_are_dropped_where_the_join_put_them(spark):
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(views.runs(spark, SF)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_a_vector_and_the_words_of_a_text_are_computed_once(spark):
    df = spark.createDataFrame([(16.0, "k", "b c")], "x double, k string, t string")
    v = R.l2_normalize(F.array(F.cbrt("x"), F.lit(3.0))).alias("v")
    assert plan(df.select(v)).upper().count("CBRT(X") == 1
    assert [round(x, 6) for x in df.select(R.l2_normalize(F.array(F.sqrt("x"), F.lit(3.0)))).first()[0]] == [0.8, 0.6]
    assert df.select(R.l2_normalize(F.lit(None).cast("array<double>"))).first()[0] is None
    swapped = T.synonyms_swapped(F.col("k"), F.col("t"), 1, {"b": ["d"]}).alias("v")
    assert plan(df.select(swapped)).count("split(t") == 1 and df.select(swapped).first()[0] == "d c"


def test_closure_joins_domains_by_broadcast(spark):
    rows = [("a", "p", "b", False), ("p", "domain", "D", False), ("p", "range", "E", False)]
    closed = K.closure(spark.createDataFrame(rows, "s string, p string, o string, o_is_literal boolean"))
    assert {("a", "type", "D"), ("b", "type", "E")} <= {tuple(r)[:3] for r in closed.collect()}
    assert "SortMergeJoin" not in plan(closed)


def test_encoders_see_few_texts_at_once(spark, tmp_path):
    def encode(texts):
        assert len(texts) <= E.TEXTS
        return E.digest_encoder(3)(texts)

    df = spark.range(700).select("id", F.col("id").cast("string").alias("t")).coalesce(1)
    found, batch = E.embed_stored(df, "t", f"file://{tmp_path}/store", encode, "small", 3)
    assert found.filter("size(embedding) = 3").count() == 700 == E.encoded(spark, f"file://{tmp_path}/store", batch)


def test_router_labels_and_features_are_one_aggregate(spark):
    from tessera.plans import routing

    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(routing.labelled(spark, SF)).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
