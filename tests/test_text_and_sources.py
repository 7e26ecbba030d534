"""Text operators, readers and writers on small fixtures."""

from pyspark.sql import functions as F

from tessera.operators import normalize as N
from tessera.operators import routing as G
from tessera.operators import text as T
from tessera.sources import files


POOL = {"battery": ["battery", "cell"], "label": ["tag", "label"], "test": ["check"]}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_chunks(spark):
    text = "\n\n".join(["a" * 40, "b" * 40, "", "c" * 100, "d" * 5])
    assert one(spark, text, lambda c: T.chunk_paragraphs(c, 50, 90)) == ["a" * 40 + "\n\n" + "b" * 40, "c" * 100, "d" * 5]
    assert one(spark, "", lambda c: T.chunk_paragraphs(c)) == []


def test_numbers_shift_and_stop_at_zero(spark):
    assert one(spark, "3 of x9, 10 and 0.", lambda c: T.numbers_shifted(c, -5)) == "0 of x9, 5 and 0."
    assert one(spark, "9", lambda c: T.numbers_shifted(c, 1)) == "10"


def test_noise_and_synonyms_keep_blanks(spark):
    assert len(one(spark, "two words", lambda c: T.noise_inserted(F.lit("k"), c, 2, ["oh", "well"])).split(" ")) == 4
    swapped = one(spark, "Battery  label test", lambda c: T.synonyms_swapped(F.lit("k"), c, 2, POOL))
    assert swapped.split(" ")[0] in ("Battery", "Cell") and swapped.endswith(" test") and "  " in swapped


def test_scores(spark):
    s = lambda kind, answer, gold, aliases=None: one(spark, answer, lambda c: N.score_success(F.lit(kind), c, F.lit(gold), F.lit(None).cast("array<string>") if aliases is None else F.array(*map(F.lit, aliases))))
    assert s("recall", "It is NMC-811!", "nmc 811") == 1 and s("recall", "none", "x", ["none"]) == 1 and s("recall", "a", "") == 0
    assert s("open", "The  Span here", "the span") == 1 and s("logic", "yes, it is", "yes") == 0 and s("logic", "yes it is", "yes") == 1
    assert s("logic", "it is Battery", "battery") == 1 and s("other", "x", "x") == 0


def test_confidence_and_composition(spark):
    nothing = F.lit(None).cast("string")
    got = spark.range(1).select(
        G.confidence_from_features(F.lit(0.5), F.lit(0.4), F.lit(False)).alias("both"), G.confidence_from_features(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True)).alias("fired"),
        G.compose_answer(F.lit("MEMSYM"), nothing, F.lit("t"), nothing).alias("fallback"), G.compose_answer(F.lit("SYM"), nothing, F.lit("t"), nothing).alias("none"), G.compose_answer(F.lit("SYM_ONLY"), nothing, nothing, nothing).alias("only"),
        G.clamp(F.lit(None).cast("double")).alias("null"),
    ).first()
    assert tuple(got) == (0.8, 0.95, "Search: t", "No result found.", "Insufficient context", None)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('# note\n{"id": "1", "n": 2}\n\n{bad\n{"id": "2", "n": 3}\n')
    assert sorted(r["id"] for r in files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "id string, n int").collect() if r["id"]) == ["1", "2"]
    assert {r["id"] for r in files.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "id string, n int", comments=True).collect() if r["id"]} == {"1", "2"}


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.csv").write_text("h1,h2\n1,2\n3,4\n")
    (tmp_path / "c.json").write_text("not json")
    (tmp_path / "d.bin").write_text("?")
    good, bad = files.ingest_files(spark, f"file://{tmp_path}")
    assert {r["doc_id"]: r["text"] for r in good.collect()} == {"a.txt": "hello", "b.csv": "1 2\n3 4", "c.json": "not json"}
    assert [r["doc_id"] for r in bad.collect()] == ["d.bin"]


def test_ntriples(spark, tmp_path):
    (tmp_path / "t.nt").write_text('<http://x#a> <http://x#p> <http://x#b> .\n<http://x#a> <http://x#l> "two words"@en .\n# c\n<http://x#a> <http://x#p> <http://x#b> .\n')
    got = {(r["o"], r["o_is_literal"]) for r in files.read_ntriples(spark, f"file://{tmp_path}/t.nt").collect()}
    assert got == {("http://x#b", False), ("two words", True)}


def test_kv_lines(spark):
    df = spark.createDataFrame([(1, "Voltage: 48 V\n- Mass = 3 kg\nColour  red\nvoltage: 48 V\nplain")], "doc int, text string")
    assert {(r["label"], r["value"]) for r in T.extract_kv(df, "doc", "text").collect()} == {("Voltage", "48 V"), ("Mass", "3 kg"), ("Colour", "red")}


def test_questions_quarantine(spark):
    df = spark.createDataFrame([(None, None, "What?", None, "d", 1), ("a", " ", None, None, "d", 2)], "id string, query string, question string, type string, domain string, position int")
    good, bad = N.canonical_questions(df, "position")
    assert [tuple(r) for r in good.select("id", "query", "session", "type").collect()] == [("d_1", "What?", "s1", "open")] and bad.count() == 1


def test_scorers_and_evaluators_are_parameters(spark):
    from tessera.operators import routing as G

    df = spark.createDataFrame([("recall", "It is X", "x"), ("yesno", "Yes sir", "yes"), ("open", None, "y")], "kind string, answer string, gold string")
    own = {**N.SCORERS, "yesno": lambda answer, gold, aliases: F.lower(answer).startswith(gold).cast("int")}
    got = [r[0] for r in df.select(N.score_success(F.col("kind"), F.col("answer"), F.col("gold"), F.lit(None).cast("array<string>"), own)).collect()]
    assert got == [1, 1, 0] and df.select(N.score_success(F.col("kind"), F.col("answer"), F.col("gold"), F.lit(None).cast("array<string>")).alias("s")).filter("s = 1").count() == 1
    none = F.array().cast("array<string>")
    length = lambda e: F.length(e["answer"]).cast("double")
    rewards = [r[0] for r in df.select(G.episode_reward(F.col("answer"), F.col("gold"), none, none, none, none, evaluator=length)).collect()]
    assert rewards == [7.0, 7.0, -0.5]


def test_numeric_contexts_over_repeats_and_edges(spark):
    text = "5 kg " + "x" * 50 + " 5 kg and 7,5 °C." + "y" * 60
    got = [tuple(r)[1:] for r in T.numeric_contexts(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none")], "k int, t string"), "k", "t").collect()]
    want = [(v, at, text[max(0, at - 40) : at + len(v) + 40]) for v, at in (("5 kg", 0), ("5 kg", 56), ("7,5 °C", 65))]
    assert got == want
