"""The pipeline's stages against their operators, and its contract."""

import hashlib
import math
import os

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from tessera.llm import byte_bpe, decontaminate, pii, toxicity
from tessera.llm.queries import BYTE_RANKS, ORACLES, PII_KEY, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def simhash_of(text):
    """The contract's fingerprint, bit by bit."""
    words = (text or "").encode().lower().split()
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stages_keep_columns_and_have_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    one = stage["toxicity"](spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    logit = lambda t: model.bias + sum(weight.get(f, 0.0) for f in toxicity.document_features(t or "").tolist())
    rejected = {k for k, t in texts.items() if 1 / (1 + math.exp(-logit(t))) >= 0.3}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == texts.keys() - rejected
    two = stage["near_duplicates"](spark, one, SF)
    left = sorted(texts.keys() - rejected)
    prints = {k: simhash_of(texts[k]) for k in left}
    root = {k: k for k in left}
    for a in left:
        for b in left:
            if (prints[a] ^ prints[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    groups = set(root.values())
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == groups
    three = stage["decontamination"](spark, two, SF)
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in groups if not any(q in decontaminate.normal(texts[i]) for q in items)}
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == clean
    four = stage["pii"](spark, three, SF).collect()
    own = pii.Pseudonyms(PII_KEY)
    assert {r["doc_id"]: r["text"] for r in four} == {i: own.replace(texts[i])[0] for i in clean} and all(r["n_chars"] == len(r["text"]) for r in four)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows) and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_every_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_give_the_rows_of_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in order) for r in want.fetchall())


def test_decoded_text_is_the_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    import public_tokenizers

    got = {r["doc_id"]: r["decoded_sha256"] for r in byte_bpe.digest_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}


def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "lone words without any id here", "en", "s", 1), (5, "", "en", "s", 0), (5, "one more text of that very id", "en", None, 3)], docs.schema)
    both = docs.unionByName(odd).unionByName(odd).withColumns({c: F.lit("own") for c in ("score", "nth", "row", "fp", "pii_kinds", "text_hash")})
    kept = both
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == both.columns, name
    rows = kept.collect()
    assert all(r[c] == "own" for r in rows for c in ("score", "nth", "row", "fp", "pii_kinds", "text_hash"))
    assert [r["text"] for r in rows if r["doc_id"] is None] == ["lone words without any id here"] and sum(r["text"] == "one more text of that very id" for r in rows) == 1
    none = both.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
