"""Registered queries of this subpackage: thin digests over its operators, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, collocations, common, decontaminate, language, merkle, oracles, pii, quality, repeats, secrets, simhash, token_counts, token_files, toxicity

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: The setting that holds the key of pseudonyms. Without it the registered queries, whose results must be the same every time,
#: take the demonstration key, which anyone can read here; the operator itself has no default.
PII_SETTING = "spark.tessera.pii.key"
PII_KEY = b"demonstration key"
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pii_key(spark: SparkSession) -> bytes:
    found = spark.conf.get(PII_SETTING, None)
    return found.encode() if found else PII_KEY


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_regions(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius of 4 bits is the contract's: links are exact, and of planted near copies they catch about half."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pii_key(spark))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest_documents(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), WORD_VOCABULARY)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_file(documents(spark, sf_dir), WORD_VOCABULARY, path)
    return token_files.document_checksums(token_files.read_token_file(spark, path))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).drop("remaining")


def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents, over a new ledger."""
    found = secrets.scan(documents(spark, sf_dir), f"{common.shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))
    counts = [secrets.n_of(F.col("findings"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir)).drop("cut")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), merkle.tampered())


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, source, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
), line AS (
  SELECT doc_id, source,
         trim(regexp_replace(translate(lower(line), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, source, unnest(lines) AS line FROM w)
), common AS (
  SELECT source, line FROM line GROUP BY source, line HAVING count(DISTINCT doc_id) > 50
), removed AS (
  SELECT doc_id, sum(length(line.line) - length(replace(line.line, ' ', '')) + 1) AS n
  FROM line JOIN common ON line.line = common.line AND line.source IS NOT DISTINCT FROM common.source
  GROUP BY doc_id
), verdict AS (
  SELECT base.*, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM base LEFT JOIN removed ON removed.doc_id = base.doc_id
)
SELECT *, NOT base_failed AND n_removed_words <= 0.8 * n_words AS kept FROM verdict
"""

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_token_files": op8_token_files,
    "op9_language": op9_language,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scans": op11_secret_scans,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}
ORACLES = {
    "op10_quality_rules": OP10_SQL,
    "op11_secret_scans": oracles.secret_scans(secrets.RULES),
    "op12_collocations": oracles.COLLOCATIONS,
    "op13_merkle": oracles.merkle(),
}
