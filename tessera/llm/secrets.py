"""Secret scans with a ledger of blobs: every text is addressed by its SHA-256, and what was scanned once isn't scanned again.

The ledger is a Parquet table in a folder that the cluster shares: blob, rules (ids of the rule versions that scanned it) and
found (their findings). A scan digests all versions of all paths, looks up which rule versions each blob still lacks, takes the
text of one row for each such blob, runs only the lacking rules, appends the outcome to the ledger, and joins findings back to
every path that holds the blob. Two scans at once may append one pair twice; readers take findings once.

Digests are narrow rows. Texts are shuffled once, compressed, and only from tasks that hold a blob that is to be scanned; they
are dealt by (blob, path), so a blob that a third of all rows hold is no hot key, and its other copies are dropped by a join with
narrow rows. The join back deals hot blobs over tasks.

Cases: a null text is the empty blob; a null path is a path like others; repeated rows give repeated results; a text of any
length is scanned whole, as one value of one row; findings of a rule don't overlap, those of different rules may; rows keep the
path columns that the caller names, others are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, spread


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of `pattern` that don't overlap, of which those stay whose `group` has at least `least` characters.

    version: to be raised whenever pattern, least or group change; every blob is then scanned anew, by this rule only.
    hint: a string that each match contains, or empty. Patterns are of the common part of the regular expressions of Python and RE2.
    """

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    hint: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(words: str) -> str:
    """`words` as a pattern that takes ASCII letters in either case, and no other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


#: The first three have fixed patterns; the others are published formats of keys and tokens.
RULES = (
    Rule("assign", 1, "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", 1, "AKIA[A-Z0-9]+", 18, hint="AKIA"),
    Rule("hex", 1, "[0-9a-f]{16,}", 16),
    Rule("github", 1, "gh[opusr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", 1, "xox[abposr]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("url", 1, r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%!$&*+=-]{1,80}:[A-Za-z0-9._~%!$&*+=-]{3,200}@", hint="://"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----", hint="-----BEGIN"),
)

SPANS = "array<struct<rule: string, start: long, end: long>>"
LEDGER = f"blob string, rules array<string>, found {SPANS}"
LEVEL = 3


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Code points of the rule's matches, end exclusive."""
    if rule.hint and rule.hint not in text:
        return []
    return [m.span() for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def versions_of(docs: DataFrame, paths: list[str]) -> DataFrame:
    """The path columns, blob, and `at`: a hash of the paths that tells a blob's rows apart (rows that share it share the text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*paths, F.sha2(text, 256).alias("blob"), F.xxhash64(*paths).alias("at"), text.alias("text"))


def ledger_of(spark, path: str) -> DataFrame:
    """The ledger at `path`; where there is none, an empty one is written first."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def lacking(blobs: DataFrame, ledger: DataFrame, rules: list[str]) -> DataFrame:
    """blob, at, todo: the rule versions that haven't scanned the blob; blobs that lack none have no row."""
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("rules", F.lit(rules))))).alias("seen"))
    todo = F.when(F.col("seen").isNull(), F.lit(rules)).otherwise(F.array_except(F.lit(rules), "seen"))
    return blobs.join(seen, "blob", "left").select("blob", "at", todo.alias("todo")).filter(F.size("todo") > 0)


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """blob, at and the compressed text; a task's repeated rows once."""
    done: set[tuple[str, int]] = set()
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = []
        for k, key in enumerate(keys):
            if key not in done:
                done.add(key)
                fresh.append(k)
        texts = batch.column(2)
        packed = pa.array([pack(texts[k].as_py().encode()) for k in fresh], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fresh, pa.int64())), batch.column(1).take(pa.array(fresh, pa.int64())), packed], names=["blob", "at", "packed"])


def _scanning(rules: tuple[Rule, ...]):
    by_id = {rule.id: rule for rule in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for blob, packed, todo in zip(*(batch.column(k) for k in range(3)), strict=True):
                blob = blob.as_py()
                if blob in done:
                    continue
                done.add(blob)
                text, todo = unpack(packed.as_py()).decode(), todo.as_py()
                out.append((blob, todo, [{"rule": r, "start": a, "end": b} for r in todo for a, b in spans(text, by_id[r])]))
            blobs, scanned, found = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(scanned, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "rules", "found"])

    return run


def scan(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, paths: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The path columns, blob and findings (array of kind, start, end: by start, then as `rules` lists them) for each row of `docs`.

    Every row is a version of what its path columns name. The ledger at `ledger_path` gets the pairs of blob and rule version that
    it lacks; findings of other versions of a rule are kept in it but not returned.
    """
    spark, ids = docs.sparkSession, [rule.id for rule in rules]
    versions = cut(versions_of(docs, list(paths)).drop("text").withColumn("row", F.monotonically_increasing_id()), "versions")
    blobs = cut(versions.groupBy("blob").agg(F.min("at").alias("at"), F.count("*").alias("n")), "blobs")
    todo = cut(lacking(blobs, ledger_of(spark, ledger_path), ids), "blobs-todo")
    texts = versions_of(docs, list(paths)).select("blob", "at", "text").mapInArrow(_packing, "blob string, at long, packed binary")
    scanned = texts.join(todo.hint("shuffle_hash"), ["blob", "at"]).select("blob", "packed", "todo").mapInArrow(_scanning(rules), LEDGER)
    if not todo.isEmpty():
        scanned.write.mode("append").parquet(ledger_path)
    order = F.create_map(*[F.lit(x) for k, i in enumerate(ids) for x in (i, k)])
    found = ledger_of(spark, ledger_path).select("blob", F.explode("found").alias("f")).filter(F.col("f.rule").isin(ids))
    span = F.struct(F.col("f.start").alias("start"), order[F.col("f.rule")].alias("k"), F.col("f.end").alias("end"))
    found = found.select("blob", span.alias("span")).distinct().groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    findings = F.transform("spans", lambda s: F.struct(F.get(kinds, s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    keyed = blobs.select("blob").join(found, "blob", "left")
    keyed = keyed.select("blob", F.coalesce(findings, F.array().cast("array<struct<kind: string, start: long, end: long>>")).alias("findings"))
    back = spread(versions, keyed, blobs.select("blob", "n"), ["blob"], versions.count(), F.col("row"))
    return back.select(*paths, "blob", "findings")


def joined(findings: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def n_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
