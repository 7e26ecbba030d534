"""Readers and writers: JSON lines, run CSVs, whole-text documents, mixed files, N-Triples, traces."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


#: Column that tells bad JSON from rows of nulls.
CORRUPT = "_corrupt_line"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, comments: bool = False) -> DataFrame:
    """JSON lines: blank lines are skipped, bad ones dropped (or an error if strict), lines with # skipped on request."""
    if comments:
        lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
        if strict:
            return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        row = F.from_json("value", f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
        return lines.select(row.alias("r")).filter(F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """f and h: each file and its first line, by one job; a row for each file, as many as the caller lists."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.col("value").alias("h"))
    return lines.withColumn("p", F.monotonically_increasing_id()).filter("b = 0 and h <> ''").groupBy("f").agg(F.min_by("h", "p").alias("h"))


def read_runs(spark: SparkSession, paths: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """CSVs with headers as one table: tagged by file, missing columns added, nulls replaced by defaults."""
    # Files with one header are one scan, however many there are.
    heads: dict[str, list[str]] = {}
    for file, head in sorted((r["f"], r["h"]) for r in headers(spark, paths).collect()):
        heads.setdefault(head, []).append(file)
    out = None
    for head, files in heads.items():
        names = next(csv.reader([head]))
        schema = StructType([StructField(name, StringType()) for name in names])
        one = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files).withColumn("source_file", F.col("_metadata.file_name"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    for name, value in defaults.items():
        have = F.col(name).try_cast("double") if name in out.columns and isinstance(value, (int, float)) else F.col(name) if name in out.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(have, F.lit(value)))
    return out


def read_text_docs(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """doc_id (file name) and text of whole files."""
    text = F.trim(F.regexp_replace("value", r"[ \t\r\n]+", " ")) if one_line else F.col("value")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), text.alias("text"))


#: A cell of a CSV line after its comma: quoted, with doubled quotes inside, or up to the next comma.
CELL = r',("(?:[^"]|"")*"|[^,]*)'


def csv_cells(line: Column) -> Column:
    """Cells of a CSV line, joined by blanks; commas inside quotes are part of a cell."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    plain = lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(cells, plain), " ")


def ingest_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text of files by extension, and the files of unknown kinds, for quarantine.

    txt and md as they are; csv without its header, cells joined by blanks; json as text, pretty if it is one object; lines of
    objects as they are.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value"))
    kind = F.lower(F.regexp_extract("doc_id", r"\.([A-Za-z0-9]+)$", 1))
    rows = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    csv = F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), csv_cells), "\n")
    objects = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<map<string,string>>")
    pretty = F.when(F.size(objects) == 1, F.to_json(F.get(objects, F.lit(0)), {"pretty": "true"}))
    text = F.when(kind.isin("txt", "md"), F.col("value")).when(kind == "csv", csv).when(kind == "json", F.coalesce(pretty, F.col("value")))
    typed = raw.select("doc_id", kind.alias("kind"), text.alias("text"))
    return typed.filter("text is not null"), typed.filter("text is null").select("doc_id", "kind")


NT = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)"[^ ]*) *\. *$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o and o_is_literal of N-Triples lines, once each; other lines are skipped."""
    lines = spark.read.text(path).filter(F.col("value").rlike(NT))
    part = lambda g: F.regexp_extract("value", NT, g)
    literal = F.col("value").rlike(r'> "')
    return lines.select(part(1).alias("s"), part(2).alias("p"), F.when(literal, part(4)).otherwise(part(3)).alias("o"), literal.alias("o_is_literal")).distinct()


def read_alias_map(spark: SparkSession, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """term and alias of a dictionary, each term an alias of itself."""
    rows = [(t, a) for t, names in aliases.items() for a in dict.fromkeys([t, *names])]
    return spark.createDataFrame(rows, "term string, alias string")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the committer replaces a folder as a whole."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with the columns in the order of their names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("header", True).csv(path)


def append_trace(df: DataFrame, path: str) -> None:
    """Append trace rows, a folder for each mode."""
    df.write.mode("append").partitionBy("mode").parquet(path)


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Each table as CSV under its name; the paths written."""
    out = []
    for name, df in tables.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}")
        out.append(f"{folder.rstrip('/')}/{name}")
    return out


def flatten_corpus(df: DataFrame) -> DataFrame:
    """Passages from documents: chunks where there are some, else rows with a pid as they are, else text as {doc_id}#p1."""
    text = F.trim(F.coalesce("text", F.lit("")))
    whole = F.array(F.struct(F.coalesce("pid", F.concat("doc_id", F.lit("#p1"))).alias("pid"), text.alias("text")))
    pieces = F.when(F.coalesce(F.size("chunks"), F.lit(0)) > 0, F.col("chunks")).otherwise(whole)
    return df.select("doc_id", F.explode(pieces).alias("c")).select("doc_id", "c.pid", F.trim("c.text").alias("text")).filter("text <> ''")


def build_corpus_split(docs: DataFrame, golds: DataFrame | None, split: str) -> DataFrame:
    """id and text of seed documents and gold answers of a split; default ids from sha1; the first of each id stays."""
    from tessera.operators.runs import dedup_keep_first
    from tessera.operators.text import hash_split

    seeds = docs.select(F.coalesce("id", F.substring(F.sha1("text"), 1, 12)).alias("id"), "text", F.lit(0).alias("o"))
    if golds is not None:
        seeds = seeds.unionByName(golds.select(F.concat(F.lit("gold:"), F.substring(F.sha1("text"), 1, 10)).alias("id"), "text", F.lit(1).alias("o")))
    return dedup_keep_first(seeds.filter(hash_split(F.col("id")) == split), ["id"], ["o", "text"]).drop("o")
