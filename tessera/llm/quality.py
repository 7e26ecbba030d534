"""Quality rules: counts of a text, and lines that many documents of a host share.

DataFrame functions only. Lines are normalised (lower case, digits as 0, white space as one blank), hashed, and counted by
distinct documents of a host (the `source` column). Lines found in more than `most_documents` documents of the host are
boilerplate and are removed; a document is depleted, and rejected, when boilerplate takes more than `most_removed` of its
words. Lines are split and hashed once, into a table in the shared folder. Counts have partial sums before each shuffle, so a
line that a third of all documents hold is one row from each task; the join back to documents deals it over tasks.

Cases: a null text has no words and fails the base rules; null sources are one host, apart from empty ones; rows with a null
doc_id don't count towards a line's documents, and lose common lines like others; repeated rows give repeated results and
count once; other columns are ignored; an empty table gives no rows; a text of any length is one value of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, spread

#: White space of the word rule `[^\\x20\\x09-\\x0D]+` (fixed values).
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Documents of one host that may share a line, and the share of a document's words that may be boilerplate.
MOST_DOCUMENTS = 50
MOST_REMOVED = 0.8


def words(text: Column) -> Column:
    """Words of a text, in order."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def has_word(text: Column) -> Column:
    return F.translate(text, BLANKS, "") != ""


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789" + BLANKS, "000000000" + " " * len(BLANKS)), "  +", " "))


def _repeated(sorted_windows: Column) -> Column:
    """Start positions, ascending, of windows whose hash stands beside an equal one in (hash, start) order."""
    same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
    kept = F.filter(sorted_windows, lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    return F.sort_array(F.transform(kept, lambda x: x["i"]))


def _doubled(hashes: Column, width: int) -> Column:
    """Hashes of windows of 2 * width words from those of width words."""
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - width, F.lit(0))), F.slice(hashes, width + 1, F.greatest(F.size(hashes) - width, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(hashes) > width, pairs).otherwise(F.array().cast("array<bigint>"))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, text with the counts of the base rules, n_symbols and base_failed among them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), has_word)
    df = df.select("*", words(text).alias("words"), lines.alias("lines"))
    df = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    for width in (1, 2, 4):  # hashes of windows of two, four and eight words
        df = df.withColumn("hashes", _doubled(F.col("hashes"), width))
    pairs = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.select("*", pairs.alias("pairs"))
    df = df.select("*", _repeated(F.col("pairs")).alias("starts"))
    starts = F.col("starts")
    covered = F.aggregate(F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    n_words = F.size("words").cast("long")
    df = df.select(
        "doc_id", "source", "text", "lines",
        n_words.alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def document_lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, text_hash, host, no_host, place, hash of the normalised line, and its words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    places = F.posexplode(F.split(text, "\n")).alias("place", "line")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("host"), source.isNull().alias("no_host"), F.xxhash64(text).alias("text_hash"), places)
    df = df.filter(has_word(F.col("line"))).withColumn("line", normal_line(F.col("line")))
    blanks = F.length("line") - F.length(F.translate("line", " ", ""))
    return df.select("doc_id", "text_hash", "host", "no_host", "place", F.xxhash64("line").alias("line_hash"), (blanks + 1).alias("line_words"))


LINE = ["host", "no_host", "line_hash"]


def common_lines(lines: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """LINE of the lines that more than `most_documents` distinct doc_ids of a host hold, with n_docs and n, their rows."""
    counted = lines.groupBy(*LINE, "doc_id").agg(F.count("*").alias("n")).groupBy(*LINE).agg(F.count("doc_id").alias("n_docs"), F.sum("n").alias("n"))
    return counted.filter(F.col("n_docs") > most_documents)


def removed_lines(docs: DataFrame, most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """n_removed_words and places of the removed lines by doc_id and text_hash; documents without boilerplate have no row."""
    lines = cut(document_lines(docs), "lines")
    common = cut(common_lines(lines, most_documents), "common-lines")
    hits = spread(lines, common.select(*LINE), common.select(*LINE, "n"), LINE, lines.count(), F.struct("doc_id", "text_hash", "place"))
    once = hits.select("doc_id", "text_hash", "place", "line_words").dropDuplicates(["doc_id", "text_hash", "place"]).groupBy("doc_id", "text_hash")
    return once.agg(F.sum("line_words").alias("n_removed_words"), F.collect_list("place").alias("places"))


def quality_rules(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_removed: float = MOST_REMOVED) -> DataFrame:
    """One row for each document: the base counts, base_failed, n_removed_words (words of removed lines), remaining and kept.

    remaining: the text without the removed lines. Where it isn't selected, no text is shuffled.
    """
    counts = base_counts(docs).withColumn("text_hash", F.xxhash64("text")).drop("lines", "source")
    removed = removed_lines(docs, most_documents)
    key = counts["doc_id"].eqNullSafe(removed["doc_id"]) & (counts["text_hash"] == removed["text_hash"])
    n_removed = F.coalesce(removed["n_removed_words"], F.lit(0)).cast("long").alias("n_removed_words")
    left = F.array_join(F.filter(F.split(counts["text"], "\n"), lambda line, i: ~F.array_contains(removed["places"], i)), "\n")
    remaining = F.when(removed["places"].isNull(), counts["text"]).otherwise(left).alias("remaining")
    joined = counts.join(removed, key, "left").select(*[counts[c] for c in counts.columns if c not in ("text_hash", "text")], n_removed, remaining)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= most_removed * F.col("n_words")))
