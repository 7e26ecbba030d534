"""Questions mined from documents in three passes, with caps: what a program that goes through the documents in order would take.

Passes: titles (open), labelled values (recall if they hold a number with a unit, or else open), numbers in context (recall). An item
is taken if its type has room in its document and in all, and no item with the same question was taken before. A document's items are
folded in one row. Where a cap over all documents is reached, and an item's number, follow from counts by ranges of documents: no task
orders more than the items of one range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import text as T
from tessera.sources.shared import partitions_for, written

OPEN, RECALL = "open", "recall"
#: Characters of a number's context that a question quotes.
QUOTED = 120
#: Bytes of documents that one task mines: far more time than reading them takes.
MINED_BYTES = 4 << 20
#: Documents of one range.
RANGE = 50_000
#: Numbers of one block, in which free ones are looked for.
BLOCK = 1 << 16


def candidates(docs: DataFrame) -> DataFrame:
    """at, source, pass, place, type, query and expected of all items. docs: at (the order of documents), source, text."""
    item = lambda df, n, place, kind, query, expected: df.select("at", "source", F.lit(n).alias("pass"), place.cast("long").alias("place"), kind.alias("type"), query.alias("query"), expected.alias("expected"))
    about = lambda label: F.concat(F.lit("According to "), "source", F.lit(", what is the "), label, F.lit("?"))
    title = T.extract_title(F.col("text"))
    first = item(docs.withColumn("title", title).filter("title is not null"), 0, F.lit(0), F.lit(OPEN), about(F.lit("model name")), F.col("title"))
    keyed = docs.withColumn("key", F.struct("at", "source"))
    pairs = T.extract_kv(keyed, "key", "text").select("key.*", "label", "value", "line_no")
    second = item(pairs, 1, F.col("line_no"), F.when(F.col("value").rlike(T.NUMERIC), RECALL).otherwise(OPEN), about(F.col("label")), F.col("value"))
    found = T.numeric_contexts(keyed, "key", "text").select("key.*", "value", "start", "context")
    near = F.trim(F.regexp_replace("context", r"[ \t\n\r]+", " "))
    near = F.when(F.length(near) > QUOTED, F.concat(F.substring(near, 1, QUOTED), F.lit("..."))).otherwise(near)
    third = item(found, 2, F.col("start"), F.lit(RECALL), F.concat(F.lit("In "), "source", F.lit(', what is the value reported near: "'), near, F.lit('"?')), F.trim("value"))
    return first.unionByName(second).unionByName(third)


def _taken(items: Column, most: int, until: dict[str, Column]) -> Column:
    """The items that a document gives: `until` has, by type, the last position in all documents that its cap lets through."""
    counted = lambda taken, kind: F.size(F.filter(taken, lambda t: t["type"] == kind))

    def let(x: Column, kind: str) -> Column:
        position = F.struct(x["pass"].alias("pass"), x["at"].alias("at"), x["place"].alias("place"))
        return (x["type"] == kind) & (F.lit(True) if kind not in until else position <= until[kind])

    def step(taken: Column, x: Column) -> Column:
        room = (let(x, OPEN) & (counted(taken, OPEN) < most)) | (let(x, RECALL) & (counted(taken, RECALL) < most))
        new = ~F.exists(taken, lambda t: t["key"] == x["key"])
        return F.when(room & new, F.concat(taken, F.array(x))).otherwise(taken)

    # Where no question is asked twice and there is room for all, items don't hinder each other.
    plain = (F.size(items) <= most) & (F.size(F.array_distinct(F.transform(items, lambda x: x["key"]))) == F.size(items))
    return F.when(plain, F.filter(items, lambda x: let(x, OPEN) | let(x, RECALL))).otherwise(F.aggregate(items, F.slice(items, 1, 0), step))


ORDER = ["pass", "at", "place"]


def _ranged(grouped: DataFrame) -> DataFrame:
    """`grouped` with slot: the range of `at`, in order, of at most about RANGE documents each."""
    usual = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(usual, -(-grouped.count() // RANGE))
    cuts = [k / n for k in range(1, n)] or [0.5]
    found = grouped.agg(F.percentile_approx("at", cuts, 20 * n).alias("cuts")).first()["cuts"] or [0]
    splits = [-float("inf"), *sorted({float(c) for c in found}), float("inf")]
    slots = Bucketizer(splits=splits, inputCol="_at", outputCol="_slot", handleInvalid="keep").transform(grouped.withColumn("_at", F.col("at").cast("double")))
    return slots.withColumn("slot", F.when(F.col("at").isNull(), -1).otherwise(F.col("_slot").cast("int"))).drop("_at", "_slot")


def _end(taken: DataFrame, counts: list, kind: str, cap: int) -> tuple | None:
    """The position of the last item of a type that its cap lets through; None if there are no more than the cap.

    counts: (type, pass, slot, n) of `taken` in order, by which only the items of one range need be ordered.
    """
    of_kind = [c for c in counts if c[0] == kind]
    if sum(c[3] for c in of_kind) <= cap:
        return None
    if not cap:
        return -1, -1, -1
    for _, at_pass, slot, n in of_kind:
        if cap <= n:
            rows = taken.filter((F.col("type") == kind) & (F.col("pass") == at_pass) & (F.col("slot") == slot)).select(*ORDER)
            return tuple(rows.orderBy(*ORDER).offset(cap - 1).limit(1).first())
        cap -= n


def mine(docs: DataFrame, existing: DataFrame, n_open: int, n_recall: int, each: int = 12) -> DataFrame:
    """id, type, source, query, expected and pass of the items taken, at most n_open and n_recall, `each` of a type from a document.

    existing: id and query of questions that there are: theirs aren't asked again (in `text.normal` form), nor are their ids given.
    Ids are docopen- and docrec- with running numbers from 0, in the order in which items are taken.
    """
    dealt = docs.repartition(partitions_for(docs, MINED_BYTES), "at")
    keyed = candidates(dealt).withColumn("key", T.normal(F.col("query")))
    known = existing.select(T.normal(F.col("query")).alias("key")).distinct()
    fresh = keyed.filter("key <> ''").join(known, "key", "left_anti")
    item = F.struct("pass", "at", "place", "type", "query", "expected", "key")
    grouped = _ranged(written(fresh.groupBy("at", "source").agg(F.sort_array(F.collect_list(item)).alias("items")), "mined-items"))
    caps, until = {OPEN: n_open, RECALL: n_recall}, {}
    while True:
        taken = grouped.select("slot", "source", F.explode(_taken(F.col("items"), each, until)).alias("x")).select("slot", "source", "x.*")
        # One number for each type, pass and range.
        counts = sorted(tuple(r) for r in taken.groupBy("type", "pass", "slot").agg(F.count("*").alias("n")).collect())
        ends = {kind: end for kind in (OPEN, RECALL) if kind not in until and (end := _end(taken, counts, kind, caps[kind])) is not None}
        if not ends:
            break
        # Only the type that closes first is sure to close there: what it no longer takes may leave room for the other.
        kind = min(ends, key=lambda k: ends[k])
        until[kind] = F.struct(*[F.lit(v).cast("int" if c == "pass" else "long").alias(c) for c, v in zip(ORDER, ends[kind], strict=True)])
    before, totals = [], {OPEN: 0, RECALL: 0}
    for kind, at_pass, slot, n in counts:
        before.append((kind, at_pass, slot, totals[kind]))
        totals[kind] += n
    before = docs.sparkSession.createDataFrame(before, "type string, pass int, slot int, before long")
    in_range = F.row_number().over(Window.partitionBy("type", "pass", "slot").orderBy("at", "place"))
    numbered = taken.withColumn("in_range", in_range).join(F.broadcast(before), ["type", "pass", "slot"]).withColumn("nth", F.col("before") + F.col("in_range"))
    prefix = F.when(F.col("type") == OPEN, PREFIXES[OPEN]).otherwise(PREFIXES[RECALL])
    return numbered.join(free_numbers(existing, totals), ["type", "nth"]).select(F.concat(prefix, F.lpad("number", 6, "0")).alias("id"), "type", "source", "query", "expected", "pass")


PREFIXES = {OPEN: "docopen-", RECALL: "docrec-"}


def free_numbers(existing: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """type, nth and number: the nth number from 0 that no existing id has with a type's prefix, `wanted` of them for each type.

    Numbers are dealt in blocks; only how many a block has free, one row a block, meets in one place.
    """
    spark, found = existing.sparkSession, None
    for kind, most in wanted.items():
        used = existing.filter(F.col("id").rlike(f"^{PREFIXES[kind]}[0-9]{{6,}}$")).select(F.regexp_extract("id", "[0-9]+$", 0).cast("long").alias("number")).distinct()
        # Of the first `most` + n numbers, n used ones leave `most` at least.
        blocks = -(-(most + used.count()) // BLOCK)
        taken = used.filter(F.col("number") < blocks * BLOCK).groupBy(F.floor(F.col("number") / BLOCK).alias("block")).agg(F.collect_list("number").alias("used"))
        block = spark.range(blocks).withColumnRenamed("id", "block").join(taken, "block", "left")
        sizes = block.select("block", (BLOCK - F.coalesce(F.size("used"), F.lit(0))).alias("n"))
        before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
        numbers = F.array_except(F.sequence(F.col("block") * BLOCK, F.col("block") * BLOCK + (BLOCK - 1)), F.coalesce("used", F.array().cast("array<long>")))
        free = block.join(before, "block").select("before", F.posexplode(numbers).alias("i", "number")).select(F.lit(kind).alias("type"), (F.col("before") + F.col("i") + 1).alias("nth"), "number")
        free = free.filter(F.col("nth") <= most)
        found = free if found is None else found.unionByName(free)
    return found.withColumn("number", F.col("number").cast("string"))
