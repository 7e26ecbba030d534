"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Two fingerprints within `RADIUS` = 4 differing bits agree to one bit in two of their four quarters at least: three quarters
with two differing bits each would make six. So each of the first three quarters has a tree of its own whose levels partition
by the Hamming distance, on one group of bits, to the level's vantage point. The groups of a tree are disjoint, so the triangle
bounds of its levels add up: a fingerprint within one bit of another lies in the same shard (the same distances at all levels)
or in one where a single distance is off by one. Each fingerprint is dealt to its home shard and, as a visitor, to the shards
that its boundary overlaps, on the upper side only, so that every pair meets. The levels are the same for tables of any size. A
shard of many rows is spread over a grid of tasks; what a task can't compare outright goes through inner trees over the other three
quarters, in one of which a pair agrees to one bit again, so that a shard of n rows takes about n ** 2 / 2 ** 16 comparisons more than
n. What is found is checked on all 64 bits.

Shards work on distinct fingerprints, so a group of copies is one row; each task sends on a forest of the links it found, not
all pairs, and the components of the forests are found by alternating star contractions whose edges are cut off into the
shared folder every round. Joins deal the rows of hot keys (hubs, fingerprints and groups of many rows) over tasks.

Cases: null and empty texts and texts without words have fingerprint zero and are linked like others; a null doc_id gets its
fingerprint and the component of its fingerprint's group, and is never the smallest id; repeated rows are repeated in the
result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, id_and_text, slices, spread
from tessera.llm.pretokens import byte_texts

RADIUS = 4
SHINGLE = 4
SEED = 42
BLOCK_BYTES = 1 << 20
#: Vantage points of the quarters' trees (any constants do; a level takes the bits of its group).
VANTAGE = 0x9E3779B97F4A7C15
#: Comparisons made at once, and without an inner tree; links that a task holds before it reduces them to a forest.
OUTRIGHT = 4_000_000
HELD_LINKS = 2_000_000
#: Rows of shards that a task gets on average, and at most of a single shard on either side of its grid of cells.
ROWS_EACH = 4_000_000
CELL_ROWS = 500_000


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a long) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                found = np.fromiter(map(fingerprint, byte_texts(part.column(1))), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"])

    hashed = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")
    return id_and_text(docs, hashed).mapInArrow(run, "doc_id long, text_hash long, fp long")


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z, and white space 20 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    if len(words) > SHINGLE:
        ends, starts = ends[SHINGLE - 1 :], starts[: 1 - SHINGLE]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    pairs = list(zip(starts.tolist(), ends.tolist(), strict=True))
    for k in range(0, len(pairs), 1 << 16):
        some = pairs[k : k + (1 << 16)]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in some), ">u8", len(some))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(pairs)).tobytes(), "big")


#: Bits of each level's group in a quarter's tree, for tables of any size: cells of pairs of bits hold up to two values each.
WIDTHS = (2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1)
#: Shards of a quarter's tree.
CELLS = math.prod(w + 1 for w in WIDTHS)


def shards(distinct: DataFrame, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """shard, fp and home (false: a visitor) of fingerprints at home and wherever their boundary overlaps."""
    offsets = np.cumsum([0, *widths])
    place = [math.prod(w + 1 for w in widths[g + 1 :]) for g in range(len(widths))]
    cells_of_all = math.prod(w + 1 for w in widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            apart = fp ^ np.uint64(VANTAGE)
            for quarter in range(3):
                cells, distances = np.full(len(fp), quarter * cells_of_all, np.int64), []
                for g, width in enumerate(widths):
                    bits = apart >> np.uint64(16 * quarter + offsets[g]) & np.uint64((1 << width) - 1)
                    distances.append(np.bitwise_count(bits).astype(np.int64))
                    cells += distances[-1] * place[g]
                yield _dealt(cells, fp, True)
                for g, distance in enumerate(distances):
                    upper = distance < widths[g]
                    yield _dealt(cells[upper] + place[g], fp[upper], False)

    return distinct.mapInArrow(run, "shard long, fp long, home boolean")


def _dealt(cells: np.ndarray, fp: np.ndarray, home: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), home))], ["shard", "fp", "home"])


def cells(dealt: DataFrame, most: int = CELL_ROWS) -> DataFrame:
    """cell, fp and home: a shard is one cell, or a grid of cells where it holds more than `most` rows.

    In a grid the homes are dealt over its rows and all of the shard over its columns, so that every home meets the whole
    shard, a block at a time. Shards are at most 4 * 2 ** 16, whatever the table, so their counts may be broadcast.
    """
    counted = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home"))
    large = counted.filter(F.col("n") > most).select("shard", *[F.ceil(F.col(c) / most).cast("long").alias(d) for c, d in (("n_home", "down"), ("n", "across"))])
    first = F.col("shard") * (1 << 40)
    deal = lambda parts, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(parts))
    cell = lambda row, column, home: F.struct((first + row * (1 << 20) + column).alias("cell"), home.alias("home"))
    upto = lambda parts: F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)
    none = F.array().cast("array<struct<cell:bigint,home:boolean>>")
    as_home = F.when(F.col("home"), F.transform(upto("across"), lambda k: cell(deal("down", 1), k, F.lit(True)))).otherwise(none)
    as_other = F.transform(upto("down"), lambda k: cell(k, deal("across", 2), F.lit(False)))
    alone = F.array(cell(F.lit(0), F.lit(0), F.col("home")))
    marked = dealt.join(F.broadcast(large), "shard", "left")
    return marked.select("fp", F.explode(F.when(F.col("down").isNull(), alone).otherwise(F.concat(as_home, as_other))).alias("c")).select("c.cell", "fp", "c.home")


def near(homes: np.ndarray, others: np.ndarray, quarters: Sequence[int] = (0, 1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within RADIUS of a home and another home or one of `others`.

    What is too much to compare outright goes through an inner tree for each of `quarters`, with a level for each bit: its
    nodes are the values of the quarter, and the boundary of one bit is its 16 neighbours.
    """
    both = np.concatenate([homes, others])
    if len(homes) * len(both) <= OUTRIGHT:
        yield from _outright(homes, both, len(homes))
        return
    flips = np.array([0, *(1 << k for k in range(16))], np.int64)
    for quarter in quarters:
        value = (homes >> np.uint64(16 * quarter) & np.uint64(0xFFFF)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        first = np.searchsorted(value[order], np.arange(65537))
        asked = (both >> np.uint64(16 * quarter) & np.uint64(0xFFFF)).astype(np.int64)
        for flip in flips.tolist():
            node = asked ^ flip
            count = first[node + 1] - first[node]
            total = np.concatenate([[0], np.cumsum(count)])
            start = 0
            while start < len(both):
                stop = max(start + 1, int(np.searchsorted(total, total[start] + OUTRIGHT, side="right")) - 1)
                n = count[start:stop]
                who = np.repeat(np.arange(start, stop), n)
                at = np.arange(len(who)) - np.repeat(total[start:stop] - total[start], n) + np.repeat(first[node[start:stop]], n)
                a, b = homes[order[at]], both[who]
                keep = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
                if keep.any():
                    yield a[keep], b[keep]
                start = stop


def _outright(some: np.ndarray, others: np.ndarray, same: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all; the first `same` of `others` are `some` themselves."""
    step = max(1, OUTRIGHT // max(1, len(others)))
    for k in range(0, len(some), step):
        a, b = np.nonzero(np.bitwise_count(some[k : k + step, None] ^ others) <= RADIUS)
        keep = (b >= same) | (b > a + k)
        if keep.any():
            yield some[a[keep] + k], others[b[keep]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value and the least value (as signed) of its component, for those that aren't it."""
    values, codes = np.unique(np.concatenate([a, b]).view(np.int64), return_inverse=True)
    left, right, label = codes[: len(a)], codes[len(a) :], np.arange(len(values))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            off = label != np.arange(len(values))
            return values[off].view(np.uint64), values[label[off]].view(np.uint64)
        label = new


def other_quarters(shard: int) -> tuple[int, ...]:
    """The quarters that a shard isn't of: a pair of it that is to be found agrees to one bit in one of them too."""
    return tuple(q for q in range(4) if q != shard // CELLS)


def links(dealt: DataFrame, partitions: int) -> DataFrame:
    """A forest of the links between different fingerprints: a (the greater) and b. Shards are those of WIDTHS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        cell, home = table["cell"].to_numpy(), table["home"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort([~home, cell])
        cell, home, fp = cell[order], home[order], fp[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
        n_home = np.add.reduceat(home.astype(np.int64), cuts[:-1])
        held, size = [], 0
        for start, end, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), n_home.tolist(), strict=True):
            if n and end - start > 1:
                for pair in near(fp[start : start + n], fp[start + n : end], other_quarters(int(cell[start]) >> 40)):
                    held.append(pair)
                    size += len(pair[0])
                    if size > HELD_LINKS:
                        held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                        size = len(held[0][0])
        if held:
            a, b = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition(partitions, "cell").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node that isn't the root, by star contractions.

    edges: a, b, in either direction. Each round's edges are written to the shared folder; the edges of hubs are dealt over
    tasks.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, total = None, edges.count()
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread(both, least.drop("n"), least.drop("m"), ["u"], 2 * total, F.col("v")).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread(large, root.drop("n"), root.drop("m"), ["a"], total, F.col("b"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.filter("a <> b").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, total = now, now["n"]


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, text_hash and fp of every row; fp with its rows n and root, the least fingerprint of its group; all rows."""
    spark = docs.sparkSession
    rows = cut(fingerprints(docs), "fingerprints")
    firsts = cut(rows.groupBy("fp").agg(F.count("*").alias("n")), "fingerprint-firsts")
    distinct, total = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * (1 + len(WIDTHS)) * distinct // ROWS_EACH))
    roots = components(links(cells(shards(firsts.select("fp"))), partitions))
    rooted = cut(firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root")), "groups")
    return rows, rooted, total


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id that links reach) of every row of `docs`."""
    rows, rooted, total = _grouped(docs)
    named = spread(rows, rooted.drop("n"), rooted.drop("root"), ["fp"], total, F.monotonically_increasing_id()).drop("text_hash")
    named = cut(named, "grouped-rows")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    found = spread(named, least.drop("n"), least.drop("component_id"), ["root"], total, F.monotonically_increasing_id())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of linked fingerprints, with the columns of `docs`, whatever their names.

    Of a group stays the row of least doc_id, rows without a doc_id only if the whole group has none; of several such rows,
    the text of least hash; of several rows of that text, the one whose columns have the least hash. Rows of one doc_id whose
    texts are in different groups stay in each.
    """
    rows, rooted, total = _grouped(docs)
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    kept = first.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("kept")).select("kept.no_id", F.coalesce("kept.doc_id", F.lit(0)).alias("id"), "kept.text_hash")
    own = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tagged = docs.select(own.isNull().alias("no_id"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"), F.struct(*docs.columns).alias("row"))
    key = ["no_id", "id", "text_hash"]
    some = tagged.join(kept, key, "left_semi")
    hashable = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(*hashable)))
    return some.withColumn("nth", nth).filter("nth = 1").select("row.*")
