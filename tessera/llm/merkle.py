"""Merkle manifest of a dataset: a tree of digests for each language, one root over all of them, and a proof for each document.

Every document is a leaf: the SHA-256 of its fields, each as its UTF-8 length, a colon and the value, or a dash if it is null.
The leaves of a language stand in the order of doc_id (nulls first; rows of one doc_id by their leaves). While a tree has more
than one node, runs of FAN nodes become the digest of their concatenation. The languages' roots, null first and then bytewise,
are the leaves of one more tree.

Places come from a range partitioning by (language, doc_id, leaf, row) that is written once, and from running sums over one row
for each partition and language; no language is sorted in one task, and repeated rows are spread like others. Trees are built
bottom up: a superblock of FAN ** DEPTH consecutive nodes is one group, whose digests up to its top stay inside its task, and only the top
is a node of the next round. Proofs come top down: each superblock gets one row with the nodes that it needs from outside, and
leaves and outer nodes are cogrouped by superblock, where local reduction, proof and fold are finished together.

Cases: a null text or other field is a dash and differs from an empty one; the null language is a tree of its own; a text of any
length is one value of one row and never leaves the JVM; ties and repeated rows are leaves of their own with interchangeable
places; a document whose language has no other is its own subroot; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions_for

FAN = 8
#: Levels that a superblock reduces by itself, and the nodes that it has at most.
DEPTH = 4
#: Bytes of leaf rows in a range partition.
RANGE_BYTES = 64 << 20
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: dict[str, Column]) -> Column:
    """Digest of the fields in their order."""
    return F.sha2(F.concat(*[field(c) for c in fields.values()]), 256)


def leaves(docs: DataFrame, found: Column | None = None) -> DataFrame:
    """tree, doc_id, leaf and found: the leaf of the text as it is found now (`found`, by default unchanged)."""
    fields = {name: F.col(name).cast(kind) for name, kind in FIELDS.items()}
    leaf = leaf_of(fields)
    now = leaf if found is None else F.when(found.eqNullSafe(fields["text"]), leaf).otherwise(leaf_of(fields | {"text": found}))
    tree = F.coalesce(F.concat(F.lit("1"), fields["lang"]), F.lit("0"))
    return docs.select(tree.alias("tree"), fields["doc_id"].alias("doc_id"), leaf.alias("leaf"), now.alias("found"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with i, the place in their tree by `order` (nulls first), and n, the size of the tree."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "row")]
    dealt = rows.repartitionByRange(partitions_for(rows, RANGE_BYTES), *keys).sortWithinPartitions(*keys)
    # The place in a partition is the lower 33 bits of the increasing id.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("part"), place.alias("place")).drop("row"), "merkle-placed")
    runs = dealt.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return dealt.join(runs, ["tree", "part"]).withColumn("i", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def reduced(nodes: list[str], n: int, depth: int) -> list[list[str]]:
    """Levels of a superblock, lowest first, up to its top: `nodes` are consecutive in a tree of `n`."""
    levels = [nodes]
    while n > 1 and len(levels) <= depth:
        levels.append([digest(levels[-1][k : k + FAN]) for k in range(0, len(levels[-1]), FAN)])
        n = -(-n // FAN)
    return levels


def path_of(levels: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """Own position in the run, and the run, for each level below the top."""
    path = []
    for level in levels[:-1]:
        first = i // FAN * FAN
        path.append((i - first, level[first : first + FAN]))
        i //= FAN
    return path


def _tops(depth: int):
    def tops(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        n, width = int(group["n"].iat[0]), FAN**depth
        top = reduced(group["node"].tolist(), n, depth)[-1][0]
        return pd.DataFrame({"tree": [group["tree"].iat[0]], "i": [int(group["i"].iat[0]) // width], "n": [-(-n // width)], "node": [top]})

    return tops


def block(depth: int) -> Column:
    return F.expr(f"i div {FAN**depth}")


def rounds(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """tree, i, n, node of the given nodes, then of the tops of their superblocks, until each tree is one node."""
    out = [nodes.select("tree", "i", "n", "node")]
    n = out[0].agg(F.max("n")).first()[0] or 0
    while n > 1:
        tops = out[-1].withColumn("block", block(depth)).groupBy("tree", "block").applyInPandas(_tops(depth), "tree string, i long, n long, node string")
        out.append(cut(tops, "merkle-tops"))
        n = -(-n // FAN**depth)
    return out


OUTER = "path array<struct<at: int, run: array<string>>>, subroot string"


def _inner_paths(depth: int):
    def paths_of(members: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("i")
        levels = reduced(members["node"].tolist(), int(members["n"].iat[0]), depth)
        above = [(int(p["at"]), list(p["run"])) for p in outer["path"].iat[0]]
        paths = [[{"at": at, "run": list(run)} for at, run in path_of(levels, k) + above] for k in range(len(members))]
        out = pd.DataFrame({"tree": members["tree"].to_numpy(), "block": members["i"].to_numpy(), "node": members["node"].to_numpy()})
        return out.assign(path=paths, subroot=outer["subroot"].iat[0])

    return paths_of


def descend(nodes: DataFrame, outer: DataFrame, depth: int) -> DataFrame:
    """tree, block, node, path, subroot: for each node its path up to the root, first inside its superblock and then as `outer` has
    it; a node is the top of a superblock beneath (`block`), which needs just this from outside."""
    sides = nodes.withColumn("block", block(depth)).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return cut(sides.applyInPandas(_inner_paths(depth), f"tree string, block long, node string, {OUTER}"), "merkle-outer")


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """Root that `leaf` leads to in the place of the path's own nodes."""
    for at, run in path:
        leaf = digest([*run[:at], leaf, *run[at + 1 :]])
    return leaf


def _finish(root: str, depth: int):
    def finish(members: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("i")
        leaf = members["leaf"].tolist()
        levels = reduced(leaf, int(members["n"].iat[0]), depth)
        above = [(int(p["at"]), list(p["run"])) for p in outer["path"].iat[0]]
        proofs, folded = [], []
        for k, found in enumerate(members["found"].tolist()):
            path = path_of(levels, k) + above
            proofs.append(digest([x for at, run in path for j, x in enumerate(run) if j != at]))
            folded.append(fold(found, path))
        out = members[["doc_id"]].reset_index(drop=True).assign(leaf=leaf, subroot=outer["subroot"].iat[0], root=root)
        return out.assign(proof_sha256=proofs, folded_root=folded, verified=[f == root for f in folded])

    return finish


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, found: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """RESULT for each document; folded_root and verified are of the text as `found` gives it, all else of the text in `docs`.

    depth: levels of a superblock; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    own = cut(placed(leaves(docs, found), ["doc_id", "leaf"]), "merkle-leaves")
    lower = rounds(own.withColumnRenamed("leaf", "node"), depth)
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node")
    top_leaves = cut(placed(subroots, ["lang"]), "merkle-subroots")
    upper = rounds(top_leaves, depth)
    last = upper[-1].first()
    if last is None:
        return spark.createDataFrame([], RESULT)
    outer = spark.createDataFrame([("", 0, [], None)], f"tree string, block long, {OUTER}")
    for nodes in reversed(upper):
        outer = descend(nodes, outer, depth)
    # The superblocks above a language's own nodes are that language's place among the subroots.
    outer = outer.withColumnRenamed("block", "i").join(top_leaves.select("i", "lang"), "i")
    outer = outer.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"))
    for nodes in reversed(lower[1:]):
        outer = descend(nodes, outer, depth).drop("node")
    sides = own.withColumn("block", block(depth)).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return sides.applyInPandas(_finish(last["node"], depth), RESULT)


def lower_cased(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(every: int = 3) -> Column:
    """The text, in lower case where `every` divides the CRC-32 of the decimal doc_id; a null doc_id is never tampered with."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0, F.lit(False))
    text = F.col("text").cast("string")
    return F.when(hit, lower_cased(text)).otherwise(text)
