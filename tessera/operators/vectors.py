"""Exact nearest vectors: an index of cells whose radii bound the cosine, and search within sessions as a grid of blocks.

Vectors and queries are both rows that Spark deals; none of them passes through the driver. The index assigns every vector to the
nearest of at most MOST_CELLS centroids, which come from a bounded sample, and packs a cell in blocks of at most BLOCK rows. A query
first asks the cells around it, which gives its k-th score so far; by the triangle inequality of angles, a cell at angle t from the
query whose members lie within angle r of the centroid holds no cosine above cos(t - r), so cells below the k-th score are skipped.
All others are asked, whatever their number: results are those of a comparison with every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.routing import ranked
from tessera.sources.shared import written

#: Rows of a block of vectors or queries.
BLOCK = 4096
#: Centroids, and vectors that they are fitted on, at most; rounds of fitting.
MOST_CELLS = 4096
SAMPLE = 50_000
ROUNDS = 6
#: Slack of the angular bound for rounding.
SLACK = 1e-6
DIGITS = 9


def unit(column: pa.Array) -> np.ndarray:
    """Rows of unit length from an array column; rows of zeros stay."""
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def best(scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row; ties by name."""
    return np.lexsort([np.broadcast_to(names, scores.shape), -scores], axis=1)[:, :k]


def centroids(vectors: DataFrame, key: str, vector: str) -> np.ndarray:
    """Unit centroids, about the square root of the number of vectors, from a sample in the order of hashed keys."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow()
    if not n:
        return np.zeros((0, 0))
    m = unit(pa.chunked_array(sample.column(0)).combine_chunks())
    cells = max(1, min(MOST_CELLS, int(n**0.5), len(m)))
    out = m[np.linspace(0, len(m) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        nearest = (m @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), out)
    return out


def _assigned(df: DataFrame, key: str, vector: str, centers: np.ndarray) -> DataFrame:
    """key, vector and cell: the nearest centroid; angle: to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = unit(batch.column(1)) @ centers.T
                cell = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cell", "angle"])

    kinds = dict(df.dtypes)
    return df.select(key, vector).mapInArrow(run, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, cell int, angle double")


def _blocks(assigned: DataFrame, sizes: DataFrame, key: str, vector: str) -> DataFrame:
    """cell, names and rows (unit vectors on end, as bytes): blocks of about BLOCK rows, hot cells dealt over several."""
    pieces = sizes.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("pieces"))
    dealt = assigned.join(F.broadcast(pieces), "cell").withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int"))

    def pack(group: pa.Table) -> pa.Table:
        m = unit(group.column(vector).combine_chunks())
        return pa.table({"cell": group.column("cell").slice(0, 1), "names": pa.array([group.column(key).to_pylist()], pa.list_(group.schema.field(key).type)), "rows": pa.array([m.tobytes()], pa.binary())})

    kind = dict(assigned.dtypes)[key]
    return dealt.select("cell", "piece", key, vector).groupBy("cell", "piece").applyInArrow(pack, f"cell int, names array<{kind}>, rows binary")


@dataclass
class Index:
    """centers: unit centroids; sizes: rows and radius by cell; blocks: cell, names, rows, in the shared folder; kind: type of a name."""

    centers: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    blocks: DataFrame
    kind: str


def build(vectors: DataFrame, key: str = "pid", vector: str = "embedding") -> Index:
    """The index of all rows with a vector; at most MOST_CELLS rows of sizes come to the driver."""
    pool = vectors.filter(F.col(vector).isNotNull()).select(key, vector)
    kind = dict(pool.dtypes)[key]
    centers = centroids(pool, key, vector)
    if not len(centers):
        return Index(centers, np.zeros(0), np.zeros(0), pool.sparkSession.createDataFrame([], f"cell int, names array<{kind}>, rows binary"), kind)
    assigned = written(_assigned(pool, key, vector, centers), "vector-cells")
    sizes = written(assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")), "vector-sizes")
    found = sizes.toPandas()
    n, radii = np.zeros(len(centers), np.int64), np.zeros(len(centers))
    n[found["cell"]], radii[found["cell"]] = found["n"], found["radius"]
    return Index(centers, n, radii, written(_blocks(assigned, sizes, key, vector), "vector-blocks"), kind)


def _targets(index: Index, k: int, first: bool):
    """What gives each block of queries the cells that it asks: at `first` the nearest that hold k rows, and then those that the bound
    of any of its queries lets through, without the former. bounds: for each cell, the least angle that its members can have."""
    centers, sizes, radii = index.centers, index.sizes, index.radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"cell": [], "block": [], "asked": []}
            for block, rows, kth in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), batch.column("kth").to_pylist(), strict=True):
                q = np.frombuffer(rows).reshape(-1, centers.shape[1])
                angles = np.arccos(np.clip(q @ centers.T, -1, 1))
                order = np.argsort(angles, axis=1, kind="stable")
                enough = np.cumsum(sizes[order], axis=1) - sizes[order] < k
                own = np.zeros_like(enough)
                np.put_along_axis(own, order, enough, axis=1)
                wanted = own if first else ~own & (np.cos(np.maximum(0, angles - radii - SLACK)) >= np.array(kth)[:, None] - SLACK)
                wanted &= sizes > 0
                for cell in np.flatnonzero(wanted.any(axis=0)):
                    out["cell"].append(int(cell))
                    out["block"].append(block)
                    out["asked"].append(np.flatnonzero(wanted[:, cell]).astype(np.int32).tolist())
            yield pa.RecordBatch.from_pydict({"cell": pa.array(out["cell"], pa.int32()), "block": pa.array(out["block"], pa.int64()), "asked": pa.array(out["asked"], pa.list_(pa.int32()))})

    return run


def _compared(index: Index, k: int, qid: str, key: str, qkind: pa.DataType):
    """Multiplies the asked queries of a block with a block of vectors, and keeps k of each."""
    width = index.centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names = batch.column("names")[row].values
                asked = batch.column("asked")[row].values.to_numpy()
                q = np.frombuffer(batch.column("qrows")[row].as_py()).reshape(-1, width)[asked]
                m = np.frombuffer(batch.column("rows")[row].as_py()).reshape(-1, width)
                ids = batch.column("qids")[row].values.take(pa.array(asked))
                rank = np.argsort(np.argsort(names.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                scores = np.round(q @ m.T, DIGITS)
                order = best(scores, rank, k)
                at = np.repeat(np.arange(len(scores)), order.shape[1])
                compared = np.where(np.arange(len(at)) % order.shape[1] == 0, len(m), 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), names.take(pa.array(order.ravel())), pa.array(scores[at, order.ravel()]), pa.array(compared)], [qid, key, "score", "compared"])

    return run


def search(index: Index, queries: DataFrame, k: int, key: str = "pid", qid: str = "qid", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(qid, key, score, rank) of the k nearest by cosine, ties by key; and (qid, compared): vectors that each query was compared with.

    Queries with a null vector are left out; repeated queries are answered each time under their qid, once in the result.
    """
    spark, kinds = queries.sparkSession, dict(queries.dtypes)
    asked = queries.filter(F.col(vector).isNotNull()).select(qid, vector).dropDuplicates([qid])
    schema = f"`{qid}` {kinds[qid]}, `{key}` {index.kind}, score double, compared long"
    if not len(index.centers):
        none = spark.createDataFrame([], schema)
        return none.select(qid, key, "score", F.lit(1).alias("rank")), none.select(qid, "compared")
    assigned = written(_assigned(asked, qid, vector, index.centers), "query-cells")
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"))
    blocks = _blocks(assigned, sizes, qid, vector).select(F.col("names").alias("qids"), F.col("rows").alias("qrows"), F.monotonically_increasing_id().alias("block"))
    blocks = written(blocks, "query-blocks")
    plain = blocks.select("block", F.col("qrows").alias("rows"), F.array().cast("array<double>").alias("kth"))

    def compare(targets: DataFrame) -> DataFrame:
        pairs = targets.join(blocks, "block").join(index.blocks, "cell").select("qids", "qrows", "asked", "names", "rows")
        return written(pairs.mapInArrow(_compared(index, k, qid, key, None), schema), "query-scores")

    pair = "cell int, block long, asked array<int>"
    near = compare(plain.mapInArrow(_targets(index, k, True), pair))
    top = ranked(near, [qid], "score", key, k)
    # Fewer than k rows so far: there are no others.
    reached = top.groupBy(qid).agg(F.min("score").alias("low"), F.count("*").alias("n")).select(F.col(qid).alias("q"), F.when(F.col("n") == k, F.col("low")).otherwise(-2.0).alias("low"))
    places = blocks.select("block", F.posexplode("qids").alias("at", "q")).join(reached, "q")
    kth = places.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "low"))), lambda s: s["low"]).alias("kth"))
    far = compare(blocks.join(kth, "block").select("block", F.col("qrows").alias("rows"), "kth").mapInArrow(_targets(index, k, False), pair))
    both = near.unionByName(far)
    return ranked(both.drop("compared"), [qid], "score", key, k), both.groupBy(qid).agg(F.sum("compared").alias("compared"))


def session_grid(memories: DataFrame, queries: DataFrame, k: int, session: str = "session_id", key: str = "memory_id", qid: str = "qid", vector: str = "embedding") -> DataFrame:
    """(session, qid, key, score, rank): the k memories of a query's session by cosine; ties by key.

    A session is a grid of (block of queries, block of memories): a session that holds a third of all rows is as many cells as its
    size asks for, and every cell gives k rows of each query. Cells are dealt to buckets of about BLOCK memories; small sessions share
    a bucket. No row is made for a pair.
    """
    m = memories.filter(F.col(vector).isNotNull() & F.col(session).isNotNull()).select(session, key, vector)
    q = queries.filter(F.col(vector).isNotNull() & F.col(session).isNotNull()).select(session, qid, vector)
    kinds = dict(m.dtypes) | dict(q.dtypes)
    pieces = lambda df, name: df.groupBy(session).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select(session, F.ceil(F.col("n") / BLOCK).cast("int").alias(name))
    # Only sessions of more than BLOCK rows have a row here: a share of 1 / BLOCK of all rows at most.
    large = written(pieces(m, "ms").join(pieces(q, "qs"), session, "full"), "large-sessions")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    part = lambda name, c: F.pmod(F.xxhash64(name), one(c)).cast("int")
    copies = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    # Both sides may come from one table: new names keep their columns apart.
    named = [F.col(session).alias("_session"), F.col(vector).alias("_vector")]
    m = m.join(large, session, "left").select(*named, F.col(key).alias("_m"), part(key, "ms").alias("mp"), copies("qs").alias("qp"))
    q = q.join(large, session, "left").select(*named, F.col(qid).alias("_q"), part(qid, "qs").alias("qp"), copies("ms").alias("mp"))
    buckets = max(int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-memories.count() // BLOCK))
    bucket = F.pmod(F.xxhash64("_session", "mp", "qp"), F.lit(buckets))
    schema = f"`{session}` {kinds[session]}, `{qid}` {kinds[qid]}, `{key}` {kinds[key]}, score double"

    def cells(table: pa.Table) -> dict[tuple, np.ndarray]:
        keys = list(zip(*(table.column(c).to_pylist() for c in ("_session", "mp", "qp")), strict=True))
        found: dict[tuple, list[int]] = {}
        for i, cell in enumerate(keys):
            found.setdefault(cell, []).append(i)
        return {cell: np.array(rows) for cell, rows in found.items()}

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        # The sides are queries and memories; a side may lack rows.
        out: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            theirs, a, b = cells(right), unit(left.column("_vector").combine_chunks()), unit(right.column("_vector").combine_chunks())
            names = right.column("_m").combine_chunks()
            rank = np.argsort(np.argsort(names.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            for cell, rows in cells(left).items():
                others = theirs.get(cell)
                if others is None:
                    continue
                scores = np.round(a[rows] @ b[others].T, 6)
                order = best(scores, rank[others], k)
                at = np.repeat(np.arange(len(rows)), order.shape[1])
                columns = [left.column(c).take(pa.array(rows[at])) for c in ("_session", "_q")]
                out.append(pa.table([*columns, names.take(pa.array(others[order.ravel()])), pa.array(scores[at, order.ravel()])], [session, qid, key, "score"]))
        return pa.concat_tables(out) if out else pa.table([left.column("_session").slice(0, 0), left.column("_q").slice(0, 0), right.column("_m").slice(0, 0), pa.array([], pa.float64())], [session, qid, key, "score"])

    found = q.withColumn("bucket", bucket).groupBy("bucket").cogroup(m.withColumn("bucket", bucket).groupBy("bucket")).applyInArrow(near, schema)
    return ranked(found, [qid], "score", key, k)
