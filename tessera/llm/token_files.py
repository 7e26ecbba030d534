"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every id, level k the next chunk of those ids that go
on, and a bitmap beside each level says which do. The position of an id in the next level is the number of set bits before
it, which a directory of counts (one for each 512 bits) and the bits since give: any token is read in as many steps as it
has chunks, without decoding a block.

A token file is a table: `part` and `block` in ascending doc_id order, the block's documents and their lengths, the place of
its first token in the part, and `codes`, the block's image. Parts are the range partitions of doc_id; the tokens before a
part are summed from one number for each part, so no task sees more than its own part.

Cases: null or empty text has only the end id; a null doc_id comes first; documents of one doc_id follow each other in the
order of their ids; other columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, partitions_for, slices
from tessera.llm.pretokens import encoder

BLOCK_BYTES = 4 << 20
PART_BYTES = 64 << 20
#: Bits that one entry of a rank directory covers.
STEP = 512
MAGIC = b"DAC1"


def encode_block(ids: np.ndarray) -> bytes:
    """The image of a block: magic, count, levels; for each level its size, chunks, bitmap and directory."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STEP // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, STEP // 8).sum(1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(np.uint32(len(rest)).tobytes() + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return MAGIC + np.array([len(ids), len(levels)], "<u4").tobytes() + b"".join(levels)


class Block:
    """A block's image, addressable by position."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token block")
        self.count, levels = np.frombuffer(image, "<u4", 2, 4).tolist()
        self.levels, at = [], 12
        for _ in range(levels):
            n = int(np.frombuffer(image, "<u4", 1, at)[0])
            width = -(-n // STEP) * (STEP // 8)
            chunks = np.frombuffer(image, np.uint8, n, at + 4)
            bits = np.frombuffer(image, np.uint8, width, at + 4 + n)
            entries = width // (STEP // 8) + 1
            # the directory may begin at any byte, so it is viewed through its bytes
            directory = np.frombuffer(image[at + 4 + n + width : at + 4 + n + width + 4 * entries], "<u4")
            self.levels.append((chunks, bits, directory))
            at += 4 + n + width + 4 * entries

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        """Token i by rank, without the tokens around it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            first = i // STEP * (STEP // 8)
            before = int(np.bitwise_count(bits[first:byte]).sum()) + (int(bits[byte]) & ((1 << bit) - 1)).bit_count()
            i = int(directory[i // STEP]) + before
        return value

    def ids(self) -> np.ndarray:
        """All tokens, level by level."""
        out = np.zeros(self.count, np.uint32)
        where = np.arange(self.count)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


FILE_SCHEMA = "part int, block int, first_token long, n_tokens long, doc_ids binary, has_id binary, lengths binary, codes binary"


def _narrow(ids: np.ndarray) -> bytes:
    width = 4 if len(ids) and ids.max() > 0xFFFF else 2
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _wide(narrow: bytes) -> np.ndarray:
    return np.frombuffer(narrow, f"<u{narrow[0]}", offset=1).astype("<u4")


def part_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """The least doc_id of each of at most `parts` ranges of about as many rows: one number a part reaches the driver."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
    least = ids.repartitionByRange(parts, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("least"))
    return np.array(sorted(r["least"] for r in least.select("least").collect()), np.int64)


def encoded(docs: DataFrame, vocabulary: str, bounds: np.ndarray) -> DataFrame:
    """part (by `bounds`), doc_id and ids of every text: a byte that says how wide ids are, and little-endian unsigned integers."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(vocabulary)
        for batch in batches:
            for some in slices(batch, "text", BLOCK_BYTES):
                ids = [_narrow(np.frombuffer(x, "<u4")) for x in lib.encode_column(some.column(1))]
                keys = some.column(0)
                part = np.searchsorted(sent.value, keys.fill_null(0).to_numpy(), side="right") - 1
                part = np.where(keys.is_valid().to_numpy(zero_copy_only=False), np.maximum(part, 0), 0)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), keys, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "part int, doc_id long, ids binary")


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """The blocks of a token file: every text's ids and `end_id`, in ascending doc_id order.

    Texts are encoded where they are; only ids are dealt by ranges of doc_id and sorted. A part is one task and one file, and files
    in the order of their names are in that of doc_id.
    """
    n = partitions_for(docs, PART_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, last, block, first = np.array([end_id], "<u4"), None, 0, 0
        for batch in batches:
            for some in slices(batch, "ids", BLOCK_BYTES):
                parts = some.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if parts[a] != last:
                        last, block, first = int(parts[a]), 0, 0
                    ids = [np.append(_wide(x), end) for x in some.column(2).slice(a, b - a).to_pylist()]
                    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
                    keys = some.column(1).slice(a, b - a)
                    row = [last, block, first, int(lengths.sum()), keys.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(keys.is_valid().to_numpy(zero_copy_only=False)).tobytes(), lengths.astype("<i8").tobytes(), encode_block(np.concatenate(ids))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], [c.split()[0] for c in FILE_SCHEMA.split(", ")])
                    block, first = block + 1, first + row[3]

    return encoded(docs, vocabulary, part_bounds(docs, n)).repartitionById(n, "part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(run, FILE_SCHEMA)


def write_token_file(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Write the blocks of `docs` under `path`; Spark's committer makes the write whole or absent."""
    token_blocks(docs, vocabulary, end_id).write.option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)


def read_token_file(spark, path: str) -> DataFrame:
    """The blocks under `path` with `start`, the place of a block's first token in the whole file.

    The totals of parts, one row for each file part, are the only rows that meet in one place.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("first_token")).drop("before")


def document_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, middle_id and ids (array) of each document of a token file."""
    return _documents(blocks, "ids array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))


def document_checksums(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, middle_id and ids_crc32 of each document of a token file."""
    return _documents(blocks, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _documents(blocks: DataFrame, column: str, value, kind: pa.DataType) -> DataFrame:
    """middle_id: the id at place n_tokens // 2 of the document, read by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i8")
                keys = np.frombuffer(row["doc_ids"], "<i8")
                valid = np.unpackbits(np.frombuffer(row["has_id"], np.uint8), count=len(keys)).astype(bool)
                ends = np.cumsum(lengths)
                block = Block(row["codes"])
                ids = block.ids()
                middle = [block[i] for i in (ends - lengths + lengths // 2).tolist()]
                values = [value(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64(), mask=~valid), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(middle, pa.int64()), pa.array(values, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "middle_id", column.split()[0]])

    return blocks.select("start", "doc_ids", "has_id", "lengths", "codes").mapInArrow(run, f"doc_id long, start long, n_tokens long, middle_id long, {column}")


def tokens_at(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """place and id of each distinct `place` (counted over the whole file) that the file has, without decoding the blocks."""
    stride = 1 << 20
    where = blocks.select("part", "block", "start", "n_tokens").withColumn("stride", F.explode(F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("start") + F.col("n_tokens") - 1) / stride))))
    asked = places.select(F.col("place").cast("long").alias("place")).filter("place >= 0").distinct().withColumn("stride", F.floor(F.col("place") / stride))
    found = asked.join(where, "stride").filter("place >= start and place < start + n_tokens")
    by_block = found.groupBy("part", "block").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, start = Block(row["codes"]), row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(row["places"], pa.int64()), pa.array([block[p - start] for p in row["places"]], pa.int64())], ["place", "id"])

    return blocks.select("part", "block", "start", "codes").join(by_block, ["part", "block"]).select("start", "codes", "places").mapInArrow(run, "place long, id long")
