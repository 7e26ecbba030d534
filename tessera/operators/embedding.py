"""A store of embeddings by content: texts are encoded once for each encoder and dimension."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts that an encoder sees at once.
TEXTS = 256
STORE = "content string, encoder string, dim int, embedding array<double>, batch string"


def digest_encoder(dim: int) -> Callable[[pd.Series], np.ndarray]:
    """The stand-in where there is no model: numbers from md5 of text and place, as `retrieval.hash_embed` has them."""

    def encode(texts: pd.Series) -> np.ndarray:
        numbers = [[int(hashlib.md5(f"{t}|{i}".encode()).hexdigest()[:8], 16) / 2147483647.5 - 1 for i in range(dim)] for t in texts]
        return np.array(numbers, np.float64).reshape(len(texts), dim)

    return encode


def store(spark: SparkSession, path: str) -> DataFrame:
    """The store at `path`; where there is none, an empty one is written first."""
    spark.createDataFrame([], STORE).write.mode("ignore").parquet(path)
    return spark.read.schema(STORE).parquet(path)


def embed_stored(df: DataFrame, text: str, path: str, encoder: Callable[[pd.Series], np.ndarray], name: str, dim: int) -> tuple[DataFrame, str]:
    """`df` with unit vectors as `embedding`, and the id of the batch that this call added to the store.

    Contents that the store lacks for this encoder and dimension are encoded, once however many rows have them, TEXTS at a time; a
    new dimension or encoder lacks them all, and leaves what is stored alone. Null texts are empty texts. If two jobs store one
    content at once, either row serves. The encoder must give rows of `dim` numbers, or else there is an error.
    """
    spark, batch_id = df.sparkSession, uuid.uuid4().hex
    content = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    mine = lambda: store(spark, path).filter((F.col("encoder") == name) & (F.col("dim") == dim))
    keyed = df.withColumn("_content", content)
    texts = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("content", F.sha2("t", 256))
    lacking = texts.join(mine().select("content"), "content", "left_anti").groupBy("content").agg(F.min("t").alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                m = np.asarray(encoder(part.column(1).to_pandas()), np.float64)
                if m.shape != (part.num_rows, dim):
                    raise ValueError(f"the encoder gave {m.shape} for {part.num_rows} texts of dimension {dim}")
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))
                same = lambda x, kind: pa.array([x] * part.num_rows, kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), same(name, pa.string()), same(dim, pa.int32()), vectors, same(batch_id, pa.string())], ["content", "encoder", "dim", "embedding", "batch"])

    lacking.mapInArrow(encode, STORE).write.mode("append").parquet(path)
    vectors = mine().groupBy("content").agg(F.first("embedding").alias("embedding"))
    return keyed.join(vectors, keyed["_content"] == vectors["content"], "left").drop("_content", "content"), batch_id


def encoded(spark: SparkSession, path: str, batch: str) -> int:
    """Contents that a call of `embed_stored` encoded."""
    return store(spark, path).filter(F.col("batch") == batch).count()


