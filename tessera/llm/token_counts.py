"""Token counts: pieces are counted once per distinct pre-token and summed by per-document pre-token frequencies.

`token_counts` is one narrow stage. In each block of documents the frequencies of each document's pre-tokens are taken, the
distinct pre-tokens that the worker's memo of counts lacks are counted once by the library, and frequencies and counts are
joined and summed; neither a document's ids nor a kept pre-token's are ever put together. The frequencies stay inside the
task: as shuffled rows (document, pre-token, frequency) they are about five times the input, far beyond the disk that the
count is worth.

Cases: null or empty text has 0 bytes and 0 tokens; a null doc_id is kept; repeated rows are counted each; other columns
are ignored, whatever their names; an empty table gives no rows. A text of any length is one value of one block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, slices
from tessera.llm.pretokens import Counts, byte_texts, encoder

#: Tokens that a training sample can hold.
LIMIT = 2048
BLOCK_BYTES = 4 << 20


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_pretokens and over_limit (n_tokens > limit) of every text of `docs`.

    vocabulary: path of a tokenizers .json whose tokens never cross white space; every executor has it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(vocabulary, Counts)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts = byte_texts(part.column(1))
                frequencies = [Counter(t.split()) for t in texts]
                count_of = lib.known(set().union(*frequencies)).__getitem__
                tokens = [sum(map(mul, map(count_of, f), f.values())) for f in frequencies]
                columns = [pa.array(list(map(len, texts)), pa.int64()), pa.array(tokens, pa.int64()), pa.array([f.total() for f in frequencies], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_tokens", "n_pretokens"])

    counted = id_and_text(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_pretokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
