"""Encoders against the libraries, token files by round trip."""

import base64
import glob
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, pretokens, token_counts, token_files

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CHARS = [chr(c) for c in (32, 32, 9, 10, 13, 11, 12, 28, 29, 0x85, 0xA0, 0x2003, 0x3000, 97, 98, 99, 39, 115, 48, 49, 0x660, 0x4E2D, 0x1F600, 0x301, 65, 0xDF, 0x130, 0x3A3, 46, 1, 0x200B, 0x2028)]


def texts():
    r = random.Random(0)
    odd = ["", " ", "a" * 3000, "ab" * 700, "x<|endoftext|>y <|startoftext|> <|endoftext|>", "é" * 200, "it's we'll I'D", "\x01 \x01a \x01"]
    return odd + ["".join(r.choice(CHARS) for _ in range(r.randint(0, 40))) for _ in range(500)]


def rows(spark):
    data = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "null id", "x"), (3, None, "x"), (3, "twice", "x"), (3, "twice", "x")]
    return data, spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(3)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_librarys(spark):
    data, df = rows(spark)
    lib = library()
    got = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in byte_bpe.encode_documents(df, RANKS, P.PATTERN).collect())
    want = []
    for k, t, _ in data:
        ids = lib.encode_ordinary(t or "")
        want.append((str(k), len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()))
    assert got == sorted(want)


def test_segment_tree_takes_the_leftmost_least_rank():
    lib, ref = byte_bpe.encoder(RANKS, P.PATTERN).bpe, library()
    r = random.Random(2)
    words = [bytes(r.choice(b"theandiog ") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 31, 63, 64, 65, 200, 1000)]
    for word, ids in zip(words, lib.encode(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref._encode_single_piece(word)


def test_counts_are_the_librarys(spark):
    data, df = rows(spark)
    lib = Tokenizer.from_file(WORDS)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(df, WORDS, limit=20).collect())
    counts = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t, _ in data]
    assert got == sorted((str(k), len((t or "").encode()), n, n > 20) for (k, t, _), n in zip(data, counts, strict=True))


def test_token_file_round_trip(spark, tmp_path):
    data, df = rows(spark)
    lib = Tokenizer.from_file(WORDS)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_file(df, WORDS, path)
    blocks = token_files.read_token_file(spark, path)
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, np.array(lib.encode(r[1] or "", add_special_tokens=False).ids, "<u2").tobytes()))
    start, want = 0, []
    for k, t, _ in order:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, start, ids))
        start += len(ids)
    got = [(r["doc_id"], r["start"], list(r["ids"])) for r in token_files.document_tokens(blocks).orderBy("start").collect()]
    assert got == want
    whole = [x for _, _, ids in want for x in ids]
    places = [0, 1, 7, len(whole) // 2, len(whole) - 1, len(whole), -1, 7]
    asked = spark.createDataFrame([(p,) for p in places] + [(None,)], "place long")
    assert sorted(map(tuple, token_files.tokens_at(blocks, asked).collect())) == sorted({(p, whole[p]) for p in places if 0 <= p < len(whole)})
    assert all(r["middle_id"] == r["ids"][r["n_tokens"] // 2] for r in token_files.document_tokens(blocks).collect())
    sums = {(r["start"], r["ids_crc32"]) for r in token_files.document_checksums(blocks).collect()}
    assert sums == {(s, zlib.crc32(np.array(i, "<u4").tobytes())) for _, s, i in want}


def test_files_in_order_of_name_are_in_order_of_doc_id(spark, tmp_path):
    df = spark.range(400).select(((F.col("id") * 7) % 400).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text")).repartition(5)
    token_files.write_token_file(df, WORDS, f"file://{tmp_path}/tokens")
    parts, last = [], -1
    for file in sorted(glob.glob(f"{tmp_path}/tokens/part-*.parquet")):
        table = pq.read_table(file)
        parts.append(set(table["part"].to_pylist()))
        for keys in table["doc_ids"].to_pylist():
            found = np.frombuffer(keys, "<i8").tolist()
            assert found == sorted(found) and (not found or found[0] > last)
            last = max([last, *found])
    assert all(len(p) == 1 for p in parts if p) and [min(p) for p in parts if p] == sorted(min(p) for p in parts if p) and len(parts) > 2


def test_any_token_without_its_block():
    r = random.Random(4)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = np.array([r.choice([0, 255, 256, 65535, 65536, 2**32 - 1, r.randrange(49408)]) for _ in range(n)], np.uint32)
        block = token_files.Block(token_files.encode_block(ids))
        assert len(block) == n and (block.ids() == ids).all()
        assert all(block[i] == ids[i] for i in range(0, n, 7))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digest_documents(none, RANKS, P.PATTERN).count() == 0 and token_counts.token_counts(none, WORDS).count() == 0
    token_files.write_token_file(none, WORDS, f"file://{tmp_path}/none")
    assert token_files.document_tokens(token_files.read_token_file(spark, f"file://{tmp_path}/none")).count() == 0


def test_memos_may_overflow_and_keep_nothing_long(monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO_ENTRIES", 5)
    lib, counts, ref = pretokens.PretokenEncoder(WORDS), pretokens.PretokenEncoder(WORDS, pretokens.Counts), Tokenizer.from_file(WORDS)
    for t in ("one two three four", "five six seven eight nine", "one two", "x" * 5000 + " one", "Don't WON'T it's 'S 's 'll. a1b22,c", "<|endoftext|> a<|endoftext|>b <| |>"):
        ids = ref.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(lib.encode([t.encode()])[0], "<u4").tolist() == ids and counts.encode([t.encode()]) == [len(ids)]
        for memo in (lib.memo, counts.memo):
            assert all(len(k) <= pretokens.LONG for k in memo.new)


def test_texts_are_cut_before_they_are_told_apart():
    """Ids are the library's for every text; of Latin texts, words that differ in case or marks are kept once."""
    lib, ref = pretokens.PretokenEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = ["Don't 'rest' x's9 we'LL -'s ''s '' O'Brien's 12,5 kg (\"A-B\")", "ÀÉ straße ÿ×÷", "é H̱ İ ≠", "a\xa0b\x85c d \x1c x", "<|endoftext|>a <| startoftext|>", "’s “q” 中文 ſ Σ", "\x01 a\x01b", "q" * 700, " \t\n", "", None, "end "]
    got = lib.encode_column(pa.array(texts))
    assert got == [np.array(ref.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert lib.encode_column(pa.array(texts).slice(1, 3)) == got[1:4] and lib.encode_column(pa.array([], pa.string())) == []
    lib = pretokens.PretokenEncoder(WORDS)
    lib.encode_column(pa.array(["Word word, WORD. (word)"]))
    assert set(lib.memo.new) == {b"word", b",", b".", b"(", b")"}
