"""Byte-level BPE: a segment tree over byte positions gives the leftmost minimum pair rank, and each merge makes
logarithmic point updates on its live neighbours.

The leaves of the tree are byte positions; a leaf's key is (rank of the pair that starts there) * width + position, so the
root's minimum is the leftmost pair of least rank. A merge at position p, whose right neighbour is q: q dies (its leaf goes
to infinity), p takes the merged id, and the leaves of p and of p's left neighbour get the ranks of their new pairs. Short
pre-tokens are merged many at a time, one tree in each row of an array; long ones have a tree of their own.

Texts are cut into chunks (white space and the word after it) which the split pattern never crosses, and each distinct
chunk is encoded once for a worker, in a memo of bounded size.

Cases: null and empty text give no ids; a null doc_id is kept; repeated rows are encoded each; other columns are ignored;
an empty table gives no rows; one pre-token of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import Recent, id_and_text, slices

#: The characters of `\\s` in the split pattern's dialect (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Entries of a generation of either memo.
MEMO_ENTRIES = 150_000
BLOCK_BYTES = 4 << 20
#: Pre-tokens of up to so many bytes share arrays of trees.
SHORT = 64
NEVER = np.int64(1) << 62


class SegmentTreeBPE:
    """ids of pre-tokens under ranks of byte strings; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.count = max(ranks.values()) + 1
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    pairs[a * self.count + b] = rank
        self.pairs = pairs
        order = np.array(sorted(pairs), np.int64)
        self.slots = 1 << max(4, (4 * len(order)).bit_length())
        self.keys, self.values = self._hashed(order, np.array([pairs[k] for k in order.tolist()], np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - (self.slots.bit_length() - 1))).astype(np.int64)

    def _hashed(self, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing with linear steps; `self.steps` is the longest search."""
        table, held = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        slot, left, self.steps = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            at = slot[left] % self.slots
            free = table[at] < 0
            _, first = np.unique(np.where(free, at, -1 - left), return_index=True)
            put = first[free[first]]
            table[at[put]], held[at[put]] = keys[left[put]], values[left[put]]
            slot[left] += 1
            left = np.delete(left, put)
            self.steps += 1
        return table, held

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NEVER where a pair doesn't merge, or an id is negative."""
        want = left * self.count + right
        at, found = self._slot(want), np.full(len(want), NEVER)
        for _ in range(self.steps):
            at %= self.slots
            hit = (self.keys[at] == want) & (left >= 0) & (right >= 0)
            found[hit] = self.values[at[hit]]
            at += 1
        return found

    def _merge_rows(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Merges of pre-tokens of at most `width` bytes (a power of two), a tree in each row."""
        rows = len(words)
        lens = np.fromiter(map(len, words), np.int64, rows)
        ids = np.full((rows, width), -1, np.int64)
        inside = np.arange(width) < lens[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(inside, np.arange(1, width + 1), width)
        after[np.arange(rows), lens - 1] = width
        before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
        tree = np.full((rows, 2 * width), NEVER)
        r, p = np.nonzero(inside[:, 1:])
        ranked = self.rank(ids[r, p], ids[r, p + 1])
        tree[r, width + p] = np.where(ranked == NEVER, NEVER, ranked * width + p)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(row: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
            node = leaf + width
            tree[row, node] = key
            while width > 1 and node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def renew(row: np.ndarray, leaf: np.ndarray) -> None:
            follow = after[row, leaf]
            ranked = self.rank(ids[row, leaf], np.where(follow < width, ids[row, follow % width], -1))
            put(row, leaf, np.where(ranked == NEVER, NEVER, ranked * width + leaf))

        live = np.flatnonzero(tree[:, 1] < NEVER)
        while len(live):
            rank, at = np.divmod(tree[live, 1], width)
            gone = after[live, at]
            follow = after[live, gone]
            ids[live, at], ids[live, gone], after[live, at] = rank, -1, follow
            has = follow < width
            before[live[has], follow[has]] = at[has]
            put(live, gone, np.full(len(live), NEVER))
            renew(live, at)
            has = at > 0
            if has.any():
                renew(live[has], before[live[has], at[has]])
            live = live[tree[live, 1] < NEVER]
        kept = ids >= 0
        return np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long pre-token, on lists."""
        n, pairs, count = len(word), self.pairs, self.count
        width = 1 << (n - 1).bit_length()
        never = int(NEVER)
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [never] * (2 * width)
        for p in range(n - 1):
            ranked = pairs.get(ids[p] * count + ids[p + 1])
            if ranked is not None:
                tree[width + p] = ranked * width + p
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, key: int) -> None:
            node = leaf + width
            tree[node] = key
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        def renew(leaf: int) -> None:
            follow = after[leaf]
            ranked = pairs.get(ids[leaf] * count + ids[follow]) if follow < n else None
            put(leaf, never if ranked is None else ranked * width + leaf)

        while tree[1] < never:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            follow = after[gone]
            ids[at], ids[gone], after[at] = rank, -1, follow
            if follow < n:
                before[follow] = at
            put(gone, never)
            renew(at)
            if before[at] >= 0:
                renew(before[at])
        return np.array([i for i in ids if i >= 0], np.int64)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif w:
                by_width.setdefault(1 << (len(w) - 1).bit_length() if len(w) <= SHORT else 0, []).append(i)
        for width, rows in by_width.items():
            for k in range(0, len(rows), 8192):
                some = rows[k : k + 8192]
                made = self._merge_rows([words[i] for i in some], width) if width else [self._merge_long(words[i]) for i in some]
                for i, ids in zip(some, made, strict=True):
                    out[i] = ids.astype("<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class ChunkEncoder:
    """Encodes texts by distinct chunk and, below that, by distinct pre-token."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            self.bpe = SegmentTreeBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})
        self.split = regex.compile(pattern).findall
        self.chunks, self.pieces = Recent(MEMO_ENTRIES), Recent(MEMO_ENTRIES)

    def learn(self, chunks: set[str]) -> None:
        missing = self.chunks.missing(chunks)
        if not missing:
            return
        cut = [[x.encode() for x in self.split(c)] for c in missing]
        new = self.pieces.missing({x for xs in cut for x in xs})
        self.pieces.new.update(zip(new, self.bpe.encode(new), strict=True))
        get = self.pieces.new.__getitem__
        self.chunks.new.update((c, b"".join(map(get, xs))) for c, xs in zip(missing, cut, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [CHUNK.findall(t) for t in texts]
        self.learn(set().union(*split))
        get = self.chunks.new.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, pattern: str) -> ChunkEncoder:
    """One encoder for a Python worker, rank file and split pattern."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ChunkEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of every text.

    ranks: path of a rank file, pattern: the split before the merges; as the tiktoken library encodes without special
    tokens. One narrow stage without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                ids = lib.encode([x or "" for x in part.column(1).to_pylist()])
                decoded = [lib.bpe.decode(x) for x in ids]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: `encode_documents` with digests in place of the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                ids = lib.encode([x or "" for x in part.column(1).to_pylist()])
                hashed = [hashlib.sha256(x).hexdigest() for x in ids]
                decoded = [hashlib.sha256(lib.bpe.decode(x)).hexdigest() for x in ids]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(hashed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
