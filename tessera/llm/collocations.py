"""Collocations: phrases whose words stand together more often than their parts explain, by language.

Counting is done by HAT-tries, one for each language of a task: a shallow trie over word ids above hash containers. A container
of more than BURST entries bursts at a word. When a task holds more than MOST_ENTRIES entries, whole subtrees, largest first, are
spilled as runs sorted by words. Runs are dealt by hashed prefixes, and each task merges those of its prefix partitions; what
follows a pair of words is dealt over NEIGHBOURS partitions, so that no prefix is one task's. A phrase has one row for each spill
at most; texts are never shuffled.

A phrase is at most as frequent as its parts, so phrases of k words are counted only where both parts of k - 1 words may reach
`least`, as a bit array of FILTER_BITS bits says (no frequent phrase is missed; a full array would only let more phrases be
counted). That array is the one thing broadcast. Scores are exact: 38-digit decimals and integral division.

Cases: a null text is empty; a null language is `und`, together with rows whose lang is that word; empty texts, and texts
without words, add nothing; a text of any length is counted in blocks of about BLOCK_BYTES that end with a piece; ties of score go by
frequency, then by phrase; repeated rows count each time; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, packed, partitions_for, spread

#: Between the pieces of a text, and between the words of a piece (fixed values).
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
UNKNOWN_LANG = "und"

BURST = 65_536
MOST_ENTRIES = 750_000
#: Words of a task that have an id; beyond it all tries are spilled and ids start anew.
MOST_WORDS = 300_000
STEP = 500_000
BLOCK_BYTES = 4 << 20
#: A power of two.
FILTER_BITS = 1 << 27
#: Bytes of texts whose runs one prefix partition merges.
PART_BYTES = 16 << 20
#: Groups of a language's candidates that are ranked before the language is.
RANK_GROUPS = 64

_MAP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS + BLANKS, b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
_END = b"\n"
#: Ids of words take so many bits: MOST_WORDS and STEP together fit.
_ID_BITS = 21
_ID_MASK = (1 << _ID_BITS) - 1


def words_of(raw: bytes) -> pa.LargeBinaryArray:
    """Words of texts that stand on end with a piece's end between them, in order, and _END for each end of a piece."""
    data = np.frombuffer(raw.translate(_MAP), np.uint8)
    data = np.append(data, np.uint8(10))
    end, blank = data == 10, data == 32
    after = np.append(True, (end | blank)[:-1])
    starts = (after | end)[~blank]
    data = data[~blank]
    offsets = np.append(np.flatnonzero(starts), len(data)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\n" + word)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of each row of word hashes, by place."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    mask = np.uint64(FILTER_BITS - 1)
    return (hashes & mask).astype(np.int64), (hashes * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32) & mask).astype(np.int64)


class HatTrie:
    """Counts of phrases of word ids, packed into one integer each, in hash containers under a shallow trie.

    A container owns a range of first words (hybrid), or of second words after one first word (pure); unused places of a phrase
    are 0, which is no word's id. A container of more than BURST entries bursts in two at a word, near its middle; one that is
    down to a single pair of words stays. `starts` are the least keys of the containers' ranges, ascending.
    """

    def __init__(self):
        self.starts: list[int] = [0]
        self.containers: list[Counter] = [Counter()]
        self.entries = 0

    def add(self, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        bounds = [*np.searchsorted(keys, self.starts).tolist(), len(keys)]
        full = []
        for k, container in enumerate(self.containers):
            if bounds[k] < bounds[k + 1]:
                before = len(container)
                container.update(keys[bounds[k] : bounds[k + 1]].tolist())
                self.entries += len(container) - before
                if len(container) > BURST:
                    full.append(k)
        for k in reversed(full):
            self._burst(k)

    def _burst(self, k: int) -> None:
        container = self.containers[k]
        keys = np.fromiter(container.keys(), np.int64, len(container))
        counts = np.fromiter(container.values(), np.int64, len(container))
        middle = int(np.partition(keys, len(keys) // 2)[len(keys) // 2])
        for bits in (2 * _ID_BITS, _ID_BITS):  # at a first word, or else at a second one
            for at in (middle >> bits << bits, (middle >> bits) + 1 << bits):
                right = keys >= at
                if 0 < right.sum() < len(keys):
                    self.starts.insert(k + 1, at)
                    halves = [Counter(dict(zip(keys[side].tolist(), counts[side].tolist(), strict=True))) for side in (~right, right)]
                    self.containers[k : k + 1] = halves
                    for half in (k + 1, k):
                        if len(self.containers[half]) > BURST:
                            self._burst(half)
                    return

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of whole containers, largest first, taken out until at most `most` entries are left."""
        keys, counts = [], []
        for k in sorted(range(len(self.containers)), key=lambda k: len(self.containers[k]), reverse=True):
            if self.entries <= most:
                break
            container, self.containers[k] = self.containers[k], Counter()
            self.entries -= len(container)
            keys.append(np.fromiter(container.keys(), np.int64, len(container)))
            counts.append(np.fromiter(container.values(), np.int64, len(container)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *keys]), np.concatenate([none, *counts])


#: Rows of runs: the prefix partition, language and phrase as one key, and occurrences. An empty phrase counts all words.
RUN = "part int, key string, n long"
_RUN = pa.schema([("part", pa.int32()), ("key", pa.string()), ("n", pa.int64())])
#: Partitions next to each other over which the third words after a pair are dealt.
NEIGHBOURS = 16


class _Ids(dict):
    """Ids of words, given when a word is first asked for; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})
        self.words: list[bytes] = [_END]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        return found


class Counting:
    """Counts phrases of `lengths` words over a task's texts; what it holds is bounded by MOST_ENTRIES and MOST_WORDS."""

    def __init__(self, lengths: tuple[int, ...], allowed: np.ndarray | None):
        self.lengths, self.allowed = lengths, allowed
        self._reset()

    def _reset(self) -> None:
        self.ids = _Ids()
        self.words = self.ids.words
        self.hashes: dict[str, np.ndarray] = {}
        self.tries: dict[str, HatTrie] = {}
        self.totals: Counter = Counter()

    def _hashes(self, lang: str) -> np.ndarray:
        known = self.hashes.get(lang, np.zeros(0, np.uint64))
        new = np.array([word_hash(lang, w) for w in self.words[len(known) :]], np.uint64)
        self.hashes[lang] = np.concatenate([known, new])
        return self.hashes[lang]

    def block(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Adds all phrases of `texts`, in steps of STEP words that look ahead for the phrases that start in them."""
        words = words_of(_END.join(texts))
        for first in range(0, len(words), STEP):
            self._add(lang, words.slice(first, STEP + max(self.lengths) - 1), min(STEP, len(words) - first))
            if len(self.words) > MOST_WORDS:
                yield from self.flush()
            elif sum(t.entries for t in self.tries.values()) > MOST_ENTRIES:
                yield from self._spill(MOST_ENTRIES // 2)

    def _add(self, lang: str, words: pa.LargeBinaryArray, n: int) -> None:
        distinct = words.dictionary_encode()
        ids = np.array([self.ids[w] for w in distinct.dictionary.to_pylist()], np.int64)
        x = ids[distinct.indices.to_numpy()]
        x = np.r_[x, np.zeros(max(self.lengths), np.int64)]
        trie = self.tries.setdefault(lang, HatTrie())
        for k in self.lengths:
            inside = np.ones(n, bool)
            for j in range(k):
                inside &= x[j : j + n] > 0
            at = np.flatnonzero(inside)
            if k == 1:
                self.totals[lang] += len(at)
            if k > 2 and self.allowed is not None and len(at):
                at = at[self._passes(lang, x, at, k)]
            keys = np.zeros(len(at), np.int64)
            for j in range(3):
                keys = keys << _ID_BITS | (x[at + j] if j < k else 0)
            trie.add(keys)

    def _passes(self, lang: str, x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        hashes, ok = self._hashes(lang)[x], np.ones(len(at), bool)
        for first in (0, 1):
            for bit in bits_of(mixed([hashes[at + first + j] for j in range(k - 1)])):
                ok &= (self.allowed[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return ok

    def _spill(self, most: int) -> Iterator[pa.RecordBatch]:
        """A run of each language whose subtrees go: phrases in the order of their words."""
        words = pa.array(self.words, pa.binary())
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        left = sum(t.entries for t in self.tries.values())
        for lang in sorted(self.tries, key=lambda name: self.tries[name].entries, reverse=True):
            others = left - self.tries[lang].entries
            keys, counts = self.tries[lang].take(max(0, most - others))
            left = others + self.tries[lang].entries
            places = [keys >> j * _ID_BITS & _ID_MASK for j in (2, 1, 0)]
            order = np.argsort(rank[places[0]] << 2 * _ID_BITS | np.where(places[1] > 0, rank[places[1]] + 1, 0) << _ID_BITS | np.where(places[2] > 0, rank[places[2]] + 1, 0))
            part = self._parts(lang, places)
            head = lang.encode() + b"\n"
            for k in range(0, len(order), 100_000):
                rows = order[k : k + 100_000]
                column = [pa.array(p[rows], mask=p[rows] == 0) for p in places]
                phrase = pc.binary_join_element_wise(*[words.take(c) for c in column], b" ", null_handling="skip")
                key = pc.binary_join_element_wise(pa.scalar(head), phrase, b"").cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(part[rows]), key, pa.array(counts[rows])], schema=_RUN)

    def _parts(self, lang: str, places: list[np.ndarray]) -> np.ndarray:
        """Prefix partitions: by the first two words; a third deals a pair's phrases over NEIGHBOURS of them."""
        hashes = self._hashes(lang)
        pair = mixed([hashes[places[0]], np.where(places[1] > 0, hashes[places[1]], np.uint64(0))])
        third = np.where(places[2] > 0, hashes[places[2]] % np.uint64(NEIGHBOURS), np.uint64(0))
        return ((pair + third) & np.uint64(0x7FFFFFFF)).astype(np.int32)

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self._spill(0)
        if self.totals:
            keys = [lang + "\n" for lang in self.totals]
            parts = [hash_of & 0x7FFFFFFF for hash_of in (word_hash(lang, b"") for lang in self.totals)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(keys, pa.string()), pa.array(list(self.totals.values()), pa.int64())], schema=_RUN)
        self._reset()


def _cuts(raw: bytes, most: int) -> Iterator[bytes]:
    """`raw` in parts of about `most` bytes that end with a piece. A piece longer than that stays whole."""
    first = 0
    while len(raw) - first > most:
        last = max(raw.rfind(e, first, first + most) for e in (b"\n", b".", b","))
        if last < 0:
            found = [k for e in PIECE_ENDS if (k := raw.find(bytes([e]), first + most)) >= 0]
            last = min(found, default=len(raw) - 1)
        yield raw[first : last + 1]
        first = last + 1
    yield raw[first:]


def _counter(lengths: tuple[int, ...], allowed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(lengths, None if allowed is None else allowed.value)
        waiting: dict[str, list[bytes]] = {}
        held: Counter = Counter()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            raw, ends = packed(batch.column(1))
            for k, lang in enumerate(langs):
                for part in _cuts(raw[ends[k] : ends[k + 1]].tobytes(), BLOCK_BYTES):
                    waiting.setdefault(lang, []).append(part)
                    held[lang] += len(part) + 1
                    if held[lang] > BLOCK_BYTES:
                        yield from counting.block(lang, waiting.pop(lang))
                        del held[lang]
                    elif held.total() > 4 * BLOCK_BYTES:
                        largest = max(held, key=held.get)
                        yield from counting.block(largest, waiting.pop(largest))
                        del held[largest]
        for lang, texts in waiting.items():
            yield from counting.block(lang, texts)
        yield from counting.flush()

    return run


#: Rows of runs that a task gathers before it adds them up.
GATHER = 500_000


def _merger(least: int):
    """Adds up the runs of a task's prefix partitions: what is held is the distinct phrases, and GATHER rows."""

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, rows = [], [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch.select(["key", "n"])]))
            rows += batch.num_rows
            if rows > GATHER + (sums[0].num_rows if sums else 0):
                sums, held, rows = [added([*sums, *held])], [], 0
        if not sums and not held:
            return
        whole = added([*sums, *held])
        empty = pc.ends_with(whole["key"], "\n")
        kept = whole.filter(pc.or_(empty, pc.greater_equal(whole["n"], least)))
        for batch in kept.to_batches(max_chunksize=100_000):
            both = [key.rsplit("\n", 1) for key in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in both], pa.string()), pa.array([phrase for _, phrase in both], pa.string()), batch.column(1)], names=["lang", "phrase", "n"])

    return run


def phrase_counts(texts: DataFrame, lengths: tuple[int, ...], least: int, allowed=None) -> DataFrame:
    """lang, phrase, n: phrases of `lengths` words with n >= least; those of three or more only where `allowed` lets them.

    With words among the lengths, an empty phrase has the number of all words of a language.
    """
    runs = texts.mapInArrow(_counter(lengths, allowed), RUN)
    dealt = runs.repartition(partitions_for(texts, PART_BYTES), "part")
    return dealt.mapInArrow(_merger(least), "lang string, phrase string, n long")


def _bit_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[word_hash(lang, w) for w in phrase.encode().split(b" ")] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if rows:
            bit = np.concatenate(bits_of(mixed(list(np.array(rows, np.uint64).T))))
            mask = (np.uint64(1) << (bit & 63).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(mask)], names=["slot", "mask"])


def filter_of(phrases: DataFrame) -> np.ndarray:
    """Bit array over phrases of equal length (lang, phrase): FILTER_BITS / 64 numbers at most come to the driver."""
    words = phrases.select("lang", "phrase").mapInArrow(_bit_words, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[words.column("slot").to_numpy()] = words.column("mask").to_numpy().astype(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of phrases of up to `longest` words with n >= least, and (lang, n) with all word occurrences."""
    if not 2 <= longest <= 3:
        raise ValueError("phrases have 2 or 3 words at most")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spaces = F.length("phrase") - F.length(F.translate("phrase", " ", ""))
    counted = cut(phrase_counts(texts, (1, 2), least).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(spaces + 1)), "phrase-counts")
    totals = counted.filter("k = 0").select("lang", "n")
    found = counted.filter("k > 0")
    if longest == 3:
        allowed = docs.sparkSession.sparkContext.broadcast(filter_of(found.filter("k = 2")))
        threes = phrase_counts(texts, (3,), least, allowed).withColumn("k", F.lit(3))
        found = found.unionByName(cut(threes, "phrase-threes"))
    return found, totals


def _part(words: str, first, size) -> F.Column:
    return F.array_join(F.slice(words, first, size), " ")


def _with_count(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """`rows` with the count of their phrase `part` as `name`; parts that many rows share are dealt over tasks."""
    keyed = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    many = rows.groupBy("lang", part).agg(F.count("*").alias("n"))
    return spread(rows, keyed, many, ["lang", part], rows.count(), F.struct("phrase", "k"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, covered_percent: int = 50, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut: each language's `first` phrases by the score of their worst cut.

    a, l and r: occurrences of the phrase and of its two parts; score: floor(1000000 * a * a / (l * r)); cut: words of the first part.
    Phrases that stand inside a longer candidate with at least `covered_percent` of their occurrences are left out.
    """
    found, totals = frequent_phrases(docs, longest, least)
    candidates = found.filter("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cut(cuts.select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("head"), _part("words", F.col("k") + 1, size - F.col("k")).alias("tail")), "phrase-cuts")
    scored = _with_count(cut(_with_count(cuts, found, "head", "l"), "phrase-heads"), found, "tail", "r")
    exact = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    scored = scored.select("lang", "phrase", *(c.alias(f"x{name}") for name, c in exact.items()), "a", "l", "r", "k").withColumn("score", F.expr("(1000000BD * xa * xa) div (xl * xr)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    inside = candidates.filter(size > 2).withColumn("k", F.explode(F.sequence(F.lit(2), size - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1))).select("lang", _part("words", F.col("at"), F.col("k")).alias("phrase"), F.col("a").alias("around"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = worst.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("around") < covered_percent * F.col("cut.a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score", F.col("cut.k").alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    kept = kept.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).filter(F.col("rank") <= first)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
