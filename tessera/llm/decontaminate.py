"""Benchmark decontamination by the q-gram lemma.

An item of m letters and digits that occurs in a text with at most k edits shares at least (m - q + 1) - k * q of its q-grams
with the place, on diagonals (place in the text minus place in the item) within k of each other. So shared q-grams are counted
in diagonal bands that overlap by half, bands with fewer are dropped, and the rest are verified by banded alignment of the
whole item against the place. q is 8, or for an item too short for its edits the largest of 4, 2 and 1 whose bound is at least
1. Case, punctuation and white space are left out on both sides.

The benchmark is the stated query set: it is dealt by hash into blocks of at most about BLOCK bytes. Documents are read once, in
one narrow stage, a slice at a time; each slice meets all blocks. A broadcast never exceeds a block, unless one item does.

Cases: null, empty and blank texts, and items, match nothing; an item of any length matches within int(edits * letters) edits,
so the shortest match without edits only, wherever they stand; all regions of an item are reported that don't overlap; repeated
items and rows are reported each; null ids are kept; other columns are ignored; an empty table on either side gives no rows; a
text of any length is one value of one slice.
"""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, slices

#: Lengths of q-grams, in order of preference (powers of two).
QS = (8, 4, 2, 1)
#: Edits that an occurrence may have, as a share of the item's letters and digits.
EDITS = 0.08
BLOCK = 8 << 20
SLICE_BYTES = 2 << 20
PREFILTER_BITS = 22
#: More than any place of a text; its square still fits.
FAR = 1 << 31
OUT = re.compile(r"[\W_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Letters and digits of a text, in lower case."""
    return OUT.sub("", text or "").lower()


def q_grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams (q a power of two) that begin at each place."""
    h, width = points.astype(np.uint64) * MULTIPLIER, 1
    while width < q:
        h = (h[:-width] ^ h[:-width] >> np.uint64(29)) * MULTIPLIER + h[width:] if len(h) > width else h[:0]
        width *= 2
    h = h ^ h >> np.uint64(32)
    return h * MULTIPLIER


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Index:
    """The q-grams of the items that are searched with one q."""

    def __init__(self, q: int, numbers: list[int], texts: list[str], edits: list[int]):
        self.q, self.numbers = q, np.array(numbers, np.int64)
        self.least = np.array([bound(len(t), k, q) for t, k in zip(texts, edits, strict=True)], np.int64)
        self.step = np.array(edits, np.int64) + 1
        grams = [q_grams(points_of(t), q) for t in texts]
        which = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        values = np.concatenate(grams)
        order = np.argsort(values, kind="stable")
        self.which, self.place = which[order], place[order]
        self.values, self.first, self.count = np.unique(values[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << PREFILTER_BITS, bool)
        self.bits[(self.values >> np.uint64(64 - PREFILTER_BITS)).astype(np.int64)] = True

    def bands(self, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, first diagonal and width of the bands of `points` that may hold the item; bands that touch come as one."""
        grams = q_grams(points, self.q)
        at = np.flatnonzero(self.bits[(grams >> np.uint64(64 - PREFILTER_BITS)).astype(np.int64)])
        if not len(at):
            return
        hit = np.minimum(np.searchsorted(self.values, grams[at]), len(self.values) - 1)
        same = self.values[hit] == grams[at]
        at, hit = at[same], hit[same]
        counts = self.count[hit]
        owner = np.repeat(np.arange(len(at)), counts)
        entry = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.first[hit], counts)
        item = self.which[entry]
        diagonal = at[owner] - self.place[entry]
        lower = diagonal // self.step[item]
        # a band holds the diagonals of two steps; each diagonal lies in two bands
        key = np.concatenate([lower, lower - 1]) + (1 << 40) + np.concatenate([item, item]) * (1 << 42)
        key, shared = np.unique(key, return_counts=True)
        item = key >> 42
        key = key[shared >= self.least[item]]
        if not len(key):
            return
        begins = np.flatnonzero(np.concatenate([[True], np.diff(key) > 2]))
        ends = np.append(begins[1:], len(key)) - 1
        item = key[begins] >> 42
        lower, upper = (key[x] - (item << 42) - (1 << 40) for x in (begins, ends))
        step = self.step[item]
        yield from zip(self.numbers[item].tolist(), (lower * step).tolist(), ((upper - lower + 2) * step).tolist(), strict=True)


def bound(letters: int, edits: int, q: int) -> int:
    """q-grams that an item shares at least with a place that is so many edits away."""
    return letters - q + 1 - edits * q


class Items:
    """The items of a block and an index of their q-grams for each q in use: the largest whose bound says anything."""

    def __init__(self, ids: list[int | None], texts: list[str | None], edits: float):
        kept = [(i, normal(t)) for i, t in zip(ids, texts, strict=True)]
        self.kept = [(i, t) for i, t in kept if t]
        self.edits = [int(edits * len(t)) for _, t in self.kept]
        by_q: dict[int, list[int]] = {}
        for n, ((_, t), k) in enumerate(zip(self.kept, self.edits, strict=True)):
            by_q.setdefault(next(q for q in QS if bound(len(t), k, q) > 0), []).append(n)
        self.indexes = [Index(q, ns, [self.kept[n][1] for n in ns], [self.edits[n] for n in ns]) for q, ns in sorted(by_q.items())]


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, edits: int) -> list[tuple[int, int, int]]:
    """Edits, start and end of the parts of `text`, one for each end, that `item` is within `edits` of.

    Banded alignment on the diagonals first .. first + width: column j of row i is the place first + i + j of the text. A cell
    is one number, edits * FAR - start, so that the least has the fewest edits and, of these, the latest start.
    """
    m, columns = len(item), np.arange(width + 1)
    places = first + columns
    cell = np.where((places >= 0) & (places <= len(text)), -places, FAR * FAR)
    padded = np.concatenate([np.full(max(0, -first), -1, np.int64), text.astype(np.int64), np.full(max(0, first + m + width - len(text)) + 1, -1, np.int64)])
    shift = max(0, -first) + first
    for i in range(m):
        across = cell + FAR * (padded[shift + i : shift + i + width + 1] != item[i])
        down = np.append(cell[1:] + FAR, FAR * FAR)
        # places of the text passed over: a running minimum along the row
        cell = np.minimum.accumulate(np.minimum(across, down) - FAR * columns) + FAR * columns
        ends = places + i + 1
        cell = np.where((ends >= 0) & (ends <= len(text)), cell, FAR * FAR)
    cost = -(-cell // FAR)
    good = np.flatnonzero(cost <= edits)
    return list(zip(cost[good].tolist(), (cost[good] * FAR - cell[good]).tolist(), (first + m + good).tolist(), strict=True))


def exact(whole: str, text: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """Occurrences without edits, overlapping ones too."""
    at = text.find(whole, low, high)
    while at >= 0:
        yield 0, at, at + len(whole)
        at = text.find(whole, at + 1, high)


def apart(candidates: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Regions that don't overlap: those with the fewest edits first, then from left to right."""
    starts: list[int] = []
    out: list[tuple[int, int, int]] = []
    for found in sorted(candidates, key=lambda c: (c[0], c[2], -c[1])):
        i = bisect.bisect_left(starts, found[1])
        if (i == 0 or out[i - 1][2] <= found[1]) and (i == len(out) or found[2] <= starts[i]):
            starts.insert(i, found[1])
            out.insert(i, found)
    return out


def regions(whole: str, text: str, bands: list[tuple[int, int]], edits: int) -> list[tuple[int, int, int]]:
    """Edits, start and end of the places of `text`, on the diagonals of `bands`, that hold `whole`.

    Where an exact occurrence stands, no other candidate of a narrow band matters unless exact occurrences overlap.
    """
    item = points_of(whole)
    for narrow in (True, False):
        candidates, plain = set(), set()
        for first, width in bands:
            first, width = first - edits, width + 2 * edits
            low, high = max(0, first), max(0, min(len(text), first + width + len(whole)))
            some = list(exact(whole, text, low, high))
            plain.update(some)
            if not edits or some and narrow and width + edits <= len(whole) // 2:
                candidates.update(some)
            else:
                candidates.update((c, a + low, b + low) for c, a, b in align(item, points_of(text[low:high]), first - low, width, edits))
        chosen = apart(list(candidates))
        if not edits or not plain - set(chosen):
            break
    return chosen


def positions(text: str) -> np.ndarray:
    """For each letter of the normal form, its place in `text`."""
    kept = [(i, len(c.lower())) for i, c in enumerate(text) if not OUT.match(c)]
    return np.repeat([i for i, _ in kept], [n for _, n in kept]).astype(np.int64)


def find(items: Items, plain: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """For each text in normal form, the item number, edits and range of each verified region, by item and place."""
    joined = points_of("\0".join(plain))  # no q-gram of an item holds the separator
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    starts = np.cumsum(lengths + 1) - lengths - 1
    asked: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for index in items.indexes:
        for item, diagonal, width in index.bands(joined):
            m, k = len(items.kept[item][1]), items.edits[item]
            a = int(np.searchsorted(starts, max(0, diagonal - k), side="right")) - 1
            b = int(np.searchsorted(starts, diagonal + width + m + k, side="left"))
            for n in range(max(0, a), b):
                low = diagonal - int(starts[n])
                if low - k <= len(plain[n]) and low + width + k + m >= 0:
                    asked.setdefault((n, item), []).append((low, width))
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in plain]
    for (n, item), bands in sorted(asked.items()):
        chosen = regions(items.kept[item][1], plain[n], bands, items.edits[item])
        found[n] += ((item, *r) for r in chosen)
    return found


REGION = "doc_id long, item_id long, start long, length long, edits long"


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, start and length (characters of the text) and edits of every region that holds a benchmark item.

    Regions of one item in a text don't overlap: those of fewest edits come first, then those that end first.
    """
    sent = _blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _held(batches, "text"):
            texts = _texts(part, 1)
            plain = [normal(t) for t in texts]
            keys, rows, places = part.column(0).to_pylist(), [], {}
            for items in _each_block(sent, edits):
                for n, found in enumerate(find(items, plain)):
                    for item, cost, start, end in found:
                        if n not in places:
                            places[n] = positions(texts[n])
                        a, b = int(places[n][start]), int(places[n][end - 1]) + 1
                        rows.append((keys[n], items.kept[item][0], a, b - a, cost))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in REGION.split(", ")])

    return id_and_text(docs).mapInArrow(run, REGION)


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Distinct doc_id of documents that hold a benchmark item."""
    return contaminated_regions(docs, benchmark, edits).select("doc_id").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of `docs` whose texts hold no benchmark item, with the columns of `docs`, in one narrow stage."""
    place, sent = docs.columns.index("text"), _blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _held(batches, "text"):
            plain = [normal(t) for t in _texts(part, place)]
            clean = np.ones(part.num_rows, bool)
            for items in _each_block(sent, edits):
                clean &= [not f for f in find(items, plain)]
            yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def _blocks(benchmark: DataFrame) -> list[tuple[str, Broadcast]]:
    """The ids and texts of the benchmark, a broadcast and a name for each block."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-int(size) // BLOCK))
    out = []
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == block).collect()
        out.append((uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))))
    return out


#: The index of the block that a Python worker asked last, by the block's name and the share of edits.
_LAST: dict[tuple[str, float], Items] = {}


def _each_block(sent: list[tuple[str, Broadcast]], edits: float) -> Iterator[Items]:
    for name, block in sent:
        if (name, edits) not in _LAST:
            _LAST.clear()
            _LAST[name, edits] = Items(*block.value, edits)
        yield _LAST[name, edits]


def _held(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, SLICE_BYTES)


def _texts(part: pa.RecordBatch, place: int) -> list[str]:
    return [x or "" for x in part.column(place).cast(pa.string()).to_pylist()]
