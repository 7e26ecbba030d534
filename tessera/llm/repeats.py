"""Suffix-array deduplication: maximal repeats across documents from common-prefix interval trees.

Every string of LENGTH = 50 bytes holds an anchor: a place whose 20-byte gram has the least hash among the 31 grams of the
string. Anchors depend on the bytes alone, so all occurrences of a repeated string share one, and suffixes need to meet only
where their anchors agree. A sparse suffix array is built over the anchors in four steps that shuffle packed arrays:

1. each task reduces its anchors to (hash, document bucket) pairs; by hash, those found in two documents or more are kept;
2. beside the kept anchors each document bucket cuts their contexts, 30 bytes to the left and 50 to the right, and sends each
   distinct context once, with its least doc_id;
3. for each anchor the contexts are sorted (enhanced suffix array: order and longest common prefixes), a stack scan lists the
   common-prefix intervals, and inside each interval a second scan over the left contexts tells where left extensions differ:
   a group of suffixes that no byte extends on both sides is a maximal repeat. Its least doc_id goes back to every member;
4. each document bucket marks the occurrences of repeats that a smaller doc_id holds too.

There is a task for each bucket, so tasks stay as they are while the table grows.

A hot anchor, found in more than HOT documents, is split exactly: its suffixes are keyed by the whole 50-byte string,
one context for each bucket and string. Nothing that grows with a group's size meets in one task but one row for each bucket
of documents, and no pair of occurrences is ever listed.

Cases: null text is empty; matches never cross documents; documents of the same doc_id don't count as smaller than each other;
rows with a null doc_id keep all their bytes and take none from others; texts under 50 bytes keep all; other columns are
ignored; an empty table gives no rows. A document is one value of one task.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, packed, partitions_for, slices

LENGTH = 50
GRAM = 20
WINDOW = LENGTH - GRAM + 1
LEFT, RIGHT = LENGTH - GRAM, LENGTH
HOT = 20_000
BUCKET_BYTES = 4 << 20
SLICE_BYTES = 512 << 10
HELD_ANCHORS = 600_000
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
LOW40 = np.uint64((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * C2
    return x ^ x >> np.uint64(32)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes, at least 1, of the 20-byte grams at each place."""
    h1 = data.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * C1 + h1[1:]
    h4 = h2[:-2] * C2 + h2[2:]
    h8 = h4[:-4] * C3 + h4[4:]
    h16 = h8[:-8] * C1 + h8[8:]
    return np.maximum(_mix(h16[:-4] * C2 + h4[16:]), np.uint64(1))


def _sliding(values: np.ndarray, of) -> np.ndarray:
    """`of` (minimum or maximum) over each run of WINDOW values."""
    out, width = values, 1
    while 2 * width <= WINDOW:
        out = of(out[:-width], out[width:])
        width *= 2
    return of(out[: len(values) - WINDOW + 1], out[WINDOW - width : WINDOW - width + len(values) - WINDOW + 1])


def find_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash and document of each anchor of texts on end (`ends`: their offsets), and the least hash of each string."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint64)
    h = _gram_hashes(data)
    least = _sliding(h, np.minimum)
    crossing = np.zeros(len(least) + LENGTH, np.int32)
    inner = ends[1:-1]
    np.add.at(crossing, np.maximum(inner - LENGTH + 1, 0), 1)
    np.subtract.at(crossing, np.minimum(inner, len(crossing) - 1), 1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    pad = np.zeros(WINDOW - 1, np.uint64)
    place = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), np.maximum) == h)
    return place, h[place], np.searchsorted(ends, place, side="right") - 1, least


def _key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 bits of a hash, as one number: what anchors are matched by before their bytes are.

    Hashes of anchors are the least of their strings, so mostly small: they are mixed again, or the first buckets held most.
    """
    h = _mix(h * C3)
    bucket = (h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    return bucket << np.uint64(40) | h & LOW40


def contexts(data: np.ndarray, ends: np.ndarray, place: np.ndarray, doc: np.ndarray, left: int | np.ndarray = LEFT, right: int | np.ndarray = RIGHT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes around places as rows of LEFT (nearest first) and RIGHT bytes, zero outside; their numbers on either side."""
    begin, end = ends[doc], ends[doc + 1]
    n_left, n_right = np.minimum(left, place - begin), np.minimum(right, end - place)
    columns = np.concatenate([-1 - np.arange(LEFT), np.arange(RIGHT)])
    at = place[:, None] + columns
    inside = np.concatenate([np.arange(LEFT) < n_left[:, None], np.arange(RIGHT) < n_right[:, None]], axis=1)
    rows = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
    return rows, n_left.astype(np.uint8), n_right.astype(np.uint8)


def _context_hash(key: np.ndarray, rows: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    acc = key * C1 + n_left.astype(np.uint64) * np.uint64(256) + n_right.astype(np.uint64)
    for column in np.ascontiguousarray(rows).view("<u8").T:
        acc = _mix((acc ^ column) * C3)
    return acc


def _strings_at(least: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For hot anchors: the number of each, and how far to its left a string begins that chose it."""
    back = np.arange(LEFT + 1)
    start = place[:, None] - back
    ok = (start >= 0) & (start < len(least))
    ok &= least[np.clip(start, 0, len(least) - 1)] == h[:, None]
    return np.nonzero(ok)


# Packed arrays travel as one compressed binary column; its parts have known types.
def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=2).compress(sizes + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(packed_arrays: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed_arrays)
    out, at = [], 8 * (len(kinds) + 1)
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds) + 1)[1:].tolist(), map(np.dtype, kinds), strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def _gathered(table: pa.Table, *kinds) -> list[np.ndarray]:
    """The packed arrays of all rows, on end; the rows' `source` is repeated in front."""
    sources = table["source"].to_numpy()
    rows = [_unpack(x, *kinds) for x in table["packed"].to_pylist()]
    columns = [np.concatenate(c) if rows else np.zeros(0, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
    return [np.repeat(sources, [len(r[0]) for r in rows]), *columns]


def _rows(targets: np.ndarray, source: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each target: (target, source, the columns of its entries)."""
    order = np.argsort(targets, kind="stable")
    targets = targets[order]
    cuts = [0, *(np.flatnonzero(np.diff(targets)) + 1).tolist(), len(targets)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            some = order[a:b]
            yield pa.RecordBatch.from_arrays([pa.array([int(targets[a])], pa.int32()), pa.array([source], pa.int32()), pa.array([_pack(*(c[some] for c in columns))], pa.binary())], ["target", "source", "packed"])


PACKED = "target int, source int, packed binary"


def _as_table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("target", pa.int32()), ("source", pa.int32()), ("packed", pa.binary())])
    return pa.Table.from_batches(list(batches), schema)


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    return id_and_text(docs).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def _anchor_pairs(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1, before the shuffle: the anchors of a task as distinct (key, document bucket) with the documents that have them."""

    def send(keys: list[np.ndarray], homes: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, home, doc = map(np.concatenate, (keys, homes, docs))
        order = np.lexsort([doc, home, key])
        key, home, doc = key[order], home[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        count = np.add.reduceat(other.astype(np.int64), first).astype("<u4")
        key, home = key[first], home[first]
        # a row goes to the anchors' bucket; inside, entries of one document bucket follow each other
        order = np.lexsort([home, key >> np.uint64(40)])
        key, home, count = key[order], home[order], count[order]
        low = key & LOW40
        yield from _rows((key >> np.uint64(40)).astype(np.int64), 0, (low >> np.uint64(8)).astype("<u4"), low.astype(np.uint8), home.astype("<i4"), count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = seen = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                part = part.filter(part.column(0).is_valid())
                if not part.num_rows:
                    continue
                data, ends = packed(part.column(1))
                place, h, doc, _ = find_anchors(data, ends)
                held[0].append(_key(h, buckets))
                held[1].append(part.column(2).to_numpy()[doc])
                held[2].append(doc + seen)
                size, seen = size + len(place), seen + part.num_rows
                if size > HELD_ANCHORS:
                    yield from send(*held)
                    held, size = ([], [], []), 0
        if size:
            yield from send(*held)

    return _bucketed(docs, buckets).mapInArrow(run, PACKED)


def _repeated(pairs: DataFrame, buckets: int) -> DataFrame:
    """Step 1, after the shuffle: for each document bucket its anchors that two documents or more have, and which are hot."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["target"][0].as_py()
        _, high, low, home, count = _gathered(table, "<u4", "u1", "<i4", "<u4")
        key = high.astype(np.uint64) << np.uint64(8) | low
        order = np.argsort(key, kind="stable")
        key, home, count = key[order], home[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.repeat(np.add.reduceat(count.astype(np.int64), first), np.diff(np.append(first, len(key))))
        keep = total > 1
        key, home, hot = key[keep], home[keep], total[keep] > HOT
        order = np.lexsort([key, home])
        key, home, hot = key[order], home[order], hot[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
        return _as_table(_rows(home[new].astype(np.int64), bucket, (key[new] >> np.uint64(8)).astype("<u4"), key[new].astype(np.uint8), hot[new]))

    return pairs.repartition(buckets, "target").groupBy("target").applyInArrow(run, PACKED)


#: Key, hot anchor (or 0), context, bytes on either side, least and greatest doc_id.
ELEMENT = ("<u8", "<u8", "V80", "u1", "u1", "<i8", "<i8")


def _elements(docs: DataFrame, repeated: DataFrame, buckets: int) -> DataFrame:
    """Step 2: the distinct contexts of a document bucket, sent to their anchors' buckets."""

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        if not texts.num_rows or not flags.num_rows:
            return _as_table(iter(()))
        home = texts["bucket"][0].as_py()
        source, high, low, hot = _gathered(flags, "<u4", "u1", "?")
        wanted = source.astype(np.uint64) << np.uint64(40) | high.astype(np.uint64) << np.uint64(8) | low
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        parts = []
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "text", SLICE_BYTES):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data, ends = packed(part.column(1))
                place, h, doc, least = find_anchors(data, ends)
                key = _key(h, buckets)
                at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                found = wanted[at] == key
                plain, split = found & ~hot[at], found & hot[at]
                rows, n_left, n_right = contexts(data, ends, place[plain], doc[plain])
                parts.append((key[plain], _context_hash(key[plain], rows, n_left, n_right), key[plain], rows, n_left, n_right, ids[doc[plain]]))
                if split.any():
                    parts.append(_split_hot(data, ends, place[split], h[split], key[split], doc[split], least, ids, buckets))
        key, code, anchor, rows, n_left, n_right, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(code[order].view(np.int64)) != 0])) if len(order) else order
        ids = ids[order].astype("<i8")
        low_id, high_id = (np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)) if len(first) else (ids, ids)
        one = order[first]
        return _as_table(_rows((key[one] >> np.uint64(40)).astype(np.int64), home, key[one], np.where(anchor[one] != key[one], anchor[one], np.uint64(0)), np.ascontiguousarray(rows[one]).view("V80").ravel(), n_left[one], n_right[one], low_id, high_id))

    return _with_texts(docs, repeated, buckets, run, PACKED)


def _split_hot(data, ends, place, h, anchor, doc, least, ids, buckets) -> tuple[np.ndarray, ...]:
    """The strings of hot anchors, keyed by their own bytes; each is its anchor's context, cut to the string."""
    which, code, rows, n_left, n_right = _hot_codes(data, ends, place, h, anchor, doc, least)
    return _key(_mix(code), buckets), code, anchor[which], rows, n_left, n_right, ids[doc[which]]


def _with_texts(docs: DataFrame, other: DataFrame, buckets: int, run, schema: str) -> DataFrame:
    texts = _bucketed(docs, buckets).filter("doc_id is not null").repartition(buckets, "bucket")
    return texts.groupBy("bucket").cogroup(other.repartition(buckets, "target").groupBy("target")).applyInArrow(run, schema)


def lcp_intervals(lcps: list[int], floor: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals of at least `floor`, from the prefixes of neighbours, by a stack scan: length, first, last."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcps, -1]):
        low = i
        while stack and stack[-1][0] > v:
            length, low = stack.pop()
            yield length, low, i
        if v >= floor and (not stack or stack[-1][0] < v):
            stack.append((v, low))


def _common(a: int, b: int, width: int) -> int:
    """Leading bytes that two numbers of `width` bytes share."""
    return width - ((a ^ b).bit_length() + 7) // 8


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of at least `least` bytes through one anchor: bytes to its left, bytes from it on, and members.

    lefts: contexts to the left, nearest byte first; rights: contexts from the anchor on. The contexts differ from each other.
    """
    order = sorted(range(len(rights)), key=lambda i: (rights[i].ljust(RIGHT, b"\0"), len(rights[i])))
    right_numbers = [int.from_bytes(rights[i].ljust(RIGHT, b"\0"), "big") for i in order]
    left_numbers = [int.from_bytes(lefts[i].ljust(LEFT, b"\0"), "big") for i in order]
    n_left, n_right = [len(lefts[i]) for i in order], [len(rights[i]) for i in order]
    lcps = [min(_common(right_numbers[k], right_numbers[k + 1], RIGHT), n_right[k], n_right[k + 1]) for k in range(len(order) - 1)]
    for length, first, last in lcp_intervals(lcps, least - LEFT):
        inside = sorted(range(first, last + 1), key=lambda k: (left_numbers[k], n_left[k]))
        shared = [min(_common(left_numbers[a], left_numbers[b], LEFT), n_left[a], n_left[b]) for a, b in zip(inside, inside[1:], strict=False)]
        for extent, a, b in lcp_intervals(shared, max(0, least - length)):
            members = inside[a : b + 1]
            if min(lcps[min(members) : max(members)]) == length:  # else a deeper interval has the same members
                yield extent, length, [order[k] for k in members]


def _repeat_groups(elements: DataFrame, buckets: int) -> DataFrame:
    """Step 3: for each context its maximal repeats and their least doc_id, to the document buckets that can use them."""

    def run(table: pa.Table) -> pa.Table:
        source, key, hot, rows, n_left, n_right, low_id, high_id = _gathered(table, *ELEMENT)
        del table
        code = _context_hash(np.where(hot > 0, hot, key), rows.view(np.uint8).reshape(-1, LEFT + RIGHT), n_left, n_right)
        order = np.lexsort([code, key])
        key, code = key[order], code[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (key[1:] != key[:-1])])
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        one = order[first]
        least = np.minimum.reduceat(low_id[order], first)
        # a context is itself a repeat of the documents that hold all of it
        whole = n_left[one].astype(np.int64) + n_right[one] >= LENGTH
        out = [(np.flatnonzero(whole), n_left[one][whole], n_right[one][whole], least[whole])]
        groups = np.concatenate([[0], np.flatnonzero(key[first][1:] != key[first][:-1]) + 1, [len(first)]])
        who, left, right, owner = array("q"), array("B"), array("B"), array("q")
        several = np.flatnonzero(np.diff(groups) > 1)
        for a, b in zip(groups[several].tolist(), groups[several + 1].tolist(), strict=True):
            raw = rows[one[a:b]].tobytes()
            lefts = [raw[80 * k : 80 * k + n] for k, n in enumerate(n_left[one[a:b]].tolist())]
            rights = [raw[80 * k + LEFT : 80 * k + LEFT + n] for k, n in enumerate(n_right[one[a:b]].tolist())]
            owners = least[a:b].tolist()
            # repeats that reach no further than another of no greater doc_id add nothing to a member
            known = [[(len(x), len(y), o)] for x, y, o in zip(lefts, rights, owners, strict=True)]
            for extent, length, members in maximal_repeats(lefts, rights):
                smallest = min(owners[m] for m in members)
                for m in members:
                    if not any(x >= extent and y >= length and o <= smallest for x, y, o in known[m]):
                        known[m].append((extent, length, smallest))
                        who.append(a + m)
                        left.append(extent)
                        right.append(length)
                        owner.append(smallest)
        out.append((np.array(who, np.int64), np.array(left, np.uint8), np.array(right, np.uint8), np.array(owner, np.int64)))
        who, left, right, owner = (np.concatenate(c) for c in zip(*out, strict=True))
        # each document bucket that holds context `who` and a document after the least one
        by_who = np.argsort(who, kind="stable")
        who, left, right, owner = who[by_who], left[by_who], right[by_who], owner[by_who]
        begin, end = np.searchsorted(who, number), np.searchsorted(who, number, side="right")
        holder = np.repeat(np.arange(len(order)), end - begin)
        entry = np.arange(len(holder)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
        useful = owner[entry] < high_id[order][holder]
        holder, entry = holder[useful], entry[useful]
        return _as_table(_rows(source[order][holder].astype(np.int64), 0, code[holder], left[entry], right[entry], owner[entry].astype("<i8"), hot[order][holder]))

    return elements.repartition(buckets, "target").groupBy("target").applyInArrow(run, PACKED)


def _marked(docs: DataFrame, repeats: DataFrame, buckets: int) -> DataFrame:
    """Step 4: spans of each document that a smaller doc_id holds too, and the bytes that remain."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    names = ["doc_id", "spans", "n_bytes", "kept"]

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        _, code, left, right, owner, hot = _gathered(answers, "<u8", "u1", "u1", "<i8", "<u8")
        order = np.argsort(code, kind="stable")
        code, left, right, owner = code[order], left[order].astype(np.int64), right[order].astype(np.int64), owner[order]
        hot = np.unique(hot[hot > 0])
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "text", SLICE_BYTES):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data, ends = packed(part.column(1))
                change = np.zeros(len(data) + 1, np.int32)
                if len(code):
                    place, h, doc, least = find_anchors(data, ends)
                    key = _key(h, buckets)
                    rows, n_left, n_right = contexts(data, ends, place, doc)
                    _mark(change, place, ids[doc], _context_hash(key, rows, n_left, n_right), code, left, right, owner)
                    split = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
                    if split.any():
                        which, own, *_ = _hot_codes(data, ends, place[split], h[split], key[split], doc[split], least)
                        _mark(change, place[split][which], ids[doc[split][which]], own, code, left, right, owner)
                gone = np.cumsum(change[:-1]) > 0
                out.append(_spans(part, ids, data, ends, gone, span, names))
        schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("n_bytes", pa.int64()), ("kept", pa.binary())])
        return pa.Table.from_batches(out, schema)

    return _with_texts(docs, repeats, buckets, run, "doc_id long, spans array<struct<start:int,end:int>>, n_bytes long, kept binary")


def _hot_codes(data, ends, place, h, anchor, doc, least) -> tuple[np.ndarray, ...]:
    """Number of the anchor and code of each string that chose a hot anchor, and the string around the anchor."""
    which, back = _strings_at(least, place, h)
    rows, n_left, n_right = contexts(data, ends, place[which], doc[which], back, LENGTH - back)
    return which, _context_hash(anchor[which], rows, n_left, n_right), rows, n_left, n_right


def _mark(change, place, ids, own, code, left, right, owner) -> None:
    """Add the repeats of occurrences to a difference array of bytes."""
    begin, end = np.searchsorted(code, own), np.searchsorted(code, own, side="right")
    n = end - begin
    which = np.repeat(np.arange(len(own)), n)
    entry = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    earlier = owner[entry] < ids[which]
    which, entry = which[earlier], entry[earlier]
    np.add.at(change, place[which] - left[entry], 1)
    np.subtract.at(change, place[which] + right[entry], 1)


def _spans(part, ids, data, ends, gone, span, names) -> pa.RecordBatch:
    edge = np.zeros(len(gone) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[ends] = True  # spans end with their documents
    cuts = np.flatnonzero(edge)
    starts = cuts[:-1][gone[cuts[:-1]]] if len(gone) else cuts[:0]
    stops = cuts[np.searchsorted(cuts, starts, side="right")] if len(starts) else starts
    doc = np.searchsorted(ends, starts, side="right") - 1
    number = np.bincount(doc, minlength=len(ids))
    flat = pa.StructArray.from_arrays([pa.array((starts - ends[doc]).astype(np.int32)), pa.array((stops - ends[doc]).astype(np.int32))], fields=list(span))
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32)), flat)
    remains = np.concatenate([[0], np.cumsum(~gone)])[ends]
    kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(remains.astype(np.int64).tobytes()), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([part.column(0), spans, pa.array(np.diff(ends).astype(np.int64)), kept], names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, spans (start, end: bytes that 50-byte strings shared with a smaller doc_id cover), n_bytes and kept (binary).

    docs: doc_id and text; the documents are shuffled once, by bucket, for both steps that need them.
    """
    buckets = partitions_for(docs, BUCKET_BYTES)
    repeated = _repeated(_anchor_pairs(docs, buckets), buckets)
    repeats = _repeat_groups(_elements(docs, repeated, buckets), buckets)
    unnamed = id_and_text(docs).filter("doc_id is null")
    rest = unnamed.select("doc_id", F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("kept"))
    return _marked(docs, repeats, buckets).unionByName(rest)
