"""SimHash fingerprints and components against all pairs."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from tessera.llm import common, simhash


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, fp string").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=repr)
    fps = [brute(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (k, _), r in zip(rows, root, strict=True):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    assert got == sorted(((k, f"{f:016x}", least.get(r)) for (k, _), f, r in zip(rows, fps, root, strict=True)), key=repr)


def test_near_copies_chains_and_edges(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 9)}" for _ in range(80)) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(30):
        words = r.choice(base).split()
        words[r.randrange(80)] = f"v{i % 4}"
        rows.append((100 - i, " ".join(words)))
    rows += [(None, base[0]), (7, None), (8, ""), (9, " \t\n"), (10, "One TWO"), (11, "one two"), (11, "one two"), (12, "a b c d")]
    check(spark, rows)


def all_pairs(fps, others=()):
    both = {*map(int, fps), *map(int, others)}
    return {frozenset((int(x), y)) for x in fps for y in both if x != y and (int(x) ^ y).bit_count() <= 4}


def crowd(seed):
    r = np.random.default_rng(seed)
    center = r.integers(0, 1 << 63, 4, dtype=np.uint64)
    return np.unique(np.concatenate([c ^ sum((np.uint64(1) << r.integers(0, 64, 60, dtype=np.uint64) for _ in range(2)), np.uint64(0)) for c in center]))


def test_near_finds_all_pairs_with_and_without_inner_trees(monkeypatch):
    fps = crowd(3)
    for most in (200, 10**7):
        monkeypatch.setattr(simhash, "OUTRIGHT", most)
        for homes, others in ((fps, fps[:0]), (fps[:100], fps[100:])):
            got = {frozenset(map(int, p)) for a, b in simhash.near(homes, others) for p in zip(a, b, strict=True)}
            assert got == all_pairs(homes, others)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_shards_bring_every_near_pair_together(spark):
    r = random.Random(1)
    a = [r.getrandbits(64) for _ in range(40)]
    b = [x ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 4))) for x in a]
    df = spark.createDataFrame([(signed(v),) for v in a + b], "fp long")
    for widths in (simhash.WIDTHS, (2,) * 8, (1,) * 16):
        homes, visits = {}, {}
        for row in simhash.shards(df, widths).collect():
            (homes if row["home"] else visits).setdefault(row["fp"], set()).add(row["shard"])
        for x, y in zip(map(signed, a), map(signed, b), strict=True):
            assert homes[x] & (homes[y] | visits.get(y, set())) or homes[y] & visits.get(x, set())


def test_a_large_shard_is_not_compared_pair_by_pair(monkeypatch):
    """Homes of one shard share their own quarter; the inner trees are those of the others, which find every pair."""
    r = np.random.default_rng(7)
    assert sum(simhash.WIDTHS) == 16
    for quarter in (0, 1, 2):
        own = np.uint64(0xFFFF << 16 * quarter)
        fps = r.integers(0, 1 << 63, 4000, dtype=np.uint64) & ~own
        fps[2000:] = fps[:2000]
        for _ in range(4):
            fps[2000:] ^= np.uint64(1) << r.integers(0, 64, 2000, dtype=np.uint64)
        fps[2000:] = fps[2000:] & ~own | np.where(r.random(2000) < 0.3, np.uint64(1 << 16 * quarter), np.uint64(0))
        compared = []
        count = np.bitwise_count
        monkeypatch.setattr(simhash, "OUTRIGHT", 10_000)
        monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(x.size), count(x))[1])
        others = simhash.other_quarters(quarter * simhash.CELLS + 5)
        found = {frozenset((int(x), int(y))) for a, b in simhash.near(fps, fps[:0], others) for x, y in zip(a, b, strict=True)}
        monkeypatch.undo()
        assert quarter not in others and sum(compared) < 4000 * 4000 / 50
        assert found == {p for p in all_pairs(fps.tolist(), fps.tolist()) if len(p) == 2}


def test_a_large_shard_is_a_grid_that_loses_no_pair(spark):
    fps = crowd(8)
    dealt = spark.createDataFrame([(5, signed(int(v)), k % 3 > 0) for k, v in enumerate(fps)] + [(6, 1, True), (6, 2, False)], "shard long, fp long, home boolean")
    found = simhash.cells(dealt, most=40)
    assert found.select("cell").distinct().count() > 10 and found.filter(f"cell = {6 << 40}").count() == 2
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(found, 4).collect()]
    assert groups(links) == groups(tuple(p) for p in all_pairs([v for k, v in enumerate(fps) if k % 3], fps) | {frozenset((1, 2))})


def groups(pairs):
    root = {}
    for a, b in pairs:
        x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
        if x is not y:
            x |= y
            root.update(dict.fromkeys(y, x))
    return {frozenset(g) for g in root.values()}


def test_components_of_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_HOT", 3)
    r = random.Random(4)
    edges = [(0, k) for k in range(1, 300)] + [(1000, 1000 + k) for k in range(1, 150)] + [(2000 + k, 2001 + k) for k in range(40)] + [(r.randrange(3000, 3100), r.randrange(3000, 3100)) for _ in range(70)] + [(1010, 5)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {n: min(g) for g in groups((a, b) for a, b in edges if a != b) for n in g}
    assert {(x["node"], x["root"]) for x in got} == {(n, m) for n, m in want.items() if n != m} and len(got) == len({x["node"] for x in got})


def test_keep_one_keeps_one_of_each_group(spark):
    same, other, third = "same text of five words", "quite another one than that", "and now for a third"
    rows = [
        (5, same, "a"), (3, same, "b"), (3, same, "b"), (3, same, "c"), (9, other, None), (None, same, "d"),
        (7, other, "unlike rows of one id"), (7, third, "x"), (3, "a b c d e f", "y"),
        (None, "only null ids here", "p"), (None, "only null ids here", "q"), (None, "Only NULL ids here", "r"), (4, None, "s"), (2, "", "t"),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, nth string, _row_id int, row int, fp int").repartition(3)
    got = simhash.keep_one(df)
    kept = [(r["doc_id"], (r["text"] or "").lower(), r["nth"]) for r in got.collect()]
    assert got.columns == df.columns and len(kept) == 6 and all((k, x) in {(a, (b or "").lower()) for a, b, _ in rows} for k, x, _ in kept)
    assert sorted((k, x) for k, x, _ in kept if k is not None) == sorted([(2, ""), (3, "a b c d e f"), (3, same), (7, third), (7, other)])
    assert [x for k, x, _ in kept if k is None] == ["only null ids here"]
    assert simhash.keep_one(df.limit(0)).count() == 0 and sorted(kept, key=repr) == sorted(((r["doc_id"], (r["text"] or "").lower(), r["nth"]) for r in simhash.keep_one(df.repartition(7)).collect()), key=repr)
