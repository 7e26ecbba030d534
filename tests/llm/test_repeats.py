"""Suffix-array deduplication against a set of all strings."""

import random

from tessera.llm import repeats


def brute(rows):
    """Kept bytes and spans by (doc_id, place), judged on the input."""
    owner = {}
    for key, text in rows:
        raw = (text or "").encode()
        if key is not None:
            for i in range(len(raw) - 49):
                s = raw[i : i + 50]
                owner[s] = min(owner.get(s, key), key)
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if key is not None:
            for i in range(len(raw) - 49):
                if owner[raw[i : i + 50]] < key:
                    gone[i : i + 50] = b"\1" * 50
        spans, i = [], 0
        while i < len(raw):
            j = i
            while j < len(raw) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out.append((key, len(raw), tuple(spans), bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()]
    assert sorted(got, key=repr) == brute(rows)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    pool = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(r.randint(1, 4))]
        text = "\n".join(parts)
        if r.random() < 0.5:  # a near copy
            at = r.randrange(len(text) + 1)
            text = text[:at] + "#" + text[at + r.randint(0, 2) :]
        rows.append((i * 3, text))
    return rows


def test_random_corpora(spark):
    check(spark, corpus(1))


def test_hot_anchors_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)  # pickled with the module's functions: only the driver's steps see it
    check(spark, corpus(2))


def test_edges(spark):
    long = "x" * 49
    rows = [(None, "a" * 120), (3, None), (4, ""), (5, "a" * 120), (6, "a" * 50), (6, "a" * 50), (7, long), (8, long), (9, "ab" * 400), (10, "ba" * 400), (11, "\0" * 60), (12, "\0" * 60), (1, "a" * 51)]
    check(spark, rows)


def test_empty_table(spark):
    check_rows = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(check_rows).count() == 0


def test_maximal_repeats_by_hand():
    lefts, rights = [b"xyz", b"xyw", b"q"], [b"abcde", b"abcdf", b"abcde"]
    got = sorted((a, b, tuple(sorted(m))) for a, b, m in repeats.maximal_repeats([x.ljust(30, b"-") for x in lefts], [y.ljust(50, b"+") for y in rights], 1))
    assert (0, 50, (0, 2)) in got and (2, 4, (0, 1)) in got
