"""Mined questions against a program that goes through the documents in order."""

import random
import re

import pytest

from tessera.operators import mining as G
from tessera.operators import text as T


def sequential(items, existing, n_open, n_recall, each):
    """items: (pass, at, place, type, source, query, expected), in order."""
    normal = lambda q: re.sub(r"[ \t\n\r]+", " ", (q or "").lower()).strip(" ")
    seen, ids = {normal(q) for _, q in existing}, {i for i, _ in existing}
    caps, total, per, numbers, out = {"open": n_open, "recall": n_recall}, {"open": 0, "recall": 0}, {}, {"open": 0, "recall": 0}, []
    for step, _, _, kind, source, query, expected in sorted(items):
        key = normal(query)
        if total[kind] >= caps[kind] or per.get((source, kind), 0) >= each or not key or key in seen:
            continue
        while f"doc{kind[:3] if kind == 'recall' else kind}-{numbers[kind]:06d}" in ids:
            numbers[kind] += 1
        seen.add(key)
        total[kind] += 1
        per[source, kind] = per.get((source, kind), 0) + 1
        out.append((f"doc{kind[:3] if kind == 'recall' else kind}-{numbers[kind]:06d}", kind, source, query, expected, step))
        numbers[kind] += 1
    return sorted(out)


def sheets():
    r = random.Random(4)
    labels = ["Model name", "Weight", "Brand", "Type", "Power"]
    values = ["12 kg", "blue", "5 W", "red one", "7 V and 9 V"]
    rows = []
    for k in range(40):
        head = f"Sheet — Unit{k % 7} (x)\n" if k % 3 else "Sheet\n"
        rows.append((k, f"s{k}", head + "\n".join(f"{r.choice(labels)}: {r.choice(values)}" for _ in range(r.randint(0, 9)))))
    return [*rows, (40, "s40", ""), (41, "s41", None), (42, "s42", "Sheet — Z9 Pro\nWeight: 3 kg\nweight: heavy\nWeight: 3 kg")]


@pytest.mark.parametrize("n_open,n_recall,each", [(1000, 1000, 12), (30, 1000, 2), (1000, 25, 3), (35, 30, 12), (30, 35, 12), (0, 5, 12), (28, 0, 1)])
def test_items_are_those_of_the_sequential_program(spark, n_open, n_recall, each):
    docs = spark.createDataFrame(sheets(), "at long, source string, text string").repartition(3)
    asked = [("docopen-000000", "According to s1, what is the  BRAND?"), ("docopen-000002", "other"), ("docrec-000001", None), ("docopen-x", "According to s2, what is the model name?"), (None, "")]
    existing = spark.createDataFrame(asked, "id string, query string")
    items = [(r["pass"], r["at"], r["place"], r["type"], r["source"], r["query"], r["expected"]) for r in G.candidates(docs).collect()]
    got = sorted(tuple(r) for r in G.mine(docs, existing, n_open, n_recall, each).select("id", "type", "source", "query", "expected", "pass").collect())
    assert got == sequential(items, asked, n_open, n_recall, each)
    assert {i[0] for i in items} == {0, 1, 2}


def test_without_documents_there_are_no_items(spark):
    none = spark.createDataFrame([], "at long, source string, text string")
    assert G.mine(none, spark.createDataFrame([], "id string, query string"), 5, 5).count() == 0


def test_no_task_orders_all_items_or_numbers(spark, monkeypatch):
    """Caps, numbers and free ids over many ranges and blocks; no window over a whole type, no row with all positions."""
    monkeypatch.setattr(G, "RANGE", 3)
    monkeypatch.setattr(G, "BLOCK", 4)
    docs = spark.createDataFrame(sheets(), "at long, source string, text string").repartition(3)
    asked = [(f"docopen-{k:06d}", None) for k in (0, 1, 2, 3, 5, 6, 11, 400)] + [("docrec-000001", "According to s1, what is the brand?")]
    existing = spark.createDataFrame(asked, "id string, query string")
    items = [(r["pass"], r["at"], r["place"], r["type"], r["source"], r["query"], r["expected"]) for r in G.candidates(docs).collect()]
    for caps in [(35, 30), (1000, 1000), (10, 0)]:
        mined = G.mine(docs, existing, *caps)
        assert sorted(tuple(r) for r in mined.collect()) == sequential(items, asked, *caps, 12)
        windows = [x for x in mined._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [row_number" in x]
        assert windows and all("slot" in x.split("windowspec")[1] for x in windows)


def test_a_line_is_searched_once_for_its_label(spark):
    df = spark.createDataFrame([(1, "• Weight : 3 kg\nplain line\nName  x y\n- a-b: c")], "n long, t string")
    found = T.extract_kv(df, "n", "t")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "Name", "x y", 2), (1, "Weight", "3 kg", 0), (1, "a", "b: c", 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace(") == 1
