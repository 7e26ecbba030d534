"""Rule and memory knock-outs, and robustness runs, against the programs that they stand for."""

from pyspark.sql import functions as F

from tessera.operators import faithfulness as A
from tessera.operators import kg as K
from tessera.operators import robustness as B
from tessera.operators import text as T

POOL, NOISE = {"standard": ["norm", "rule"], "label": ["tag"], "battery": ["cell"]}, ("oh", "label")
TRIPLES = "s string, p string, o string, o_is_literal boolean"


def graph(spark, rows):
    return spark.createDataFrame([(*r, False) for r in rows], TRIPLES)


def chain():
    """Rules whose `unless` looks for heads of others, a body that reads a head, and two rules with one head."""
    rule = K.Rule
    return (
        rule("a", "type", "A", (("requiresStep", "X"),)),
        rule("b", "type", "B", (("requiresStep", "Y"),), unless=("requiresStep", "X")),
        rule("c", "type", "C", (("requiresStep", "Z"), ("requiresCompliance", "S")), unless=("requiresStep", "Y")),
        rule("d", "requiresStep", "Z", (("requiresCompliance", "Deep"),)),
        rule("e", "type", "B", (("requiresCompliance", "S"),)),
        rule("f", "uses", None, (("requiresStep", "F"),), via_type="Fabric", unless=("requiresCompliance", "Deep")),
    )


ROWS = [
    ("p", "hasComponent", "a1"), ("p", "hasComponent", "b1"), ("p", "hasComponent", "c1"), ("q", "hasComponent", "b1"), ("q", "hasComponent", "c1"),
    ("r", "hasComponent", "p"), ("r", "hasComponent", "c1"), ("r", "hasComponent", "u1"), ("t", "hasComponent", "q"), ("t", "requiresStep", "Y"), ("t", "hasComponent", "c1"),
    ("v", "hasComponent", "a1"), ("v", "hasComponent", "a2"), ("a1", "type", "A"), ("a2", "type", "A"), ("b1", "type", "B"), ("c1", "type", "C"), ("u1", "uses", "f1"), ("f1", "type", "Fabric"),
]


def added(spark, triples, rules, disabled):
    return {tuple(r) for r in K.apply_rules(triples, rules, disabled).select("s", "p", "o").distinct().collect()}


def test_worlds_are_the_runs_with_rules_disabled(spark):
    triples, rules = graph(spark, ROWS), chain()
    disabled = [*K.single_knockouts(rules), ("a", "b"), ("b", "c", "e"), tuple(r.name for r in rules)]
    worlds = K.apply_rules_in_worlds(triples, rules, disabled).collect()
    for k, names in enumerate(disabled):
        got = {(r["s"], r["p"], r["o"]) for r in worlds if r["worlds"] >> k & 1}
        assert got == added(spark, triples, rules, names), names
    assert ("p", "requiresStep", "Y") in {(r["s"], r["p"], r["o"]) for r in worlds if r["worlds"] >> 1 & 1}, "what a lost blocker sets free"


def test_rule_knockouts_count_what_each_run_adds(spark):
    triples, rules = graph(spark, ROWS), chain()
    got = {r["rule"]: (r["n"], r["n_without"]) for r in K.rule_knockouts(triples, rules).collect()}
    n = len(added(spark, triples, rules, ()))
    assert got == {r.name: (n, len(added(spark, triples, rules, (r.name,)))) for r in rules}
    assert K.rule_knockouts(graph(spark, [("x", "y", "z")]), rules).filter("n <> 0 or n_without <> 0").count() == 0


def test_drops_come_from_composed_answers(spark):
    rules = (K.Rule("a", "type", "A", (("requiresStep", "X"),)), K.Rule("b", "type", "B", (("requiresStep", "Y"),), unless=("requiresStep", "X")), K.Rule("e", "type", "B", (("requiresStep", "X"),)))
    triples = graph(spark, [("p", "hasComponent", "a1"), ("q", "hasComponent", "b1"), ("a1", "type", "A"), ("b1", "type", "B"), ("w", "hasComponent", "a1"), ("w", "hasComponent", "b1")])
    rows = [("1", "logic", "p", "x"), ("2", "open", "q", "Y"), ("3", "recall", "none", "blue"), ("4", "recall", "p", "blue"), ("5", "open", "p", "absent"), ("6", "open", "p", ""), ("7", "open", None, None), ("8", "logic", "w", "X")]
    questions = spark.createDataFrame(rows, "id string, type string, product string, expected string")
    memory = spark.createDataFrame([("3", "It is blue."), ("4", "Blue.")], "id string, text string")
    search = spark.createDataFrame([("3", "found blue"), ("1", "found")], "id string, text string")
    out = A.knockouts(questions, memory, search, triples, rules)
    got = {r["id"]: (r["used_mem"], r["used_sym"], r["delta_memory"], {d["rule"]: d["delta"] for d in r["deltas"]}) for r in out.collect()}
    assert got == {
        "1": (0, 1, 0, {"a": 1, "b": 0, "e": 0}),
        "2": (0, 1, 0, {"a": 0, "b": 1, "e": 0}),
        "3": (1, 0, 0, {"a": 1, "b": 1, "e": 1}),
        "4": (1, 1, 1, {"a": 1, "b": 1, "e": 1}),
        "8": (0, 1, 0, {"a": 0, "b": 0, "e": 0}),
    }
    assert tuple(A.summary(out).first()) == (5, 1 / 5, 4 / 5)
    assert {r["rule"]: r["n_dropped"] for r in A.by_rule(out).collect()} == {"a": 3, "b": 3, "e": 2}
    assert A.summary(out.limit(0)).first()["n"] == 0


def test_sizes_take_the_best_of_their_prefix(spark):
    rows = [("q", "", 0, k, at, float(score)) for k, (at, score) in enumerate([(0, 1), (3, 5), (4, 5), (9, 7), (12, 9), (40, 99), (5, 5)])]
    scored = spark.createDataFrame(rows, "id string, kind string, intensity int, key long, at long, score double")
    for k in (1, 2):
        got = sorted((r["size"], r["rank"], r["key"]) for r in B.best_by_size(scored, [20, 4, 10], k).collect())
        want = [(size, n, key) for size in (4, 10, 20) for n, (_, key) in enumerate(sorted((-r[5], r[3]) for r in rows if r[4] < size)[:k], 1)]
        assert got == sorted(want)


def test_whole_run_is_that_of_one_question_at_a_time(spark):
    """Against a program that searches for each form and size anew."""
    asked = [("1", "What Battery standard applies to unit 7", "blue"), ("2", "label steps", "red"), ("3", "zzz", "")]
    texts = [(0, "unit 8 is blue and standard"), (1, "red label accumulator"), (2, None), (3, "steps 7 red"), (4, "blue unit 7 standard applies")]
    memories = [(10, 0, "marking red"), (11, 5, "unit 7 standard blue"), (12, 9, "label steps are red")]
    questions = spark.createDataFrame(asked, "id string, query string, expected string")
    passages = spark.createDataFrame(texts, "key long, text string")
    memory = spark.createDataFrame(memories, "key long, at long, text string")
    got = {(r["setting"], r["param"], r["mode"], r["id"]): (r["answer"], r["success"], round(r["cost"], 6)) for r in B.evaluate(questions, passages, memory, (1, 6, 10), ("BASE", "MEM", "RL"), POOL, NOISE).collect()}
    words = lambda t: set(spark.createDataFrame([(t,)], "t string").select(B.tokens(F.col("t")).alias("w")).first()["w"] or ())
    held = {t: words(t) for _, t in texts if t} | {t: words(t) for _, _, t in memories}
    expected = {i: e for i, _, e in asked}
    forms = [(r["base"], "AUGMENT", f"{r['kind']}@{r['intensity']}", r["query"], 1) for r in T.augment_grid(questions, "id", "query", POOL, NOISE).collect()]
    forms += [(i, "MEMSCALE", f"mem@{size}", q, size) for i, q, _ in asked for size in (1, 6, 10)]
    assert len(got) == 3 * len(forms)
    for i, setting, param, query, size in forms:
        terms = words(query)
        best = lambda rows, terms=terms: min(((-len(terms & held[t]), k, t) for k, t in rows if t and terms & held[t]), default=(0, None, None))
        (m, _, mem), (s, _, found) = best([(k, t) for k, at, t in memories if at < size]), best(texts)
        m, s = -m / max(1, len(terms)), -s / max(1, len(terms))
        for mode in ("BASE", "MEM", "RL"):
            action = mode if mode != "RL" else "MEM" if m >= 0.45 else "SEARCH" if s >= 0.55 else "MEMSYM"
            part = ("Memory: " + mem, 0.3) if mem and action in ("MEM", "MEMSYM") else ("Search: " + found, 0.5) if found and action != "MEM" else ("No result found.", 0.1)
            want = (part[0], int(expected[i] != "" and expected[i] in part[0].lower()), part[1])
            assert got[setting, param, mode, i] == want
    assert B.summary(B.evaluate(questions.limit(0), passages, memory, (1,), ("BASE",), POOL, NOISE)).count() == 0
