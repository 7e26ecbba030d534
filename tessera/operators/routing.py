"""Routing, confidence, cost and answer composition as column expressions over evidence tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cost of a step by its source, and names that stand for sources (fixed values).
STEP_COSTS = {"BASE": 0.1, "MEM": 0.3, "SEARCH": 0.5, "SYM": 0.8, "COMPOSE": 0.1}
SOURCE_ALIASES = {"RAG": "SEARCH", "RETRIEVAL": "SEARCH", "DOCS": "SEARCH", "MEMORY": "MEM", "SYMBOLIC": "SYM", "KG": "SYM"}
INSUFFICIENT = "Insufficient context"
NOTHING = "No result found."


def canonical_source(c: Column) -> Column:
    """BASE, MEM, SEARCH, SYM or COMPOSE; aliases are mapped, everything else is COMPOSE."""
    name = F.upper(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in SOURCE_ALIASES.items() for x in kv])
    return F.when(name.isin(*STEP_COSTS), name).otherwise(F.coalesce(F.try_element_at(table, name), F.lit("COMPOSE")))


def clamp(c: Column) -> Column:
    """Within [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def confidence_from_memory(score: Column) -> Column:
    return F.coalesce(clamp(score), F.lit(0.5))


def confidence_from_search(score: Column) -> Column:
    return F.coalesce(1 / (1 + F.exp(-score / 2)), F.lit(0.5))


def confidence_from_symbolic(proved: Column, refuted: Column) -> Column:
    return F.when(proved, 1.0).when(refuted, 0.0).otherwise(0.5)


def confidence_from_features(mem: Column, search: Column, fired: Column) -> Column:
    """0.2 + 0.6 * the better score; at least 0.8 if both are strong, 0.95 if the rules fired; within [0, 1]."""
    mem, search = F.coalesce(mem, F.lit(0.0)), F.coalesce(search, F.lit(0.0))
    base = 0.2 + 0.6 * F.greatest(mem, search)
    base = F.when((mem >= 0.45) & (search >= 0.35), F.greatest(base, F.lit(0.8))).otherwise(base)
    return clamp(F.when(F.coalesce(fired, F.lit(False)), F.greatest(base, F.lit(0.95))).otherwise(base))


def attach_confidence(mode: Column, mem: Column, search: Column, proved: Column, refuted: Column, has_symbolic: Column) -> Column:
    """The confidence that a mode derives from its steps: its own signal, or for combined modes the greatest there is."""
    m, s = clamp(mem), 1 / (1 + F.exp(-search / 2))
    y = F.when(has_symbolic, confidence_from_symbolic(proved, refuted))
    best = F.array_max(F.array_compact(F.array(m, s, y)))
    own = F.when(mode == "MEM", m).when(mode.isin("SEARCH", "BASE"), s).when(mode == "SYM", y).when(mode.isin("MEMSYM", "ROUTER", "ADAPTIVERAG"), best)
    return F.coalesce(own, F.lit(0.5))


def adaptive_route(mem: Column, search: Column, fired: Column, t_mem: float = 0.45, t_search: float = 0.55) -> Column:
    return F.when(mem >= t_mem, "MEM").when(search >= t_search, "SEARCH").when(fired, "SYM").otherwise("MEMSYM")


def abstain(answer: Column, confidence: Column, threshold: float | None) -> Column:
    """ABSTAIN below the threshold; None turns it off."""
    return answer if threshold is None else F.when(confidence < threshold, "ABSTAIN").otherwise(answer)


def episode_cost(sources: Column, costs: Mapping[str, float] = STEP_COSTS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in costs.items() for x in kv])
    return F.aggregate(sources, F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(table, canonical_source(s)), F.lit(0.1)))


def reward(success: Column, steps: Column, alpha: float = 0.3, budget: float = 6.0) -> Column:
    return success - alpha * F.least(F.lit(1.0), steps / budget)


def tokens_estimate(answer: Column) -> Column:
    return F.size(F.filter(F.split(answer, r"[ \t\n\r]+"), lambda w: w != ""))


def guess_action(sources: Column, answer: Column) -> Column:
    """The action that a row's steps, or else its answer's prefix, point to."""
    has = lambda s: F.array_contains(sources, s)
    by_steps = F.when(has("MEM") & has("SYM"), "MEMSYM").when(has("SYM"), "SYM").when(has("MEM"), "MEM").when(has("SEARCH"), "SEARCH")
    low = F.lower(answer)
    by_prefix = F.when(low.startswith("memory:"), "MEM").when(low.startswith("symbolic:"), "SYM").when(low.startswith("search:"), "SEARCH")
    return F.coalesce(by_steps, by_prefix, F.lit("BASE"))


def compose_answer(action: Column, memory: Column, search: Column, symbolic: Column) -> Column:
    """The answer of an action from the evidence texts (null: none)."""
    mem_part, search_part = F.concat(F.lit("Memory: "), memory), F.concat(F.lit("Search: "), search)
    both = F.nullif(F.concat_ws(" ", mem_part, symbolic), F.lit(""))
    only = F.coalesce(symbolic, F.lit(INSUFFICIENT))
    chosen = F.when(action == "MEM", mem_part).when(action == "SYM", symbolic).when(action == "MEMSYM", F.coalesce(both, search_part)).when(action == "SYM_ONLY", only).otherwise(search_part)
    return F.coalesce(chosen, F.lit(NOTHING))


def compose_steps(action: Column, memory: Column, search: Column, symbolic: Column) -> Column:
    """Sources of the steps that `compose_answer` takes."""
    mem, find, sym = (F.when(x.isNotNull(), s) for x, s in ((memory, "MEM"), (search, "SEARCH"), (symbolic, "SYM")))
    fallback = F.when(memory.isNull() & symbolic.isNull(), find)
    parts = F.when(action == "MEM", F.array(mem)).when(action.isin("SYM", "SYM_ONLY"), F.array(sym)).when(action == "MEMSYM", F.array(mem, sym, fallback)).otherwise(F.array(find))
    steps = F.array_compact(parts)
    return F.when((F.size(steps) == 0) & (action != "SYM_ONLY"), F.array(F.lit("BASE"))).otherwise(steps)


def compose_gated(memory: Column, mem_score: Column, search: Column, search_score: Column, symbolic: Column, t_mem: float = 0.45, t_search: float = 0.35) -> Column:
    """Symbolic first, enriched by strong memory and search; else strong memory, then search if strong or nothing came yet."""
    strong_mem, strong_search = F.coalesce(mem_score >= t_mem, F.lit(False)), F.coalesce(search_score >= t_search, F.lit(False))
    mem_part = F.when(strong_mem, F.concat(F.lit("Memory: "), memory))
    search_part = F.when(strong_search | mem_part.isNull(), F.concat(F.lit("Search: "), search))
    rest = F.nullif(F.concat_ws(" ", mem_part, search_part), F.lit(""))
    enriched = F.when(strong_mem | strong_search, F.concat_ws(" ", symbolic, rest)).otherwise(symbolic)
    return F.when(symbolic.isNotNull(), enriched).otherwise(F.coalesce(rest, F.lit(NOTHING)))


def router_scores(features: Sequence[str], weights: Mapping[str, Sequence[float]], bias: Mapping[str, float]) -> Column:
    """Softmax over labels of linear scores: an array of (label, p) structs in label order."""
    labels = sorted(weights)
    logit = {k: sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * float(w) for f, w in zip(features, weights[k], strict=True)), F.lit(float(bias[k]))) for k in labels}
    top = F.greatest(*logit.values()) if len(labels) > 1 else logit[labels[0]]
    exps = {k: F.exp(v - top) for k, v in logit.items()}
    total = sum(exps.values(), F.lit(0.0))
    return F.array(*[F.struct(F.lit(k).alias("label"), (exps[k] / total).alias("p")) for k in labels])


def router_label(scores: Column) -> Column:
    """The label of greatest p, the first of equals."""
    return F.aggregate(scores, F.struct(F.lit(None).cast("string").alias("label"), F.lit(-1.0).alias("p")), lambda a, s: F.when(s["p"] > a["p"], F.struct(s["label"].alias("label"), s["p"].alias("p"))).otherwise(a))["label"]


def router_train(labelled: DataFrame, features: Sequence[str], label: str = "label") -> tuple[Mapping[str, list[float]], Mapping[str, float]]:
    """Weights and bias by label, as `router_logistic` fits them."""
    return router_logistic(labelled, features, label)[:2]


def router_logistic(labelled: DataFrame, features: Sequence[str], label: str = "label") -> tuple[dict[str, list[float]], dict[str, float], dict[str, int]]:
    """One-vs-rest logistic regression: weights and bias by label, and label counts. Fitting runs on the executors; a model is a few numbers.

    Equal rows are one row with a weight, and all fits read the same persisted rows of these; rows with a null feature or label are left
    out of the fits, and those with a null label of the counts. Features are scaled here, by the deviation of all rows, since that of
    weighted rows isn't the same.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
    names = [f"_x{i}" for i in range(len(features))]
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).alias("_label"), *x).groupBy("_label", *names).agg(F.count("*").cast("double").alias("_n")).persist()
    counts = {r["_label"]: int(r["n"]) for r in rows.groupBy("_label").agg(F.sum("_n").alias("n")).collect()}
    known = rows.dropna(subset=names)
    total = F.sum("_n")
    means = known.agg(total.alias("n"), *[(F.sum(F.col(c) * F.col("_n")) / total).alias(c) for c in names]).first()
    squares = known.agg(F.lit(1).alias("one"), *[F.sum(F.col("_n") * (F.col(c) - F.lit(means[c])) ** 2).alias(c) for c in names]).first()
    scale = [(squares[c] / (means["n"] - 1)) ** 0.5 if squares[c] and means["n"] > 1 else 1.0 for c in names]
    scaled = known.select("_label", "_n", *[(F.col(c) / F.lit(s)).alias(c) for c, s in zip(names, scale, strict=True)])
    vectors = VectorAssembler(inputCols=names, outputCol="_vector").transform(scaled).select("_vector", "_label", "_n").persist()
    weights, bias = {}, {}
    for k in sorted(r[0] for r in vectors.select("_label").distinct().collect()):
        fit = LogisticRegression(featuresCol="_vector", labelCol="_is", weightCol="_n", regParam=0.01, standardization=False)
        model = fit.fit(vectors.withColumn("_is", (F.col("_label") == k).cast("double")))
        weights[k], bias[k] = [float(v) / s for v, s in zip(model.coefficients, scale, strict=True)], float(model.intercept)
    vectors.unpersist()
    rows.unpersist()
    return weights, bias, counts


def router_sums(labelled: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """label, n, sums (of the features and of 1) and products (of each two of these, row by row): one pass of partial sums.

    Rows with a null feature or label are left out. What a fit needs is linear in these rows, of which there is one a label.
    """
    known = labelled.dropna(subset=[*features, label])
    x = [*(F.col(f).cast("double") for f in features), F.lit(1.0)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)]
    out = known.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *sums, *products)
    width = range(len(x))
    return out.select("label", "n", F.array(*[f"s{i}" for i in width]).alias("sums"), F.array(*[f"p{i}_{j}" for i in width for j in width]).alias("products"))


#: Labels that a router may have.
MOST_LABELS = 1000


def router_least_squares(labelled: DataFrame, features: Sequence[str], label: str = "label", ridge: float = 0.0) -> tuple[dict[str, list[float]], dict[str, float], dict[str, int]]:
    """One-vs-rest least squares in closed form: weights and bias by label, and label counts; no features that depend on each other
    are needed (the solution of least norm is taken). Raises ValueError without rows.
    """
    import numpy as np

    sums = router_sums(labelled, features, label).orderBy("label").limit(MOST_LABELS + 1).collect()
    if not sums:
        raise ValueError("there are no labelled rows to train on")
    if len(sums) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    width = len(features) + 1
    gram = np.sum([r["products"] for r in sums], axis=0).reshape(width, width) + ridge * np.eye(width)
    solved = np.linalg.pinv(gram, hermitian=True) @ np.array([r["sums"] for r in sums]).T
    weights = {r["label"]: [float(v) for v in solved[:-1, k]] for k, r in enumerate(sums)}
    return weights, {r["label"]: float(solved[-1, k]) for k, r in enumerate(sums)}, {r["label"]: r["n"] for r in sums}


def best_label(df: DataFrame, modes: Sequence[str], key: str = "id", features: Sequence[Column] = ()) -> DataFrame:
    """id and label: the best single mode by success, latency and steps, if it succeeded. An aggregate, not a window.

    features: aggregates over all modes of an id, taken in the same pass. key: the column that id is the text of.
    """
    order = F.struct((-F.col("success")).alias("s"), F.col("latency_ms").alias("l"), F.col("steps").alias("t"), F.col("mode").alias("m"))
    asked = F.col("mode").isin(*modes)
    best = (df if features else df.filter(asked)).groupBy(key).agg(F.min(F.when(asked, order)).alias("b"), *features)
    return best.filter("b.s = -1").select(F.col(key).cast("string").alias("id"), *[c for c in best.columns if c not in (key, "b")], F.col("b.m").alias("label"))


def policy_softmax(df: DataFrame, weights: Mapping[str, Sequence[float]]) -> DataFrame:
    """`df` with p_{action} columns: softmax of linear scores over eight state features."""
    state = [F.lit(1.0), F.col("product").isNotNull().cast("double"), (F.col("mem_hits") > 0).cast("double"), (F.col("doc_hits") > 0).cast("double"), F.col("has_sym").cast("double"), F.least(F.length("query") / 200.0, F.lit(1.0)), F.col("steps_taken") / 6.0, F.least(F.col("added") / 5.0, F.lit(1.0))]
    logit = {a: sum((x * float(w) for x, w in zip(state, ws, strict=True)), F.lit(0.0)) for a, ws in weights.items()}
    top = F.greatest(*logit.values())
    total = sum((F.exp(v - top) for v in logit.values()), F.lit(0.0)) + 1e-12
    return df.withColumns({f"p_{a}": F.exp(v - top) / total for a, v in logit.items()})


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def default_evaluator(episode: Mapping[str, Column]) -> Column:
    """+1 or -1 by substring of the gold text; else 2 * mean Jaccard of the sets - 0.5; -0.2 without gold."""
    e = episode
    by_text = F.when(F.contains(F.lower(e["answer"]), F.lower(e["contains"])), 1.0).otherwise(-1.0)
    sets = jaccard(e["want_req"], e["got_req"]) + jaccard(e["want_miss"], e["got_miss"]) - 0.5
    return F.when(e["contains"].isNotNull(), by_text).when(F.size(e["want_req"]) + F.size(e["want_miss"]) > 0, sets).otherwise(-0.2)


def episode_reward(answer: Column, contains: Column, want_req: Column, want_miss: Column, got_req: Column, got_miss: Column, evaluator: Callable[[Mapping[str, Column]], Column] = default_evaluator) -> Column:
    """Reward of a logged episode: what `evaluator` makes of its columns (named as the arguments); -0.5 unanswered."""
    episode = {"answer": answer, "contains": contains, "want_req": want_req, "want_miss": want_miss, "got_req": got_req, "got_miss": got_miss}
    return F.when(answer.isNull(), -0.5).otherwise(evaluator(episode))


def ranked(df: DataFrame, keys: Sequence[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of greatest score of each key, with rank; Spark's window group limit keeps k of each before the shuffle."""
    over = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)
