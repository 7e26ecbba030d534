"""Queries of routing, confidence, cost and composition over signals of the run tables."""

from pyspark.sql import functions as F

from tessera.operators import routing as G
from tessera.operators.stats import rounded
from tessera.registry import register
from tessera.sources.views import keyed_runs, runs, table, view, with_views

view(
    "sig",
    """SELECT id, mode, type, domain, success, steps, confidence AS mem_top, steps / 6.0 AS search_top, product % 3 = 0 AS sym_fired, product,
CASE WHEN product % 4 <> 0 THEN 'memory ' || CAST(product AS VARCHAR) END AS mem_text, CASE WHEN source % 3 <> 0 THEN 'passage ' || CAST(source AS VARCHAR) END AS search_text,
CASE WHEN product % 3 = 0 THEN 'Symbolic: standards for p' || CAST(product AS VARCHAR) || '.' END AS sym_text,
CASE mode WHEN 'M1' THEN 'MEM' WHEN 'M2' THEN 'SEARCH' WHEN 'M3' THEN 'SYM' WHEN 'M4' THEN 'MEMSYM' WHEN 'M5' THEN 'RAG_BASE' WHEN 'M6' THEN 'SYM_ONLY' ELSE 'BASE' END AS action FROM runs""",
    "runs",
)


def sig(spark, d):
    names = F.create_map(*[F.lit(x) for kv in (("M1", "MEM"), ("M2", "SEARCH"), ("M3", "SYM"), ("M4", "MEMSYM"), ("M5", "RAG_BASE"), ("M6", "SYM_ONLY"), ("M7", "BASE")) for x in kv])
    p, s = F.col("product").cast("string"), F.col("source").cast("string")
    return runs(spark, d).select(
        "id", "mode", "type", "domain", "success", "steps", F.col("confidence").alias("mem_top"), (F.col("steps") / 6.0).alias("search_top"), (F.col("product") % 3 == 0).alias("sym_fired"), "product",
        F.when(F.col("product") % 4 != 0, F.concat(F.lit("memory "), p)).alias("mem_text"), F.when(F.col("source") % 3 != 0, F.concat(F.lit("passage "), s)).alias("search_text"),
        F.when(F.col("product") % 3 == 0, F.concat(F.lit("Symbolic: standards for p"), p, F.lit("."))).alias("sym_text"), names[F.col("mode")].alias("action"),
    )


def sql(body):
    return with_views(body, "sig")


ROUTE = "CASE WHEN mem_top >= 0.45 THEN 'MEM' WHEN search_top >= 0.55 THEN 'SEARCH' WHEN sym_fired THEN 'SYM' ELSE 'MEMSYM' END"
FEATURES = "greatest(0.0, least(1.0, CASE WHEN sym_fired THEN greatest(0.95, {b}) ELSE {b} END))".format(b="CASE WHEN mem_top >= 0.45 AND search_top >= 0.35 THEN greatest(0.8, 0.2 + 0.6 * greatest(mem_top, search_top)) ELSE 0.2 + 0.6 * greatest(mem_top, search_top) END")


def mem_():
    return F.col("mem_text")


def search_():
    return F.col("search_text")


def sym_():
    return F.col("sym_text")


@register("adaptive_route", sql(f"SELECT id, mode, {ROUTE} AS action FROM sig"))
def adaptive_route(spark, d):
    return sig(spark, d).select("id", "mode", G.adaptive_route(F.col("mem_top"), F.col("search_top"), F.col("sym_fired")).alias("action"))


@register("confidence_from_features", sql(f"SELECT id, mode, round({FEATURES}, 6) AS confidence FROM sig"))
def confidence_from_features(spark, d):
    return sig(spark, d).select("id", "mode", rounded(G.confidence_from_features(F.col("mem_top"), F.col("search_top"), F.col("sym_fired"))).alias("confidence"))


@register("confidence_from_scores", sql("""SELECT id, mode, round(greatest(0.0, least(1.0, mem_top)), 6) AS mem, round(1 / (1 + exp(-search_top / 2)), 6) AS search,
CASE WHEN sym_fired AND success = 1 THEN 1.0 WHEN sym_fired AND success = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS sym FROM sig"""))
def confidence_from_scores(spark, d):
    fired = F.col("sym_fired")
    return sig(spark, d).select("id", "mode", rounded(G.confidence_from_memory(F.col("mem_top"))).alias("mem"), rounded(G.confidence_from_search(F.col("search_top"))).alias("search"), G.confidence_from_symbolic(fired & (F.col("success") == 1), fired & (F.col("success") == 0)).alias("sym"))


@register("attach_confidence", sql("""
WITH c AS (SELECT *, CASE WHEN mem_text IS NOT NULL THEN greatest(0.0, least(1.0, mem_top)) END AS m, CASE WHEN search_text IS NOT NULL THEN 1 / (1 + exp(-search_top / 2)) END AS s,
CASE WHEN sym_fired THEN CASE WHEN success = 1 THEN 1.0 ELSE 0.5 END END AS y FROM sig)
SELECT id, mode, round(coalesce(CASE WHEN action = 'MEM' THEN m WHEN action IN ('SEARCH', 'BASE') THEN s WHEN action = 'SYM' THEN y WHEN action = 'MEMSYM' THEN list_max(list_filter([m, s, y], lambda x: x IS NOT NULL)) END, 0.5), 6) AS confidence FROM c"""))
def attach_confidence(spark, d):
    m, s = F.when(mem_().isNotNull(), F.col("mem_top")), F.when(search_().isNotNull(), F.col("search_top"))
    return sig(spark, d).select("id", "mode", rounded(G.attach_confidence(F.col("action"), m, s, F.col("success") == 1, F.lit(False), F.col("sym_fired"))).alias("confidence"))


@register("abstain", sql(f"SELECT id, mode, CASE WHEN {FEATURES} < 0.6 THEN 'ABSTAIN' ELSE coalesce(mem_text, 'none') END AS answer, CASE WHEN {FEATURES} < 0.6 THEN 0 ELSE steps END AS cost_steps FROM sig"))
def abstain(spark, d):
    c = G.confidence_from_features(F.col("mem_top"), F.col("search_top"), F.col("sym_fired"))
    return sig(spark, d).select("id", "mode", G.abstain(F.coalesce(mem_(), F.lit("none")), c, 0.6).alias("answer"), F.when(c < 0.6, 0).otherwise(F.col("steps")).alias("cost_steps"))


ANSWER = """coalesce(CASE WHEN action = 'MEM' THEN 'Memory: ' || mem_text WHEN action = 'SYM' THEN sym_text
WHEN action = 'MEMSYM' THEN coalesce(nullif(concat_ws(' ', 'Memory: ' || mem_text, sym_text), ''), 'Search: ' || search_text)
WHEN action = 'SYM_ONLY' THEN coalesce(sym_text, 'Insufficient context') ELSE 'Search: ' || search_text END, 'No result found.')"""
STEPS = """CASE WHEN len(s) = 0 AND action <> 'SYM_ONLY' THEN ['BASE'] ELSE s END"""
PARTS = """list_filter(CASE WHEN action = 'MEM' THEN [m] WHEN action IN ('SYM', 'SYM_ONLY') THEN [y] WHEN action = 'MEMSYM' THEN [m, y, CASE WHEN m IS NULL AND y IS NULL THEN f END] ELSE [f] END, lambda x: x IS NOT NULL)"""
COMPOSED = f"""composed AS (SELECT *, {ANSWER} AS answer, {STEPS} AS sources FROM (SELECT *, {PARTS} AS s FROM (SELECT *, CASE WHEN mem_text IS NOT NULL THEN 'MEM' END AS m,
CASE WHEN search_text IS NOT NULL THEN 'SEARCH' END AS f, CASE WHEN sym_text IS NOT NULL THEN 'SYM' END AS y FROM sig)))"""


def composed(spark, d):
    a = F.col("action")
    return sig(spark, d).withColumns({"answer": G.compose_answer(a, mem_(), search_(), sym_()), "sources": G.compose_steps(a, mem_(), search_(), sym_())})


@register("compose_answer", sql(f"WITH {COMPOSED} SELECT id, mode, answer, array_to_string(sources, ',') AS sources FROM composed"))
def compose_answer(spark, d):
    return composed(spark, d).select("id", "mode", "answer", F.array_join("sources", ",").alias("sources"))


@register("compose_gated", sql("""
WITH p AS (SELECT id, mode, sym_text, mem_top >= 0.45 AS sm, search_top >= 0.35 AS ss, CASE WHEN mem_top >= 0.45 THEN 'Memory: ' || mem_text END AS mp, search_text FROM sig),
q AS (SELECT *, CASE WHEN ss OR mp IS NULL THEN 'Search: ' || search_text END AS sp FROM p), r AS (SELECT *, nullif(concat_ws(' ', mp, sp), '') AS rest FROM q)
SELECT id, mode, CASE WHEN sym_text IS NOT NULL THEN CASE WHEN sm OR ss THEN concat_ws(' ', sym_text, rest) ELSE sym_text END ELSE coalesce(rest, 'No result found.') END AS answer FROM r"""))
def compose_gated(spark, d):
    return sig(spark, d).select("id", "mode", G.compose_gated(mem_(), F.col("mem_top"), search_(), F.col("search_top"), sym_()).alias("answer"))


@register("episode_cost", sql(f"""WITH {COMPOSED} SELECT id, mode, round(coalesce(list_sum(list_transform(sources, lambda x: CASE x WHEN 'BASE' THEN 0.1 WHEN 'MEM' THEN 0.3 WHEN 'SEARCH' THEN 0.5 WHEN 'SYM' THEN 0.8 ELSE 0.1 END)), 0), 6)::DOUBLE AS cost FROM composed"""))
def episode_cost(spark, d):
    return composed(spark, d).select("id", "mode", rounded(G.episode_cost(F.col("sources"))).alias("cost"))


@register("reward", sql("SELECT id, mode, round(success - 0.3 * least(1.0, steps / 6.0), 6) AS reward, round(1 - 0.3 * least(1.0, steps / 6.0), 6) AS if_success, round(0 - 0.3 * least(1.0, steps / 6.0), 6) AS if_fail FROM sig"))
def reward(spark, d):
    s = F.col("steps")
    return sig(spark, d).select("id", "mode", rounded(G.reward(F.col("success"), s)).alias("reward"), rounded(G.reward(F.lit(1), s)).alias("if_success"), rounded(G.reward(F.lit(0), s)).alias("if_fail"))


@register("tokens_est", sql(f"WITH {COMPOSED} SELECT id, mode, len(list_filter(string_split(answer, ' '), lambda x: x <> ''))::INTEGER AS tokens_est FROM composed"))
def tokens_est(spark, d):
    return composed(spark, d).select("id", "mode", G.tokens_estimate(F.col("answer")).alias("tokens_est"))


@register("guess_action", sql(f"""WITH {COMPOSED} SELECT id, mode, coalesce(CASE WHEN list_contains(sources, 'MEM') AND list_contains(sources, 'SYM') THEN 'MEMSYM' WHEN list_contains(sources, 'SYM') THEN 'SYM' WHEN list_contains(sources, 'MEM') THEN 'MEM'
WHEN list_contains(sources, 'SEARCH') THEN 'SEARCH' END, CASE WHEN lower(answer) LIKE 'memory:%' THEN 'MEM' WHEN lower(answer) LIKE 'symbolic:%' THEN 'SYM' WHEN lower(answer) LIKE 'search:%' THEN 'SEARCH' END, 'BASE') AS action FROM composed"""))
def guess_action(spark, d):
    return composed(spark, d).select("id", "mode", G.guess_action(F.col("sources"), F.col("answer")).alias("action"))


@register("canonical_source", """SELECT event_id, CASE upper(trim(event_type)) WHEN 'BASE' THEN 'BASE' WHEN 'MEM' THEN 'MEM' WHEN 'SEARCH' THEN 'SEARCH' WHEN 'SYM' THEN 'SYM' WHEN 'COMPOSE' THEN 'COMPOSE'
WHEN 'RAG' THEN 'SEARCH' WHEN 'RETRIEVAL' THEN 'SEARCH' WHEN 'DOCS' THEN 'SEARCH' WHEN 'MEMORY' THEN 'MEM' WHEN 'SYMBOLIC' THEN 'SYM' WHEN 'KG' THEN 'SYM' ELSE 'COMPOSE' END AS source FROM events""")
def canonical_source(spark, d):
    return table(spark, d, "events").select("event_id", G.canonical_source(F.col("event_type")).alias("source"))


@register("sym_fired", sql(f"WITH {COMPOSED} SELECT id, mode, list_contains(sources, 'SYM') AS sym_fired FROM composed"))
def sym_fired(spark, d):
    return composed(spark, d).select("id", "mode", F.exists("sources", lambda s: F.upper(s) == "SYM").alias("sym_fired"))


@register("filter_modes", sql("SELECT id, mode FROM sig WHERE mode IN ('M1', 'M3')"))
def filter_modes(spark, d):
    known, asked = {f"M{i}" for i in range(1, 8)}, "m1, M3 ,M9"
    wanted = sorted(known & {m.strip().upper() for m in asked.split(",")})
    return sig(spark, d).filter(F.col("mode").isin(*wanted)).select("id", "mode")


@register("symbolic_sample", sql(f"WITH {COMPOSED} SELECT mode, id, answer FROM (SELECT mode, id, answer, row_number() OVER (PARTITION BY mode ORDER BY id) AS nth FROM composed WHERE lower(answer) LIKE 'symbolic:%') WHERE nth <= 5"))
def symbolic_sample(spark, d):
    from tessera.operators.runs import cap_per_group

    return cap_per_group(composed(spark, d).filter(F.lower("answer").startswith("symbolic:")).select("mode", "id", "answer"), ["mode"], ["id"], 5)


WEIGHTS = {"MEM": [2.0, -1.0, -0.5], "SEARCH": [-1.0, 2.0, -0.5], "SYM": [-0.5, -0.5, 3.0]}
BIAS = {"MEM": 0.1, "SEARCH": 0.0, "SYM": -0.4}
LOGITS = "2.0 * mem_top - 1.0 * search_top - 0.5 * f + 0.1 AS lm, -1.0 * mem_top + 2.0 * search_top - 0.5 * f AS ls, -0.5 * mem_top - 0.5 * search_top + 3.0 * f - 0.4 AS ly"
SCORED = f"""scored AS (SELECT *, exp(lm) / (exp(lm) + exp(ls) + exp(ly)) AS pm, exp(ls) / (exp(lm) + exp(ls) + exp(ly)) AS ps, exp(ly) / (exp(lm) + exp(ls) + exp(ly)) AS py FROM (SELECT *, {LOGITS} FROM (SELECT *, CASE WHEN sym_fired THEN 1.0 ELSE 0.0 END AS f FROM sig)))"""
PICK = "CASE WHEN lm >= ls AND lm >= ly THEN 'MEM' WHEN ls >= ly THEN 'SEARCH' ELSE 'SYM' END"


def scored(spark, d):
    return sig(spark, d).withColumn("f", F.col("sym_fired").cast("double")).withColumn("scores", G.router_scores(["mem_top", "search_top", "f"], WEIGHTS, BIAS))


@register("router_score", sql(f"WITH {SCORED} SELECT id, mode, {PICK} AS label, round(greatest(pm, ps, py), 5) AS p FROM scored"))
def router_score(spark, d):
    return scored(spark, d).select("id", "mode", G.router_label(F.col("scores")).alias("label"), rounded(F.array_max(F.transform("scores", lambda s: s["p"])), 5).alias("p"))


@register("route_then_compose", sql(f"WITH {SCORED}, routed AS (SELECT * REPLACE (CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN {ROUTE} ELSE {PICK} END AS action) FROM scored) SELECT id, mode, action, {ANSWER} AS answer FROM routed"))
def route_then_compose(spark, d):
    routed = F.when(F.col("id").cast("long") % 5 != 0, G.router_label(F.col("scores")))  # ids without a model take the adaptive route
    df = scored(spark, d).withColumn("action", F.coalesce(routed, G.adaptive_route(F.col("mem_top"), F.col("search_top"), F.col("sym_fired"))))
    return df.select("id", "mode", "action", G.compose_answer(F.col("action"), mem_(), search_(), sym_()).alias("answer"))


FEATURES = "SELECT id, avg(confidence) AS mem, avg(steps) AS steps, avg(CASE WHEN product % 3 = 0 THEN 1.0 ELSE 0.0 END) AS f FROM runs GROUP BY id"
LABELS = "SELECT id, mode AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY success DESC, latency_ms, steps, mode) AS nth FROM runs WHERE mode IN ('M1', 'M2', 'M3')) WHERE nth = 1 AND success = 1"


def labelled(spark, d):
    """id, features and best label of a question by one aggregate, where the join of the runs has put its rows."""
    df = keyed_runs(spark, d).withColumn("f", (F.col("product") % 3 == 0).cast("double"))
    features = [F.avg("confidence").alias("mem"), F.avg("steps").alias("steps"), F.avg("f").alias("f")]
    return G.best_label(df, ("M1", "M2", "M3"), "key", features)


def model(spark, weights, bias, counts):
    total = sum(counts.values())
    rows = [(k, float(bias[k]), *map(float, weights[k]), counts[k], total) for k in weights]
    return spark.createDataFrame(rows, "label string, bias double, w_mem double, w_steps double, w_f double, label_count long, n_train long")


#: Solved by Cramer's rule from covariances with each label's indicator.
@register("router_train", sql(f"""WITH rows AS (SELECT mem, steps, f, label FROM ({FEATURES}) JOIN ({LABELS}) USING (id)), x AS (SELECT rows.*, l.label AS k, CASE WHEN rows.label = l.label THEN 1.0 ELSE 0.0 END AS y FROM rows, (SELECT DISTINCT label FROM rows) l),
c AS (SELECT k, avg(y) AS y, avg(mem) AS m, avg(steps) AS s, avg(f) AS g, covar_pop(mem, mem) AS mm, covar_pop(steps, steps) AS ss, covar_pop(f, f) AS ff, covar_pop(mem, steps) AS ms, covar_pop(mem, f) AS mf, covar_pop(steps, f) AS sf,
  covar_pop(mem, y) AS my, covar_pop(steps, y) AS sy, covar_pop(f, y) AS fy, CAST(sum(y) AS BIGINT) AS label_count, count(*) AS n_train FROM x GROUP BY k),
d AS (SELECT *, mm * (ss * ff - sf * sf) - ms * (ms * ff - sf * mf) + mf * (ms * sf - ss * mf) AS det FROM c),
w AS (SELECT *, (my * (ss * ff - sf * sf) - ms * (sy * ff - sf * fy) + mf * (sy * sf - ss * fy)) / det AS wm, (mm * (sy * ff - sf * fy) - my * (ms * ff - sf * mf) + mf * (ms * fy - sy * mf)) / det AS ws,
  (mm * (ss * fy - sy * sf) - ms * (ms * fy - sy * mf) + my * (ms * sf - ss * mf)) / det AS wf FROM d)
SELECT k AS label, round(y - wm * m - ws * s - wf * g, 5) AS bias, round(wm, 5) AS w_mem, round(ws, 5) AS w_steps, round(wf, 5) AS w_f, label_count, n_train FROM w"""))
def router_train(spark, d):
    """Least squares in closed form, from one pass of sums."""
    out = model(spark, *G.router_least_squares(labelled(spark, d), ["mem", "steps", "f"]))
    return out.withColumns({c: rounded(F.col(c), 5) for c in ("bias", "w_mem", "w_steps", "w_f")})


@register("router_train_logistic")
def router_train_logistic(spark, d):
    rows = labelled(spark, d)
    return model(spark, *G.router_logistic(rows, ["mem", "steps", "f"]))


POLICY = {"MEM": [0.1, 0.2, 1.0, 0.0, 0.0, 0.3, -0.1, 0.2], "SEARCH": [0.0, 0.1, 0.0, 1.0, 0.0, 0.5, -0.1, 0.1], "SYM": [0.0, 0.5, 0.0, 0.0, 1.2, 0.0, 0.0, 0.0], "STOP": [-0.2, 0.0, 0.2, 0.2, 0.2, 0.0, 1.0, -0.5]}
STATE = "[1.0, 1.0, CASE WHEN turn % 3 > 0 THEN 1.0 ELSE 0.0 END, CASE WHEN turn % 2 > 0 THEN 1.0 ELSE 0.0 END, CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.0 END, least(length(text) / 200.0, 1.0), (turn % 6) / 6.0, least((turn % 4) / 5.0, 1.0)]"


@register("policy_softmax", "WITH s AS (SELECT conv_id, turn, " + ", ".join(f"list_dot_product({STATE}::DOUBLE[], {w}::DOUBLE[]) AS l_{a}" for a, w in POLICY.items()) + " FROM conversations) SELECT conv_id, turn, " + ", ".join(f"round(exp(l_{a}) / (" + " + ".join(f"exp(l_{b})" for b in POLICY) + f"), 6) AS p_{a}" for a in POLICY) + " FROM s")
def policy_softmax(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.lit("p").alias("product"), (F.col("turn") % 3).alias("mem_hits"), (F.col("turn") % 2).alias("doc_hits"), (F.col("conv_id") % 2 == 0).alias("has_sym"), (F.col("turn") % 6).alias("steps_taken"), (F.col("turn") % 4).alias("added"))
    return G.policy_softmax(c, POLICY).select("conv_id", "turn", *[rounded(F.col(f"p_{a}")).alias(f"p_{a}") for a in POLICY])


EPISODE = """episodes AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS answer, CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 3) WHEN p_partkey % 3 = 1 THEN NULL ELSE NULL END AS contains,
CASE WHEN p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE [p_brand, p_type] END AS want_req, CASE WHEN p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE ['m' || CAST(p_size % 3 AS VARCHAR)] END AS want_miss,
[p_brand] AS got_req, ['m' || CAST(p_size % 2 AS VARCHAR)] AS got_miss, p_partkey % 4 AS epoch FROM part)"""


def episodes(spark, d):
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    m = lambda n: F.array(F.concat(F.lit("m"), (F.col("p_size") % n).cast("string")))
    return table(spark, d, "part").select(
        k.alias("id"), F.when(k % 11 != 0, F.col("p_name")).alias("answer"), F.when(k % 3 == 0, F.substring("p_name", 1, 3)).alias("contains"), F.when(k % 5 == 0, none).otherwise(F.array("p_brand", "p_type")).alias("want_req"),
        F.when(k % 5 == 0, none).otherwise(m(3)).alias("want_miss"), F.array("p_brand").alias("got_req"), m(2).alias("got_miss"), (k % 4).alias("epoch"),
    )


JACCARD = "(len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b})))))"
REWARD = f"""CASE WHEN answer IS NULL THEN -0.5 WHEN contains IS NOT NULL THEN CASE WHEN contains(lower(answer), lower(contains)) THEN 1.0 ELSE -1.0 END
WHEN len(want_req) + len(want_miss) > 0 THEN {JACCARD.format(a='want_req', b='got_req')} + {JACCARD.format(a='want_miss', b='got_miss')} - 0.5 ELSE -0.2 END"""


@register("episode_return", f"WITH {EPISODE} SELECT epoch, count(*) AS n, round(avg({REWARD}), 6) AS mean_reward FROM episodes GROUP BY epoch")
def episode_return(spark, d):
    r = G.episode_reward(*[F.col(c) for c in ("answer", "contains", "want_req", "want_miss", "got_req", "got_miss")])
    return episodes(spark, d).groupBy("epoch").agg(F.count("*").alias("n"), rounded(F.avg(r)).alias("mean_reward"))


@register("jaccard_sets", f"WITH {EPISODE} SELECT id, round({JACCARD.format(a='want_req', b='got_req')}, 6) AS jaccard FROM episodes")
def jaccard_sets(spark, d):
    return episodes(spark, d).select("id", rounded(G.jaccard(F.col("want_req"), F.col("got_req"))).alias("jaccard"))
