"""Queries over run tables: summaries, intervals, paired tests, calibration, selective risk, effect sizes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import runs as R
from tessera.operators import stats as S
from tessera.registry import register
from tessera.sources import catalogue as C
from tessera.sources.shared import scratch, written
from tessera.sources.views import raw_runs, runs, with_views

MODES = ("M1", "M2", "M3")


def sql(body, *more):
    return with_views(body, "runs", *more)


SUMMARY = """count(*) AS n, round(avg(success), 4) AS accuracy, round(avg(latency_ms), 2) AS avg_latency_ms,
round(median(latency_ms), 2) AS median_latency_ms, round(avg(steps), 2) AS avg_steps"""


@register("dedup_keep_last", sql("SELECT id, mode, source, latency_ms, product FROM runs"))
def dedup_keep_last(spark, d):
    return runs(spark, d).select("id", "mode", "source", "latency_ms", "product")


@register("summary_by_mode", sql(f"SELECT mode, {SUMMARY} FROM runs GROUP BY mode"))
def summary_by_mode(spark, d):
    return S.summary(runs(spark, d), "mode")


@register("summary_by_domain_mode", sql(f"""
WITH s AS (SELECT domain, mode, {SUMMARY} FROM runs GROUP BY domain, mode),
ids AS (SELECT domain, mode, string_agg(run_id, ',' ORDER BY run_id) AS run_ids FROM (SELECT DISTINCT domain, mode, run_id FROM runs) GROUP BY domain, mode)
SELECT s.*, run_ids FROM s JOIN ids USING (domain, mode)"""))
def summary_by_domain_mode(spark, d):
    df = runs(spark, d)
    ids = df.groupBy("domain", "mode").agg(F.array_join(F.sort_array(F.collect_set("run_id")), ",").alias("run_ids"))
    return S.summary(df, "domain", "mode").join(ids, ["domain", "mode"])


@register("best_mode_by_domain", sql("""
WITH s AS (SELECT domain, mode, avg(success) AS accuracy FROM runs GROUP BY domain, mode)
SELECT domain, mode, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY round(accuracy, 6) DESC, mode) AS nth FROM s) WHERE nth = 1"""))
def best_mode_by_domain(spark, d):
    s = runs(spark, d).groupBy("domain", "mode").agg(S.rounded(F.avg("success")).alias("accuracy"))
    return s.groupBy("domain").agg(F.min(F.struct((-F.col("accuracy")).alias("a"), F.col("mode").alias("m"))).alias("best")).select("domain", F.col("best.m").alias("mode"), (-F.col("best.a")).alias("accuracy"))


@register("acc_by_type", sql("SELECT mode, type, round(avg(success), 6) AS accuracy, count(*) AS n FROM runs GROUP BY mode, type"))
def acc_by_type(spark, d):
    return runs(spark, d).groupBy("mode", "type").agg(S.rounded(F.avg("success")).alias("accuracy"), F.count("*").alias("n"))


@register("ablation_pivot", sql("""
SELECT mode, coalesce(round(avg(success) FILTER (WHERE type = 'recall'), 6), 0) AS recall, coalesce(round(avg(success) FILTER (WHERE type = 'logic'), 6), 0) AS logic,
coalesce(round(avg(success) FILTER (WHERE type = 'open'), 6), 0) AS open FROM runs GROUP BY mode"""))
def ablation_pivot(spark, d):
    return runs(spark, d).groupBy("mode").pivot("type", ["recall", "logic", "open"]).agg(S.rounded(F.avg("success"))).fillna(0.0)


@register("ablation_costs", sql("""
SELECT mode, coalesce(domain, 'all') AS domain, count(*) AS n, round(avg(success), 6) AS accuracy, round(avg(steps), 6) AS avg_steps, round(avg(latency_ms), 4) AS avg_latency_ms
FROM runs GROUP BY GROUPING SETS ((mode), (domain, mode))"""))
def ablation_costs(spark, d):
    sets = runs(spark, d).groupingSets([["mode"], ["domain", "mode"]], "mode", "domain")
    return sets.agg(F.count("*").alias("n"), S.rounded(F.avg("success")).alias("accuracy"), S.rounded(F.avg("steps")).alias("avg_steps"), S.rounded(F.avg("latency_ms"), 4).alias("avg_latency_ms")).withColumn("domain", F.coalesce("domain", F.lit("all")))


COSTS = ("latency_ms", "steps", "tokens_est", "retrieval_calls", "llm_calls", "cost")


@register("cost_by_mode", sql("""
SELECT mode, domain, round(avg(coalesce(latency_ms, 0)), 4) AS avg_latency_ms, round(avg(coalesce(steps, 0)), 4) AS avg_steps, 0.0::DOUBLE AS avg_tokens_est,
0.0::DOUBLE AS avg_retrieval_calls, 0.0::DOUBLE AS avg_llm_calls, 0.0::DOUBLE AS avg_cost FROM runs GROUP BY mode, domain"""))
def cost_by_mode(spark, d):
    df = runs(spark, d)
    mean = lambda c: S.rounded(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 4) if c in df.columns else F.max(F.lit(0.0))
    return df.groupBy("mode", "domain").agg(*[mean(c).alias(f"avg_{c}") for c in COSTS])


WILSON = """round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, ((k / n + 3.8416 / (2 * n)) {sign} 1.96 * sqrt((k / n) * (1 - k / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n))) END, 6)"""
ACC_CI = f"""
WITH s AS (SELECT mode, CASE WHEN grouping(domain) = 1 THEN 'pooled' ELSE domain END AS domain, CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, count(*) AS n, CAST(sum(success) AS DOUBLE) AS k
FROM runs GROUP BY GROUPING SETS ((mode, domain, type), (mode, domain), (mode, type), (mode)))
SELECT mode, domain, type, n, round(k / n, 6) AS accuracy, {WILSON.format(sign='-')} AS ci_low, {WILSON.format(sign='+')} AS ci_high FROM s"""


@register("acc_ci", sql(ACC_CI))
def acc_ci(spark, d):
    return S.acc_ci(runs(spark, d))


@register("example_counts", sql("SELECT domain, type, count(DISTINCT id) AS n_examples, greatest(0, 1000 - count(DISTINCT id)) AS deficit FROM runs GROUP BY domain, type"))
def example_counts(spark, d):
    counted = runs(spark, d).select("domain", "type", "id").distinct().groupBy("domain", "type").agg(F.count("*").alias("n_examples"))
    return counted.withColumn("deficit", F.greatest(F.lit(0).cast("long"), 1000 - F.col("n_examples")))


BINOMIAL = """CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1),
lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"""


@register("mcnemar", sql(f"""
WITH base AS (SELECT domain, id, max(success) AS base FROM runs WHERE mode = 'M1' GROUP BY domain, id),
s AS (SELECT mode, coalesce(domain, 'pooled') AS domain, count(*) FILTER (WHERE success = 1 AND base = 0) AS b, count(*) FILTER (WHERE success = 0 AND base = 1) AS c, count(*) AS n_pairs
FROM runs JOIN base USING (domain, id) WHERE mode <> 'M1' GROUP BY GROUPING SETS ((mode, domain), (mode)))
SELECT mode, domain, b, c, n_pairs, round({BINOMIAL}, 6) AS p_value FROM s"""))
def mcnemar(spark, d):
    return S.mcnemar(runs(spark, d), "M1").withColumn("p_value", S.rounded(F.col("p_value")))


@register("paired_modes", sql("""
SELECT domain, id, max(success) FILTER (WHERE mode = 'M1') AS success_a, max(success) FILTER (WHERE mode = 'M2') AS success_b FROM runs WHERE mode IN ('M1', 'M2')
GROUP BY domain, id HAVING success_a IS NOT NULL AND success_b IS NOT NULL"""))
def paired_modes(spark, d):
    return R.paired_modes(runs(spark, d), "M1", "M2")


@register("complete_cases", sql("""
SELECT id, max(success) FILTER (WHERE mode = 'M1') AS M1, max(success) FILTER (WHERE mode = 'M2') AS M2, max(success) FILTER (WHERE mode = 'M3') AS M3 FROM runs
GROUP BY id HAVING M1 IS NOT NULL AND M2 IS NOT NULL AND M3 IS NOT NULL"""))
def complete_cases(spark, d):
    return R.complete_cases(runs(spark, d), MODES)


CURVE = """
taus AS (SELECT i, round(i * 0.02, 4) AS threshold FROM (SELECT unnest(range(0, 51)) AS i)),
levels AS (SELECT mode, (SELECT count(*) FROM taus WHERE threshold <= confidence) AS level, success FROM runs),
sums AS (SELECT mode, level, count(*) AS c, sum(success) AS k FROM levels GROUP BY mode, level),
points AS (SELECT mode, i, threshold, CAST(sum(CASE WHEN level > i THEN c ELSE 0 END) AS BIGINT) AS n, sum(CASE WHEN level > i THEN k ELSE 0 END) AS k, sum(c) AS total FROM sums, taus GROUP BY mode, i, threshold),
curve AS (SELECT mode, threshold, round(n / total, 6) AS coverage, round(CASE WHEN n > 0 THEN k / n ELSE 0 END, 6) AS accuracy, round(1 - CASE WHEN n > 0 THEN k / n ELSE 0 END, 6) AS risk, n FROM points)"""


@register("selective_curve", sql(f"WITH {CURVE} SELECT * FROM curve"))
def selective_curve(spark, d):
    return S.selective_curve(runs(spark, d), "mode")


@register("aurc", sql(f"""WITH {CURVE}, steps AS (SELECT mode, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS area FROM curve WINDOW w AS (PARTITION BY mode ORDER BY coverage, threshold DESC))
SELECT mode, round(sum(area), 6) AS aurc FROM steps GROUP BY mode"""))
def aurc(spark, d):
    return S.aurc(S.selective_curve(runs(spark, d), "mode"), "mode")


BY_DOMAIN = CURVE.replace("FROM runs", "FROM (SELECT * REPLACE (domain || '/' || mode AS mode) FROM runs)")


@register("selective_deltas", sql(f"""WITH {BY_DOMAIN}, steps AS (SELECT mode, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS area FROM curve WINDOW w AS (PARTITION BY mode ORDER BY coverage, threshold DESC)),
a AS (SELECT mode, round(sum(area), 6) AS aurc FROM steps GROUP BY mode), r AS (SELECT mode, max(risk) FILTER (threshold = 0.3) AS r30, max(risk) FILTER (threshold = 0.5) AS r50, max(risk) FILTER (threshold = 0.7) AS r70 FROM curve GROUP BY mode),
e AS (SELECT split_part(mode, '/', 1) AS domain, split_part(mode, '/', 2) AS mode, aurc, r30, r50, r70 FROM a JOIN r USING (mode))
SELECT x.domain, x.mode, round(coalesce(x.aurc, 0) - coalesce(b.aurc, 0), 6) AS delta_aurc, round(x.r30 - coalesce(b.r30, 0), 6) AS delta_risk_30, round(x.r50 - coalesce(b.r50, 0), 6) AS delta_risk_50, round(x.r70 - coalesce(b.r70, 0), 6) AS delta_risk_70
FROM e x LEFT JOIN e b ON b.domain = x.domain AND b.mode = 'M2' WHERE x.mode <> 'M2'"""))
def selective_deltas(spark, d):
    found = S.selective_deltas(runs(spark, d), "M2", (0.3, 0.5, 0.7), "domain")
    return found.select("domain", "mode", "delta_aurc", *[F.get("delta_risk", F.lit(i)).alias(f"delta_risk_{t}") for i, t in enumerate((30, 50, 70))])


@register("mcnemar_notes", sql(f"""
WITH marked AS (SELECT id, CASE WHEN mode = 'M3' THEN id || 'x' ELSE id END AS k, mode, domain, success FROM runs), base AS (SELECT domain, k, max(success) AS base FROM marked WHERE mode = 'M1' GROUP BY domain, k),
s AS (SELECT mode, count(*) FILTER (WHERE success = 1 AND base = 0) AS b, count(*) FILTER (WHERE success = 0 AND base = 1) AS c FROM marked JOIN base USING (domain, k) WHERE mode <> 'M1' GROUP BY mode)
SELECT m.mode, coalesce(b + c, 0) AS n, CASE WHEN b + c > 0 THEN round({BINOMIAL}, 6) END AS p_value, CASE WHEN b IS NULL THEN 'no overlap' WHEN b + c = 0 THEN 'no discordant pairs' END AS note FROM (SELECT DISTINCT mode FROM runs WHERE mode <> 'M1') m LEFT JOIN s ON s.mode = m.mode"""))
def mcnemar_notes(spark, d):
    """M3 answers other questions here, so that it has no pairs."""
    df = runs(spark, d).withColumn("id", F.when(F.col("mode") == "M3", F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    return S.mcnemar_notes(df, "M1").withColumn("p_value", S.rounded(F.col("p_value")))


def nearest(target):
    return f"SELECT mode, threshold, coverage, accuracy, risk, n, {target}::DOUBLE AS target FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY round(abs(coverage - {target}), 9), risk, threshold) AS nth FROM curve) WHERE nth = 1"


@register("pick_threshold", sql(f"WITH {CURVE} {nearest(0.8)}"))
def pick_threshold(spark, d):
    return S.pick_threshold(S.selective_curve(runs(spark, d), "mode"), 0.8, "mode")


@register("selective_targets", sql(f"WITH {CURVE} {nearest(0.5)} UNION ALL {nearest(0.7)} UNION ALL {nearest(0.9)}"))
def selective_targets(spark, d):
    curve = S.selective_curve(runs(spark, d), "mode")
    a, b, c = (S.pick_threshold(curve, t, "mode") for t in (0.5, 0.7, 0.9))
    return a.unionByName(b).unionByName(c)


BINS = """
sums AS (SELECT mode, confidence, count(*) AS n, sum(success) AS k FROM (SELECT mode, success, greatest(0.0, least(1.0, confidence)) AS confidence FROM runs WHERE confidence IS NOT NULL) GROUP BY mode, confidence),
ranked AS (SELECT r.mode, r.confidence, sums.k / sums.n AS p, row_number() OVER (PARTITION BY r.mode ORDER BY r.confidence) - 1 AS r, count(*) OVER (PARTITION BY r.mode) AS total
FROM (SELECT mode, greatest(0.0, least(1.0, confidence)) AS confidence FROM runs WHERE confidence IS NOT NULL) r JOIN sums ON r.mode = sums.mode AND r.confidence = sums.confidence),
bins AS (SELECT mode, ((r + 1) * least(10, total) - 1) // total AS bin, count(*) AS n, avg(confidence) AS mc, avg(p) AS ms FROM ranked GROUP BY mode, bin)"""


@register("ece_quantile", sql(f"WITH {BINS} SELECT mode, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_bins, round(sum(abs(ms - mc) * n) / sum(n), 6) AS ece FROM bins GROUP BY mode"))
def ece_quantile(spark, d):
    return S.ece_quantile(runs(spark, d), "mode")


@register("calibration_means", sql(f"""WITH {BINS}, e AS (SELECT mode, sum(abs(ms - mc) * n) / sum(n) AS ece FROM bins GROUP BY mode), {CURVE.strip()}, steps AS (SELECT mode, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS area FROM curve WINDOW w AS (PARTITION BY mode ORDER BY coverage, threshold DESC)),
a AS (SELECT mode, round(sum(area), 6) AS aurc FROM steps GROUP BY mode) SELECT round(avg(round(ece, 6)), 5) AS mean_ece, round(avg(aurc), 5) AS mean_aurc, count(*) AS n_modes FROM e JOIN a USING (mode)""".replace("sums AS (SELECT mode, level", "level_sums AS (SELECT mode, level").replace("FROM sums, taus", "FROM level_sums, taus")))
def calibration_means(spark, d):
    """Mean calibration error and mean area under risk over all modes."""
    df = runs(spark, d)
    both = S.ece_quantile(df, "mode").select("mode", "ece").join(S.aurc(S.selective_curve(df, "mode"), "mode"), "mode")
    return both.agg(S.rounded(F.avg("ece"), 5).alias("mean_ece"), S.rounded(F.avg("aurc"), 5).alias("mean_aurc"), F.count("*").alias("n_modes"))


@register("reliability_points", sql(f"WITH {BINS} SELECT mode, CAST(bin AS BIGINT) AS bin, n, round(mc + 1e-9, 6) AS mean_confidence, round(ms + 1e-9, 6) AS mean_success FROM bins"))
def reliability_points(spark, d):
    b = S.quantile_bins(runs(spark, d), "mode")
    return b.select("mode", "bin", "n", S.rounded(F.col("mean_confidence") + 1e-9).alias("mean_confidence"), S.rounded(F.col("mean_success") + 1e-9).alias("mean_success"))


@register("global_row_index", sql(f"WITH {BINS.rsplit(', bins AS', 1)[0].rsplit('),', 1)[0]}) SELECT mode, confidence, n, CAST(k AS BIGINT) AS k, CAST(coalesce(sum(n) OVER (PARTITION BY mode ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(n) OVER (PARTITION BY mode) AS BIGINT) AS total FROM sums"))
def global_row_index(spark, d):
    return S.confidence_rows(runs(spark, d), "mode")


@register("calibration_bins", sql("""
SELECT mode, bin, count(*) AS n, round(avg(confidence), 6) AS avg_conf, round(avg(success), 6) AS accuracy, round(avg(success) - avg(confidence), 6) AS gap
FROM (SELECT *, CAST(greatest(1, ceil(confidence * 5)) AS INTEGER) AS bin FROM runs WHERE confidence BETWEEN 0 AND 1) GROUP BY mode, bin"""))
def calibration_bins(spark, d):
    return S.fixed_bins(runs(spark, d), "mode")


SIGNALS = "signals AS (SELECT *, confidence AS mem_top, steps / 6.0 AS search_top, product % 3 = 0 AS sym_fired FROM runs)"
GRID = [round(0.1 * i, 1) for i in range(1, 10)]


def signals(spark, d):
    return runs(spark, d).withColumns({"mem_top": F.col("confidence"), "search_top": F.col("steps") / 6.0, "sym_fired": F.col("product") % 3 == 0})


@register("router_threshold_sweep", sql(f"""WITH {SIGNALS}, grid AS (SELECT a.t AS t_mem, b.t AS t_search FROM (SELECT unnest({GRID})::DOUBLE AS t) a, (SELECT unnest({GRID})::DOUBLE AS t) b),
cell AS (SELECT mem_top, search_top, sym_fired, count(*) AS n, sum(success) AS k FROM signals GROUP BY ALL),
g AS (SELECT t_mem, t_search, CASE WHEN mem_top >= t_mem THEN 'mem' WHEN search_top >= t_search THEN 'search' WHEN sym_fired THEN 'sym' ELSE 'rest' END AS g, sum(k) / sum(n) AS accuracy FROM cell, grid GROUP BY ALL)
SELECT t_mem, t_search, round(sum(accuracy) / 4, 6) AS score FROM g GROUP BY t_mem, t_search"""))
def router_threshold_sweep(spark, d):
    return S.router_threshold_sweep(signals(spark, d), GRID)


ISOTONIC = """
sums AS (SELECT mode, confidence, count(*) AS n, sum(success) AS k, row_number() OVER (PARTITION BY mode ORDER BY confidence) AS i FROM runs GROUP BY mode, confidence),
run AS (SELECT a.mode, a.i AS j, b.i AS l, sum(b.k) OVER (PARTITION BY a.mode, a.i ORDER BY b.i) / sum(b.n) OVER (PARTITION BY a.mode, a.i ORDER BY b.i) AS m FROM sums a JOIN sums b ON a.mode = b.mode AND b.i >= a.i),
low AS (SELECT mode, j, i, min(m) AS m FROM run JOIN (SELECT mode AS sm, i FROM sums) s ON s.sm = run.mode AND run.l >= s.i AND run.j <= s.i GROUP BY mode, j, i),
fit AS (SELECT mode, i, max(m) AS calibrated FROM low GROUP BY mode, i),
fitted AS (SELECT sums.mode, confidence, round(calibrated, 6) AS calibrated FROM fit JOIN sums ON fit.mode = sums.mode AND fit.i = sums.i)"""


@register("isotonic_calibrate", sql(f"WITH {ISOTONIC} SELECT * FROM fitted"))
def isotonic_calibrate(spark, d):
    return S.isotonic(runs(spark, d), "mode")


@register("interpolate_lookup", sql(f"""WITH {ISOTONIC},
maps AS (SELECT mode, list(calibrated ORDER BY g) AS map FROM (
 SELECT g.mode, g.g, CASE WHEN lo.c IS NULL THEN hi.v WHEN hi.c IS NULL THEN lo.v ELSE lo.v + (hi.v - lo.v) / (hi.c - lo.c) * (g.g / 100.0 - lo.c) END AS calibrated
 FROM (SELECT DISTINCT mode, g FROM fitted, (SELECT unnest(range(0, 101)) AS g)) g
 LEFT JOIN LATERAL (SELECT max(confidence) AS c, max_by(calibrated, confidence) AS v FROM fitted f WHERE f.mode = g.mode AND f.confidence <= g.g / 100.0) lo ON true
 LEFT JOIN LATERAL (SELECT min(confidence) AS c, min_by(calibrated, confidence) AS v FROM fitted f WHERE f.mode = g.mode AND f.confidence > g.g / 100.0) hi ON true) GROUP BY mode),
x AS (SELECT runs.*, map, greatest(0.0, least(1.0, confidence)) * 100 AS x, CAST(least(floor(greatest(0.0, least(1.0, confidence)) * 100), 99) AS INTEGER) AS low FROM runs JOIN maps USING (mode))
SELECT mode, count(*) AS n, round(avg(map[low + 1] + (map[low + 2] - map[low + 1]) * (x - low)), 5) AS mean_calibrated FROM x GROUP BY mode"""))
def interpolate_lookup(spark, d):
    df = runs(spark, d)
    done = S.interpolate(df, S.calibration_map(S.isotonic(df, "mode"), "mode"), "mode")
    return done.groupBy("mode").agg(F.count("*").alias("n"), S.rounded(F.avg("calibrated"), 5).alias("mean_calibrated"))


@register("paired_differences", sql("""
WITH p AS (SELECT max(success) FILTER (WHERE mode = 'M1') - max(success) FILTER (WHERE mode = 'M2') AS diff FROM runs GROUP BY domain, id)
SELECT count(*) AS n, count(*) FILTER (WHERE diff > 0) AS plus, count(*) FILTER (WHERE diff = 0) AS zero, count(*) FILTER (WHERE diff < 0) AS minus FROM p WHERE diff IS NOT NULL"""))
def paired_differences(spark, d):
    return S.paired_differences(runs(spark, d), "M1", "M2")


RESAMPLES = 200
COUNT = " + ".join(f"CASE WHEN draw >= {b} THEN 1 ELSE 0 END" for b in S.poisson_bounds())


def bootstrap_sql(rows, keys):
    """SQL twin of the Poisson bootstrap over `rows` (keys, unit, x)."""
    k = "".join(f"{c}, " for c in keys)
    by = "GROUP BY " + ", ".join(keys) if keys else ""
    return f"""SELECT {k}n, round(mean, 6) AS mean, round(m[CAST(floor((len(m) - 1) * 25 / 1000.0) AS INTEGER) + 1], 6) AS ci_low, round(m[CAST(ceil((len(m) - 1) * 975 / 1000.0) AS INTEGER) + 1], 6) AS ci_high,
round(least(1.0, 2 * least(len(list_filter(m, lambda x: x <= 0)) / len(m), len(list_filter(m, lambda x: x >= 0)) / len(m))), 6) AS p_value FROM (
  SELECT {k}list_sort(list(round(s / w, 12)) FILTER (w > 0)) AS m FROM (SELECT {k}b, sum(w * c) AS w, sum(w * t) AS s FROM (
    SELECT {k}c, t, b, {COUNT} AS w FROM (SELECT {k}c, t, b, ('0x' || substr(md5(CAST(bucket AS VARCHAR) || '|' || CAST(b AS VARCHAR)), 1, 8))::BIGINT AS draw FROM (
      SELECT {k}('0x' || substr(md5(unit), 1, 8))::BIGINT % {S.POISSON_BUCKETS} AS bucket, count(*) AS c, sum(x) AS t FROM ({rows}) GROUP BY {k}bucket), (SELECT unnest(range(1, {RESAMPLES + 1})) AS b)))
  GROUP BY {k}b) {by}) m {f"JOIN (SELECT {k}count(*) AS n, avg(x) AS mean FROM ({rows}) {by}) USING ({', '.join(keys)})" if keys else f", (SELECT count(*) AS n, avg(x) AS mean FROM ({rows}))"}"""


def rounded_bounds(df):
    return df.withColumns({c: S.rounded(F.col(c)) for c in ("mean", "ci_low", "ci_high", "p_value")})


PAIRS = "SELECT id AS unit, a - b AS x FROM (SELECT id, CAST(max(success) FILTER (WHERE mode = 'M1') AS DOUBLE) AS a, max(success) FILTER (WHERE mode = 'M2') AS b FROM runs GROUP BY domain, id) WHERE a IS NOT NULL AND b IS NOT NULL"


@register("paired_bootstrap", sql(bootstrap_sql(PAIRS, ())))
def paired_bootstrap(spark, d):
    """Mean difference of M1 and M2 over the questions that both answered."""
    pairs = R.paired_modes(runs(spark, d), "M1", "M2").withColumn("x", F.col("success_a") - F.col("success_b"))
    return rounded_bounds(S.poisson_bootstrap(pairs, (), "id", "x", RESAMPLES))


GROUPS = "SELECT mode, 'all' AS type, 'pooled' AS domain, id AS unit, CAST(success AS DOUBLE) AS x FROM runs UNION ALL SELECT mode, type, 'pooled', id, success FROM runs UNION ALL SELECT mode, 'all', domain, id, success FROM runs"


@register("bootstrap_ci", sql(bootstrap_sql(GROUPS, ("mode", "type", "domain"))))
def bootstrap_ci(spark, d):
    """Mean success by mode, mode and type, domain and mode: one pass over the runs for all three."""
    df = runs(spark, d).select("id", "success", "mode", F.explode(F.array(
        F.struct(F.lit("all").alias("type"), F.lit("pooled").alias("domain")), F.struct(F.col("type"), F.lit("pooled").alias("domain")), F.struct(F.lit("all").alias("type"), F.col("domain")))).alias("g"))
    return rounded_bounds(S.poisson_bootstrap(df.select("id", "success", "mode", "g.type", "g.domain"), ("mode", "type", "domain"), "id", "success", RESAMPLES))


@register("multinomial_bootstrap")
def multinomial_bootstrap(spark, d):
    """The form that draws resamples from counts alone."""
    return S.paired_bootstrap(runs(spark, d), "M1", "M2")


@register("effect_sizes_basic", sql("""
WITH p AS (SELECT max(success) FILTER (WHERE mode = 'M1') AS a, max(success) FILTER (WHERE mode = 'M2') AS b FROM runs GROUP BY domain, id HAVING a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round(avg(CASE WHEN a > b THEN 1 ELSE 0 END) - avg(CASE WHEN a < b THEN 1 ELSE 0 END), 6) AS cliffs_delta, round(avg(a - b) / (coalesce(stddev_samp(a - b), 0) + 1e-12), 6) AS cohens_d,
round(2 * asin(sqrt(avg(a))) - 2 * asin(sqrt(avg(b))), 6) AS cohens_h, round(avg(a) - avg(b), 6) AS delta_accuracy FROM p"""))
def effect_sizes_basic(spark, d):
    return S.effect_sizes(runs(spark, d), "M1", "M2")


SELECTIVE = f"""
scoped AS (SELECT unnest([domain, 'pooled']) AS domain, mode, success, steps, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE confidence END AS confidence FROM runs),{CURVE.replace("mode", "domain, mode").replace("FROM runs", "FROM scoped")},
areas AS (SELECT domain, mode, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS area FROM curve WINDOW w AS (PARTITION BY domain, mode ORDER BY coverage, threshold DESC)),
a AS (SELECT domain, mode, round(sum(area), 6) AS aurc FROM areas GROUP BY domain, mode),
r AS (SELECT domain, mode, max(risk) FILTER (threshold = 0.3) AS risk_30, max(risk) FILTER (threshold = 0.5) AS risk_50, max(risk) FILTER (threshold = 0.7) AS risk_70 FROM curve GROUP BY domain, mode),
acc AS (SELECT domain, mode, avg(success) AS accuracy, avg(steps) AS cost FROM scoped GROUP BY domain, mode),
util AS (SELECT *, CASE WHEN domain <> 'pooled' THEN accuracy - 0.3 * coalesce(cost, 0) / greatest(1.0, max(cost) OVER (PARTITION BY domain)) END AS utility FROM acc),
effects AS (SELECT * FROM util JOIN r USING (domain, mode) JOIN a USING (domain, mode))"""


def selective_effects(df, baseline):
    """Each mode against `baseline`, by domain and over all of them ('pooled').

    risk_reduction at 0.3, 0.5 and 0.7 and aurc_delta: the baseline's less the mode's; delta_accuracy and delta_utility: the mode's less
    the baseline's. Utility is accuracy less 0.3 times the mean steps, which count as a share of the domain's greatest (1 at least);
    there is none over all domains. A missing confidence counts as 0; a domain without the baseline has no rows. Runs are summed once.
    """
    confidence = F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))
    sums = df.groupBy("domain", "mode", S.levels_of(confidence).alias("_at")).agg(
        F.count("*").alias("_n"), F.coalesce(F.sum("success"), F.lit(0)).alias("_k"), F.sum("steps").alias("steps"), F.count("steps").alias("counted")
    )
    each = sums.withColumn("domain", F.explode(F.array("domain", F.lit("pooled"))))
    levels = written(each.groupBy("domain", "mode", "_at").agg(*[F.sum(c).alias(c) for c in ("_n", "_k", "steps", "counted")]), "levels")
    curve = S.curve_of(levels, "domain", "mode")
    risks = [F.max(F.when(F.round("threshold", 4) == t, F.col("risk"))).alias(f"risk_{round(100 * t)}") for t in (0.3, 0.5, 0.7)]
    acc = levels.groupBy("domain", "mode").agg((F.sum("_k") / F.sum("_n")).alias("accuracy"), (F.sum("steps") / F.nullif(F.sum("counted"), F.lit(0))).alias("cost"))
    share = F.coalesce("cost", F.lit(0.0)) / F.greatest(F.lit(1.0), F.max("cost").over(Window.partitionBy("domain")))
    util = acc.withColumn("utility", F.when(F.col("domain") != "pooled", F.col("accuracy") - 0.3 * share))
    both = util.join(curve.groupBy("domain", "mode").agg(*risks), ["domain", "mode"]).join(S.aurc(curve, "domain", "mode"), ["domain", "mode"])
    names = ("risk_30", "risk_50", "risk_70", "aurc", "accuracy", "utility")
    base = both.filter(F.col("mode") == baseline).select("domain", *[F.col(c).alias(f"b_{c}") for c in names])
    minus = lambda c: F.col(f"b_{c}") - F.col(c)
    return both.filter(F.col("mode") != baseline).join(base, "domain").select(
        "domain", "mode", F.lit(baseline).alias("baseline"), *[S.rounded(minus(f"risk_{t}")).alias(f"risk_reduction_{t}") for t in (30, 50, 70)],
        S.rounded(minus("aurc")).alias("aurc_delta"), S.rounded(-minus("accuracy")).alias("delta_accuracy"), S.rounded(-minus("utility"), 5).alias("delta_utility"),
    )


@register("effect_sizes_selective", sql(f"""WITH {SELECTIVE}
SELECT x.domain, x.mode, 'M1' AS baseline, round(b.risk_30 - x.risk_30, 6) AS risk_reduction_30, round(b.risk_50 - x.risk_50, 6) AS risk_reduction_50, round(b.risk_70 - x.risk_70, 6) AS risk_reduction_70, round(b.aurc - x.aurc, 6) AS aurc_delta,
round(x.accuracy - b.accuracy, 6) AS delta_accuracy, round(x.utility - b.utility, 5) AS delta_utility FROM effects x JOIN effects b ON x.domain = b.domain AND b.mode = 'M1' WHERE x.mode <> 'M1'"""))
def effect_sizes_selective(spark, d):
    return selective_effects(runs(spark, d), "M1")


@register("baseline_compare", sql("""
WITH s AS (SELECT domain, mode, avg(success) AS a, avg(latency_ms) AS c FROM runs GROUP BY domain, mode)
SELECT x.domain, x.mode, round(x.a - coalesce(b.a, 0), 6) AS delta_accuracy, round(x.c - coalesce(b.c, 0), 4) AS delta_cost FROM s x LEFT JOIN s b ON b.domain = x.domain AND b.mode = 'M2'"""))
def baseline_compare(spark, d):
    s = runs(spark, d).groupBy("domain", "mode").agg(F.avg("success").alias("a"), F.avg("latency_ms").alias("c"))
    b = s.filter("mode = 'M2'").select("domain", F.col("a").alias("ba"), F.col("c").alias("bc"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.join(b, "domain", "left").select("domain", "mode", S.rounded(F.col("a") - zero("ba")).alias("delta_accuracy"), S.rounded(F.col("c") - zero("bc"), 4).alias("delta_cost"))


@register("sym_coverage", sql(f"""WITH {SIGNALS} SELECT CASE WHEN grouping(mode) = 1 THEN 'ALL' ELSE mode END AS mode, count(*) AS n_total, count(*) FILTER (WHERE sym_fired) AS fired_n,
round(count(*) FILTER (WHERE sym_fired) / count(*), 6) AS coverage, round(coalesce(avg(success) FILTER (WHERE sym_fired), 0), 6) AS precision FROM signals WHERE mode <> 'M7' GROUP BY ROLLUP (mode)"""))
def sym_coverage(spark, d):
    return S.sym_coverage(signals(spark, d), exclude=("M7",))


ALPHAS = [round(0.1 * i, 1) for i in range(11)]


@register("pareto_sweep", sql(f"""SELECT alpha, round(a, 6) AS accuracy, round(c, 6) AS avg_cost, round(s, 6) AS avg_steps, n, round(a - alpha * c, 6) AS utility
FROM (SELECT avg(success) AS a, avg(steps / 6.0) AS c, avg(steps) AS s, count(*) AS n FROM runs), (SELECT unnest({ALPHAS})::DOUBLE AS alpha)"""))
def pareto_sweep(spark, d):
    return S.pareto_sweep(runs(spark, d).withColumn("cost", F.col("steps") / 6.0), ALPHAS)


@register("acceptance_check", sql("SELECT count(*) AS n_rows, count(DISTINCT id) * count(DISTINCT mode) AS expected, count(*) = count(DISTINCT id) * count(DISTINCT mode) AS complete FROM runs"))
def acceptance_check(spark, d):
    e = F.count_distinct("id") * F.count_distinct("mode")
    return runs(spark, d).agg(F.count("*").alias("n_rows"), e.alias("expected")).withColumn("complete", F.col("n_rows") == F.col("expected"))


@register("paper_numbers", sql("""
SELECT kind, value, n FROM (SELECT 'total' AS kind, 'all' AS value, count(DISTINCT id) AS n FROM runs UNION ALL SELECT 'domain', domain, count(DISTINCT id) FROM runs GROUP BY domain UNION ALL SELECT 'type', type, count(DISTINCT id) FROM runs GROUP BY type)"""))
def paper_numbers(spark, d):
    sets = runs(spark, d).groupingSets([[], ["domain"], ["type"]], "domain", "type").agg(F.count_distinct("id").alias("n"))
    kind = F.when(F.col("domain").isNotNull(), "domain").when(F.col("type").isNotNull(), "type").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("domain", "type", F.lit("all")).alias("value"), "n")


@register("mode_drop_summary", sql("""
WITH base AS (SELECT id, success FROM runs WHERE mode = 'M1' AND success = 1), knocked AS (SELECT id, success AS without FROM runs WHERE mode = 'M2')
SELECT count(*) AS n_correct, round(avg(greatest(0, success - without)), 6) AS mean_drop, round(avg(CASE WHEN success > without THEN 1 ELSE 0 END), 6) AS share_dropped FROM base JOIN knocked USING (id)"""))
def mode_drop_summary(spark, d):
    pairs = R.paired_modes(runs(spark, d), "M1", "M2", ["id"]).filter("success_a = 1")
    drop = F.greatest(F.lit(0), F.col("success_a") - F.col("success_b"))
    return pairs.agg(F.count("*").alias("n_correct"), S.rounded(F.avg(drop)).alias("mean_drop"), S.rounded(F.avg((drop > 0).cast("int"))).alias("share_dropped"))


@register("mode_drop_join", sql("""
WITH base AS (SELECT id, success FROM runs WHERE mode = 'M1' AND success = 1)
SELECT base.id, r.mode AS ablation, greatest(0, base.success - r.success) AS delta FROM base JOIN runs r ON r.id = base.id WHERE r.mode IN ('M2', 'M3', 'M4')"""))
def mode_drop_join(spark, d):
    df = runs(spark, d)
    base = df.filter("mode = 'M1' and success = 1").select("id", F.col("success").alias("base"))
    ablated = df.filter(F.col("mode").isin("M2", "M3", "M4"))
    return ablated.join(base, "id").select("id", F.col("mode").alias("ablation"), F.greatest(F.lit(0), F.col("base") - F.col("success")).alias("delta"))


@register("mode_drops", sql("""
WITH base AS (SELECT id, success FROM runs WHERE mode = 'M1' AND success = 1)
SELECT r.mode AS ablation, count(*) AS n, round(avg(greatest(0, base.success - r.success)), 6) AS mean_drop, round(avg(CASE WHEN base.success > r.success THEN 1 ELSE 0 END), 6) AS share_dropped,
count(*) FILTER (WHERE base.success > r.success) AS n_dropped FROM base JOIN runs r ON r.id = base.id WHERE r.mode <> 'M1' GROUP BY r.mode"""))
def mode_drops(spark, d):
    """What each other mode loses of what M1 has right."""
    return S.ablation_drops(runs(spark, d), "M1")


@register("robustness_by_setting", sql("""
SELECT setting, param, mode, count(*) AS n, round(avg(success), 6) AS accuracy, round(avg(latency_ms), 4) AS avg_latency_ms, round(avg(steps / 6.0), 6) AS avg_cost
FROM (SELECT *, 'steps' AS setting, CAST(steps AS VARCHAR) AS param FROM runs UNION ALL SELECT *, 'type', type FROM runs) GROUP BY setting, param, mode"""))
def robustness_by_setting(spark, d):
    df = runs(spark, d).withColumn("cost", F.col("steps") / 6.0)
    return S.by_setting(df, {"steps": F.col("steps").cast("string"), "type": F.col("type")})


@register("latest_run_per_domain", sql("WITH m AS (SELECT domain AS dm, max(run_id) AS r FROM runs GROUP BY domain) SELECT domain, run_id, count(*) AS n FROM runs JOIN m ON domain = dm AND run_id = r GROUP BY domain, run_id"))
def latest_run_per_domain(spark, d):
    return R.latest_run_per_domain(runs(spark, d)).groupBy("domain", "run_id").agg(F.count("*").alias("n"))


@register("latest_run", sql("WITH m AS (SELECT max_by(run_id, (CASE WHEN run_id LIKE '1996%' THEN 1 ELSE 0 END) * 1000000 + CAST(substr(run_id, 1, 6) AS INTEGER)) AS r FROM runs) SELECT id, mode, run_id FROM runs, m WHERE run_id = r"))
def latest_run(spark, d):
    return R.latest_run(runs(spark, d), F.col("run_id").startswith("1996").cast("int")).select("id", "mode", "run_id")


NAMED = """named AS (SELECT 'runs/eval_joined_' || domain || '_' || run_id || CASE WHEN run_id LIKE '1997%' THEN '_calibrated' ELSE '' END || '.csv' AS path, max(latency_ms) AS changed, domain, run_id AS stamp, run_id LIKE '1997%' AS calibrated FROM runs GROUP BY domain, run_id),
traces AS (SELECT 'runs/trace_' || run_id || '.jsonl' AS path, run_id AS stamp, max(latency_ms) AS changed FROM runs WHERE run_id LIKE '%0__000000' OR run_id LIKE '1996%' GROUP BY run_id)"""


@register("latest_files", sql(f"""WITH {NAMED}, chosen AS (SELECT 'newest of domain' AS choice, * FROM named QUALIFY row_number() OVER (PARTITION BY domain ORDER BY changed DESC, path DESC) = 1
UNION ALL (SELECT 'calibrated first', * FROM named ORDER BY calibrated DESC, changed DESC, path DESC LIMIT 1) UNION ALL SELECT 'joined', * FROM named WHERE NOT calibrated)
SELECT choice, c.path, coalesce(t.path, (SELECT max_by(path, changed) FROM traces)) AS trace FROM chosen c LEFT JOIN traces t USING (stamp)"""))
def latest_files(spark, d):
    """Choices from a catalogue of files named by the domains and months of all runs."""
    df, month = runs(spark, d), F.col("run_id")
    named = df.groupBy("domain", "run_id").agg(F.max("latency_ms").alias("changed"))
    suffix = F.when(month.startswith("1997"), "_calibrated").otherwise("")
    paths = named.select(F.concat(F.lit("runs/eval_joined_"), "domain", F.lit("_"), month, suffix, F.lit(".csv")).alias("path"), "changed")
    traces = df.filter(month.like("%0__000000") | month.startswith("1996")).groupBy("run_id").agg(F.max("latency_ms").alias("changed"))
    files = written(C.catalogue(paths.unionByName(traces.select(F.concat(F.lit("runs/trace_"), month, F.lit(".jsonl")).alias("path"), "changed"))), "catalogue")
    tagged = lambda name, rows: C.with_traces(rows, files).select(F.lit(name).alias("choice"), "path", "trace")
    return tagged("newest of domain", C.newest_by_domain(files)).unionByName(tagged("calibrated first", C.calibrated_first(files))).unionByName(tagged("joined", C.joined_runs(files)))


@register("failure_sample", sql("SELECT id, mode, type FROM runs WHERE success = 0 ORDER BY id, mode LIMIT 20"))
def failure_sample(spark, d):
    return R.failure_sample(runs(spark, d)).select("id", "mode", "type")


@register("first_per_key", sql("SELECT mode, id FROM (SELECT mode, id, row_number() OVER (PARTITION BY mode ORDER BY id) AS nth FROM runs) WHERE nth <= 5"))
def first_per_key(spark, d):
    return R.cap_per_group(runs(spark, d).select("mode", "id"), ["mode"], ["id"], 5)


@register("sample_per_group", sql("SELECT mode, success, id FROM (SELECT mode, success, id, row_number() OVER (PARTITION BY mode, success ORDER BY md5(id || '13'), id) AS nth FROM runs) WHERE nth <= 3"))
def sample_per_group(spark, d):
    return R.sample_per_group(runs(spark, d).select("mode", "success", "id"), ["mode", "success"], "id", 3)


@register("best_label", sql("""
SELECT id, mode AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY success DESC, latency_ms, steps, mode) AS nth FROM runs WHERE mode IN ('M1', 'M2', 'M3')) WHERE nth = 1 AND success = 1"""))
def best_label(spark, d):
    from tessera.operators.routing import best_label as label

    return label(runs(spark, d), MODES)


@register("union_runs", sql("SELECT id, mode, success, 'a' AS origin FROM runs WHERE mode = 'M1' UNION ALL SELECT id, mode, success, 'b' FROM runs WHERE mode = 'M2'"))
def union_runs(spark, d):
    df = runs(spark, d).select("id", "mode", "success")
    return df.filter("mode = 'M1'").withColumn("origin", F.lit("a")).unionByName(df.filter("mode = 'M2'").withColumn("origin", F.lit("b")))


@register("pool_runs", sql("SELECT domain, count(*) AS n FROM runs GROUP BY domain"))
def pool_runs(spark, d):
    """Runs of all domains, each kept in its own folder, as one table: whatever domains there are."""
    df, path = runs(spark, d).drop("run_id"), scratch(spark, "runs-by-domain")
    df.write.partitionBy("domain").parquet(path)
    return spark.read.schema(df.schema).parquet(path).groupBy("domain").agg(F.count("*").alias("n"))


@register("merge_unique", sql("SELECT id, mode FROM (SELECT id, mode, row_number() OVER (PARTITION BY id ORDER BY o, mode) AS nth FROM (SELECT id, mode, 1 AS o FROM runs WHERE mode = 'M2' UNION ALL SELECT id, mode, 2 FROM runs WHERE mode = 'M3')) WHERE nth = 1"))
def merge_unique(spark, d):
    df = runs(spark, d).select("id", "mode")
    both = df.filter("mode = 'M2'").withColumn("o", F.lit(1)).unionByName(df.filter("mode = 'M3'").withColumn("o", F.lit(2)))
    return R.dedup_keep_first(both, ["id"], ["o", "mode"]).select("id", "mode")


@register("key_intersection", sql("SELECT id FROM runs WHERE mode = 'M1' INTERSECT SELECT id FROM runs WHERE mode = 'M2'"))
def key_intersection(spark, d):
    df = runs(spark, d)
    return df.filter("mode = 'M1'").select("id").intersect(df.filter("mode = 'M2'").select("id"))


@register("sort_tables", sql("SELECT mode, round(avg(success), 6) AS accuracy FROM runs GROUP BY mode ORDER BY accuracy DESC, mode"))
def sort_tables(spark, d):
    return runs(spark, d).groupBy("mode").agg(S.rounded(F.avg("success")).alias("accuracy")).orderBy(F.desc("accuracy"), "mode")


@register("dataset_counts", sql("""
SELECT domain, type, CASE WHEN ('0x' || substr(md5(id), 1, 8))::BIGINT / 4294967295.0 < 0.3 THEN 'dev' ELSE 'test' END AS split, count(DISTINCT id) AS n FROM runs GROUP BY ALL"""))
def dataset_counts(spark, d):
    from tessera.operators.text import hash_split

    return runs(spark, d).select("domain", "type", "id").distinct().withColumn("split", hash_split(F.col("id"))).groupBy("domain", "type", "split").agg(F.count("*").alias("n"))


@register("raw_run_counts", with_views("SELECT mode, count(*) AS n FROM raw_runs GROUP BY mode", "raw_runs"))
def raw_run_counts(spark, d):
    return raw_runs(spark, d).groupBy("mode").agg(F.count("*").alias("n"))
