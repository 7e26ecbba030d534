"""Evaluation statistics over run tables: every result is small, and every input is reduced by partial aggregates first."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.sources.shared import written

#: Two-sided 95 % quantile of the normal distribution, to the digits that the published tables use.
Z95 = 1.96
THRESHOLDS = [round(i * 0.02, 4) for i in range(51)]
#: Ranges of a group's confidences that are ranked and pooled by themselves, and the step of the coarse search among their bounds.
SLOTS = 1024
STRIDE = 32


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by keys, where null equals null; the keys are those of `a`."""
    other = [f"_key{i}" for i in range(len(keys))]
    b = b.withColumnsRenamed(dict(zip(keys, other, strict=True)))
    return a.join(b, reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(keys, other, strict=True)], F.lit(True)), how).drop(*other)


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """n, accuracy, mean and exact median latency, and mean steps of each group.

    No task holds the latencies of a group: a sketch in the first pass bounds the middle, and the second pass counts the values
    between the bounds, a five-hundredth of the rows; all others are clipped to the bounds. The sketch's ranks are off by
    1/10,000 of the rows at most, so the median lies well inside.
    """
    first = df.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(F.avg("success"), 4).alias("accuracy"), rounded(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
        rounded(F.avg("steps"), 2).alias("avg_steps"), F.percentile_approx("latency_ms", [0.499, 0.501], 10_000).alias("_bounds"), F.count("latency_ms").alias("_known"),
    )
    clipped = F.greatest(F.get("_bounds", F.lit(0)), F.least(F.get("_bounds", F.lit(1)), F.col("latency_ms"))).alias("_value")
    rows = joined(df.filter(F.col("latency_ms").isNotNull()).select(*keys, "latency_ms"), first.select(*keys, "_bounds", "_known"), keys)
    counts = rows.groupBy(*keys, "_known", clipped).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_value"))
    # of m values those of rank (m + 1) div 2 and m div 2 + 1 are the middle ones
    low, high = F.expr("(_known + 1) div 2"), F.expr("_known div 2 + 1")
    middle = counts.withColumn("_upto", upto).groupBy(*keys).agg(((F.min(F.when(F.col("_upto") >= low, F.col("_value"))) + F.min(F.when(F.col("_upto") >= high, F.col("_value")))) / 2).alias("_median"))
    return joined(first, middle, keys, "left").select(*keys, "n", "accuracy", "avg_latency_ms", rounded(F.col("_median"), 2).alias("median_latency_ms"), "avg_steps")


def wilson(n: Column, k: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k successes in n, within [0, 1]; (0, 0) without cases."""
    p = k / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.0))
    return bound(middle - half), bound(middle + half)


def acc_ci(df: DataFrame) -> DataFrame:
    """Accuracy with its interval for (mode, domain, type), (mode, domain), (mode, type) and (mode), in one pass."""
    sets = df.groupingSets([["mode", "domain", "type"], ["mode", "domain"], ["mode", "type"], ["mode"]], "mode", "domain", "type").agg(
        F.count("*").alias("n"), F.sum("success").cast("long").alias("k"), F.grouping("domain").alias("no_domain"), F.grouping("type").alias("no_type")
    )
    low, high = wilson(F.col("n"), F.col("k"))
    domain, kind = F.when(F.col("no_domain") == 1, "pooled").otherwise(F.col("domain")), F.when(F.col("no_type") == 1, "all").otherwise(F.col("type"))
    return sets.select("mode", domain.alias("domain"), kind.alias("type"), "n", rounded(F.col("k") / F.col("n")).alias("accuracy"), rounded(low).alias("ci_low"), rounded(high).alias("ci_high"))


@F.pandas_udf(DoubleType())
def exact_binomial(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact p of b and c discordant pairs; 1 without any. Runs on aggregated rows only.

    The tail is the likeliest term times the sum of the ratios below it, which ends where they no longer count: after about
    the square root of n terms, whatever n is, and without a list of them.
    """

    def p(b: int, c: int) -> float:
        n, k = int(b + c), int(min(b, c))
        if not n:
            return 1.0
        top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        ratio = total = 1.0
        while k and ratio > total * 1e-17:
            ratio *= k / (n - k + 1)
            total += ratio
            k -= 1
        return min(1.0, 2 * math.exp(top) * total)

    return pd.Series([p(x, y) for x, y in zip(b, c, strict=True)])


def mcnemar(df: DataFrame, baseline: str) -> DataFrame:
    """Discordant counts and exact p of every other mode against `baseline`, by domain and pooled; keys are (domain, id)."""
    base = df.filter(F.col("mode") == baseline).groupBy("domain", "id").agg(F.max("success").alias("base"))
    pairs = df.filter(F.col("mode") != baseline).join(base, ["domain", "id"])
    counts = [F.count_if((F.col("success") == 1) & (F.col("base") == 0)).alias("b"), F.count_if((F.col("success") == 0) & (F.col("base") == 1)).alias("c"), F.count("*").alias("n_pairs")]
    sets = pairs.groupingSets([["mode", "domain"], ["mode"]], "mode", "domain").agg(*counts, F.grouping("domain").alias("g"))
    return sets.select("mode", F.when(F.col("g") == 1, "pooled").otherwise(F.col("domain")).alias("domain"), "b", "c", "n_pairs", exact_binomial("b", "c").alias("p_value"))


def selective_curve(df: DataFrame, *keys: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """coverage, accuracy (0 if empty), risk (1 if empty) and n of rows with confidence >= threshold, at each threshold.

    One pass: a row counts once, at the number of thresholds it reaches; a reverse running sum over those few rows follows.
    """
    reached = df.filter(F.col("confidence").isNotNull()).withColumn("_at", levels_of(F.col("confidence"), thresholds))
    return curve_of(reached.groupBy(*keys, "_at").agg(F.count("*").alias("_n"), F.sum("success").alias("_k")), *keys, thresholds=thresholds)


def levels_of(confidence: Column, thresholds: Sequence[float] = THRESHOLDS) -> Column:
    """The number of thresholds that a confidence reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= confidence))


def curve_of(steps: DataFrame, *keys: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """`selective_curve` of the numbers of rows (_n) and of successes (_k) by keys and level (_at)."""
    taus = F.array(*[F.lit(float(t)) for t in thresholds])
    total = steps.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    grid = total.select(*keys, "_total", F.posexplode(taus).alias("_place", "threshold"))
    at = grid.join(steps.withColumnRenamed("_at", "_level"), list(keys), "left") if keys else grid.crossJoin(steps.withColumnRenamed("_at", "_level"))
    kept = at.groupBy(*keys, "_total", "threshold").agg(
        F.sum(F.when(F.col("_level") > F.col("_place"), F.col("_n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("_level") > F.col("_place"), F.col("_k")).otherwise(0)).alias("_s")
    )
    accuracy = F.when(F.col("n") > 0, F.col("_s") / F.col("n")).otherwise(F.lit(0.0))
    return kept.select(*keys, "threshold", rounded(F.col("n") / F.col("_total")).alias("coverage"), rounded(accuracy).alias("accuracy"), rounded(1 - accuracy).alias("risk"), F.col("n").cast("long").alias("n"))


def aurc(curve: DataFrame, *keys: str) -> DataFrame:
    """Area under risk over coverage by trapezoids; null with fewer than two points. A curve has at most 51 points."""
    over = Window.partitionBy(*keys).orderBy("coverage", F.desc("threshold"))
    step = (F.col("coverage") - F.lag("coverage").over(over)) * (F.col("risk") + F.lag("risk").over(over)) / 2
    return curve.withColumn("_area", step).groupBy(*keys).agg(rounded(F.when(F.count("*") >= 2, F.sum("_area"))).alias("aurc"))


def selective_deltas(df: DataFrame, baseline: str, taus: Sequence[float], *keys: str) -> DataFrame:
    """keys, mode, delta_aurc and delta_risk (array by tau): each mode's area and risks less the baseline's; a missing value counts as 0.

    Everything comes from curves of 51 points a group.
    """
    curve = written(selective_curve(df, *keys, "mode"), "curves")
    risks = F.array(*[F.max(F.when(F.round("threshold", 4) == t, F.col("risk"))) for t in taus])
    each = joined(curve.groupBy(*keys, "mode").agg(risks.alias("risks")), aurc(curve, *keys, "mode"), [*keys, "mode"])
    base = each.filter(F.col("mode") == baseline).select(*keys, F.col("risks").alias("_r"), F.col("aurc").alias("_a"))
    both = joined(each.filter(F.col("mode") != baseline), base, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    deltas = F.array(*[rounded(zero(F.get("risks", F.lit(i))) - zero(F.get("_r", F.lit(i)))) for i in range(len(taus))])
    return both.select(*keys, "mode", rounded(zero(F.col("aurc")) - zero(F.col("_a"))).alias("delta_aurc"), deltas.alias("delta_risk"))


def mcnemar_notes(df: DataFrame, baseline: str) -> DataFrame:
    """mode, n (discordant pairs), p_value and note of all modes: null p where there are no pairs, or none that differ."""
    modes = df.filter(F.col("mode") != baseline).select("mode").distinct()
    pooled = mcnemar(df, baseline).filter("domain = 'pooled'").select("mode", (F.col("b") + F.col("c")).alias("n"), "p_value", "n_pairs")
    n, pairs = F.coalesce("n", F.lit(0)), F.coalesce("n_pairs", F.lit(0))
    note = F.when(pairs == 0, "no overlap").when(n == 0, "no discordant pairs")
    return modes.join(pooled, "mode", "left").select("mode", n.cast("long").alias("n"), F.when(n > 0, F.col("p_value")).alias("p_value"), note.alias("note"))


def pick_threshold(curve: DataFrame, target: float, *keys: str) -> DataFrame:
    """The curve's row nearest the target coverage; ties by risk, then threshold."""
    order = Window.partitionBy(*keys).orderBy(rounded(F.abs(F.col("coverage") - target), 9), "risk", "threshold")
    return curve.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth").withColumn("target", F.lit(target))


def confidence_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and successes at each distinct confidence (clipped to [0, 1], nulls out) with the rows before it in its group.

    Ranks come from these sums, so a mode with a third of all rows isn't sorted by one task: rows are ranked inside their slot of
    the confidences, and the sums of the slots, SLOTS rows a group, are ranked beside them. Inside a tie every row has the tie's
    mean success.
    """
    sums = confidence_sums(df, *keys)
    slots = sums.groupBy(*keys, "slot").agg(F.sum("n").alias("_n"))
    earlier = lambda *c: Window.partitionBy(*keys, *c).rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(*keys, "slot", F.coalesce(F.sum("_n").over(earlier().orderBy("slot")), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("total"))
    inside = sums.withColumn("_inside", F.coalesce(F.sum("n").over(earlier("slot").orderBy("confidence")), F.lit(0)))
    return joined(inside, slots, [*keys, "slot"]).select(*keys, "confidence", "n", "k", (F.col("_before") + F.col("_inside")).alias("before"), "total")


def confidence_sums(df: DataFrame, *keys: str) -> DataFrame:
    """n and k (successes) at each distinct confidence, clipped to [0, 1], with its slot; nulls are out.

    Slots are ranges of a group's distinct confidences between sketched quantiles, so they hold about as many each, however close
    the confidences lie. The sums are written once: they are few beside the rows, and what follows reads them more than once.
    """
    clipped = df.filter(F.col("confidence").isNotNull()).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    sums = written(clipped.groupBy(*keys, "confidence").agg(F.count("*").alias("n"), F.sum("success").cast("long").alias("k")), "confidence-sums")
    places = F.array(*[F.lit(k / SLOTS) for k in range(1, SLOTS)])
    bounds = sums.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("confidence", places, F.lit(10 * SLOTS)))).alias("_bounds"))
    bounds = bounds.withColumn("_coarse", F.filter("_bounds", lambda b, i: i % STRIDE == STRIDE - 1))
    below = lambda c: F.size(F.filter(c, lambda b: b <= F.col("confidence")))
    # First among every STRIDE-th bound, and then among those before the next.
    slotted = joined(sums, bounds, keys).withColumn("_skip", below(F.col("_coarse")) * STRIDE)
    slot = F.col("_skip") + below(F.slice("_bounds", F.col("_skip") + 1, F.lit(STRIDE)))
    return slotted.withColumn("slot", slot).drop("_bounds", "_coarse", "_skip")


def quantile_bins(df: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """n, mean confidence and mean success of equal-count bins: row r of n falls in ((r + 1) * k - 1) div n, k = min(bins, n).

    A tie that spans an edge is divided between the bins in proportion.
    """
    sums = confidence_rows(df, *keys).withColumn("bins", F.least(F.lit(bins), F.col("total")))
    first = F.expr("((before + 1) * bins - 1) div total")
    last = F.expr("((before + n) * bins - 1) div total")
    parts = sums.withColumn("bin", F.explode(F.sequence(first, last)))
    # rows r with bin b: from ceil((b * total + 1) / bins) - 1 up to the next bin's first
    start = F.expr("(bin * total + bins) div bins - 1")
    stop = F.expr("((bin + 1) * total + bins) div bins - 1")
    share = F.least(F.col("before") + F.col("n"), stop) - F.greatest(F.col("before"), start)
    parts = parts.withColumn("m", share).filter("m > 0")
    return parts.groupBy(*keys, "bin").agg(
        F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("confidence")) / F.sum("m")).alias("mean_confidence"), (F.sum(F.col("m") * F.col("k") / F.col("n")) / F.sum("m")).alias("mean_success")
    )


def ece_quantile(df: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-count bins, with n and the number of bins."""
    binned = quantile_bins(df, *keys, bins=bins)
    gap = F.abs(F.col("mean_success") - F.col("mean_confidence")) * F.col("n")
    return binned.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_bins"), rounded(F.sum(gap) / F.sum("n")).alias("ece"))


def fixed_bins(df: DataFrame, *keys: str, bins: int = 5) -> DataFrame:
    """n, mean confidence, accuracy and their gap in right-closed bins of equal width; the first includes 0."""
    at = F.greatest(F.lit(1), F.ceil(F.col("confidence") * bins)).cast("int")
    binned = df.filter(F.col("confidence").between(0, 1)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg("success").alias("s"))
    return binned.select(*keys, "bin", "n", rounded(F.col("c")).alias("avg_conf"), rounded(F.col("s")).alias("accuracy"), rounded(F.col("s") - F.col("c")).alias("gap"))


def pooled_blocks(k: Sequence[int], n: Sequence[int]) -> list[int]:
    """Lengths of the blocks that pooling adjacent violators of k / n leaves."""
    blocks: list[list[int]] = []
    for one in zip(map(int, k), map(int, n), strict=True):
        blocks.append([*one, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    return [m for *_, m in blocks]


def isotonic(df: DataFrame, *keys: str) -> DataFrame:
    """Monotone fit of success on confidence at each distinct confidence, by pooling adjacent violators of the sums.

    Violators may be pooled in any order, so each slot of the confidences is pooled by its own task, and then the blocks of all
    slots of a group, which are few beside its rows. With fewer than two distinct confidences, or one class only, the fit is the
    identity.
    """
    sums = confidence_sums(df, *keys)
    types = dict(sums.dtypes)
    named = "".join(f"`{c}` {types[c]}, " for c in keys)

    def in_slot(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("confidence")
        lengths = pooled_blocks(rows["k"], rows["n"])
        return rows[[*keys, "slot", "confidence", "n", "k"]].assign(block=[i for i, m in enumerate(lengths) for _ in range(m)])

    def across(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["slot", "block"])
        number = [i for i, m in enumerate(pooled_blocks(blocks["k"], blocks["n"])) for _ in range(m)]
        whole = blocks.groupby(number)[["k", "n"]].transform("sum")
        trivial = blocks["rows"].sum() < 2 or blocks["k"].sum() in (0, blocks["n"].sum())
        return blocks[[*keys, "slot", "block"]].assign(calibrated=None if trivial else whole["k"] / whole["n"])

    rows = sums.groupBy(*keys, "slot").applyInPandas(in_slot, f"{named}slot int, confidence double, n long, k long, block long")
    blocks = rows.groupBy(*keys, "slot", "block").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("rows"))
    fits = blocks.groupBy(*keys).applyInPandas(across, f"{named}slot int, block long, calibrated double")
    return joined(rows, fits, [*keys, "slot", "block"]).select(*keys, "confidence", rounded(F.coalesce("calibrated", "confidence")).alias("calibrated"))


def calibration_map(fitted: DataFrame, key: str, points: int = 101) -> DataFrame:
    """The fit on an even grid of `points`, as an array for each group: linear between the fitted points, flat outside.

    Only the first and the last fitted point of each cell of the grid have a grid point as neighbour, so that is all that a
    group's array holds.
    """
    last = float(points - 1)
    place = F.ceil(F.col("confidence") * last)
    cell = F.when((place - 1) / last >= F.col("confidence"), place - 1).when(place / last < F.col("confidence"), place + 1).otherwise(place)
    point = F.struct("confidence", "calibrated")
    ends = fitted.groupBy(key, cell.alias("_cell")).agg(F.array(F.min(point), F.max(point)).alias("_ends"))
    knots = ends.groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_ends")))).alias("knots"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / F.lit(float(points - 1)))

    def at(x: Column) -> Column:
        below = F.filter(F.col("knots"), lambda k: k["confidence"] <= x)
        above = F.filter(F.col("knots"), lambda k: k["confidence"] > x)
        a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
        slope = (b["calibrated"] - a["calibrated"]) / (b["confidence"] - a["confidence"])
        return F.when(F.size(below) == 0, b["calibrated"]).when(F.size(above) == 0, a["calibrated"]).otherwise(a["calibrated"] + slope * (x - a["confidence"]))

    return knots.select(key, F.transform(grid, at).alias("map"))


def interpolate(df: DataFrame, maps: DataFrame, key: str, points: int = 101) -> DataFrame:
    """`df` with `calibrated`: its confidence in its group's map, or itself where the group has none.

    maps: one row for each group, `points` numbers each; the groups are modes, so the table is small and Spark broadcasts it
    by its size.
    """
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * (points - 1)
    low = F.least(F.floor(x), F.lit(points - 2)).cast("int")
    a, b = F.get("map", low), F.get("map", low + 1)
    value = F.when(F.col("map").isNull(), F.col("confidence")).otherwise(a + (b - a) * (x - low))
    return df.join(maps, key, "left").withColumn("calibrated", value).drop("map")


def paired_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and the numbers of pairs where a is better, equal and worse: all that a resample of paired 0/1 results depends on."""
    from tessera.operators.runs import paired_modes

    d = F.col("success_a") - F.col("success_b")
    return paired_modes(df, a, b).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("plus"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("minus"))


def paired_bootstrap(df: DataFrame, a: str, b: str, resamples: int = 10_000, seed: int = 13) -> DataFrame:
    """Mean difference, its 95 % bootstrap interval and two-sided p: each resample is one multinomial draw."""
    import numpy as np

    def draw(rows):
        for frame in rows:
            for r in frame.itertuples():
                rng = np.random.default_rng(seed)
                counts = rng.multinomial(r.n, np.array([r.plus, r.zero, r.minus]) / r.n, size=resamples) if r.n else np.zeros((1, 3))
                means = (counts[:, 0] - counts[:, 2]) / max(1, r.n)
                p = min(1.0, 2 * min((means <= 0).mean(), (means >= 0).mean()))
                low, high = np.percentile(means, [2.5, 97.5])
                yield pd.DataFrame({"mean_diff": [(r.plus - r.minus) / max(1, r.n)], "ci_low": [low], "ci_high": [high], "p_value": [p], "n": [r.n]})

    return paired_differences(df, a, b).mapInPandas(draw, "mean_diff double, ci_low double, ci_high double, p_value double, n long")


def bootstrap_ci(df: DataFrame, *keys: str, resamples: int = 2_000, seed: int = 13) -> DataFrame:
    """Mean success of each group with its bootstrap interval, from (n, successes) alone."""
    import numpy as np

    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("success").cast("long").alias("k"))

    def draw(rows):
        for frame in rows:
            out = []
            for r in frame.itertuples():
                means = np.random.default_rng(seed).binomial(r.n, r.k / r.n, size=resamples) / r.n
                out.append([*(getattr(r, c) for c in keys), r.n, r.k / r.n, *np.percentile(means, [2.5, 97.5])])
            yield pd.DataFrame(out, columns=[*keys, "n", "mean", "ci_low", "ci_high"])

    types = dict(df.dtypes)
    return sums.mapInPandas(draw, ", ".join(f"{c} {types[c]}" for c in keys) + ", n long, mean double, ci_low double, ci_high double")



#: Odds of a count in a Poisson draw of mean one, as whole numbers of 2 ** -32: a draw is the number of sums that it reaches.
POISSON_STEPS = 16


def poisson_bounds(steps: int = POISSON_STEPS) -> list[int]:
    """Least 32-bit draws that mean a count of 1, 2, ...: the distribution function of a Poisson variable of mean 1."""
    import math

    return [round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(steps)]


def poisson_weight(*parts: Column) -> Column:
    """A count by md5 of the parts, Poisson distributed with mean 1."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    return sum(((draw >= b).cast("long") for b in poisson_bounds()), F.lit(0).cast("long"))


#: Sums that rows are added up in before they are resampled.
POISSON_BUCKETS = 1024


def poisson_bootstrap(df: DataFrame, keys: Sequence[str], unit: str, value: str, resamples: int = 200) -> DataFrame:
    """keys, n, mean, ci_low, ci_high and p_value (two-sided, that the mean is 0), by Poisson weights on sums.

    Rows are added up in POISSON_BUCKETS buckets of each group, by md5 of `unit`; in each resample a bucket counts Poisson times, keyed
    by md5 of bucket and resample. So the table is read and reduced once, whatever the number of resamples, and results don't depend on
    partitioning. Bounds are the resampled means of ranks floor(0.025 * (m - 1)) and ceil(0.975 * (m - 1)) of the m resamples
    that are not empty. Null values are left out.
    """
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    rows = df.select(*keys, (number(F.col(unit).cast("string")) % POISSON_BUCKETS).alias("_k"), F.col(value).cast("double").alias("_x")).filter("_x is not null")
    buckets = rows.groupBy(*keys, "_k").agg(F.count("*").alias("_c"), F.sum("_x").alias("_t"))
    each = buckets.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    weighted = each.withColumn("_w", poisson_weight(F.col("_k").cast("string"), F.col("_b").cast("string")))
    sums = weighted.groupBy(*keys, "_b").agg(F.sum(F.col("_w") * F.col("_c")).alias("_n"), F.sum(F.col("_w") * F.col("_t")).alias("_s"))
    means = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_n") > 0, F.round(F.col("_s") / F.col("_n"), 12)))).alias("_m"))
    whole = buckets.groupBy(*keys).agg(F.sum("_c").alias("n"), (F.sum("_t") / F.sum("_c")).alias("mean"))
    m = F.size("_m")
    at = lambda place: F.get("_m", place.cast("int"))
    share = lambda keep: F.size(F.filter("_m", keep)) / m
    p = F.least(F.lit(1.0), 2 * F.least(share(lambda x: x <= 0), share(lambda x: x >= 0)))
    joined = means.join(whole, list(keys)) if keys else means.crossJoin(whole)
    return joined.select(*keys, "n", "mean", at(F.floor((m - 1) * 25 / 1000)).alias("ci_low"), at(F.ceil((m - 1) * 975 / 1000)).alias("ci_high"), p.alias("p_value"))

def effect_sizes(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cliff's delta, Cohen's d and h, and the accuracy difference of two modes over paired questions."""
    from tessera.operators.runs import paired_modes

    d = F.col("success_a") - F.col("success_b")
    sums = paired_modes(df, a, b).agg(F.count("*").alias("n"), F.avg("success_a").alias("pa"), F.avg("success_b").alias("pb"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"), F.avg((d > 0).cast("int")).alias("up"), F.avg((d < 0).cast("int")).alias("down"))
    h = 2 * F.asin(F.sqrt("pa")) - 2 * F.asin(F.sqrt("pb"))
    return sums.select("n", rounded(F.col("up") - F.col("down")).alias("cliffs_delta"), rounded(F.col("m") / (F.coalesce("sd", F.lit(0.0)) + 1e-12)).alias("cohens_d"), rounded(h).alias("cohens_h"), rounded(F.col("pa") - F.col("pb")).alias("delta_accuracy"))


def sym_coverage(df: DataFrame, exclude: Sequence[str] = ("RL",)) -> DataFrame:
    """n, fired, coverage and precision (success among the fired) by mode, with a row ALL."""
    kept = df.filter(~F.col("mode").isin(*exclude))
    sums = kept.rollup("mode").agg(F.count("*").alias("n_total"), F.count_if("sym_fired").alias("fired_n"), F.avg(F.when(F.col("sym_fired"), F.col("success"))).alias("p"), F.grouping("mode").alias("g"))
    return sums.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("mode")).alias("mode"), "n_total", "fired_n", rounded(F.col("fired_n") / F.col("n_total")).alias("coverage"), rounded(F.coalesce("p", F.lit(0.0))).alias("precision"))


def router_threshold_sweep(df: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Mean of the four groups' accuracies at each pair of thresholds: mem_top >= t_mem, else search_top >= t_search, else
    sym_fired, else the rest (an empty group counts 0).

    Rows are first summed by how many thresholds they reach, so the grid meets a few hundred rows.
    """
    taus = F.array(*[F.lit(float(t)) for t in grid])
    level = lambda c: F.size(F.filter(taus, lambda t: t <= F.col(c)))
    sums = df.groupBy(level("mem_top").alias("m"), level("search_top").alias("s"), F.col("sym_fired").alias("f")).agg(F.count("*").alias("n"), F.sum("success").alias("k"))
    cells = df.sparkSession.createDataFrame([(i, j, float(a), float(b)) for i, a in enumerate(grid) for j, b in enumerate(grid)], "i int, j int, t_mem double, t_search double")
    group = F.when(F.col("m") > F.col("i"), "mem").when(F.col("s") > F.col("j"), "search").when(F.col("f"), "sym").otherwise("rest")
    joined = sums.crossJoin(F.broadcast(cells)).groupBy("t_mem", "t_search", group.alias("g")).agg((F.sum("k") / F.sum("n")).alias("accuracy"))
    return joined.groupBy("t_mem", "t_search").agg(rounded(F.sum("accuracy") / 4).alias("score"))


def pareto_sweep(df: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """accuracy, mean cost, mean steps, n and utility (accuracy - alpha * cost) at each alpha, from one aggregate row."""
    sums = df.agg(F.avg("success").alias("a"), F.avg("cost").alias("c"), F.avg("steps").alias("s"), F.count("*").alias("n"))
    with_alpha = sums.select("*", F.explode(F.array(*[F.lit(float(x)) for x in alphas])).alias("alpha"))
    return with_alpha.select("alpha", rounded(F.col("a")).alias("accuracy"), rounded(F.col("c")).alias("avg_cost"), rounded(F.col("s")).alias("avg_steps"), "n", rounded(F.col("a") - F.col("alpha") * F.col("c")).alias("utility"))


def ablation_drops(runs: DataFrame, base: str, key: str = "id") -> DataFrame:
    """ablation, n, mean_drop, share_dropped and n_dropped of each other mode, over what `base` has right."""
    right = runs.filter((F.col("mode") == base) & (F.col("success") == 1)).select(key)
    others = runs.filter(F.col("mode") != base).join(right, key, "left_semi")
    drop = F.greatest(F.lit(0), 1 - F.col("success"))
    return others.groupBy(F.col("mode").alias("ablation")).agg(F.count("*").alias("n"), rounded(F.avg(drop)).alias("mean_drop"), rounded(F.avg((drop > 0).cast("int"))).alias("share_dropped"), F.count_if(drop > 0).alias("n_dropped"))


def by_setting(runs: DataFrame, settings: Mapping[str, Column]) -> DataFrame:
    """n, accuracy, avg_latency_ms and avg_cost by setting, value of the setting and mode; rows pass once for all settings."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("setting"), value.alias("param")) for name, value in settings.items()])).alias("_s")
    rows = runs.select("mode", "success", "latency_ms", "cost", pairs).select("_s.*", "mode", "success", "latency_ms", "cost")
    return rows.groupBy("setting", "param", "mode").agg(F.count("*").alias("n"), rounded(F.avg("success")).alias("accuracy"), rounded(F.avg("latency_ms"), 4).alias("avg_latency_ms"), rounded(F.avg("cost")).alias("avg_cost"))
