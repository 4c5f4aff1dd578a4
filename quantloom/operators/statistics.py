"""Evaluation statistics, purged splits and feature selection (EV01-EV09, EV13, EV15, FS01-FS09)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.distributions import normal_cdf, student_t_tail
from quantloom.functions.frames import average_rank, ratio
from quantloom.operators.chunks import WHOLE_BYTES, average_ranks, numbered, size_of

EPS = 1e-9


def sharpe(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.avg(x) / (F.stddev_pop(x) + F.lit(EPS))


def sortino(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.avg(x) / (F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2))) + F.lit(EPS))


def stability_factor(x: Column | str) -> Column:
    """0.6 where one bar makes over 60 % of the total, else 1 (EV03)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.max(x) / (F.abs(F.sum(x)) + EPS) > 0.6, 0.6).otherwise(1.0)


def metrics(returns: DataFrame, by: list[str], annual: float = 1.0) -> DataFrame:
    """One row for each group: total, sharpe, sortino, adjusted sortino, drawdown, bars (EV01-EV04, EV09)."""
    w = Window.partitionBy(*by).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("_c", F.sum("net_ret").over(w)).withColumn("_top", F.greatest(F.max("_c").over(w), F.lit(0.0)))
    k = F.lit(math.sqrt(annual))
    made = curve.groupBy(*by).agg(
        F.count("*").alias("bars"), F.sum("net_ret").alias("total"), (sharpe("net_ret") * k).alias("sharpe"), (sortino("net_ret") * k).alias("sortino"), stability_factor("net_ret").alias("_f"), F.min(F.col("_c") - F.col("_top")).alias("drawdown")
    )
    return made.withColumn("adjusted", F.col("sortino") * F.col("_f")).drop("_f")


def hamming(signals: DataFrame, names: list[str]) -> DataFrame:
    """Bars on which two strategies' signals differ (EV15), for pairs a < b of ``names``: strategies side by side, then one
    wide aggregate; no pair of rows is made."""
    wide = signals.groupBy("series", "bar_id").agg(*[F.max(F.when(F.col("strategy_id") == s, F.col("signal"))).alias(f"s{i}") for i, s in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names)) if names[i] < names[j]]
    both = {(i, j): F.col(f"s{i}").isNotNull() & F.col(f"s{j}").isNotNull() for i, j in pairs}
    made = wide.agg(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.count_if(F.col(f"s{i}") != F.col(f"s{j}")).alias("differ"), F.count_if(both[i, j]).alias("bars")).alias(f"p{k}") for k, (i, j) in enumerate(pairs)])
    return made.select(F.explode(F.array(*[F.col(f"p{k}") for k in range(len(pairs))])).alias("r")).select("r.*")


def deflated_sharpe(sr: Column, n: Column, skew: Column, kurtosis: Column, trials: Column, annual: float = 1.0) -> Column:
    """Probability that a Sharpe ratio over ``n`` returns beats the best of ``trials`` null ones (EV08).

    ``sr`` is annualised by sqrt(``annual``), ``kurtosis`` the raw one. The estimator's deviation follows from skew and
    kurtosis; the hurdle is that deviation times sqrt(2 ln trials), none under two trials. 0 under two returns, NULL where
    the variance would be negative.
    """
    raw = sr / math.sqrt(annual)
    variance = (1 - skew * raw + (kurtosis - 1) / 4 * raw * raw) / (n - 1) * annual
    s = F.sqrt(F.when(variance > 0, variance))
    hurdle = F.when(trials < 2, 0.0).otherwise(F.sqrt(2 * F.log(F.greatest(trials, F.lit(2)).cast("double"))))
    return F.when(n < 2, 0.0).otherwise(normal_cdf(sr / s - hurdle))


def deflated_table(returns: DataFrame, by: list[str], trials: int | Column, annual: float = 1.0) -> DataFrame:
    """(by, bars, sharpe, skew, kurtosis, deflated) of ``net_ret`` by group (EV08): population moments, raw kurtosis. A
    Sharpe ratio of constant returns is 0."""
    made = returns.groupBy(*by).agg(
        F.count("net_ret").alias("bars"), F.avg("net_ret").alias("_m"), F.stddev_pop("net_ret").alias("_s"), F.skewness("net_ret").alias("skew"), (F.kurtosis("net_ret") + 3).alias("kurtosis")
    )
    made = made.withColumn("sharpe", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * math.sqrt(annual)).otherwise(0.0))
    moments = [F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(d)) for c, d in (("skew", 0.0), ("kurtosis", 3.0))]
    made = made.withColumn("deflated", deflated_sharpe(F.col("sharpe"), F.col("bars"), *moments, trials if isinstance(trials, Column) else F.lit(trials), annual))
    return made.drop("_m", "_s")


def purged_ranges(sizes: DataFrame, folds: int = 6, tests: int = 2, embargo: float = 0.01) -> DataFrame:
    """Combinatorial purged splits (EV06) as rows: by, split, fold, role (`train`, `test`), start, stop (half open).

    ``sizes`` has the keys and n, the rows of each. Each of the C(folds, tests) splits tests on that many of equal folds (the
    last takes the rest). A training fold loses the embargo, a share of n, behind a test fold that ends within it, and
    before one that starts within it; folds without rows left go.
    """
    by = [c for c in sizes.columns if c != "n"]
    chosen = [list(c) for c in combinations(range(folds), tests)]
    splits = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("split"), F.array(*[F.lit(t) for t in c]).alias("tested")) for i, c in enumerate(chosen)]))
    base = sizes.withColumns({"_size": F.floor(F.col("n") / folds), "_gap": F.floor(F.col("n") * embargo)}).select("*", splits.alias("s")).select("*", "s.*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    first = lambda k: k * F.col("_size")
    last = lambda k: F.when(k < folds - 1, (k + 1) * F.col("_size")).otherwise(F.col("n")) - 1
    a, b = first(F.col("fold")), last(F.col("fold"))
    after = F.exists("tested", lambda t: (a > last(t)) & (a - last(t) <= F.col("_gap") + 1))
    before = F.exists("tested", lambda t: (b < first(t)) & (first(t) - b <= F.col("_gap") + 1))
    is_test = F.array_contains("tested", F.col("fold"))
    cut = lambda side: F.when(is_test | ~side, 0).otherwise(F.col("_gap"))
    made = base.select(*by, "split", "fold", F.when(is_test, "test").otherwise("train").alias("role"), (a + cut(after)).cast("long").alias("start"), (b + 1 - cut(before)).cast("long").alias("stop"))
    return made.where("start < stop")


def in_purged_splits(rows: DataFrame, by: list[str], folds: int = 6, tests: int = 2, embargo: float = 0.01, horizon: int = 0, span: int = 200_000) -> DataFrame:
    """``rows`` (by, bar_id, ...) once for each split and role that it belongs to (EV06), with split, role and k, its place.

    A range lies within one fold, so that rows and ranges meet by an equality of (by, fold). With a ``horizon`` a row's label
    covers its next so many rows: training rows whose labels reach into a test range of the split are taken out by an
    anti-join of intervals within (by, split).
    """
    placed = numbered(rows, by, [F.floor(F.col("bar_id") / span)], ["bar_id"], "k")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    ranges = purged_ranges(sizes, folds, tests, embargo)
    fold = F.least(F.floor(F.col("k") / F.greatest(F.floor(F.col("n") / folds), F.lit(1))), F.lit(folds - 1)).cast("int")
    here = placed.join(sizes, by).withColumn("fold", fold).drop("n")
    cases = here.join(ranges, [*by, "fold"]).where("k >= start and k < stop").drop("start", "stop", "fold")
    if not horizon:
        return cases
    tested = ranges.where("role = 'test'").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("split").alias("_split"), F.col("start").alias("_start"), F.col("stop").alias("_stop"))
    touches = (F.col("role") == "train") & (F.col("split") == F.col("_split")) & (F.col("k") < F.col("_stop")) & (F.col("k") + horizon >= F.col("_start"))
    for c in by:
        touches = touches & (F.col(c) == F.col(f"_{c}"))
    return cases.join(tested, touches, "left_anti")


def purged_scores(returns: DataFrame, by: list[str], annual: float = 1.0, **how) -> DataFrame:
    """(by, split, train_rows, test_rows, train_sharpe, test_sharpe) of ``net_ret`` on every purged split."""
    cases = in_purged_splits(returns, by, **how)
    role = lambda name: F.when(F.col("role") == name, F.col("net_ret"))
    ratio_of = lambda name: F.coalesce(F.avg(role(name)) / F.nullif(F.stddev_pop(role(name)), F.lit(0.0)) * math.sqrt(annual), F.lit(0.0))
    made = [f(n).alias(f"{n}_{what}") for n in ("train", "test") for what, f in (("rows", lambda n: F.count_if(F.col("role") == n)), ("sharpe", ratio_of))]
    return cases.groupBy(*by, "split").agg(*made)


def walk_forward(n: int, folds: int = 5) -> list[tuple[int, int]]:
    """Test ranges on the first 80 % of rows (EV05): 11 % each, behind windows of 55 % that start 11 % apart."""
    m = int(n * 0.8)
    return [(int(m * 0.11 * f) + int(m * 0.55), min(m, int(m * 0.11 * f) + int(m * 0.55) + int(m * 0.11))) for f in range(folds)]


def long_features(df: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """(keys, target, feature, value) rows with both values there."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.col(target).alias("y"), F.explode(rows).alias("r")).select(*keys, "y", "r.feature", "r.value").where("value is not null and y is not null")


def _corr(a: str, b: str) -> Column:
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def rank_ic(df: DataFrame, features: list[str], target: str, folds: int = 5, most: int = WHOLE_BYTES, span: int = 200_000) -> DataFrame:
    """(feature, n, ic, stability) (FS01, FS03): Pearson of global average ranks, and |mean| / (std + 1e-6) of the folds'
    correlations of the same ranks. Needs bar_id for the order.

    A table of up to ``most`` bytes is ranked feature by feature; a larger one by ranges of values and of ``span`` bars.
    """
    long = long_features(df, features, target, ["series", "bar_id"])
    if size_of(df) <= most:
        own = Window.partitionBy("feature")
        ranked = long.withColumns({"rx": average_rank("value", "feature"), "ry": average_rank("y", "feature"), "size": F.count(F.lit(1)).over(own)})
        ranked = ranked.withColumn("place", F.row_number().over(own.orderBy("series", "bar_id")) - 1)
    else:
        ranked = average_ranks(average_ranks(long, "value", "feature", "rx"), "y", "feature", "ry")
        ranked = numbered(ranked, ["feature"], [F.col("series"), F.floor(F.col("bar_id") / span)], ["bar_id"], "place")
        ranked = ranked.join(F.broadcast(long.groupBy("feature").agg(F.count("*").alias("size"))), "feature")  # one row a feature
    fold = F.least(F.floor(F.col("place") / F.greatest(F.floor(F.col("size") / folds), F.lit(1))), F.lit(folds - 1))
    x, y = (F.col(c) - (F.col("size") + 1) / 2 for c in ("rx", "ry"))  # about their mean, so that sums of products keep their digits
    sums = {"n": F.count("*").cast("double"), "sx": F.sum(x), "sy": F.sum(y), "xx": F.sum(x * x), "yy": F.sum(y * y), "xy": F.sum(x * y)}
    by_fold = ranked.groupBy("feature", fold.alias("fold")).agg(*[c.alias(k) for k, c in sums.items()])

    def corr(of: Callable[[str], Column]) -> Column:
        n = of("n")
        cov, vx, vy = (of(a) - of(b) * of(c) / n for a, b, c in (("xy", "sx", "sy"), ("xx", "sx", "sx"), ("yy", "sy", "sy")))
        return F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(F.nullif(vx * vy, F.lit(0.0))))

    each = by_fold.withColumn("c", corr(F.col))
    made = each.groupBy("feature").agg(*[F.sum(k).alias(k) for k in sums], (F.abs(F.avg("c")) / (F.stddev_pop("c") + 1e-6)).alias("stability"))
    return made.select("feature", F.col("n").cast("long").alias("n"), corr(F.col).alias("ic"), "stability")


def gates(ic: DataFrame, least_ic: float = 0.005, most_p: float = 0.05, least_stability: float = 0.25) -> DataFrame:
    """``verdict``: the first gate a feature fails, or keep (FS04); ``p``: two-sided, by t of each row's n."""
    t = F.abs("ic") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("ic") * F.col("ic"), F.lit(1e-12)))
    p = F.when(F.col("n") > 2, student_t_tail(t, F.col("n") - 2))
    verdict = F.when(F.coalesce(F.abs("ic"), F.lit(0.0)) < least_ic, "ic").when(F.coalesce("p", F.lit(1.0)) > most_p, "p").when(F.coalesce("stability", F.lit(0.0)) < least_stability, "stability").otherwise("keep")
    return ic.withColumn("p", p).withColumn("verdict", verdict)


def greedy_redundancy(order: list[str], pairs: dict[tuple[str, str], float], most: float = 0.85) -> list[str]:
    """Features in order of strength, without those too correlated with one kept before (FS05)."""
    kept: list[str] = []
    for f in order:
        if all(abs(pairs.get((min(f, g), max(f, g)), 0.0)) <= most for g in kept):
            kept.append(f)
    return kept


def seeded_sample(df: DataFrame, keys: list[str], rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows of the least hashes of ``keys`` and ``seed`` (SL05): the same ones on any cluster."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(rows)


def without_redundant(df: DataFrame, strength: DataFrame, features: list[str], keys: list[str], most: float = 0.85, sample: int = 50_000) -> DataFrame:
    """(feature, place) of the features that stay (FS05): by |ic| falling, none correlated over ``most`` with one before it.

    ``strength`` has feature and ic. Correlations come from one aggregate over at most ``sample`` rows; the choice itself
    is made from one row a feature and one a pair.
    """
    from quantloom.operators.cleaning import correlation_matrix

    matrix = correlation_matrix(seeded_sample(df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]), keys, sample), features)
    pairs = {(min(r.a, r.b), max(r.a, r.b)): r.corr or 0.0 for r in matrix.collect()}  # a few thousand rows at most
    order = [r.feature for r in strength.orderBy(F.desc_nulls_last(F.abs("ic")), "feature").collect()]
    return df.sparkSession.createDataFrame(list(enumerate(greedy_redundancy(order, pairs, most))), "place long, feature string").select("feature", "place")


def across_horizons(kept: dict[int, DataFrame], names: list[str]) -> DataFrame:
    """(feature, horizons, useful): in how many horizons' lists each name is (FS06); useless ones are in none."""
    spark = next(iter(kept.values())).sparkSession
    long = reduce(lambda a, b: a.union(b), [d.select("feature").withColumn("horizon", F.lit(h)) for h, d in kept.items()])
    counts = long.groupBy("feature").agg(F.countDistinct("horizon").alias("horizons"))
    known = spark.createDataFrame([(n,) for n in names], "feature string")
    return known.join(counts, "feature", "left").select("feature", F.coalesce("horizons", F.lit(0)).alias("horizons"), F.col("horizons").isNotNull().alias("useful"))


def decile_ic(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """(feature, ic): correlation of decile number with mean target (FS09, WN24). Edges are linear quantiles, equal ones
    merge, ties stay together."""
    long = long_features(df, features, target, ["series", "bar_id"])
    edges = long.groupBy("feature").agg(F.array_distinct(F.percentile("value", F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    placed = long.join(F.broadcast(edges), "feature")  # one row a feature
    number = F.greatest(F.size(F.filter("edges", lambda e: e < F.col("value"))) - 1, F.lit(0))
    means = placed.withColumn("bin", number).groupBy("feature", "bin").agg(F.avg("y").alias("mean_y"))
    return means.groupBy("feature").agg(_corr("bin", "mean_y").alias("ic"), F.count("*").alias("bins"))


def best_horizon(df: DataFrame, features: list[str], targets: list[str], least: int) -> DataFrame:
    """(feature, horizon, corr): the target each feature correlates with most (FS08); pairs of fewer rows don't count."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("horizon"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets])
    long = df.select(F.explode(rows).alias("r")).select("r.*").where("x is not null and y is not null")
    corr = long.groupBy("feature", "horizon").agg(_corr("x", "y").alias("corr"), F.count("*").alias("n")).where(F.col("n") >= least)
    return corr.groupBy("feature").agg(F.max_by(F.struct("horizon", "corr"), F.struct(F.abs("corr"), "horizon")).alias("b")).select("feature", "b.horizon", "b.corr")


def complete_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster numbers by complete linkage, merging while the farthest pair is within ``cut`` (EV13)."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        far = [(max(distance[a, b] for a in x for b in y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j]
        d, i, j = min(far)
        if d > cut:
            break
        groups[i] += groups.pop(j)
    out = [0] * len(distance)
    for k, g in enumerate(groups):
        for i in g:
            out[i] = k
    return out


def cluster_signals(signals: DataFrame, names: list[str], scores: dict[str, float], cut: float = 0.3) -> DataFrame:
    """(strategy_id, cluster, best) by complete linkage on 1 - |correlation| of signals (EV13). The correlations are one
    wide aggregate; the linkage takes one row a pair of ``names`` (some hundred names). Constant signals correlate 0."""
    from quantloom.operators.cleaning import correlation_matrix

    wide = signals.groupBy("series", "bar_id").agg(*[F.max(F.when(F.col("strategy_id") == s, F.col("signal"))).cast("double").alias(f"s{i}") for i, s in enumerate(names)])
    distance = np.ones((len(names), len(names))) - np.eye(len(names))
    for r in correlation_matrix(wide, [f"s{i}" for i in range(len(names))]).collect() if len(names) > 1 else []:
        i, j = int(r.a[1:]), int(r.b[1:])
        distance[i, j] = distance[j, i] = min(1.0, max(0.0, 1 - abs(r.corr or 0.0)))
    groups = complete_linkage(distance, cut)
    best = {g: max((n for n, h in zip(names, groups, strict=True) if h == g), key=lambda n: (scores.get(n, -math.inf), n)) for g in set(groups)}
    return signals.sparkSession.createDataFrame([(n, g, best[g] == n) for n, g in zip(names, groups, strict=True)], "strategy_id string, cluster int, best boolean")
