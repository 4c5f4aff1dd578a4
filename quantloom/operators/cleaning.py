"""Cleaning, gaps, rolls and audits (OP01-OP17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import ratio


def choose_price(df: DataFrame, candidates: dict[str, tuple[Column, list[str]]], by: str = "series") -> DataFrame:
    """``mid_price`` and ``price_source`` (OP01): for each instrument the first candidate whose columns all have some value
    there; NULL where none has. ``candidates``: name to (price, the columns it needs)."""
    filled = lambda c: F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) > 0
    source = F.coalesce(*[F.when(reduce(lambda x, y: x & y, map(filled, needs)), F.lit(name)) for name, (_, needs) in candidates.items()])
    chosen = df.groupBy(by).agg(source.alias("price_source"))
    price = F.coalesce(*[F.when(F.col("price_source") == name, F.nanvl(c.cast("double"), F.lit(None).cast("double"))) for name, (c, _) in candidates.items()])
    return df.join(chosen, by).withColumn("mid_price", price)


def drop_jumps(ticks: DataFrame, most: float = 0.02, price: str = "mid") -> DataFrame:
    """Valid prices only (OP02), without rows that change by more than ``most`` against the row before (OP03).

    One pass over raw rows: the jump out and the jump back both go. A series' first row stays.
    """
    w = Window.partitionBy("series").orderBy("ts", "seq")
    change = F.abs(ratio(price, F.lag(price).over(w)) - 1)
    return ticks.where(F.col(price) > 0).withColumn("change", change).where(F.coalesce(F.col("change") <= most, F.lit(True)))


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (OP05, SNK03, SNK04)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in ``order`` (OP05): ``order`` is given ascending, nulls first."""
    return keep_one(df, keys, [c.desc_nulls_last() for c in order])


def trading_bars(bars: DataFrame, start: str | None = None, timed: bool = True) -> DataFrame:
    """Bars from a date on (OP06), without those of no duration (OP07)."""
    kept = bars.where(F.col("time_start") >= F.lit(start).cast("timestamp_ntz")) if start else bars
    return kept.where(F.col("time_start") != F.col("time_end")) if timed else kept


#: Columns that stay whatever the list says: fixed names of the surveyed bars.
META = ("series", "bar_id", "time_start", "time_end", "open", "high", "low", "close", "volume")


def keep_columns(df: DataFrame, survivors: list[str]) -> DataFrame:
    """META columns and the survivors that exist (OP08)."""
    return df.select(*[c for c in df.columns if c in META], *[c for c in dict.fromkeys(survivors) if c in df.columns and c not in META])


def leak_audit(df: DataFrame, columns: list[str], ret: str = "log_ret", known: tuple[str, ...] = (), ahead: float = 0.2, same: float = 0.95) -> DataFrame:
    """(column, next_corr, current_corr, leaks, proxy) (OP15): whether a column correlates over ``ahead`` with the next
    bar's return, unless it is ``known`` to, and over ``same`` with the current one."""
    nxt = df.withColumn("_next", F.lead(ret).over(Window.partitionBy("series").orderBy("bar_id"))).where("_next is not null")
    next_, now = correlations_to(nxt, "_next", columns), correlations_to(nxt, ret, [c for c in columns if c != ret])
    both = next_.withColumnRenamed("corr", "next_corr").join(now.withColumnRenamed("corr", "current_corr"), "column", "left")
    listed = F.col("column").isin(list(known)) if known else F.lit(False)
    over = lambda c, most: F.coalesce(F.abs(c) > most, F.lit(False))
    return both.withColumns({"leaks": over("next_corr", ahead) & ~listed, "proxy": over("current_corr", same)})


def drop_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without those of ``columns`` that hold one value at most, or no deviation (OP16): one aggregate decides."""
    made = df.agg(*[F.struct(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("one"), F.coalesce(F.stddev_samp(F.col(c).cast("double")), F.lit(0.0)).alias("std")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if made[c]["one"] or made[c]["std"] == 0])


def gaps(ticks: DataFrame, start: str, end: str, inner: str = "30 minutes", tail: str = "4 hours") -> DataFrame:
    """Holes in a tape between two times (OP09): head and inner ones longer than ``inner``, the tail one than ``tail``."""
    w = Window.partitionBy("series").orderBy("ts", "seq")
    t = F.col("ts").cast("timestamp")
    inside = ticks.select("series", t.alias("gap_start"), F.lead(t).over(w).alias("gap_end"), F.lit("inner").alias("kind")).where(F.col("gap_end") > F.col("gap_start") + F.expr(f"interval {inner}"))
    ends = ticks.groupBy("series").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    head = ends.select("series", a.alias("gap_start"), F.col("a").alias("gap_end"), F.lit("head").alias("kind")).where(F.col("gap_end") > a + F.expr(f"interval {inner}"))
    last = ends.select("series", F.col("b").alias("gap_start"), b.alias("gap_end"), F.lit("tail").alias("kind")).where(F.col("gap_start") < b - F.expr(f"interval {tail}"))
    return inside.unionByName(head).unionByName(last)


def ohlc_audit(bars: DataFrame) -> DataFrame:
    """Counts of impossible bars by series (OP12)."""
    c = {n: F.col(n) for n in ("open", "high", "low", "close", "volume")}
    rules = {
        "high_lt_low": c["high"] < c["low"],
        "high_lt_body": (c["high"] < c["open"]) | (c["high"] < c["close"]),
        "low_gt_body": (c["low"] > c["open"]) | (c["low"] > c["close"]),
        "not_positive": (c["open"] <= 0) | (c["high"] <= 0) | (c["low"] <= 0) | (c["close"] <= 0),
        "negative_volume": c["volume"] < 0,
    }
    return bars.groupBy("series").agg(F.count("*").alias("n"), *[F.count_if(r).alias(n) for n, r in rules.items()])


def time_audit(ticks: DataFrame, gap: str = "3 days") -> DataFrame:
    """Backward steps in arrival order, duplicated times with their widest row distance, and long gaps (OP13)."""
    arrival = Window.partitionBy("series").orderBy("seq")
    t = F.col("ts").cast("timestamp")
    rows = ticks.select("series", t.alias("ts"), F.lag(t).over(arrival).alias("before"), F.row_number().over(arrival).alias("rn"))
    same = rows.groupBy("series", "ts").agg(F.count("*").alias("n"), (F.max("rn") - F.min("rn")).alias("spread"))
    dup = same.groupBy("series").agg(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("duplicates"), F.max("spread").alias("widest"))
    steps = rows.groupBy("series").agg(F.count_if(F.col("ts") < F.col("before")).alias("backwards"), F.count_if(F.col("ts") > F.col("before") + F.expr(f"interval {gap}")).alias("long_gaps"))
    return steps.join(dup, "series")


def column_audit(df: DataFrame, columns: list[str], sparse: tuple[str, ...] = ()) -> DataFrame:
    """(column, n, nulls, infinite, constant) in one pass (OP14, OP16, AG07). Columns named in ``sparse`` are never constant."""
    def kinds(c: str) -> list[Column]:
        x = F.col(c).cast("double")
        return [F.count_if(x.isNull() | F.isnan(x)), F.count_if(F.abs(x) == float("inf")), F.coalesce(F.stddev_samp(F.when(F.abs(x) < float("inf"), x)), F.lit(0.0))]
    wide = df.agg(F.count("*").alias("n"), *[F.struct(*[k.alias(a) for k, a in zip(kinds(c), ("nulls", "infinite", "std"), strict=True)]).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    long = wide.select("n", F.explode(rows).alias("r"))
    constant = (F.col("r.s.std") == 0) & ~F.col("r.column").isin(*sparse) if sparse else F.col("r.s.std") == 0
    return long.select(F.col("r.column").alias("column"), "n", F.col("r.s.nulls").alias("nulls"), F.col("r.s.infinite").alias("infinite"), constant.alias("constant"))


def correlations_to(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, corr) of each column with a target over rows where both are there, in one wide aggregate (AG10, OP15)."""
    out = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(c)), F.when(both, F.col(target))
        out.append(ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias(c))
    wide = df.agg(*out)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("corr")) for c in columns])).alias("r")).select("r.column", "r.corr")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for a < b, pairwise complete, in one pass (AG11)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        out.append(ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias(f"p{i}"))
    wide = df.agg(*out)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(rows).alias("r")).select("r.a", "r.b", "r.corr")


#: Fixed names of the surveyed purge (OP17): columns that are no features, and parts of the names of noisy ones.
NO_FEATURES = (
    "time_start", "time_end", "open", "high", "low", "close", "volume", "net_aggressor_vol", "cum_vol", "vol_proxy", "bar_id", "log_ret",
    "avg_bid_price", "avg_ask_price", "avg_bid_size", "avg_ask_size", "avg_spread", "ticket_imbalance", "residual_bund", "residual_tnx", "residual_usdchf",
    "rel_strength_z_6e", "delta_rel_strength_z_6e_25", "delta_rel_strength_z_6e_50", "delta_rel_strength_z_6e_100", "divergence_50_6e",
    "delta_divergence_50_6e_25", "delta_divergence_50_6e_50", "delta_divergence_50_6e_100", "day_open", "prev_val", "prev_vah", "prev_vpoc",
    "price_es", "price_zn", "price_bund", "price_6e", "price_gbpusd", "price_usdjpy", "price_tnx", "price_us2y", "price_schatz",
    "hamiltonian_3200", "lagrangian_3200", "potential_energy_3200",
)
NOISE = ("kyle_lambda", "tick_spread", "tick_volatility", "tick_ofi", "pres_imbalance", "avg_spread")


def kept_names(names: list[str], exclude: tuple[str, ...] = NO_FEATURES, patterns: tuple[str, ...] = NOISE) -> list[str]:
    """Feature names without excluded ones and those that hold a pattern (OP17)."""
    return [n for n in names if n not in exclude and not any(p in n for p in patterns)]


def feature_columns(df: DataFrame, keys: tuple[str, ...] = ("series", "bar_id"), target: str | None = None) -> DataFrame:
    """``df`` with its keys and features alone (OP17)."""
    return df.select(*keys, *[c for c in kept_names(df.columns) if c not in keys and c != target])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns as NULL (SET1)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
