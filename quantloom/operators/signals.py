"""Derived context columns (CX01-CX10), gene predicates (G01-G21), votes (ST1-ST4).

Context columns have zero-filled warm-ups, unlike the rolling features. A gene is a dict with a ``type`` and parameters;
its predicate is a boolean column (a fractional vote for soft genes), false where a value or a column is missing.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import frame, lag, ordered, pairwise, upto

EPS = 1e-9
_KEY = re.compile(r"^(delta|flux|slope|eff|zscore)_(.+)_(\d+)$")
_CORR = re.compile(r"^corr_(.+)__(.+)_(\d+)$")


def _index() -> Column:
    return F.row_number().over(ordered()) - 1


def _zero(value: Column, ready: Column) -> Column:
    return F.when(ready, F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def delta(f: str, k: int) -> Column:
    return F.coalesce(F.col(f) - lag(f, k), F.lit(0.0))


def zscore(f: str, w: int) -> Column:
    std = F.stddev_pop(f).over(frame(w))
    return _zero((F.col(f) - F.avg(f).over(frame(w))) / F.nullif(std, F.lit(0.0)), (_index() >= w - 1) & (std > EPS))


def slope(f: str, w: int) -> Column:
    return _zero(F.regr_slope(F.col(f), F.col("_i").cast("double")).over(frame(w)), F.col("_i") >= w - 1)


def efficiency(f: str, w: int, step: str) -> Column:
    path = F.sum(step).over(frame(w))
    return _zero(F.abs(F.col(f) - lag(f, w)) / F.nullif(path, F.lit(0.0)), (F.col("_i") >= w) & (path > EPS))


def correlation(a: str, b: str, w: int) -> Column:
    x, y = pairwise(a, b)
    low = F.stddev_pop(x).over(frame(w)) * F.stddev_pop(y).over(frame(w))
    value = F.covar_pop(x, y).over(frame(w)) / F.nullif(low, F.lit(0.0))
    return _zero(F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)), (_index() >= w - 1) & (low > EPS))


def with_context(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the derived columns that are asked for by key, levels of dependence one select each (CX10).

    Keys: delta_f_k, flux_f_k, slope_f_w, eff_f_w, zscore_f_w, corr_a__b_w, consecutive_up, consecutive_down, atr_base,
    hour, weekday. f may be a key itself. Keys whose base columns are missing are left out.
    """
    waiting, df = list(dict.fromkeys(keys)), df.withColumn("_i", _index())
    for key in list(waiting):  # what a key rests on comes first
        m = _KEY.match(key)
        if m and m[2] not in df.columns and (_KEY.match(m[2]) or _CORR.match(m[2])) and m[2] not in waiting:
            waiting.append(m[2])
    while waiting:
        ready: dict[str, Column] = {}
        helpers: dict[str, Column] = {}
        for key in waiting:
            if key in df.columns:
                continue
            m, c = _KEY.match(key), _CORR.match(key)
            if m and m[2] in df.columns:
                kind, f, k = m[1], m[2], int(m[3])
                if kind == "flux":
                    helpers[f"_d_{f}_{k}"] = delta(f, k)
                elif kind == "eff":
                    helpers[f"_p_{f}"] = F.abs(F.col(f) - lag(f))
                ready[key] = F.lit(None)
            elif c and c[1] in df.columns and c[2] in df.columns or key in ("consecutive_up", "consecutive_down", "atr_base", "hour", "weekday"):
                ready[key] = F.lit(None)
        if not ready:
            break
        if "consecutive_up" in ready or "consecutive_down" in ready:
            helpers["_up"] = F.coalesce(F.col("close") > lag("close"), F.lit(False))
        if "atr_base" in ready:
            helpers["_tr"] = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")), F.abs(F.col("low") - lag("close")))
        df = df.withColumns(helpers) if helpers else df
        for key in ready:
            m, c = _KEY.match(key), _CORR.match(key)
            if m:
                kind, f, k = m[1], m[2], int(m[3])
                n = F.count(F.lit(1)).over(Window.partitionBy("series"))
                d = f"_d_{f}_{k}"
                ready[key] = {
                    "delta": lambda f=f, k=k: delta(f, k),
                    "zscore": lambda f=f, k=k: zscore(f, k),
                    "slope": lambda f=f, k=k: slope(f, k),
                    "eff": lambda f=f, k=k: efficiency(f, k, f"_p_{f}"),
                    "flux": lambda d=d, k=k, n=n: F.when(n > 2 * k, F.col(d) - F.coalesce(lag(d, k), F.lit(0.0))).otherwise(0.0),
                }[kind]()
            elif c:
                ready[key] = correlation(c[1], c[2], int(c[3]))
            elif key in ("consecutive_up", "consecutive_down"):
                mask = F.col("_up") if key.endswith("up") else ~F.col("_up")
                last_other = F.coalesce(F.last(F.when(~mask, F.col("_i")), ignorenulls=True).over(upto()), F.lit(-1))
                ready[key] = F.when(mask, F.col("_i") - last_other).otherwise(0).cast("double")
            elif key == "atr_base":
                mean = F.when(F.col("_i") < 50, F.col("_tr")).otherwise(F.avg("_tr").over(frame(50)))
                ready[key] = F.greatest(mean, F.col("close") * 1.5e-4)
            else:
                t = F.col("time_start").cast("timestamp")
                ready[key] = (F.hour(t) if key == "hour" else F.weekday(t)).cast("double")
        df = df.withColumns(ready)
        waiting = [k for k in waiting if k not in ready]
    return df.drop("_i", *[c for c in df.columns if c.startswith(("_d_", "_p_")) or c in ("_up", "_tr")])


def needed(gene: dict) -> list[str]:
    """Context keys that a gene reads."""
    g, kind = gene, gene["type"]
    w = g.get("window")
    return {
        "zscore": lambda: [f"zscore_{g['feature']}_{w}"],
        "soft_zscore": lambda: [f"zscore_{g['feature']}_{w}"],
        "delta": lambda: [f"delta_{g['feature']}_{g['lookback']}"],
        "flux": lambda: [f"flux_{g['feature']}_{g['lag']}"],
        "divergence": lambda: [f"slope_{g['feature_a']}_{w}", f"slope_{g['feature_b']}_{w}"],
        "efficiency": lambda: [f"eff_{g['feature']}_{w}"],
        "correlation": lambda: ["corr_{}__{}_{}".format(*sorted((g["feature_a"], g["feature_b"])), w)],
        "consecutive": lambda: [f"consecutive_{g['direction']}"],
        "time": lambda: [g["mode"]],
        "mean_reversion": lambda: [f"zscore_{g['feature']}_{w}", g["regime_feature"]],
    }.get(kind, list)()


def _cmp(a: Column, op: str, b: Column) -> Column:
    return {">": a > b, "<": a < b, "==": a == b, "!=": a != b, ">=": a >= b, "<=": a <= b}[op]


def predicate(gene: dict, columns: set[str]) -> Column:
    """The gene's vote on each bar: boolean, or a double between 0 and 1 for soft genes. Missing columns: no vote."""
    g, kind = gene, gene["type"]
    keys = needed(g)
    op, threshold, w = g.get("operator", ">"), F.lit(float(g.get("threshold", 0.0))), int(g.get("window", 1))
    reads = keys + [g[k] for k in ("feature", "feature_left", "feature_right", "feature_short", "feature_long", "regime_feature") if k in g and kind not in ("zscore", "soft_zscore", "delta", "flux", "efficiency")]
    if any(c not in columns for c in reads):
        return F.lit(False)
    x = F.col(keys[0]) if keys else F.col(g["feature"]) if "feature" in g else None
    if kind == "soft_zscore":
        side = 1.0 if op == ">" else -1.0
        z = F.lit(float(g["slope"]) * side) * (x - threshold)
        return F.coalesce(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(10.0)), F.lit(-10.0)))), F.lit(0.0))
    if kind in ("zscore", "delta", "flux", "efficiency", "correlation", "seasonality"):
        out = _cmp(x, op, threshold)
    elif kind == "relational":
        out = _cmp(F.col(g["feature_left"]), op, F.col(g["feature_right"]))
    elif kind == "cross":
        d = F.col(g["feature_left"]) - F.col(g["feature_right"])
        out = (d > 0) & (lag(d) <= 0) if g["direction"] == "above" else (d < 0) & (lag(d) >= 0)
    elif kind == "divergence":
        out = F.col(keys[0]) * F.col(keys[1]) < 0
    elif kind in ("persistence", "event", "validity"):
        hit = F.coalesce(_cmp(F.col(g["feature"]), op, threshold), F.lit(False)).cast("int")
        total, full = F.sum(hit).over(frame(w)), F.count(F.lit(1)).over(frame(w)) >= w
        need = w if kind == "persistence" else 1 if kind == "event" else int(w * float(g["percentage"]))
        out = F.lit(True) if need == 0 else full & (total >= need)
    elif kind in ("extrema", "proximity"):
        name = g.get("mode", "max")
        edge = F.when(F.count(F.col(g["feature"])).over(frame(w)) >= w, (F.max if name == "max" else F.min)(F.col(g["feature"])).over(frame(w)))
        v = F.col(g["feature"])
        out = F.abs(v - edge) <= threshold if kind == "proximity" else v >= edge if name == "max" else v <= edge
    elif kind == "squeeze":
        out = F.col(g["feature_short"]) < F.col(g["feature_long"]) * F.lit(float(g["multiplier"]))
    elif kind == "consecutive":
        out = _cmp(x, op, F.lit(float(g["count"])))
    elif kind == "time":
        out = _cmp(x, op, F.lit(float(g["value"])))
    elif kind == "mean_reversion":
        z = F.col(keys[0])
        out = (F.col(g["regime_feature"]) > F.lit(float(g["regime_threshold"]))) & (z < -threshold if g["direction"] == "long" else z > threshold)
    elif kind == "hysteresis":
        before = F.collect_list(F.struct(F.col(g["feature"]).alias("f"), F.col("close").alias("c"))).over(ordered().rowsBetween(-(w - 1), -1))
        f = F.col(g["feature"])
        near = F.filter(before, lambda s: F.abs(s.f - f) < F.greatest(F.abs(f) * 0.05, F.lit(1e-6)))
        then = F.try_element_at(near, F.lit(-1)).getField("c")
        out = (F.row_number().over(ordered()) > w) & _cmp(F.col("close"), op, then)
    else:
        raise ValueError(f"no gene type {kind!r}")
    return F.coalesce(out, F.lit(False))


def concordance(n: int) -> int:
    """Votes needed of n genes: 1 for up to two, else a bare majority of 51 % (ST2)."""
    return 1 if n <= 2 else math.ceil(0.51 * n)


def unique_genes(genes: list[dict]) -> list[dict]:
    """Genes without repeats, in order (ST2)."""
    return list({json.dumps(g, sort_keys=True): g for g in genes}.values())


def strategy_hash(strategy: dict) -> str:
    """The same for strategies of the same genes, in any order, and the same stops, targets, horizon and limit."""
    sides = [sorted(json.dumps(g, sort_keys=True) for g in strategy.get(s, [])) for s in ("long_genes", "short_genes")]
    rest = [effective(strategy, "long"), effective(strategy, "short"), strategy.get("horizon"), strategy.get("limit", 0.0)]
    return hashlib.sha256(json.dumps([sides, rest]).encode()).hexdigest()[:16]


def vote(strategy: dict, columns: set[str]) -> Column:
    """-1, 0 or 1: long votes at or over the threshold less short votes at or over theirs (ST1)."""
    def side(genes: list[dict]) -> Column:
        genes = unique_genes(genes)
        if not genes:
            return F.lit(0)
        need = min(max(1, strategy.get("min_concordance") or concordance(len(genes))), len(genes))
        total = sum((predicate(g, columns).cast("double") for g in genes), F.lit(0.0))
        return (total >= need).cast("int")
    return (side(strategy.get("long_genes", [])) - side(strategy.get("short_genes", []))).cast("int")


def signals(df: DataFrame, strategies: list[dict], carried: tuple[str, ...] = ()) -> DataFrame:
    """(series, bar_id, strategy_id, signal) in long form, with the columns ``carried`` of each bar, which genes don't
    read. Derived columns of all strategies are computed once."""
    keys = [k for s in strategies for side in ("long_genes", "short_genes") for g in s.get(side, []) for k in needed(g)]
    wide = with_context(df, keys)
    have = set(wide.columns) - set(carried)
    rows = F.array(*[F.struct(F.lit(s["name"]).alias("strategy_id"), F.col(f"_s{i}").alias("signal")) for i, s in enumerate(strategies)])
    voted = wide.select("series", "bar_id", *carried, *[vote(s, have).alias(f"_s{i}") for i, s in enumerate(strategies)])
    return voted.select("series", "bar_id", *carried, F.explode(rows).alias("r")).select("series", "bar_id", "r.strategy_id", "r.signal", *carried)


def raw_votes(df: DataFrame, strategy: dict) -> DataFrame:
    """series, bar_id, long_votes, short_votes and net: the votes' difference over the longer side's genes (EV17)."""
    sides = [strategy.get(s, []) for s in ("long_genes", "short_genes")]
    wide = with_context(df, [k for genes in sides for g in genes for k in needed(g)])
    have = set(wide.columns)
    up, down = (sum((predicate(g, have).cast("double") for g in genes), F.lit(0.0)) for genes in sides)
    most = max(1, *map(len, sides))
    return wide.select("series", "bar_id", up.alias("long_votes"), down.alias("short_votes"), ((up - down) / most).alias("net"))


def market_hours(df: DataFrame, horizon: int, minutes: float = 1.5) -> Column:
    """8 to 22 h on weekdays, and early enough for the horizon to end by 22 h (ST3)."""
    t = F.col("time_start").cast("timestamp")
    return F.hour(t).between(8, 21) & (F.weekday(t) < 5) & (F.hour(t) < 22 - horizon * minutes / 60)


def next_open(signal: str = "signal", by: tuple[str, ...] = ("series", "strategy_id", "split")) -> Column:
    """The signal acts one bar later; the first bar of each slice has none (ST4)."""
    return F.coalesce(F.lag(signal).over(Window.partitionBy(*by).orderBy("bar_id")), F.lit(0))


def parse_strategies(text: str) -> list[dict]:
    """Strategies of a JSON text: a list, or one object; none if it can't be read."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return []
    return [s for s in (found if isinstance(found, list) else [found]) if isinstance(s, dict)]


def read_strategies(spark: SparkSession, path: str) -> list[dict]:
    """Strategies of JSON files, lists or single objects (SRC16); a driver-side configuration, not data."""
    return [s for r in spark.read.text(path, wholetext=True).collect() for s in parse_strategies(r[0])]


def effective(strategy: dict, direction: str) -> tuple[float, float]:
    """(stop, target) of a side: its own, else the common one (ST2)."""
    return tuple(strategy[k] if strategy.get(k) is not None else strategy.get(c, 0.0) for k, c in ((f"sl_{direction}", "sl"), (f"tp_{direction}", "tp")))
