"""Null rules and frame-based (window) primitives, WN01-WN24. Every primitive works per series, in bar order.

NULL is the only missing value inside the engine (``clean``). Divisions yield NULL at a zero denominator (``ratio``).
A rolling value is NULL until its frame has ``min_periods`` values (the whole window by default).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES, ORDER = "series", "bar_id"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN to NULL (rule N1)."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is zero (rule N2)."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def ieee_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b by IEEE 754, not by rule N2: infinity or NaN where b is zero."""
    return F.when(col(b) == 0, col(a) * F.lit(math.inf)).otherwise(ratio(a, b))


def positive_log(x: Column | str) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def ieee_log(x: Column | str) -> Column:
    """Logarithm by IEEE 754: minus infinity at zero, NaN below."""
    return F.when(col(x) == 0, -math.inf).when(col(x) < 0, math.nan).otherwise(F.ln(col(x)))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds that keep NULL as NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, with one zero."""
    return F.round(col(x).cast("double"), digits) + F.lit(0.0)


def ordered(by: str = SERIES, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def frame(n: int, by: str = SERIES, order: str = ORDER) -> WindowSpec:
    """The last ``n`` rows, this one included."""
    return ordered(by, order).rowsBetween(-(n - 1), 0)


def time_frame(seconds: float, by: str = SERIES, time: str = "time_end") -> WindowSpec:
    """The rows of the last ``seconds`` up to this one's time (WN25)."""
    return Window.partitionBy(by).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-int(seconds * 1e6), 0)


def upto(by: str = SERIES, order: str = ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def onwards(by: str = SERIES, order: str = ORDER) -> WindowSpec:
    """This row and all after it, from the last one on: their first value is ``F.last`` here. A frame that ends with the
    partition is read anew for each row, one that begins with it grows by a row."""
    return Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column | str, w: WindowSpec, least: int) -> Column:
    """``value`` where the frame holds at least ``least`` values of x (rule N4)."""
    return F.when(F.count(col(x)).over(w) >= least, value)


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(ordered()) if k >= 0 else F.lead(col(x), -k).over(ordered())


def diff(x: Column | str, k: int = 1) -> Column:
    return col(x) - lag(x, k)


def pct_change(x: Column | str, k: int = 1) -> Column:
    return ratio(x, lag(x, k)) - 1


def rolling(name: str, x: Column | str, n: int, least: int | None = None) -> Column:
    """A built-in aggregate over the last ``n`` rows: sum, avg, min, max, stddev_samp, stddev_pop, var_samp, ..."""
    return full(getattr(F, name)(col(x)).over(frame(n)), x, frame(n), n if least is None else least)


def rolling_skew(x: Column | str, n: int) -> Column:
    """Bias-corrected skewness of a full window of n (Spark's own is the population moment)."""
    return rolling("skewness", x, n) * F.lit(math.sqrt(n * (n - 1)) / (n - 2))


def rolling_kurt(x: Column | str, n: int) -> Column:
    """Bias-corrected excess kurtosis of a full window of n."""
    return F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(n + 1.0) * rolling("kurtosis", x, n) + 6)


def pairwise(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Both columns, NULL where either is."""
    both = col(a).isNotNull() & col(b).isNotNull()
    return F.when(both, col(a)), F.when(both, col(b))


def rolling_cov(a: Column | str, b: Column | str, n: int, least: int | None = None) -> Column:
    x, y = pairwise(a, b)
    return full(F.covar_samp(x, y).over(frame(n)), x, frame(n), n if least is None else least)


def rolling_corr(a: Column | str, b: Column | str, n: int, least: int | None = None) -> Column:
    """Pearson correlation, NULL where either side is constant (rule N3: never ``corr`` over a frame)."""
    x, y = pairwise(a, b)
    w = frame(n)
    value = ratio(F.covar_samp(x, y).over(w), F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w))
    return full(value, x, w, n if least is None else least)


def rolling_beta(a: Column | str, b: Column | str, n: int, least: int | None = None) -> Column:
    """cov(a, b) / var(b)."""
    x, y = pairwise(a, b)
    w = frame(n)
    return full(ratio(F.covar_samp(x, y).over(w), F.var_samp(y).over(w)), x, w, n if least is None else least)


def rolling_quantile(x: Column | str, n: int, p: float, least: int | None = None) -> Column:
    return full(F.percentile(col(x), F.lit(p)).over(frame(n)), x, frame(n), n if least is None else least)


def rolling_pct_rank(x: Column | str, n: int, least: int | None = None) -> Column:
    """Average percentile rank of this value among the last n: (less + (equal + 1) / 2) / count."""
    held = F.collect_list(col(x)).over(frame(n))
    less = F.size(F.filter(held, lambda v: v < col(x)))
    same = F.size(F.filter(held, lambda v: v == col(x)))
    value = (less + (same + 1) / 2) / F.size(held)
    return F.when(col(x).isNotNull() & (F.size(held) >= (n if least is None else least)), value)


def expanding(name: str, x: Column | str, least: int = 1) -> Column:
    return full(getattr(F, name)(col(x)).over(upto()), x, upto(), least)


def ffill(x: Column | str) -> Column:
    return F.last(col(x), ignorenulls=True).over(upto())


def bfill(x: Column | str) -> Column:
    """Looks ahead: only for parity with sources that do."""
    return F.last(col(x), ignorenulls=True).over(onwards())


def bars_since(condition: Column, index: Column | str = ORDER) -> Column:
    """Rows since the condition last held (0 where it holds), NULL before."""
    return col(index) - F.last(F.when(condition, col(index)), ignorenulls=True).over(upto())


def fir(x: Column | str, weights: list[float]) -> Column:
    """Sum of weights[k] * x lagged by k; NULL until all lags exist."""
    n = len(weights)
    held = F.collect_list(col(x)).over(frame(n))
    taps = F.array(*[F.lit(float(w)) for w in reversed(weights)])
    value = F.aggregate(F.zip_with(held, taps, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(held) == n, value)


def rolling_count(mask: Column, n: int) -> Column:
    """How often the mask held in the last n rows; NULL before n rows."""
    one = F.coalesce(mask, F.lit(False)).cast("int")
    return F.when(F.count(F.lit(1)).over(frame(n)) >= n, F.sum(one).over(frame(n)))


def rolling_slope(x: Column | str, n: int, index: Column | str = ORDER) -> Column:
    """Least-squares slope against the row index over a full window."""
    return full(F.regr_slope(col(x).cast("double"), col(index).cast("double")).over(frame(n)), x, frame(n), n)


def rolling_z(x: Column | str, n: int, least: int | None = None, unit: bool = True) -> Column:
    """(x - mean) / std over the last n; a zero std counts as 1 (``unit``) or yields NULL."""
    least = n if least is None else least
    std = rolling("stddev_samp", x, n, least)
    std = F.when(std == 0, F.lit(1.0)).otherwise(std) if unit else F.nullif(std, F.lit(0.0))
    return (col(x) - rolling("avg", x, n, least)) / std


def average_rank(x: Column | str, by: str) -> Column:
    """Rank from 1 with ties averaged, within ``by``."""
    w = Window.partitionBy(by).orderBy(col(x))
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(by, col(x))) - 1) / 2
