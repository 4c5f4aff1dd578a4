"""Distribution functions as Column expressions (SC02): error function, normal law, log gamma, incomplete beta, Student's t.

Power series and continued fractions of fixed depth, so that no row leaves the executors. Accurate to about 1e-12.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series of erf, steps of the fraction of erfc, and of that of the incomplete beta function.
TERMS, STEPS, BETA_STEPS = 70, 80, 200
_TINY = 1e-300


def bound(x: Column, make: Callable[[Column], Column]) -> Column:
    """``make(x)`` where x is computed once, however often ``make`` names it."""
    return F.element_at(F.transform(F.array(x.cast("double")), make), 1)


def _fold(count: int, start: Column, step: Callable[[Column, Column], Column], falling: bool = False) -> Column:
    """``step(state, k)`` for k from 1 to ``count``, or back from ``count`` to 1."""
    numbers = F.sequence(F.lit(count), F.lit(1)) if falling else F.sequence(F.lit(1), F.lit(count))
    return F.aggregate(numbers, start, lambda s, k: step(s, k.cast("double")))


def erfc(x: Column) -> Column:
    """The complementary error function: 1 less a power series up to 2.5, a continued fraction beyond."""

    def make(v: Column) -> Column:
        a = F.abs(v)
        pair = F.struct(a.alias("term"), a.alias("sum"))

        def add(s: Column, k: Column) -> Column:
            term = s["term"] * 2 * a * a / (2 * k + 1)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

        near = 1 - 2 / math.sqrt(math.pi) * F.exp(-a * a) * _fold(TERMS, pair, add)["sum"]
        far = F.exp(-a * a) / math.sqrt(math.pi) / _fold(STEPS, a, lambda s, k: a + k / 2 / s, falling=True)
        upper = F.when(a < 2.5, near).otherwise(far)
        return F.when(F.isnan(v), v).when(v >= 0, upper).otherwise(2 - upper)

    return bound(x, make)


def erf(x: Column) -> Column:
    return 1 - erfc(x)


def normal_cdf(x: Column) -> Column:
    return erfc(-x.cast("double") / math.sqrt(2)) / 2


def normal_quantile(p: Column) -> Column:
    """The x of which ``normal_cdf`` is p; infinite at 0 and 1, NULL outside.

    A rational start (good to 4.5e-4) and three Newton-Halley steps, in the lower half, where the tail is exact.
    """

    def make(q: Column) -> Column:
        low = F.least(q, 1 - q)
        t = F.sqrt(-2 * F.log(low))
        start = (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) - t

        def refine(x: Column, _: Column) -> Column:
            return bound((normal_cdf(x) - low) * math.sqrt(2 * math.pi) * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))

        x = _fold(3, start.cast("double"), refine)
        return F.when(q == 0, F.lit(-math.inf)).when(q == 1, F.lit(math.inf)).when((q > 0) & (q < 1), F.when(q <= 0.5, x).otherwise(-x))

    return bound(p, make)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series beyond 12, reached by the recurrence."""

    def make(v: Column) -> Column:
        shift = F.log(F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(1.0), lambda s, k: s * (v + k)))
        z = v + 12
        i = 1 / (z * z)
        tail = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * 691 / 360360))))) / z
        return F.when(v > 0, (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + tail - shift)

    return bound(x, make)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction on the side where it converges soon."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    case = F.struct(F.when(flip, b).otherwise(a).alias("p"), F.when(flip, a).otherwise(b).alias("q"), F.when(flip, 1 - x).otherwise(x).alias("y"), flip.alias("flip"))

    def make(s: Column) -> Column:
        p, q, y = s["p"], s["q"], s["y"]
        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y)) / p
        safe = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

        def step(state: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            term = F.when(k % 2 == 0, even).otherwise(odd)
            d = 1 / safe(1 + term * state["d"])
            c = safe(1 + term / state["c"])
            return F.struct((state["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

        start = F.struct(F.lit(1.0).alias("f"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"))
        value = front / _fold(BETA_STEPS, start, step)["f"]
        # the fraction itself is 1 / (1 + d1 / (1 + ...)); the fold holds its denominator
        return F.when(s["flip"], 1 - value).otherwise(value)

    inside = F.element_at(F.transform(F.array(case), make), 1)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_t_tail(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t; NULL without degrees of freedom.

    The incomplete beta function up to 1,000 degrees, and beyond a normal deviate corrected in powers of 1 / df.
    """
    t, df = F.abs(t.cast("double")), F.when(df > 0, df.cast("double"))

    def large(y: Column) -> Column:
        b = 48 * (df - 0.5) * (df - 0.5)
        z = (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * F.sqrt(y)
        return erfc(z / math.sqrt(2))

    return F.when(df <= 1000, incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))).when(df > 1000, bound((df - 0.5) * F.log1p(t * t / df), large))
