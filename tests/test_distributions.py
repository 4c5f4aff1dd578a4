"""Distribution functions as columns against the standard library and numerical integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import distributions as D
from quantloom.operators import statistics as E


def column(spark, made, *values):
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(*values)], ", ".join(f"c{i} double" for i in range(len(values))))
    return [r.y for r in df.select(made(*[F.col(f"c{i}") for i in range(len(values))]).alias("y")).collect()]


def test_error_function_and_normal_law(spark):
    x = [-9, -4, -2.5, -1, -0.3, 0, 1e-9, 0.5, 2.49999, 2.5, 3, 5, 8, 20]
    for got, v in zip(column(spark, D.erfc, x), x):
        assert got == pytest.approx(math.erfc(v), rel=1e-11, abs=1e-300)
    assert column(spark, D.erf, [0.7])[0] == pytest.approx(math.erf(0.7), abs=1e-15)
    p = [1e-12, 1e-5, 0.01, 0.3, 0.5, 0.77, 0.975, 0.999999]
    for got, v in zip(column(spark, D.normal_quantile, p), p):
        assert 0.5 * math.erfc(-got / math.sqrt(2)) == pytest.approx(v, rel=1e-11)
    assert column(spark, D.normal_quantile, [0, 1, 1.5, -1]) == [-math.inf, math.inf, None, None]


def test_log_gamma_and_incomplete_beta(spark):
    x = [0.01, 0.5, 1, 2, 3.7, 11, 50.5, 1e4, 1e9]
    for got, v in zip(column(spark, D.log_gamma, x), x):
        assert got == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-11)
    for a, b, v in ((2, 3, 0.3), (0.5, 0.5, 0.2), (5, 1, 0.9), (30, 0.5, 0.99), (4, 4, 0.5)):
        u = (np.arange(400_000) + 0.5) / 400_000
        s = u * u * (3 - 2 * u)  # gentle ends
        w = 6 * u * (1 - u) * s ** (a - 1) * (1 - s) ** (b - 1)
        assert column(spark, D.incomplete_beta, [a], [b], [v])[0] == pytest.approx(w[s < v].sum() / w.sum(), abs=2e-5)
    assert column(spark, D.incomplete_beta, [2, 2], [2, 2], [0, 1]) == [0, 1]


def test_student_tail(spark):
    known = [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e9, 0.05), (0, 5, 1.0), (3.3, 1500, 0.000989)]
    for t, n, p in known:
        assert column(spark, D.student_t_tail, [t], [n])[0] == pytest.approx(p, abs=2e-6)
    near = [column(spark, D.student_t_tail, [t], [n])[0] for t in (0.4, 2, 5) for n in (1000, 1000.0001)]
    assert all(a == pytest.approx(b, rel=1e-6) for a, b in zip(near[::2], near[1::2]))  # both forms meet
    for t, n in ((0.7, 2), (1.5, 7), (3, 30), (2, 999)):
        h = t / 20_000
        g = sum((1 if i in (0, 20_000) else 4 if i % 2 else 2) * (1 + (i * h) ** 2 / n) ** (-(n + 1) / 2) for i in range(20_001)) * h / 3
        assert column(spark, D.student_t_tail, [t], [n])[0] == pytest.approx(1 - 2 * g * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi), abs=1e-11)
    assert column(spark, D.student_t_tail, [1.0], [-1]) == [None]


def test_deflated_sharpe(spark):
    """Values worked out by hand from the definition: hurdle s * sqrt(2 ln N), s from skew and raw kurtosis."""
    cases = [(0.3, 200, -2, 20, 50, 1), (0.1, 1000, -1, 10, 1, 1), (1.5, 500, 0.2, 3.5, 10, 252), (0.2, 1, 0, 3, 5, 1), (0.2, 50, 0, 3, 0, 1)]
    for sr, n, skew, kurt, trials, annual in cases:
        raw = sr / math.sqrt(annual)
        want = 0.0
        if n > 1:
            s = math.sqrt((1 - skew * raw + (kurt - 1) / 4 * raw * raw) / (n - 1) * annual)
            hurdle = s * math.sqrt(2 * math.log(trials)) if trials > 1 else 0
            want = 0.5 * math.erfc(-(sr - hurdle) / s / math.sqrt(2))
        got = column(spark, lambda *c: E.deflated_sharpe(*c, annual=annual), [sr], [n], [skew], [kurt], [trials])[0]
        assert got == pytest.approx(want, abs=1e-12)
    assert [round(column(spark, E.deflated_sharpe, *[[v] for v in c[:5]])[0], 3) for c in cases[:2]] == [0.569, 0.999]
