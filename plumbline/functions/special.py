"""Special functions as Column expressions: they stay in the JVM and need no UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_STEPS = 200
_TINY = 1e-300


def let(f, **values: Column) -> Column:
    """f of named values, each computed once: they become fields of a lambda variable instead of being repeated in the plan."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: Stirling's series at x + 10, shifted back by the product."""
    z = x + 10.0
    product = x
    for k in range(1, 10):
        product = product * (x + float(k))
    inverse = 1 / (z * z)
    # Bernoulli numbers over 2k(2k-1)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse * (1 / 1188 - inverse * (691 / 360360)))))) / z
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """1 + d1/(1 + d2/(1 + ...)), whose inverse is the continued fraction of the incomplete beta function, by the modified Lentz method, as a fold over half steps."""
    guard = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = F.when(k % 2 == 1, odd).otherwise(even)
        low, high = 1 / guard(1 + d * s["d"]), guard(1 + d / s["c"])
        return F.struct((s["f"] * low * high).alias("f"), high.alias("c"), low.alias("d"))

    start = F.struct(F.lit(1.0).alias("f"), F.lit(1.0).alias("c"), F.lit(0.0).alias("d"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), start, step, lambda s: s["f"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """Regularised I_x(a, b); `rest` is 1 - x where it is known more exactly."""
    y = 1 - x if rest is None else rest

    def inside(v: Column) -> Column:
        direct = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        front = F.exp(log_gamma(v["a"] + v["b"]) - log_gamma(v["a"]) - log_gamma(v["b"]) + v["a"] * F.log(v["x"]) + v["b"] * F.log(v["y"]))
        pick = lambda one, other: F.when(direct, v[one]).otherwise(v[other])
        part = let(lambda w: w["front"] / (_fraction(w["p"], w["q"], w["u"]) * w["p"]), p=pick("a", "b"), q=pick("b", "a"), u=pick("x", "y"), front=front)
        return F.when(v["x"] <= 0, 0.0).when(v["y"] <= 0, 1.0).otherwise(F.when(direct, part).otherwise(1 - part))

    return let(inside, a=a, b=b, x=x, y=y)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t.  Infinite or undefined t: 0; no degrees of freedom: null."""

    def inside(v: Column) -> Column:
        square, n = v["t"] * v["t"], v["n"]
        p = incomplete_beta(n / 2, F.lit(0.5), n / (n + square), square / (n + square))
        return F.when(~(n > 0), None).when(F.isnan(v["t"]) | (F.abs(v["t"]) == float("inf")), 0.0).when(v["t"] == 0, 1.0).otherwise(F.least(F.lit(1.0), p))

    return let(inside, t=t, n=df.cast("double"))


def t_cdf(t: Column, df: Column) -> Column:
    half = t_two_sided(t, df) / 2
    return F.when(t > 0, 1 - half).otherwise(half)


def t_quantile(p: Column, df: Column, steps: int = 60) -> Column:
    """Inverse of t_cdf by bisection on t / (1 + |t|), for 0 < p < 1."""

    def inside(v: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = (s["low"] + s["high"]) / 2
            t = mid / (1 - F.abs(mid))
            below = let(lambda w: F.when(w["t"] > 0, 1 - w["half"]).otherwise(w["half"]) < v["p"], t=t, half=t_two_sided(t, v["n"]) / 2)
            return let(lambda w: F.struct(F.when(w["below"], w["mid"]).otherwise(w["low"]).alias("low"), F.when(w["below"], w["high"]).otherwise(w["mid"]).alias("high")), below=below, mid=mid, low=s["low"], high=s["high"])

        start = F.struct(F.lit(-1.0).alias("low"), F.lit(1.0).alias("high"))
        at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
        return let(lambda w: w["at"] / (1 - F.abs(w["at"])), at=at)

    return let(inside, p=p.cast("double"), n=df.cast("double"))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7."""
    # The coefficients of formula 7.1.26.
    p, c = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(0.0)
    for k in reversed(c):
        poly = (poly + k) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def normal_two_sided(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def binomial_tail(hits: Column, n: Column, p0: Column) -> Column:
    """Exact P(X >= hits) of a binomial, summed in logarithms; 1 outside 0 <= hits <= n, n > 0."""
    top = log_gamma(n + 1.0)

    def add(s: Column, i: Column) -> Column:
        return s + F.exp(top - log_gamma(i + 1.0) - log_gamma(n - i + 1.0) + i * F.log(p0) + (n - i) * F.log(1 - p0))

    total = F.aggregate(F.sequence(hits.cast("int"), n.cast("int")), F.lit(0.0), add)
    return F.when((n <= 0) | (hits < 0) | (hits > n), 1.0).otherwise(F.least(F.lit(1.0), total))
