"""Hypothesis tests as Column expressions over sufficient statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.special import binomial_tail, t_quantile, t_two_sided

#: Share of the arithmetic ceiling within which a Grubbs statistic counts as having reached it.
CEILING_TOLERANCE = 1e-12


def leave_one_out(n: Column, total: Column, square: Column, x: Column) -> tuple[Column, Column]:
    """(mean, sample sd) of a group without one of its values, from count, sum and sum of squares."""
    m = n - 1
    mean = (total - x) / m
    var = (square - x * x - (total - x) * mean) / (m - 1)
    return mean, F.sqrt(F.greatest(var, F.lit(0.0)))


def p_value(t: Column, df: Column, times: Column | None = None, known: Column | None = None) -> Column:
    """Two-sided p of a t statistic, times a factor where one is given, 1 at most; `known` where the p is known already.

    Tests return what this needs instead of p itself, so that a search of many tests states the expression once.
    """
    p = t_two_sided(t, df)
    p = p if times is None else F.least(F.lit(1.0), F.coalesce(times, F.lit(1)) * p)
    return p if known is None else F.coalesce(known, p)


def grubbs(n: Column, g: Column) -> Column:
    """struct(t, df, times, known, ceiling, degenerate, low_power) of a two-sided Grubbs statistic of n values; see p_value."""
    limit = (n - 1) * (n - 1) / n
    room = limit - g * g
    degenerate = room <= CEILING_TOLERANCE * limit
    t = F.sqrt(g * g * (n - 2) / F.when(~degenerate, room))
    known = F.when(degenerate, F.when(n >= 6, 1e-6).otherwise(0.05))
    return F.struct(t.alias("t"), (n - 2).alias("df"), n.alias("times"), known.alias("known"), ((n - 1) / F.sqrt(n)).alias("ceiling"), degenerate.alias("degenerate"), (n < 6).alias("low_power"))


def extremes(members: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The member farthest from the mean of each group: its row with seen, total, square, mean, sd and the Grubbs statistic g."""
    w = Window.partitionBy(*by)
    v = F.col(value)
    d = members.withColumn("seen", F.count(v).over(w)).withColumn("total", F.sum(v).over(w)).withColumn("square", F.sum(v * v).over(w)).withColumn("mean", F.avg(v).over(w)).withColumn("sd", F.stddev_samp(v).over(w))
    far = F.row_number().over(w.orderBy(F.desc(F.abs(v - F.col("mean"))), F.desc(v), *[c for c in members.columns if c not in by and c != value]))
    return d.withColumn("__far", far).where("__far = 1").drop("__far").withColumn("g", F.abs(v - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")))


def robust_z(members: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds robust_z, the distance from the group's median in scaled MADs, or from its mean in sds where the MAD is zero,
    and basis, which of them it is.  A group is the members of one dimension, not data rows."""
    w, v = Window.partitionBy(*by), F.col(value)
    d = members.withColumn("__mid", F.median(v).over(w)).withColumn("__mean", F.avg(v).over(w)).withColumn("__sd", F.stddev_samp(v).over(w))
    d = d.withColumn("__mad", F.median(F.abs(v - F.col("__mid"))).over(w) * 1.4826)
    z = F.when(F.col("__mad") > 0, (v - F.col("__mid")) / F.col("__mad")).when(F.col("__sd") > 0, (v - F.col("__mean")) / F.col("__sd")).otherwise(0.0)
    return d.withColumn("robust_z", z).withColumn("basis", F.when(F.col("__mad") > 0, "mad").otherwise("sd")).drop("__mid", "__mean", "__sd", "__mad")


def last_point(latest: Column, n: Column, mean: Column, sd: Column) -> Column:
    """struct(t, df) of a new value against n earlier ones; t is null where the history is flat."""
    t = (latest - mean) / F.when(sd > 0, sd * F.sqrt(1 + 1 / n))
    return F.struct(t.alias("t"), (n - 1).alias("df"))


def persistence(hits: Column, periods: Column, members: Column) -> Column:
    """p of holding an extreme rank `hits` times in `periods` among `members`; 1 up to the expected number."""
    p0 = 1 / members.cast("double")
    return F.when((periods < 4) | (members < 2), None).when(hits <= periods * p0, 1.0).otherwise(binomial_tail(hits, periods, p0))


def welch(n1: Column, s1: Column, q1: Column, n2: Column, s2: Column, q2: Column) -> Column:
    """struct(t, df, mean1, mean2, effect) from count, sum and sum of squares of two groups; null if untestable."""
    m1, m2 = s1 / n1, s2 / n2
    v1, v2 = F.greatest((q1 - s1 * m1) / (n1 - 1), F.lit(0.0)), F.greatest((q2 - s2 * m2) / (n2 - 1), F.lit(0.0))
    e1, e2 = v1 / n1, v2 / n2
    se = F.when((n1 > 1) & (n2 > 1) & (e1 + e2 > 0), e1 + e2)
    t = (m1 - m2) / F.sqrt(se)
    df = se * se / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(se.isNotNull(), F.struct(t.alias("t"), df.alias("df"), m1.alias("mean1"), m2.alias("mean2"), ((m1 - m2) / F.when(pooled > 0, pooled)).alias("effect")))


def correlation(n: Column, r: Column) -> Column:
    """struct(t, p, low, high): test and 95 % Fisher interval of a correlation of n pairs (interval from n > 3)."""
    t = r * F.sqrt((n - 2) / F.when(r * r < 1, 1 - r * r))
    z, half = F.atanh(F.when(F.abs(r) < 1, r)), 1.959963984540054 / F.sqrt(F.when(n > 3, n - 3))
    p = F.when(n < 3, None).when(r * r >= 1, 0.0).otherwise(t_two_sided(t, n - 2))
    return F.struct(t.alias("t"), p.alias("p"), F.tanh(z - half).alias("low"), F.tanh(z + half).alias("high"))


def benjamini_hochberg(df: DataFrame, p: str = "p", q: str = "q", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds q-values over the rows with a p, null for the others.  One task sorts them: they are tests, bounded by the cells
    of one period."""
    d = df.withColumn("__rank", F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last(), *ties))).withColumn("__n", F.count(p).over(Window.partitionBy(F.lit(0))))
    after = Window.orderBy("__rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = F.min(F.col(p) * F.col("__n") / F.col("__rank")).over(after)
    return d.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), found))).drop("__rank", "__n")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank of a value within `by`, ties sharing the mean of their ranks."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def mean_interval(n: Column, mean: Column, sd: Column, confidence: float = 0.95) -> Column:
    """struct(mean, low, high) of a t interval; null for fewer than two values."""
    half = t_quantile(F.lit(0.5 + confidence / 2), n - 1) * sd / F.sqrt(n)
    return F.when(n > 1, F.struct(mean.alias("mean"), (mean - half).alias("low"), (mean + half).alias("high")))
