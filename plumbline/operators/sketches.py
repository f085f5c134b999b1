"""Mergeable sketches beside the cells: distinct members and quantiles of any period as lookups.

A row of day sketches holds an HLL sketch of a column's values and a KLL sketch of a measure for each member of a dimension;
both merge up the grains as counts and sums do.  Errors: about 1.04 / sqrt(2^LG_K) of a distinct count (one standard
deviation), and about 1.65 % of the rows in the rank of a quantile; `profile.quantiles` is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.timeaxis import day_of, period

LG_K = 12
#: Three standard deviations of the distinct count, and the rank error of a KLL sketch of k = 200 at 99 % confidence.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / (1 << LG_K) ** 0.5, 0.0165


def day_sketches(rows: DataFrame, time: str, dims: Sequence[str], distinct: str, measure: str) -> DataFrame:
    """(day, dim, val, n, distinct_sketch, value_sketch): totals under a null dim; null members, days and measures are left out."""
    day = day_of(F.col(time), rows.schema[time].dataType.simpleString())
    base = rows.select(day.alias("day"), *[F.col(d).cast("string").alias(f"d_{i}") for i, d in enumerate(dims)], F.col(distinct).cast("string").alias("x"), F.col(measure).cast("double").alias("m")).where("day IS NOT NULL AND m IS NOT NULL AND NOT isnan(m)")
    keys = ["day", *[f"d_{i}" for i in range(len(dims))]]
    sets = [["day"], *[["day", f"d_{i}"] for i in range(len(dims))]]
    found = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("x", LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double("m").alias("value_sketch"), *[F.grouping(k).alias(f"g_{k}") for k in keys[1:]]
    )
    dim = val = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        dim, val = F.when(F.col(f"g_d_{i}") == 0, d).otherwise(dim), F.when(F.col(f"g_d_{i}") == 0, F.col(f"d_{i}")).otherwise(val)
    return found.select("day", dim.alias("dim"), val.alias("val"), "n", "distinct_sketch", "value_sketch").where("dim IS NULL OR val IS NOT NULL")


def merged(sketches: DataFrame, grain: str) -> DataFrame:
    """(period, dim, val, n, distinct_sketch, value_sketch) of a grain, from day sketches."""
    keys = (period(F.col("day"), grain).alias("period"), "dim", "val")
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(sketches: DataFrame, ranks: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(period, dim, val, n, members, quantiles): the estimates that merged sketches give."""
    asked = F.array(*[F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(r))) for r in ranks])
    return sketches.select("period", "dim", "val", "n", F.hll_sketch_estimate("distinct_sketch").alias("members"), asked.alias("quantiles"))
