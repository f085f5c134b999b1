"""Lookups on the cell table; each is a lazy filter and a small aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_of(agg: str) -> Column:
    """A cell's value: its sum, or its mean for averaged measures."""
    return F.when(F.col("n") > 0, F.col("sum") / F.col("n")) if agg == "avg" else F.col("sum")


def _total(cells: DataFrame, measure: str, grain: str) -> DataFrame:
    return cells.where((F.col("grain") == grain) & (F.col("measure") == measure) & F.col("dim_a").isNull())


def one_way(cells: DataFrame, dim: str, measure: str, grain: str) -> DataFrame:
    return cells.where((F.col("grain") == grain) & (F.col("measure") == measure) & (F.col("dim_a") == dim) & F.col("dim_b").isNull())


def all_periods(cells: DataFrame, grain: str) -> DataFrame:
    """Periods that occur, ascending."""
    return cells.where((F.col("grain") == grain) & F.col("dim_a").isNull()).select("period").distinct().orderBy("period")


def latest_period(cells: DataFrame, grain: str) -> DataFrame:
    return cells.where((F.col("grain") == grain) & F.col("dim_a").isNull()).agg(F.max("period").alias("period"))


def usable_grains(cells: DataFrame, least: int = 3) -> DataFrame:
    """Grains with at least `least` periods."""
    found = cells.where(F.col("dim_a").isNull()).groupBy("grain").agg(F.count_distinct("period").alias("periods"))
    return found.where(F.col("periods") >= least)


def resolve_grain(cells: DataFrame, requested: str | None = None, least: int = 3) -> str:
    """The requested grain if usable, else the first usable of month, quarter, year, week, day; then any that occurs."""
    have = {r["grain"]: r["periods"] for r in usable_grains(cells, 1).collect()}
    for floor in (least, 1):
        for g in (requested, "month", "quarter", "year", "week", "day"):
            if g and have.get(g, 0) >= floor:
                return g
    raise ValueError("the cells hold no period")


def breakdown(cells: DataFrame, dim: str, measure: str, grain: str, period: str, agg: str = "sum") -> DataFrame:
    """(label, value, n) of a dimension's members, largest first."""
    return one_way(cells, dim, measure, grain).where(F.col("period") == period).select(F.col("val_a").alias("label"), value_of(agg).alias("value"), "n").orderBy(F.desc("value"), "label")


def raw(cells: DataFrame, dim: str, measure: str, grain: str, period: str) -> DataFrame:
    """(label, sum, count, mean) of a dimension's members."""
    return one_way(cells, dim, measure, grain).where(F.col("period") == period).select(F.col("val_a").alias("label"), "sum", F.col("n").alias("count"), (F.col("sum") / F.col("n")).alias("mean"))


def trend(cells: DataFrame, measure: str, grain: str, agg: str = "sum", last: int | None = 12, dim: str | None = None, member: str | None = None) -> DataFrame:
    """(period, value, n, present) of the last periods of the whole table; a period without the member counts 0."""
    spine = all_periods(cells, grain)
    if last is not None:
        spine = spine.orderBy(F.desc("period")).limit(last)
    own = _total(cells, measure, grain) if dim is None else one_way(cells, dim, measure, grain).where(F.col("val_a") == member)
    own = own.select("period", value_of(agg).alias("v"), "n")
    return spine.join(own, "period", "left").select("period", F.coalesce("v", F.lit(0.0)).alias("value"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present")).orderBy("period")


def _with_delta(series: DataFrame, period: str) -> DataFrame:
    before = F.lag("value").over(Window.orderBy("period"))
    moved = series.withColumn("previous", before).where(F.col("period") == period)
    return moved.select("period", "value", "n", "previous", F.try_divide(F.col("value") - F.col("previous"), F.col("previous")).alias("delta"))


def total(cells: DataFrame, measure: str, grain: str, period: str, agg: str = "sum") -> DataFrame:
    """(period, value, n, previous, delta); delta is null without a previous value or where it is 0."""
    return _with_delta(trend(cells, measure, grain, agg, None), period)


def member_delta(cells: DataFrame, dim: str, member: str, measure: str, grain: str, period: str, agg: str = "sum") -> DataFrame:
    """The same for one member; a period without it counts 0."""
    return _with_delta(trend(cells, measure, grain, agg, None, dim, member), period)


def top_k(cells: DataFrame, dim: str, measure: str, grain: str, period: str, k: int = 5, agg: str = "sum", ascending: bool = False) -> DataFrame:
    """The k largest (or smallest) members."""
    return breakdown(cells, dim, measure, grain, period, agg).orderBy(F.col("value").asc() if ascending else F.desc("value"), "label").limit(k)


def find_pair(cells: DataFrame, dim_a: str, dim_b: str) -> DataFrame:
    """Two-way cells of a pair of dimensions, in either order; their columns are in name order."""
    a, b = sorted((dim_a, dim_b))
    return cells.where((F.col("dim_a") == a) & (F.col("dim_b") == b))


def cross_breakdown(cells: DataFrame, dim_a: str, dim_b: str, measure: str, grain: str, period: str, agg: str = "sum") -> DataFrame:
    """(label_a, label_b, value, n), largest first; label_a belongs to the dimension asked for first."""
    first, second = ("val_a", "val_b") if dim_a <= dim_b else ("val_b", "val_a")
    own = find_pair(cells, dim_a, dim_b).where((F.col("grain") == grain) & (F.col("measure") == measure) & (F.col("period") == period))
    return own.select(F.col(first).alias("label_a"), F.col(second).alias("label_b"), value_of(agg).alias("value"), "n").orderBy(F.desc("value"), "label_a", "label_b")


def cross_cell(cells: DataFrame, dim_a: str, dim_b: str, val_a: str, val_b: str, measure: str, grain: str, period: str, agg: str = "sum") -> DataFrame:
    return cross_breakdown(cells, dim_a, dim_b, measure, grain, period, agg).where((F.col("label_a") == val_a) & (F.col("label_b") == val_b))


def period_pair(cells: DataFrame, dim: str, measure: str, grain: str, before: str, after: str, agg: str = "sum") -> DataFrame:
    """(label, before, after, n_before, n_after) by conditional aggregation: no join; a missing side counts 0."""
    own = one_way(cells, dim, measure, grain).where(F.col("period").isin(before, after)).withColumn("v", value_of(agg))
    at = lambda p, c: F.coalesce(F.max(F.when(F.col("period") == p, F.col(c))), F.lit(0))
    return own.groupBy(F.col("val_a").alias("label")).agg(at(before, "v").alias("before"), at(after, "v").alias("after"), at(before, "n").alias("n_before"), at(after, "n").alias("n_after"))
