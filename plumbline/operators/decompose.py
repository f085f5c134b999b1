"""Decompositions of a change: additive contributions, and mix against rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import lookup

CAVEAT = "A decomposition says which cells moved; it does not say why, nor what would have happened otherwise."


def contribution(pairs: DataFrame, part: float = 0.8, by: list[str] | None = None) -> DataFrame:
    """(label, before, after) -> within each of `by`, plus delta, share of the total change, pct_change, position, cells_to_part.

    cells_to_part: how many members, largest change first, until their shares add up to `part`; all if they never do.
    Where nothing changed in total, shares are 0 and cells_to_part is null.
    """
    d = pairs.withColumn("delta", F.col("after") - F.col("before"))
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    order = everything.orderBy(F.desc(F.abs("delta")), "label")
    d = d.withColumn("share", F.coalesce(F.try_divide("delta", F.sum("delta").over(everything)), F.lit(0.0))).withColumn("pct_change", F.try_divide("delta", "before")).withColumn("position", F.row_number().over(order))
    d = d.withColumn("__covered", F.sum("share").over(order))
    reach = F.coalesce(F.min(F.when(F.col("__covered") >= part - 1e-12, F.col("position"))).over(everything), F.count("*").over(everything))
    return d.withColumn("cells_to_part", F.when(F.sum("delta").over(everything) != 0, reach).cast("int")).drop("__covered")


def mix_rate(cells: DataFrame) -> DataFrame:
    """(label, w0, r0, w1, r1) -> one row a member: rate, mix and interaction of the change of the weighted mean.

    Over shares s of the weights: rate s0*(r1-r0), mix (s1-s0)*r0, interaction (s1-s0)*(r1-r0); over all members their sum
    is the change of the blended rate.
    """
    whole = Window.partitionBy(F.lit(0))
    s0, s1 = (F.coalesce(F.try_divide(F.col(w), F.sum(w).over(whole)), F.lit(0.0)) for w in ("w0", "w1"))
    d = cells.withColumn("s0", s0).withColumn("s1", s1)
    move, turn = F.col("s1") - F.col("s0"), F.col("r1") - F.col("r0")
    return d.withColumn("rate", F.col("s0") * turn).withColumn("mix", move * F.col("r0")).withColumn("interaction", move * turn)


def mix_rate_summary(parts: DataFrame) -> DataFrame:
    """One row: blended before and after, change, rate, mix, interaction, dominant part, paradox flag."""
    s = parts.agg(F.sum(F.col("s0") * F.col("r0")).alias("before"), F.sum(F.col("s1") * F.col("r1")).alias("after"), F.sum("rate").alias("rate"), F.sum("mix").alias("mix"), F.sum("interaction").alias("interaction"))
    s = s.withColumn("change", F.col("after") - F.col("before"))
    dominant = F.when((F.abs("rate") >= F.abs("mix")) & (F.abs("rate") >= F.abs("interaction")), "rate").when(F.abs("mix") >= F.abs("interaction"), "mix").otherwise("interaction")
    return s.withColumn("dominant", dominant).withColumn("paradox", (F.signum("change") != F.signum("rate")) & (F.abs("rate") > 1e-12))


def weights(cells: DataFrame, dim: str, measure: str, grain: str, before: str, after: str) -> DataFrame:
    """(label, w0, r0, w1, r1): rows and mean of each member in two periods; a missing side counts 0."""
    p = lookup.period_pair(cells, dim, measure, grain, before, after, "avg")
    return p.select("label", F.col("n_before").cast("double").alias("w0"), F.col("before").alias("r0"), F.col("n_after").cast("double").alias("w1"), F.col("after").alias("r1"))


def explain_change(cells: DataFrame, dim: str, measure: str, grain: str, before: str, after: str, agg: str) -> DataFrame:
    """Contributions of a summed measure; mix and rate parts of an averaged one."""
    if agg == "avg":
        return mix_rate(weights(cells, dim, measure, grain, before, after))
    return contribution(lookup.period_pair(cells, dim, measure, grain, before, after))
