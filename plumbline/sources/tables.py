"""Analysis frames over the star-schema Parquet tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cells import build_cells, select_pairs
from plumbline.sources.store import keep, release

SALES_DIMS = ("r_name", "n_name", "c_mktsegment", "o_orderpriority", "l_returnflag")
SALES_MEASURES = {"price": "sum", "quantity": "sum", "discount": "avg"}
EVENT_DIMS, EVENT_MEASURES = ("event_type",), {"value": "sum"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, days: tuple[date, date] | None = None) -> DataFrame:
    """Order lines with the dimensions of order, customer, nation and region; of the given days only, if given.

    Days become a filter on the stored column, so the scan prunes.  No join is hinted: nation and region are small enough
    for the planner to broadcast by their size, orders and customer are so only where their size allows it.
    """
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customer = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    orders = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_mktsegment", "n_name", "r_name")
    lines = read(spark, sf_dir, "lineitem")
    if days:
        lines = lines.where((F.col("l_shipdate") >= F.lit(days[0])) & (F.col("l_shipdate") < F.lit(days[1] + timedelta(days=1))))
    lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("l_shipdate").cast("date").alias("day"), *SALES_DIMS, F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


_stored: dict[tuple[str, str], DataFrame] = {}


def sales_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all grains, dimensions, measures and affordable pairs of the sales, built once a session and table folder.

    They are kept by grain in the shared folder, and every lookup and search reads them there.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        rows = keep(sales(spark, sf_dir))  # joined once: the members, the sizes of the plan and the cells are three passes
        members = rows.agg(*[F.approx_count_distinct(d, 0.01).alias(d) for d in SALES_DIMS]).first().asDict()
        cells = build_cells(rows, "day", SALES_DIMS, list(SALES_MEASURES), select_pairs(members))
        _stored[key] = keep(cells.repartition("grain", "dim_a"), by="grain")
        release(rows)
    return _stored[key]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "value")
