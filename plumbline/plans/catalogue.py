"""Registered queries of the engine over the star-schema tables, with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import hypotheses as tests
from plumbline.functions.timeaxis import GRAINS, parse_day, period_range
from plumbline.operators import cells as cube
from plumbline.operators import decompose, discover, lookup, profile
from plumbline.sources import tables

MONTH, BEFORE = "2001-10", "2001-09"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SALES_SQL = """sales AS (
  SELECT CAST(l_shipdate AS DATE) AS day, r_name, n_name, c_mktsegment, o_orderpriority, l_returnflag,
         l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
KEY_SQL = {
    "day": "strftime(day, '%Y-%m-%d')", "week": "strftime(day, '%G-W%V')", "month": "strftime(day, '%Y-%m')",
    "quarter": "CAST(year(day) AS VARCHAR) || '-Q' || CAST(quarter(day) AS VARCHAR)", "year": "strftime(day, '%Y')",
}
M = KEY_SQL["month"]


def query(sql: str | None = None, on_sales: bool = True):
    """Register a query; `sql` goes on after the common table `sales` unless it stands alone."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"WITH {SALES_SQL}{sql}" if on_sales else sql
        return f

    return add


def sales_cells(spark: SparkSession, sf_dir: str, dims=("r_name",), measures=("price",), pairs=(), grains=("month",)) -> DataFrame:
    """The kept cells of these dimensions, measures, pairs and grains."""
    one = F.col("dim_b").isNull() & (F.col("dim_a").isNull() | F.col("dim_a").isin(list(dims)))
    for a, b in pairs:
        one = one | ((F.col("dim_a") == min(a, b)) & (F.col("dim_b") == max(a, b)))
    return tables.sales_cells(spark, sf_dir).where(F.col("grain").isin(list(grains)) & F.col("measure").isin(list(measures)) & one)


def built_cells(spark: SparkSession, sf_dir: str, dims=("r_name",), measures=("price",), pairs=(), grains=("month",)) -> DataFrame:
    """The same, computed from the rows."""
    return cube.build_cells(tables.sales(spark, sf_dir), "day", dims, measures, pairs, grains=grains)


def money(*names: str) -> list:
    return [F.round(n, 2).alias(n) for n in names]


@query(f" SELECT r_name AS label, round(sum(price), 2) AS value, count(*) AS n FROM sales WHERE {M} = '{MONTH}' GROUP BY 1")
def breakdown(spark, sf_dir):
    """Price by region in one month."""
    return lookup.breakdown(sales_cells(spark, sf_dir), "r_name", "price", "month", MONTH).select("label", *money("value"), "n")


@query(f", m AS (SELECT {M} AS period, round(sum(price), 2) AS value, count(*) AS n FROM sales GROUP BY 1) SELECT period, value, n, true AS present FROM m ORDER BY period DESC LIMIT 12")
def trend(spark, sf_dir):
    """Total price of the last 12 months."""
    return lookup.trend(sales_cells(spark, sf_dir), "price", "month").select("period", *money("value"), "n", "present")


@query(f""", p AS (SELECT DISTINCT {M} AS period FROM sales), m AS (SELECT {M} AS period, sum(price) AS v, count(*) AS n FROM sales WHERE n_name = 'FRANCE' GROUP BY 1)
SELECT period, round(coalesce(v, 0), 2) AS value, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM p LEFT JOIN m USING (period)""")
def member_trend(spark, sf_dir):
    """All months of one nation; months without it count 0."""
    cells = sales_cells(spark, sf_dir, ("n_name",))
    return lookup.trend(cells, "price", "month", last=None, dim="n_name", member="FRANCE").select("period", *money("value"), "n", "present")


@query(f", m AS (SELECT {M} AS period, sum(price) AS v, count(*) AS n FROM sales GROUP BY 1), d AS (SELECT *, lag(v) OVER (ORDER BY period) AS b FROM m) SELECT period, round(v, 2) AS value, n, round(b, 2) AS previous, round((v - b) / b, 6) AS delta FROM d WHERE period = '{MONTH}'")
def total_delta(spark, sf_dir):
    """Total of a month and its change on the month before."""
    return lookup.total(sales_cells(spark, sf_dir), "price", "month", MONTH).select("period", *money("value"), "n", *money("previous"), F.round("delta", 6).alias("delta"))


@query(f""", p AS (SELECT DISTINCT {M} AS period FROM sales), m AS (SELECT {M} AS period, sum(price) AS s, count(*) AS c FROM sales WHERE r_name = 'ASIA' GROUP BY 1),
f AS (SELECT period, coalesce(s, 0) AS v, coalesce(c, 0) AS n FROM p LEFT JOIN m USING (period)), d AS (SELECT *, lag(v) OVER (ORDER BY period) AS b FROM f)
SELECT period, round(v, 2) AS value, n, round(b, 2) AS previous, round((v - b) / b, 6) AS delta FROM d WHERE period = '{MONTH}'""")
def member_delta(spark, sf_dir):
    """One region's change on the month before."""
    return lookup.member_delta(sales_cells(spark, sf_dir), "r_name", "ASIA", "price", "month", MONTH).select("period", *money("value"), "n", *money("previous"), F.round("delta", 6).alias("delta"))


@query(f" SELECT n_name AS label, round(sum(price), 2) AS value, count(*) AS n FROM sales WHERE {M} = '{MONTH}' GROUP BY 1 ORDER BY sum(price) DESC, 1 LIMIT 5")
def topk(spark, sf_dir):
    """The five largest nations of a month."""
    return lookup.top_k(sales_cells(spark, sf_dir, ("n_name",)), "n_name", "price", "month", MONTH).select("label", *money("value"), "n")


@query(f" SELECT n_name AS label, round(sum(price), 2) AS value, count(*) AS n FROM sales WHERE {M} = '{MONTH}' GROUP BY 1 ORDER BY sum(price), 1 LIMIT 5")
def bottomk(spark, sf_dir):
    """The five smallest nations of a month."""
    return lookup.top_k(sales_cells(spark, sf_dir, ("n_name",)), "n_name", "price", "month", MONTH, ascending=True).select("label", *money("value"), "n")


@query(f" SELECT r_name AS label_a, l_returnflag AS label_b, round(avg(discount), 6) AS value, count(*) AS n FROM sales WHERE {M} = '{MONTH}' GROUP BY 1, 2")
def cross_breakdown(spark, sf_dir):
    """Mean discount by region and return flag."""
    cells = sales_cells(spark, sf_dir, ("r_name", "l_returnflag"), ("discount",), [("r_name", "l_returnflag")])
    return lookup.cross_breakdown(cells, "r_name", "l_returnflag", "discount", "month", MONTH, "avg").select("label_a", "label_b", F.round("value", 6).alias("value"), "n")


@query(f" SELECT 'R' AS label_a, 'ASIA' AS label_b, round(sum(price), 2) AS value, count(*) AS n FROM sales WHERE {M} = '{MONTH}' AND r_name = 'ASIA' AND l_returnflag = 'R' HAVING count(*) > 0")
def cross_cell(spark, sf_dir):
    """One two-way cell, its dimensions asked for against name order."""
    cells = sales_cells(spark, sf_dir, ("r_name", "l_returnflag"), ("price",), [("r_name", "l_returnflag")])
    return lookup.cross_cell(cells, "l_returnflag", "r_name", "R", "ASIA", "price", "month", MONTH).select("label_a", "label_b", *money("value"), "n")


PAIR_SQL = f"pair AS (SELECT r_name AS label, coalesce(sum(price) FILTER (WHERE {M} = '{BEFORE}'), 0) AS before, coalesce(sum(price) FILTER (WHERE {M} = '{MONTH}'), 0) AS after, count(*) FILTER (WHERE {M} = '{BEFORE}') AS n_before, count(*) FILTER (WHERE {M} = '{MONTH}') AS n_after FROM sales WHERE {M} IN ('{BEFORE}', '{MONTH}') GROUP BY 1)"


@query(f", {PAIR_SQL} SELECT label, round(before, 2) AS before, round(after, 2) AS after, n_before, n_after FROM pair")
def period_pair(spark, sf_dir):
    """Regions in two months side by side."""
    return lookup.period_pair(sales_cells(spark, sf_dir), "r_name", "price", "month", BEFORE, MONTH).select("label", *money("before", "after"), "n_before", "n_after")


@query(f""", {PAIR_SQL}, d AS (SELECT *, after - before AS delta FROM pair), s AS (SELECT *, delta / sum(delta) OVER () AS share, row_number() OVER (ORDER BY abs(delta) DESC, label) AS position FROM d),
c AS (SELECT *, sum(share) OVER (ORDER BY position) AS covered FROM s)
SELECT label, round(delta, 2) AS delta, round(share, 6) AS share, round(delta / nullif(before, 0), 6) AS pct_change, position,
       CAST(coalesce((SELECT min(position) FROM c WHERE covered >= 0.8 - 1e-12), (SELECT count(*) FROM c)) AS INTEGER) AS cells_to_part FROM c""")
def contribution(spark, sf_dir):
    """What each region adds to the change of a month, and how many carry 80 % of it."""
    d = decompose.contribution(lookup.period_pair(sales_cells(spark, sf_dir), "r_name", "price", "month", BEFORE, MONTH))
    return d.select("label", *money("delta"), F.round("share", 6).alias("share"), F.round("pct_change", 6).alias("pct_change"), "position", "cells_to_part")


WEIGHT_SQL = f"w AS (SELECT r_name AS label, count(*) FILTER (WHERE {M} = '{BEFORE}') AS w0, coalesce(avg(discount) FILTER (WHERE {M} = '{BEFORE}'), 0) AS r0, count(*) FILTER (WHERE {M} = '{MONTH}') AS w1, coalesce(avg(discount) FILTER (WHERE {M} = '{MONTH}'), 0) AS r1 FROM sales WHERE {M} IN ('{BEFORE}', '{MONTH}') GROUP BY 1), x AS (SELECT *, w0 / CAST(sum(w0) OVER () AS DOUBLE) AS s0, w1 / CAST(sum(w1) OVER () AS DOUBLE) AS s1 FROM w)"


@query(f", {WEIGHT_SQL} SELECT label, round(s0, 8) AS s0, round(s1, 8) AS s1, round(s0 * (r1 - r0), 8) AS rate, round((s1 - s0) * r0, 8) AS mix, round((s1 - s0) * (r1 - r0), 8) AS interaction FROM x")
def mix_rate(spark, sf_dir):
    """Rate and mix parts of the change of the mean discount, by region."""
    cells = sales_cells(spark, sf_dir, measures=("discount",))
    return decompose.mix_rate(decompose.weights(cells, "r_name", "discount", "month", BEFORE, MONTH)).select("label", *[F.round(c, 8).alias(c) for c in ("s0", "s1", "rate", "mix", "interaction")])


@query(f", {WEIGHT_SQL}, t AS (SELECT sum(s0 * r0) AS b, sum(s1 * r1) AS a, sum(s0 * (r1 - r0)) AS rate, sum((s1 - s0) * r0) AS mix FROM x) SELECT round(a - b, 8) AS change, round(rate, 8) AS rate, round(mix, 8) AS mix, sign(a - b) <> sign(rate) AND abs(rate) > 1e-12 AS paradox FROM t")
def mix_rate_summary(spark, sf_dir):
    """The same in total, with the sign of a Simpson reversal."""
    cells = sales_cells(spark, sf_dir, measures=("discount",))
    s = decompose.mix_rate_summary(decompose.mix_rate(decompose.weights(cells, "r_name", "discount", "month", BEFORE, MONTH)))
    return s.select(*[F.round(c, 8).alias(c) for c in ("change", "rate", "mix")], "paradox")


@query(f" SELECT c_mktsegment AS label, round(sum(quantity), 2) AS sum, count(*) AS count, round(avg(quantity), 6) AS mean FROM sales WHERE {M} = '{MONTH}' GROUP BY 1")
def raw_mean(spark, sf_dir):
    """Sum, rows and mean of each segment."""
    return lookup.raw(sales_cells(spark, sf_dir, ("c_mktsegment",), ("quantity",)), "c_mktsegment", "quantity", "month", MONTH).select("label", *money("sum"), "count", F.round("mean", 6).alias("mean"))


@query(f" SELECT DISTINCT {KEY_SQL['quarter']} AS period FROM sales")
def all_periods(spark, sf_dir):
    """Quarters that occur."""
    return lookup.all_periods(sales_cells(spark, sf_dir, (), grains=("quarter",)), "quarter")


@query(f" SELECT max({KEY_SQL['week']}) AS period FROM sales")
def latest_period(spark, sf_dir):
    """The latest week."""
    return lookup.latest_period(sales_cells(spark, sf_dir, (), grains=("week",)), "week")


_EVENT_GRAINS = " UNION ALL ".join(f"SELECT '{g}' AS grain, count(DISTINCT {KEY_SQL[g]}) AS periods FROM (SELECT CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL)" for g in GRAINS)


@query(f"SELECT * FROM ({_EVENT_GRAINS}) WHERE periods >= 3", on_sales=False)
def usable_grains(spark, sf_dir):
    """Grains of the events with three periods or more."""
    return lookup.usable_grains(cube.build_cells(tables.events(spark, sf_dir), "day", tables.EVENT_DIMS, ["value"]))


def _cells_sql(grain: str) -> str:
    key = KEY_SQL[grain]
    parts = [f"SELECT {key} AS period, CAST(NULL AS VARCHAR) AS dim_a, CAST(NULL AS VARCHAR) AS val_a, count(price) AS n, round(sum(price), 2) AS sum, round(min(price), 2) AS min, round(max(price), 2) AS max FROM sales GROUP BY 1"]
    parts += [f"SELECT {key}, '{d}', {d}, count(price), round(sum(price), 2), round(min(price), 2), round(max(price), 2) FROM sales WHERE {d} IS NOT NULL GROUP BY 1, 3" for d in ("r_name", "l_returnflag")]
    return ", c AS (" + " UNION ALL ".join(parts) + ") SELECT * FROM c"


def _cells_query(grain: str):
    def run(spark, sf_dir):
        out = built_cells(spark, sf_dir, ("r_name", "l_returnflag"), grains=(grain,))
        return out.select("period", "dim_a", "val_a", "n", *money("sum", "min", "max"))

    run.__name__, run.__doc__ = f"cells_{grain}", f"Totals and one-way cells by {grain}."
    return query(_cells_sql(grain))(run)


for _g in GRAINS:
    _cells_query(_g)


@query(f" SELECT {M} AS period, n_name AS val_a, r_name AS val_b, count(*) AS n, round(sum(quantity), 2) AS sum, round(sum(quantity * quantity), 2) AS sum_sq FROM sales GROUP BY 1, 2, 3")
def cells_pair(spark, sf_dir):
    """Two-way cells of nation and region by month."""
    out = built_cells(spark, sf_dir, ("n_name", "r_name"), ("quantity",), [("n_name", "r_name")])
    return out.where("dim_b IS NOT NULL").select("period", "val_a", "val_b", "n", *money("sum", "sum_sq"))


@query(f", k AS (SELECT {M} AS p, r_name FROM sales GROUP BY ALL), t AS (SELECT DISTINCT {M} AS p FROM sales) SELECT 'month' AS grain, (SELECT count(*) FROM k) + (SELECT count(*) FROM t) AS cells")
def cell_count(spark, sf_dir):
    """Month cells, totals included."""
    return cube.count_cells(sales_cells(spark, sf_dir))


@query("""SELECT * FROM (SELECT 'c_mktsegment' AS name, count(*) AS rows, count(c_mktsegment) AS non_null, count(DISTINCT c_mktsegment) AS "unique", 0 AS numbers FROM customer
UNION ALL SELECT 'c_acctbal', count(*), count(c_acctbal), count(DISTINCT c_acctbal), count(c_acctbal) FROM customer)""", on_sales=False)
def profile_counts(spark, sf_dir):
    """Counts behind the role rules, for two columns of customer."""
    stats = profile.column_statistics(tables.read(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"))
    return spark.createDataFrame([(s["name"], s["rows"], s["non_null"], s["unique"], s["numbers"]) for s in stats], "name string, rows long, non_null long, unique long, numbers long")


@query(" SELECT round(quantile_cont(price, CAST(0.05 AS DOUBLE)), 4) AS p05, round(quantile_cont(price, CAST(0.5 AS DOUBLE)), 4) AS p50, round(quantile_cont(price, CAST(0.95 AS DOUBLE)), 4) AS p95 FROM sales")
def percentiles(spark, sf_dir):
    """Exact type-7 percentiles."""
    q = profile.quantiles(tables.read(spark, sf_dir, "lineitem"), "l_extendedprice", (0.05, 0.5, 0.95))
    return spark.createDataFrame([tuple(round(x, 4) for x in q)], "p05 double, p50 double, p95 double")


@query(" SELECT round((var_samp(quantity) + avg(quantity) ** 2) / avg(quantity), 6) AS dispersion FROM sales")
def dispersion_index(spark, sf_dir):
    """(variance + mean squared) / mean of quantities, as the profile holds it."""
    s = profile.column_statistics(tables.read(spark, sf_dir, "lineitem").select("l_quantity"))[0]
    return spark.createDataFrame([(round(profile.dispersion(s["mean"], s["sd"], s["low"]), 6),)], "dispersion double")


NATION_SQL = f"b AS (SELECT n_name AS label, CAST(sum(quantity) AS DOUBLE) AS v, count(*) AS n FROM sales WHERE {M} = '{MONTH}' GROUP BY 1)"


def nations(spark, sf_dir) -> DataFrame:
    return lookup.breakdown(sales_cells(spark, sf_dir, ("n_name",), ("quantity",)), "n_name", "quantity", "month", MONTH).withColumnRenamed("value", "v")


@query(f", {NATION_SQL}, c AS (SELECT median(v) AS med FROM b), d AS (SELECT 1.4826 * median(abs(v - med)) AS mad FROM b, c) SELECT label, round((v - med) / mad, 6) AS robust_z FROM b, c, d")
def mad_robust_z(spark, sf_dir):
    """Deviation of each nation from the median in scaled MADs."""
    return tests.robust_z(nations(spark, sf_dir).withColumn("o", F.lit(0)), "v", ["o"]).select("label", F.round("robust_z", 6).alias("robust_z"))


@query(f", {NATION_SQL} SELECT label, n, round(abs(v) / sum(abs(v)) OVER (), 6) AS share, CASE WHEN n < 30 THEN 'low row count' WHEN abs(v) / sum(abs(v)) OVER () < 0.005 THEN 'negligible share' END AS dropped FROM b")
def support_filter(spark, sf_dir):
    """Which nations carry a claim in a month, and why not."""
    own = discover.supported(sales_cells(spark, sf_dir, ("n_name",), ("quantity",)), {"quantity": "sum"}, "month", discover.Settings())
    return own.where(F.col("period") == MONTH).select(F.col("value").alias("label"), "n", F.round("share", 6).alias("share"), "dropped")


@query(f", {NATION_SQL} SELECT count(*) AS members, round(max(abs(v - m)) / any_value(s), 8) AS g FROM b, (SELECT avg(v) AS m, stddev_samp(v) AS s FROM b)")
def grubbs_g(spark, sf_dir):
    """Grubbs statistic of the most extreme nation."""
    top = tests.extremes(nations(spark, sf_dir).select("label", "v").withColumn("o", F.lit(0)), "v", ["o"])
    return top.select(F.col("seen").alias("members"), F.round("g", 8).alias("g"))


@query(f", {NATION_SQL}, t AS (SELECT count(*) AS k, sum(v) AS s, sum(v * v) AS q FROM b) SELECT label, round((v - (s - v) / (k - 1)) / sqrt((q - v * v - (s - v) * (s - v) / (k - 1)) / (k - 2)), 5) AS d FROM b, t")
def cohens_d(spark, sf_dir):
    """Distance of each nation from all others in their sds."""
    w = Window.partitionBy(F.lit(0))
    b = nations(spark, sf_dir).withColumn("k", F.count("*").over(w)).withColumn("s", F.sum("v").over(w)).withColumn("q", F.sum(F.col("v") * F.col("v")).over(w))
    mean, sd = tests.leave_one_out(F.col("k"), F.col("s"), F.col("q"), F.col("v"))
    return b.select("label", F.round((F.col("v") - mean) / sd, 5).alias("d"))


@query(f""", g AS (SELECT r_name, l_returnflag, count(*) AS n, sum(quantity) AS s, sum(quantity * quantity) AS q FROM sales WHERE {KEY_SQL['year']} = '2000' GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q FROM g),
x AS (SELECT r_name, l_returnflag, g.n AS n1, t.n - g.n AS n2, g.s / g.n AS m1, (t.s - g.s) / (t.n - g.n) AS m2, (g.q - g.s * g.s / g.n) / (g.n - 1) / g.n AS e1, ((t.q - g.q) - (t.s - g.s) * (t.s - g.s) / (t.n - g.n)) / (t.n - g.n - 1) / (t.n - g.n) AS e2 FROM g, t)
SELECT r_name AS value_b, l_returnflag AS value, round((m1 - m2) / sqrt(e1 + e2), 6) AS t, round((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 3) AS df FROM x""")
def welch_t(spark, sf_dir):
    """Welch statistic of each region and return flag against everything else, year 2000."""
    days = (period_range("2000", "year")[0], period_range("2000", "year")[1])
    c = cube.build_cells(tables.sales(spark, sf_dir, days), "day", ("r_name", "l_returnflag"), ("quantity",), [("r_name", "l_returnflag")], ("year",), ("year",))
    c = discover.against_rest(c.where("dim_b IS NOT NULL AND period = '2000'"))
    return c.select(F.col("val_b").alias("value_b"), F.col("val_a").alias("value"), F.round("t.t", 6).alias("t"), F.round("t.df", 3).alias("df"))


@query(f""", p AS (SELECT n_name, {M} AS period, CAST(sum(quantity) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), r AS (SELECT *, dense_rank() OVER (ORDER BY period DESC) AS back FROM p WHERE period <= '{MONTH}'),
h AS (SELECT n_name, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s FROM r WHERE back BETWEEN 2 AND 13 GROUP BY 1)
SELECT n_name AS value, h.n AS history_n, round((v - m) / (s * sqrt(1 + 1 / CAST(h.n AS DOUBLE))), 6) AS t FROM r JOIN h USING (n_name) WHERE back = 1 AND h.n >= 5 AND s > 0""")
def last_point_t(spark, sf_dir):
    """The latest month of each nation against its own last twelve."""
    s = discover.Settings(min_rows=0, min_share=0.0)
    own = discover.supported(sales_cells(spark, sf_dir, ("n_name",), ("quantity",)), {"quantity": "sum"}, "month", s)
    return discover.temporal_candidates(own, MONTH, s).select("value", "history_n", F.round("statistic", 6).alias("t"))


TOP_SQL = f"p AS (SELECT {M} AS period, c_mktsegment AS value, sum(price) AS v FROM sales WHERE {M} <= '{MONTH}' GROUP BY 1, 2), w AS (SELECT * FROM p WHERE period IN (SELECT DISTINCT period FROM p ORDER BY period DESC LIMIT 24)), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY v DESC, value) AS t FROM w), h AS (SELECT value, count(*) FILTER (WHERE t = 1) AS hits FROM r GROUP BY 1)"


@query(f", {TOP_SQL} SELECT value, hits FROM h WHERE hits > 0")
def rank_persistence_hits(spark, sf_dir):
    """In how many of 24 months a segment was the highest."""
    return _persistence(spark, sf_dir).where("extreme = 'top'").select("value", "hits")


def _persistence(spark, sf_dir) -> DataFrame:
    s = discover.Settings(min_rows=0, min_share=0.0, trim_persistence=False)
    own = discover.supported(sales_cells(spark, sf_dir, ("c_mktsegment",)), {"price": "sum"}, "month", s)
    return discover.persistence_candidates(own, MONTH, s)


@query(f", {TOP_SQL}, k AS (SELECT value, hits, unnest(range(hits, 25)) AS i FROM h WHERE hits > 0) SELECT value, round(CASE WHEN any_value(hits) <= 24 / 5.0 THEN 1.0 ELSE sum(exp(lgamma(25) - lgamma(i + 1) - lgamma(25 - i) + i * ln(0.2) + (24 - i) * ln(0.8))) END, 8) AS p FROM k GROUP BY value")
def binomial_tail(spark, sf_dir):
    """Exact probability of that persistence among five alike segments."""
    return _persistence(spark, sf_dir).where("extreme = 'top'").select("value", F.round("__known", 8).alias("p"))


@query(f""", v AS (SELECT n_name, {M} AS period, CAST(sum(price) AS DOUBLE) AS x FROM sales GROUP BY 1, 2), h AS (SELECT n_name, x FROM v WHERE period = '{MONTH}'),
p AS (SELECT n_name AS id, count(*) FILTER (WHERE v.x >= h.x) / CAST(count(*) AS DOUBLE) AS p FROM v JOIN h USING (n_name) GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM p)
SELECT id, round(p, 6) AS p, round(least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM r""")
def bh_qvalues(spark, sf_dir):
    """Benjamini-Hochberg over nations: how high the month ranks among all months of each."""
    v = sales_cells(spark, sf_dir, ("n_name",)).where("dim_a = 'n_name'").select(F.col("val_a").alias("id"), "period", "sum")
    here = F.max(F.when(F.col("period") == MONTH, F.col("sum"))).over(Window.partitionBy("id"))
    p = v.withColumn("here", here).where("here IS NOT NULL").groupBy("id").agg((F.count(F.when(F.col("sum") >= F.col("here"), 1)) / F.count("*")).alias("p"))
    return tests.benjamini_hochberg(p, ties=("id",)).select("id", F.round("p", 6).alias("p"), F.round("q", 8).alias("q"))


VECTOR_SQL = f"v AS (SELECT n_name, sum(price) AS x, sum(quantity) AS y FROM sales WHERE {M} = '{MONTH}' GROUP BY 1)"


def _vectors(spark, sf_dir) -> DataFrame:
    c = sales_cells(spark, sf_dir, ("n_name",), ("price", "quantity")).where((F.col("period") == MONTH) & F.col("dim_a").isNotNull())
    at = lambda m: F.max(F.when(F.col("measure") == m, F.col("sum")))
    return c.groupBy("val_a").agg(at("price").alias("x"), at("quantity").alias("y"))


@query(f", {VECTOR_SQL} SELECT count(*) AS n, round(corr(x, y), 8) AS r FROM v")
def pearson_r(spark, sf_dir):
    """Correlation of price and quantity over nations."""
    return _vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 8).alias("r"))


@query(f", {VECTOR_SQL}, k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM v) SELECT count(*) AS n, round(corr(a, b), 8) AS rho FROM k")
def spearman_rho(spark, sf_dir):
    """Rank correlation of the same, ties sharing their mean rank."""
    v = _vectors(spark, sf_dir).withColumn("o", F.lit(0))
    return v.select(tests.average_rank("x", ["o"]).alias("a"), tests.average_rank("y", ["o"]).alias("b")).agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 8).alias("rho"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) AS c, CAST(o_orderdate AS DATE) AS d, CAST(NULL AS DATE) AS e FROM orders", on_sales=False)
def date_shapes(spark, sf_dir):
    """Order dates written in four shapes and read back; one string is no date."""
    d = F.col("o_orderdate").cast("date")
    texts = [F.date_format(d, f) for f in ("yyyy/MM/dd", "yyyy.MM.dd", "d-MMM-yyyy")] + [F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.date_format(d, "yyyy"), F.lit("-02-31"))]
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", *[parse_day(t).alias(n) for t, n in zip(texts, "abcde", strict=True)])


@query(f", e AS (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS period, event_type AS label, value FROM events) SELECT period, label, count(value) AS n, round(sum(value), 2) AS value FROM e GROUP BY 1, 2")
def events_by_day(spark, sf_dir):
    """Day cells of the events by type."""
    c = cube.build_cells(tables.events(spark, sf_dir), "day", ("event_type",), ["value"], grains=("day",))
    return c.where("dim_a IS NOT NULL").select("period", F.col("val_a").alias("label"), "n", F.round("sum", 2).alias("value"))
