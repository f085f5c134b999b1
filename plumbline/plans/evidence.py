"""Registered queries of profile, discovery, analyses, intents, notes, ledger and statistics, with SQL that states the same.

Student's t enters the SQL as the hypergeometric series of the incomplete beta function, apart from the continued
fraction of the library.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import hypotheses as tests
from plumbline.functions import special
from plumbline.functions.timeaxis import period_range
from plumbline.operators import cells as cube
from plumbline.operators import discover, forecast, lookup, profile
from plumbline.plans import analyses, brief, intent, ledger
from plumbline.plans.catalogue import BEFORE, KEY_SQL, MONTH, NATION_SQL, ORACLE_SQL, QUERIES, M, money, query, sales_cells
from plumbline.sources import tables
from plumbline.sources.delimited import read_delimited
from plumbline.sources.store import keep, release, remove, shared_dir


__all__ = ["ORACLE_SQL", "QUERIES"]


def text(value: str) -> str:
    """A SQL string."""
    return "'" + value.replace("'", "''") + "'"


def t_sql(t: str, df: str) -> str:
    """SQL of the two-sided p of Student's t; |t| above 25 at 30 degrees of freedom or more counts as p 0."""

    def series(x: str, rest: str, a: str, b: str) -> str:
        terms = f"list_sum(list_transform(range(600), lambda k: exp(lgamma({a} + {b} + k) - lgamma({a} + {b}) - lgamma({a} + 1.0 + k) + lgamma({a} + 1.0) + k * ln({x}))))"
        return f"exp({a} * ln({x}) + {b} * ln({rest}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})) * {terms}"

    y, x, a = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))", f"(({df}) / (({df}) + ({t}) * ({t})))", f"(({df}) / 2.0)"
    return f"CASE WHEN ({t}) IS NULL THEN NULL WHEN ({t}) = 0 THEN 1.0 WHEN abs({t}) > 25 AND ({df}) >= 30 THEN 0.0 WHEN {y} > 0.9 THEN {series(x, y, a, '0.5')} ELSE 1.0 - {series(y, x, '0.5', a)} END"


# ---------------------------------------------------------------- statistics


_WELCH_SQL = f""", g AS (SELECT {M} AS period, r_name, l_returnflag, count(*) AS n, sum(quantity) AS s, sum(quantity * quantity) AS q FROM sales GROUP BY 1, 2, 3), u AS (SELECT *, sum(n) OVER w - n AS n2, sum(s) OVER w - s AS s2, sum(q) OVER w - q AS q2 FROM g WINDOW w AS (PARTITION BY period)),
e AS (SELECT *, (q - s * s / n) / (n - 1) / n AS e1, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS e2 FROM u WHERE n >= 10 AND n2 >= 10), x AS (SELECT period, r_name, l_returnflag, (s / n - s2 / n2) / sqrt(e1 + e2) AS t, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n - 1) + e2 * e2 / (n2 - 1)) AS df FROM e WHERE e1 + e2 > 0)"""


def _welch(spark, sf_dir):
    """t and df of each region and return flag against the rest, every month."""
    pairs = sales_cells(spark, sf_dir, ("r_name", "l_returnflag"), ("quantity",), [("r_name", "l_returnflag")]).where("dim_b IS NOT NULL")
    own = discover.against_rest(pairs).where("n >= 10 AND whole_n - n >= 10 AND t.t IS NOT NULL")
    return own.select("period", F.col("val_b").alias("r_name"), F.col("val_a").alias("l_returnflag"), F.col("t.t").alias("t"), F.col("t.df").alias("df"))


@query(_WELCH_SQL + f" SELECT period, r_name, l_returnflag, round({t_sql('t', 'df')}, 7) AS p, round(CASE WHEN t > 0 THEN 1 - ({t_sql('t', 'df')}) / 2 ELSE ({t_sql('t', 'df')}) / 2 END, 7) AS cdf FROM x")
def t_distribution(spark, sf_dir):
    """p and distribution of Student's t at the Welch statistic of every pair and month."""
    return _welch(spark, sf_dir).select("period", "r_name", "l_returnflag", F.round(special.t_two_sided(F.col("t"), F.col("df")), 7).alias("p"), F.round(special.t_cdf(F.col("t"), F.col("df")), 7).alias("cdf"))


@query(_WELCH_SQL + f" SELECT period, r_name, l_returnflag, round(t, 4) AS t FROM x WHERE ({t_sql('t', 'df')}) > 1e-6")
def t_quantiles(spark, sf_dir):
    """The quantile at the distribution of t is t again."""
    own = _welch(spark, sf_dir).where(special.t_two_sided(F.col("t"), F.col("df")) > 1e-6)
    return own.select("period", "r_name", "l_returnflag", F.round(special.t_quantile(special.t_cdf(F.col("t"), F.col("df")), F.col("df")), 4).alias("t"))


@query(f""", n AS (SELECT r_name, n_name, CAST(sum(quantity) AS DOUBLE) AS v FROM sales WHERE {M} = '{MONTH}' GROUP BY 1, 2), g AS (SELECT r_name AS label, count(*) AS n, avg(v) AS m, stddev_samp(v) AS s FROM n GROUP BY 1)
SELECT label, n, round(m, 4) AS mean, round(m - t * s / sqrt(n), 4) AS low, round(m + t * s / sqrt(n), 4) AS high FROM g, (SELECT 2 * sqrt(cos(acos(sqrt(0.0975)) / 3) / sqrt(0.0975) - 1) AS t) WHERE n = 5""")
def mean_intervals(spark, sf_dir):
    """95 % interval of the mean nation of each region of five nations."""
    own = lookup.find_pair(tables.sales_cells(spark, sf_dir), "n_name", "r_name").where(f"grain = 'month' AND measure = 'quantity' AND period = '{MONTH}'")
    g = own.groupBy(F.col("val_b").alias("label")).agg(F.count("*").alias("n"), F.avg("sum").alias("m"), F.stddev_samp("sum").alias("s")).where("n = 5")
    return g.withColumn("i", tests.mean_interval(F.col("n"), F.col("m"), F.col("s"))).select("label", "n", *[F.round(f"i.{c}", 4).alias(c) for c in ("mean", "low", "high")])


@query(f""", v AS (SELECT n_name, {M} AS period, CAST(sum(quantity) AS DOUBLE) AS v FROM sales GROUP BY 1, 2), m AS (SELECT *, median(v) OVER (PARTITION BY period) AS med FROM v), d AS (SELECT *, 1.4826 * median(abs(v - med)) OVER (PARTITION BY period) AS mad FROM m), z AS (SELECT n_name, period, (v - med) / mad AS z FROM d WHERE mad > 0),
c AS (SELECT *, 0.5 + z / 6000.0 * list_sum(list_transform(range(2001), lambda k: CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (z * k / 2000.0) ** 2) / sqrt(2 * pi()))) AS c FROM z WHERE abs(z) < 6) SELECT n_name, period, round(c, 2) AS cdf, round(2 * least(c, 1 - c), 2) AS p FROM c""")
def normal_distribution(spark, sf_dir):
    """Distribution and two-sided p of the normal at the robust z of every nation and month, against Simpson's rule; to two
    digits, as the library's error function is exact to seven and no rounding of many values may hang on that."""
    own = sales_cells(spark, sf_dir, ("n_name",), ("quantity",)).where("dim_a = 'n_name'").select(F.col("val_a").alias("n_name"), "period", F.col("sum").alias("v"))
    z = tests.robust_z(own, "v", ["period"]).where("basis = 'mad' AND abs(robust_z) < 6")
    return z.select("n_name", "period", F.round(special.normal_cdf(F.col("robust_z")), 2).alias("cdf"), F.round(special.normal_two_sided(F.col("robust_z")), 2).alias("p"))


# ---------------------------------------------------------------- profile and sources


def _statistics_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{t}' AS tab, '{c}' AS name, count(*) AS n_rows, count(v) AS n, count(DISTINCT v) AS u, avg(length(v)) AS len, count(x) AS numbers, count(d) AS dates, coalesce(stddev_samp(x), 0) AS sd, min(x) AS low, max(x) AS high, bool_and(x = floor(x)) AS whole FROM (SELECT nullif(CAST({c} AS VARCHAR), '') AS v, try_cast(CASE WHEN typeof({c}) NOT LIKE 'TIMESTAMP%' THEN {c} END AS DOUBLE) AS x, CASE WHEN typeof({c}) LIKE 'TIMESTAMP%' THEN {c} END AS d FROM {t})"
    return " UNION ALL ".join(one.format(t=table, c=c) for c in columns)


_PROFILED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}
_AGG_SQL = r"""CASE WHEN regexp_matches(lower(name), '(^|[_\s])(pct|percent|rate|ratio|margin|rating|score|avg|average|mean|index|nps|csat|share)([_\s]|$)|%') AND ((low >= -1.0001 AND high <= 1.0001) OR (low >= -100.01 AND high <= 100.01) OR NOT whole) THEN 'avg'
 WHEN regexp_matches(lower(name), '(^|[_\s])(duration|latency|elapsed|lead_?time|cycle_?time|days|hours|minutes|seconds)([_\s]|$)') THEN 'avg' WHEN regexp_matches(lower(name), '(^|[_\s])(count|qty|quantity|units|orders|sessions|clicks|visits|items|n)([_\s]|$)') THEN 'sum'
 WHEN low >= -1.0001 AND high <= 1.0001 AND NOT whole THEN 'avg' ELSE 'sum' END"""


@query(f"""WITH s AS ({" UNION ALL ".join(_statistics_sql(t, c) for t, c in _PROFILED.items())}),
r AS (SELECT *, len(list_filter(regexp_split_to_array(lower(name), '[_\\s-]+'), lambda w: list_contains(['id', 'uuid', 'guid', 'key', 'code', 'ref', 'sku', 'hash'], w))) > 0 AS id_name FROM s),
k AS (SELECT *, CASE WHEN dates >= 0.8 * n THEN 'time' WHEN id_name AND (u > 50 OR u >= 0.85 * n_rows) THEN 'identifier' WHEN numbers > 0.95 * n AND u <= 12 THEN 'dimension' WHEN numbers > 0.95 * n AND sd > 0 THEN 'measure' WHEN numbers > 0.95 * n THEN 'identifier'
 WHEN u = 2 THEN 'dimension' WHEN len > 60 THEN 'text' WHEN u > 50 AND u >= 0.85 * n_rows THEN 'identifier' WHEN u <= 50 THEN 'dimension' ELSE 'excluded' END AS role FROM r)
SELECT tab, name, role, CASE WHEN role IN ('dimension', 'excluded') THEN u END AS members, CASE WHEN role = 'measure' THEN {_AGG_SQL} END AS agg FROM k""", on_sales=False)
def column_roles(spark, sf_dir):
    """Roles of the columns of three tables, with members of dimensions and aggregation of measures."""
    rows = []
    for name, columns in _PROFILED.items():
        p = profile.profile(tables.read(spark, sf_dir, name).select(*columns))
        single = [m for m in p.measures if not m.dual_role]
        rows += [(name, p.time, "time", None, None)] if p.time else []
        rows += [(name, d, "dimension", k, None) for d, k in p.dims] + [(name, d, "excluded", k, None) for d, k in p.excluded_dims]
        rows += [(name, m.name, "measure", None, m.agg) for m in single] + [(name, c, "identifier", None, None) for c, _ in p.ids] + [(name, c, "text", None, None) for c in p.texts]
    return spark.createDataFrame(rows, "tab string, name string, role string, members long, agg string")


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95 FROM {t}" for t, m, c in (("lineitem", "price", "l_extendedprice"), ("lineitem", "quantity", "l_quantity"), ("orders", "total", "o_totalprice"))), on_sales=False)
def profile_percentiles(spark, sf_dir):
    """Exact percentiles of measures, as a profile holds them once they are asked for."""
    lines = tables.read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("day"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    totals = tables.read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("total"))
    measures = [m for df in (lines, totals) for m in profile.with_exact_percentiles(profile.profile(df, {c: "measure" for c in df.columns[1:]}), df).measures]
    return spark.createDataFrame([(m.name, *(round(x, 6) for x in (m.p05, m.p50, m.p95))) for m in measures], "measure string, p05 double, p50 double, p95 double")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, round(count({c}) / CAST(count(*) AS DOUBLE) * 1000 + least(count(DISTINCT year({c}) * 12 + month({c})), 60) + least(date_diff('day', CAST(min({c}) AS DATE), CAST(max({c}) AS DATE)) / 365.0, 10), 6) AS score FROM {t}" for t, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))), on_sales=False)
def time_scores(spark, sf_dir):
    """How well three columns serve as time axis: coverage, months, span."""
    found = [(t, round(profile.time_score(profile.column_statistics(tables.read(spark, sf_dir, t).select(c))[0]), 6)) for t, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))]
    return spark.createDataFrame(found, "tab string, score double")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(source, '') AS source, nullif(replace(text, chr(13), ''), '') AS text, 'a; \"b\"' || chr(10) || lang AS lang FROM documents", on_sales=False)
def delimited_text(spark, sf_dir):
    """Documents written as text with semicolons, quotes and line breaks, and read back by the delimiter that is found."""
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "source", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), F.concat(F.lit('a; "b"\n'), "lang").alias("lang"))
    path = f"{shared_dir(spark)}/plumbline-documents-{uuid.uuid4().hex}"
    d.write.options(header=True, sep=";", quote='"', escape='"').csv(path)
    found = keep(read_delimited(spark, path))
    remove(spark, path)
    return found


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS \"rows\", true AS same_elsewhere, true AS differs_by_a_cell FROM {t}" for t in ("customer", "orders", "events")), on_sales=False)
def fingerprints(spark, sf_dir):
    """The hash of a table's content is the same wherever its rows lie, and another if one cell is."""
    found = []
    for name, key, cell in (("customer", "c_custkey", "c_acctbal"), ("orders", "o_orderkey", "o_totalprice"), ("events", "event_id", "value")):
        t = tables.read(spark, sf_dir, name)
        first = t.agg(F.min(key)).first()[0]
        other = t.withColumn(cell, F.when(F.col(key) == first, F.coalesce(F.col(cell), F.lit(0)) + 1).otherwise(F.col(cell)))
        a, b, c = (ledger.fingerprint(x, profile.Profile(0, None)) for x in (t, t.repartition(7, cell), other))
        found.append((name, a["rows"], a == b, a["content"] != c["content"]))
    return spark.createDataFrame(found, "tab string, rows long, same_elsewhere boolean, differs_by_a_cell boolean")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_totalprice FROM orders) SELECT count(*) AS "rows", count(*) FILTER (WHERE o_orderkey % 7 = 0) AS no_date, count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0) AS no_measure FROM d""", on_sales=False)
def dropped_rows(spark, sf_dir):
    """Rows left out for a date that does not parse, or for want of a number."""
    o = tables.read(spark, sf_dir, "orders")
    given = o.select(F.when(F.col("o_orderkey") % 7 == 0, F.lit("31/31/2020")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return cube.dropped_rows(given, "day", ["price"])


@query(f""", u AS (SELECT {", ".join(f"count(DISTINCT {d}) AS {d}" for d in tables.SALES_DIMS)} FROM sales), p AS ({" UNION ALL ".join(f"SELECT '{a}' AS dim_a, '{b}' AS dim_b, {a} * {b} AS cells FROM u" for i, a in enumerate(sorted(tables.SALES_DIMS)) for b in sorted(tables.SALES_DIMS)[i + 1 :])}),
c AS (SELECT *, sum(cells * 36) OVER (ORDER BY cells, dim_a, dim_b) AS spent FROM p WHERE cells <= 60) SELECT dim_a, dim_b, cells FROM c WHERE spent <= 5000""")
def pair_budget(spark, sf_dir):
    """Pairs of dimensions within 60 cells a pair and 5,000 cells over 36 periods."""
    members = {r["dim_a"]: r["k"] for r in sales_cells(spark, sf_dir, tables.SALES_DIMS).where("dim_a IS NOT NULL").groupBy("dim_a").agg(F.count_distinct("val_a").alias("k")).collect()}
    return spark.createDataFrame([(a, b, members[a] * members[b]) for a, b in cube.select_pairs(members, 60, 5000)], "dim_a string, dim_b string, cells long")


_RANGES_SQL = " UNION ALL ".join(f"SELECT '{g}' AS grain, {KEY_SQL[g]} AS period, min(CAST(date_trunc('{g}', day) AS DATE)) AS first, min(CAST(date_trunc('{g}', day) + INTERVAL {i} AS DATE)) - 1 AS last FROM sales GROUP BY 2" for g, i in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("quarter", "3 MONTH"), ("year", "1 YEAR")))


@query(f", r AS ({_RANGES_SQL}) SELECT grain, period, first, CAST(last AS DATE) AS last FROM r")
def period_ranges(spark, sf_dir):
    """First and last day of every period that occurs."""
    keys = tables.sales_cells(spark, sf_dir).where("dim_a IS NULL").select("grain", "period").distinct().collect()  # a few thousand keys
    return spark.createDataFrame([(r["grain"], r["period"], *period_range(r["period"], r["grain"])) for r in keys], "grain string, period string, first date, last date")


# ---------------------------------------------------------------- discovery

_SETTINGS = discover.Settings()
_DISCOVERY_SQL = f""", long AS (SELECT {M} AS period, unnest([{", ".join(f"{{'dim': '{d}', 'value': {d}}}" for d in tables.SALES_DIMS)}]) AS d, price, quantity, discount FROM sales),
one AS (SELECT period, d.dim AS dim, d.value AS value, count(*) AS n, unnest([{{'measure': 'price', 'val': sum(price)}}, {{'measure': 'quantity', 'val': sum(quantity)}}, {{'measure': 'discount', 'val': avg(discount)}}]) AS m FROM long GROUP BY 1, 2, 3),
own AS (SELECT m.measure AS measure, dim, value, period, n, m.val AS val, abs(m.val) / sum(abs(m.val)) OVER (PARTITION BY m.measure, dim, period) AS share FROM one),
sup AS (SELECT *, n >= {_SETTINGS.min_rows} AND share >= {_SETTINGS.min_share} AS ok FROM own),
here AS (SELECT *, count(*) OVER w AS shown, count(*) FILTER (WHERE ok) OVER w AS held FROM sup WHERE period = '{MONTH}' WINDOW w AS (PARTITION BY measure, dim)),
kept AS (SELECT *, count(*) OVER w AS m, sum(val) OVER w AS s, sum(val * val) OVER w AS q, avg(val) OVER w AS mean, stddev_samp(val) OVER w AS sd FROM here WHERE ok AND shown >= 2 WINDOW w AS (PARTITION BY measure, dim)),
far AS (SELECT *, m >= {_SETTINGS.min_members} AND coalesce(sd > 0, false) AS fit, abs(val - mean) / nullif(sd, 0) AS g, (m - 1) * (m - 1) / CAST(m AS DOUBLE) AS most FROM kept QUALIFY row_number() OVER (PARTITION BY measure, dim ORDER BY abs(val - mean) DESC, val DESC, value) = 1),
sib AS (SELECT 'sibling' AS kind, measure, dim, CASE WHEN fit THEN value END AS value, CAST(NULL AS VARCHAR) AS dim_b, CAST(NULL AS VARCHAR) AS value_b, CASE WHEN fit THEN n END AS n, CASE WHEN fit THEN share END AS share, CASE WHEN fit THEN g END AS statistic,
 CASE WHEN fit AND most - g * g > 1e-12 * most THEN sqrt(g * g * (m - 2) / (most - g * g)) END AS t, CAST(m - 2 AS DOUBLE) AS df, m AS times, CASE WHEN fit AND most - g * g <= 1e-12 * most THEN 1e-6 END AS known,
 CASE WHEN fit THEN (val - (s - val) / (m - 1)) / nullif(sqrt(greatest((q - val * val - (s - val) * (s - val) / (m - 1)) / (m - 2), 0)), 0) END AS effect, CAST(NULL AS DOUBLE) AS pct, '' AS extreme, false AS weak FROM far
 UNION ALL SELECT DISTINCT 'sibling', measure, dim, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', false FROM here WHERE shown >= 2 AND held = 0),
places AS (SELECT period, row_number() OVER (ORDER BY period DESC) AS back FROM (SELECT DISTINCT period FROM sup WHERE period <= '{MONTH}')),
hist AS (SELECT measure, dim, value, count(*) AS hn, avg(val) AS hm, stddev_samp(val) AS hs, max_by(val, period) AS prev FROM sup JOIN places USING (period) WHERE back BETWEEN 2 AND {_SETTINGS.history} GROUP BY 1, 2, 3),
tem AS (SELECT 'temporal' AS kind, measure, dim, value, NULL AS dim_b, NULL AS value_b, n, share, (val - hm) / (hs * sqrt(1 + 1 / CAST(hn AS DOUBLE))) AS statistic, (val - hm) / (hs * sqrt(1 + 1 / CAST(hn AS DOUBLE))) AS t, CAST(hn - 1 AS DOUBLE) AS df, 1 AS times, NULL AS known, NULL AS effect, (val - prev) / nullif(prev, 0) AS pct, '' AS extreme, false AS weak
 FROM sup JOIN hist USING (measure, dim, value) WHERE period = '{MONTH}' AND ok AND hn >= {_SETTINGS.min_history} AND hs > 0),
rk AS (SELECT s.*, count(*) OVER (PARTITION BY measure, dim, period) AS k, row_number() OVER (PARTITION BY measure, dim, period ORDER BY val DESC, value) AS top FROM sup s JOIN places USING (period) WHERE ok AND back <= {_SETTINGS.lookback}),
obs AS (SELECT measure, dim, count(DISTINCT period) AS observed, max(k) AS members FROM rk WHERE k >= 2 GROUP BY 1, 2),
hit AS (SELECT measure, dim, value, arg_max(n, period) AS n, arg_max(share, period) AS share, unnest([{{'x': 'top', 'h': count(*) FILTER (WHERE top = 1)}}, {{'x': 'bottom', 'h': count(*) FILTER (WHERE top = k)}}]) AS e FROM rk WHERE k >= 2 GROUP BY 1, 2, 3),
per AS (SELECT 'persistence' AS kind, measure, dim, value, NULL AS dim_b, NULL AS value_b, n, share, e.h / CAST(observed AS DOUBLE) AS statistic, NULL AS t, NULL AS df, 1 AS times,
 CASE WHEN e.h <= observed / CAST(members AS DOUBLE) THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(e.h, observed + 1), lambda i: exp(lgamma(observed + 1) - lgamma(i + 1) - lgamma(observed - i + 1) - i * ln(members) + (observed - i) * ln(1 - 1 / CAST(members AS DOUBLE)))))) END AS known,
 NULL AS effect, NULL AS pct, e.x AS extreme, false AS weak FROM hit JOIN obs USING (measure, dim) WHERE e.h > 0 AND observed >= {_SETTINGS.min_persist_periods} AND (e.x = 'top' OR members > 2)),
two AS (SELECT unnest([{", ".join(f"{{'a': '{a}', 'b': '{b}', 'va': {a}, 'vb': {b}}}" for i, a in enumerate(sorted(tables.SALES_DIMS)) for b in sorted(tables.SALES_DIMS)[i + 1 :])}]) AS d, price, quantity, discount FROM sales WHERE {M} = '{MONTH}'),
cell AS (SELECT d.a AS dim, d.b AS dim_b, d.va AS value, d.vb AS value_b, count(*) AS n, unnest([{", ".join(f"{{'measure': '{m}', 's': sum({m}), 'q': sum({m} * {m})}}" for m in tables.SALES_MEASURES)}]) AS m FROM two GROUP BY 1, 2, 3, 4),
whole AS (SELECT *, m.measure AS measure, m.s AS s1, m.q AS q1, count(*) OVER w AS k, sum(n) OVER w - n AS n2, sum(m.s) OVER w - m.s AS s2, sum(m.q) OVER w - m.q AS q2, sum(m.s) OVER w AS s_all FROM cell WINDOW w AS (PARTITION BY m.measure, dim, dim_b)),
var AS (SELECT *, greatest((q1 - s1 * s1 / n) / (n - 1), 0) AS v1, greatest((q2 - s2 * s2 / n2) / (n2 - 1), 0) AS v2 FROM whole WHERE k >= 4 AND n >= {_SETTINGS.min_rows} AND n2 > 1),
cro AS (SELECT 'cross' AS kind, measure, dim, value, dim_b, value_b, n, s1 / s_all AS share, (s1 / n - s2 / n2) / sqrt(v1 / n + v2 / n2) AS statistic, (s1 / n - s2 / n2) / sqrt(v1 / n + v2 / n2) AS t,
 (v1 / n + v2 / n2) * (v1 / n + v2 / n2) / ((v1 / n) * (v1 / n) / (n - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)) AS df, 1 AS times, NULL AS known, (s1 / n - s2 / n2) / nullif(sqrt(((n - 1) * v1 + (n2 - 1) * v2) / (n + n2 - 2)), 0) AS effect, NULL AS pct, '' AS extreme, false AS weak FROM var WHERE v1 / n + v2 / n2 > 0),
found AS (SELECT * FROM sib UNION ALL SELECT * FROM tem UNION ALL SELECT * FROM per WHERE known < 0.5 UNION ALL SELECT * FROM cro),
pv AS (SELECT *, CASE WHEN known IS NOT NULL OR t IS NULL THEN known ELSE least(1.0, times * ({t_sql("t", "df")})) END AS p FROM found),
bh AS (SELECT *, p * count(p) OVER () / row_number() OVER (ORDER BY p NULLS LAST, kind, measure, dim, value, dim_b, value_b, extreme) AS raw, row_number() OVER (ORDER BY p NULLS LAST, kind, measure, dim, value, dim_b, value_b, extreme) AS place FROM pv),
qv AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM bh),
tier AS (SELECT *, CASE WHEN p IS NULL THEN 'low' WHEN q <= 0.001 AND abs(coalesce(effect, 0)) >= 1 THEN 'high' WHEN q <= 0.1 THEN 'medium' ELSE 'low' END AS tier FROM qv)"""


def _found(spark, sf_dir):
    return discover.candidates(tables.sales_cells(spark, sf_dir), tables.SALES_MEASURES, "month", MONTH)


@query(_DISCOVERY_SQL + " SELECT kind, measure, dim, value, dim_b, value_b, n, round(statistic, 6) AS statistic, round(p, 6) AS p, round(q, 6) AS q, q <= 0.1 AS significant, tier FROM tier")
def discover_candidates(spark, sf_dir):
    """Every candidate of a month over all dimensions, measures and pairs, with p, q and tier."""
    found = discover.with_tier(_found(spark, sf_dir), _SETTINGS)
    return found.select("kind", "measure", "dim", "value", "dim_b", "value_b", "n", F.round("statistic", 6).alias("statistic"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "significant", "tier")


@query(_DISCOVERY_SQL + """, sub AS (SELECT *, row_number() OVER (PARTITION BY measure, dim, value, dim_b, value_b ORDER BY q, CASE kind WHEN 'sibling' THEN 0 WHEN 'temporal' THEN 1 WHEN 'persistence' THEN 2 ELSE 3 END, extreme) AS k, count(*) OVER (PARTITION BY measure, dim, value, dim_b, value_b) - 1 AS others FROM tier WHERE q <= 0.35)
SELECT kind, measure, dim, value, dim_b, value_b, tier, round(q, 6) AS q, others AS corroborated, round(abs(coalesce(effect, 0)) * 2 + abs(share) + abs(statistic) * 0.05, 5) AS strength FROM sub WHERE k = 1""")
def discovery_subjects(spark, sf_dir):
    """One finding a subject, with tier, strength and how many other tests agree."""
    fed = discover.ranked_feed(_found(spark, sf_dir), _SETTINGS)
    return fed.select("kind", "measure", "dim", "value", "dim_b", "value_b", "tier", F.round("q", 6).alias("q"), F.size("corroboration").cast("long").alias("corroborated"), F.round("strength", 5).alias("strength"))


@query(_DISCOVERY_SQL + """ SELECT kind, measure, dim, value, dim_b, value_b, tier, round(q, 6) AS q, round(abs(coalesce(effect, 0)) * 2 + abs(share) + abs(statistic) * 0.05, 5) AS strength FROM tier WHERE q <= 0.1""")
def scan_findings(spark, sf_dir):
    """Scan: all that passes correction, with tier and strength."""
    return discover.survivors(_found(spark, sf_dir), _SETTINGS).select("kind", "measure", "dim", "value", "dim_b", "value_b", "tier", F.round("q", 6).alias("q"), F.round("strength", 5).alias("strength"))


_FEED_SQL = _DISCOVERY_SQL + f""", sub AS (SELECT *, row_number() OVER (PARTITION BY measure, dim, value, dim_b, value_b ORDER BY q, CASE kind WHEN 'sibling' THEN 0 WHEN 'temporal' THEN 1 WHEN 'persistence' THEN 2 ELSE 3 END, extreme) AS k, count(*) OVER (PARTITION BY measure, dim, value, dim_b, value_b) - 1 AS others FROM tier WHERE q <= {_SETTINGS.low_ceiling}),
fed AS (SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, abs(coalesce(effect, 0)) * 2 + abs(share) + abs(statistic) * 0.05 DESC, q, value, measure, dim, dim_b, value_b) AS place FROM sub WHERE k = 1),
queue AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY place) AS i, min(place) OVER (PARTITION BY measure) AS lead, concat_ws('|', dim, dim_b) AS pair, CASE WHEN kind = 'cross' THEN [dim || '|' || value, dim_b || '|' || value_b] ELSE [dim || '|' || value] END AS own FROM fed),
pick AS (WITH RECURSIVE g AS (SELECT DISTINCT measure, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS pairs, CAST([] AS VARCHAR[]) AS members, CAST(0 AS BIGINT) AS kept, false AS took, CAST(0 AS BIGINT) AS place FROM queue
 UNION ALL SELECT measure, i, CASE WHEN ok THEN list_append(pairs, pair) ELSE pairs END, CASE WHEN ok THEN list_concat(members, own) ELSE members END, kept + CAST(ok AS BIGINT), ok, place FROM (SELECT g.measure, q.i, g.pairs, g.members, g.kept, q.pair, q.own, q.place, g.kept < {_SETTINGS.max_feed} AND len(list_filter(g.pairs, lambda x: x = q.pair)) < {_SETTINGS.max_per_pair} AND list_bool_and(list_transform(q.own, lambda o: len(list_filter(g.members, lambda x: x = o)) < {_SETTINGS.max_per_value})) AS ok FROM g JOIN queue q ON q.measure = g.measure AND q.i = g.i + 1)) SELECT place, kept FROM g WHERE took),
turns AS (SELECT queue.*, row_number() OVER (ORDER BY kept, lead) AS turn FROM queue JOIN pick USING (place))"""


@query(_FEED_SQL + f""" SELECT kind, measure, dim, value, dim_b, value_b, tier, round(q, 6) AS q, others AS corroborated FROM turns WHERE turn <= {_SETTINGS.max_feed}""")
def discovery_feed(spark, sf_dir):
    """The feed of a month: deduplicated, tiered, spread over measures within caps."""
    fed = discover.select_diverse(discover.ranked_feed(_found(spark, sf_dir), _SETTINGS), _SETTINGS)
    return fed.select("kind", "measure", "dim", "value", "dim_b", "value_b", "tier", F.round("q", 6).alias("q"), F.size("corroboration").cast("long").alias("corroborated"))


_CHART_SQL = f"""bars AS (SELECT m.measure AS measure, d.dim AS dim, count(*) AS bars, max_by(d.value, m.val) AS first_bar, round(max(m.val), 2) AS first_value FROM (SELECT d, unnest([{{'measure': 'price', 'val': sum(price)}}, {{'measure': 'quantity', 'val': sum(quantity)}}, {{'measure': 'discount', 'val': avg(discount)}}]) AS m FROM long WHERE period = '{MONTH}' GROUP BY d) GROUP BY 1, 2)"""


@query(_FEED_SQL + f""", {_CHART_SQL},
say AS (SELECT *, CASE WHEN coalesce(CASE WHEN kind = 'cross' THEN statistic ELSE effect END, 1) > 0 THEN 'above' ELSE 'below' END AS side FROM turns LEFT JOIN bars USING (measure, dim) WHERE turn <= {_SETTINGS.max_feed})
SELECT dim || ' = ' || value || CASE WHEN kind = 'cross' THEN ' and ' || dim_b || ' = ' || value_b ELSE '' END || ' ' || CASE kind WHEN 'sibling' THEN 'lies ' || side || ' its peers on' WHEN 'temporal' THEN 'left its own history on' WHEN 'persistence' THEN 'is steadily the ' || CASE extreme WHEN 'bottom' THEN 'lowest' ELSE 'highest' END || ' on' ELSE 'averages ' || side || ' the rest on' END || ' ' || measure AS title,
CASE WHEN kind = 'temporal' THEN 'temporal' WHEN kind = 'cross' THEN 'interaction' WHEN regexp_matches(dim, {text(discover.PLACES)}, 'i') THEN 'spatial' ELSE 'behavioral' END AS class, tier, CASE WHEN kind = 'cross' OR bars > 5 THEN 'bar' ELSE 'pie' END AS chart, bars, first_bar, first_value FROM say""")
def feed_cards(spark, sf_dir):
    """The feed of a month as cards: title, class, tier, and the chart with its first bar."""
    fed = discover.select_diverse(discover.ranked_feed(_found(spark, sf_dir), _SETTINGS), _SETTINGS)
    cards = analyses.card_rows(fed, tables.sales_cells(spark, sf_dir), tables.SALES_MEASURES, "month", MONTH)
    return cards.select("title", "class", "tier", "chart", F.size("bars").cast("long").alias("bars"), F.col("bars")[0]["label"].alias("first_bar"), F.round(F.col("bars")[0]["value"], 2).alias("first_value"))


@query(_DISCOVERY_SQL + " SELECT count(p) AS tests, count(*) FILTER (WHERE q <= 0.1) AS survived, count(*) FILTER (WHERE p IS NULL) AS untestable FROM tier")
def discovery_audit(spark, sf_dir):
    """How many tests a search runs, how many pass, and how many cannot be tested."""
    return discover.audit(_found(spark, sf_dir))


_CONDITION_DIMS = sorted([*tables.SALES_DIMS, "discount"])
_CONDITION_SQL = f"""f AS (SELECT s.*, o_orderdate AS order_day, c_name AS customer FROM (SELECT *, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount FROM lineitem) s JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
k AS (SELECT {", ".join(f"count(DISTINCT {d}) AS {d}" for d in _CONDITION_DIMS)} FROM sales), kd AS (UNPIVOT k ON COLUMNS(*) INTO NAME dim VALUE members),
one AS (SELECT d.dim AS dim, d.value AS value, count(*) AS n FROM (SELECT unnest([{", ".join(f"{{'dim': '{d}', 'value': {d}}}" for d in tables.SALES_DIMS)}]) AS d FROM sales WHERE {M} = '{MONTH}') GROUP BY 1, 2)"""


@query(f""", {_CONDITION_SQL} SELECT 'high' AS severity, 'rejected-time-axis' AS id, 'order_day' AS subject, CAST(NULL AS BIGINT) AS n FROM f HAVING count(order_day) >= 0.8 * count(*)
UNION ALL SELECT 'high', 'no-sum', 'discount', NULL FROM sales HAVING min(discount) >= -1 AND max(discount) <= 1 AND bool_or(discount <> floor(discount))
UNION ALL SELECT 'medium', 'dual-role', 'discount', NULL FROM k WHERE discount BETWEEN 3 AND 12
UNION ALL SELECT 'medium', 'small-dimension', dim, members FROM kd WHERE members < {_SETTINGS.min_members} UNION ALL SELECT 'medium', 'excluded-dimension', 'customer', NULL FROM f HAVING count(DISTINCT customer) > 50
UNION ALL SELECT 'medium', 'skipped-pairs', NULL, count(*) FROM kd a JOIN kd b ON a.dim < b.dim WHERE a.members * b.members > 60 HAVING count(*) > 0
UNION ALL SELECT 'medium', 'short-history', 'month', count(DISTINCT {M}) FROM sales HAVING count(DISTINCT {M}) < 12
{" ".join(f"UNION ALL SELECT 'low', 'spread', '{m}', NULL FROM sales HAVING min({m}) >= 0 AND var_samp({m}) + avg({m}) * avg({m}) > 3 * avg({m}) * avg({m})" for m in tables.SALES_MEASURES)}
UNION ALL SELECT 'low', 'thin', dim, count(*) FILTER (WHERE n < {_SETTINGS.min_rows}) AS t FROM one GROUP BY dim HAVING t > 0 AND t < count(*)""")
def data_conditions(spark, sf_dir):
    """What misleads in order lines with the order's date and the customer's name beside the dimensions of sales."""
    orders = tables.read(spark, sf_dir, "orders").join(tables.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nation = tables.read(spark, sf_dir, "nation").join(tables.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = tables.read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # joined once: the statistics are several passes
    rows = keep(lines.select(F.col("l_shipdate").cast("date").alias("day"), F.col("o_orderdate").alias("order_day"), F.col("c_name").alias("customer"), *tables.SALES_DIMS, F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")))
    p = profile.profile(rows, {"day": "time", "price": "measure", "quantity": "measure"})
    release(rows)
    pairs = len(p.dims) * (len(p.dims) - 1) // 2 - len(cube.select_pairs(dict(p.dims), pair_cells=60))
    found = brief.conditions(p, tables.sales_cells(spark, sf_dir), period=MONTH, pairs_skipped=pairs)
    # the number of members of a dimension far above the cutoff is approximate
    return found.withColumn("n", F.when(F.col("id") != "excluded-dimension", F.col("n")))


# ---------------------------------------------------------------- the six analyses


@query(f""", {NATION_SQL}, b30 AS (SELECT * FROM b WHERE n >= 30), c AS (SELECT median(v) AS med, count(*) AS k, sum(v) AS s, sum(v * v) AS q FROM b30), d AS (SELECT 1.4826 * median(abs(v - med)) AS mad FROM b30, c)
SELECT label, n, round(v / s, 6) AS share, round((v - med) / mad, 5) AS robust_z, 'mad' AS basis, round((v - (s - v) / (k - 1)) / sqrt((q - v * v - (s - v) * (s - v) / (k - 1)) / (k - 2)), 5) AS effect FROM b30, c, d""")
def deepdive_members(spark, sf_dir):
    """Deep dive: every nation with enough rows, its robust deviation and effect."""
    d = analyses.deepdive_members(tables.sales_cells(spark, sf_dir), "n_name", "quantity", "month", MONTH)
    return d.select("label", "n", F.round("share", 6).alias("share"), F.round("robust_z", 5).alias("robust_z"), "basis", F.round("effect", 5).alias("effect"))


@query(f""", {NATION_SQL}, k AS (SELECT count(*) AS m, avg(v) AS mean, stddev_samp(v) AS sd FROM b WHERE n >= 5), g AS (SELECT label, m, abs(v - mean) / sd AS g, (m - 1) * (m - 1) / CAST(m AS DOUBLE) AS most FROM b, k WHERE n >= 5 ORDER BY abs(v - mean) DESC, v DESC, label LIMIT 1),
t AS (SELECT *, sqrt(g * g * (m - 2) / (most - g * g)) AS t, CAST(m - 2 AS DOUBLE) AS df FROM g) SELECT label, m AS members, round(g, 6) AS g, round(least(1.0, m * ({t_sql("t", "df")})), 6) AS p, round((m - 1) / sqrt(m), 6) AS ceiling, m < 6 AS low_power FROM t""")
def deepdive_extreme(spark, sf_dir):
    """Grubbs test of the extreme nation, of those with five rows or more."""
    own = lookup.breakdown(tables.sales_cells(spark, sf_dir), "n_name", "quantity", "month", MONTH).where("n >= 5")
    return analyses.deepdive_extreme(own).select("label", "members", *[F.round(c, 6).alias(c) for c in ("g", "p", "ceiling")], "low_power")


_MOVES_SQL = f", mt AS (SELECT {M} AS period, sum(price) AS v FROM sales GROUP BY 1), mv AS (SELECT period, lag(period) OVER (ORDER BY period) AS before, v, lag(v) OVER (ORDER BY period) AS w FROM mt)"


@query(_MOVES_SQL + " SELECT period, before, round(v, 2) AS value, round(w, 2) AS previous, round((v - w) / abs(w), 6) AS move FROM mv WHERE w <> 0")
def drill_moves(spark, sf_dir):
    """Drill: how the total moves from month to month."""
    return analyses.drill_moves(tables.sales_cells(spark, sf_dir), "price", "month").select("period", "before", *money("value", "previous"), F.round("move", 6).alias("move"))


@query(f""", long AS (SELECT {M} AS period, unnest([{", ".join(f"{{'dim': '{d}', 'value': {d}}}" for d in tables.SALES_DIMS)}]) AS d, price FROM sales WHERE {M} IN ('{BEFORE}', '{MONTH}')),
g AS (SELECT d.dim AS dim, d.value AS label, coalesce(sum(price) FILTER (WHERE period = '{MONTH}'), 0) - coalesce(sum(price) FILTER (WHERE period = '{BEFORE}'), 0) AS delta FROM long GROUP BY 1, 2), s AS (SELECT *, delta / sum(delta) OVER (PARTITION BY dim) AS share, row_number() OVER (PARTITION BY dim ORDER BY abs(delta) DESC, label) AS position FROM g),
c AS (SELECT *, sum(share) OVER (PARTITION BY dim ORDER BY position) AS covered FROM s), r AS (SELECT dim, coalesce(min(position) FILTER (WHERE covered >= 0.8 - 1e-12), count(*)) AS reach FROM c GROUP BY 1)
SELECT dim, label, round(delta, 2) AS delta, round(share, 5) AS share, position, CAST(reach AS INTEGER) AS cells_to_part FROM c JOIN r USING (dim)""")
def drill_dimensions(spark, sf_dir):
    """Drill: which dimension's fewest members carry the change of a month."""
    d = analyses.drill_dimensions(tables.sales_cells(spark, sf_dir), list(tables.SALES_DIMS), "price", "month", BEFORE, MONTH)
    return d.select("dim", "label", *money("delta"), F.round("share", 5).alias("share"), "position", "cells_to_part")


_OTHERS = [d for d in tables.SALES_DIMS if d != "r_name"]


@query(f""", long AS (SELECT {M} AS period, unnest([{", ".join(f"{{'dim': '{d}', 'value': {d}}}" for d in _OTHERS)}]) AS d, price FROM sales WHERE {M} IN ('{BEFORE}', '{MONTH}') AND r_name = 'ASIA'),
g AS (SELECT d.dim AS dim_b, d.value AS label_b, coalesce(sum(price) FILTER (WHERE period = '{MONTH}'), 0) - coalesce(sum(price) FILTER (WHERE period = '{BEFORE}'), 0) AS delta, count(*) FILTER (WHERE period = '{MONTH}') AS n FROM long GROUP BY 1, 2),
s AS (SELECT *, sum(delta) OVER (PARTITION BY dim_b) AS moved, count(*) FILTER (WHERE n > 0) OVER (PARTITION BY dim_b) AS members FROM g) SELECT dim_b, label_b, round(delta, 2) AS delta, n, round(abs(delta / moved), 5) AS share FROM s WHERE members >= 3 AND moved <> 0""")
def drill_inside(spark, sf_dir):
    """Drill: how the change inside one region falls on the other dimensions."""
    d = analyses.drill_inside(tables.sales_cells(spark, sf_dir), "r_name", "ASIA", "price", "month", BEFORE, MONTH)
    return d.select("dim_b", "label_b", *money("delta"), "n", F.round("share", 5).alias("share"))


@query(f""", y AS (SELECT n_name, count(*) AS n, sum(price) AS x, unnest([{{'measure': 'quantity', 'v': sum(quantity)}}, {{'measure': 'discount', 'v': avg(discount)}}]) AS o FROM sales WHERE {KEY_SQL["year"]} = '2001' GROUP BY 1),
v AS (SELECT o.measure AS measure, x, o.v AS v FROM y WHERE n >= 30), k AS (SELECT *, rank() OVER (PARTITION BY measure ORDER BY x) + (count(*) OVER (PARTITION BY measure, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY measure ORDER BY v) + (count(*) OVER (PARTITION BY measure, v) - 1) / 2.0 AS b FROM v),
c AS (SELECT measure, count(*) AS n, corr(x, v) AS r, corr(a, b) AS rho FROM k GROUP BY 1 HAVING count(*) >= 3), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM c)
SELECT measure, n, round(r, 6) AS r, round(t, 5) AS t, round({t_sql("t", "df")}, 6) AS p, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high, round(rho, 6) AS rho, abs(r) >= 0.985 AS derived, abs(r) - abs(rho) > 0.25 AS leverage FROM t""")
def correlations(spark, sf_dir):
    """Correlate: which measures move with price over nations in a year, with test and interval."""
    d = analyses.correlations(tables.sales_cells(spark, sf_dir), "n_name", "price", tables.SALES_MEASURES, "year", "2001")
    return d.select("measure", "n", F.round("r", 6).alias("r"), F.round("t", 5).alias("t"), *[F.round(c, 6).alias(c) for c in ("p", "low", "high", "rho")], "derived", "leverage")


@query(f""", s AS (SELECT r_name AS series, {M} AS period, sum(price) AS x, row_number() OVER (PARTITION BY r_name ORDER BY {M}) AS i, count(*) OVER (PARTITION BY r_name) AS n FROM sales WHERE {M} <= '{MONTH}' GROUP BY 1, 2),
w AS (SELECT a.k AS ka, b.k AS kb, 0.02 + 0.048 * a.k AS alpha, 0.02 + 0.048 * b.k AS beta FROM range(21) a(k), range(21) b(k)),
h AS (WITH RECURSIVE f AS (SELECT series, ka, kb, alpha, beta, CAST(1 AS BIGINT) AS i, s1.x AS level, s2.x - s1.x AS trend, CAST(0 AS DOUBLE) AS sse FROM (SELECT series, x FROM s WHERE i = 1) s1 JOIN (SELECT series, x FROM s WHERE i = 2) s2 USING (series), w
 UNION ALL SELECT f.series, ka, kb, alpha, beta, s.i, alpha * s.x + (1 - alpha) * (level + trend), beta * (alpha * s.x + (1 - alpha) * (level + trend) - level) + (1 - beta) * trend, sse + (s.x - level - trend) * (s.x - level - trend) FROM f JOIN s ON s.series = f.series AND s.i = f.i + 1) SELECT f.* FROM f JOIN (SELECT series, max(n) AS n FROM s GROUP BY 1) USING (series) WHERE f.i = n AND n >= 8),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY series ORDER BY sse, ka, kb) = 1) SELECT series, CAST(step AS INTEGER) AS step, round(level + step * trend, 1) AS value FROM b, range(1, 4) r(step)""")
def holt_levels(spark, sf_dir):
    """Forecast: the next three months of each region by the weights of least squared error."""
    c = lookup.one_way(sales_cells(spark, sf_dir), "r_name", "price", "month").where(F.col("period") <= MONTH)
    return forecast.forecast_series(c.select(F.col("val_a").alias("series"), "period", F.col("sum").alias("value")), 3).select("series", "step", F.round("value", 1).alias("value"))


_HOLT_SQL = f""", s AS (SELECT r_name AS series, {M} AS period, sum(price) AS x, row_number() OVER (PARTITION BY r_name ORDER BY {M}) AS i, count(*) OVER (PARTITION BY r_name) AS n FROM sales WHERE {M} <= '{MONTH}' GROUP BY 1, 2),
w AS (SELECT a.k AS ka, b.k AS kb, 0.02 + 0.048 * a.k AS alpha, 0.02 + 0.048 * b.k AS beta FROM range(21) a(k), range(21) b(k)), nn AS (SELECT series, max(n) AS n FROM s GROUP BY 1),
fx AS (WITH RECURSIVE f AS (SELECT series, ka, kb, alpha, beta, CAST(1 AS BIGINT) AS i, s1.x AS level, s2.x - s1.x AS trend, CAST(0 AS DOUBLE) AS sse, CAST(0 AS DOUBLE) AS se FROM (SELECT series, x FROM s WHERE i = 1) s1 JOIN (SELECT series, x FROM s WHERE i = 2) s2 USING (series), w
 UNION ALL SELECT f.series, ka, kb, alpha, beta, s.i, alpha * s.x + (1 - alpha) * (level + trend), beta * (alpha * s.x + (1 - alpha) * (level + trend) - level) + (1 - beta) * trend, sse + (s.x - level - trend) * (s.x - level - trend), se + (s.x - level - trend) FROM f JOIN s ON s.series = f.series AND s.i = f.i + 1) SELECT * FROM f),
best AS (SELECT * FROM fx QUALIFY row_number() OVER (PARTITION BY series, i ORDER BY sse, ka, kb) = 1),
fin AS (SELECT best.*, n, sqrt((sse - se * se / (n - 1)) / (n - 2)) AS sigma FROM best JOIN nn USING (series) WHERE i = n AND n >= 8),
bt AS (SELECT b.series, count(*) AS folds, avg(abs(b.level + b.trend - a.x)) / avg(abs(o.x - a.x)) AS ratio FROM best b JOIN nn USING (series) JOIN s a ON a.series = b.series AND a.i = b.i + 1 JOIN s o ON o.series = b.series AND o.i = b.i WHERE b.i >= greatest(6, nn.n // 2) GROUP BY 1),
tq AS (WITH RECURSIVE r AS (SELECT DISTINCT CAST(greatest(2, n - 2) AS DOUBLE) AS df, CAST(0 AS DOUBLE) AS lo, CAST(20 AS DOUBLE) AS hi, 0 AS k FROM nn UNION ALL SELECT df, CASE WHEN p > 0.2 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.2 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, {t_sql("((lo + hi) / 2)", "df")} AS p FROM r WHERE k < 60)) SELECT df, (lo + hi) / 2 AS t FROM r WHERE k = 60)"""


@query(_HOLT_SQL + """, o AS (SELECT fin.*, step, t * sigma * sqrt(list_sum(list_transform(range(step), lambda k: (1 + k * alpha * beta) ** 2))) AS half, ratio, folds FROM fin JOIN bt USING (series) JOIN tq ON df = greatest(2, n - 2), range(1, 4) r(step))
SELECT series, CAST(step AS INTEGER) AS step, round(level + step * trend, 1) AS value, round(level + step * trend - half, 1) AS low, round(level + step * trend + half, 1) AS high, round(ratio, 6) AS naive_ratio, folds FROM o""")
def holt_forecast(spark, sf_dir):
    """Three months ahead for each region, with interval, and the error of one-step forecasts against that of the last value."""
    c = lookup.one_way(sales_cells(spark, sf_dir), "r_name", "price", "month").where(F.col("period") <= MONTH)
    f = forecast.forecast_series(c.select(F.col("val_a").alias("series"), "period", F.col("sum").alias("value")), 3)
    return f.select("series", "step", *[F.round(x, 1).alias(x) for x in ("value", "low", "high")], F.round("naive_ratio", 6).alias("naive_ratio"), F.col("folds").cast("long").alias("folds"))


# ---------------------------------------------------------------- questions

_INTENT_CASES = {
    name: "CASE " + " ".join(f"WHEN regexp_matches(q, {text(pattern)}) THEN {text(label)}" for label, pattern in table) + f" {rest} END"
    for name, table, rest in (("analysis", intent.ANALYSES, ""), ("grain", intent.GRAIN_WORDS, "ELSE 'month'"), ("shape", intent.SHAPES, ""))
}
_ASKED = ("Scan {} for anything unusual", "Why did price drop in {}?", "top 7 by quantity, {}", "forecast the next 5 quarters of {}", "what moves together with discount in {}?", "explain the change in {} yearly", "weekly trend of price, {}", "deep dive into every member of {}", "bottom 3 of {} per day", "total price overall in {}")


@query(f"""WITH t AS (SELECT c_custkey AS id, [{", ".join(text(q) for q in _ASKED)}][c_custkey % {len(_ASKED)} + 1] AS template, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), a AS (SELECT id, r_name, replace(template, '{{}}', r_name) AS question FROM t), q AS (SELECT *, ' ' || lower(question) || ' ' AS q FROM a)
SELECT id, {_INTENT_CASES["analysis"]} AS analysis, {_INTENT_CASES["grain"]} AS grain, least(20, coalesce(try_cast(nullif(regexp_extract(q, '\\btop\\s+(\\d{{1,2}})\\b', 1), '') AS INTEGER), 5)) AS k, least(12, coalesce(try_cast(nullif(regexp_extract(q, '\\bnext\\s+(\\d{{1,2}})\\b', 1), '') AS INTEGER), 3)) AS horizon,
regexp_matches(q, '\\b(bottom|worst|lowest)\\b') AS ascending, CASE WHEN q LIKE '%discount%' THEN 'discount' WHEN q LIKE '%price%' THEN 'price' WHEN q LIKE '%quantity%' THEN 'quantity' ELSE 'discount' END AS measure, q LIKE '%discount%' OR q LIKE '%price%' OR q LIKE '%quantity%' AS explicit, r_name AS member FROM q""", on_sales=False)
def intents(spark, sf_dir):
    """A question of every customer about its region, read as analysis, grain, number, horizon, direction, measure and member."""
    region = tables.read(spark, sf_dir, "nation").join(tables.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = tables.read(spark, sf_dir, "customer").join(region, F.col("c_nationkey") == F.col("n_nationkey"))
    template = F.get(F.array(*[F.lit(q) for q in _ASKED]), F.pmod("c_custkey", F.lit(len(_ASKED))).cast("int"))
    questions = asked.select(F.col("c_custkey").alias("id"), F.replace(template, F.lit("{}"), F.col("r_name")).alias("question"))
    members = sorted(r["r_name"] for r in tables.read(spark, sf_dir, "region").select("r_name").collect())
    p = profile.Profile(0, "day", dims=[(d, 5) for d in sorted(tables.SALES_DIMS)], measures=[profile.Measure(m, a, "", 0, 0, 0, 0, 0, 0, 0, False, 0) for m, a in sorted(tables.SALES_MEASURES.items())], members={"r_name": members})
    return intent.read_questions(questions, p).select("id", "analysis", "grain", "k", "horizon", "ascending", "measure", "explicit", "member")


@query(f", c AS (SELECT {M} AS p, n_name, count(*) AS n FROM sales GROUP BY 1, 2) SELECT round(avg(CASE WHEN n < 30 THEN 1.0 ELSE 0.0 END), 6) AS thin, count(*) AS cells FROM c")
def thin_cells(spark, sf_dir):
    """Share of a dimension's month cells that are too thin to test."""
    c = sales_cells(spark, sf_dir, ("n_name",)).where("dim_a IS NOT NULL")
    return c.agg(F.round(F.avg((F.col("n") < 30).cast("double")), 6).alias("thin"), F.count("*").alias("cells"))
