from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import hypotheses as tests
from plumbline.functions import special, stats
from plumbline.functions.timeaxis import parse_day, period, period_range
from plumbline.operators import forecast
from plumbline.operators.cells import select_pairs
from plumbline.operators.profile import classify_aggregation, name_is_id


def test_known_values_on_the_driver():
    assert stats.t_cdf(2.228, 10) == pytest.approx(0.975, abs=5e-4)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228, abs=2e-3)
    assert stats.pearson([1, 2, 3, 4, 5], [2, 4, 5, 4, 5]) == pytest.approx(0.7745966692)
    q = stats.benjamini_hochberg([0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.5])
    assert q == sorted(q) and q[0] == pytest.approx(0.01)


def test_columns_agree_with_the_driver(spark):
    grid = [(t, n) for t in (0.0, 0.3, 1.812, 2.228, 8.0) for n in (1, 2, 10, 57)]
    rows = spark.createDataFrame(grid, "t double, n int").select("t", "n", special.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    assert all(r.p == pytest.approx(stats.t_p(r.t, r.n), rel=1e-9) for r in rows)
    g = spark.range(1).select(tests.grubbs(F.lit(3), F.lit(2 / 3**0.5)).alias("g"), special.binomial_tail(F.lit(18), F.lit(18), F.lit(1 / 3)).alias("b")).first()
    assert g.g.degenerate and g.g.known == 0.05 and g.g.t is None
    assert g.b == pytest.approx((1 / 3) ** 18)


def test_quantiles_equal_numpy(spark, monkeypatch):
    from plumbline.operators import profile

    rng = np.random.default_rng(2)
    shares = (0.0, 0.05, 0.5, 0.77, 0.95, 1.0)
    monkeypatch.setattr(profile, "SORTED", 50)
    monkeypatch.setattr(profile, "SKETCH", 100)
    for x in (rng.normal(size=3000), rng.integers(0, 5, 2000).astype(float), np.array([7.0]), np.append(np.full(900, 3.0), rng.normal(size=600))):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
        assert profile.quantiles(df, "v", shares) == pytest.approx(np.quantile(x, shares).tolist())
    assert profile.quantiles(spark.createDataFrame([], "v double"), "v", (0.5,)) == [None]


def test_column_quantile_and_interval_agree_with_the_driver(spark):
    grid = [(p, n) for p in (0.03, 0.5, 0.9, 0.995) for n in (1, 3, 40)]
    rows = spark.createDataFrame(grid, "p double, n int").select("p", "n", special.t_quantile(F.col("p"), F.col("n")).alias("t")).collect()
    assert all(r.t == pytest.approx(stats.t_quantile(r.p, r.n), abs=1e-7, rel=1e-7) for r in rows)
    x = [3.0, 5.0, 4.5, 8.0]
    i = spark.range(1).select(tests.mean_interval(F.lit(4), F.lit(float(np.mean(x))), F.lit(float(np.std(x, ddof=1)))).alias("i")).first().i
    assert (i.mean, i.low, i.high) == pytest.approx(stats.mean_interval(x))


def test_dates(spark):
    given = ["2024-03-05", "2024/03/05", "2024.03.05", "2024-03-05T10:11:12", "05/3/2024", "3-25-2024", "5-Mar-24", "5-Mar-71", "2024-02-31", "x", ""]
    out = [r.d for r in spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string").orderBy("i").select(parse_day(F.col("s")).alias("d")).collect()]
    d = date(2024, 3, 5)
    assert out == [d, d, d, d, d, date(2024, 3, 25), d, date(1971, 3, 5), None, None, None]
    k = spark.sql("SELECT date'2021-01-03' AS d").select(*[period(F.col("d"), g).alias(g) for g in ("week", "quarter")]).first()
    assert (k.week, k.quarter) == ("2020-W53", "2021-Q1")
    assert period_range("2024-Q3", "quarter") == (date(2024, 7, 1), date(2024, 9, 30))
    with pytest.raises(ValueError):
        period_range("2024", "month")


def test_roles_and_pairs():
    assert name_is_id("order_id") and not name_is_id("l_orderkey")
    assert classify_aggregation("margin_pct", 0, 0.5, False)[0] == "avg"
    assert classify_aggregation("revenue", 0, 1e6, False)[0] == "sum"
    assert select_pairs({"a": 5, "b": 4, "c": 200}) == [("a", "b")]


def test_trend_beats_naive_and_walk_does_not():
    rng = np.random.default_rng(1)
    line = 400 + 40 * np.arange(30) + rng.normal(0, 5, 30)
    assert forecast.backtest(line, 12)["naive_ratio"] < 1
    f = forecast.forecast(forecast.fit(line), 3)
    assert f[0]["value"] == pytest.approx(1600, rel=0.05) and f[2]["high"] - f[2]["low"] > f[0]["high"] - f[0]["low"]
    assert forecast.fit([1, 2, 3]) is None


def test_quantiles_of_columns_share_their_passes_and_hold_with_wrong_brackets(spark, monkeypatch):
    from plumbline.operators import profile

    rng, read = np.random.default_rng(4), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(profile, "SORTED", 400)
    monkeypatch.setattr(profile, "SKETCH", 100)
    n, shares = 3000, profile.PERCENTILES
    x = {"price": rng.normal(size=n), "units": rng.integers(0, 40, n).astype(float), "total": rng.exponential(size=n)}
    want = [pytest.approx(np.quantile(v, shares).tolist()) for v in x.values()]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], "price double, units double, total double")

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = df.mapInArrow(count, df.schema)
    found = profile.with_exact_percentiles(profile.profile(seen, dict.fromkeys(x, "measure")), seen)
    assert read.value <= 3 * n
    assert {m.name: [m.p05, m.p50, m.p95] for m in found.measures} == dict(zip(x, want, strict=True))
    wrong = {"price": [(50.0, 60.0)], "units": [(3.0, 3.0)], "total": [(0.0, 1e9)]}
    assert profile.quantiles_of(df, list(x), shares, wrong) == want
    assert profile.quantiles_of(df.where("price > 100"), list(x), shares, wrong) == [[None] * 3] * 3
