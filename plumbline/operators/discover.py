"""Discovery: candidate findings from cells, tested, corrected for the search, tiered and selected.

Rows are cells, not data rows.  The families of tests read the same kept cells; what they find (test statistics, one row a
test) is kept before p-values, q-values and tiers are worked out, so that each of those expressions is planned once.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plumbline.functions import hypotheses as tests
from plumbline.functions import stats
from plumbline.operators.profile import Profile
from plumbline.sources.store import keep


@dataclass(frozen=True)
class Settings:
    q_limit: float = 0.10
    min_rows: int = 30
    min_share: float = 0.005
    min_members: int = 6
    min_persist_periods: int = 6
    min_history: int = 5
    max_feed: int = 30
    max_per_pair: int = 2
    max_per_value: int = 3
    low_ceiling: float = 0.35
    history: int = 13
    lookback: int = 24
    #: Leave persistence results of p >= 0.5 out of the correction, as they show nothing.
    trim_persistence: bool = True


# name -> type of a candidate row
FIELDS = {
    "kind": "string", "measure": "string", "dim": "string", "value": "string", "dim_b": "string", "value_b": "string", "val": "double", "n": "bigint", "share": "double", "test": "string", "statistic": "double",
    "p": "double", "effect": "double", "low_power": "boolean", "degenerate": "boolean", "members": "bigint", "direction": "string", "ceiling": "double", "hist_mean": "double", "history_n": "bigint",
    "pct_change": "double", "hits": "bigint", "periods": "bigint", "expected": "double", "extreme": "string", "rest_mean": "double", "reason": "string",
}


#: What a p-value is worked out from; see tests.p_value.
PARTS = {"__t": "double", "__df": "double", "__times": "double", "__known": "double"}


def _shape(df: DataFrame, **given: Column) -> DataFrame:
    return df.select(*[(given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in (FIELDS | PARTS).items() if k != "p"])


def supported(cells: DataFrame, aggs: dict[str, str], grain: str, s: Settings) -> DataFrame:
    """One-way cells with value, share of all absolute values of their dimension and period, and whether they carry a claim."""
    averaged = [m for m, a in aggs.items() if a == "avg"]
    own = cells.where((F.col("grain") == grain) & F.col("dim_a").isNotNull() & F.col("dim_b").isNull() & (F.col("dim_a") != F.col("measure")) & F.col("measure").isin(list(aggs)))
    value = F.when(F.col("measure").isin(averaged), F.col("sum") / F.col("n")).otherwise(F.col("sum"))
    w = Window.partitionBy("measure", "dim", "period")
    own = own.select("measure", F.col("dim_a").alias("dim"), F.col("val_a").alias("value"), "period", "n", value.alias("val"))
    own = own.withColumn("share", F.coalesce(F.try_divide(F.abs("val"), F.sum(F.abs("val")).over(w)), F.lit(0.0)))
    reason = F.when(F.col("n") < s.min_rows, "low row count").when(F.col("share") < s.min_share, "negligible share")
    return own.withColumn("dropped", reason)


def sibling_candidates(own: DataFrame, period: str, s: Settings) -> DataFrame:
    """Grubbs on the most extreme member of each (measure, dimension); too few members: a row with a reason, no p."""
    here = own.where(F.col("period") == period)
    w = Window.partitionBy("measure", "dim")
    placed = here.withColumn("shown", F.count("*").over(w)).withColumn("held", F.count(F.when(F.col("dropped").isNull(), 1)).over(w)).where("shown >= 2")
    kept = placed.where("dropped IS NULL")
    top = tests.extremes(kept.select("measure", "dim", "value", "val", "n", "share"), "val", ["measure", "dim"])
    top = top.withColumnsRenamed({"seen": "m", "total": "s", "square": "q"})
    ok = (F.col("m") >= s.min_members) & (F.col("sd") > 0)
    others_mean, others_sd = tests.leave_one_out(F.col("m"), F.col("s"), F.col("q"), F.col("val"))
    top = top.withColumn("g", F.when(ok, F.col("g"))).withColumn("t", F.when(ok, tests.grubbs(F.col("m"), F.col("g"))))
    effect = F.when(ok & (F.col("m") >= 6), (F.col("val") - others_mean) / F.when(others_sd > 0, others_sd))
    bare = placed.where("held = 0").groupBy("measure", "dim").agg(F.lit(0).alias("m"))
    none = _shape(bare, kind=F.lit("sibling"), measure=F.col("measure"), dim=F.col("dim"), test=F.lit("grubbs-two-sided"), members=F.col("m"), reason=F.concat(F.lit("no member of "), F.col("dim"), F.lit(" clears the support floor")))
    return none.unionByName(_shape(
        top, kind=F.lit("sibling"), measure=F.col("measure"), dim=F.col("dim"), value=F.when(ok, F.col("value")), val=F.when(ok, F.col("val")), n=F.when(ok, F.col("n")), share=F.when(ok, F.col("share")), test=F.lit("grubbs-two-sided"), statistic=F.col("g"),
        __t=F.col("t.t"), __df=F.col("t.df"), __times=F.col("t.times"), __known=F.col("t.known"), effect=effect, low_power=F.col("t.low_power"), degenerate=F.col("t.degenerate"), members=F.col("m"), direction=F.when(F.col("val") > F.col("mean"), "above").otherwise("below"), ceiling=F.col("t.ceiling"),
        reason=F.when(F.col("m") < s.min_members, F.concat(F.col("m").cast("string"), F.lit(" testable members of "), F.col("dim"), F.lit(f", the test needs {s.min_members}"))).when(~ok, "no variance among members"),
    ))


def temporal_candidates(own: DataFrame, period: str, s: Settings) -> DataFrame:
    """The latest value of each supported member against its own observed history in the periods before."""
    places = own.select("period").distinct().where(F.col("period") <= period).withColumn("back", F.row_number().over(Window.orderBy(F.desc("period"))))
    seen = own.join(F.broadcast(places.where(F.col("back") <= s.history)), "period")
    w = Window.partitionBy("measure", "dim", "value")
    before = F.col("back") > 1
    hist = seen.withColumn("hn", F.count(F.when(before, 1)).over(w)).withColumn("hm", F.avg(F.when(before, F.col("val"))).over(w)).withColumn("hs", F.stddev_samp(F.when(before, F.col("val"))).over(w)).withColumn("prev", F.max_by("val", F.when(before, F.col("period"))).over(w))
    now = hist.where((F.col("back") == 1) & F.col("dropped").isNull() & (F.col("hn") >= s.min_history) & (F.col("hs") > 0)).withColumn("t", tests.last_point(F.col("val"), F.col("hn"), F.col("hm"), F.col("hs")))
    return _shape(
        now, kind=F.lit("temporal"), measure=F.col("measure"), dim=F.col("dim"), value=F.col("value"), val=F.col("val"), n=F.col("n"), share=F.col("share"), test=F.lit("studentized-deviation"), statistic=F.col("t.t"), __t=F.col("t.t"), __df=F.col("t.df"),
        direction=F.when(F.col("val") > F.col("hm"), "above").otherwise("below"), hist_mean=F.col("hm"), history_n=F.col("hn"), pct_change=F.try_divide(F.col("val") - F.col("prev"), F.col("prev")),
    )


def persistence_candidates(own: DataFrame, period: str, s: Settings) -> DataFrame:
    """How often a member was the highest or lowest of its dimension over the periods up to `period`."""
    places = own.select("period").distinct().where(F.col("period") <= period).withColumn("back", F.row_number().over(Window.orderBy(F.desc("period"))))
    seen = own.where("dropped IS NULL").join(F.broadcast(places.where(F.col("back") <= s.lookback)), "period")
    each = Window.partitionBy("measure", "dim", "period")
    seen = seen.withColumn("k", F.count("*").over(each)).where("k >= 2")
    seen = seen.withColumn("top", F.row_number().over(each.orderBy(F.desc("val"), "value"))).withColumn("bottom", F.col("k") - F.col("top") + 1)
    group = Window.partitionBy("measure", "dim")
    seen = seen.withColumn("observed", F.sum(F.when(F.col("top") == 1, 1)).over(group)).withColumn("members", F.max("k").over(group))
    by = seen.groupBy("measure", "dim", "value").agg(*[F.sum((F.col(x) == 1).cast("int")).alias(x) for x in ("top", "bottom")], *[F.max(x).alias(x) for x in ("observed", "members")], F.max_by(F.struct("val", "n", "share"), "period").alias("last"))
    long = by.withColumn("x", F.explode(F.array(F.struct(F.lit("top").alias("extreme"), F.col("top").alias("hits")), F.struct(F.lit("bottom").alias("extreme"), F.col("bottom").alias("hits"))))).select("*", "x.extreme", "x.hits")
    # of two members, the lowest is but the complement of the highest
    long = long.where((F.col("hits") > 0) & (F.col("observed") >= s.min_persist_periods) & ((F.col("extreme") == "top") | (F.col("members") > 2)))
    long = long.withColumn("p", tests.persistence(F.col("hits"), F.col("observed"), F.col("members")))
    if s.trim_persistence:
        long = long.where("p < 0.5")
    return _shape(
        long, kind=F.lit("persistence"), measure=F.col("measure"), dim=F.col("dim"), value=F.col("value"), val=F.col("last.val"), n=F.col("last.n"), share=F.col("last.share"), test=F.lit("binomial-persistence"), statistic=F.col("hits") / F.col("observed"), __known=F.col("p"),
        hits=F.col("hits"), periods=F.col("observed"), members=F.col("members"), expected=F.col("observed") / F.col("members"), extreme=F.col("extreme"), direction=F.when(F.col("extreme") == "top", "above").otherwise("below"),
    )


def against_rest(cells: DataFrame) -> DataFrame:
    """Two-way cells with k, the cells of their measure, pair and period, whole, the sum of them, and t, the Welch test of
    each against all other rows of its pair."""
    w = Window.partitionBy("measure", "dim_a", "dim_b", "period")
    c = cells.withColumn("k", F.count("*").over(w)).withColumn("whole_n", F.sum("n").over(w)).withColumn("whole", F.sum("sum").over(w)).withColumn("whole_sq", F.sum("sum_sq").over(w))
    return c.withColumn("t", tests.welch(F.col("n"), F.col("sum"), F.col("sum_sq"), F.col("whole_n") - F.col("n"), F.col("whole") - F.col("sum"), F.col("whole_sq") - F.col("sum_sq")))


def cross_candidates(cells: DataFrame, aggs: dict[str, str], grain: str, period: str, s: Settings) -> DataFrame:
    """Welch test of each two-way cell's mean against all other rows of its pair and period."""
    own = cells.where((F.col("grain") == grain) & (F.col("period") == period) & F.col("dim_b").isNotNull() & (F.col("dim_a") != F.col("measure")) & (F.col("dim_b") != F.col("measure")) & F.col("measure").isin(list(aggs)))
    own = against_rest(own).where((F.col("k") >= 4) & (F.col("n") >= s.min_rows) & F.col("t").isNotNull())
    return _shape(
        own, kind=F.lit("cross"), measure=F.col("measure"), dim=F.col("dim_a"), value=F.col("val_a"), dim_b=F.col("dim_b"), value_b=F.col("val_b"), val=F.col("t.mean1"), rest_mean=F.col("t.mean2"), n=F.col("n"), share=F.coalesce(F.try_divide("sum", "whole"), F.lit(0.0)),
        test=F.lit("welch-t"), statistic=F.col("t.t"), __t=F.col("t.t"), __df=F.col("t.df"), effect=F.col("t.effect"), direction=F.when(F.col("t.mean1") > F.col("t.mean2"), "above").otherwise("below"),
    )


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    p = stats.t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).where(~pd.isna(df.reset_index(drop=True)), None)


def candidates(cells: DataFrame, aggs: dict[str, str], grain: str, period: str, s: Settings | None = None) -> DataFrame:
    """All candidate rows, tested and untestable, with p, q and `significant`.  `cells` is best a kept table: each family of
    tests reads it."""
    s = s or Settings()
    own = supported(cells, aggs, grain, s)
    found = keep(sibling_candidates(own, period, s).unionByName(temporal_candidates(own, period, s)).unionByName(persistence_candidates(own, period, s)).unionByName(cross_candidates(cells, aggs, grain, period, s)))
    # one batch of numbers for all tests; as an expression the continued fraction would be folded row by row
    own = F.when(F.col("__t").isNotNull(), F.least(F.lit(1.0), F.coalesce("__times", F.lit(1.0)) * _t_two_sided("__t", "__df")))
    tested = found.withColumn("p", F.coalesce("__known", own)).select(*FIELDS)
    ties = ("kind", "measure", "dim", "value", "dim_b", "value_b", "extreme")
    return tests.benjamini_hochberg(tested, ties=ties).withColumn("significant", F.col("q") <= s.q_limit)


def with_tier(found: DataFrame, s: Settings) -> DataFrame:
    """Adds tier and tier_reason: the evidence standard a finding meets."""
    effect, share, weak = F.abs(F.coalesce("effect", F.lit(0.0))), F.abs(F.coalesce("share", F.lit(0.0))), F.coalesce("low_power", F.lit(False))
    material = (effect >= 0.8) | (share >= 0.25) | ((F.col("kind") == "persistence") & (F.col("statistic") >= 0.75)) | ((F.col("kind") == "temporal") & (F.abs(F.coalesce("pct_change", F.lit(0.0))) >= 0.2))
    high, strong, passed = (F.col("q") <= 0.001) & ~weak & (effect >= 1), (F.col("q") <= 0.01) & ~weak & material, F.col("q") <= s.q_limit
    tier = F.when(F.col("p").isNull(), "low").when(high, "high").when(strong | passed, "medium").otherwise("low")
    why = F.when(F.col("p").isNull(), "no test applies").when(high, "q <= 0.001 with an effect of one sd or more").when(strong, "q <= 0.01 with a material effect").when(passed & weak, "passes correction with limited power")
    why = why.when(passed & ~material, "passes correction with a small effect").when(passed, "passes correction").otherwise("does not pass correction: unproven")
    return found.withColumn("tier", tier).withColumn("tier_reason", why)


def deduplicate(found: DataFrame) -> DataFrame:
    """The finding of least q about each subject, the other tests listed as corroboration."""
    subject = ["measure", "dim", "value", "dim_b", "value_b"]
    w = Window.partitionBy(*subject)
    order = F.when(F.col("kind") == "sibling", 0).when(F.col("kind") == "temporal", 1).when(F.col("kind") == "persistence", 2).otherwise(3)
    ranked = found.withColumn("__k", F.row_number().over(w.orderBy(F.col("q").asc_nulls_last(), order, "extreme"))).withColumn("__tests", F.collect_list(F.struct("__k", "test")).over(w))
    others = F.transform(F.filter("__tests", lambda x: x["__k"] > 1), lambda x: x["test"])
    return ranked.where("__k = 1").withColumn("corroboration", others).drop("__k", "__tests")


RANK = {"high": 0, "medium": 1, "low": 2}


def survivors(found: DataFrame, s: Settings) -> DataFrame:
    """Every finding that passes correction, with tier and strength: what an effect is worth, not how small its p is."""
    return _with_strength(with_tier(found.where("significant"), s))


def _with_strength(fed: DataFrame) -> DataFrame:
    zero = lambda c: F.abs(F.coalesce(c, F.lit(0.0)))
    return fed.withColumn("strength", zero("effect") * 2 + zero("share") + zero("statistic") * 0.05)


def ranked_feed(found: DataFrame, s: Settings) -> DataFrame:
    """Deduplicated findings, tested or descriptive, with tier, strength and their place in the feed."""
    # a row without p is either descriptive, and shown, or untestable with its reason, which belongs to the audit
    pool = found.where((F.col("q") <= max(s.q_limit, s.low_ceiling)) | (F.col("p").isNull() & F.col("reason").isNull()))
    fed = _with_strength(with_tier(deduplicate(pool), s))
    place = F.row_number().over(Window.orderBy(F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2), F.desc("strength"), F.coalesce("q", F.lit(1.0)), "value", "measure", "dim", "dim_b", "value_b"))
    return fed.withColumn("place", place)


def select_diverse(fed: DataFrame, s: Settings) -> DataFrame:
    """At most max_feed findings: each measure in turn gives its next best one, within caps for pairs and members.

    Caps are kept by measure, so each measure's choice is made on its own, over its part of the feed.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs: dict[tuple, int] = {}
        members: dict[tuple, int] = {}
        kept = []
        for i, r in enumerate(pdf.sort_values("place").itertuples()):
            two = r.kind == "cross"
            pair = tuple(sorted((r.dim, r.dim_b))) if two else (r.dim,)
            own = [(r.dim, r.value), (r.dim_b, r.value_b)] if two else [(r.dim, r.value)]
            if pairs.get(pair, 0) >= s.max_per_pair or any(members.get(o, 0) >= s.max_per_value for o in own):
                continue
            pairs[pair] = pairs.get(pair, 0) + 1
            for o in own:
                members[o] = members.get(o, 0) + 1
            kept.append((r.place, len(kept)))
            if len(kept) == s.max_feed:
                break
        out = pd.DataFrame(kept, columns=["place", "turn"])
        out["lead"] = pdf["place"].min()
        return out

    turns = fed.select("measure", "kind", "dim", "value", "dim_b", "value_b", "place").groupBy("measure").applyInPandas(choose, "place int, turn int, lead int")
    chosen = turns.orderBy("turn", "lead").limit(s.max_feed)
    tier = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return fed.join(chosen.select("place"), "place").orderBy(tier, F.desc(F.abs(F.coalesce("effect", F.lit(0.0)))), "q", "place")


def audit(found: DataFrame) -> DataFrame:
    """One row: tests, survived and untestable candidates of a search."""
    return found.agg(F.count("p").alias("tests"), F.count(F.when(F.col("significant"), 1)).alias("survived"), F.count(F.when(F.col("p").isNull(), 1)).alias("untestable"))


def sentence(r: dict) -> str:
    """What a finding says, from its own numbers."""
    where = f"{r['dim']} = {r['value']}"
    if r["kind"] == "sibling":
        effect = f", {abs(r['effect']):.1f} sd from its peers" if r["effect"] is not None else ""
        power = f" With {r['members']} members the test has limited power." if r["low_power"] else ""
        return f"{where} lies {r['direction']} the other {r['members'] - 1} members on {r['measure']}{effect}: Grubbs G {r['statistic']:.2f} of at most {r['ceiling']:.2f}, {r['n']:,} rows.{power}"
    if r["kind"] == "temporal":
        moved = f", {r['pct_change']:+.1%} on the period before" if r["pct_change"] is not None else ""
        return f"{where} left its own history on {r['measure']}: {r['val']:,.2f} against a mean of {r['hist_mean']:,.2f} over {r['history_n']} periods{moved} (t {r['statistic']:.2f})."
    if r["kind"] == "persistence":
        return f"{where} was {'highest' if r['extreme'] == 'top' else 'lowest'} on {r['measure']} in {r['hits']} of {r['periods']} periods; {r['expected']:.1f} would be expected of {r['members']} alike members."
    return f"{where} with {r['dim_b']} = {r['value_b']} averages {r['val']:,.2f} on {r['measure']} against {r['rest_mean']:,.2f} elsewhere (Welch t {r['statistic']:.2f}, {r['n']:,} rows)."


PLACES = "region|city|state|country|geo|location|zone|area|territory|district|market"


def titled(found: DataFrame) -> DataFrame:
    """Adds title, what a finding is in one line, and class: temporal, interaction, spatial or behavioral."""
    kind = F.col("kind")
    subject = F.concat(F.col("dim"), F.lit(" = "), F.col("value"), F.when(kind == "cross", F.concat(F.lit(" and "), F.col("dim_b"), F.lit(" = "), F.col("value_b"))).otherwise(""))
    verb = F.when(kind == "sibling", F.concat(F.lit("lies "), F.col("direction"), F.lit(" its peers on"))).when(kind == "temporal", "left its own history on")
    verb = verb.when(kind == "persistence", F.concat(F.lit("is steadily the "), F.when(F.col("extreme") == "bottom", "lowest").otherwise("highest"), F.lit(" on"))).otherwise(F.concat(F.lit("averages "), F.col("direction"), F.lit(" the rest on")))
    what = F.when(kind == "temporal", "temporal").when(kind == "cross", "interaction").when(F.col("dim").rlike(f"(?i){PLACES}"), "spatial").otherwise("behavioral")
    return found.withColumn("title", F.concat_ws(" ", subject, verb, "measure")).withColumn("class", what)


def discover(cells: DataFrame, p: Profile, grain: str, period: str, s: Settings | None = None, measure: str | None = None) -> dict:
    """feed (dicts, with sentence), the strongest survivors (of one measure, if given) and an audit of the search."""
    s = s or Settings()
    found = candidates(cells, {m.name: m.agg for m in p.measures}, grain, period, s).persist()
    try:
        fed = ranked_feed(found, s).persist()
        feed = [r.asDict(recursive=True) for r in titled(select_diverse(fed, s)).collect()]
        passed = survivors(found if measure is None else found.where(F.col("measure") == measure), s)
        best = [r.asDict(recursive=True) for r in titled(passed).orderBy(F.desc("strength"), "q", "measure", "dim", "value", "dim_b", "value_b", "kind").limit(s.max_feed).collect()]
        counts = audit(found).first()
        reasons = [r["reason"] for r in found.where("reason IS NOT NULL").select("reason").distinct().orderBy("reason").limit(8).collect()]
        fed.unpersist()
    finally:
        found.unpersist()
    for r in feed + best:
        r["why"] = sentence(r)
    tiers = {t: sum(r["tier"] == t for r in feed) for t in RANK}
    n, kept = counts["tests"], counts["survived"] or 0
    verdict = f"{kept} of {n} tested cells pass correction at q <= {s.q_limit:g}; {len(feed)} shown." if kept else f"{n} cells tested, none passes correction at q <= {s.q_limit:g}: the data look flat."
    return {"grain": grain, "period": period, "feed": feed, "survivors": best, "tiers": tiers, "audit": {"tests": n, "survived": kept, "untestable": counts["untestable"] or 0, "reasons": reasons, "q_limit": s.q_limit, "min_rows": s.min_rows, "min_share": s.min_share, "verdict": verdict}}
