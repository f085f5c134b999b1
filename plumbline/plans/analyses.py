"""The six analyses over a cell table.

What an analysis computes is a DataFrame over cells (deepdive_members, drill_moves, drill_dimensions, correlations); a card
collects that small result and says it in a sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import hypotheses as tests
from plumbline.functions import stats
from plumbline.operators import decompose, discover, forecast, lookup
from plumbline.operators.profile import Profile

CATALOGUE = {"scan": "What stands out?", "deepdive": "How do all members compare?", "drill": "Where did the change happen?", "correlate": "Which measures move together?", "forecast": "What comes next?", "explain": "What makes up the change?"}
DERIVED, LEVERAGE = 0.985, 0.25


def _frame(cells: DataFrame, p: Profile, intent: dict) -> tuple[str, str, str, str | None]:
    grain = lookup.resolve_grain(cells, intent.get("grain"))
    period = intent.get("period") or lookup.latest_period(cells, grain).first()["period"]
    return grain, period, intent["measure"], intent.get("dimension") or (p.dim_names() or [None])[0]


def _previous(cells: DataFrame, grain: str, period: str) -> str | None:
    return lookup.all_periods(cells, grain).where(F.col("period") < period).agg(F.max("period").alias("p")).first()["p"]


def scan(cells: DataFrame, p: Profile, intent: dict) -> dict:
    """What passes correction, the strongest first; of the measure that was asked for, if one was named."""
    grain, period, measure, _ = _frame(cells, p, intent)
    found = discover.discover(cells, p, grain, period, measure=measure if intent.get("explicit") else None)
    top = found["survivors"][:3]
    return {"analysis": "scan", "grain": grain, "period": period, "findings": top, "audit": found["audit"], "summary": " ".join([found["audit"]["verdict"], *(r["why"] for r in top)])}


def deepdive_members(cells: DataFrame, dim: str, measure: str, grain: str, period: str, agg: str = "sum") -> DataFrame:
    """(label, value, n, share, robust_z, basis, effect) of the members with enough rows; effect is the distance from all
    others in their sds."""
    rows = lookup.breakdown(cells, dim, measure, grain, period, agg).where(F.col("n") >= discover.Settings().min_rows).withColumn("__all", F.lit(0))
    w = Window.partitionBy("__all")
    d = tests.robust_z(rows, "value", ["__all"]).withColumn("__k", F.count("*").over(w)).withColumn("__s", F.sum("value").over(w)).withColumn("__q", F.sum(F.col("value") * F.col("value")).over(w))
    mean, sd = tests.leave_one_out(F.col("__k"), F.col("__s"), F.col("__q"), F.col("value"))
    effect = F.when((F.col("__k") > 2) & (sd > 0), (F.col("value") - mean) / sd)
    return d.select("label", "value", "n", F.coalesce(F.try_divide("value", "__s"), F.lit(0.0)).alias("share"), "robust_z", "basis", effect.alias("effect"))


def deepdive_extreme(members: DataFrame) -> DataFrame:
    """The member farthest from the mean with its Grubbs test: (label, members, g, p, ceiling, low_power); no row if untestable."""
    least = discover.Settings().min_members
    top = tests.extremes(members.select("label", "value", F.lit(0).alias("__all")), "value", ["__all"]).where((F.col("seen") >= least) & (F.col("sd") > 0))
    t = top.withColumn("t", tests.grubbs(F.col("seen"), F.col("g")))
    p = tests.p_value(F.col("t.t"), F.col("t.df"), F.col("t.times"), F.col("t.known"))
    return t.select("label", F.col("seen").alias("members"), "g", p.alias("p"), "t.ceiling", "t.low_power")


def deepdive(cells: DataFrame, p: Profile, intent: dict) -> dict:
    """Every member of a dimension, the extreme one tested."""
    grain, period, measure, dim = _frame(cells, p, intent)
    shown = [r.asDict() for r in lookup.breakdown(cells, dim, measure, grain, period, p.agg_of(measure)).collect()]
    found = deepdive_members(cells, dim, measure, grain, period, p.agg_of(measure))
    members = sorted((r.asDict() for r in found.collect()), key=lambda r: (-abs(r["robust_z"]), r["label"]))
    top = deepdive_extreme(found).first()
    thin = len(shown) - len(members)
    said = f" {top['label']} is the extreme one: Grubbs G {top['g']:.2f}, {stats.format_p(top['p'])}." if top else " Too few vary for a test."
    return {
        "analysis": "deepdive", "measure": measure, "dimension": dim, "grain": grain, "period": period, "members": members, "basis": members[0]["basis"] if members else None, "thin": thin,
        "evidence": top and top.asDict(), "chart": chart(shown), "summary": f"{len(members)} members of {dim} carry {measure}; {thin} have too few rows.{said}",
    }


def chart(rows: list[dict]) -> dict:
    """A pie for up to five members, else bars."""
    return {"type": "pie" if len(rows) <= 5 else "bar", "rows": rows}


def chart_rows(cells: DataFrame, aggs: dict[str, str], grain: str, period: str) -> DataFrame:
    """(measure, dim, bars): the members of each dimension in a period, the largest first; at most the cardinality cutoff of them."""
    averaged = F.col("measure").isin([m for m, a in aggs.items() if a == "avg"])
    own = cells.where((F.col("grain") == grain) & (F.col("period") == period) & F.col("dim_a").isNotNull() & F.col("dim_b").isNull())
    bar = F.struct((-F.when(averaged, F.col("sum") / F.col("n")).otherwise(F.col("sum"))).alias("below"), F.col("val_a").alias("label"), F.col("n"))
    bars = F.transform(F.sort_array(F.collect_list(bar)), lambda b: F.struct(b["label"].alias("label"), (-b["below"]).alias("value"), b["n"].alias("n")))
    return own.groupBy("measure", F.col("dim_a").alias("dim")).agg(bars.alias("bars"))


def card_rows(feed: DataFrame, cells: DataFrame, aggs: dict[str, str], grain: str, period: str) -> DataFrame:
    """The feed with title, class, chart (pie of up to five members, else bars; bars for two-way findings) and bars."""
    shown = discover.titled(feed).join(chart_rows(cells, aggs, grain, period), ["measure", "dim"], "left")
    return shown.withColumn("chart", F.when((F.col("kind") == "cross") | (F.size("bars") > 5), "bar").otherwise("pie"))


def feed_cards(cells: DataFrame, p: Profile, grain: str, period: str, s: discover.Settings | None = None) -> dict:
    """The feed as cards, each with a title, its class, the rows of its chart and the audit of the search.

    The charts are the breakdowns of the measures and dimensions in the feed, read in one pass over the cells.
    """
    found = discover.discover(cells, p, grain, period, s)
    named = {(r["measure"], r["dim"]) for r in found["feed"]}
    own = cells.where(F.col("dim_a").isin(sorted({d for _, d in named})) & F.col("measure").isin(sorted({m for m, _ in named})))
    charts = {(r["measure"], r["dim"]): [b.asDict() for b in r["bars"]] for r in chart_rows(own, {m.name: m.agg for m in p.measures}, grain, period).collect()}
    cards = []
    for r in found["feed"]:
        rows = charts.get((r["measure"], r["dim"]), [])
        cards.append({"title": r["title"], "class": r["class"], "tier": r["tier"], "measure": r["measure"], "dimension": r["dim"], "grain": grain, "period": period, "chart": {"type": "bar", "rows": rows} if r["kind"] == "cross" else chart(rows), "value": r["val"], "change": r["pct_change"], "summary": r["why"], "corroboration": r["corroboration"], "evidence": r})
    return {"cards": cards, "audit": found["audit"], "tiers": found["tiers"], "grain": grain, "period": period}


def evidence_tier(evidence: dict | None) -> str:
    """What stands behind a number: tested and passed, tested and not passed, descriptive, or a plain lookup."""
    if not evidence:
        return "lookup"
    if evidence.get("p") is None:
        return "descriptive"
    q = evidence.get("q")
    passed = q <= discover.Settings().q_limit if q is not None else evidence["p"] <= 0.05
    return ("limited power" if evidence.get("low_power") else "tested") if passed else "not significant"


def explain(cells: DataFrame, p: Profile, intent: dict) -> dict:
    grain, period, measure, dim = _frame(cells, p, intent)
    before = _previous(cells, grain, period)
    card = {"analysis": "explain", "measure": measure, "dimension": dim, "grain": grain, "from": before, "to": period, "caveat": decompose.CAVEAT}
    if before is None:
        return card | {"parts": [], "summary": f"{period} is the first period: there is no change to explain."}
    parts = decompose.explain_change(cells, dim, measure, grain, before, period, p.agg_of(measure))
    if p.agg_of(measure) == "avg":
        s = decompose.mix_rate_summary(parts).first().asDict()
        turn = " The blend moves against the rates of its members." if s["paradox"] else ""
        return card | {"parts": [r.asDict() for r in parts.collect()], "total": s, "summary": f"{measure} changed by {s['change']:.4g}: rate {s['rate']:.4g}, mix {s['mix']:.4g}, interaction {s['interaction']:.4g}.{turn}"}
    rows = [r.asDict() for r in parts.orderBy("position").collect()]
    return card | {"parts": rows, "summary": f"{measure} changed by {sum(r['delta'] for r in rows):,.2f}; {rows[0]['label']} moved most, {rows[0]['delta']:,.2f}." if rows else "No member in either period."}


def drill_moves(cells: DataFrame, measure: str, grain: str) -> DataFrame:
    """(period, before, value, previous, move): the change of the total against the period before, as a share of it."""
    line = lookup.trend(cells, measure, grain, "sum", None)
    w = Window.orderBy("period")  # periods of the total, one row each
    d = line.withColumn("before", F.lag("period").over(w)).withColumn("previous", F.lag("value").over(w))
    return d.where("previous <> 0").select("period", "before", "value", "previous", ((F.col("value") - F.col("previous")) / F.abs("previous")).alias("move"))


def drill_dimensions(cells: DataFrame, dims: list[str], measure: str, grain: str, before: str, after: str) -> DataFrame:
    """(dim, label, delta, share, position, cells_to_part) of all dimensions' members between two periods, from one read of
    the cells: what each adds to the change, and how many carry 80 % of it."""
    own = cells.where((F.col("grain") == grain) & (F.col("measure") == measure) & F.col("dim_b").isNull() & F.col("dim_a").isin(dims) & F.col("period").isin(before, after))
    at = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col("sum"))), F.lit(0.0))
    return decompose.contribution(own.groupBy(F.col("dim_a").alias("dim"), F.col("val_a").alias("label")).agg(at(before).alias("before"), at(after).alias("after")), by=["dim"])


def drill_inside(cells: DataFrame, dim: str, member: str, measure: str, grain: str, before: str, after: str) -> DataFrame:
    """(dim_b, label_b, delta, n, share): how the change inside one member falls on the members of the other dimensions."""
    two = cells.where((F.col("grain") == grain) & (F.col("measure") == measure) & F.col("dim_b").isNotNull() & F.col("period").isin(before, after) & (((F.col("dim_a") == dim) & (F.col("val_a") == member)) | ((F.col("dim_b") == dim) & (F.col("val_b") == member))))
    first = F.col("dim_a") == dim
    two = two.select(F.when(first, F.col("dim_b")).otherwise(F.col("dim_a")).alias("dim_b"), F.when(first, F.col("val_b")).otherwise(F.col("val_a")).alias("label_b"), "period", "sum", "n")
    at = lambda p, c: F.coalesce(F.sum(F.when(F.col("period") == p, F.col(c))), F.lit(0))
    d = two.groupBy("dim_b", "label_b").agg((at(after, "sum") - at(before, "sum")).alias("delta"), at(after, "n").alias("n"))
    whole = Window.partitionBy("dim_b")
    d = d.withColumn("members", F.count(F.when(F.col("n") > 0, 1)).over(whole)).withColumn("moved", F.sum("delta").over(whole)).where("members >= 3 AND moved <> 0")
    return d.select("dim_b", "label_b", "delta", "n", F.abs(F.col("delta") / F.col("moved")).alias("share"))


def drill(cells: DataFrame, p: Profile, intent: dict) -> dict:
    """The largest move of the total, and the dimension whose fewest members carry 80 % of it."""
    grain, _, measure, _ = _frame(cells, p, intent)
    if p.agg_of(measure) == "avg":
        return {"analysis": "drill", "measure": measure, "grain": grain, "caveat": decompose.CAVEAT, "summary": f"{measure} is averaged; contributions do not add up. Ask to explain it for rate and mix."}
    moves = drill_moves(cells, measure, grain)
    moves = moves.where(F.col("period") == intent["period"]) if intent.get("period") else moves
    top = moves.orderBy(F.desc(F.abs("move")), "period").first()
    if top is None:
        return {"analysis": "drill", "measure": measure, "summary": "There is no earlier period to compare with."}
    period, before = top["period"], top["before"]
    card = {"analysis": "drill", "measure": measure, "grain": grain, "from": before, "to": period, "caveat": decompose.CAVEAT}
    parts = [r.asDict() for r in drill_dimensions(cells, p.dim_names(), measure, grain, before, period).orderBy("dim", "position").collect()]
    few = min(((r["cells_to_part"], r["dim"]) for r in parts if r["cells_to_part"]), default=None)
    if few is None:
        return card | {"summary": "The change is spread evenly over every dimension."}
    dim = few[1]
    rows = [r for r in parts if r["dim"] == dim]
    lead = rows[0]["label"]
    best = drill_inside(cells, dim, lead, measure, grain, before, period).withColumn("__place", F.row_number().over(Window.partitionBy("dim_b").orderBy(F.desc(F.abs("delta")), "label_b"))).where((F.col("__place") == 1) & (F.col("n") >= discover.Settings().min_rows)).orderBy(F.desc("share"), "dim_b").first()
    inside = best and {"dimension": best["dim_b"], "member": best["label_b"], "share": best["share"]}
    return card | {"dimension": dim, "member": lead, "parts": rows, "members_to_80": few[0], "inside": inside, "summary": f"{measure} moved most in {period}; {few[0]} member(s) of {dim} carry 80 % of it, first {lead}." + (f" Within it, {inside['dimension']} = {inside['member']}." if inside else "")}


def correlations(cells: DataFrame, dim: str, anchor: str, aggs: dict[str, str], grain: str, period: str) -> DataFrame:
    """(measure, n, r, t, p, low, high, rho, derived, leverage) of every other measure with the anchor over a dimension's
    members of enough rows, from one read of the cells."""
    own = cells.where((F.col("grain") == grain) & (F.col("period") == period) & (F.col("dim_a") == dim) & F.col("dim_b").isNull() & F.col("measure").isin(list(aggs)))
    averaged = [m for m, a in aggs.items() if a == "avg"]
    own = own.select("measure", F.col("val_a").alias("label"), "n", F.when(F.col("measure").isin(averaged), F.col("sum") / F.col("n")).otherwise(F.col("sum")).alias("v"))
    w = Window.partitionBy("label")
    at = lambda c: F.max(F.when(F.col("measure") == anchor, F.col(c))).over(w)
    pairs = own.withColumn("x", at("v")).withColumn("__n", at("n")).where((F.col("measure") != anchor) & (F.col("__n") >= discover.Settings().min_rows) & F.col("x").isNotNull())
    ranked = pairs.withColumn("a", tests.average_rank("x", ["measure"])).withColumn("b", tests.average_rank("v", ["measure"]))
    each = ranked.groupBy("measure").agg(F.count("*").alias("n"), F.corr("x", "v").alias("r"), F.corr("a", "b").alias("rho")).where((F.col("n") >= 3) & F.col("r").isNotNull() & ~F.isnan("r"))
    c = each.withColumn("c", tests.correlation(F.col("n"), F.col("r")))
    return c.select("measure", "n", "r", "c.t", "c.p", "c.low", "c.high", "rho", (F.abs("r") >= DERIVED).alias("derived"), (F.abs("r") - F.abs("rho") > LEVERAGE).alias("leverage"))


def correlate(cells: DataFrame, p: Profile, intent: dict) -> dict:
    """Which measures move with the one asked for, over the members of a dimension."""
    grain, period, anchor, dim = _frame(cells, p, intent)
    rows = correlations(cells, dim, anchor, {m.name: m.agg for m in p.measures}, grain, period)
    out = [r.asDict() for r in rows.orderBy(F.desc(F.abs("r")), "measure").collect()]
    return {"analysis": "correlate", "measure": anchor, "dimension": dim, "grain": grain, "period": period, "correlations": out, "summary": "; ".join(f"{c['measure']} r {c['r']:.2f}, {stats.format_p(c['p'])}" for c in out[:4]) or f"{anchor} cannot be correlated here."}


def predict(cells: DataFrame, p: Profile, intent: dict) -> dict:
    grain, _, measure, _ = _frame(cells, p, intent)
    line = lookup.trend(cells, measure, grain, p.agg_of(measure), None, intent.get("dimension") if intent.get("member") else None, intent.get("member"))
    x = [r["value"] for r in line.where("present").orderBy("period").collect()]
    card = {"analysis": "forecast", "measure": measure, "grain": grain, "periods": len(x)}
    if len(x) < forecast.LEAST_PERIODS:
        return card | {"forecast": [], "summary": f"{len(x)} periods are too few to forecast; {forecast.ADVISED_PERIODS} are advised."}
    ahead, test = forecast.forecast(forecast.fit(x), intent.get("horizon", 3)), forecast.backtest(x, max(6, len(x) // 2))
    worth = "" if test is None else f" Error against assuming no change: {test['naive_ratio']:.2f}."
    return card | {"forecast": ahead, "backtest": test, "summary": f"Next {grain}: {ahead[0]['value']:,.2f} ({ahead[0]['low']:,.2f} to {ahead[0]['high']:,.2f}).{worth}"}


ANALYSES = {"scan": scan, "deepdive": deepdive, "drill": drill, "correlate": correlate, "forecast": predict, "explain": explain}


def run(cells: DataFrame, p: Profile, intent: dict) -> dict:
    """The analysis an intent names, drill by default; or a lookup without a test."""
    if intent.get("analysis") or intent.get("shape") in (None, "analysis"):
        return ANALYSES[intent.get("analysis") or "drill"](cells, p, intent)
    grain, period, measure, dim = _frame(cells, p, intent)
    agg, shape = p.agg_of(measure), intent["shape"]
    if shape == "trend":
        rows = lookup.trend(cells, measure, grain, agg, 18)
    elif shape == "total":
        rows = lookup.total(cells, measure, grain, period, agg)
    elif shape == "topk":
        rows = lookup.top_k(cells, dim, measure, grain, period, intent.get("k", 5), agg, intent.get("ascending", False))
    else:
        rows = lookup.breakdown(cells, dim, measure, grain, period, agg)
    return {"analysis": None, "shape": shape, "measure": measure, "grain": grain, "period": period, "rows": [r.asDict() for r in rows.collect()], "summary": "A lookup; no test was applied."}
