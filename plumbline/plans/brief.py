"""A brief of a data set: what its columns are, what to beware of, what can and cannot be asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.discover import Settings
from plumbline.operators.forecast import ADVISED_PERIODS, LEAST_PERIODS
from plumbline.operators.profile import Profile
from plumbline.plans.ledger import digest


SEVERITY = {"high": 0, "medium": 1, "low": 2}
#: What each condition says; {s} is its subject and {n} its number.
SAYS = {
    "rejected-time-axis": "{s} is another time axis: {why}",
    "unparsed-dates": "{n:,} rows have a {s} that does not parse and are in no total",
    "no-sum": "{s} is averaged ({why}); its sum means nothing, and its change needs rate and mix apart",
    "truncated": "the file was cut at {n:,} rows: totals are those of the rows read",
    "small-dimension": "{s} has {n} members: too few for a test of siblings; persistence over periods still works",
    "excluded-dimension": "{s} has {n} members and is left out of the cells",
    "skipped-pairs": "{n} pairs of dimensions have no two-way cells: no answer there is not the same as no finding",
    "short-history": "{n} {s} periods: forecasts start at {least} and are advised from {advised}",
    "dual-role": "{s} is both a measure and a dimension",
    "nulls": "{n} values of {s} are empty",
    "thin": "{n} members of {s} have too few rows in the period and are shown, but not tested",
    "spread": "{s} is widely spread",
}


def conditions(p: Profile, cells: DataFrame, grain: str = "month", period: str | None = None, unparsed: int = 0, pairs_skipped: int = 0, truncated_at: int | None = None, min_rows: int = 30) -> DataFrame:
    """(severity, id, subject, n): what misleads, one row a condition and subject.

    What the profile knows is a few rows; thin members and the length of history are aggregates over the cells.  `unparsed`
    comes from dropped_rows, `pairs_skipped` from the choice of pairs, `truncated_at` from the loader.
    """
    known: list[tuple] = [("high", "rejected-time-axis", t, None) for t, _ in p.time_alternatives]
    known += [("high", "unparsed-dates", p.time, unparsed)] if unparsed else []
    known += [("high", "no-sum", m.name, None) for m in p.measures if m.agg == "avg"]
    known += [("high", "truncated", None, truncated_at)] if truncated_at else []
    known += [("medium", "small-dimension", d, k) for d, k in p.dims if k < Settings().min_members]
    known += [("medium", "excluded-dimension", d, k) for d, k in p.excluded_dims]
    known += [("medium", "skipped-pairs", None, pairs_skipped)] if pairs_skipped else []
    known += [("medium", "dual-role", m.name, None) for m in p.measures if m.dual_role]
    known += [("medium", "nulls", c, round(share * p.rows)) for c, share in p.null_share.items() if share > 0.05]
    known += [("low", "spread", m.name, None) for m in p.measures if m.dispersion is not None and m.mean > 0 and m.dispersion > 3 * m.mean]
    schema = "severity string, id string, subject string, n long"
    out = cells.sparkSession.createDataFrame(known, schema)
    own = cells.where(F.col("grain") == grain)
    short = own.agg(F.count_distinct("period").alias("n")).where(F.col("n") < ADVISED_PERIODS).select(F.lit("medium").alias("severity"), F.lit("short-history").alias("id"), F.lit(grain).alias("subject"), "n")
    out = out.unionByName(short)
    if p.measures:
        period = period or own.agg(F.max("period").alias("p")).first()["p"]
        members = own.where((F.col("period") == period) & (F.col("measure") == p.measures[0].name) & F.col("dim_a").isNotNull() & F.col("dim_b").isNull())
        thin = members.groupBy(F.col("dim_a").alias("subject")).agg(F.count(F.when(F.col("n") < min_rows, 1)).alias("n"), F.count("*").alias("all")).where("n > 0 AND n < all")
        out = out.unionByName(thin.select(F.lit("low").alias("severity"), F.lit("thin").alias("id"), "subject", "n"))
    return out


def gotchas(p: Profile, cells: DataFrame, **options) -> list[dict]:
    """The conditions in words, the most severe first."""
    why = dict(p.time_alternatives) | {m.name: m.reason for m in p.measures}
    rows = sorted(conditions(p, cells, **options).collect(), key=lambda r: (SEVERITY[r["severity"]], r["id"], r["subject"] or ""))
    return [{"severity": r["severity"], "id": r["id"], "text": SAYS[r["id"]].format(s=r["subject"], n=r["n"], why=why.get(r["subject"], ""), least=LEAST_PERIODS, advised=ADVISED_PERIODS)} for r in rows]


def build_brief(p: Profile, cells: DataFrame, fingerprint: dict | None = None) -> dict:
    body = {
        "rows": p.rows, "time": p.time, "dimensions": [{"name": d, "members": k} for d, k in p.dims], "measures": [{"name": m.name, "agg": m.agg, "why": m.reason, "mean": m.mean, "sd": m.sd, "p50": m.p50} for m in p.measures],
        "gotchas": gotchas(p, cells), "works": ["breakdowns and trends", "findings under correction for the search", "contributions of sums; rate and mix of averages"],
        "limits": ["no causes: decompositions say where, not why", "no prediction beyond the linear trend", "no claim from fewer than 30 rows"], "fingerprint": fingerprint,
    }
    return body | {"hash": digest(body)}


def to_markdown(b: dict) -> str:
    lines = ["# Data brief", "", f"{b['rows']:,} rows on `{b['time']}`; brief `{b['hash'][:12]}`.", "", "## Measures", *(f"- `{m['name']}`: {m['agg']}, {m['why']}" for m in b["measures"]), "", "## Dimensions", *(f"- `{d['name']}`: {d['members']} members" for d in b["dimensions"])]
    return "\n".join([*lines, "", "## Beware", *(f"- {g['severity']}: {g['text']}" for g in b["gotchas"]), "", "## Works", *(f"- {w}" for w in b["works"]), "", "## Does not", *(f"- {w}" for w in b["limits"])])


def passages(b: dict) -> list[dict]:
    """A brief as passages to cite: (id, kind, text, subjects), subjects being the columns that a passage speaks of."""
    columns = [x["name"] for x in b["measures"] + b["dimensions"]]
    out = [{"id": f"gotcha:{i}", "kind": "gotcha", "text": g["text"]} for i, g in enumerate(b["gotchas"])]
    out += [{"id": f"measure:{m['name']}", "kind": "measure", "text": f"{m['name']}: {m['agg']}, {m['why']}"} for m in b["measures"]]
    out += [{"id": f"dimension:{d['name']}", "kind": "dimension", "text": f"{d['name']}: {d['members']} members"} for d in b["dimensions"]]
    out += [{"id": f"limit:{i}", "kind": "limit", "text": t} for i, t in enumerate(b["limits"])]
    return [x | {"subjects": [c for c in columns if c in x["text"]]} for x in out]
