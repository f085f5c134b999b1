"""Column roles from one wide aggregate: time axis, dimensions, measures, identifiers, text."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.timeaxis import BEGINNING, day_of

# Thresholds and name patterns of the role rules.
CARDINALITY_CUTOFF, ID_RATIO, NUMERIC_UNIQUE, TEXT_LENGTH = 50, 0.85, 12, 60
DATE_SHARE, NUMBER_SHARE = 0.8, 0.95
ID_NAMES = frozenset({"id", "uuid", "guid", "key", "code", "ref", "sku", "hash"})
RATE_NAME = re.compile(r"(^|[_\s])(pct|percent|rate|ratio|margin|rating|score|avg|average|mean|index|nps|csat|share)([_\s]|$)|%", re.I)
DURATION_NAME = re.compile(r"(^|[_\s])(duration|latency|elapsed|lead_?time|cycle_?time|days|hours|minutes|seconds)([_\s]|$)", re.I)
COUNT_NAME = re.compile(r"(^|[_\s])(count|qty|quantity|units|orders|sessions|clicks|visits|items|n)([_\s]|$)", re.I)
#: What counts as a number in a string: finite, plain or with an exponent.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@dataclass(frozen=True)
class Measure:
    name: str
    agg: str
    reason: str
    mean: float
    sd: float
    low: float
    high: float
    p05: float
    p50: float
    p95: float
    count_like: bool
    non_null: int
    dispersion: float | None = None
    dual_role: bool = False
    #: Whether p05, p50 and p95 are exact (type 7) or from a sketch.
    exact: bool = False
    #: What the sketch says that the percentiles lie between.
    brackets: tuple[tuple[float, float], ...] = field(default=(), compare=False, repr=False)


@dataclass(frozen=True)
class Profile:
    rows: int
    time: str | None
    time_alternatives: list[tuple[str, str]] = field(default_factory=list)
    dims: list[tuple[str, int]] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=list)
    excluded_dims: list[tuple[str, int]] = field(default_factory=list)
    ids: list[tuple[str, str]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    null_share: dict[str, float] = field(default_factory=dict)

    def agg_of(self, measure: str) -> str:
        return next((m.agg for m in self.measures if m.name == measure), "sum")

    def dim_names(self) -> list[str]:
        return [d for d, _ in self.dims]

    def measure_names(self) -> list[str]:
        return [m.name for m in self.measures]


def name_is_id(name: str) -> bool:
    return any(t in ID_NAMES for t in re.split(r"[_\s-]+", name.lower()))


def classify_aggregation(name: str, low: float | None, high: float | None, whole: bool) -> tuple[str, str]:
    """(sum or avg, why), by name and range."""
    if low is None or high is None:
        return "sum", "no values"
    unit, percent = low >= -1.0001 and high <= 1.0001, low >= -100.01 and high <= 100.01
    if RATE_NAME.search(name) and (unit or percent or not whole):
        return "avg", f"a rate by name, values in [{low:g}, {high:g}]"
    if DURATION_NAME.search(name):
        return "avg", "durations are averaged"
    if COUNT_NAME.search(name):
        return "sum", "a count by name"
    if unit and not whole:
        return "avg", "fractions in [0, 1] look like a proportion"
    return "sum", "additive unless told otherwise"


#: Types whose values are numbers, or are not, without a look at their text; a float has the digits of its text.
NUMBER_TYPES, OTHER_TYPES = ("tinyint", "smallint", "int", "bigint", "double", "decimal"), ("boolean", "date", "timestamp")


def numeric(column: Column, kind: str = "string") -> Column:
    """Finite number of a cell of Spark type `kind`, else null."""
    if kind.startswith(NUMBER_TYPES):
        x = column.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    s = column.cast("string")
    x = s.try_cast("double")
    return F.when(s.rlike(NUMBER) & (F.abs(x) < float("inf")), x)


#: Relative error of the first count of distinct values, of the percentile sketch, and the values that an exact quantile sorts at once.
DISTINCT_ERROR, SKETCH, SORTED = 0.02, 10_000, 100_000


#: The shares of a profile's percentiles.
PERCENTILES = (0.05, 0.5, 0.95)


def _edges(shares: Iterable[float]) -> list[float]:
    """Below and above each share by twice the error of a sketch; the values there bracket it."""
    return [float(e) for p in shares for e in (max(0.0, p - 2 / SKETCH), min(1.0, p + 2 / SKETCH))]


def _brackets(at: list[float] | None) -> list[tuple[float, float]]:
    return sorted(set(zip(at[::2], at[1::2], strict=True))) if at else []


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """Exact type-7 quantiles of one column, as quantiles_of() finds them."""
    return quantiles_of(df, [column], shares)[0]


def quantiles_of(df: DataFrame, columns: Sequence[str], shares: tuple[float, ...], brackets: dict[str, Sequence[tuple[float, float]]] | None = None) -> list[list[float | None]]:
    """Exact type-7 quantiles of columns side by side, without sorting or holding a column: a sketch brackets the two rows that
    each needs, one more pass counts what lies below and inside, and one groups what lies inside.  A bracket that is still
    wide is narrowed again.  Each pass serves all columns.

    `brackets` of a column, from a sketch that is there already, save the first pass; they decide nothing of what comes
    out, as rows outside of them are looked for anew.  Null and NaN take no part; nothing left: nulls.
    """
    x = [F.col(f"x_{i}") for i in range(len(columns))]
    rows = df.select(*[F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"x_{i}") for i, c in enumerate(columns)])
    inside, whole = lambda i, a, b: (x[i] >= a) & (x[i] <= b), (float("-inf"), float("inf"))

    def within(asked: list[tuple]) -> Column:
        """Whether a row lies in any of the brackets."""
        return reduce(lambda p, q: p | q, [inside(i, a, b) for i, a, b, *_ in asked])

    def sketched(asked: list[tuple[int, float, float, list[float]]]) -> list[list[tuple[float, float]]]:
        """Brackets, in values, of shares of what lies in each (column, low, high)."""
        if not asked:
            return []
        at = rows.where(within(asked)).agg(*[F.percentile_approx(F.when(inside(i, a, b), x[i]), _edges(e), SKETCH) for i, a, b, e in asked])
        return [_brackets(found) for found in at.first()]

    def counted(asked: list[tuple[int, float, float]]) -> list[tuple[int, int]]:
        """Rows below and rows inside of each (column, low, high)."""
        c = rows.agg(*[F.count(F.when(k, 1)) for i, a, b in asked for k in (x[i] < a, inside(i, a, b))]).first() if asked else []
        return list(zip(c[::2], c[1::2], strict=True))

    known = {i: list(brackets[c]) for i, c in enumerate(columns) if brackets and brackets.get(c)}
    unknown = [i for i in range(len(columns)) if i not in known]
    known |= dict(zip(unknown, sketched([(i, *whole, list(shares)) for i in unknown]), strict=True))
    asked = [(i, a, b) for i in range(len(columns)) for a, b in (whole, *known[i])]
    sizes = dict(zip(asked, counted(asked), strict=True))
    n = [sizes[(i, *whole)][1] for i in range(len(columns))]
    ranks = [sorted({r for p in shares for r in (int(p * (k - 1)), min(k - 1, int(p * (k - 1)) + 1))}) if k else [] for k in n]
    found: list[dict[int, float]] = [{} for _ in columns]
    # (column, low, high, rows below low, rows inside, ranks wanted) with brackets inside; those to be grouped by value
    open_, first = [((i, *whole, 0, n[i], ranks[i]), known[i]) for i in range(len(columns))], True
    grouped: list[tuple[int, float, float, int, list[int]]] = []
    while open_:
        narrowed = []
        for (i, low, high, start, count, wanted), parts in open_:
            rest = set(wanted)
            for a, b in parts:
                below, size = sizes[(i, a, b)]
                here = sorted(r for r in rest if below <= r < below + size)
                rest -= set(here)
                if here and a == b:
                    found[i] |= dict.fromkeys(here, a)
                elif here and size > SORTED and (a, b) != (low, high):
                    narrowed.append((i, a, b, below, size, here))
                elif here:  # at most SORTED rows, or few values that no sketch can split
                    grouped.append((i, a, b, below, here))
            if rest and first and count > SORTED:  # the brackets did not hold
                narrowed.append((i, low, high, start, count, sorted(rest)))
            elif rest:
                grouped.append((i, low, high, start, sorted(rest)))
        parts = sketched([(i, a, b, [(w - start) / count for w in wanted]) for i, a, b, start, count, wanted in narrowed])
        asked = sorted({(w[0], a, b) for w, inner in zip(narrowed, parts, strict=True) for a, b in inner})
        sizes = dict(zip(asked, counted(asked), strict=True))
        open_, first = list(zip(narrowed, parts, strict=True)), False
    if grouped:
        cells = F.array(*[F.when(inside(i, a, b), F.struct(F.lit(g).alias("g"), x[i].alias("x"))) for g, (i, a, b, *_) in enumerate(grouped)])
        values = rows.where(within(grouped)).select(F.explode_outer(cells).alias("c")).where("c IS NOT NULL").select("c.*").groupBy("g", "x").count()
        at = [start for _, _, _, start, _ in grouped]
        for r in values.orderBy("g", "x").toLocalIterator():
            i, wanted = grouped[r["g"]][0], grouped[r["g"]][-1]
            found[i] |= {w: r["x"] for w in wanted if at[r["g"]] <= w < at[r["g"]] + r["count"]}
            at[r["g"]] += r["count"]
            if r["g"] == len(grouped) - 1 and at[-1] > wanted[-1]:
                break

    def quantile(i: int, p: float) -> float | None:
        if not n[i]:
            return None
        k = int(p * (n[i] - 1))
        low, high = found[i][k], found[i][min(n[i] - 1, k + 1)]
        return low + (p * (n[i] - 1) - k) * (high - low)

    return [[quantile(i, p) for p in shares] for i in range(len(columns))]


def dispersion(mean: float | None, sd: float | None, low: float | None) -> float | None:
    """(variance + mean squared) / mean of values that are never negative."""
    return (sd**2 + mean**2) / mean if low is not None and sd is not None and low >= 0 and mean > 0 else None


def _dates(d: Column) -> dict[str, Column]:
    return {"dates": F.count(d), "months": F.approx_count_distinct(F.year(d) * 12 + F.month(d), DISTINCT_ERROR), "first": F.min(d), "last": F.max(d)}


def column_statistics(df: DataFrame, settled: Collection[str] = ()) -> list[dict]:
    """One dict a column, from at most four passes over the rows, whatever the number of columns.

    The first holds sketches only.  Text is read for dates in a pass of its own, and only in columns where DATE_SHARE of the
    values begin like a date; of others no dates are counted.  `unique` is exact where a role can hang on it: columns near the cardinality cutoff are
    counted by their `values`, which come with it, those near one value a row by a shuffle of all of them; others are within
    DISTINCT_ERROR; `settled` columns, whose role needs no count, have none.  Percentiles come from a sketch of SKETCH points; quantiles() is exact.  What cannot be in a type is not
    looked for: no date in a number, no number in a date, and a length only in text.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    usable = [c for c in df.columns if not kinds[c].startswith(("array", "map", "struct", "binary"))]
    text = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
    read, aggs = [], [F.count("*").alias("rows")]
    for i, c in enumerate(usable):
        own, typed = F.col(f"`{c}`"), kinds[c].startswith(NUMBER_TYPES + OTHER_TYPES)
        s, x = F.col(f"s_{i}"), F.col(f"x_{i}")
        read.append((own if typed else text(c)).alias(f"s_{i}"))
        found = {"non_null": F.count(s)} | ({} if c in settled else {"unique": F.approx_count_distinct(s, DISTINCT_ERROR)})
        if not typed:
            found |= {"length": F.avg(F.length(s)), "likely": F.count(F.when(s.rlike(BEGINNING), 1))}
        if not kinds[c].startswith(OTHER_TYPES):
            read.append(numeric(own, kinds[c]).alias(f"x_{i}"))
            found |= {"numbers": F.count(x), "whole": F.bool_and(x == F.floor(x)), "positive": F.bool_and(x >= 0), "mean": F.avg(x), "sd": F.stddev_samp(x), "low": F.min(x), "high": F.max(x), "q": F.percentile_approx(x, [*PERCENTILES, *_edges(PERCENTILES)], SKETCH)}
        if kinds[c].startswith(("date", "timestamp")):
            read.append(day_of(own, kinds[c]).alias(f"d_{i}"))
            found |= _dates(F.col(f"d_{i}"))
        aggs += [a.alias(f"{k}_{i}") for k, a in found.items()]
    # each value is read once, beside the aggregates
    row = df.select(*read).agg(*aggs).first().asDict()
    dated = [i for i in range(len(usable)) if row.get(f"likely_{i}") and row[f"likely_{i}"] >= DATE_SHARE * row[f"non_null_{i}"]]
    if dated:
        days = df.select(*[day_of(F.col(f"`{usable[i]}`"), "string").alias(f"d_{i}") for i in dated])
        row |= days.agg(*[a.alias(f"{k}_{i}") for i in dated for k, a in _dates(F.col(f"d_{i}")).items()]).first().asDict()
    names = ("non_null", "unique", "length", "numbers", "whole", "positive", "mean", "sd", "low", "high", "q", "dates", "months", "first", "last")
    none = {"length": 0.0, "numbers": 0, "dates": 0, "months": 0}
    out = [{"name": c, "rows": row["rows"], **{k: row.get(f"{k}_{i}", none.get(k)) for k in names}, "values": None} for i, c in enumerate(usable)]
    for s in out:
        s["brackets"] = tuple(_brackets(s["q"] and s["q"][len(PERCENTILES) :]))
        s["q"] = s["q"] and s["q"][: len(PERCENTILES)]
    few = [s for s in out if s["name"] not in settled and s["unique"] <= 2 * CARDINALITY_CUTOFF]
    many = [s for s in out if s["name"] not in settled and s not in few and s["unique"] >= (ID_RATIO - 0.2) * s["rows"]]
    if few:
        for s, values in zip(few, members_of(df, [s["name"] for s in few]), strict=True):
            s["values"], s["unique"] = values, len(values)
    if many:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(s["name"]).alias("v")) for i, s in enumerate(many)]))
        counted = df.select(cells.alias("c")).select("c.*").where("v IS NOT NULL").distinct().groupBy("i").count().collect()  # one row a column
        for r in counted:
            many[r["i"]]["unique"] = r["count"]
    return out


def members_of(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """The sorted different values of columns of few values, in one pass."""
    row = df.agg(*[F.sort_array(F.collect_set(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")))).alias(f"v_{i}") for i, c in enumerate(columns)]).first()
    return list(row)


def time_score(s: dict) -> float | None:
    """Coverage first, then months and span; None if too few values are dates."""
    if not s["non_null"] or s["dates"] / s["non_null"] < DATE_SHARE:
        return None
    span = (s["last"] - s["first"]).days
    return s["dates"] / s["rows"] * 1000 + min(s["months"], 60) + min(span / 365, 10)


def _measure(s: dict, dual: bool) -> Measure:
    agg, reason = classify_aggregation(s["name"], s["low"], s["high"], bool(s["whole"]))
    return Measure(s["name"], agg, reason, s["mean"], s["sd"], s["low"], s["high"], *s["q"], bool(s["whole"] and s["positive"]), s["numbers"], dispersion(s["mean"], s["sd"], s["low"]), dual, brackets=s["brackets"])


def profile(df: DataFrame, roles: dict[str, str] | None = None) -> Profile:
    """Infer roles; `roles` fixes columns to time, dimension, measure or ignore."""
    roles = roles or {}
    stats = [s for s in column_statistics(df, [c for c, r in roles.items() if r in ("measure", "ignore")]) if roles.get(s["name"]) != "ignore"]
    times = sorted(((-score, s["name"]) for s in stats if roles.get(s["name"], "time") == "time" and (score := time_score(s)) is not None))
    fixed = next((c for c, r in roles.items() if r == "time"), None)
    time = fixed or (times[0][1] if times else None)
    dims, measures, excluded, ids, texts = [], [], [], [], []
    for s in stats:
        name, n, unique, role = s["name"], s["non_null"], s["unique"], roles.get(s["name"])
        if name == time or any(name == t for _, t in times):
            continue
        number = n and s["numbers"] / n > NUMBER_SHARE
        varies = bool(s["sd"] and s["sd"] > 0)
        if role == "dimension":
            dims.append((name, unique))
        elif role == "measure":
            measures.append(_measure(s, False))
        elif not n:
            texts.append(name)  # nothing to learn from an empty column
        elif name_is_id(name) and (unique > CARDINALITY_CUTOFF or unique / s["rows"] >= ID_RATIO):
            ids.append((name, "identifier by name"))
        elif number and unique <= NUMERIC_UNIQUE:
            dims.append((name, unique))
            if unique >= 3 and varies and not name_is_id(name):
                measures.append(_measure(s, True))
        elif number:
            measures.append(_measure(s, False)) if varies else ids.append((name, "constant"))
        elif unique == 2:
            dims.append((name, unique))
        elif s["length"] > TEXT_LENGTH:
            texts.append(name)
        elif unique > CARDINALITY_CUTOFF and unique / s["rows"] >= ID_RATIO:
            ids.append((name, "nearly unique"))
        elif unique <= CARDINALITY_CUTOFF:
            dims.append((name, unique))
        else:
            excluded.append((name, unique))
    dims.sort()
    # at most CARDINALITY_CUTOFF members each, unless a caller fixed the role
    members = {d: next(s["values"] for s in stats if s["name"] == d) for d, _ in dims}
    unread = [d for d, _ in dims if members[d] is None]
    if unread:
        members |= dict(zip(unread, members_of(df, unread), strict=True))
    nulls = {s["name"]: 1 - s["non_null"] / s["rows"] if s["rows"] else 0.0 for s in stats}
    return Profile(stats[0]["rows"] if stats else 0, time, [(t, "lower score than the chosen time axis") for _, t in times if t != time], dims, sorted(measures, key=lambda m: m.name), sorted(excluded), ids, texts, members, nulls)


def with_time(p: Profile, column: str) -> Profile:
    """The same profile on another time axis; its cells must be built anew."""
    others = [(t, why) for t, why in p.time_alternatives if t != column] + ([(p.time, "replaced by the user")] if p.time else [])
    return replace(p, time=column, time_alternatives=others)


def with_aggregation(p: Profile, measure: str, agg: str) -> Profile:
    """The same profile with a measure summed or averaged; cells stay as they are."""
    if agg not in ("sum", "avg"):
        raise ValueError(f"agg is sum or avg, not {agg!r}")
    return replace(p, measures=[replace(m, agg=agg, reason="chosen by the user") if m.name == measure else m for m in p.measures])


def with_exact_percentiles(p: Profile, df: DataFrame) -> Profile:
    """The same profile with exact type-7 percentiles of its measures, in place of those of the sketch.

    The rows are read twice for all measures, as the profile's sketch brackets what is looked for, and twice more where a bracket
    is wide; keep them before if they are dear to make.  Text that is no finite number takes no part, as in the profile.
    """
    if not p.measures:
        return p
    numbers = df.select(*[numeric(F.col(f"`{m.name}`"), df.schema[m.name].dataType.simpleString()).alias(m.name) for m in p.measures])
    found = quantiles_of(numbers, [m.name for m in p.measures], PERCENTILES, {m.name: m.brackets for m in p.measures})
    return replace(p, measures=[replace(m, p05=a, p50=b, p95=c, exact=True) for m, (a, b, c) in zip(p.measures, found, strict=True)])
