"""The cell table: mergeable aggregates by period, members and measure.

cells(grain, period, dim_a, val_a, dim_b, val_b, measure, n, sum, sum_sq, min, max)

Cells form a lattice: a set of cells can be added up from any set that holds its dimensions at a finer or equal grain.  Only
a few sets, the roots, are computed from the rows, in one scan with map-side partial aggregation; all others are added up
from their root, and coarser grains from the finest.  Which sets become roots is planned from the sizes of the dimensions and
their pairs (see plan_roots).  dim_a is null for totals, dim_b for one-way cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.timeaxis import GRAINS, day_of, period

KEYS = ("grain", "period", "dim_a", "val_a", "dim_b", "val_b", "measure")
PAIR_CELLS, TOTAL_CELLS, PAIR_PERIODS = 400, 2_500_000, 36
BYTES_PER_CELL = 120
PARTS = ("n", "sum", "sum_sq", "min", "max")
#: Rows that a task is taken to aggregate before the shuffle, and the price of a shuffled cell in rows read: a root pays for
#: its cells once a task, so sets are merged only while their cells stay few beside the rows of a task.
TASK_ROWS, SHUFFLED = 400_000, 20


def select_pairs(cardinality: dict[str, int], pair_cells: int = PAIR_CELLS, total_cells: int = TOTAL_CELLS) -> list[tuple[str, str]]:
    """Dimension pairs for two-way cells, cheapest first, within the cells of a pair and of all pairs over PAIR_PERIODS."""
    priced = sorted((cardinality[a] * cardinality[b], a, b) for a, b in combinations(sorted(cardinality), 2))
    chosen, spent = [], 0
    for cost, a, b in priced:
        if cost <= pair_cells and spent + cost * PAIR_PERIODS <= total_cells:
            chosen.append((a, b))
            spent += cost * PAIR_PERIODS
    return chosen


@dataclass
class Sizes:
    """How many rows there are, and about how many different periods, members and pairs of members."""

    rows: int
    periods: dict[str, int]
    members: dict[frozenset, int]
    _bounds: dict[frozenset, int] = field(default_factory=dict, repr=False)

    def combinations(self, dims: frozenset) -> int:
        """At most so many different combinations of members: the least product over known parts."""
        if not dims:
            return 1
        if dims not in self._bounds:
            known = self.members.get(dims)
            parts = [(frozenset(p), dims.difference(p)) for k in (1, 2) for p in combinations(sorted(dims), k) if len(dims) > k]
            bound = min([self.members[p] * self.combinations(rest) for p, rest in parts if p in self.members], default=self.rows)
            self._bounds[dims] = min(known, bound) if known is not None else bound
        return self._bounds[dims]

    def tasks(self) -> int:
        return max(1, -(-self.rows // TASK_ROWS))

    def cells(self, grain: str, dims: frozenset) -> int:
        return min(self.rows, self.periods[grain] * self.combinations(dims))


@dataclass(frozen=True)
class Root:
    """A set of cells computed from the rows, the sets that are added up from it, and about how many cells it has."""

    grain: str
    dims: frozenset
    serves: tuple[frozenset, ...]
    cells: int

    def shuffled(self, rows: int, tasks: int) -> int:
        """Cells that further tasks than one send on after adding up their own rows."""
        return min(rows, (tasks - 1) * self.cells)

    def cost(self, rows: int, tasks: int = 1) -> int:
        """Rows read to compute it and what it serves, and what its tasks shuffle; a root that serves but itself is added up no further."""
        return rows + SHUFFLED * self.shuffled(rows, tasks) + (0 if self.serves == (self.dims,) else self.cells * len(self.serves))


def plan_roots(sizes: Sizes, wanted: Iterable[tuple[str, frozenset]], tasks: int = 1) -> list[Root]:
    """Roots for the wanted (grain, dimensions), by smallest parents: every set starts as its own root, and the two roots whose
    union saves most over so many tasks (see Root.cost) are merged, until nothing is saved.  Ties go by name."""
    roots = [Root(g, d, (d,), sizes.cells(g, d)) for g, d in sorted(set(wanted), key=lambda w: (w[0], sorted(w[1])))]
    while True:
        best = None
        for a, b in combinations(roots, 2):
            if a.grain != b.grain:
                continue
            both = Root(a.grain, a.dims | b.dims, a.serves + b.serves, sizes.cells(a.grain, a.dims | b.dims))
            saved = a.cost(sizes.rows, tasks) + b.cost(sizes.rows, tasks) - both.cost(sizes.rows, tasks)
            if saved > 0 and (best is None or saved > best[0]):
                best = (saved, a, b, both)
        if best is None:
            return roots
        roots = [r for r in roots if r is not best[1] and r is not best[2]] + [best[3]]


def _start(grain: str) -> Column:
    """The first day of a period stands for it."""
    return F.col("day") if grain == "day" else F.trunc("day", grain)


def _typed(rows: DataFrame, time: str, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """day, d_i, m_i of the rows that have a date and a number."""
    kind = rows.schema[time].dataType.simpleString()
    number = lambda c: F.when(~F.isnan(x := F.col(c).try_cast("double")) & (F.abs(x) < float("inf")), x)
    base = rows.select(day_of(F.col(time), kind).alias("day"), *[F.col(d).cast("string").alias(f"d_{i}") for i, d in enumerate(dims)], *[number(m).alias(f"m_{i}") for i, m in enumerate(measures)])
    return base.where(F.col("day").isNotNull() & F.coalesce(*[F.col(f"m_{i}") for i in range(len(measures))]).isNotNull())


def _finest(pair_grains: Sequence[str]) -> list[str]:
    """The grains at which pairs are computed: quarters and years come from months, years from quarters, all from days."""
    made: list[str] = []
    for g in sorted(set(pair_grains), key=GRAINS.index):
        if "day" in made or (g in ("quarter", "year") and "month" in made) or (g == "year" and "quarter" in made):
            continue
        made.append(g)
    return made


def measure_sizes(rows: DataFrame, time: str, dims: Sequence[str], measures: Sequence[str], pair_grains: Sequence[str] = ("month",), share: float = 0.1) -> Sizes:
    """Sizes for the plan, from sketches over a share of the rows; they decide what is computed from what, and never what
    comes out.  What nearly every fourth row of the share holds anew is taken to grow with the rows."""
    base = _typed(rows, time, dims, measures)
    base = base.sample(fraction=share, seed=1) if share < 1 else base
    grains = ["day", *[g for g in _finest(pair_grains) if g != "day"]]
    sets = [(d,) for d in dims] + list(combinations(dims, 2))
    place = {d: f"d_{i}" for i, d in enumerate(dims)}
    found = base.agg(
        F.count("*").alias("rows"), *[F.approx_count_distinct(_start(g)).alias(f"t_{g}") for g in grains],
        *[F.approx_count_distinct(F.xxhash64(*[place[d] for d in s]) if len(s) > 1 else place[s[0]]).alias(f"s_{i}") for i, s in enumerate(sets)],
    ).first()
    all_of = lambda k: int(k / share) if k > found["rows"] / 4 else k
    return Sizes(int(found["rows"] / share), {g: found[f"t_{g}"] for g in grains}, {frozenset(s): all_of(found[f"s_{i}"]) for i, s in enumerate(sets)})


def wanted_sets(dims: Sequence[str], pairs: Sequence[tuple[str, str]], pair_grains: Sequence[str]) -> list[tuple[str, frozenset]]:
    """Totals and one-way cells by day, pairs at their finest grains."""
    one = [("day", frozenset())] + [("day", frozenset([d])) for d in dims]
    return one + [(g, frozenset(p)) for g in _finest(pair_grains) for p in pairs]


def build_cells(rows: DataFrame, time: str, dims: Sequence[str], measures: Sequence[str], pairs: Sequence[tuple[str, str]] = (), pair_grains: Sequence[str] = ("month",), grains: Sequence[str] = GRAINS, sizes: Sizes | None = None) -> DataFrame:
    """Cells of all grains, from one scan of the rows (and one before it for `sizes`, if several sets are asked for and none are given).

    Rows whose date does not parse or that hold no measure are left out; a null member is left out of its dimension but
    counts in totals.  Text measures are cast where they are finite numbers.
    """
    dims, wanted = list(dims), wanted_sets(dims, pairs, pair_grains)
    if len(wanted) > 2 and sizes is None:
        sizes = measure_sizes(rows, time, dims, measures, pair_grains)
    roots = plan_roots(sizes, wanted, sizes.tasks()) if sizes else [Root("day", frozenset(dims), tuple(d for _, d in wanted), 0)]
    base = _typed(rows, time, dims, measures)
    made = _finest(pair_grains) if pairs else []
    for g in made:
        base = base.withColumn(f"p_{g}", _start(g))
    where = {d: i for i, d in enumerate(dims)}
    # a root by day and one by month differ by the column of their period
    column = lambda r: "day" if r.grain == "day" else f"p_{r.grain}"
    sets = [[column(r), *[f"d_{where[d]}" for d in sorted(r.dims)]] for r in roots]
    keys = list(dict.fromkeys(["day", *[f"p_{g}" for g in made], *[f"d_{i}" for i in range(len(dims))]]))
    aggs = []
    for i in range(len(measures)):
        m = F.col(f"m_{i}")
        aggs += [x.alias(f"{k}_{i}") for k, x in zip(PARTS, (F.count(m), F.sum(m), F.sum(m * m), F.min(m), F.max(m)), strict=True)]
    totals = {"n": F.sum, "sum": F.sum, "sum_sq": F.sum, "min": F.min, "max": F.max}
    merged = lambda: [totals[k](f"{k}_{i}").alias(f"{k}_{i}") for i in range(len(measures)) for k in PARTS]
    values = [f"{k}_{i}" for i in range(len(measures)) for k in PARTS]
    at = F.grouping_id(*keys).alias("root")
    grouped = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(*aggs, at)

    def served(root: Root, own: list[str]) -> Column:
        """The cells that a row of this root adds to."""
        out = []
        for s in root.serves:
            (a, va), (b, vb) = [(F.lit(d), F.col(f"d_{where[d]}")) for d in sorted(s)] + [(F.lit(None).cast("string"),) * 2] * (2 - len(s))
            cell = F.struct(F.lit(root.grain).alias("from"), F.col(column(root)).alias("start"), a.alias("dim_a"), va.alias("val_a"), b.alias("dim_b"), vb.alias("val_b"))
            out.append(F.when(F.lit(True) if not s else va.isNotNull() & (vb.isNotNull() if len(s) > 1 else F.lit(True)), cell))
        return F.filter(F.array(*out), lambda c: c.isNotNull())

    # grouping_id: one bit a key, set where the key is not grouped by
    chosen = None
    for r, s in zip(roots, sets, strict=True):
        code = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        chosen = F.when(F.col("root") == code, served(r, s)) if chosen is None else chosen.when(F.col("root") == code, served(r, s))
    finest = grouped.select(F.explode(chosen).alias("c"), *values).select("c.*", *values).groupBy("from", "start", *KEYS[2:-1]).agg(*merged())
    # pairs made at several grains are told apart by where they are from
    coarser = {"day": tuple(grains)} if not pairs else {"day": tuple(grains), **{g: tuple(k for k in pair_grains if k == g or (g == "month" and k in ("quarter", "year") or g == "quarter" and k == "year")) for g in made if g != "day"}}
    places = None
    for g, targets in coarser.items():
        one_way = F.array(*[F.struct(F.lit(k).alias("grain"), (F.trunc("start", k) if k != "day" else F.col("start")).alias("start")) for k in targets])
        if g == "day" and pairs:
            two = tuple(pair_grains) if "day" in made else ()
            paired = F.array(*[F.struct(F.lit(k).alias("grain"), (F.trunc("start", k) if k != "day" else F.col("start")).alias("start")) for k in two]) if two else F.array().cast("array<struct<grain:string,start:date>>")
            one_way = F.when(F.col("dim_b").isNull(), one_way).otherwise(paired)
        places = F.when(F.col("from") == g, one_way) if places is None else places.when(F.col("from") == g, one_way)
    placed = finest.withColumn("g", F.explode(places)).select("g.grain", "g.start", "dim_a", "val_a", "dim_b", "val_b", *values)
    # all measures of a cell are merged side by side; names of periods and measures are put on at the end
    whole = placed.groupBy("grain", "start", *KEYS[2:-1]).agg(*merged())
    named = F.lit(None).cast("string")
    for g in sorted({*grains, *(pair_grains if pairs else ())}, key=GRAINS.index):
        named = F.when(F.col("grain") == g, period(F.col("start"), g)).otherwise(named)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), *[F.col(f"{k}_{i}").alias(k) for k in PARTS]) for i, m in enumerate(measures)]))
    return whole.select("grain", named.alias("period"), *KEYS[2:-1], each.alias("x")).select(*KEYS[:-1], "x.*").where("n > 0")


def dropped_rows(rows: DataFrame, time: str, measures: Sequence[str]) -> DataFrame:
    """One row: rows, no_date (whose date does not parse) and no_measure (with a date, but without any number)."""
    day = day_of(F.col(time), rows.schema[time].dataType.simpleString())
    number = F.coalesce(*[F.when(~F.isnan(x := F.col(m).try_cast("double")) & (F.abs(x) < float("inf")), x) for m in measures])
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(F.count("*").alias("rows"), count(day.isNull()).alias("no_date"), count(day.isNotNull() & number.isNull()).alias("no_measure"))


def merge(cells: DataFrame) -> DataFrame:
    """Cells of equal keys added up: the accumulators form a monoid, so parts of any input can be merged."""
    return cells.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"), F.min("min").alias("min"), F.max("max").alias("max"))


def count_cells(cells: DataFrame) -> DataFrame:
    """Cells of each grain, whatever the number of measures."""
    return cells.select(*KEYS[:-1]).distinct().groupBy("grain").agg(F.count("*").alias("cells"))


def estimate_bytes(cells: int, measures: int) -> int:
    return cells * measures * BYTES_PER_CELL
