"""From a delimited file to profile and cells, with errors and warnings that a reader can act on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.cells import KEYS, build_cells, dropped_rows, estimate_bytes, select_pairs
from plumbline.operators.profile import Profile, profile
from plumbline.sources.delimited import read_delimited
from plumbline.sources.store import keep

# Rows above which a file is read only so far, is warned of, and bytes of cells that are warned of.
HARD_ROWS, SOFT_ROWS, WARN_BYTES = 1_000_000, 250_000, 300_000_000
#: File endings that are offered for data and for context notes.
DATA_ENDINGS, NOTE_ENDINGS = (".csv", ".tsv", ".txt"), (".md", ".txt", ".markdown")


@dataclass(frozen=True)
class Dataset:
    rows: DataFrame
    profile: Profile
    cells: DataFrame
    warnings: list[str] = field(default_factory=list)


def load(spark: SparkSession, path: str, roles: dict[str, str] | None = None, row_limit: int | None = None) -> Dataset:
    """Read, profile, build the cells and keep them.

    Raises ValueError for a file without header or rows, without a date column, or without a measure.  `row_limit` (for
    instance HARD_ROWS) reads no more rows than that and says so; by default all rows are read.
    """
    if not path.lower().endswith(DATA_ENDINGS):
        raise ValueError(f"{path} is no delimited text; expected one of {', '.join(DATA_ENDINGS)}")
    rows = read_delimited(spark, path, limit=None if row_limit is None else row_limit + 1)
    return from_frame(rows, roles, row_limit)


def from_frame(rows: DataFrame, roles: dict[str, str] | None = None, row_limit: int | None = None) -> Dataset:
    """The same for rows that are read already."""
    warnings = []
    if row_limit is not None and rows.limit(row_limit + 1).count() > row_limit:
        rows = rows.limit(row_limit)
        warnings.append(f"The file has more than {row_limit:,} rows; only the first {row_limit:,} were read.")
    p = profile(rows, roles)
    if not p.time:
        read = [c for c, _ in p.ids + p.excluded_dims][:4]
        raise ValueError("No date column recognised; the cells need a time axis. Dates look like 2024-01-31, 31/01/2024 or 31-Jan-2024." + (f" Columns read as text: {', '.join(read)}." if read else ""))
    if not p.measures:
        raise ValueError("No measure found; at least one column must hold numbers that vary.")
    if not p.dims:
        warnings.append("No usable dimension: every other column is unique a row or has too many members. Only totals and trends will work.")
    if p.time_alternatives:
        warnings.append(f"{p.time} is the time axis; {', '.join(t for t, _ in p.time_alternatives)} hold dates as well.")
    members = dict(p.dims)
    pairs = select_pairs(members)
    cells = keep(build_cells(rows, p.time, p.dim_names(), p.measure_names(), pairs), by="grain")
    lost = dropped_rows(rows, p.time, p.measure_names()).first()
    if lost["no_date"]:
        warnings.append(f"{lost['no_date']:,} row(s) ({lost['no_date'] / lost['rows']:.1%}) have a date that does not parse and are left out.")
    skipped = len(members) * (len(members) - 1) // 2 - len(pairs)
    if skipped:
        warnings.append(f"{skipped} pair(s) of dimensions are left out to stay within the budget of cells.")
    size = estimate_bytes(cells.select(*[F.col(k) for k in KEYS[:-1]]).distinct().count(), len(p.measures))
    if size > WARN_BYTES:
        warnings.append(f"The cells take about {size / 1e6:,.0f} MB; fewer dimensions or a coarser grain help.")
    if p.rows > SOFT_ROWS:
        warnings.append(f"{p.rows:,} rows.")
    return Dataset(rows, p, cells, warnings)
