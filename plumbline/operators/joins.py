"""Joins that are no equality: overlapping spans, names inside texts, numbers within a tolerance.

Each is turned into an equi-join on buckets and an exact check, so no plan holds a nested loop.  The side that may be hot is
dealt by a hash (`salts`), the other side is repeated for each; equal keys then never meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8
#: A side of at most so many rows (periods of a calendar, names of members) is sent to every task, so that the other side is
#: not shuffled; a larger one is joined by its buckets.
FEW = 100_000
# Scores of a note, by how its dates meet a period.
IN_PERIOD, PRIOR, NEAR = 100, 70, 25
#: Tolerance of a number, and the width of its buckets in logarithms.
TOLERANCE, WIDTH = 0.02, 0.01
#: From here on, numbers that round alike differ by less than the tolerance.
ROUNDED = 51


def _months(first: Column, last: Column) -> Column:
    """Number of every month that a span touches."""
    number = lambda d: F.year(d) * 12 + F.month(d)
    return F.sequence(number(first), number(last))


def _dealt(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))


def _repeated(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def overlapping(left: DataFrame, right: DataFrame, salts: int = SALTS) -> DataFrame:
    """left and right, both with start and end (dates, end included), joined where their spans share a day.

    Spans are bucketed by the months they touch.  A pair that shares several months comes out once, in the later of the two
    first months.  Columns of right get the prefix r_.  A span without start or end, or that ends before it starts, joins
    nothing.
    """
    whole = lambda df: df.where(F.col("start") <= F.col("end"))
    a = _dealt(whole(left).withColumn("__month", F.explode(_months(F.col("start"), F.col("end")))), salts)
    b = whole(right).select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    b = _repeated(b.withColumn("__month", F.explode(_months(F.col("r_start"), F.col("r_end")))), salts)
    met = a.join(b, ["__month", "__salt"]).where((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")))
    later = F.greatest("start", "r_start")
    return met.where(F.col("__month") == F.year(later) * 12 + F.month(later)).drop("__month", "__salt")


def dated_matches(periods: DataFrame, notes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(period columns, id, score): every note that has a date in a period (IN_PERIOD), in the period before of the same
    length (PRIOR), or within twice its length before or once after (NEAR); the best of a note's dates counts.

    periods: start, end and names; notes: id and dates array<struct<start, end>>.
    A note without a whole date meets nothing; rows of one id are one note.  A note meets each period in one of the months that
    both touch, with all its dates beside it, so pairs of notes and periods are not shuffled.
    """
    length = F.date_diff("end", "start") + 1
    reach = periods.select(F.struct(*periods.columns).alias("p"), F.date_add("start", -length * 2).alias("from"), F.date_add("end", length).alias("to"))
    b = reach.where(F.col("from") <= F.col("to")).withColumn("__month", F.explode(_months(F.col("from"), F.col("to"))))
    # explode() would work out the dates once more, to leave out empty ones before it
    spans = notes.select("id", F.explode_outer("dates").alias("d")).where("d.start <= d.end")
    held = spans.groupBy("id").agg(F.collect_set(F.struct("d.start", "d.end")).alias("dates"), F.min("d.start").alias("first"), F.max("d.end").alias("last"))
    months = F.array_distinct(F.flatten(F.transform("dates", lambda d: _months(d["start"], d["end"]))))
    a = held.withColumn("__month", F.explode(months))
    if periods.count() <= FEW:
        met = a.join(F.broadcast(b), "__month")
    else:
        met = _dealt(a, salts).join(_repeated(b, salts), ["__month", "__salt"])
    met = met.where((F.col("first") <= F.col("to")) & (F.col("from") <= F.col("last")))
    p, size = F.col("p"), F.date_diff("p.end", "p.start") + 1
    whole = lambda x, y: (F.col("first") <= y) & (x <= F.col("last"))
    some = lambda x, y: F.when(F.size("dates") == 1, whole(x, y)).otherwise(F.exists("dates", lambda d: (d["start"] <= y) & (x <= d["end"])))
    month = lambda start: F.year(later := F.greatest(start, F.col("from"))) * 12 + F.month(later)
    in_reach = F.filter("dates", lambda d: (d["start"] <= F.col("to")) & (F.col("from") <= d["end"]))
    # the least of the months in which a date and the period's reach begin to meet
    own = F.when(F.size("dates") == 1, month(F.col("first"))).otherwise(F.array_min(F.transform(in_reach, lambda d: month(d["start"]))))
    score = F.when(some(p["start"], p["end"]), IN_PERIOD).when(some(F.date_add(p["start"], -size), F.date_add(p["start"], -1)), PRIOR).otherwise(NEAR)
    return met.where(F.col("__month") == own).select("p.*", "id", score.alias("score"))


def units(text: Column) -> Column:
    """Words (letters, digits, underscore) and single other characters of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+|[^a-z0-9_]"), F.lit(0))


def mentions(texts: DataFrame, names: DataFrame, salts: int = SALTS) -> DataFrame:
    """(id, name): every name that stands in a text, whatever its case, from word to word.

    texts: id, text; names: name.  Texts and names are cut into units, and every run of units of a text that is as long as
    some name and begins with a word is looked up among the names.  Names of fewer than three characters, and names that do
    not begin and end with a word, are not looked for.  A text that names something twice gives one row.
    """
    asked = names.select("name").distinct().where((F.length("name") >= 3) & F.lower("name").rlike(r"^[a-z0-9_]") & F.lower("name").rlike(r"[a-z0-9_]$"))
    asked = asked.select("name", F.lower("name").alias("gram"), F.size(units(F.col("name"))).alias("size"))
    sizes = [r["size"] for r in asked.select("size").distinct().orderBy("size").limit(64).collect()]
    sizes = sizes if len(sizes) < 64 else list(range(1, 1 + asked.agg(F.max("size")).first()[0]))
    if not sizes:
        return texts.select("id", F.lit(None).cast("string").alias("name")).limit(0)
    cut = texts.select("id", units(F.col("text")).alias("u"))
    last = F.size("u")
    words = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("u", i).rlike("^[a-z0-9_]"))
    grams = lambda n: F.transform(F.filter(words, lambda i: i + (n - 1) <= last), lambda i: F.array_join(F.slice("u", i, n), ""))
    every = F.array_distinct(F.concat(*[grams(n) for n in sizes]))
    found = cut.select("id", F.explode_outer(F.when(last > 0, every)).alias("gram"))
    if asked.count() <= FEW:
        return found.join(F.broadcast(asked.select("gram", "name")), "gram").select("id", "name")
    return _dealt(found, salts).join(_repeated(asked.select("gram", "name"), salts), ["gram", "__salt"]).select("id", "name")


def _bucket(x: Column) -> Column:
    """Number of a bucket of a positive number; it does not fall as the number grows."""
    return F.floor(F.ln(x) / WIDTH)


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def evidence_summary(evidence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What decides whether a number is in evidence, whatever the number of rows: for each bucket of each sign its least and
    greatest value, the rounded small values, and zero.  At most about 300,000 rows for each value of `by`."""
    a = F.col("value")
    size = F.struct(F.lit("size").alias("kind"), F.when(a < 0, -1).otherwise(1).alias("sign"), _bucket(F.abs(a)).alias("bucket"))
    small = F.struct(F.lit("round").alias("kind"), F.lit(0).alias("sign"), _rounded(a).alias("bucket"))
    zero = F.struct(F.lit("zero").alias("kind"), F.lit(0).alias("sign"), F.lit(0).cast("long").alias("bucket"))
    keys = F.when(a == 0, F.array(zero)).when((F.abs(a) >= 1) & (F.abs(a) < ROUNDED), F.array(size, small)).otherwise(F.array(size))
    real = evidence.where(a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return real.select(*by, a.alias("value"), F.explode(keys).alias("key")).groupBy(*by, "key").agg(F.min("value").alias("least"), F.max("value").alias("most"))


def with_support(claims: DataFrame, evidence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """claims (`value`, `by` and others, no two rows alike) with `supported`: whether some row of evidence (value, `by`) bears the value.

    A value is supported if it, a hundredth or a hundred times it, lies within TOLERANCE of a value in evidence, or rounds to
    the same whole number as one of at least 1; zero supports only what is below 1e-9.  Claims are read once.  The summary of
    evidence without `by` is bounded and sent to every task, so what claims look up is not shuffled.
    """
    held = evidence_summary(evidence, by)
    v = F.col("value")

    def wanted(f: Column) -> Column:
        size = F.abs(f)
        # a within [f / 1.02, f / 0.98]: buckets from its lower to its upper end
        low, high = size / (1 + TOLERANCE), size / (1 - TOLERANCE)
        row = lambda kind, sign, bucket: F.struct(F.struct(F.lit(kind).alias("kind"), sign.alias("sign"), bucket.cast("long").alias("bucket")).alias("key"), low.alias("low"), high.alias("high"))
        near = F.when(size > 0, F.transform(F.sequence(_bucket(low), _bucket(high)), lambda b: row("size", F.when(f < 0, -1).otherwise(1), b)))
        alike = F.when(size < ROUNDED + 1, F.array(row("round", F.lit(0), _rounded(f))))
        none = F.when(size < 1e-9, F.array(row("zero", F.lit(0), F.lit(0))))
        return F.concat(*[F.coalesce(x, F.array().cast(f"array<struct<key:struct<kind:string,sign:int,bucket:bigint>,low:double,high:double>>")) for x in (near, alike, none)])

    # a claim that looks up nothing, as one without a value, stays
    asked = claims.select(*claims.columns, F.explode_outer(F.concat(wanted(v), wanted(v / 100), wanted(v * 100))).alias("w")).select(*claims.columns, "w.*")
    # of a bucket inside the interval every value will do; at its ends the extreme ones decide
    inside = F.when(F.col("key.kind") != "size", F.col("least").isNotNull()).when(F.col("key.sign") > 0, (F.col("most") >= F.col("low")) & (F.col("least") <= F.col("high"))).otherwise((F.col("least") <= -F.col("low")) & (F.col("most") >= -F.col("high")))
    met = asked.join(held if by else F.broadcast(held), [*by, "key"], "left")
    return met.groupBy(*claims.columns).agg(F.bool_or(F.coalesce(inside, F.lit(False))).alias("supported"))


def without_evidence(claims: DataFrame, evidence: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of claims that no row of evidence supports (see with_support).  Claims need different ids."""
    return with_support(claims, evidence, by).where("NOT supported").drop("supported")


assert math.log((1 + TOLERANCE) / (1 - TOLERANCE)) > WIDTH  # both ends of an interval never lie in one bucket
