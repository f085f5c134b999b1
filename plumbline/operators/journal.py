"""Journals as tables: records in canonical JSON, chained by hash, verified in parallel, with a hash tree over them.

A record commits to the one before by `previous`, the hash of that record; so building a chain is a fold over one journal,
but verifying it needs only a record and its predecessor, which an equi-join brings together.  The hash tree is built level
by level over fixed ranges of places; two trees are compared from the root down, and only what differs is opened.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.store import keep

FANOUT = 256


def _plain(c: Column, kind: T.DataType) -> Column:
    """A value as canonical JSON has it: fields by name, doubles to 12 significant digits."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_plain(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        digits = F.when(c == 0, 0).otherwise(11 - F.floor(F.log10(F.abs(c)))).cast("int")
        scale = F.pow(F.lit(10.0), digits.cast("double"))
        return F.when(F.abs(digits) <= 300, F.round(c.cast("double") * scale) / scale).otherwise(c.cast("double"))
    return c


def canonical(df: DataFrame, columns: Sequence[str]) -> Column:
    """JSON of some columns: keys in order, no blanks, nulls shown; equal values give equal text whatever the order of columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.to_json(F.struct(*[_plain(F.col(c), kinds[c]).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def record_hash(body: Column, previous: Column) -> Column:
    """Hash of a record: of its body and its claim about the one before."""
    return F.sha2(F.concat(F.lit('{"body":'), body, F.lit(',"previous":'), F.coalesce(F.concat(F.lit('"'), previous, F.lit('"')), F.lit("null")), F.lit("}")), 256)


def build(rows: DataFrame, journal: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(journal, place, body, previous, hash): the rows of each journal chained in order, places from 0.

    A chain has no parallel form, since every hash needs the one before: each journal is one fold.  Journals that are too
    long for one task are appended to in pieces, with `previous` and the place of the last record of the piece before, or
    sealed by `tree` instead.
    """
    body = rows.select(F.col(journal).alias("journal"), F.struct(*order, canonical(rows, columns).alias("body")).alias("r"))
    start = F.struct(F.lit(None).cast("string").alias("hash"), F.array().cast("array<struct<body:string,previous:string,hash:string>>").alias("done"))

    def add(held: Column, r: Column) -> Column:
        own = record_hash(r["body"], held["hash"])
        return F.struct(own.alias("hash"), F.concat(held["done"], F.array(F.struct(r["body"].alias("body"), held["hash"].alias("previous"), own.alias("hash")))).alias("done"))

    chained = body.groupBy("journal").agg(F.aggregate(F.array_sort(F.collect_list("r")), start, add, lambda held: held["done"]).alias("done"))
    return chained.select("journal", F.posexplode("done").alias("place", "r")).select("journal", F.col("place").cast("long").alias("place"), "r.body", "r.previous", "r.hash")


def faults(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(journal, place, fault) of a table of records, in any order.

    content: a record that does not match its hash.  chain: its `previous` is not the hash of the record at the place before
    (for the first: not null; where that record is missing, every claim is unfounded).  repeated: a place that occurs again.
    end: the last record is not the one that `heads` (journal, hash) knows, without which a lost end goes unseen.
    """
    own = records.withColumn("__own", record_hash(F.col("body"), F.col("previous")))
    content = own.where(~F.col("hash").eqNullSafe(F.col("__own"))).select("journal", "place", F.lit("content").alias("fault"))
    # of a repeated place, any of its records may be the one meant; an equi-join of three keys, so that nothing is collected
    before = records.select("journal", (F.col("place") + 1).alias("place"), F.col("hash").alias("previous"))
    first = (F.col("place") == 0) & F.col("previous").isNull()
    claims = records.select("journal", "place", "previous").where(~F.coalesce(first, F.lit(False)))
    followed = claims.where("place <> 0 AND previous IS NOT NULL").join(before, ["journal", "place", "previous"], "left_anti")
    unfounded = claims.where("place IS NULL OR place = 0 OR previous IS NULL")
    chain = followed.unionByName(unfounded).select("journal", "place", F.lit("chain").alias("fault"))
    repeated = records.groupBy("journal", "place").count().where("count > 1").select("journal", "place", F.lit("repeated").alias("fault"))
    found = content.unionByName(chain).unionByName(repeated)
    if heads is not None:
        last = records.groupBy("journal").agg(F.max("place").alias("place"), F.max_by("hash", "place").alias("hash"))
        ends = heads.select("journal", F.col("hash").alias("__head")).join(last, "journal", "left").where(~F.col("hash").eqNullSafe(F.col("__head")))
        found = found.unionByName(ends.select("journal", F.coalesce(F.col("place") + 1, F.lit(0)).alias("place"), F.lit("end").alias("fault")))
    return found


def tree(records: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(journal, level, node, hash): level 0 are the records by place; node k of a level holds `fanout` nodes of the level below,
    and its hash is that of their places and hashes in order.  Each journal ends in one node.

    A level is one aggregation over groups of at most `fanout` rows, so nothing is ordered as a whole.
    """
    level = records.select("journal", F.lit(0).alias("level"), F.col("place").alias("node"), "hash")
    found, depth = level, 0
    most = records.agg(F.max("place")).first()[0]
    while most is not None and (most > 0 or depth == 0):
        most, depth = most // fanout, depth + 1
        parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))
        # kept, so that higher levels read this one and not the records
        level = keep(level.groupBy("journal", F.floor(F.col("node") / fanout).alias("node")).agg(F.sha2(F.array_join(parts, ","), 256).alias("hash")).select("journal", F.lit(depth).alias("level"), "node", "hash"))
        found = found.unionByName(level)
    return found


def differences(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(journal, place): records in which two trees differ, or that one of them lacks.

    From the roots down, only the children of nodes that differ are read and compared.
    """
    top = a.unionByName(b).agg(F.max("level")).first()[0] or 0
    roots = a.unionByName(b).groupBy("journal").agg(F.max("level").alias("level"))
    opened = None
    for level in range(top, -1, -1):
        own = roots.where(F.col("level") == level).select("journal")

        def nodes(t: DataFrame, name: str, level=level, own=own, opened=opened) -> DataFrame:
            here = t.where(F.col("level") == level).select("journal", "node", F.floor(F.col("node") / fanout).alias("up"), F.col("hash").alias(name))
            first = here.join(own, "journal", "left_semi")
            return (first if opened is None else first.unionByName(here.join(opened, ["journal", "up"], "left_semi"))).drop("up")

        differ = nodes(a, "ha").join(nodes(b, "hb"), ["journal", "node"], "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("journal", "node")
        opened = keep(differ).withColumnRenamed("node", "up") if level else differ
    return opened.select("journal", F.col("node").alias("place"))
