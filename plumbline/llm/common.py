"""Helpers shared by the training-data operators: table reading, lineage cuts, Arrow plumbing."""

from __future__ import annotations

import atexit
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A local session without that setting gets a folder under /tmp; a cluster without it is an error, since executors
    would write where the others cannot read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/checkpoints/plumbline"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_written: list[tuple[weakref.ref, str]] = []
_tables: list[tuple[weakref.ref, str, str]] = []


@atexit.register
def _sweep() -> None:
    for ref, what in [*_written, *((ref, path) for ref, _, path in _tables)]:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _remove(spark, what)
        except Exception:  # the JVM may have gone before the interpreter
            return


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: later steps restart from files, not from lineage.

    Unlike an RDD checkpoint the table is columnar and compressed, and its size is known to the planner.  Void columns
    (which Parquet refuses) become strings.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
    df = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.option("compression", "zstd").parquet(path)
    _written.append((weakref.ref(spark), path))
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Like cut(), as a table in `parts` buckets of `key`, its files in the shared folder: grouping by the key and joining on
    it need no further shuffle of these rows.  Buckets are sorted, so that equal keys lie together and take little room."""
    spark = df.sparkSession
    name = f"plumbline_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(name)
    _tables.append((weakref.ref(spark), name, path))
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that cut() or cut_by() wrote and that nothing reads any more."""
    files = df.inputFiles()[:1]
    for entry in _tables:
        if files and f"/{entry[1]}/" in files[0]:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {entry[1]}")
            _tables.remove(entry)
            break
    for path in files:
        _remove(df.sparkSession, path.rsplit("/", 1)[0])


#: Keys that hold more than 1 / HEAVY of the rows of a lookup are answered by broadcast: fewer than HEAVY of them exist.
HEAVY, HEAVY_LEAST = 1024, 32


def heavy_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The keys with more than n / HEAVY (and HEAVY_LEAST) of the n rows: fewer than HEAVY rows, whatever n."""
    return rows.groupBy(key).count().where(F.col("count") > max(HEAVY_LEAST, n / HEAVY)).select(key)


def lookup(rows: DataFrame, key: str, values: DataFrame, heavy: DataFrame, spread: str) -> DataFrame:
    """rows left joined with values (key and others; one row a key), so that no frequent key meets in one task.

    The values of `heavy` keys (see heavy_keys) are broadcast; their rows are dealt by `spread`, a column of rows.
    """
    wanted = [c for c in values.columns if c != key]
    few = values.join(F.broadcast(heavy), key).select(F.col(key), F.lit(True).alias("__heavy"), *[F.col(c).alias(f"__few_{c}") for c in wanted])
    marked = rows.join(F.broadcast(few), key, "left").withColumn("__deal", F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(HEAVY)) + 1).otherwise(0))
    # zero, but no constant: as one it would leave the join's keys, and the rows would be dealt by the key alone
    rest = values.select(key, F.pmod(F.xxhash64(key), F.lit(1)).alias("__deal"), *[F.col(c).alias(f"__own_{c}") for c in wanted])
    joined = marked.join(rest, [key, "__deal"], "left")
    return joined.select(*rows.columns, *[F.when(F.col("__heavy"), F.col(f"__few_{c}")).otherwise(F.col(f"__own_{c}")).alias(c) for c in wanted])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty, without a round trip over Python strings."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b if b is not None else b"" for b in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def crc_fold(doc_id, modulus: int):
    """crc32 of the decimal doc_id, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def draw(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], max_total: int, fold: tuple[int, int] | None = None) -> dict[int, list]:
    """Texts of at most most[value] documents for each label value, the first by hash of the id: rows (h, doc_id, t).

    Ids are drawn first, over narrow columns: a label with many rows is thinned by its hash to little more than it may give
    before its rows are ranked, so no label meets in one task.  Only the drawn ids (bounded by `most`) are broadcast to fetch
    texts, so no text but theirs is shuffled.  Texts are whole: a label is drawn until its texts hold `max_total` characters,
    and the text that reaches the bound is the last.  `fold` = (modulus, remainder that is left out).  Null labels, null texts
    and rows without id are not drawn.
    """
    ids = docs.where("text IS NOT NULL").select("doc_id").distinct()
    pairs = ids.join(labels.where(F.col(label).isin(list(most))).select("doc_id", F.col(label).alias("__y")).distinct(), "doc_id")
    if fold:
        pairs = pairs.where(crc_fold("doc_id", fold[0]) != fold[1])
    held_rows = {r["__y"]: r["count"] for r in pairs.groupBy("__y").count().collect()}  # at most one row a value of `most`
    if not held_rows:
        return {value: [] for value in most}
    reach = None
    for value, n in held_rows.items():
        share = min(1.0, (most[value] + 10 * most[value] ** 0.5 + 50) / n)
        reach = F.when(F.col("__y") == value, share) if reach is None else reach.when(F.col("__y") == value, share)
    limit = None
    for value in held_rows:
        limit = F.when(F.col("__y") == value, most[value]) if limit is None else limit.when(F.col("__y") == value, most[value])
    thinned = pairs.select(F.xxhash64("doc_id").alias("h"), "doc_id", "__y").where(F.col("h") / float(1 << 64) + 0.5 <= reach)
    picked = thinned.withColumn("__place", F.row_number().over(Window.partitionBy("__y").orderBy("h", "doc_id"))).where(F.col("__place") <= limit).drop("__place")
    before = Window.partitionBy("__y").orderBy("h", "doc_id", "t").rowsBetween(Window.unboundedPreceding, -1)
    held = docs.where("text IS NOT NULL").select("doc_id", F.col("text").alias("t")).join(F.broadcast(picked), "doc_id")
    rows = held.withColumn("__before", F.sum(F.length("t")).over(before)).where(F.coalesce("__before", F.lit(0)) < max_total).drop("__before").collect()
    found: dict[int, list] = {value: [] for value in most}
    for r in sorted(rows, key=lambda r: (r["h"], str(r["doc_id"]), r["t"])):
        found[r["__y"]].append(r)
    return found
