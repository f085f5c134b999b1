"""Results kept as Parquet in a folder that driver and executors share: built once, served many times."""

from __future__ import annotations

import atexit
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may do without it and gets one under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints/plumbline"


_kept: list[tuple[weakref.ref, str]] = []


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to the shared folder, in partitions of `by` if given, and read back with the same columns.

    The files live as long as the interpreter.  A lost executor costs the tasks that it ran, not what lies behind the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-kept-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _kept.append((weakref.ref(spark), path))
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that keep() gave and that nothing reads any more."""
    files = df.inputFiles()
    for entry in [e for e in _kept if any(f"{e[1].rstrip('/').rsplit('/', 1)[-1]}/" in f for f in files[:1])]:
        remove(df.sparkSession, entry[1])
        _kept.remove(entry)


@atexit.register
def _sweep() -> None:
    for ref, path in _kept:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may have gone before the interpreter
            return
