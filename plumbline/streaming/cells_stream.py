"""Day cells kept up to date from a stream: files that arrive are added up, and nothing is counted twice.

Cells form a monoid, so the kept table is one folder of day cells for each batch, and reading it adds them up.  A batch that
is replayed after a failure overwrites its own folder.  An event that is delivered again, by another file, is dropped while
its time is within the watermark; a late event is counted in its own day however late it is.  `compact` merges folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.functions.timeaxis import GRAINS, period
from plumbline.operators.cells import KEYS, build_cells, merge

CELLS = "grain string, period string, dim_a string, val_a string, dim_b string, val_b string, measure string, n long, sum double, sum_sq double, min double, max double"
_DAY_KEY = "yyyy-MM-dd"


def ingest(spark: SparkSession, arrivals: str, schema: StructType, kept: str, checkpoint: str, time: str, dims: Sequence[str], measures: Sequence[str], event_id: str | None = None, delay: str = "30 days", files_a_batch: int = 1000) -> StreamingQuery:
    """Read the Parquet files that have arrived since the last call, and add their day cells to the kept table.

    Runs until all files there are have been read.  `event_id` names an event; the same one is counted once if it comes again
    before `delay` of event time has passed, and state is held for no longer.  An event whose time is before the watermark
    cannot be told from a repeated one, so without `event_id` (no state) it is counted and with it Spark drops it.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(arrivals)
    if event_id is not None:
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([event_id])

    def add(batch: DataFrame, batch_id: int) -> None:
        cells = build_cells(batch.withColumn("__day", F.col(time).cast("date")), "__day", dims, measures, grains=("day",))
        # one folder a batch, whose content hangs on the batch alone: a replay changes nothing
        cells.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(spark: SparkSession, kept: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(where) if f.isDirectory()) if fs.exists(where) else []


def day_cells(spark: SparkSession, kept: str) -> DataFrame:
    """Day cells of all that has been ingested; none before the first batch."""
    folders = _folders(spark, kept)
    return merge(spark.read.schema(CELLS).parquet(*folders)) if folders else spark.createDataFrame([], CELLS)


def cells(spark: SparkSession, kept: str, grains: Sequence[str] = GRAINS) -> DataFrame:
    """Cells of the asked grains, added up from the day cells."""
    day = F.to_date("period", _DAY_KEY)
    places = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), period(day, g).alias("period")) for g in grains]))
    return merge(day_cells(spark, kept).withColumn("g", places).select("g.grain", "g.period", *KEYS[2:], "n", "sum", "sum_sq", "min", "max"))


def compact(spark: SparkSession, kept: str, into: str) -> None:
    """Write the kept day cells as one folder of `into`, a new kept table to go on with, with the same checkpoint.

    Run it while no ingestion runs.  Batches that are replayed later have numbers above those merged, since a batch that was
    committed is not replayed.
    """
    day_cells(spark, kept).write.mode("overwrite").parquet(f"{into}/batch=merged")
