"""Delimited text as an all-string frame, read in splits whatever its quotes hold, and text sinks."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.store import keep

#: Candidate delimiters; the commonest outside quotes in the header wins, ties to the earlier.
DELIMITERS = (",", ";", "\t", "|")


def sniff_delimiter(header: str) -> str:
    plain = "".join(header.split('"')[::2])
    return max(DELIMITERS, key=lambda d: (plain.count(d), -DELIMITERS.index(d)))


def clean_headers(names: list[str | None]) -> list[str]:
    """Blank names become column_i, repeated ones get _k until all differ."""
    out: list[str] = []
    for i, n in enumerate(names):
        base = (n or "").replace("﻿", "").strip() or f"column_{i + 1}"
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


#: Splits that begin inside quotes are broadcast up to this number (a row of about 24 bytes each), and joined beyond it.
BROADCAST_SPLITS = 1_000_000


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, seq, record): the records of delimited text, each with the line breaks inside its quotes.

    Files are read in splits, by as many tasks.  A first pass counts the quotes of each split; their running sum by file says
    which splits begin inside quotes.  A second pass cuts records where a line ends outside quotes; what crosses the border
    of splits comes out as a first and a last piece, and these few pieces are put together at the end.
    """
    meta = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*meta, F.col("value"))
    counted = lines.groupBy("file", "split").agg(F.sum(_quotes(F.col("value"))).alias("quotes"))  # a row a split
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = keep(counted.withColumn("before", F.coalesce(F.sum("quotes").over(before), F.lit(0))).where("before % 2 = 1").select("file", "split", F.lit(True).alias("inside")))
    if inside.count() <= BROADCAST_SPLITS:
        marked = lines.join(F.broadcast(inside), ["file", "split"], "left")
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(inside, ["file", "split"], "left")
        marked = placed.repartition("file", "split").sortWithinPartitions("file", "split", "at").drop("at")

    def cut(batches):
        here, held, opened, leading, seq = None, [], False, False, 0
        for b in batches:
            out = []
            for file, split, line, inside in zip(*[b.column(c).to_pylist() for c in ("file", "split", "value", "inside")], strict=True):
                if (file, split) != here:
                    if held:
                        out.append((*here, seq, "middle" if leading else "last", "\n".join(held)))
                    here, held, opened, leading, seq = (file, split), [], bool(inside), bool(inside), 0
                held.append(line)
                opened ^= line.count('"') % 2 == 1
                if not opened:
                    out.append((file, split, seq, "first" if leading else "whole", "\n".join(held)))
                    held, leading, seq = [], False, seq + 1
            yield batch(out)
        if held:
            yield batch([(*here, seq, "middle" if leading else "last", "\n".join(held))])

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "split", "seq", "piece", "record"])

    pieces = marked.select("file", "split", "value", "inside").mapInArrow(cut, "file long, split long, seq long, piece string, record string")
    whole = pieces.where("piece = 'whole'").select("file", "split", "seq", "record")
    run = F.sum((F.col("piece") == "last").cast("int")).over(Window.partitionBy("file").orderBy("split", "seq"))
    border = pieces.where("piece <> 'whole'").withColumn("run", run)  # at most two pieces a split
    joined = border.groupBy("file", "run").agg(F.array_sort(F.collect_list(F.struct("split", "seq", "record"))).alias("p"))
    joined = joined.select("file", F.get("p", F.lit(0))["split"].alias("split"), F.get("p", F.lit(0))["seq"].alias("seq"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, limit: int | None = None) -> DataFrame:
    """Strings only: quotes, doubled quotes and line breaks in quotes are read; short rows are padded, surplus fields dropped,
    blank lines skipped.  Of several files each has the header.  Raises ValueError for a file without a header or without rows."""
    found = records(spark, path)
    header = found.where("split = 0 AND seq = 0").select("record").limit(1).collect()
    if not header or not header[0][0].strip():
        raise ValueError("the file has no header line")
    sep = delimiter or sniff_delimiter(header[0][0])
    names = clean_headers(next(csv.reader(io.StringIO(header[0][0]), delimiter=sep)))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    parsed = F.from_csv("record", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1"})
    df = found.where("NOT (split = 0 AND seq = 0)").select(parsed.alias("r")).select(*[F.col("r")[n].alias(n) for n in names])
    df = df.limit(limit) if limit is not None else df
    if df.isEmpty():
        raise ValueError("the file has a header but no rows")
    return df


def write_journal(spark: SparkSession, records: list[dict], path: str) -> None:
    """Audit records as JSON lines."""
    import json

    spark.createDataFrame([(i, json.dumps(r, sort_keys=True, default=str)) for i, r in enumerate(records)], "seq int, value string").orderBy("seq").select("value").coalesce(1).write.text(path)
