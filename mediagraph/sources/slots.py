"""The 15-minute slot calendar and which of its files are missing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STREAMS = ("", ".translation")


def slots_between(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """(slot) quarter-hour marks with start < slot <= end."""
    return slots_over(spark.range(1).select(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end")))


def slots_over(span: DataFrame) -> DataFrame:
    """The same for spans (start, end) given as rows, such as the first and last time in a table."""
    quarter = 900
    first = (F.floor(F.unix_seconds("start") / quarter) + 1) * quarter
    last = F.floor(F.unix_seconds("end") / quarter) * quarter
    marks = F.when(last >= first, F.sequence(first, last, F.lit(quarter).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return span.select(F.explode(marks).alias("x")).select(F.timestamp_seconds("x").alias("slot"))


def slot_of(c: Column) -> Column:
    """The slot an instant falls in: the quarter hour it ends with, its start excluded."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(c) / F.lit(900_000_000)) * 900)


def slot_files(slots: DataFrame) -> DataFrame:
    """(slot, stream, file): both streams' file names."""
    streams = F.explode(F.array(*map(F.lit, STREAMS))).alias("stream")
    return slots.select("slot", streams).withColumn(
        "file", F.concat(F.date_format("slot", "yyyyMMddHHmmss"), "stream", F.lit(".gkg.csv.zip")))


def classify_gaps(slots: DataFrame, present: DataFrame, max_missing: int = 4) -> DataFrame:
    """(slot, state): `read`, `skipped` (missing, but a later slot was read), `pending` (missing at the end), or `not tried`
    (after `max_missing` missing in a row). `present` is (slot).

    Windows run over the calendar: 96 rows a day, whatever the data's size.
    """
    rows = slots.join(present.select("slot", F.lit(True).alias("_got")).distinct(), "slot", "left").withColumn("_got", F.coalesce("_got", F.lit(False)))
    order = Window.orderBy("slot")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_run", F.sum(F.col("_got").cast("int")).over(so_far))
    in_run = Window.partitionBy("_run").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_gap", F.sum((~F.col("_got")).cast("int")).over(in_run))
    gave_up = F.max((F.col("_gap") >= max_missing).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_stopped", F.coalesce(gave_up, F.lit(0)) == 1)
    read = F.col("_got") & ~F.col("_stopped")
    later = F.max(read.cast("int")).over(order.rowsBetween(1, Window.unboundedFollowing))
    state = (F.when(F.col("_stopped"), "not tried").when(F.col("_got"), "read").when(F.coalesce(later, F.lit(0)) == 1, "skipped").otherwise("pending"))
    return rows.select("slot", state.alias("state"))
