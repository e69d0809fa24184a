"""Streams over the test tables, drained into a table that can be compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.plans.bindings import Tables
from mediagraph.plans.registry import query
from mediagraph.session import checkpoint_dir
from mediagraph.streaming import jobs

SLOTS = """SELECT time_bucket(INTERVAL '15' MINUTE, ts - INTERVAL '1' MICROSECOND) + INTERVAL '15' MINUTE AS slot, user_id AS outlet_id, count(*) AS articles FROM events GROUP BY 1, 2"""


def events_of(t: Tables, stream: bool) -> DataFrame:
    schema = t.read("events").schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet") if stream else t.spark.read.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(t.folder).select(F.col("ts").cast("timestamp").alias("seen"), F.col("user_id").alias("outlet_id"))


@query("slot_counts_batch", sql=SLOTS)
def _(t: Tables) -> DataFrame:
    return jobs.slot_counts(events_of(t, stream=False), ["outlet_id"])


@query("slot_counts_streamed", sql=SLOTS)
def _(t: Tables) -> DataFrame:
    """Drained to the end: what the watermark has not closed yet is flushed by update mode's last values."""
    out = f"{checkpoint_dir(t.spark)}/slots-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    rows = jobs.slot_counts(events_of(t, stream=True), ["outlet_id"])
    started = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    got = t.spark.read.parquet(f"{out}/data")
    # A slot updated in several batches counts with its last value.
    return got.groupBy("slot", "outlet_id").agg(F.max_by("articles", "batch").alias("articles"))


