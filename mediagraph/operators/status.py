"""The status roll-up as (metric, value) rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.operators import load


def _one(df: DataFrame, metric: str, value: Column) -> DataFrame:
    return df.agg(value.alias("value")).select(F.lit(metric).alias("metric"), F.col("value").cast("string").alias("value"))


def _per(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).select(F.concat(F.lit(prefix), F.col(key)).alias("metric"), F.col("n").cast("string").alias("value"))


def report(articles: DataFrame, outlets: DataFrame, cursors: DataFrame, funding: DataFrame, now: datetime,
           dated_days: int = 3, interval: timedelta = timedelta(minutes=15), runs: DataFrame | None = None,
           corrections: DataFrame | None = None) -> DataFrame:
    """Totals, dating, outlets behind or silent, each outlet's share of the last 24 hours, matches and funding counts; with `runs`
    (run_id, status, finished) the last run and the last full one, with `corrections` (state) how many are in each state.

    The article table is read once for the totals and once for the per-outlet counts; everything else is a dimension.
    """
    recent = F.col("seen") >= F.lit(now - timedelta(days=dated_days))
    undatable = recent & F.col("stated").isNull() & (F.col("attempts") >= 2)
    totals = articles.agg(
        F.count("*").alias("a"), F.max("seen").alias("b"), F.count_if(recent & F.col("stated").isNotNull()).alias("c"), F.count_if(undatable).alias("d"))
    pairs = F.explode(F.array(
        F.struct(F.lit("articles").alias("metric"), F.col("a").cast("string").alias("value")),
        F.struct(F.lit("newest").alias("metric"), F.date_format("b", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value")),
        F.struct(F.lit("dated").alias("metric"), F.col("c").cast("string").alias("value")),
        F.struct(F.lit("undatable").alias("metric"), F.col("d").cast("string").alias("value")))).alias("p")
    active = outlets.where("active")
    day = articles.where(F.col("seen") >= F.lit(now - timedelta(days=1))).groupBy("outlet_id").agg(F.count("*").alias("n"))
    per_outlet = active.join(day, "outlet_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = per_outlet.withColumn("_all", F.sum("n").over(Window.partitionBy()))  # the outlet dimension
    shown = share.select(F.concat(F.lit("last 24 h: "), "display_name").alias("metric"), F.expr("CAST(n * 100 DIV _all AS STRING)").alias("value"))
    parts = [
        totals.select(pairs).select("p.*"),
        _one(active, "outlets active", F.count("*")),
        _one(load.behind(outlets, cursors, now - 2 * interval), "outlets behind", F.count("*")),
        _one(per_outlet, "silent in 24 h", F.count_if(F.col("n") == 0)),
        shown,
        _per(active, "matches: ", "match_status"),
        _per(funding, "funding: ", "source"),
    ]
    if runs is not None:
        parts.append(_one(runs, "last run", F.max_by("status", "run_id")))
        parts.append(_one(runs, "last full run", F.max(F.when(F.col("status") == "ok", F.col("finished")))))
    if corrections is not None:
        parts.append(_per(corrections, "corrections: ", "state"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
