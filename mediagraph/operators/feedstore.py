"""The feed's articles as a stored table: files by the day an article is shown, and an hourly rollup written in the same commit.

Totals, counts per outlet and the hours a page lies in come from the rollup (outlet, hour, articles), without a look at articles; a page then
reads the files of its own days and ranks the rows of its own hours, however deep it is. This holds for feeds filtered by outlet, country
and days; other filters read the articles of the days asked for. Where a day begins inside a UTC hour, that hour is counted from its articles.

A date found later moves its article to another day and hour: the files of the days it leaves are written again and the rollup gets a row
that takes away and one that adds, in one commit.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediagraph.functions import when
from mediagraph.operators import feed
from mediagraph.operators.feed import CAP, FeedFilters
from mediagraph.session import cut
from mediagraph.sources.tablelog import Piece, TableLog

HOURS = "outlet_id bigint, hour timestamp, n bigint"
HOUR = timedelta(hours=1)


def by_rollup(f: FeedFilters) -> bool:
    """Whether counts of this feed follow from the rollup."""
    return not (f.q or f.tag or f.place or f.owner or f.mentions)


class FeedStore:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType) -> None:
        """`schema` is that of the articles without `shown`."""
        self.log = TableLog(spark, folder)
        self.schema = T.StructType([*schema.fields, T.StructField("shown", T.TimestampType())])

    def add(self, articles: DataFrame, batch: int) -> int | None:
        """Add a batch of articles; one that is already in stays as it is."""
        if self.log.state().batches.get("feed", -1) >= batch:
            return None
        rows = cut(articles.withColumn("shown", when.shown_at(F.col("stated"), F.col("seen"))))
        return self.log.commit([*self._files(rows, batch), *self._hours_file(rows.select("outlet_id", "shown", F.lit(1).alias("n")), batch)], batches={"feed": batch})

    def _files(self, rows: DataFrame, batch: int | None) -> list[Piece]:
        day = F.to_date("shown")
        return self.log.write(rows.select(*self.schema.names).repartition(day).sortWithinPartitions(day, "shown"), day, "articles", batch)

    def _hours_file(self, rows: DataFrame, batch: int | None) -> list[Piece]:
        sums = rows.groupBy(F.col("outlet_id").cast("bigint").alias("outlet_id"), when.utc_hour(F.col("shown")).alias("hour")).agg(F.sum("n").cast("bigint").alias("n"))
        return self.log.write(sums.where("n <> 0").sort("hour"), kind="hours", batch=batch)

    def redate(self, found: DataFrame, batch: int) -> int | None:
        """Give articles the dates found for them: (article_id, shown: as it was, stated). Only the files of the days they leave are written again."""
        if self.log.state().batches.get("dates", -1) >= batch:
            return None
        found = cut(found.select("article_id", F.to_date("shown").alias("_day"), F.col("stated").alias("_stated")))
        days = {str(r[0]) for r in found.select("_day").distinct().collect()}
        worn = self.log.picked("articles", lambda p: p.part in days)
        old = self.log.read_pieces(self.schema, worn)
        hit = cut(old.join(found.select("article_id", "_stated"), "article_id").withColumn("_was", F.col("shown")).withColumn("stated", F.col("_stated"))
                  .withColumn("shown", when.shown_at(F.col("_stated"), F.col("seen"))))
        rest = old.join(hit.select("article_id"), "article_id", "left_anti").select(*self.schema.names)
        change = hit.select("outlet_id", "shown", F.lit(1).alias("n")).unionByName(hit.select("outlet_id", F.col("_was").alias("shown"), F.lit(-1).alias("n")))
        rows = rest.unionByName(hit.select(*self.schema.names))
        return self.log.commit([*self._files(rows, None), *self._hours_file(change, batch)], worn, batches={"dates": batch})

    def compact(self, least: int = 8) -> None:
        """Few files for many: of each day, and of the rollup, whose rows are added up."""
        self.log.compact(self.schema, "articles", least=least)
        old = self.log.picked("hours")
        if len(old) >= least:
            self.log.commit(self.log.write(self._summed(old).sort("hour"), kind="hours", batch=max((p.batch for p in old if p.batch is not None), default=None)), old)

    # ------------------------------------------------------------ reading

    def _summed(self, pieces: list[Piece]) -> DataFrame:
        return self.log.read_pieces(HOURS, pieces).groupBy("outlet_id", "hour").agg(F.sum("n").alias("n")).where("n > 0")

    def articles(self, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
        """Articles shown from `first` to before `last` (UTC); only the files of those days are read."""
        low, high = (None if x is None else str(x.date()) for x in (first, last))
        rows = self.log.read(self.schema, "articles", lambda p: p.part is not None and (low is None or p.part >= low) and (high is None or p.part <= high))
        utc = lambda x: F.lit(x.replace(tzinfo=timezone.utc))
        if first is not None:
            rows = rows.where(F.col("shown") >= utc(first))
        if last is not None:
            rows = rows.where(F.col("shown") < utc(last))
        return rows

    def _range(self, f: FeedFilters, zone: str) -> tuple[datetime | None, datetime | None]:
        """The days asked for as UTC instants (without a zone)."""
        spark = self.log.spark
        days = [f.date_from, f.date_to and f.date_to + timedelta(days=1)]
        ask = [F.to_utc_timestamp(F.lit(str(d)).cast("timestamp_ntz").cast("timestamp"), zone).cast("timestamp_ntz").alias(f"d{i}") for i, d in enumerate(days) if d]
        told = iter(spark.range(1).select(*ask).first() if ask else ())
        return tuple(next(told) if d else None for d in days)  # type: ignore[return-value]

    def _outlets(self, outlets: DataFrame, f: FeedFilters) -> DataFrame:
        if f.outlet:
            outlets = outlets.where(F.col("domain") == f.outlet)
        return outlets.where(F.col("country") == f.country) if f.country else outlets

    def hours(self, outlets: DataFrame, f: FeedFilters = FeedFilters(), zone: str = "UTC") -> DataFrame:
        """(outlet_id, hour, n) of a feed filtered by outlet, country and days."""
        first, last = self._range(f, zone)
        floor = lambda x: x.replace(minute=0, second=0, microsecond=0)
        rows = self._summed(self.log.picked("hours"))
        utc = lambda x: F.lit(x.replace(tzinfo=timezone.utc))
        low = None if first is None else floor(first) + (HOUR if floor(first) != first else timedelta(0))
        high = None if last is None else floor(last)
        if low is not None:
            rows = rows.where(F.col("hour") >= utc(low))
        if high is not None:
            rows = rows.where(F.col("hour") < utc(high))
        edges = [(first, min(low, last) if last else low)] if first is not None and low != first else []
        if last is not None and high != last and (low is None or high >= low):
            edges.append((high, last))
        for a, b in edges:  # hours of which the feed has a part
            part = self.articles(a, b).groupBy(F.col("outlet_id").cast("bigint").alias("outlet_id"), when.utc_hour(F.col("shown")).alias("hour")).agg(F.count("*").alias("n"))
            rows = rows.unionByName(part)
        return rows.join(self._outlets(outlets, f).select("outlet_id"), "outlet_id", "left_semi")

    def counts_per_outlet(self, outlets: DataFrame, f: FeedFilters = FeedFilters(), zone: str = "UTC", cap: int = CAP) -> DataFrame:
        """(outlet_id, articles, hidden), as `feed.counts_per_outlet`."""
        kept = F.least(F.col("n"), F.lit(cap)) if f.balanced else F.col("n")
        return self.hours(outlets, f, zone).groupBy("outlet_id").agg(F.sum(kept).alias("articles"), F.sum(F.col("n") - kept).alias("hidden"))

    def totals(self, outlets: DataFrame, f: FeedFilters = FeedFilters(), zone: str = "UTC", cap: int = CAP) -> DataFrame:
        return self.counts_per_outlet(outlets, f, zone, cap).agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("total"), F.coalesce(F.sum("hidden"), F.lit(0)).alias("hidden"))

    def rows(self, outlets: DataFrame, f: FeedFilters = FeedFilters(), zone: str = "UTC") -> DataFrame:
        """Articles with their outlet, of the days asked for."""
        return self.articles(*self._range(f, zone)).join(self._outlets(outlets, f), "outlet_id")

    def page(self, outlets: DataFrame, f: FeedFilters, zone: str = "UTC", cap: int = CAP) -> tuple[DataFrame, dict[str, int]]:
        """A page ordered by time and its counts, as `feed.feed_page`: one pass over the rollup, then the articles of the page's hours."""
        if not by_rollup(f) or f.sort not in ("newest", "oldest"):
            raise ValueError("such a feed is read by feed.feed_page")
        kept = F.least(F.col("n"), F.lit(cap)) if f.balanced else F.col("n")
        by_hour = cut(self.hours(outlets, f, zone).groupBy("hour").agg(F.sum(kept).alias("kept"), F.sum("n").alias("n")))  # a row per hour of the feed
        sums = by_hour.agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - F.col("kept")), F.lit(0)).alias("hidden")).first()
        pages = max(1, -(-sums["total"] // f.per))
        page = min(f.page, pages)
        begin, end = (page - 1) * f.per, min(page * f.per, sums["total"])
        order = F.desc("hour") if f.sort == "newest" else F.asc("hour")
        run = by_hour.withColumn("run", F.sum("kept").over(Window.orderBy(order)))
        mine = run.where((F.col("run") > begin) & (F.col("run") - F.col("kept") < end))
        found = mine.agg(F.min("hour").cast("timestamp_ntz").alias("low"), F.max("hour").cast("timestamp_ntz").alias("high"), F.min(F.col("run") - F.col("kept")).alias("before")).first()
        info = {"total": sums["total"], "hidden": sums["hidden"], "pages": pages, "page": page, "first": begin + 1 if sums["total"] else 0, "last": end}
        rows = self.rows(outlets, f, zone)
        if found["low"] is None:
            return rows.limit(0), info
        first, last = self._range(f, zone)
        low, high = max(found["low"], first or found["low"]), min(found["high"] + HOUR, last or found["high"] + HOUR)
        rows = self.articles(low, high).join(self._outlets(outlets, f), "outlet_id")
        shown = feed.capped(rows, cap) if f.balanced else rows
        return shown.orderBy(*feed.order(f.sort)).offset(begin - found["before"]).limit(end - begin), info
