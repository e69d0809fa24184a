"""The collection cycle as Structured Streaming.

One query reads slot files, each once, oldest first, and hands every micro-batch to a `CollectJob`: parse, keep the first of each key, fill in
what is stored without names or themes, tag, place, match names, link stories. Progress is the checkpoint; every table has a log of commits that
knows its batches, so a replayed batch adds what is missing and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediagraph.functions import url
from mediagraph.operators import counts, dates, load, mentions, stories, tagging
from mediagraph.operators.feedstore import FeedStore
from mediagraph.session import cut
from mediagraph.sources import lines, pages
from mediagraph.sources.tablelog import TableLog

ARTICLES = """article_id bigint, url_key string, url string, title string, domain string, outlet_id bigint, seen timestamp, language string,
image_url string, about array<string>, names array<string>, themes map<string,bigint>, source_url string"""
TAGS = "article_id bigint, slug string, evidence string"
PLACES = "article_id bigint, country string, mentions bigint"
MENTIONS = "article_id bigint, qid string, mentions bigint"
SECTIONS = "article_id bigint, pos int, label string"
UNREADABLE = "file string, error string"
STORIES = "article_id bigint, story_id bigint, linked_to bigint, shared array<string>"
DATES = "article_id bigint, at timestamp, method string, conflict boolean, checked timestamp"


ARTICLE_COLUMNS = [c.split()[0] for c in ARTICLES.replace("map<string,bigint>", "map").split(",")]
RECORD = "_all array<struct<value:string,count:bigint>>, _places array<struct<value:string,count:bigint>>"
STAGED = f"{ARTICLES}, {RECORD}"
FILLED = f"{ARTICLES}, batch int, day date, names_filled boolean, themes_filled boolean, {RECORD}"
BATCH_IDS = 1 << 36  # ids set aside for one batch


def read_lines_stream(spark: SparkSession, folder: str, files_per_batch: int = 2) -> DataFrame:
    """(file, block, value) of slot files as they appear. Oldest first; usually the two streams of one slot per batch."""
    raw = spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").load(folder)
    return lines.locate_lines(raw)


def read_zips_stream(spark: SparkSession, folder: str, files_per_batch: int = 2) -> DataFrame:
    """(file, arrival, value, error) of zipped slot files as they appear."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return lines.zip_rows(raw.option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", files_per_batch).load(folder))


@dataclass
class CollectJob:
    """What a micro-batch is joined with, and where its results go. Dimensions are functions, so that each batch sees their
    current state."""

    spark: SparkSession
    root: str
    outlets: Callable[[], DataFrame]  # outlet_id, domain, aliases, display_name, entity_id
    tag_themes: Callable[[], DataFrame]
    tag_sections: Callable[[], DataFrame]
    entities: Callable[[], DataFrame]  # entity_id, qid, name, aliases
    places: Callable[[], DataFrame]  # code, name
    pages: Callable[[DataFrame], DataFrame] | None = None  # new articles -> (article_id, html) that were read
    link: bool = True
    feed: FeedStore | None = None  # article_id, outlet_id, seen, stated, title, about: what readers see
    compact_from: int = 16  # files of one part that are made one
    schemas: dict[str, str] = field(default_factory=lambda: {
        "articles": ARTICLES, "tags": TAGS, "places": PLACES, "mentions": MENTIONS, "stories": STORIES, "dates": DATES, "sections": SECTIONS, "unreadable": UNREADABLE})

    def log(self, name: str) -> TableLog:
        return TableLog(self.spark, f"{self.root}/{name}")

    def schema(self, name: str) -> str:
        return f"{self.schemas[name]}, batch int" + (", day date" if name == "articles" else "")

    def table(self, name: str, before: int | None = None, since: date | None = None) -> DataFrame:
        """A result table. With `before`, files of earlier batches only (what a replay may look at); with `since`, of days from it on."""
        return self.log(name).read(self.schema(name), keep=lambda p: (before is None or p.batch < before) and (since is None or p.part is None or p.part >= str(since)))

    def put(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """Append a batch's rows; a replay finds them there and writes nothing."""
        rows = rows.withColumn("batch", F.lit(batch_id))
        if name == "articles":
            self.log(name).append(rows.withColumn("day", F.to_date("seen")), batch_id, F.col("day"))
        else:
            self.log(name).append(rows, batch_id)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if "error" in batch.columns:
            unzipped = cut(batch)  # each archive is opened once
            self.put("unreadable", unzipped.where("error is not null").select("file", "error"), batch_id)
            batch = lines.good_files(unzipped)
        numbered = batch if "arrival" in batch.columns else lines.number_lines(batch)
        self.store(lines.parse_lines(numbered, self.outlets()), batch_id)
        self.tidy(batch_id)

    def tidy(self, batch_id: int) -> None:
        """Few files for many, of batches before this one (which may be replayed)."""
        for name in self.schemas:
            self.log(name).compact(self.schema(name), least=self.compact_from, before=batch_id)

    def described(self, records: DataFrame) -> DataFrame:
        """Records of known outlets with what they are about, kept names, themes in use, and all names and places."""
        keyed = records.withColumn("url_key", url.canonical_key(F.col("url")))
        known = cut(keyed.join(self.outlets().select("domain", "outlet_id"), "domain").withColumn("article_id", F.col("arrival")))
        names = self.places().select(F.col("code").alias("country"), F.col("name").alias("place_name"))
        placed = known.select("article_id", F.posexplode("places").alias("place", "p")).select("article_id", "place", F.col("p.value").alias("country"), F.col("p.count").alias("mentions"))
        who = known.select("article_id", F.posexplode("people").alias("place", "p")).select("article_id", "place", F.col("p.value").alias("name"))
        about = counts.about_text(who, placed, names)
        kept = F.transform(F.filter(F.slice("names", 1, counts.MAX_NAMES), lambda n: n["count"] >= counts.MIN_MENTIONS), lambda n: n["value"])
        used = self.tag_themes().agg(F.collect_set("theme").alias("_used"))  # one row: the tag settings
        themes = F.map_from_entries(F.filter(F.transform("themes", lambda t: F.struct(t["value"], t["count"])), lambda e: F.array_contains("_used", e["value"])))
        return known.withColumn("_names", kept).join(about, "article_id", "left").join(F.broadcast(used)).select(
            "arrival", "url_key", "url", "title", "domain", "outlet_id", "seen", "language", "image_url", F.coalesce("about", F.array().cast("array<string>")).alias("about"),
            F.col("_names").alias("names"), themes.alias("themes"), "source_url", F.col("names").alias("_all"), F.col("places").alias("_places"))

    def staged(self, name: str, rows: DataFrame, schema: str, batch_id: int, done: bool) -> DataFrame:
        """A batch's rows on disk, for all that hangs off them. Once what they lead to is committed, a replay reads them as they were. Folders of two
        batches are used in turn."""
        folder = f"{self.root}/staged/{name}-{batch_id % 2}"
        if not done:
            rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(schema).parquet(folder)

    def store(self, records: DataFrame, batch_id: int) -> None:
        """One batch of article records: dedup, write, fill in what is stored, then everything that hangs off new and filled articles."""
        rows = cut(self.described(records))
        known = self.table("articles", batch_id)
        fresh = load.new_articles(rows, known).drop("copies")
        # Ids in order of arrival, within the batch's own range: a replay gives the same article the same id.
        numbered = load.number_rows(fresh, [F.col("arrival"), F.col("url_key")], "_n")
        numbered = numbered.withColumn("article_id", F.lit(batch_id).cast("bigint") * F.lit(BATCH_IDS) + F.col("_n"))
        # A later record of the same batch fills in what the first one lacks, as one of a later batch does.
        done = self.log("articles").state().batches.get("stream/rows", -1) >= batch_id
        staged = self.staged("new", self.filled(numbered, rows), STAGED, batch_id, done)
        self.put("articles", staged.select(*ARTICLE_COLUMNS), batch_id)
        filled = self.fill(rows, batch_id)
        self.enrich(staged, filled, batch_id)
        if self.feed is not None:
            self.feed.add(staged.select("article_id", "outlet_id", "seen", F.lit(None).cast("timestamp").alias("stated"), "title", F.concat_ws("; ", "about").alias("about")), batch_id)
        if self.pages is not None:
            self.date(staged, batch_id)
        if self.link:
            self.link_stories(staged, batch_id)

    def filled(self, targets: DataFrame, rows: DataFrame) -> DataFrame:
        """Articles filled in from a batch's records, with the names and places of the record that gave `about` and `names`."""
        got = load.enrich_once(targets.drop("_all", "_places"), rows)
        named = (F.size("about") > 0) | (F.size("names") > 0)
        gave = rows.groupBy("url_key").agg(F.min_by(F.struct("_all", "_places"), F.when(named, F.col("arrival"))).alias("_gave"))
        out = got.join(gave, "url_key", "left")
        own = targets.select(F.col("url_key").alias("_key"), F.col("_all").alias("_own_all"), F.col("_places").alias("_own_places")) if "_all" in targets.columns else None
        if own is None:
            return out.select("*", F.col("_gave._all").alias("_all"), F.col("_gave._places").alias("_places")).drop("_gave")
        out = out.join(own, F.col("url_key") == F.col("_key"), "left")
        pick = lambda c: F.when(F.col("names_filled"), F.col(f"_gave.{c}")).otherwise(F.col(f"_own{c}")).alias(c)
        return out.select(*ARTICLE_COLUMNS, pick("_all"), pick("_places"))

    def fill(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Fill in stored articles that the batch has again: copy-on-write of just the files of the days they were seen on. Returns the filled rows."""
        log = self.log("articles")
        done = log.state().batches.get("fill", -1) >= batch_id
        if done:
            return self.staged("filled", rows, FILLED, batch_id, done)
        lacking = ((F.size("about") == 0) & (F.size("names") == 0)) | (F.size(F.map_keys("themes")) == 0)
        hit = self.table("articles", batch_id).where(lacking).join(rows.select("url_key").distinct(), "url_key", "left_semi")
        got = self.staged("filled", self.filled(hit, rows).where("names_filled or themes_filled"), FILLED, batch_id, done)
        days = {str(r[0]) for r in got.select("day").distinct().collect()}
        worn = log.picked(keep=lambda p: p.batch < batch_id and p.part in days)
        schema = self.spark.createDataFrame([], self.schema("articles")).columns
        kept = log.read_pieces(self.schema("articles"), worn).join(got.select("article_id"), "article_id", "left_anti")
        whole = kept.select(*schema).unionByName(got.select(*schema))
        # the rows stay those of earlier batches: a replay must find them known
        add = log.write(whole, F.col("day"), batch=max(p.batch for p in worn)) if worn else []
        log.commit(add, worn, batches={"fill": batch_id})
        return got

    def enrich(self, staged: DataFrame, filled: DataFrame, batch_id: int) -> None:
        """Places, item mentions and tags of new articles and of what was filled in, against the dimensions as they are now. Tags of new articles wait for
        the date pass where there is one, as pages have section labels of their own."""
        named = filled.where("names_filled")
        both = staged.select("article_id", "domain", "_all", "_places").unionByName(named.select("article_id", "domain", "_all", "_places"))
        spots = both.select("article_id", F.explode("_places").alias("p")).select("article_id", F.col("p.value").alias("country"), F.col("p.count").alias("mentions"))
        self.put("places", spots.join(self.table("places", batch_id), ["article_id", "country"], "left_anti"), batch_id)
        spelt = both.select("article_id", "domain", F.explode("_all").alias("n")).select("article_id", "domain", F.col("n.value").alias("name"), F.col("n.count").alias("count"))
        entities = self.entities()
        found = mentions.match_names(spelt, mentions.name_index(entities), mentions.own_keys(self.outlets(), entities))
        self.put("mentions", found.join(self.table("mentions", batch_id), ["article_id", "qid"], "left_anti"), batch_id)
        if self.pages is None:
            self.tag(staged, self.spark.createDataFrame([], SECTIONS), filled, batch_id)

    def tag(self, staged: DataFrame, labels: DataFrame, filled: DataFrame, batch_id: int) -> None:
        """Tags of new articles, and of those whose themes were filled in, with the labels stored for them. Tags they have stay as they are."""
        themed = filled.where("themes_filled")
        themes = staged.select("article_id", "themes").unionByName(themed.select("article_id", "themes"))
        counted = themes.select("article_id", F.explode("themes").alias("theme", "n"))
        told = labels.unionByName(self.table("sections", batch_id).join(themed.select("article_id"), "article_id", "left_semi").select("article_id", "pos", "label"))
        tags = tagging.retag(counted, told, self.tag_themes(), self.tag_sections())
        self.put("tags", tags.join(self.table("tags", batch_id), ["article_id", "slug"], "left_anti"), batch_id)

    def link_stories(self, staged: DataFrame, batch_id: int) -> None:
        """New articles against the pool of the last 48 hours; what has a story keeps it. Only files of these days are read."""
        newest = staged.agg(F.max("seen").cast("timestamp_ntz")).first()[0]
        if newest is None:
            return
        first = newest - stories.POOL
        since = F.col("seen") >= F.lit(first).cast("timestamp")
        pool = self.table("articles", batch_id + 1, since=first.date()).where(since)
        given = self.table("stories", batch_id).select("article_id", "story_id")
        rows = pool.join(given, "article_id", "left").select("article_id", "outlet_id", "title", "names", "about", "seen", "story_id")
        linked = stories.link_stories(rows, place_names=self.places().select("name"))
        self.put("stories", linked, batch_id)

    def date(self, staged: DataFrame, batch_id: int) -> None:
        """The date pass over the pages read for this batch, in the same trigger. The pages' own section labels tag their articles, and dates found move them
        in the feed."""
        got = cut(self.pages(staged.select("article_id", "url", "seen")))
        scanned = cut(pages.scan_pages(got.select("article_id", "html")))
        labels = cut(dates.section_labels(scanned).select("article_id", F.posexplode("sections").alias("pos", "label")))
        self.put("sections", labels, batch_id)
        self.tag(staged, labels, self.staged("filled", staged, FILLED, batch_id, True), batch_id)
        cands = dates.candidates(scanned, ["article_id"])
        chosen = dates.choose(cands, staged.select("article_id", "seen"), key="article_id")
        rows = got.select("article_id").join(chosen, "article_id", "left").withColumn("checked", F.current_timestamp())
        self.put("dates", rows.select("article_id", "at", "method", "conflict", "checked"), batch_id)
        if self.feed is not None:
            mine = self.log("dates").read(self.schema("dates"), keep=lambda p: p.batch == batch_id).where("at is not null")
            self.feed.redate(mine.join(staged.select("article_id", F.col("seen").alias("shown")), "article_id").select("article_id", "shown", F.col("at").alias("stated")), batch_id)


def collect(spark: SparkSession, folder: str, job: CollectJob, checkpoint: str, files_per_batch: int = 2, zipped: bool = False) -> StreamingQuery:
    """Read what has arrived since the last run and stop (run again to resume). `zipped`: the slot files as they are published."""
    stream = (read_zips_stream if zipped else read_lines_stream)(spark, folder, files_per_batch)
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_stream(records: DataFrame, watermark: str = "6 hours") -> DataFrame:
    """Drops repeated keys while they are inside the watermark. Older repeats are caught by the stored keys in `CollectJob.store`, so state
    stays bounded."""
    return records.withColumn("url_key", url.canonical_key(F.col("url"))).withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["url_key"])


def slot_counts(rows: DataFrame, keys: list[str], at: str = "seen", watermark: str = "6 hours") -> DataFrame:
    """(slot, keys, articles) per quarter hour. A slot is named by its end and excludes its start. Works on batch and streaming rows; as a stream, rows
    later than the watermark are dropped (see `late_rows`) and a slot is emitted once it is past."""
    # Windows include their start: a microsecond earlier turns that round. The watermark is set on the shifted time, which the windows use.
    shifted = rows.withColumn("_at", F.col(at) - F.expr("INTERVAL 0.000001 SECOND"))
    source = shifted.withWatermark("_at", watermark) if rows.isStreaming else shifted
    return source.groupBy(F.window("_at", "15 minutes").alias("w"), *keys).agg(F.count("*").alias("articles")).select(F.col("w.end").alias("slot"), *keys, "articles")


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped for being later than the watermark, over the query's recorded progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


# ---------------------------------------------------------------- hold, then release

RELEASED = "article_id bigint, released_at timestamp, reason string"


def _processor(hold_ms: int):
    """The stateful processor, built here so that it is shipped by value."""
    from pyspark.sql.streaming import StatefulProcessor

    class Hold(StatefulProcessor):
        """Waits for an article's date check, or for the hold to pass. Released once; a late check changes nothing."""

        def init(self, handle) -> None:
            self.handle = handle
            self.done = handle.getValueState("done", "released boolean")
            self.since = handle.getValueState("since", "collected_ms bigint, checked_ms bigint")

        def _release(self, key, at_ms: int, reason: str) -> pd.DataFrame:
            self.done.update((True,))
            return pd.DataFrame({"article_id": [key[0]], "released_at": [pd.Timestamp(at_ms, unit="ms")], "reason": [reason]})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
            collected = checked = None
            if self.since.exists():
                collected, checked = self.since.get()
            for frame in rows:
                for kind, at in zip(frame["kind"], frame["at"], strict=True):
                    ms = int(pd.Timestamp(at).timestamp() * 1000)
                    if kind == "collected":
                        collected = ms if collected is None else min(collected, ms)
                    else:
                        checked = ms if checked is None else min(checked, ms)
            if self.done.exists():
                return
            self.since.update((collected, checked))
            if collected is None:
                return
            if checked is not None and checked <= collected + hold_ms:
                yield self._release(key, max(collected, checked), "checked")
            elif collected + hold_ms <= timerValues.getCurrentWatermarkInMs():
                yield self._release(key, collected + hold_ms, "held long enough")
            else:
                self.handle.registerTimer(collected + hold_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            if not self.done.exists():
                yield self._release(key, expiredTimerInfo.getExpiryTimeInMs(), "held long enough")

        def close(self) -> None:
            pass

    return Hold()


def hold_release(events: DataFrame, hold: timedelta = timedelta(minutes=15), watermark: str = "1 minute") -> DataFrame:
    """(article_id, released_at, reason) from a stream of (article_id, kind: collected | checked, at). Needs the RocksDB state store."""
    rows = events.withWatermark("at", watermark).groupBy("article_id")
    return rows.transformWithStateInPandas(
        statefulProcessor=_processor(int(hold.total_seconds() * 1000)), outputStructType=RELEASED, outputMode="append", timeMode="EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


