"""Loading articles and keeping dimensions: dedup, enrichment, progress, merges, repairs, retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import fixed, ids, url
from mediagraph.session import cut


# ---------------------------------------------------------------- articles

def first_per_key(rows: DataFrame, key: str = "url_key", arrival: str = "arrival") -> DataFrame:
    """One row per key: the first to arrive, whole; `copies` counts them. An aggregate with partial results, so a key
    holding a third of the rows sends one row per task."""
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.col(arrival)).alias("_first")
    return rows.groupBy(key).agg(first, F.count("*").alias("copies")).select(key, "_first.*", "copies")


def new_articles(rows: DataFrame, stored: DataFrame, key: str = "url_key") -> DataFrame:
    """The batch's first row per key, for keys not stored yet. Existing rows win.

    The batch's first rows are a written table of known size, so the optimizer can narrow years of stored keys to the batch's own
    without a shuffle where the batch is small, and joins by shuffle where it is not.
    """
    first = cut(first_per_key(rows, key))
    known = stored.select(key).join(first.select(key), key, "left_semi")
    return first.join(known, key, "left_anti")


def number_rows(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in a global order, without one task seeing all of them: range-partition on the order, number
    within partitions, add each partition's offset. The order must be total."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stamped = cut(ordered.withColumn("_mono", F.monotonically_increasing_id()))
    part, index = F.shiftrightunsigned("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stamped.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition of the sort: as many as there are tasks, whatever the data's size.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (stamped.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + index).drop("_part", "_offset", "_mono"))


def rank_in_group(rows: DataFrame, group: str, at: str, tie: str, name: str) -> DataFrame:
    """Rows numbered from 1 within each group by time. Ranked within each group's hours; the counts of earlier hours are added, so a
    group holding most of the rows is spread over as many tasks as it has hours."""
    hour = F.date_trunc("hour", at)
    marked = rows.withColumn("_hour", hour)
    sizes = marked.groupBy(group, "_hour").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(Window.partitionBy(group, "_hour").orderBy(at, tie))
    return marked.withColumn("_in", inside).join(offsets, [group, "_hour"]).withColumn(name, (F.col("_in") + F.col("_offset")).cast("int")).drop("_hour", "_in", "_offset")


def insert_counts(rows: DataFrame, stored: DataFrame, outlets: DataFrame) -> DataFrame:
    """One row: fetched (all records) and inserted (known outlet, new key)."""
    known = rows.join(outlets.where("active").select("domain"), "domain", "left_semi")
    fetched = rows.agg(F.count("*").alias("fetched"))
    inserted = new_articles(known, stored).agg(F.count("*").alias("inserted"))
    return fetched.crossJoin(inserted)  # two one-row aggregates


def enrich_once(stored: DataFrame, batch: DataFrame, key: str = "url_key") -> DataFrame:
    """Stored rows filled in from a batch that has the same articles: `about` and `names` together, only where both
    are empty; `themes` only where empty. `names_filled` and `themes_filled` mark the rows whose places, mentions or
    tags must follow.

    The first arrival that brings something wins, separately for the two kinds of data.
    """
    named = (F.size("about") > 0) | (F.size("names") > 0)
    themed = F.size(F.map_keys("themes")) > 0
    got = batch.groupBy(key).agg(
        F.min_by(F.struct("about", "names"), F.when(named, F.col("arrival"))).alias("_named"),
        F.min_by("themes", F.when(themed, F.col("arrival"))).alias("_themes"),
        F.min(F.when(named, F.col("arrival"))).alias("_has_named"), F.min(F.when(themed, F.col("arrival"))).alias("_has_themes"))
    rows = stored.join(got, key, "left")
    fill_names = F.coalesce((F.size("about") == 0) & (F.size("names") == 0) & F.col("_has_named").isNotNull(), F.lit(False))
    fill_themes = F.coalesce((F.size(F.map_keys("themes")) == 0) & F.col("_has_themes").isNotNull(), F.lit(False))
    keep = [c for c in stored.columns if c not in ("about", "names", "themes")]
    return rows.select(
        *keep,
        F.when(fill_names, F.col("_named.about")).otherwise(F.col("about")).alias("about"),
        F.when(fill_names, F.col("_named.names")).otherwise(F.col("names")).alias("names"),
        F.when(fill_themes, F.col("_themes")).otherwise(F.col("themes")).alias("themes"),
        fill_names.alias("names_filled"), fill_themes.alias("themes_filled"))


def prune(articles: DataFrame, now: datetime, days: int, column: str = "seen") -> DataFrame:
    """Rows within the retention period; 0 or less keeps everything. On a table partitioned by day this drops
    partitions."""
    return articles if days <= 0 else articles.where(F.col(column) >= F.lit(now - timedelta(days=days)))


# ---------------------------------------------------------------- windows and progress

def group_starts(members: DataFrame, cursors: DataFrame, last_ok: DataFrame, now: datetime, *,
                 backfill: timedelta, overlap: timedelta, catch_up: timedelta) -> DataFrame:
    """(group, start, turn): where each group's next window begins, most-behind group first.

    `members` is (group, domain), `cursors` (domain, window_end), `last_ok` one row (window_end, may be null). A member
    that fell behind resumes at most `catch_up` ago; a new one starts after the last full run, at most `backfill` ago.
    """
    catch_up = min(catch_up, backfill)
    fallback = F.greatest(F.coalesce(F.col("_ok") - F.expr(_interval(overlap)), F.lit(now - backfill)), F.lit(now - backfill))
    own = F.greatest(F.col("window_end") - F.expr(_interval(overlap)), F.lit(now - catch_up))
    rows = members.join(cursors.select("domain", "window_end"), "domain", "left").crossJoin(
        F.broadcast(last_ok.agg(F.max("window_end").alias("_ok"))))  # one row
    starts = rows.groupBy("group").agg(F.min(F.when(F.col("window_end").isNotNull(), own).otherwise(fallback)).alias("start"))
    return starts.withColumn("turn", F.row_number().over(Window.orderBy("start", "group")))  # one row per group


def _interval(span: timedelta) -> str:
    return f"INTERVAL '{int(span.total_seconds())}' SECOND"


def progress(results: DataFrame) -> DataFrame:
    """(group, window_end, ok): how far each group got. `results` is (group, turn, slice, window_end, error,
    throttled) in the order they were fetched; a group stops at its first error and a throttled error ends the run."""
    failed = F.when(F.col("error"), F.col("slice"))
    first = results.groupBy("group").agg(F.min(failed).alias("_first"), F.min_by("throttled", failed).alias("_throttled"), F.min("turn").alias("_turn"))
    stop = first.where(F.col("_first").isNotNull() & F.col("_throttled")).agg(F.min("_turn").alias("_stop"))
    live = first.crossJoin(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col("_turn") <= F.col("_stop")))  # one row
    rows = results.join(live.select("group", "_first"), "group")
    good = F.col("_first").isNull() | (F.col("slice") < F.col("_first"))
    return rows.groupBy("group").agg(F.max(F.when(good, F.col("window_end"))).alias("window_end"), F.bool_and(F.col("_first").isNull()).alias("ok"))


def run_status(results: DataFrame, crashed: Column | None = None) -> DataFrame:
    """One row per run: queries, errors and status (ok, partial, failed)."""
    done = results.groupBy("run_id").agg(F.count("*").alias("queries"), F.count_if("error").alias("errors"))
    crash = F.lit(False) if crashed is None else crashed
    status = F.when(crash | (F.col("errors") == F.col("queries")), "failed").when(F.col("errors") > 0, "partial").otherwise("ok")
    return done.withColumn("status", status)


def close_stale(runs: DataFrame, source: str) -> DataFrame:
    stale = (F.col("source") == source) & (F.col("status") == "running")
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def behind(outlets: DataFrame, cursors: DataFrame, fresh_after: datetime) -> DataFrame:
    """Active outlets never fetched, or fetched too long ago."""
    rows = outlets.where("active").join(cursors.select("domain", "window_end"), "domain", "left")
    return rows.where(F.col("window_end").isNull() | (F.col("window_end") < F.lit(fresh_after)))


# ---------------------------------------------------------------- dimensions

PINNED = "set in settings"


def sync_outlets(stored: DataFrame, configured: DataFrame, now: datetime) -> DataFrame:
    """The outlet dimension after a configuration change: settings win, missing outlets are deactivated, and a pinned
    item (`pin`: an id, 'none', or null) is set or handed back to automatic matching.

    Both sides have `domain`; one full merge join.
    """
    settings = ["display_name", "country", "language", "aliases", "feeds", "note"]
    old, new = stored.alias("o"), configured.withColumn("_in", F.lit(True)).alias("n")
    rows = old.join(new, F.col("o.domain") == F.col("n.domain"), "full")
    listed = F.coalesce(F.col("n._in"), F.lit(False))
    pin = F.when(F.col("n.pin") == "none", F.lit(None)).otherwise(F.col("n.pin"))
    pinned = F.coalesce(F.col("n.pin"), F.lit("")) != ""
    was_pinned = (F.col("o.match_status") == "manual") & (F.col("o.match_note") == PINNED)
    same = was_pinned & F.col("o.qid").eqNullSafe(pin)
    set_it = listed & pinned & ~F.coalesce(same, F.lit(False))
    clear = listed & ~pinned & F.coalesce(was_pinned, F.lit(False))
    touched = set_it | clear
    pick = [F.when(listed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in settings]
    return rows.select(
        F.coalesce("n.domain", "o.domain").alias("domain"), *pick, listed.alias("active"),
        F.when(set_it, pin).when(clear, F.lit(None)).otherwise(F.col("o.qid")).alias("qid"),
        F.when(set_it, "manual").when(clear, "unmatched").otherwise(F.coalesce("o.match_status", F.lit("unmatched"))).alias("match_status"),
        F.when(set_it, PINNED).when(clear, "").otherwise(F.coalesce("o.match_note", F.lit(""))).alias("match_note"),
        F.when(touched, F.lit(None).cast("timestamp")).otherwise(F.col("o.ownership_checked")).alias("ownership_checked"),
        F.when(listed | F.col("o.active"), F.lit(now)).otherwise(F.col("o.updated")).cast("timestamp").alias("updated"))


def drop_removed_tags(article_tags: DataFrame, tags: DataFrame) -> DataFrame:
    return article_tags.join(tags.select("slug"), "slug", "left_semi")


def due(rows: DataFrame, checked: str, now: datetime, refresh: timedelta, force: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    """Rows never checked or checked too long ago; all of them with `force`; with `only`, those domains whatever their age."""
    if only is not None:
        return rows.where(F.col("domain").isin(list(only)))
    stale = F.col(checked).isNull() | (F.col(checked) < F.lit(now - refresh))
    return rows if force else rows.where(stale)


DOMAIN = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"


def _violations(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(row, rule): every rule a row breaks, in one pass."""
    broken = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules])
    return rows.select(F.col(key).cast("string").alias("row"), F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def outlet_violations(outlets: DataFrame) -> DataFrame:
    """Broken rules of outlet settings (domain, name, country, language, also, feeds, note, wikidata); a domain or alias
    listed by two outlets is reported for each."""
    wrong_alias = F.exists("also", lambda a: ~a.rlike(DOMAIN))
    rules = [
        ("invalid domain", ~F.coalesce(F.col("domain"), F.lit("")).rlike(DOMAIN)),
        ("name is required", _blank("name")),
        ("country must be a 2-letter code", ~F.coalesce(F.col("country"), F.lit("")).rlike("^[A-Z]{2}$")),
        ("language must be a 2-letter code", ~F.coalesce(F.col("language"), F.lit("")).rlike("^[a-z]{2}$")),
        ("invalid alias domain", wrong_alias),
        ("invalid feed address", F.exists("feeds", lambda f: ~url.is_http_url(f))),
        ("note is longer than 300 characters", F.length("note") > 300),
        ("item must be an id or 'none'", ~_blank("wikidata") & (F.col("wikidata") != "none") & ~ids.is_qid(F.col("wikidata"))),
    ]
    listed = outlets.select(F.col("domain").alias("row"), F.explode(F.concat(F.array("domain"), "also")).alias("_d"))
    twice = listed.groupBy("_d").agg(F.count("*").alias("n")).where("n > 1").select("_d")
    repeated = listed.join(twice, "_d", "left_semi").select("row", F.lit("domain listed twice").alias("rule")).distinct()
    return _violations(outlets, "domain", rules).unionByName(repeated)


def tag_violations(tags: DataFrame) -> DataFrame:
    """Broken rules of tag settings (slug, label, themes, sections, min_mentions)."""
    rules = [
        ("invalid slug", ~F.coalesce(F.col("slug"), F.lit("")).rlike("^[a-z0-9]+(-[a-z0-9]+)*$")),
        ("label required", _blank("label")),
        ("needs themes or sections", (F.size("themes") <= 0) & (F.size("sections") <= 0)),
        ("not a theme name", F.exists("themes", lambda x: ~x.rlike("^[A-Z0-9_]+$"))),
        ("min_mentions must be at least 1", F.col("min_mentions") < 1),
    ]
    return _violations(tags, "slug", rules)


def curated_violations(rows: DataFrame) -> DataFrame:
    """Broken rules of curated funding rows (row, outlet, qid, kind, label, amount, currency, source_url, retrieved)."""
    rules = [
        ("give exactly one of outlet or qid", _blank("outlet") == _blank("qid")),
        ("invalid outlet domain", ~_blank("outlet") & ~F.col("outlet").rlike(DOMAIN)),
        ("invalid qid", ~_blank("qid") & ~ids.is_qid(F.upper("qid"))),
        ("unknown kind", ~F.coalesce(F.col("kind"), F.lit("")).isin(*fixed.FUNDING_KINDS[:4])),
        ("label is required", _blank("label")),
        ("amount must not be negative", F.col("amount") < 0),
        ("a 3-letter currency is required with an amount", F.col("amount").isNotNull() & ~F.coalesce(F.upper("currency"), F.lit("")).rlike("^[A-Z]{3}$")),
        ("source address is required", ~url.is_http_url(F.col("source_url"))),
        ("retrieved must be a date", F.expr("try_cast(retrieved as date)").isNull() | ~F.col("retrieved").rlike(r"^\d{4}-\d{2}-\d{2}$")),
    ]
    return _violations(rows, "row", rules)


def correction_violations(rows: DataFrame) -> DataFrame:
    """Broken rules of ownership corrections (row, outlet, entity, action, target, source, checked)."""
    rules = [
        ("give exactly one of outlet or entity", _blank("outlet") == _blank("entity")),
        ("invalid outlet domain", ~_blank("outlet") & ~F.col("outlet").rlike(DOMAIN)),
        ("needs a source address", ~url.is_http_url(F.col("source"))),
        ("checked must be a date", ~F.coalesce(F.col("checked"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$")),
        ("unknown action", ~F.coalesce(F.col("action"), F.lit("")).isin("add_owner", "add_parent", "remove_owner", "remove_parent")),
        ("target is required", _blank("target")),
    ]
    return _violations(rows, "row", rules)


# ---------------------------------------------------------------- data repairs

def _reset(df: DataFrame, test: Column, checked: Column) -> DataFrame:
    """Undated again where `test`. One projection: every column is computed from the row as it was."""
    return df.withColumns({
        "checked": F.when(test, checked).otherwise(F.col("checked")),
        "attempts": F.when(test, 0).otherwise(F.col("attempts")),
        "stated": F.when(~test, F.col("stated")),
        "date_method": F.when(~test, F.col("date_method")),
    })


def repair_implausible(articles: DataFrame) -> DataFrame:
    """Clear dates later than first seen plus an hour, and dates that were a feed's last edit."""
    late = F.col("stated") > F.col("seen") + F.expr("INTERVAL 1 HOUR")
    bad = F.coalesce(F.col("stated").isNotNull() & (late | (F.col("date_method") == "feed updated")), F.lit(False))
    return _reset(articles, bad, F.col("checked"))


def repair_feed_dates(articles: DataFrame) -> DataFrame:
    """Clear all feed-derived dates; the rows stay visible while their page is checked."""
    bad = F.coalesce(F.col("date_method").startswith("feed "), F.lit(False))
    return _reset(articles, bad, F.coalesce("checked", "retrieved"))


def recheck_verdicts(articles: DataFrame, now: datetime) -> DataFrame:
    """Let recent articles with a final negative verdict be checked again."""
    again = F.coalesce(F.col("stated").isNull() & F.col("date_method").isin(fixed.DISALLOWED, fixed.NO_DATE)
                       & (F.col("seen") >= F.lit(now - timedelta(days=3))), F.lit(False))
    return _reset(articles, again, F.lit(None).cast("timestamp"))
