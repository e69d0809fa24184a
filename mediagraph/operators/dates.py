"""Publication dates: candidates, choice, conflicts, explanations, due pages, attempt state, audit."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import fixed, url, when

ARTICLE_TYPE = r"(Article|BlogPosting|Report)( |$)"
TYPED, UNTYPED = "schema.org datePublished", "schema.org datePublished (untyped)"
MAX_ATTEMPTS = 2
SUSPECT_SECONDS = 3 * 3600


def candidates(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, method, raw) of scanned pages, best first. `rank` orders a page's candidates."""
    first = F.map_from_entries(F.filter("meta", lambda m, i: F.array_position(F.transform("meta", lambda x: x["key"]), m["key"]) == i + 1))
    pages = scanned.withColumn("_first", first)
    named = [("article:published_time", "article:published_time"), ("og:article:published_time", "article:published_time"),
             ("itemprop:datepublished", "itemprop datePublished"), *[(n, f"meta {n}") for n in fixed.DATE_META]]
    cand = lambda order, pos, method, raw: F.struct(F.lit(order).alias("group"), pos.cast("int").alias("pos"), F.lit(method).alias("method"), raw.alias("raw"))
    typed = F.filter(F.transform("dates", lambda d, i: F.when(d["types"].rlike(ARTICLE_TYPE), cand(0, i, TYPED, d["value"]))), lambda c: c.isNotNull())
    untyped = F.transform("dates", lambda d, i: cand(2, i, UNTYPED, d["value"]))
    tags = F.filter(
        F.array(*[F.when(F.try_element_at("_first", F.lit(k)).isNotNull(), cand(1, F.lit(n), method, F.try_element_at("_first", F.lit(k))))
                  for n, (k, method) in enumerate(named)]), lambda c: c.isNotNull())
    rows = pages.select(*keys, F.explode(F.concat(typed, tags, untyped)).alias("c"))
    return rows.select(*keys, F.struct("c.group", "c.pos").alias("rank"), "c.method", "c.raw")


def _plausible(at: Column, seen: Column) -> Column:
    return at.between(F.lit(when.EARLIEST).cast("timestamp"), seen + F.expr("INTERVAL 1 HOUR"))


def choose(cands: DataFrame, seen: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, at, method, conflict): the first plausible candidate; no date at all when two of the page's own tags are a
    whole number of hours apart (up to 14): the page gets a time zone wrong and either may be the wrong one.

    Pages without a usable candidate are not in the result. A page has a handful of candidates.
    """
    rows = cands.withColumn("_at", when.parse_zoned_ts(F.col("raw"))).where(F.col("_at").isNotNull()).join(seen.select(key, "seen"), key)
    good = _plausible(F.col("_at"), F.col("seen"))
    own = F.col("method") != UNTYPED
    # First parsed value of each of the page's own methods, whether plausible or not.
    per_method = rows.groupBy(key, "method").agg(
        F.min_by("_at", "rank").alias("_first"), F.min_by(F.struct(F.col("_at").alias("at"), F.col("method").alias("method")), F.when(good, F.col("rank"))).alias("_pick"),
        F.min(F.when(good, F.col("rank"))).alias("_rank"), F.bool_or(own).alias("_own"))
    page = per_method.groupBy(key).agg(
        F.min_by("_pick", "_rank").alias("pick"), F.collect_list(F.when(F.col("_own"), F.unix_micros("_first"))).alias("_own"))
    hour = 3_600_000_000
    apart = lambda a, b: (F.abs(a - b) > 0) & (F.abs(a - b) <= 14 * hour) & (F.abs(a - b) % hour == 0)
    clash = F.exists("_own", lambda a: F.exists("_own", lambda b: apart(a, b)))
    return page.where(F.col("pick").isNotNull()).select(
        key, F.when(~clash, F.col("pick.at")).alias("at"), F.when(~clash, F.col("pick.method")).alias("method"), clash.alias("conflict"))


def explain(cands: DataFrame, seen: DataFrame, chosen: DataFrame, key: str = "page_id") -> DataFrame:
    """Every candidate with what became of it."""
    picked = chosen.select(key, F.col("at").alias("_used_at"), F.col("method").alias("_used"), F.col("conflict").alias("_clash"))
    rows = cands.join(seen.select(key, "seen"), key).join(picked, key, "left").withColumn("at", when.parse_zoned_ts(F.col("raw")))
    used = F.coalesce((F.col("_used") == F.col("method")) & (F.col("_used_at") == F.col("at")), F.lit(False))
    why = (
        F.when(F.col("at").isNull(), "rejected: not a full date-time with a time zone")
        .when(F.col("at") > F.col("seen") + F.expr("INTERVAL 1 HOUR"), "rejected: later than the article was first seen")
        .when(F.col("at") < F.lit(when.EARLIEST).cast("timestamp"), "rejected: before 1995")
        .when(F.coalesce(F.col("_clash"), F.lit(False)), "valid on its own")
        .when(used, "USED").otherwise("valid (a higher-priority tag was used)"))
    return rows.select(*cands.columns, "at", why.alias("outcome"))


def section_labels(scanned: DataFrame) -> DataFrame:
    """Scanned pages with `sections`: their own section and topic labels in page order, lists taken apart, once each."""
    listed = lambda e: e["key"].isin(*fixed.LIST_META, "keywords")
    parts = F.flatten(F.transform("labels", lambda e: F.when(listed(e), F.split(e["value"], ",")).otherwise(F.array(e["value"]))))
    tidy = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return scanned.withColumn("sections", F.array_distinct(F.filter(tidy, lambda p: p != "")))


def due_pages(articles: DataFrame, now: datetime, limit: int | None = None, max_age: timedelta = timedelta(days=3)) -> DataFrame:
    """Recent undated articles worth a check, newest first; with `limit`, the caller's crawl quota, a top-k."""
    rows = articles.where(
        F.col("stated").isNull() & (F.col("attempts") < MAX_ATTEMPTS) & (F.col("seen") >= F.lit(now - max_age))
        & (F.col("checked").isNull() | (F.col("checked") < F.lit(now - timedelta(hours=1)))))
    rows = rows.orderBy(F.desc("seen"), F.desc("article_id"))
    return rows if limit is None else rows.limit(limit)


def attempt_state(fetched: DataFrame) -> DataFrame:
    """What one pass records. `fetched` is (article_id, url, turn, verdict, status, at, method, conflict, attempts): in turn order, what
    the crawl rules say and how the fetch went (`status` 200 when a page was read).

    A host is left alone for the rest of the pass after 401, 403, 429, 5xx or an unreadable robots file: rows after the first
    such one are `skipped`. Found by one aggregate per host and a join, so a host with very many rows is
    not one task.
    """
    rows = fetched.withColumn("host", url.host_of(F.col("url")))
    asked = F.col("verdict") == "allowed"
    blocks = (F.col("verdict") == "unavailable") | (asked & (F.col("status").isin(401, 403, 429) | (F.col("status") >= 500)))
    stops = rows.where(blocks).groupBy("host").agg(F.min("turn").alias("_stop"))
    rows = rows.join(stops, "host", "left")
    skipped = F.coalesce(F.col("turn") > F.col("_stop"), F.lit(False)) | (F.col("verdict") == "unavailable")
    read = asked & (F.col("status") == 200)
    outcome = (
        F.when(skipped, "skipped").when(F.col("verdict") == "disallowed", "disallowed").when(~read, "failed")
        .when(F.coalesce(F.col("conflict"), F.lit(False)), "conflict").when(F.col("at").isNotNull(), "found").otherwise("no date"))
    done = rows.withColumn("outcome", outcome)
    final = F.col("outcome").isin("disallowed", "conflict", "no date")
    method = (F.when(F.col("outcome") == "found", F.col("method")).when(F.col("outcome") == "conflict", fixed.ZONE_CONFLICT)
              .when(F.col("outcome") == "no date", fixed.NO_DATE).when(F.col("outcome") == "disallowed", fixed.DISALLOWED))
    attempts = F.when(F.col("outcome") == "skipped", F.col("attempts")).when(final, MAX_ATTEMPTS).otherwise(F.col("attempts") + 1)
    return done.select("article_id", "outcome", attempts.alias("attempts"), method.alias("date_method"),
                       F.when(F.col("outcome") == "found", F.col("at")).alias("stated"))


def audit(articles: DataFrame, now: datetime, days: int = 7, undated: bool = True) -> DataFrame:
    """(domain, origin, dated, median_lag, early, zone_conflicts, suspect, place): stated dates against when articles were first
    seen. The median is the upper one. Outlets whose pages have conflicts and no dates are listed too, unless not `undated`.

    Lags are counted per second first; the median is then read off a running count over distinct lags, so no
    outlet's articles are gathered in one place.
    """
    recent = articles.where(F.col("seen") >= F.lit(now - timedelta(days=days)))
    feed = F.coalesce(F.col("date_method").startswith("feed "), F.lit(False))
    lag = F.unix_seconds("seen") - F.unix_seconds("stated")
    counted = recent.where(F.col("stated").isNotNull()).groupBy("domain", F.when(feed, "feed").otherwise("page").alias("origin"), lag.alias("lag")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("domain", "origin")
    so_far = F.sum("n").over(group.orderBy("lag"))
    ranked = counted.withColumn("_upto", so_far).withColumn("_all", F.sum("n").over(group))
    dated = ranked.groupBy("domain", "origin").agg(
        F.max("_all").alias("dated"), F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("lag"))).alias("median_lag"),
        F.sum(F.when(F.col("lag") > SUSPECT_SECONDS, F.col("n")).otherwise(0)).alias("early"))
    clash = recent.where(F.col("stated").isNull() & (F.col("date_method") == fixed.ZONE_CONFLICT)).groupBy("domain").agg(F.count("*").alias("zone_conflicts"))
    both = dated.join(clash.withColumn("origin", F.lit("page")), ["domain", "origin"], "full" if undated else "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = both.select("domain", "origin", zero("dated"), zero("median_lag"), zero("early"), zero("zone_conflicts"))
    out = out.withColumn("suspect", (F.col("dated") >= 5) & (F.col("median_lag") >= SUSPECT_SECONDS))
    order = Window.orderBy(F.desc("suspect"), F.desc("zone_conflicts"), "domain", "origin")  # two rows per outlet at most
    return out.withColumn("place", F.row_number().over(order))
