"""Feed pages, filters, counts and orders over the articles binding."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import when
from mediagraph.operators import feed, reports
from mediagraph.operators.feed import FeedFilters, FeedTables
from mediagraph.plans.bindings import Tables
from mediagraph.plans.registry import query

NOW = datetime(2024, 1, 31)
ZONE = "-05:00"
AO = ("b_articles", "b_outlets")

# Articles with their outlet and shown time, and the cap over them.
JOINED = """, joined AS (SELECT a.*, coalesce(a.stated, a.seen) AS shown, o.domain, o.display_name, o.country, o.entity_id, o.active
  FROM b_articles a JOIN b_outlets o ON o.outlet_id = a.outlet_id)"""
RANKED = JOINED + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY outlet_id, date_trunc('hour', shown)
  ORDER BY shown DESC, article_id DESC) AS n FROM joined)"""


def tables(t: Tables) -> FeedTables:
    named = t.mentions.select("article_id", "entity_id").distinct()
    return FeedTables(
        articles=t.articles.withColumn("title", F.col("tag")).withColumn("about", F.lit("")),
        outlets=t.outlets, tags=t.articles.select("article_id", F.col("tag").alias("slug")),
        places=t.mentions.select("article_id", F.col("country").cast("string").alias("country")),
        mentions=named, edges=t.edges, entities=t.entities, own=t.own)


def brief(rows: DataFrame) -> DataFrame:
    return rows.select("article_id", "outlet_id", "display_name", "shown", when.date_kind(F.col("stated")).alias("date_kind"))


BRIEF = "article_id, outlet_id, display_name, shown, CASE WHEN stated IS NOT NULL THEN 'published' ELSE 'seen' END AS date_kind"


@query("feed_balanced_newest", AO, RANKED + f"SELECT {BRIEF} FROM ranked WHERE n <= 3 ORDER BY shown DESC, article_id DESC LIMIT 50")
def _(t: Tables) -> DataFrame:
    return brief(t.feed.page(t.outlets, FeedFilters())[0])


@query("feed_capped_all", AO, RANKED + f"SELECT {BRIEF} FROM ranked WHERE n <= 3")
def _(t: Tables) -> DataFrame:
    return brief(feed.capped(feed.matching(tables(t), FeedFilters())))


@query("feed_page_7_oldest", AO, JOINED + f"SELECT {BRIEF} FROM joined ORDER BY shown, article_id LIMIT 25 OFFSET 150")
def _(t: Tables) -> DataFrame:
    f = FeedFilters.parse({"sort": "oldest", "per": "25", "page": "7", "mix": "all"})
    return brief(t.feed.page(t.outlets, f)[0])


@query("feed_outlet_order", AO, RANKED + f"SELECT {BRIEF} FROM ranked WHERE n <= 3 ORDER BY lower(display_name), shown DESC, article_id DESC LIMIT 100")
def _(t: Tables) -> DataFrame:
    f = FeedFilters.parse({"sort": "outlet", "per": "100"})
    return brief(feed.feed_page(tables(t), f)[0])


@query("feed_outlet_filter", AO, JOINED + f"SELECT {BRIEF} FROM joined WHERE domain = 's3.example.com'")
def _(t: Tables) -> DataFrame:
    return brief(feed.matching(tables(t), FeedFilters.parse({"outlet": "S3.example.com"})))


@query("feed_country_filter", AO, JOINED + f"SELECT {BRIEF} FROM joined WHERE country = (SELECT min(country) FROM b_outlets)")
def _(t: Tables) -> DataFrame:
    ft = tables(t)
    first = t.outlets.agg(F.min("country").cast("string")).first()[0]
    return brief(feed.matching(replace(ft, outlets=ft.outlets.withColumn("country", F.col("country").cast("string"))), FeedFilters(country=first)))


@query("feed_date_range", AO, JOINED + f"""SELECT {BRIEF}, CAST(shown - INTERVAL '5' HOUR AS DATE) AS local_day FROM joined
WHERE shown >= TIMESTAMP '2024-01-05 05:00:00' AND shown < TIMESTAMP '2024-01-12 05:00:00'""")
def _(t: Tables) -> DataFrame:
    f = FeedFilters.parse({"from": "2024-01-11", "to": "2024-01-05"})  # the wrong way round: swapped
    rows = t.feed.rows(t.outlets, f, ZONE)
    return brief(rows).withColumn("local_day", when.local_day(F.col("shown"), ZONE))


@query("feed_local_days", AO, JOINED + """SELECT CAST(shown - INTERVAL '5' HOUR AS DATE) AS local_day, count(*) AS articles,
count(DISTINCT date_trunc('hour', shown)) AS hours FROM joined GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = feed.matching(tables(t), FeedFilters())
    return rows.groupBy(when.local_day(F.col("shown"), ZONE).alias("local_day")).agg(
        F.count("*").alias("articles"), F.count_distinct(when.utc_hour(F.col("shown"))).alias("hours"))


@query("feed_tag_filter", AO, JOINED + f"SELECT {BRIEF} FROM joined WHERE EXISTS (SELECT 1 FROM b_articles x WHERE x.article_id = joined.article_id AND x.tag = 'click')")
def _(t: Tables) -> DataFrame:
    return brief(feed.matching(tables(t), FeedFilters.parse({"tag": "Click"})))


@query("feed_place_filter", ("b_articles", "b_outlets", "b_mentions"), JOINED + f"""SELECT {BRIEF} FROM joined
WHERE EXISTS (SELECT 1 FROM b_mentions m WHERE m.article_id = joined.article_id AND m.country IN (3, 7, 11))""")
def _(t: Tables) -> DataFrame:
    # A group of places stands for its members: here nations 3, 7 and 11 are named as three of its countries, the others as none.
    ft = tables(t)
    code = F.when(F.col("country") == 3, "FR").when(F.col("country") == 7, "GM").when(F.col("country") == 11, "EI").otherwise("CA")
    return brief(feed.matching(replace(ft, places=t.mentions.select("article_id", code.alias("country"))), FeedFilters.parse({"place": "eu"})))


@query("feed_owner_subtree", ("b_articles", "b_outlets", "b_edges"), JOINED + f""", below(node) AS (SELECT CAST(7 AS BIGINT)
UNION SELECT e.child FROM b_edges e JOIN below b ON e.parent = b.node)
SELECT {BRIEF} FROM joined WHERE entity_id IN (SELECT node FROM below)""")
def _(t: Tables) -> DataFrame:
    return brief(feed.matching(tables(t), FeedFilters.parse({"owner": "q8"})))


UP_ALL = """, up(root, node) AS (SELECT DISTINCT o.entity_id, e.parent FROM b_outlets o JOIN b_edges e ON e.child = o.entity_id AND e.source <> 'set_aside'
UNION SELECT u.root, e.parent FROM up u JOIN b_edges e ON e.child = u.node AND e.source <> 'set_aside')"""


@query("feed_names_own_owner", ("b_articles", "b_outlets", "b_mentions", "b_edges"), JOINED + UP_ALL + f"""
SELECT {BRIEF} FROM joined WHERE EXISTS (SELECT 1 FROM b_mentions m JOIN up ON up.node = m.entity_id
WHERE m.article_id = joined.article_id AND up.root = joined.entity_id)""")
def _(t: Tables) -> DataFrame:
    return brief(feed.matching(tables(t), FeedFilters.parse({"mentions": "owner"})))


HOLD_AT = datetime(2024, 1, 15, 12)
VISIBLE = "(retrieved <= {t} AND (coalesce(checked, TIMESTAMP '9999-01-01 00:00:00') <= {t} OR retrieved <= {t} - INTERVAL '15' MINUTE))"
AT = VISIBLE.format(t="TIMESTAMP '2024-01-15 12:00:00'")


@query("feed_visible_at", AO, JOINED + f"""SELECT outlet_id, count(*) AS collected, CAST(sum(CAST({AT} AS INT)) AS BIGINT) AS shown_then,
CAST(sum(CAST(retrieved < TIMESTAMP '2024-01-15 12:00:00' AS INT)) AS BIGINT) AS strictly FROM joined GROUP BY outlet_id""")
def _(t: Tables) -> DataFrame:
    rows = feed.matching(tables(t), FeedFilters())
    return rows.groupBy("outlet_id").agg(
        F.count("*").alias("collected"),
        F.sum(feed.visible(HOLD_AT, timedelta(minutes=15)).cast("int")).alias("shown_then"),
        F.sum(feed.visible(HOLD_AT, strict=True).cast("int")).alias("strictly"))


@query("feed_new_since", AO, JOINED + f""", vis AS (SELECT *, row_number() OVER (PARTITION BY outlet_id, date_trunc('hour', shown)
ORDER BY shown DESC, article_id DESC) AS n FROM joined WHERE {AT})
SELECT count(*) AS fresh FROM vis WHERE n <= 3 AND NOT (retrieved < TIMESTAMP '2024-01-15 06:00:00' AND
(coalesce(checked, TIMESTAMP '9999-01-01 00:00:00') < TIMESTAMP '2024-01-15 06:00:00' OR retrieved < TIMESTAMP '2024-01-15 05:45:00'))""")
def _(t: Tables) -> DataFrame:
    hold = timedelta(minutes=15)
    rows = feed.matching(tables(t), FeedFilters(), shown_if=feed.visible(HOLD_AT, hold))
    return feed.count_new(rows, datetime(2024, 1, 15, 6), hold)


@query("feed_counts_per_outlet", AO, RANKED + """SELECT outlet_id, CAST(sum(CAST(n <= 3 AS INT)) AS BIGINT) AS articles, CAST(sum(CAST(n > 3 AS INT)) AS BIGINT) AS hidden
FROM ranked GROUP BY outlet_id""")
def _(t: Tables) -> DataFrame:
    return t.feed.counts_per_outlet(t.outlets)


@query("feed_totals", AO, RANKED + "SELECT CAST(sum(CAST(n <= 3 AS INT)) AS BIGINT) AS total, CAST(sum(CAST(n > 3 AS INT)) AS BIGINT) AS hidden FROM ranked")
def _(t: Tables) -> DataFrame:
    return t.feed.totals(t.outlets)


@query("feed_pages_all", AO, RANKED + """SELECT article_id, CAST(floor((row_number() OVER (ORDER BY shown DESC, article_id DESC) - 1) / 50) + 1 AS BIGINT) AS page
FROM ranked WHERE n <= 3""")
def _(t: Tables) -> DataFrame:
    rows = feed.positions(feed.capped(feed.matching(tables(t), FeedFilters())), "newest")
    return rows.select("article_id", (F.floor(F.col("position") / 50) + 1).cast("bigint").alias("page"))


@query("feed_day_groups", AO, RANKED + """, page AS (SELECT *, CAST(CAST(shown - INTERVAL '5' HOUR AS DATE) AS VARCHAR) AS heading FROM ranked
WHERE n <= 3 ORDER BY shown DESC, article_id DESC LIMIT 100)
SELECT article_id, heading, CAST(dense_rank() OVER (ORDER BY heading DESC) AS BIGINT) AS group_no FROM page""")
def _(t: Tables) -> DataFrame:
    page = t.feed.page(t.outlets, FeedFilters(per=100))[0]
    return feed.headed_groups(page, "newest", ZONE).select("article_id", "heading", "group_no")


@query("feed_spread_all_pages")
def _(t: Tables) -> DataFrame:
    return feed.spread(feed.capped(feed.matching(tables(t), FeedFilters())))


@query("outlet_recent_20", AO, JOINED + """, r AS (SELECT article_id, outlet_id, shown, row_number() OVER (PARTITION BY outlet_id ORDER BY shown DESC, article_id DESC) AS place FROM joined)
SELECT * FROM r WHERE place <= 20""")
def _(t: Tables) -> DataFrame:
    return feed.recent_per_outlet(feed.matching(tables(t), FeedFilters())).select("article_id", "outlet_id", "shown", "place")


COUNTS = """, counts AS (SELECT outlet_id, count(*) AS total, CAST(sum(CAST(seen >= TIMESTAMP '2024-01-01 00:00:00' AS INT)) AS BIGINT) AS recent FROM b_articles GROUP BY outlet_id)"""


def article_counts(t: Tables, now: datetime = NOW) -> DataFrame:
    """All articles per outlet and those seen in the last 30 days."""
    return t.articles.groupBy("outlet_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("seen") >= F.lit(now - timedelta(days=30))).alias("recent"))


@query("outlet_article_counts", ("b_articles",), COUNTS + "SELECT * FROM counts")
def _(t: Tables) -> DataFrame:
    return article_counts(t)


@query("outlet_table_sorts", AO, COUNTS + """SELECT o.outlet_id, o.display_name, o.country, coalesce(c.recent, 0) AS recent,
row_number() OVER (ORDER BY lower(display_name), o.outlet_id) AS by_name,
row_number() OVER (ORDER BY country, lower(display_name), o.outlet_id) AS by_country,
row_number() OVER (ORDER BY coalesce(c.recent, 0) DESC, lower(display_name), o.outlet_id) AS by_articles
FROM b_outlets o LEFT JOIN counts c ON c.outlet_id = o.outlet_id WHERE o.active""")
def _(t: Tables) -> DataFrame:
    rows = t.outlets.where("active").join(article_counts(t), "outlet_id", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    name = [F.lower("display_name"), F.col("outlet_id")]
    place = lambda *keys: F.row_number().over(Window.orderBy(*keys))  # noqa: E731 - the outlet dimension
    return rows.select("outlet_id", "display_name", "country", "recent", place(*name).alias("by_name"),
                       place(F.col("country"), *name).alias("by_country"), place(F.desc("recent"), *name).alias("by_articles"))


@query("outlet_list_counts", AO, """SELECT o.outlet_id, o.domain, o.active,
(SELECT count(*) FROM b_articles a WHERE a.outlet_id = o.outlet_id) AS articles,
(SELECT count(*) FROM b_articles a WHERE a.outlet_id = o.outlet_id AND a.seen >= TIMESTAMP '2024-01-30 00:00:00') AS last_day FROM b_outlets o""")
def _(t: Tables) -> DataFrame:
    counts = t.articles.groupBy("outlet_id").agg(
        F.count("*").alias("articles"), F.count_if(F.col("seen") >= F.lit(NOW - timedelta(days=1))).alias("last_day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return t.outlets.join(counts, "outlet_id", "left").select("outlet_id", "domain", "active", zero("articles"), zero("last_day"))


@query("owner_topics", ("b_articles", "b_outlets", "b_edges"), """, below(node) AS (SELECT CAST(7 AS BIGINT) UNION
SELECT e.child FROM b_edges e JOIN below b ON e.parent = b.node AND e.source <> 'set_aside')
SELECT a.tag, count(*) AS n FROM b_articles a JOIN b_outlets o ON o.outlet_id = a.outlet_id
WHERE o.entity_id IN (SELECT node FROM below) AND a.seen >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY a.tag ORDER BY n DESC, a.tag LIMIT 12""")
def _(t: Tables) -> DataFrame:
    owner = t.entities.where(F.col("entity_id") == 7)
    below = t.own.below(owner.select(F.col("entity_id").alias("root")))
    return reports.owner_topics(t.edges, owner, t.outlets, t.articles.where(F.col("seen") >= F.lit(NOW - timedelta(days=30))), most=12, below=below)


@query("place_options", ("b_articles", "b_mentions"), """, n AS (SELECT m.country, count(*) AS stories FROM (SELECT DISTINCT article_id, country FROM b_mentions) m
JOIN b_articles a ON a.article_id = m.article_id WHERE a.seen >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY m.country HAVING count(*) >= 3)
SELECT x.country, na.n_name AS name, x.pinned FROM (SELECT country, 1 AS pinned FROM (VALUES (3), (7)) v(country)
UNION ALL SELECT country, 0 FROM n WHERE country NOT IN (3, 7)) x JOIN nation na ON na.n_nationkey = x.country""")
def _(t: Tables) -> DataFrame:
    places = t.mentions.select("article_id", "country").distinct()
    return reports.place_options(places, t.articles, t.read("nation").select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("name")), [3, 7], NOW)
