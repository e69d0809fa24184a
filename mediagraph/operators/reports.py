"""Reports that put several operators together: coverage by owner, owners' topics, mentions and flags, places, story pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.operators import graph, load


def coverage_by_owner(edges: DataFrame, entities: DataFrame, outlets: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per outlet: owners (its owner group), matched, display_name, articles, and group_articles, the sum over all outlets of the group.

    Outlets without an entity are one group, matched outlets without an owner another. Sums are pre-aggregated and joined back, so that no
    group, however many outlets it has, is gathered in one row.
    """
    groups = graph.owner_groups(edges, entities, outlets.where(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("base")))
    rows = counts.hint("merge").join(outlets, "outlet_id").hint("merge").join(groups.withColumnRenamed("base", "entity_id"), "entity_id", "left")
    rows = rows.withColumn("matched", F.col("entity_id").isNotNull()).withColumn("_group", F.xxhash64("owners", "matched"))
    sums = rows.groupBy("_group").agg(F.sum("articles").alias("group_articles"))
    return rows.hint("merge").join(sums, "_group").select("owners", "matched", "group_articles", "outlet_id", "display_name", "articles")


def owner_topics(edges: DataFrame, owner: DataFrame, outlets: DataFrame, articles: DataFrame, most: int, below: DataFrame | None = None) -> DataFrame:
    """(tag, n): the most frequent tags of articles of outlets at or below an owner."""
    below = graph.reach(graph.current(edges), owner.select(F.col("entity_id").alias("root")), up=False) if below is None else below
    own = outlets.join(below.select(F.col("node").alias("entity_id")), "entity_id", "left_semi").select("outlet_id")
    recent = articles.join(own, "outlet_id", "left_semi")
    return recent.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)


def owner_mentions(articles: DataFrame, outlets: DataFrame, named: DataFrame, edges: DataFrame, entities: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Articles naming something above their own outlet, with the shortest chain from it down to the outlet."""
    roots = outlets.where(F.col("entity_id").isNotNull()).select("outlet_id", F.col("entity_id").alias("root"))
    above = (graph.walk(graph.current(edges), entities, roots.select("root")) if above is None else above).where("depth > 0")
    chains = above.select("root", F.col("node").alias("entity_id"), F.reverse("path").alias("path"))
    return articles.join(roots, "outlet_id").join(named, "article_id").join(chains, ["root", "entity_id"])


def report_flags(outlets: DataFrame, entities: DataFrame, edges: DataFrame, site_mark: str = ".") -> DataFrame:
    """Per outlet, what is worth checking: no item, no owner, or an item that is the website rather than the outlet."""
    owned = graph.current(edges).select(F.col("child").alias("entity_id"), F.lit(True).alias("_owned")).distinct()
    rows = outlets.join(entities.select("entity_id", "name", "description"), "entity_id", "left").join(owned, "entity_id", "left")
    about = F.lower(F.coalesce("description", F.lit("")))
    site = F.col("name").contains(site_mark) | about.contains("website of") | about.contains("web portal")
    first = F.when(F.col("name").isNull(), "no item").when(F.col("_owned").isNull(), "no owner listed").otherwise("")
    flags = F.concat(first, F.when(F.coalesce(site, F.lit(False)), ";website item").otherwise(""))
    return rows.withColumn("flags", flags).withColumn("flagged", flags != "")


def place_options(article_places: DataFrame, articles: DataFrame, names: DataFrame, pinned: list, now: datetime) -> DataFrame:
    """Countries at least three recent stories are about; the pinned ones always, first."""
    recent = articles.where(F.col("seen") >= F.lit(now - timedelta(days=30))).select("article_id")
    busy = article_places.join(recent, "article_id", "left_semi").groupBy("country").agg(F.count("*").alias("n")).where(F.col("n") >= 3)
    always = names.where(F.col("country").isin(pinned)).select("country", "name", F.lit(1).alias("pinned"))
    rest = busy.where(~F.col("country").isin(pinned)).join(names, "country").select("country", "name", F.lit(0).alias("pinned"))
    return always.unionByName(rest)


def story_pages(linked: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Every story's members in shown order, with how many articles their outlet has in it."""
    rows = linked.join(articles.withColumn("shown", F.coalesce("stated", "seen")), "article_id").join(outlets.select("outlet_id", "display_name"), "outlet_id")
    per_outlet = rows.groupBy("story_id", "outlet_id").agg(F.count("*").alias("from_outlet"))
    return load.rank_in_group(rows, "story_id", "shown", "article_id", "place").join(per_outlet, ["story_id", "outlet_id"])
