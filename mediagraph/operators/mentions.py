"""Which items of the ownership records an article names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import text as tx


def name_index(entities: DataFrame) -> DataFrame:
    """(key, qid): names that stand for exactly one item; ambiguous ones are left out."""
    keys = entities.select("qid", F.explode(tx.alias_keys(F.col("name"), F.col("aliases"))).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("_n"), F.min("qid").alias("qid")).where(F.col("_n") == 1).drop("_n")


def own_keys(outlets: DataFrame, entities: DataFrame) -> DataFrame:
    """(domain, key): what an outlet itself goes by, in any of its item's names, its display name and its first label."""
    names = entities.select("entity_id", F.concat(F.array("name"), "aliases").alias("_names"))
    rows = outlets.select("domain", "display_name", "entity_id").join(names, "entity_id", "left")
    label = F.get(F.split("domain", r"\."), F.lit(0))
    every = F.concat(F.coalesce("_names", F.array().cast("array<string>")), F.array("display_name", label))
    return rows.select("domain", F.explode(every).alias("name")).select("domain", tx.name_key(F.col("name")).alias("key")).where("key <> ''").distinct()


def match_names(named: DataFrame, index: DataFrame, own: DataFrame) -> DataFrame:
    """(article_id, qid, mentions) from (article_id, domain, name, count).

    Each distinct spelling is keyed once. Counts are added per key before the joins, so a name half the articles use costs one
    row per article, and the index is joined by key (broadcast by size when it is small).
    """
    spelt = named.select("name").distinct().select("name", tx.name_key(F.col("name")).alias("key")).where("key <> ''")
    hits = spelt.join(index, "key")
    counted = named.join(hits, "name").groupBy("article_id", "domain", "key", "qid").agg(F.sum("count").alias("mentions"))
    others = counted.join(own, ["domain", "key"], "left_anti")
    return others.groupBy("article_id", "qid").agg(F.sum("mentions").alias("mentions"))


def add_mentions(stored: DataFrame, found: DataFrame) -> DataFrame:
    """First write wins: what is stored stays, new (article, item) pairs are added."""
    return stored.unionByName(found.join(stored.select("article_id", "qid"), ["article_id", "qid"], "left_anti"))
