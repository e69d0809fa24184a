"""What an article is about, from counted mentions: themes, places, people, names.

Each operator takes mention rows (article_id, pos, ...) and aggregates before it ranks. The `*_column` functions do the
same inside one record for the raw line scan, where mentions arrive packed in one text field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import fixed
from mediagraph.functions import text as tx

MIN_MENTIONS, MIN_SHARE, MAX_PLACES, MAX_PEOPLE, MAX_NAMES = 2, 0.25, 3, 5, 8
THEME = r"^[A-Z0-9_]{1,120}$"
NAME = r"^\p{L}[\p{L}\p{N}_ .'\-]{1,80}$"


def theme_counts(mentions: DataFrame) -> DataFrame:
    """(article_id, theme, n) of well-formed theme names."""
    return mentions.where(F.col("theme").rlike(THEME)).groupBy("article_id", "theme").agg(F.count("*").alias("n"))


def theme_maps(counts: DataFrame) -> DataFrame:
    packed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("theme").alias("key"), F.col("n").alias("value")))))
    return counts.groupBy("article_id").agg(packed.alias("themes"))


def main_places(mentions: DataFrame) -> DataFrame:
    """(article_id, country, mentions): at least two mentions and a quarter of all places named; the top three."""
    counted = mentions.groupBy("article_id", "country").agg(F.count("*").alias("mentions"))
    # Windows below run over one article's distinct countries, after the counts.
    total = F.sum("mentions").over(Window.partitionBy("article_id"))
    rank = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("mentions"), "country"))
    kept = counted.withColumn("_total", total).where((F.col("mentions") >= MIN_MENTIONS) & (F.col("mentions") >= MIN_SHARE * F.col("_total")))
    return kept.withColumn("place", rank).where(F.col("place") <= MAX_PLACES).drop("_total")


def name_counts(mentions: DataFrame) -> DataFrame:
    """(article_id, name, n): names differing only in case are one, spelt as first met."""
    tidy = mentions.select("article_id", "pos", tx.collapse(F.col("name")).alias("name")).where(F.col("name").rlike(NAME))
    grouped = tidy.groupBy("article_id", F.lower("name").alias("_key")).agg(F.count("*").alias("n"), F.min_by("name", "pos").alias("name"))
    return grouped.select("article_id", "name", "n")


def main_people(counted: DataFrame) -> DataFrame:
    """(article_id, name, n, place): full names met at least twice; the top five."""
    shown = F.when(tx.is_lower(F.col("name")), tx.title_case(F.col("name"))).otherwise(F.col("name"))
    kept = counted.where((F.col("n") >= MIN_MENTIONS) & F.col("name").contains(" ")).withColumn("name", shown)
    w = Window.partitionBy("article_id").orderBy(F.desc("n"), "name")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= MAX_PEOPLE)


def all_names(organizations: DataFrame, people: DataFrame) -> DataFrame:
    """Counts of organizations and people added on the exact spelling."""
    return organizations.select("article_id", "name", "n").unionByName(people.select("article_id", "name", "n")).groupBy(
        "article_id", "name").agg(F.sum("n").alias("n"))


def names_text(names: DataFrame) -> DataFrame:
    """(article_id, names): the eight names mentioned most, of those the ones mentioned twice."""
    w = Window.partitionBy("article_id").orderBy(F.desc("n"), "name")
    top = names.withColumn("place", F.row_number().over(w)).where((F.col("place") <= MAX_NAMES) & (F.col("n") >= 2))
    return top.groupBy("article_id").agg(_in_order("name").alias("names"))


def _in_order(c: str) -> Column:
    """Values of at most a few ranked rows per article, in `place` order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda s: s[c])


def about_text(people: DataFrame, places: DataFrame, place_names: DataFrame) -> DataFrame:
    """(article_id, about): people, then place names, then the European Union when a member is among the places.
    `place_names` is (country, place)."""
    eu = places.where(F.col("country").cast("string").isin(*fixed.EU_MEMBERS)).select(
        "article_id", F.lit(2).alias("part"), F.lit(1).alias("place"), F.lit(fixed.EU_NAME).alias("value")).distinct()
    named = places.join(place_names, "country", "left").select(
        "article_id", F.lit(1).alias("part"), "place", F.coalesce("place_name", F.col("country").cast("string")).alias("value"))
    who = people.select("article_id", F.lit(0).alias("part"), "place", F.col("name").alias("value"))
    rows = who.unionByName(named).unionByName(eu)
    packed = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "value"))), lambda s: s["value"])
    return rows.groupBy("article_id").agg(packed.alias("about"))


# ---------------------------------------------------------------- inside one record (raw lines)

COUNTED = "array<struct<value:string,count:bigint>>"


def _tally(values: Column) -> Column:
    """array<struct<value, count>> of an array's values, in order of first appearance. One record's mentions."""
    return F.transform(F.array_distinct(values), lambda v: F.struct(
        v.alias("value"), F.size(F.filter(values, lambda x: x == v)).cast("bigint").alias("count")))


def _most(counted: Column, limit: int) -> Column:
    ranked = F.array_sort(F.transform(counted, lambda s: F.struct((-s["count"]).alias("k"), s["value"].alias("value"), s["count"].alias("count"))))
    return F.transform(F.slice(ranked, 1, limit), lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count")))


def themes_column(packed: Column) -> Column:
    """`THEME,offset;...` counted, in theme order."""
    names = F.transform(F.split(packed, ";"), lambda e: F.regexp_extract(e, "^([^,]*)", 1))
    return F.array_sort(_tally(F.filter(names, lambda n: n.rlike(THEME))))


def places_column(packed: Column) -> Column:
    """`type#name#country#...;...` -> the countries the record is mainly about."""
    codes = F.filter(F.transform(F.split(packed, ";"), lambda e: F.coalesce(F.get(F.split(e, "#"), F.lit(2)), F.lit(""))), lambda c: c.rlike("^[A-Z]{2}$"))
    counted = F.filter(_tally(codes), lambda s: (s["count"] >= MIN_MENTIONS) & (s["count"] >= MIN_SHARE * F.size(codes)))
    return _most(counted, MAX_PLACES)


def names_column(packed: Column) -> Column:
    """`Name,offset;...` counted without regard to case, spelt as first met."""
    names = F.filter(
        F.transform(F.split(packed, ";"), lambda e: tx.collapse(F.regexp_extract(e, r"^(.*),[^,]*$", 1))), lambda n: n.rlike(NAME))
    keys = F.transform(names, F.lower)
    return F.transform(F.array_distinct(keys), lambda k: F.struct(
        F.get(names, (F.array_position(keys, k) - 1).cast("int")).alias("value"),
        F.size(F.filter(keys, lambda x: x == k)).cast("bigint").alias("count")))


def people_column(counted: Column) -> Column:
    kept = F.filter(counted, lambda s: (s["count"] >= MIN_MENTIONS) & s["value"].contains(" "))
    shown = F.transform(kept, lambda s: F.struct(
        F.when(tx.is_lower(s["value"]), tx.title_case(s["value"])).otherwise(s["value"]).alias("value"), s["count"].alias("count")))
    return _most(shown, MAX_PEOPLE)


def named_column(people: Column, organizations: Column) -> Column:
    both = F.concat(organizations, people)
    values = F.array_distinct(F.transform(both, lambda s: s["value"]))
    summed = F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(
        F.filter(both, lambda s: s["value"] == v), F.lit(0).cast("bigint"), lambda acc, s: acc + s["count"]).alias("count")))
    return _most(summed, 1 << 30)
