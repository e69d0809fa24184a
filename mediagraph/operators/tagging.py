"""Topic tags from theme counts and section labels.

A tag set is two small dimension tables the caller provides:
`tag_themes` (slug, theme, min_mentions) and `tag_sections` (slug, section, pos), sections already folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import text as tx
from mediagraph.session import spread


def tags_by_theme(counts: DataFrame, tag_themes: DataFrame) -> DataFrame:
    """(article_id, slug, evidence): tags whose themes are mentioned often enough; evidence names the top three.

    `counts` is (article_id, theme, n), one row per pair, so a tag's group is at most its own theme list.
    """
    hits = counts.where(F.col("n") > 0).join(tag_themes, "theme")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "theme", "n")))
    tagged = hits.groupBy("article_id", "slug").agg(
        F.sum("n").alias("total"), F.max("min_mentions").alias("least"), ranked.alias("top"))
    shown = F.array_join(F.transform(F.slice("top", 1, 3), lambda s: F.concat(s["theme"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ")
    return tagged.where(F.col("total") >= F.col("least")).select(
        "article_id", "slug", F.concat(F.lit("GDELT themes: "), shown).alias("evidence"))


def tags_by_section(labels: DataFrame, tag_sections: DataFrame, rows: int | None = None) -> DataFrame:
    """(article_id, slug, evidence) from labels (article_id, pos, label): any part of a label equal to a section; the
    evidence is the first section in the tag's order, in the spelling first met. `rows` tells about how many labels there are."""
    # Outlets use the same labels over and over: each distinct one is taken apart and folded once, and only those that name
    # a section of some tag go on to meet the articles.
    parts = labels.select("label").distinct().select("label", F.posexplode(tx.section_parts(F.col("label"))).alias("part_no", "part"))
    keyed = parts.select("label", "part_no", F.trim("part").alias("part"), tx.normalize_text(F.col("part")).alias("section"))
    named = keyed.join(tag_sections.withColumnRenamed("pos", "section_no"), "section")
    found = labels.join(named, "label")
    found = found if rows is None else spread(found, rows, "article_id")
    hits = found.groupBy("article_id", "slug", "section", "section_no").agg(F.min_by("part", F.struct("pos", "part_no")).alias("part"))
    return hits.groupBy("article_id", "slug").agg(F.concat(F.lit("Outlet's section: "), F.min_by("part", "section_no")).alias("evidence"))


def combine(by_theme: DataFrame, by_section: DataFrame, sections_only: DataFrame) -> DataFrame:
    """Theme tags win; section tags count where an article has none, and always for tags without themes
    (`sections_only`: slug)."""
    themed = by_theme.select("article_id").distinct()
    always = by_section.join(sections_only.select("slug"), "slug", "left_semi")
    fallback = by_section.join(sections_only.select("slug"), "slug", "left_anti").join(themed, "article_id", "left_anti")
    return by_theme.unionByName(always.select(by_theme.columns)).unionByName(fallback.select(by_theme.columns))


def sections_only(tag_sections: DataFrame, tag_themes: DataFrame) -> DataFrame:
    return tag_sections.select("slug").distinct().join(tag_themes.select("slug"), "slug", "left_anti")


def retag(counts: DataFrame, labels: DataFrame, tag_themes: DataFrame, tag_sections: DataFrame, rows: int | None = None) -> DataFrame:
    """Every article's tags, recomputed."""
    return combine(tags_by_theme(counts, tag_themes), tags_by_section(labels, tag_sections, rows), sections_only(tag_sections, tag_themes))


def tag_dimensions(spark, tags: list[dict]) -> tuple[DataFrame, DataFrame]:
    """The two dimension tables from tag settings: [{slug, label, themes, sections, min_mentions}]."""
    themes = [(t["slug"], theme, int(t.get("min_mentions", 3))) for t in tags for theme in t.get("themes", ())]
    sections = [(t["slug"], tx.fold_as_columns(s), i) for t in tags for i, s in enumerate(t.get("sections", ())) if tx.fold_as_columns(s)]
    return (spark.createDataFrame(themes, "slug string, theme string, min_mentions int"),
            spark.createDataFrame(sections, "slug string, section string, pos int"))


