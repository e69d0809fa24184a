"""Mention counts, tags and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import ids
from mediagraph.operators import counts, search, tagging
from mediagraph.plans.bindings import Tables
from mediagraph.plans.registry import query
from mediagraph.session import cut, spread

M = ("b_mentions",)


@query("mention_theme_counts", M, "SELECT article_id, theme, count(*) AS n FROM b_mentions WHERE regexp_matches(theme, '^[A-Z0-9_]{1,120}$') GROUP BY article_id, theme")
def _(t: Tables) -> DataFrame:
    return counts.theme_counts(t.mentions)


@query("mention_theme_maps", M, """, c AS (SELECT article_id, theme, count(*) AS n FROM b_mentions GROUP BY article_id, theme)
SELECT article_id, string_agg(theme || ':' || n, ' ' ORDER BY theme) AS themes FROM c WHERE theme IN ('ECONOMY', 'PROMO', 'LARGE') GROUP BY article_id""")
def _(t: Tables) -> DataFrame:
    maps = counts.theme_maps(counts.theme_counts(t.mentions))
    kept = maps.select("article_id", ids.used_themes(F.col("themes"), ["ECONOMY", "PROMO", "LARGE"]).alias("themes"))
    packed = kept.where(F.size(F.map_keys("themes")) > 0).select("article_id", ids.encode_themes(F.col("themes")).alias("packed"))
    return packed.select("article_id", ids.encode_themes(ids.decode_themes(F.col("packed"))).alias("themes"))


PLACES = """, pc AS (SELECT article_id, country, count(*) AS mentions FROM b_mentions GROUP BY article_id, country)
, pt AS (SELECT *, sum(mentions) OVER (PARTITION BY article_id) AS total FROM pc)
, places AS (SELECT * FROM (SELECT article_id, country, mentions, row_number() OVER (PARTITION BY article_id ORDER BY mentions DESC, country) AS place
  FROM pt WHERE mentions >= 2 AND mentions >= 0.25 * total) WHERE place <= 3)"""


@query("mention_main_places", M, PLACES + "SELECT * FROM places")
def _(t: Tables) -> DataFrame:
    return counts.main_places(t.mentions)


# Two spellings of one name; which came first decides. Positions are unique up to equal spellings.
NAMED = """, spelt AS (SELECT article_id, CAST(pos AS BIGINT) * 1000000000 + part_id AS pos, CASE part_id % 3 WHEN 0 THEN upper(n) WHEN 1 THEN lower(n) ELSE n END AS name
  FROM (SELECT *, replace(name, '#', ' ') AS n FROM b_mentions))
, nc AS (SELECT article_id, arg_min(name, pos) AS name, count(*) AS n FROM spelt GROUP BY article_id, lower(name))"""


def dealt_mentions(t: Tables) -> DataFrame:
    """The mentions of an article in one task, and no more of them in a task than it can sort at hand."""
    return spread(t.mentions, t.read("lineitem").count(), "article_id")


def spelt(t: Tables, mentions: DataFrame | None = None) -> DataFrame:
    n, p = F.replace("name", F.lit("#"), F.lit(" ")), F.col("part_id") % 3
    rows = t.mentions if mentions is None else mentions
    return rows.select("article_id", (F.col("pos").cast("bigint") * 1_000_000_000 + F.col("part_id")).alias("pos"),
                       F.when(p == 0, F.upper(n)).when(p == 1, F.lower(n)).otherwise(n).alias("name"))


@query("mention_name_counts", M, NAMED + "SELECT article_id, name, n FROM nc")
def _(t: Tables) -> DataFrame:
    return counts.name_counts(spelt(t))


PEOPLE = """, people AS (SELECT * FROM (SELECT article_id, n, shown AS name, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, shown) AS place
  FROM (SELECT *, CASE WHEN lower(name) = name THEN upper(left(name, 1)) || substr(name, 2) ELSE name END AS shown FROM nc WHERE n >= 2 AND contains(name, ' '))) WHERE place <= 5)"""


@query("mention_main_people", M, NAMED + PEOPLE + "SELECT article_id, name, n, place FROM people")
def _(t: Tables) -> DataFrame:
    return counts.main_people(counts.name_counts(spelt(t))).select("article_id", "name", "n", "place")


ALL_NAMES = """, orgs AS (SELECT article_id, replace(name, '#', ' ') AS name, count(*) AS n FROM b_mentions WHERE pos % 2 = 0 GROUP BY ALL)
, alln AS (SELECT article_id, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT article_id, name, n FROM orgs UNION ALL SELECT article_id, name, n FROM nc) GROUP BY article_id, name)"""


def every_name(t: Tables) -> DataFrame:
    mentions = dealt_mentions(t)
    orgs = mentions.where(F.col("pos") % 2 == 0).groupBy("article_id", F.replace("name", F.lit("#"), F.lit(" ")).alias("name")).agg(F.count("*").alias("n"))
    return counts.all_names(orgs, counts.name_counts(spelt(t, mentions)))


@query("mention_all_names", M, NAMED + ALL_NAMES + "SELECT * FROM alln")
def _(t: Tables) -> DataFrame:
    return every_name(t)


@query("article_names_text", M, NAMED + ALL_NAMES + """, r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, name) AS place FROM alln)
SELECT article_id, string_agg(name, ' · ' ORDER BY place) AS names FROM r WHERE place <= 8 AND n >= 2 GROUP BY article_id""")
def _(t: Tables) -> DataFrame:
    return counts.names_text(every_name(t)).select("article_id", F.array_join("names", " · ").alias("names"))


@query("article_about_text", M, NAMED + PEOPLE + PLACES + """, parts AS (SELECT article_id, 0 AS part, place, name AS value FROM people
UNION ALL SELECT p.article_id, 1, p.place, n.n_name FROM places p JOIN nation n ON n.n_nationkey = p.country)
SELECT article_id, string_agg(value, ' · ' ORDER BY part, place) AS about FROM parts GROUP BY article_id""")
def _(t: Tables) -> DataFrame:
    names = t.read("nation").select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("place_name"))
    people = counts.main_people(counts.name_counts(spelt(t)))
    rows = counts.about_text(people, counts.main_places(t.mentions), names)
    return rows.select("article_id", F.array_join("about", " · ").alias("about"))


TAGS = """, tag_themes AS (SELECT * FROM (VALUES ('goods', 'ECONOMY', 3), ('goods', 'PROMO', 3), ('size', 'LARGE', 2), ('size', 'MEDIUM', 2), ('size', 'SMALL', 2), ('plain', 'STANDARD', 3)) v(slug, theme, least))
, tag_sections AS (SELECT * FROM (VALUES ('goods', 'red widget', 0), ('goods', 'small ring', 1), ('colour', 'blue', 0), ('colour', 'brand 4', 1), ('size', 'large', 0)) v(slug, section, pos))
, tc AS (SELECT article_id, theme, count(*) AS n FROM b_mentions GROUP BY article_id, theme)
, th AS (SELECT c.*, t.slug, t.least, row_number() OVER (PARTITION BY c.article_id, t.slug ORDER BY n DESC, c.theme) AS k FROM tc c JOIN tag_themes t ON t.theme = c.theme)
, by_theme AS (SELECT article_id, slug, 'GDELT themes: ' || string_agg(theme || ' (' || n || ')', ', ' ORDER BY k) FILTER (WHERE k <= 3) AS evidence FROM th GROUP BY article_id, slug HAVING sum(n) >= max(least))
, lab AS (SELECT m.article_id, m.pos, m.part_id, unnest([replace(m.name, '#', ' '), p.p_name]) AS part, unnest([0, 1]) AS j FROM b_mentions m JOIN part p ON p.p_partkey = m.part_id)
, first AS (SELECT article_id, lower(part) AS section, arg_min(part, CAST(pos AS BIGINT) * 1000000000 + part_id * 10 + j) AS part FROM lab GROUP BY article_id, lower(part))
, by_section AS (SELECT f.article_id, s.slug, 'Outlet''s section: ' || arg_min(f.part, s.pos) AS evidence FROM first f JOIN tag_sections s ON s.section = f.section GROUP BY f.article_id, s.slug)"""


def tag_dims(t: Tables) -> tuple[DataFrame, DataFrame]:
    return tagging.tag_dimensions(t.spark, [
        {"slug": "goods", "themes": ["ECONOMY", "PROMO"], "sections": ["Red widget", "small  ring"]},
        {"slug": "size", "themes": ["LARGE", "MEDIUM", "SMALL"], "sections": ["Large"], "min_mentions": 2},
        {"slug": "plain", "themes": ["STANDARD"]},
        {"slug": "colour", "sections": ["blue", "Brand 4"]},
    ])


def labels(t: Tables) -> DataFrame:
    part = t.read("part").select(F.col("p_partkey").alias("part_id"), "p_name")
    label = F.concat(F.replace("name", F.lit("#"), F.lit(" ")), F.lit(" > "), "p_name")
    return t.mentions.join(part, "part_id").select(
        "article_id", (F.col("pos").cast("bigint") * 1_000_000_000 + F.col("part_id") * 10).alias("pos"), label.alias("label"))


@query("tags_from_themes", M, TAGS + "SELECT * FROM by_theme")
def _(t: Tables) -> DataFrame:
    return tagging.tags_by_theme(counts.theme_counts(t.mentions), tag_dims(t)[0])


@query("tags_from_sections", M, TAGS + "SELECT * FROM by_section")
def _(t: Tables) -> DataFrame:
    return tagging.tags_by_section(labels(t), tag_dims(t)[1])


@query("tags_retag_all", M, TAGS + """SELECT * FROM by_theme UNION ALL SELECT * FROM by_section s WHERE slug = 'colour' OR article_id NOT IN (SELECT article_id FROM by_theme)""")
def _(t: Tables) -> DataFrame:
    themes, sections = tag_dims(t)
    return tagging.retag(counts.theme_counts(dealt_mentions(t)), labels(t), themes, sections, t.read("lineitem").count())


# ---------------------------------------------------------------- search

TOKENS = "regexp_extract_all(trim(regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '\\s+', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"
POSTED = f""", tok AS (SELECT doc_id, 'title' AS field, {TOKENS.format(c='title')} AS w FROM b_docs UNION ALL SELECT doc_id, 'about', {TOKENS.format(c='about')} FROM b_docs)
, post AS (SELECT term, doc_id, field, field_len, count(*) AS freq FROM (SELECT doc_id, field, CAST(len(w) AS BIGINT) AS field_len, unnest(w) AS term FROM tok) GROUP BY ALL)"""
QUERY = "with The é"
RANK = POSTED + """, ph AS (SELECT doc_id, phrase, sum(freq * CASE field WHEN 'title' THEN 10.0 ELSE 1.0 END) AS w FROM (
  SELECT *, 0 AS phrase FROM post WHERE term = 'with' UNION ALL SELECT *, 1 FROM post WHERE term = 'the' UNION ALL SELECT *, 2 FROM post WHERE starts_with(term, 'e')) GROUP BY doc_id, phrase)
, dl AS (SELECT doc_id, CAST(sum(len(w)) AS DOUBLE) AS d FROM tok GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(d) AS a FROM dl)
, dfs AS (SELECT phrase, count(*) AS df FROM ph GROUP BY phrase)
, scored AS (SELECT ph.doc_id, count(*) AS k, sum(greatest(ln((st.n - dfs.df + 0.5) / (dfs.df + 0.5)), 1e-6) * (w * 2.2) / (w + 1.2 * (0.25 + 0.75 * dl.d / st.a))) AS score
  FROM ph JOIN dfs USING (phrase) JOIN dl ON dl.doc_id = ph.doc_id, st GROUP BY ph.doc_id)"""


@query("search_postings", ("b_docs",), POSTED + "SELECT * FROM post")
def _(t: Tables) -> DataFrame:
    return t.index.postings()


@query("search_ranked", ("b_docs",), RANK + "SELECT doc_id, round(score, 5) AS score FROM scored WHERE k = 3")
def _(t: Tables) -> DataFrame:
    return t.index.ranked(QUERY).select("doc_id", F.round("score", 5).alias("score"))


@query("search_ranked_from_postings", ("b_docs",), RANK + "SELECT doc_id, round(score, 5) AS score FROM scored WHERE k = 3")
def _(t: Tables) -> DataFrame:
    return search.rank_postings(search.build_postings(t.docs), cut(search.doc_lengths(t.docs)), QUERY).select("doc_id", F.round("score", 5).alias("score"))


@query("search_best_page", ("b_docs",), RANK + "SELECT s.doc_id, round(score, 5) AS score, d.seen FROM scored s JOIN b_docs d ON d.doc_id = s.doc_id WHERE k = 3 ORDER BY round(score, 5) DESC, d.seen DESC, s.doc_id DESC LIMIT 25")
def _(t: Tables) -> DataFrame:
    hits = t.index.top(QUERY, 25, slack=1e-5).select("doc_id", F.round("score", 5).alias("score"))
    return hits.join(t.docs.select("doc_id", "seen"), "doc_id").orderBy(F.desc("score"), F.desc("seen"), F.desc("doc_id")).limit(25)


@query("search_matching", ("b_docs",), POSTED + """SELECT d.doc_id FROM b_docs d WHERE EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND p.term = 'src1')
AND EXISTS (SELECT 1 FROM post p WHERE p.doc_id = d.doc_id AND starts_with(p.term, 'tion'))""")
def _(t: Tables) -> DataFrame:
    return t.index.matching("SRC1 Tion")


@query("search_matched_names", sql="""SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'e') THEN '' WHEN starts_with(lower(p_name), 'r') OR contains(lower(p_name), ' r') THEN p_name ELSE '' END AS names
FROM (SELECT p_partkey, CASE WHEN starts_with(lower(p_type), 'r') THEN 'e' ELSE 'x' END AS p_type, p_name FROM part)""")
def _(t: Tables) -> DataFrame:
    names = search.matched_names(F.array("p_name"), F.lit("x"), "r")
    return t.read("part").select("p_partkey", F.array_join(names, ", ").alias("names"))


@query("search_highlight", sql="""SELECT p_partkey, regexp_replace(p_name, '\\b(r)', '[\\1]', 'g') AS marked FROM part""")
def _(t: Tables) -> DataFrame:
    pieces = search.highlight(F.col("p_name"), "R")
    shown = F.transform(pieces, lambda p: F.when(p["marked"], F.concat(F.lit("["), p["text"], F.lit("]"))).otherwise(p["text"]))
    return t.read("part").select("p_partkey", F.array_join(shown, "").alias("marked"))
