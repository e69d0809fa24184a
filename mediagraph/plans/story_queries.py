"""Story grouping over the lines of documents, and story reports over a stand-in assignment of events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import fixed
from mediagraph.functions import text as tx
from mediagraph.operators import reports, stories
from mediagraph.plans.bindings import Tables
from mediagraph.plans.registry import query
from mediagraph.plans.text_queries import NORMAL, WORDS

STOPPED = ", ".join(f"'{w}'" for w in sorted({tx.fold_text(w) for w in (fixed.STOPWORDS_EN + fixed.STOPWORDS_FR).split()}))


def terms_sql(source: str, key: str, title: str = "title") -> str:
    """words(key, term, word): headline terms of a view, first spelling."""
    return f"""words AS (SELECT {key}, term, arg_min(word, pos) AS word FROM (SELECT {key}, pos, word,
  CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS term
  FROM (SELECT *, {NORMAL.format(c='word')} AS w FROM (SELECT {key}, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS pos FROM
  (SELECT {key}, {WORDS.format(c=title)} AS l FROM {source}))) WHERE length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({STOPPED}))
  GROUP BY {key}, term)"""


@query("story_headline_terms", ("b_docs",), ", " + terms_sql("b_docs", "article_id") + " SELECT article_id, term, word FROM words")
def _(t: Tables) -> DataFrame:
    return stories.headline_terms(t.docs)


NAMES = """, named AS (SELECT article_id, pos, n AS word FROM (SELECT article_id, unnest([a, b, c]) AS n, unnest([0, 1, 2]) AS pos FROM (SELECT article_id,
  regexp_extract(title, '^(\\S+ \\S+)', 1) AS a, 'The Acme' || article_id % 5 || ' Group Ltd' AS b, 'Solo' || article_id % 3 AS c FROM b_headlines)) WHERE n <> '')
, keyed AS (SELECT *, regexp_replace(regexp_replace(array_to_string(regexp_extract_all(""" + NORMAL.format(c="word") + """, '[\\p{L}\\p{N}_]+'), ' '), '^the( |$)', ''), '( (ltd|co|sa|ag|lp|inc))+$', '') AS k FROM named)
, nt AS (SELECT article_id, '@' || k AS term, arg_min(CASE WHEN lower(word) = word THEN word ELSE word END, pos) AS word FROM keyed WHERE length(replace(k, ' ', '')) >= 3 GROUP BY article_id, k)
, both_t AS (SELECT article_id, term FROM words UNION ALL SELECT article_id, term FROM nt WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.article_id = nt.article_id
  AND w.term = regexp_extract(nt.term, '([^ ]*)$', 1)))"""


def with_names(t: Tables) -> DataFrame:
    n = F.col("article_id")
    names = F.array(F.regexp_extract("title", r"^(\S+ \S+)", 1), F.concat(F.lit("The Acme"), (n % 5).cast("string"), F.lit(" Group Ltd")),
                    F.concat(F.lit("Solo"), (n % 3).cast("string")))
    return t.headlines.withColumn("names", F.filter(names, lambda x: x != "")).withColumn("about", F.array().cast("array<string>"))


@query("story_article_terms", ("b_headlines",), ", " + terms_sql("b_headlines", "article_id") + NAMES + " SELECT article_id, term FROM both_t")
def _(t: Tables) -> DataFrame:
    return stories.article_terms(with_names(t)).select("article_id", "term")


WEIGHTS = ", " + terms_sql("b_headlines", "article_id") + """, size AS (SELECT count(*) AS n FROM b_headlines), dfs AS (SELECT term, count(*) AS df FROM words GROUP BY term)
, tw AS (SELECT term, df, ln((1.0 + n) / (1 + df)) + 1 AS weight FROM dfs, size)"""


@query("story_term_weights", ("b_headlines",), WEIGHTS + " SELECT term, df, round(weight, 6) AS weight FROM tw")
def _(t: Tables) -> DataFrame:
    rows = t.headlines
    got = stories.term_weights(stories.headline_terms(rows), stories.pool_size(rows))
    return got.select("term", "df", F.round("weight", 6).alias("weight"))


# Pairs of distinct headlines; copies of one headline are one lead article.
PAIRS = WEIGHTS + """, vec AS (SELECT w.article_id, w.term, t.weight, t.df FROM words w JOIN tw t ON t.term = w.term)
, sigs AS (SELECT article_id, string_agg(term, ' ' ORDER BY term) AS sig, sqrt(sum(weight * weight)) AS norm FROM vec GROUP BY article_id)
, leads AS (SELECT s.sig, min(s.article_id) AS lead, any_value(s.norm) AS norm, min(h.seen) AS first_seen, max(h.seen) AS last_seen FROM sigs s JOIN b_headlines h ON h.article_id = s.article_id GROUP BY s.sig)
, lv AS (SELECT l.lead, l.norm, l.first_seen, l.last_seen, v.term, v.weight, v.df FROM leads l JOIN vec v ON v.article_id = l.lead)
, cand AS (SELECT DISTINCT a.lead AS a, b.lead AS b FROM size, lv a JOIN lv b ON a.term = b.term AND a.lead < b.lead AND a.first_seen - b.last_seen <= INTERVAL '24' HOUR AND b.first_seen - a.last_seen <= INTERVAL '24' HOUR
  WHERE a.df <= greatest(10, 0.03 * n))
, met AS (SELECT a.lead AS a, b.lead AS b, count(*) AS shared, sum(a.weight * b.weight) / (any_value(a.norm) * any_value(b.norm)) AS score, min(a.df) AS rarest,
    array_to_string(list_slice(list(a.term ORDER BY a.df, a.term), 1, 4), ' ') AS evidence
  FROM cand c JOIN lv a ON a.lead = c.a JOIN lv b ON b.lead = c.b AND a.term = b.term GROUP BY a.lead, b.lead)
, linked AS (SELECT met.* FROM met, size WHERE rarest <= greatest(10, 0.03 * n) AND ((shared >= 3 AND score >= 0.3) OR (shared >= 2 AND score >= 0.4)))"""


def pairs(t: Tables) -> DataFrame:
    return stories.similar_titles(t.headlines, stories.pool_size(t.headlines))


@query("story_similar_headlines", ("b_headlines",), PAIRS + " SELECT a, b, shared, round(score, 6) AS score FROM linked")
def _(t: Tables) -> DataFrame:
    return pairs(t).select("a", "b", F.size("shared").cast("bigint").alias("shared"), F.round("score", 6).alias("score"))


@query("story_link_evidence", ("b_headlines",), PAIRS + " SELECT a, b, evidence FROM linked")
def _(t: Tables) -> DataFrame:
    return pairs(t).select("a", "b", F.array_join(F.slice("shared", 1, stories.SHOWN), " ").alias("evidence"))


@query("story_assignments")
def _(t: Tables) -> DataFrame:
    rows = with_names(t).withColumn("outlet_id", F.col("outlet")).withColumn("story_id", F.lit(None).cast("bigint"))
    linked = stories.link_stories(rows)
    return linked.select("article_id", "story_id", "linked_to", F.array_join("shared", " · ").alias("shared"))


# ---------------------------------------------------------------- reports: every four events in a row are a story

STORIES = """, st AS (SELECT article_id, article_id - article_id % 4 AS story_id FROM b_articles)
, mem AS (SELECT s.story_id, a.article_id, a.outlet_id, a.seen, coalesce(a.stated, a.seen) AS shown, o.display_name FROM st s JOIN b_articles a ON a.article_id = s.article_id
  JOIN b_outlets o ON o.outlet_id = a.outlet_id)"""


def assigned(t: Tables) -> DataFrame:
    return t.articles.select("article_id", (F.col("article_id") - F.col("article_id") % 4).alias("story_id"))


@query("story_covered_by_several", ("b_articles", "b_outlets"), STORIES + """ SELECT story_id, article_id, outlet_id, seen, row_number() OVER (PARTITION BY story_id ORDER BY seen, article_id) AS place FROM mem
WHERE story_id IN (SELECT story_id FROM mem WHERE seen >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY story_id HAVING count(DISTINCT outlet_id) > 1)""")
def _(t: Tables) -> DataFrame:
    return stories.covered_stories(assigned(t), t.articles, datetime(2024, 1, 10))


@query("story_also_covered_by", ("b_articles", "b_outlets"), STORIES + """, firsts AS (SELECT story_id, outlet_id, display_name, min(seen) AS first FROM mem GROUP BY ALL)
SELECT m.article_id, m.story_id, coalesce(string_agg(f.display_name, ', ' ORDER BY f.first, f.display_name), '') AS also FROM mem m
LEFT JOIN firsts f ON f.story_id = m.story_id AND f.outlet_id <> m.outlet_id GROUP BY m.article_id, m.story_id""")
def _(t: Tables) -> DataFrame:
    rows = stories.also_covered(assigned(t), t.articles, t.outlets)
    return rows.select("article_id", "story_id", F.array_join("also", ", ").alias("also"))


@query("story_pages", ("b_articles", "b_outlets"), STORIES + """ SELECT story_id, article_id, display_name, shown, row_number() OVER (PARTITION BY story_id ORDER BY shown, article_id) AS place,
count(*) OVER (PARTITION BY story_id, outlet_id) AS from_outlet FROM mem""")
def _(t: Tables) -> DataFrame:
    return reports.story_pages(assigned(t), t.articles, t.outlets).select("story_id", "article_id", "display_name", "shown", "place", "from_outlet")
