"""Ownership graph queries over the edges binding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import ids
from mediagraph.operators import graph, reports
from mediagraph.plans.bindings import Tables
from mediagraph.plans.feed_queries import COUNTS, RANKED, article_counts, tables
from mediagraph.plans.registry import query

GRAPH = ("b_edges", "b_entities", "b_outlets")

# Shortest paths, level by level: the least edge-key list per (root, node) in the order a breadth-first reading meets
# them. DuckDB keeps all simple paths and the outer query picks the least.
ORDERED = """, live AS (SELECT e.child, e.parent, e.relation, e.share, p.name,
    CASE WHEN e.relation = 'owned_by' THEN 'a' ELSE 'b' END AS r FROM b_edges e JOIN b_entities p ON p.entity_id = e.parent WHERE e.source <> 'set_aside')"""
UP_PATHS = ORDERED + """, paths(root, node, depth, path, key) AS (
  SELECT DISTINCT entity_id, entity_id, 0, [entity_id], CAST([] AS VARCHAR[]) FROM b_outlets WHERE entity_id IS NOT NULL
  UNION ALL SELECT p.root, l.parent, p.depth + 1, list_append(p.path, l.parent), list_append(p.key, l.r || l.name)
  FROM paths p JOIN live l ON l.child = p.node WHERE NOT list_contains(p.path, l.parent))
, best AS (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, key) AS n FROM paths)"""


def starts(t: Tables) -> DataFrame:
    return t.outlets.where(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("root"))


def text(path: str):
    return F.array_join(F.col(path).cast("array<string>"), ">")


@query("graph_ancestors", GRAPH, UP_PATHS + """SELECT root, node, depth, array_to_string(path, '>') AS path FROM best WHERE n = 1 AND depth > 0""")
def _(t: Tables) -> DataFrame:
    rows = t.own.above(starts(t), include_roots=False)
    return rows.select("root", "node", "depth", text("path").alias("path"))


@query("graph_lineage", GRAPH, UP_PATHS + """SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY depth, key) AS place FROM best WHERE n = 1""")
def _(t: Tables) -> DataFrame:
    return lineage(t)


def lineage(t: Tables) -> DataFrame:
    """Each outlet's entity and everything above it, nearest first (`place` 1 is the entity itself)."""
    rows = t.own.above(starts(t))
    w = Window.partitionBy("root").orderBy("depth", "rank")
    return rows.select("root", "node", F.row_number().over(w).alias("place"))


@query("graph_descendants", GRAPH, ORDERED + """, roots AS (SELECT DISTINCT parent AS node FROM live WHERE parent NOT IN (SELECT child FROM live))
, paths(root, node, depth, path, key) AS (SELECT node, node, 0, [node], CAST([] AS VARCHAR[]) FROM roots
  UNION ALL SELECT p.root, l.child, p.depth + 1, list_append(p.path, l.child), list_append(p.key, l.r || l.name || lpad(CAST(l.child AS VARCHAR), 12, '0'))
  FROM paths p JOIN live l ON l.parent = p.node WHERE NOT list_contains(p.path, l.child))
, best AS (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, key) AS n FROM paths)
SELECT root, node, depth, array_to_string(path, '>') AS path FROM best WHERE n = 1 AND depth > 0""")
def _(t: Tables) -> DataFrame:
    live = graph.current(t.edges)
    roots = live.join(live.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("root"))
    rows = t.own.below(roots, include_roots=False)
    return rows.select("root", "node", "depth", text("path").alias("path"))


CLOSURE = """, live AS (SELECT DISTINCT child, parent FROM b_edges WHERE source <> 'set_aside')
, reach(root, node) AS (SELECT DISTINCT entity_id, entity_id FROM b_outlets WHERE entity_id IS NOT NULL
  UNION SELECT r.root, l.parent FROM reach r JOIN live l ON l.child = r.node)"""


@query("graph_closure_up", GRAPH, CLOSURE + "SELECT root, node FROM reach")
def _(t: Tables) -> DataFrame:
    return graph.reach(graph.current(t.edges), starts(t)).select("root", "node")


@query("graph_ultimate_owners", GRAPH, CLOSURE + "SELECT root, node FROM reach WHERE root <> node AND node NOT IN (SELECT child FROM live)")
def _(t: Tables) -> DataFrame:
    return graph.tops(t.edges, t.own.above(starts(t))).select("root", "node")


@query("graph_depth_limited_walk", GRAPH, """, lv(node, depth) AS (SELECT DISTINCT entity_id, 0 FROM b_outlets WHERE entity_id IS NOT NULL
  UNION SELECT e.parent, l.depth + 1 FROM lv l JOIN b_edges e ON e.child = l.node AND e.source <> 'set_aside' WHERE l.depth < 10)
SELECT node, min(depth) AS depth, CAST(min(depth) < 10 AS INT) AS examined FROM lv GROUP BY node""")
def _(t: Tables) -> DataFrame:
    rows = graph.reach(graph.current(t.edges), starts(t), max_depth=10).groupBy("node").agg(F.min("depth").alias("depth"))
    return rows.withColumn("examined", (F.col("depth") < 10).cast("int"))


# The single step a climb takes from each child.
FIRST = ORDERED + """, facts AS (SELECT l.*, CASE WHEN relation = 'owned_by' AND coalesce(share < 0.5, FALSE) THEN 1 ELSE 0 END AS minor FROM live l)
, stats AS (SELECT child, sum(1 - minor) AS owners, count(*) AS n FROM facts GROUP BY child)
, pick AS (SELECT child, parent, relation FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY r, name) AS k FROM facts WHERE minor = 0) WHERE k = 1)
, nxt AS (SELECT s.child, CASE WHEN en.kind = 'public company' OR s.owners = 0 THEN NULL ELSE p.parent END AS parent, p.relation,
    en.kind = 'public company' OR s.owners = 0 OR s.n > 1 AS more
  FROM stats s JOIN b_entities en ON en.entity_id = s.child LEFT JOIN pick p ON p.child = s.child)"""
CLIMB = """, climb(base, start, node, steps, rels, more, done) AS (
  SELECT DISTINCT o.entity_id, f.parent, f.parent, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), FALSE, FALSE
  FROM b_outlets o JOIN facts f ON f.child = o.entity_id AND f.minor = 0
  UNION ALL SELECT c.base, c.start, CASE WHEN go THEN parent ELSE node END, CASE WHEN go THEN list_append(steps, parent) ELSE steps END,
    CASE WHEN go THEN list_append(rels, relation) ELSE rels END, more2, NOT go
  FROM (SELECT c.*, n.parent, n.relation, c.more OR coalesce(n.more, FALSE) AS more2,
     n.parent IS NOT NULL AND n.parent <> c.base AND n.parent <> c.start AND NOT list_contains(c.steps, n.parent) AS go
     FROM climb c LEFT JOIN nxt n ON n.child = c.node WHERE NOT c.done) c)
, lines AS (SELECT * FROM climb WHERE done)"""


@query("graph_climb", GRAPH, FIRST + CLIMB + "SELECT base, start, node AS top, array_to_string(steps, '>') AS steps, more FROM lines")
def _(t: Tables) -> DataFrame:
    up = graph.current(t.edges)
    direct = up.where(~graph.minority(F.col("relation"), F.col("share"))).select(F.col("child").alias("base"), F.col("parent").alias("start"))
    lines = graph.climb(graph.first_owner(t.edges, t.entities), direct.join(starts(t).select(F.col("root").alias("base")), "base", "left_semi"))
    steps = F.array_join(F.transform("steps", lambda s: s["parent"].cast("string")), ">")
    return lines.select("base", "start", "top", steps.alias("steps"), "more")


GROUPS = """, grp AS (SELECT base, string_agg(name, '; ' ORDER BY lower(name)) AS owners FROM (SELECT DISTINCT l.base, e.name FROM lines l
  JOIN b_entities e ON e.entity_id = l.node) GROUP BY base)"""


@query("graph_owner_groups", GRAPH, FIRST + CLIMB + GROUPS + "SELECT DISTINCT o.entity_id AS base, coalesce(g.owners, '') AS owners FROM b_outlets o LEFT JOIN grp g ON g.base = o.entity_id WHERE o.entity_id IS NOT NULL")
def _(t: Tables) -> DataFrame:
    rows = graph.owner_groups(t.edges, t.entities, starts(t).select(F.col("root").alias("base")))
    return rows.select("base", F.array_join(F.transform("owners", lambda o: o["name"]), "; ").alias("owners"))


@query("coverage_by_owner", ("b_edges", "b_entities", "b_outlets", "b_articles"), RANKED + FIRST + CLIMB + GROUPS + """
, kept AS (SELECT outlet_id, count(*) AS n FROM ranked WHERE n <= 3 GROUP BY outlet_id)
, named AS (SELECT CASE WHEN o.entity_id IS NULL THEN 'unmatched' ELSE coalesce(g.owners, '') END AS owners, o.display_name, k.n
  FROM kept k JOIN b_outlets o ON o.outlet_id = k.outlet_id LEFT JOIN grp g ON g.base = o.entity_id)
SELECT owners, CAST(sum(n) OVER (PARTITION BY owners) AS BIGINT) AS articles, display_name AS outlet, n AS own FROM named""")
def _(t: Tables) -> DataFrame:
    from mediagraph.operators import feed

    counts = feed.counts_per_outlet(feed.matching(tables(t), feed.FeedFilters()))
    shares = reports.coverage_by_owner(t.edges, t.entities, t.outlets, counts)
    owners = F.when(F.col("matched"), F.array_join(F.transform("owners", lambda o: o["name"]), "; ")).otherwise("unmatched")
    return shares.select(owners.alias("owners"), F.col("group_articles").alias("articles"), F.col("display_name").alias("outlet"), F.col("articles").alias("own"))


@query("ownership_summary_lines", GRAPH, FIRST + CLIMB + """, dirs AS (SELECT o.outlet_id, f.* , row_number() OVER (PARTITION BY o.outlet_id, f.parent ORDER BY f.r, f.name) AS again
  FROM b_outlets o JOIN facts f ON f.child = o.entity_id), d AS (SELECT *, row_number() OVER (PARTITION BY outlet_id ORDER BY r, name) AS i FROM dirs WHERE again = 1)
, fc(outlet_id, base, start, node, steps, rels, more, done) AS (SELECT d.outlet_id, d.child, d.parent, d.parent, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), FALSE, FALSE FROM d WHERE i = 1
  UNION ALL SELECT c.outlet_id, c.base, c.start, CASE WHEN go THEN parent ELSE node END, CASE WHEN go THEN list_append(steps, parent) ELSE steps END,
    CASE WHEN go THEN list_append(rels, relation) ELSE rels END, more2, NOT go
  FROM (SELECT c.*, n.parent, n.relation, c.more OR coalesce(n.more, FALSE) AS more2,
     n.parent IS NOT NULL AND n.parent <> c.base AND n.parent <> c.start AND NOT list_contains(c.steps, n.parent) AS go
     FROM fc c LEFT JOIN nxt n ON n.child = c.node WHERE NOT c.done) c)
, tail AS (SELECT f.outlet_id, f.more OR len(f.steps) > 3 AS more, coalesce(string_agg(CASE WHEN s.rel = 'owned_by' THEN ', whose owner is ' ELSE ', whose parent organization is ' END || e.name, '' ORDER BY s.k), '') AS txt
  FROM (SELECT * FROM fc WHERE done) f LEFT JOIN (SELECT outlet_id, unnest(steps) AS id, unnest(rels) AS rel, unnest(range(1, len(steps) + 1)) AS k FROM fc WHERE done) s ON s.outlet_id = f.outlet_id AND s.k <= 3
  LEFT JOIN b_entities e ON e.entity_id = s.id GROUP BY f.outlet_id, f.more, f.steps)
, parts AS (SELECT d.outlet_id, string_agg(CASE WHEN i = 1 THEN lab ELSE lower(lab) END || CASE WHEN relation = 'parent_org' THEN ':' ELSE '' END || ' ' || name
   || CASE WHEN share > 0 THEN ' (30%)' ELSE '' END || CASE WHEN i = 1 THEN t.txt || CASE WHEN t.more THEN ', …' ELSE '' END ELSE '' END, '; ' ORDER BY i) AS line
  FROM (SELECT *, CASE WHEN minor = 1 THEN 'Shareholder' WHEN relation = 'owned_by' THEN 'Owned by' ELSE 'Parent organization' END AS lab FROM d) d JOIN tail t ON t.outlet_id = d.outlet_id GROUP BY d.outlet_id)
SELECT o.outlet_id, CASE WHEN o.entity_id IS NULL THEN 'Owner: no record found' ELSE coalesce(p.line, 'No owner listed on Wikidata') END AS line
FROM b_outlets o LEFT JOIN parts p ON p.outlet_id = o.outlet_id""")
def _(t: Tables) -> DataFrame:
    return graph.summary_lines(t.edges, t.entities, t.outlets)


@query("ownership_full_chains")
def _(t: Tables) -> DataFrame:
    return graph.chains(t.edges, t.entities, starts(t).select(F.col("root").alias("base")))


@query("ownership_change_log", ("b_outlets", "b_articles"), """SELECT o.outlet_id, o.display_name AS before, o.display_name || ' (moved)' AS after
FROM b_outlets o WHERE o.outlet_id IN (SELECT outlet_id FROM b_articles) AND o.outlet_id % 3 = 1""")
def _(t: Tables) -> DataFrame:
    seen = t.articles.select("outlet_id").distinct()
    before = t.outlets.join(seen, "outlet_id", "left_semi").select("outlet_id", F.col("display_name").alias("line"))
    moved = F.when(F.col("outlet_id") % 3 == 1, F.concat("display_name", F.lit(" (moved)"))).otherwise(F.col("display_name"))
    return graph.change_log(before, t.outlets.select("outlet_id", moved.alias("line")))


@query("ownership_orphans", GRAPH, """, keep(node) AS (SELECT entity_id FROM b_outlets WHERE entity_id IS NOT NULL
  UNION SELECT child FROM b_edges WHERE source = 'manual' UNION SELECT parent FROM b_edges WHERE source = 'manual')
, up(node) AS (SELECT node FROM keep UNION SELECT e.parent FROM up u JOIN b_edges e ON e.child = u.node)
SELECT entity_id FROM b_entities WHERE entity_id NOT IN (SELECT node FROM up)""")
def _(t: Tables) -> DataFrame:
    return graph.unreachable(t.entities, t.edges, t.outlets).select("entity_id")


@query("owner_league_table", ("b_edges", "b_entities", "b_outlets", "b_articles"), COUNTS + CLOSURE + """
SELECT r.node AS entity_id, e.name, count(*) AS outlets, CAST(sum(coalesce(c.recent, 0)) AS BIGINT) AS recent FROM reach r JOIN b_outlets o ON o.entity_id = r.root
LEFT JOIN counts c ON c.outlet_id = o.outlet_id JOIN b_entities e ON e.entity_id = r.node
WHERE r.root <> r.node AND r.node NOT IN (SELECT child FROM live) GROUP BY r.node, e.name""")
def _(t: Tables) -> DataFrame:
    return graph.league_table(t.edges, t.entities, t.outlets, article_counts(t), t.own.above(starts(t)))


@query("owner_outlets", ("b_edges", "b_entities", "b_outlets", "b_articles"), COUNTS + ORDERED + """
, paths(root, node, depth, path, key) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, [CAST(0 AS BIGINT)], CAST([] AS VARCHAR[])
  UNION ALL SELECT p.root, l.child, p.depth + 1, list_append(p.path, l.child), list_append(p.key, l.r || l.name || lpad(CAST(l.child AS VARCHAR), 12, '0'))
  FROM paths p JOIN live l ON l.parent = p.node WHERE NOT list_contains(p.path, l.child))
, best AS (SELECT *, row_number() OVER (PARTITION BY root, node ORDER BY depth, key) AS n FROM paths)
SELECT b.root AS owner, o.outlet_id, array_to_string(b.path[2:len(b.path) - 1], '>') AS via, coalesce(c.total, 0) AS total, coalesce(c.recent, 0) AS recent
FROM best b JOIN b_outlets o ON o.entity_id = b.node LEFT JOIN counts c ON c.outlet_id = o.outlet_id WHERE b.n = 1""")
def _(t: Tables) -> DataFrame:
    owner = t.entities.where(F.col("entity_id") == 0)
    rows = graph.owned_outlets(t.edges, t.entities, t.outlets, article_counts(t), owner, t.own.below(owner.select(F.col("entity_id").alias("root"))))
    return rows.select("owner", "outlet_id", text("via").alias("via"), "total", "recent")


@query("owner_options", GRAPH, CLOSURE + "SELECT DISTINCT r.node AS entity_id, e.name FROM reach r JOIN b_entities e ON e.entity_id = r.node WHERE r.node <> r.root")
def _(t: Tables) -> DataFrame:
    return graph.owner_options(t.edges, t.entities, t.outlets, t.own.above(starts(t)))


@query("filter_options", ("b_edges", "b_entities", "b_outlets", "b_articles"), CLOSURE + """
SELECT 'country' AS kind, CAST(country AS VARCHAR) AS value FROM b_outlets WHERE active GROUP BY country
UNION ALL SELECT 'outlet', domain FROM b_outlets WHERE active UNION ALL SELECT DISTINCT 'tag', tag FROM b_articles
UNION ALL SELECT DISTINCT 'owner', e.name FROM reach r JOIN b_entities e ON e.entity_id = r.node WHERE r.node <> r.root""")
def _(t: Tables) -> DataFrame:
    active = t.outlets.where("active")
    part = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")).distinct()
    owners = graph.owner_options(t.edges, t.entities, t.outlets, t.own.above(starts(t)))
    return (part("country", active, "country").unionByName(part("outlet", active, "domain"))
            .unionByName(part("tag", t.articles, "tag")).unionByName(part("owner", owners, "name")))


@query("owner_mention_report", ("b_edges", "b_entities", "b_outlets", "b_articles", "b_mentions"), UP_PATHS + """
, named AS (SELECT article_id, entity_id, count(*) AS mentions FROM b_mentions GROUP BY article_id, entity_id)
SELECT a.article_id, n.entity_id, n.mentions, array_to_string(list_reverse(b.path), '>') AS path FROM named n JOIN b_articles a ON a.article_id = n.article_id
JOIN b_outlets o ON o.outlet_id = a.outlet_id JOIN best b ON b.root = o.entity_id AND b.node = n.entity_id AND b.n = 1 AND b.depth > 0
WHERE a.seen >= TIMESTAMP '2024-01-08 00:00:00'""")
def _(t: Tables) -> DataFrame:
    named = t.mentions.groupBy("article_id", "entity_id").agg(F.count("*").alias("mentions"))
    recent = t.articles.where(F.col("seen") >= F.lit("2024-01-08 00:00:00").cast("timestamp"))
    rows = reports.owner_mentions(recent, t.outlets, named, t.edges, t.entities, t.own.above(starts(t)))
    return rows.select("article_id", "entity_id", "mentions", text("path").alias("path"))


@query("ownership_report_flags", GRAPH, """SELECT o.outlet_id, CASE WHEN o.entity_id IS NULL THEN 'no item' WHEN NOT EXISTS (SELECT 1 FROM b_edges e WHERE e.child = o.entity_id AND e.source <> 'set_aside')
THEN 'no owner listed' ELSE '' END || CASE WHEN position('5' IN en.name) > 0 THEN ';website item' ELSE '' END AS flags
FROM b_outlets o LEFT JOIN b_entities en ON en.entity_id = o.entity_id WHERE o.active AND o.entity_id IS NOT NULL
UNION ALL SELECT outlet_id, 'no item' FROM b_outlets WHERE active AND entity_id IS NULL""")
def _(t: Tables) -> DataFrame:
    # The names here hold no dots, so '5' plays the part of the dot in a website's name.
    rows = reports.report_flags(t.outlets.where("active"), t.entities.withColumn("description", F.lit("")), t.edges, site_mark="5")
    return rows.select("outlet_id", "flags")


@query("entity_owner_types", ("b_entities",), """SELECT entity_id, CASE entity_id % 4 WHEN 0 THEN 'person' WHEN 1 THEN CASE WHEN kind = 'public company' THEN kind ELSE 'Trust fund' END
WHEN 2 THEN 'Crown Corporation' ELSE CASE WHEN kind = 'public company' THEN kind ELSE 'broadcaster' END END AS owner_type FROM b_entities""")
def _(t: Tables) -> DataFrame:
    n = F.col("entity_id") % 4
    lead = F.when(n == 0, "human").when(n == 1, "Trust fund").when(n == 2, "Crown Corporation").otherwise("broadcaster")
    text = F.concat(F.when(n == 3, "broadcaster; ").otherwise(""), F.col("kind"), F.lit("; "), lead)
    return t.entities.select("entity_id", ids.owner_type(ids.kinds_of(text)).alias("owner_type"))
