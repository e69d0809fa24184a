"""Building the ownership records: statements, outlet matches, corrections, edges, hand-made entries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import ids, url
from mediagraph.operators import graph

AUTO = ("unmatched", "auto", "ambiguous")
WHY_WEBSITE, WHY_SEARCH = "its official website", "a search for its name; its official website checked"


def best_statements(statements: DataFrame) -> DataFrame:
    """Statements in force per (entity, prop): no deprecated or valueless ones, only preferred ones where there are any, none
    that has ended (`ended`: boolean)."""
    usable = statements.where((F.col("rank") != "deprecated") & (F.col("snaktype") == "value"))
    # Which (entity, prop) have a preferred statement: a small set found with partial aggregation, then a join.
    chosen = usable.where(F.col("rank") == "preferred").select("entity", "prop", F.lit(True).alias("_has")).distinct()
    best = usable.join(chosen, ["entity", "prop"], "left").where(F.col("_has").isNull() | (F.col("rank") == "preferred"))
    return best.where(~F.col("ended")).drop("_has")


def news_items(instances: DataFrame, subclasses: DataFrame, classes: DataFrame) -> DataFrame:
    """(qid) of items that are an instance of a news class or of any subclass of one. `instances` is (qid, class), `subclasses`
    (child, parent), `classes` (node)."""
    below = graph.spread_from(subclasses, classes, up=False)
    return instances.join(below.select(F.col("node").alias("class")), "class", "left_semi").select("qid").distinct()


def website_tiers(searched: DataFrame, outlets: DataFrame) -> DataFrame:
    """(domain, tier, qid, nth) of name-search hits whose website is on the outlet's domains: exactly (1), or on a
    subdomain (2). `searched` is (domain, nth, qid, websites)."""
    own = F.concat(F.array("domain"), F.coalesce("aliases", F.array().cast("array<string>")))
    hits = searched.join(outlets.select("domain", own.alias("_own")), "domain")
    hosts = F.transform("websites", lambda w: url.without_www(url.host_of(w)))
    exact = F.exists(hosts, lambda h: F.array_contains("_own", h))
    near = F.exists(hosts, lambda h: F.exists("_own", lambda d: h.endswith(F.concat(F.lit("."), d))))
    tiers = F.explode(F.filter(F.array(F.when(exact, F.lit(1)), F.when(near, F.lit(2))), lambda t: t.isNotNull()))
    return hits.select("domain", tiers.alias("tier"), "qid", "nth")


def decide_matches(outlets: DataFrame, by_website: DataFrame, searched: DataFrame, news: DataFrame) -> DataFrame:
    """(domain, match_status, qid, match_note, candidates) for outlets still matched automatically.

    `by_website` is (domain, qid). The first tier with any candidate decides: one candidate is the match, or the only news outlet
    among several; otherwise the outlet is ambiguous with that tier's candidates. A search counts only where no item
    lists the website.
    """
    todo = outlets.where(F.col("match_status").isin(*AUTO))
    site = by_website.select("domain", F.lit(0).alias("tier"), "qid", F.substring("qid", 2, 12).cast("bigint").alias("nth"))
    cands = site.unionByName(website_tiers(searched, outlets)).join(todo.select("domain"), "domain", "left_semi")
    cands = cands.join(news.select("qid", F.lit(True).alias("_news")), "qid", "left")
    tiers = cands.groupBy("domain", "tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("_news")).alias("media"), F.min("qid").alias("one"),
        F.min(F.when(F.col("_news"), F.col("qid"))).alias("medium"), F.array_sort(F.collect_list(F.struct("nth", "qid"))).alias("all"))
    first = tiers.groupBy("domain").agg(F.min_by(F.struct("tier", "n", "media", "one", "medium", "all"), "tier").alias("t"))
    rows = todo.select("domain").join(first, "domain", "left")
    pick = F.when(F.col("t.n") == 1, F.col("t.one")).when(F.col("t.media") == 1, F.col("t.medium"))
    among = F.concat(F.lit(f"{WHY_WEBSITE}; the only news outlet among "), F.col("t.n").cast("string"), F.lit(" items listing that website"))
    note = F.when(pick.isNull(), "").when(F.col("t.tier") > 0, WHY_SEARCH).when(F.col("t.n") == 1, WHY_WEBSITE).otherwise(among)
    status = F.when(pick.isNotNull(), "auto").when(F.col("t").isNotNull(), "ambiguous").otherwise("unmatched")
    listed = F.when(pick.isNull() & F.col("t").isNotNull(), F.transform("t.all", lambda c: c["qid"])).otherwise(F.array().cast("array<string>"))
    return rows.select("domain", status.alias("match_status"), pick.alias("qid"), note.alias("match_note"), listed.alias("candidates"))


def resolve_names(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """(ref, qid): a reference to an item is its id, or the exact name (without case) of exactly one item."""
    literal = refs.where(ids.is_qid(F.upper("ref"))).select("ref", F.upper("ref").alias("qid"))
    unique = entities.groupBy(F.lower("name").alias("_name")).agg(F.count("*").alias("_n"), F.min("qid").alias("qid")).where("_n = 1")
    named = refs.where(~ids.is_qid(F.upper("ref"))).withColumn("_name", F.lower("ref")).join(unique, "_name").select("ref", "qid")
    return literal.unionByName(named).distinct()


def resolve_corrections(corrections: DataFrame, entities: DataFrame, outlets: DataFrame) -> DataFrame:
    """Corrections (key, outlet, entity, action, relation, target, ...) with `child` and `parent` ids; null where not resolved (an
    outlet not matched, a name unknown or shared, or both ends the same)."""
    refs = corrections.select(F.col("target").alias("ref")).unionByName(corrections.where(F.col("entity").isNotNull()).select(F.col("entity").alias("ref"))).distinct()
    known = resolve_names(refs, entities)
    by_outlet = outlets.select(F.col("domain").alias("outlet"), F.col("qid").alias("_outlet_qid"))
    rows = (
        corrections.join(by_outlet, "outlet", "left")
        .join(known.select(F.col("ref").alias("entity"), F.col("qid").alias("_entity_qid")), "entity", "left")
        .join(known.select(F.col("ref").alias("target"), F.col("qid").alias("_target_qid")), "target", "left"))
    child = F.when(F.col("outlet").isNotNull(), F.col("_outlet_qid")).otherwise(F.col("_entity_qid"))
    good = child.isNotNull() & F.col("_target_qid").isNotNull() & (child != F.col("_target_qid"))
    return rows.withColumn("child", F.when(good, child)).withColumn("parent", F.when(good, F.col("_target_qid"))).select(*corrections.columns, "child", "parent")


def correction_states(resolved: DataFrame, claims: DataFrame, examined: DataFrame) -> DataFrame:
    """Resolved corrections with a `state`: not_found, retired (the source already agrees), applied, or null when the child was
    not examined in this run. `claims` is (child, parent, relation), `examined` (child)."""
    listed = claims.select("child", "parent", "relation", F.lit(True).alias("_listed")).distinct()
    seen = examined.select("child", F.lit(True).alias("_seen")).distinct()
    rows = resolved.join(listed, ["child", "parent", "relation"], "left").join(seen, "child", "left")
    agrees = F.when(F.col("action") == "add", F.col("_listed").isNotNull()).otherwise(F.col("_listed").isNull())
    state = F.when(F.col("child").isNull(), "not_found").when(F.col("_seen").isNull(), F.lit(None)).when(agrees, "retired").otherwise("applied")
    return rows.withColumn("state", state).drop("_listed", "_seen")


def build_edges(stored: DataFrame, claims: DataFrame, entities: DataFrame, examined: DataFrame, states: DataFrame) -> DataFrame:
    """The edge table after a run: manual edges and edges of children not examined stay; examined children get their
    corrections, set-aside statements and current statements anew.

    `claims` is (child, parent, relation, share, start, source_url); `entities` (qid, died) is everything fetched. A statement pointing at an
    owner who has died is out of date and left out.
    """
    mark = examined.select("child").distinct()
    kept = stored.where(F.col("source") == "manual").unionByName(stored.where(F.col("source") != "manual").join(mark, "child", "left_anti"))
    live = states.where(F.coalesce(F.col("state"), F.lit("")) == "applied")
    known = entities.select(F.col("qid").alias("parent"), "died")
    added = live.where(F.col("action") == "add").join(known, "parent").select(
        "child", "parent", "relation", F.lit(None).cast("double").alias("share"), F.lit(None).cast("string").alias("start"),
        F.lit("correction").alias("source"), F.col("source").alias("source_url"))
    aside = live.where(F.col("action") == "remove").select("child", "parent", "relation", F.col("source").alias("_aside"))
    rows = claims.join(mark, "child", "left_semi").join(known, "parent").join(aside, ["child", "parent", "relation"], "left")
    rows = rows.where(F.col("_aside").isNotNull() | F.col("died").isNull())
    stated = rows.select("child", "parent", "relation", "share", "start", F.when(F.col("_aside").isNotNull(), "set_aside").otherwise("wikidata").alias("source"),
                         F.coalesce("_aside", "source_url").alias("source_url"))
    fresh = added.unionByName(stated)
    fresh = fresh.groupBy("child", "parent", "relation", "source").agg(F.min_by(F.struct("share", "start", "source_url"), "source_url").alias("_v")).select(
        "child", "parent", "relation", "_v.share", "_v.start", "source", "_v.source_url")
    return kept.unionByName(fresh.select(kept.columns))


# ---------------------------------------------------------------- hand-made entries

def pin_items(outlets: DataFrame, pins: DataFrame, now: datetime) -> DataFrame:
    """Outlets pinned to an item, or to none (`pins`: domain, qid). Automatic matching skips them from then on."""
    rows = outlets.join(pins.select("domain", F.col("qid").alias("_qid"), F.lit(True).alias("_pin")), "domain", "left")
    on = F.coalesce(F.col("_pin"), F.lit(False))
    return (rows.withColumn("qid", F.when(on, F.col("_qid")).otherwise(F.col("qid")))
            .withColumn("match_status", F.when(on, "manual").otherwise(F.col("match_status")))
            .withColumn("match_note", F.when(on, "").otherwise(F.col("match_note")))
            .withColumn("ownership_checked", F.when(~on, F.col("ownership_checked"))).select(outlets.columns))


def confirm(outlets: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Automatic matches become confirmed: all of them, or those of some outlets."""
    test = F.col("match_status") == "auto"
    if domains is not None:
        test = test & F.col("domain").isin(domains)
    return outlets.withColumn("match_status", F.when(test, "confirmed").otherwise(F.col("match_status")))


def valid_manual(adds: DataFrame) -> Column:
    return (F.col("relation").isin("owned_by", "parent_org") & url.is_http_url(F.col("source_url"))
            & ids.is_qid(F.col("child")) & ids.is_qid(F.col("parent")) & (F.col("child") != F.col("parent")))


def add_manual_edges(edges: DataFrame, adds: DataFrame) -> DataFrame:
    """Merge manual edges by (child, parent, relation): a repeated one updates its source. Rows without a source or with equal
    or malformed ends are refused."""
    new = adds.where(valid_manual(adds)).withColumn("source", F.lit("manual"))
    for c, kind in (("share", "double"), ("start", "string")):
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(kind))
    old = edges.join(new.select("child", "parent", "relation", "source"), ["child", "parent", "relation", "source"], "left_anti")
    return old.select(edges.columns).unionByName(new.select(edges.columns))


def remove_manual_edges(edges: DataFrame, removes: DataFrame) -> DataFrame:
    gone = removes.select("child", "parent").withColumn("source", F.lit("manual"))
    return edges.join(gone, ["child", "parent", "source"], "left_anti").select(edges.columns)


def set_identifiers(identifiers: DataFrame, adds: DataFrame) -> DataFrame:
    """Merge identifiers by (entity, scheme, value) in standard form; a repeated one is due again. Malformed ones are refused."""
    new = adds.withColumn("value", ids.normalize_id(F.col("scheme"), F.col("value"))).where(F.col("value").isNotNull()).select(
        "entity_id", "scheme", "value", F.lit("manual").alias("source"), F.lit(None).cast("timestamp").alias("checked")).distinct()
    again = identifiers.join(new.select("entity_id", "scheme", "value", F.lit(True).alias("_again")), ["entity_id", "scheme", "value"], "left")
    old = again.withColumn("checked", F.when(F.col("_again").isNull(), F.col("checked"))).select(identifiers.columns)
    return old.unionByName(new.join(identifiers, ["entity_id", "scheme", "value"], "left_anti").select(identifiers.columns))


def remove_identifiers(identifiers: DataFrame, removes: DataFrame) -> DataFrame:
    gone = removes.select("entity_id", "scheme", ids.normalize_id(F.col("scheme"), F.col("value")).alias("value")).withColumn("source", F.lit("manual"))
    return identifiers.join(gone, ["entity_id", "scheme", "value", "source"], "left_anti").select(identifiers.columns)


