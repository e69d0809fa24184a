"""The ownership graph as an edge table (child, parent, relation, share, source): closures, paths, climbs.

Closures are fixpoints of a join, one round per level. Each round is written to the checkpoint folder, so plans stay
short and only new (root, node) pairs are expanded: loops end by themselves.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.session import cut, is_empty

SUMMARY_DEPTH = 3


def current(edges: DataFrame) -> DataFrame:
    """Edges in force: statements set aside by a correction are kept in the table but not followed."""
    return edges.where(F.col("source") != "set_aside")


def minority(relation: Column, share: Column) -> Column:
    """A stated stake under half: a shareholder, not an owner."""
    return F.coalesce((relation == "owned_by") & (share < 0.5), F.lit(False))


def _steps(edges: DataFrame, up: bool) -> DataFrame:
    src, dst = ("child", "parent") if up else ("parent", "child")
    return edges.select(F.col(src).alias("_at"), F.col(dst).alias("_to"))


def reach(edges: DataFrame, roots: DataFrame, up: bool = True, include_roots: bool = True,
          max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) for everything reachable from each root; depth is the shortest."""
    steps = cut(_steps(edges, up).distinct())  # read once per level
    start = roots.select("root").distinct()
    frontier = cut(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")))
    levels = [frontier]
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        met = reduce(DataFrame.unionByName, levels).select("root", "node")
        fresh = (
            frontier.join(steps, frontier["node"] == steps["_at"])
            .select("root", F.col("_to").alias("node")).distinct()
            .join(met, ["root", "node"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = cut(fresh)
        if is_empty(frontier):
            break
        levels.append(frontier)
    pairs = reduce(DataFrame.unionByName, levels)
    return pairs if include_roots else pairs.where(F.col("depth") > 0)


def walk(edges: DataFrame, names: DataFrame, roots: DataFrame, up: bool = True) -> DataFrame:
    """(root, node, depth, path, rank): everything above (or below) each root with one shortest path, root first.

    Ties follow the order a breadth-first reading of the records gives: owned_by before parent_org, then the
    parent's name, then the order of the records. That order is the lexicographic order of the edge keys along the
    path, so `rank` is an array that sorts nodes nearest first.
    """
    named = edges.join(names.select(F.col("entity_id").alias("parent"), F.col("name").alias("_name")), "parent")
    src, dst = ("child", "parent") if up else ("parent", "child")
    nth = F.col("edge_no") if "edge_no" in edges.columns else F.col(dst).cast("bigint")
    steps = cut(named.select(
        F.col(src).alias("_at"), F.col(dst).alias("_to"),
        F.struct((F.col("relation") != "owned_by").alias("r"), F.col("_name").alias("n"), nth.alias("e")).alias("_key"),
    ))
    start = roots.select("root").distinct()
    key_type = "array<struct<r:boolean,n:string,e:bigint>>"
    frontier = cut(start.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"),
                                F.array().cast(key_type).alias("rank"), F.array("root").alias("path")))
    levels = [frontier]
    depth = 0
    while True:
        depth += 1
        met = reduce(DataFrame.unionByName, levels).select("root", "node")
        fresh = (
            frontier.join(steps, frontier["node"] == steps["_at"])
            .select("root", F.col("_to").alias("node"),
                    F.concat("rank", F.array(F.col("_key").cast("struct<r:boolean,n:string,e:bigint>"))).alias("rank"),
                    F.concat("path", F.array("_to")).alias("path"))
            .join(met, ["root", "node"], "left_anti")
            .groupBy("root", "node").agg(F.min(F.struct("rank", "path")).alias("best"))
            .select("root", "node", F.lit(depth).alias("depth"), "best.rank", "best.path")
        )
        frontier = cut(fresh)
        if is_empty(frontier):
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def tops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the (root, node) pairs, those whose node has no parent of its own (the root itself does not count)."""
    with_parent = current(edges).select(F.col("child").alias("node")).distinct()
    return pairs.where(F.col("root") != F.col("node")).join(with_parent, "node", "left_anti")


def first_owner(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Per child, the one step a climb takes: (child, parent, relation, stop, more).

    `stop` children are where climbs end: public companies and children with shareholders only. `more` says that
    something is passed over there. One aggregate per child; no ordering window.
    """
    parent = entities.select(F.col("entity_id").alias("parent"), F.col("name").alias("_name"))
    nth = F.col("edge_no") if "edge_no" in edges.columns else F.col("parent").cast("bigint")
    rows = current(edges).hint("merge").join(parent, "parent").withColumn(
        "_key", F.struct((F.col("relation") != "owned_by").alias("r"), F.col("_name").alias("n"), nth.alias("e")))
    minor = minority(F.col("relation"), F.col("share"))
    per_child = rows.groupBy("child").agg(
        F.min_by(F.struct("parent", "relation"), F.when(~minor, F.col("_key"))).alias("_first"),
        F.count_if(~minor).alias("_owners"),
        F.count("*").alias("_edges"),
    )
    public = entities.select(F.col("entity_id").alias("child"), F.array_contains("kinds", "public company").alias("_public"))
    joined = per_child.hint("merge").join(public, "child", "left")
    stop = F.coalesce(F.col("_public"), F.lit(False)) | (F.col("_owners") == 0)
    return joined.select(
        "child", F.when(~stop, F.col("_first.parent")).alias("parent"), F.when(~stop, F.col("_first.relation")).alias("relation"),
        stop.alias("stop"), (stop | (F.col("_edges") > 1)).alias("more"))


def climb(first: DataFrame, starts: DataFrame) -> DataFrame:
    """From each (base, start) follow `first_owner` until a stop, a loop or the top.

    Returns (base, start, top, steps, more): `steps` is array<struct<parent, relation>>, `top` where the line ends.

    The steps are worked out once. Each round is a join by key: written, both sides look small enough for the driver to send round, in memory
    they aren't.
    """
    step_type = "array<struct<parent:bigint,relation:string>>"
    live = cut(starts.select("base", "start").distinct().select(
        "base", "start", F.col("start").alias("top"), F.array().cast(step_type).alias("steps"), F.lit(False).alias("more")))
    ended = []
    nxt = cut(first.select(F.col("child").alias("top"), F.col("parent").alias("_p"), F.col("relation").alias("_r"), F.col("more").alias("_m")))
    while True:
        tried = live.hint("merge").join(nxt, "top", "left")
        been = F.array_contains(F.transform("steps", lambda s: s["parent"]), F.col("_p")) | (F.col("_p") == F.col("base")) | (F.col("_p") == F.col("start"))
        goes = F.coalesce(~been, F.lit(False))
        more = F.col("more") | F.coalesce(F.col("_m"), F.lit(False))
        moved = cut(tried.select(
            "base", "start", F.when(goes, F.col("_p")).otherwise(F.col("top")).alias("top"),
            F.when(goes, F.concat("steps", F.array(F.struct(F.col("_p").alias("parent"), F.col("_r").alias("relation")).cast("struct<parent:bigint,relation:string>"))))
            .otherwise(F.col("steps")).alias("steps"),
            more.alias("more"), goes.alias("_goes")))
        ended.append(moved.where(~F.col("_goes")).drop("_goes"))
        live = moved.where("_goes").drop("_goes")
        if is_empty(live):
            return reduce(DataFrame.unionByName, ended)


def owner_groups(edges: DataFrame, entities: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, owners): where each owner's line ends, as array<struct<key, name, id>> in name order; [] when no
    majority owner is recorded."""
    base = bases.select("base").distinct()
    up = current(edges)
    direct = up.where(~minority(F.col("relation"), F.col("share"))).select(F.col("child").alias("base"), F.col("parent").alias("start"))
    lines = climb(first_owner(edges, entities), direct.join(base, "base", "left_semi"))
    named = lines.hint("merge").join(entities.select(F.col("entity_id").alias("top"), "name"), "top")
    grouped = named.groupBy("base").agg(F.array_sort(F.collect_set(F.struct(
        F.lower("name").alias("key"), "name", F.col("top").alias("id")))).alias("owners"))
    empty = F.array().cast("array<struct<key:string,name:string,id:bigint>>")
    return base.hint("merge").join(grouped, "base", "left").withColumn("owners", F.coalesce("owners", empty))


def percent4(share: Column) -> Column:
    """A stake in percent with at most four significant digits, as a person would write it."""
    pct = share * 100
    digits = F.when(pct >= 1, F.greatest(F.lit(0), F.lit(3) - F.floor(F.log10(pct)))).otherwise(F.lit(3) - F.floor(F.log10(pct)))
    scaled = F.round(pct * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.regexp_replace(F.format_string("%.10f", scaled), r"\.?0+$", "")


def summary_lines(edges: DataFrame, entities: DataFrame, outlets: DataFrame) -> DataFrame:
    """(outlet_id, line): the one-line ownership summary of every outlet.

    Direct owners, each parent once (owned_by first), then the line above the first of them, cut at three owners.
    """
    have = outlets.select("outlet_id", F.col("entity_id").alias("base"))
    known = have.hint("merge").join(entities.select(F.col("entity_id").alias("base"), F.lit(True).alias("_known")), "base", "left")
    up = current(edges).select(F.col("child").alias("base"), "parent", "relation", "share",
                               *([F.col("edge_no")] if "edge_no" in edges.columns else []))
    nth = F.col("edge_no") if "edge_no" in edges.columns else F.col("parent").cast("bigint")
    names = entities.select(F.col("entity_id").alias("parent"), "name")
    near = up.hint("merge").join(have.select("base").distinct(), "base", "left_semi").hint("merge").join(names, "parent")
    key = F.struct((F.col("relation") != "owned_by").alias("r"), F.col("name").alias("n"), nth.alias("e"))
    once = near.withColumn("_key", key).groupBy("base", "parent").agg(
        F.min_by(F.struct("_key", "relation", "share", "name"), "_key").alias("o"))
    # One entity's direct owners: a handful of records.
    direct = once.groupBy("base").agg(F.array_sort(F.collect_list(F.struct(
        F.col("o._key").alias("k"), F.col("parent").alias("id"), F.col("o.relation").alias("relation"),
        F.col("o.share").alias("share"), F.col("o.name").alias("name")))).alias("direct"))
    direct = cut(direct)
    firsts = direct.select("base", F.col("direct")[0]["id"].alias("start"))
    lines = climb(first_owner(edges, entities), firsts)
    steps = lines.select("base", "more", F.size("steps").alias("n"), F.posexplode_outer(F.slice("steps", 1, SUMMARY_DEPTH)).alias("i", "s"))
    above = (
        steps.select("base", "more", "n", "i", F.col("s.parent").alias("parent"), F.col("s.relation").alias("relation"))
        .hint("merge").join(names, "parent", "left").groupBy("base", "more", "n")
        .agg(F.array_sort(F.collect_list(F.when(F.col("parent").isNotNull(), F.struct("i", "relation", "name")))).alias("above"))
        .select("base", "above", (F.col("more") | (F.col("n") > SUMMARY_DEPTH)).alias("more"))
    )
    whose = lambda s: F.concat(F.when(s["relation"] == "owned_by", ", whose owner is ").otherwise(", whose parent organization is "), s["name"])
    tail = F.concat(F.array_join(F.transform("above", whose), ""), F.when(F.col("more"), ", …").otherwise(""))

    def part(o: Column, i: Column) -> Column:
        label = (F.when(minority(o["relation"], o["share"]), "Shareholder").when(o["relation"] == "owned_by", "Owned by")
                 .otherwise("Parent organization"))
        label = F.when(i == 0, label).otherwise(F.lower(label))
        colon = F.when(o["relation"] == "parent_org", ":").otherwise("")
        stake = F.when(o["share"] > 0, F.concat(F.lit(" ("), percent4(o["share"]), F.lit("%)"))).otherwise("")
        return F.concat(label, colon, F.lit(" "), o["name"], stake, F.when(i == 0, F.col("_tail")).otherwise(""))

    full = (
        known.hint("merge").join(direct, "base", "left").hint("merge").join(above, "base", "left")
        .withColumn("_tail", F.coalesce(tail, F.lit("")))
    )
    text = F.array_join(F.transform("direct", part), "; ")
    return full.select(
        "outlet_id",
        F.when(F.col("_known").isNull(), "Owner: no record found")
        .when(F.col("direct").isNull(), "No owner listed on Wikidata").otherwise(text).alias("line"))


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(outlet_id, before, after) for outlets in both snapshots whose line differs."""
    return before.select("outlet_id", F.col("line").alias("before")).join(
        after.select("outlet_id", F.col("line").alias("after")), "outlet_id").where(F.col("before") != F.col("after"))


def unreachable(entities: DataFrame, edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """Entities neither at nor above an outlet or an end of a manual edge. Every kind of edge is followed."""
    manual = edges.where(F.col("source") == "manual")
    keep = (
        outlets.where(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("node"))
        .unionByName(manual.select(F.col("child").alias("node"))).unionByName(manual.select(F.col("parent").alias("node")))
    )
    # One shared root: only which nodes are reached matters, not from where.
    reached = spread_from(edges, keep)
    return entities.join(reached.select(F.col("node").alias("entity_id")), "entity_id", "left_anti")


def spread_from(edges: DataFrame, seeds: DataFrame, up: bool = True) -> DataFrame:
    """(node, depth): nodes reachable from any seed. Smaller than `reach`: one row per node."""
    steps = cut(_steps(edges, up).distinct())  # read once per level
    frontier = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    levels, depth = [frontier], 0
    while True:
        depth += 1
        met = reduce(DataFrame.unionByName, levels).select("node")
        frontier = cut(
            frontier.join(steps, frontier["node"] == steps["_at"]).select(F.col("_to").alias("node")).distinct()
            .join(met, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if is_empty(frontier):
            return reduce(DataFrame.unionByName, levels)
        levels.append(frontier)


def _list_chain(edges: pd.DataFrame) -> pd.DataFrame:
    """One outlet's ancestors, depth first: each owner's own chain is spelled out at its first mention only."""
    rows: list[tuple] = []
    base = int(edges["base"].iloc[0])
    above: dict[int, dict[int, list]] = {}
    for e in edges.sort_values(["r", "name", "edge_no"]).itertuples():
        above.setdefault(int(e.child), {}).setdefault(int(e.parent), []).append(e)
    spelled = {base}
    # An explicit stack of (level, line below, pending parents): a long chain of holdings must not hit a recursion limit.
    stack = [(1, (base,), iter(above.get(base, {}).items()))]
    while stack:
        level, line, todo = stack[-1]
        nxt = next(todo, None)
        if nxt is None:
            stack.pop()
            continue
        parent, links = nxt
        minor = all(x.minor for x in links)
        shares = [x.share for x in links if x.share == x.share and x.share is not None]
        labels = dict.fromkeys(
            "Shareholder" if x.minor else "Owned by" if x.relation == "owned_by" else "Parent organization"
            for x in links if minor or not x.minor)
        cycle = parent in line
        listed = not cycle and parent in spelled and parent in above
        rows.append((base, len(rows) + 1, level, line[-1], parent, " · ".join(labels), max(shares, default=None), minor, cycle, listed))
        if not cycle and parent not in spelled and not minor:
            spelled.add(parent)
            stack.append((level + 1, (*line, parent), iter(above.get(parent, {}).items())))
    return pd.DataFrame(rows, columns=["base", "step", "level", "child", "parent", "label", "share", "minority", "cycle", "listed"])


def chains(edges: DataFrame, entities: DataFrame, bases: DataFrame) -> DataFrame:
    """Every base's full chain as a flat listing (base, step, level, child, parent, label, share, minority, cycle,
    listed). A group is the records above one entity, which the closure has already narrowed down."""
    up = current(edges)
    above = reach(up, bases.select(F.col("base").alias("root")), up=True)
    nth = F.col("edge_no") if "edge_no" in edges.columns else F.col("parent").cast("bigint")
    rows = (
        above.select(F.col("root").alias("base"), F.col("node").alias("child"))
        .join(up, "child").join(entities.select(F.col("entity_id").alias("parent"), "name"), "parent")
        .select("base", "child", "parent", "relation", "share", "name", nth.alias("edge_no"),
                (F.col("relation") != "owned_by").alias("r"), minority(F.col("relation"), F.col("share")).alias("minor"))
    )
    schema = ("base bigint, step bigint, level bigint, child bigint, parent bigint, label string, share double, "
              "minority boolean, cycle boolean, listed boolean")
    return rows.groupBy("base").applyInPandas(_list_chain, schema)


def league_table(edges: DataFrame, entities: DataFrame, outlets: DataFrame, counts: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Owners with no recorded parent and the outlets below them other than themselves: (entity_id, name, outlets,
    recent). Reads upward from outlets, not down from every owner: `above` has what a stored closure knows of them, else they are walked."""
    own = outlets.where(F.col("entity_id").isNotNull()).select("outlet_id", F.col("entity_id").alias("root"))
    above = tops(edges, reach(current(edges), own.select("root"), up=True) if above is None else above)
    rows = above.join(own, "root").join(counts.select("outlet_id", "recent"), "outlet_id", "left")
    return (
        rows.groupBy(F.col("node").alias("entity_id")).agg(F.count("*").alias("outlets"), F.coalesce(F.sum("recent"), F.lit(0)).alias("recent"))
        .join(entities.select("entity_id", "name"), "entity_id")
    )


def owned_outlets(edges: DataFrame, entities: DataFrame, outlets: DataFrame, counts: DataFrame, owners: DataFrame, below: DataFrame | None = None) -> DataFrame:
    """(owner, outlet_id, via, total, recent): outlets at or below each owner, with the entities in between."""
    paths = walk(current(edges), entities, owners.select(F.col("entity_id").alias("root")), up=False) if below is None else below
    hits = paths.select(F.col("root").alias("owner"), F.col("node").alias("entity_id"), "path").join(
        outlets.select("outlet_id", "entity_id", "display_name"), "entity_id")
    via = F.when(F.size("path") > 2, F.slice("path", 2, F.size("path") - 2)).otherwise(F.array().cast("array<bigint>"))
    return hits.select("owner", "outlet_id", "display_name", via.alias("via")).join(counts, "outlet_id", "left").select(
        "owner", "outlet_id", "display_name", "via",
        F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("recent", F.lit(0)).alias("recent"))


def owner_options(edges: DataFrame, entities: DataFrame, outlets: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """Everything above any outlet, once each."""
    seeds = outlets.where(F.col("entity_id").isNotNull()).select(F.col("entity_id").alias("root"))
    above = (reach(current(edges), seeds, up=True) if above is None else above).where(F.col("root") != F.col("node"))
    return above.select(F.col("node").alias("entity_id")).distinct().join(entities.select("entity_id", "name"), "entity_id")


