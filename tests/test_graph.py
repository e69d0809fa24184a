"""The ownership graph, matching, corrections and hand-made entries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediagraph.operators import graph, ownership

EDGES = "edge_no bigint, child bigint, parent bigint, relation string, share double, source string"
# CTV -> Bell Media -> BCE (public company) -> Fund; Joint has two owners; Loop1 <-> Loop2; Held has a shareholder only.
NAMES = {1: "CTV", 2: "Bell Media", 3: "BCE", 4: "Fund", 5: "Joint", 6: "Zed", 7: "Acme", 8: "Loop1", 9: "Loop2", 10: "Held", 11: "Aside", 12: "Alone"}
ROWS = [(1, 1, 2, "owned_by", None, "wikidata"), (2, 1, 2, "parent_org", None, "wikidata"), (3, 2, 3, "owned_by", None, "wikidata"), (4, 3, 4, "owned_by", 0.1, "wikidata"),
        (5, 5, 6, "owned_by", 0.5, "wikidata"), (6, 5, 7, "owned_by", 0.5, "wikidata"), (7, 7, 3, "parent_org", None, "manual"), (8, 8, 9, "owned_by", None, "wikidata"),
        (9, 9, 8, "owned_by", None, "wikidata"), (10, 10, 4, "owned_by", 0.25, "wikidata"), (11, 12, 11, "owned_by", None, "set_aside")]


@pytest.fixture(scope="module")
def world(spark):
    edges = spark.createDataFrame(ROWS, EDGES).cache()
    entities = spark.createDataFrame([(i, f"Q{i}", n, ["public company"] if n == "BCE" else [], "", []) for i, n in NAMES.items()],
                                     "entity_id bigint, qid string, name string, kinds array<string>, description string, aliases array<string>").cache()
    return edges, entities


def test_owner_groups(spark, world):
    bases = spark.createDataFrame([(i,) for i in NAMES], "base bigint")
    got = {r.base: [o.name for o in r.owners] for r in graph.owner_groups(*world, bases).collect()}
    # Loops end at the last step before they close; shareholders and set-aside records are no owners.
    assert got == {1: ["BCE"], 2: ["BCE"], 3: [], 4: [], 5: ["BCE", "Zed"], 6: [], 7: ["BCE"], 8: ["Loop2"], 9: ["Loop1"], 10: [], 11: [], 12: []}


def test_summary_lines(spark, world):
    outlets = spark.createDataFrame([(i, i) for i in NAMES] + [(99, None), (98, 77)], "outlet_id bigint, entity_id bigint")
    got = {r.outlet_id: r.line for r in graph.summary_lines(*world, outlets).collect()}
    assert got[1] == "Owned by Bell Media, whose owner is BCE, …"
    assert got[5] == "Owned by Acme (50%), whose parent organization is BCE, …; owned by Zed (50%)"
    assert got[10] == "Shareholder Fund (25%)"
    assert got[8] == "Owned by Loop2"
    assert got[12] == got[4] == "No owner listed on Wikidata"
    assert got[99] == got[98] == "Owner: no record found"


def test_chains(spark, world):
    bases = spark.createDataFrame([(1,), (5,), (8,), (10,)], "base bigint")
    rows = graph.chains(*world, bases).orderBy("base", "step").collect()
    shape = lambda b: [(r.level, r.parent, r.label, r.cycle, r.listed, r.minority) for r in rows if r.base == b]
    assert shape(1) == [(1, 2, "Owned by · Parent organization", False, False, False), (2, 3, "Owned by", False, False, False), (3, 4, "Shareholder", False, False, True)]
    assert shape(5) == [(1, 7, "Owned by", False, False, False), (2, 3, "Parent organization", False, False, False), (3, 4, "Shareholder", False, False, True), (1, 6, "Owned by", False, False, False)]
    assert shape(8) == [(1, 9, "Owned by", False, False, False), (2, 8, "Owned by", True, False, False)]
    assert shape(10) == [(1, 4, "Shareholder", False, False, True)]


def test_paths_and_closures(spark, world):
    edges, entities = world
    roots = spark.createDataFrame([(1,), (8,)], "root bigint")
    up = {(r.root, r.node): (r.depth, r.path) for r in graph.walk(graph.current(edges), entities, roots).collect()}
    assert up[1, 4] == (3, [1, 2, 3, 4]) and up[8, 9] == (1, [8, 9]) and (8, 8) in up and len(up) == 6
    reach = graph.reach(graph.current(edges), roots)
    again = graph.reach(graph.current(edges), reach.select(F.col("node").alias("root")).distinct())
    closed = {(r.root, r.node) for r in again.collect()}
    assert {(r.root, r.node) for r in reach.collect()} <= closed
    limited = graph.reach(graph.current(edges), roots, max_depth=1)
    assert {(r.root, r.node) for r in limited.collect()} == {(1, 1), (1, 2), (8, 8), (8, 9)}
    tops = graph.tops(edges, reach)
    assert {(r.root, r.node) for r in tops.collect()} == {(1, 4)}


def test_orphans(spark, world):
    edges, entities = world
    outlets = spark.createDataFrame([(1, 1), (2, None), (3, 12)], "outlet_id bigint, entity_id bigint")
    got = {r.entity_id for r in graph.unreachable(entities, edges, outlets).collect()}
    assert got == {5, 6, 8, 9, 10}  # 7 -> 3 is a manual edge; 11 is kept through the set-aside record


def test_match_tiers(spark):
    outlets = spark.createDataFrame([(d, a, s) for d, a, s in [
        ("one.ca", [], "unmatched"), ("news.ca", [], "auto"), ("many.ca", [], "auto"), ("exact.ca", ["exact.com"], "ambiguous"), ("sub.ca", [], "auto"), ("none.ca", [], "auto"), ("kept.ca", [], "confirmed")]],
        "domain string, aliases array<string>, match_status string")
    site = spark.createDataFrame([("one.ca", "Q1"), ("news.ca", "Q2"), ("news.ca", "Q3"), ("many.ca", "Q4"), ("many.ca", "Q15"), ("kept.ca", "Q6")], "domain string, qid string")
    search = spark.createDataFrame([("exact.ca", 0, "Q7", ["https://shop.exact.com/"]), ("exact.ca", 1, "Q8", ["https://www.exact.com/en"]), ("sub.ca", 0, "Q9", ["https://en.sub.ca"]), ("none.ca", 0, "Q10", ["https://else.org"])],
                                   "domain string, nth bigint, qid string, websites array<string>")
    got = {r.domain: (r.match_status, r.qid, r.candidates) for r in ownership.decide_matches(outlets, site, search, spark.createDataFrame([("Q3",)], "qid string")).collect()}
    assert got == {"one.ca": ("auto", "Q1", []), "news.ca": ("auto", "Q3", []), "many.ca": ("ambiguous", None, ["Q4", "Q15"]), "exact.ca": ("auto", "Q8", []),
                   "sub.ca": ("auto", "Q9", []), "none.ca": ("unmatched", None, [])}


def test_corrections_and_edges(spark):
    entities = spark.createDataFrame([("Q1", "Mag", None), ("Q2", "Old Owner", None), ("Q3", "New Owner", None), ("Q4", "Late", "1999"), ("Q5", "Twin", None), ("Q6", "twin", None)], "qid string, name string, died string")
    outlets = spark.createDataFrame([("mag.ca", "Q1"), ("lost.ca", None)], "domain string, qid string")
    fixes = spark.createDataFrame([
        ("k1", "mag.ca", None, "add", "owned_by", "new owner", "https://s/1"), ("k2", "mag.ca", None, "remove", "owned_by", "Q2", "https://s/2"), ("k3", None, "q1", "add", "parent_org", "Q5", "https://s/3"),
        ("k4", "lost.ca", None, "add", "owned_by", "Q2", "x"), ("k5", None, "TWIN", "add", "owned_by", "Q2", "x"), ("k6", None, "Q3", "remove", "owned_by", "Q2", "x"), ("k7", "mag.ca", None, "remove", "owned_by", "Q1", "x")],
        "key string, outlet string, entity string, action string, relation string, target string, source string")
    resolved = ownership.resolve_corrections(fixes, entities, outlets)
    assert {r.key: (r.child, r.parent) for r in resolved.collect()} == {
        "k1": ("Q1", "Q3"), "k2": ("Q1", "Q2"), "k3": ("Q1", "Q5"), "k4": (None, None), "k5": (None, None), "k6": ("Q3", "Q2"), "k7": (None, None)}
    claims = spark.createDataFrame([("Q1", "Q2", "owned_by", 0.6, "2001", "w"), ("Q1", "Q5", "parent_org", None, None, "w"), ("Q1", "Q4", "owned_by", None, None, "w"), ("Q1", "Q99", "owned_by", None, None, "w")],
                                   "child string, parent string, relation string, share double, start string, source_url string")
    examined = spark.createDataFrame([("Q1",)], "child string")
    states = ownership.correction_states(resolved, claims, examined)
    assert {r.key: r.state for r in states.collect()} == {"k1": "applied", "k2": "applied", "k3": "retired", "k4": "not_found", "k5": "not_found", "k6": None, "k7": "not_found"}
    stored = spark.createDataFrame([("Q1", "Q9", "owned_by", None, None, "manual", "m"), ("Q1", "Q8", "owned_by", None, None, "wikidata", "old"), ("Q7", "Q8", "owned_by", None, None, "wikidata", "other")],
                                   "child string, parent string, relation string, share double, start string, source string, source_url string")
    built = ownership.build_edges(stored, claims, entities, examined, states)
    want = {("Q1", "Q9", "manual", "m"), ("Q7", "Q8", "wikidata", "other"), ("Q1", "Q3", "correction", "https://s/1"), ("Q1", "Q2", "set_aside", "https://s/2"), ("Q1", "Q5", "wikidata", "w")}
    assert {(r.child, r.parent, r.source, r.source_url) for r in built.collect()} == want
    again = ownership.build_edges(built, claims, entities, examined, states)  # a second run changes nothing
    assert {(r.child, r.parent, r.source, r.source_url) for r in again.collect()} == want


def test_hand_made_entries(spark):
    from datetime import datetime

    edges = spark.createDataFrame([("Q1", "Q2", "owned_by", None, None, "manual", "old"), ("Q1", "Q2", "owned_by", None, None, "wikidata", "w")],
                                  "child string, parent string, relation string, share double, start string, source string, source_url string")
    adds = spark.createDataFrame([("Q1", "Q2", "owned_by", "https://new"), ("Q3", "Q4", "owned_by", ""), ("Q5", "Q5", "owned_by", "https://x"), ("Q6", "Q7", "parent_org", "https://y")], "child string, parent string, relation string, source_url string")
    got = ownership.add_manual_edges(edges, adds)
    assert {(r.child, r.source, r.source_url) for r in got.collect()} == {("Q1", "manual", "https://new"), ("Q1", "wikidata", "w"), ("Q6", "manual", "https://y")}
    left = ownership.remove_manual_edges(got, spark.createDataFrame([("Q1", "Q2")], "child string, parent string"))
    assert {(r.child, r.source) for r in left.collect()} == {("Q1", "wikidata"), ("Q6", "manual")}
    at = datetime(2026, 1, 1)
    numbers = spark.createDataFrame([(1, "us_ein", "12-3456789", "wikidata", at), (2, "ca_bn", "123456789RR0001", "manual", at)], "entity_id bigint, scheme string, value string, source string, checked timestamp")
    new = spark.createDataFrame([(1, "us_ein", "123456789"), (3, "sec_cik", "5"), (4, "sec_cik", "x")], "entity_id bigint, scheme string, value string")
    after = ownership.set_identifiers(numbers, new)
    assert {(r.entity_id, r.value, r.checked) for r in after.collect()} == {(1, "12-3456789", None), (2, "123456789RR0001", at), (3, "0000000005", None)}
    gone = ownership.remove_identifiers(after, spark.createDataFrame([(2, "ca_bn", "123456789 RR0001"), (1, "us_ein", "123456789")], "entity_id bigint, scheme string, value string"))
    assert {r.entity_id for r in gone.collect()} == {1, 3}  # only hand-made ones can be removed
    outlets = spark.createDataFrame([("a.ca", "Q1", "auto", "n", at), ("b.ca", None, "unmatched", "", at)], "domain string, qid string, match_status string, match_note string, ownership_checked timestamp")
    pinned = ownership.pin_items(outlets, spark.createDataFrame([("b.ca", "Q9")], "domain string, qid string"), at)
    assert {(r.domain, r.qid, r.match_status, r.ownership_checked) for r in pinned.collect()} == {("a.ca", "Q1", "auto", at), ("b.ca", "Q9", "manual", None)}
    assert {r.match_status for r in ownership.confirm(outlets).collect()} == {"confirmed", "unmatched"}
    assert {r.match_status for r in ownership.confirm(outlets, ["b.ca"]).collect()} == {"auto", "unmatched"}


def test_groups_and_summary_lines_are_not_sent_through_the_driver(spark, world):
    edges, entities = world
    bases = spark.createDataFrame([(i,) for i in NAMES], "base bigint")
    outlets = bases.select(F.col("base").alias("outlet_id"), F.col("base").alias("entity_id"))
    for rows in (graph.first_owner(edges, entities), graph.owner_groups(edges, entities, bases), graph.summary_lines(edges, entities, outlets)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
