"""The stored closure against a fresh walk, after random changes of the edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mediagraph.operators import graph
from mediagraph.operators.closure import ROWS, Closure, Ownership, beginnings, extended, steps_of
from mediagraph.session import cut

EDGES = "edge_no bigint, child bigint, parent bigint, relation string, share double, source string"


def frame(spark, edges):
    return spark.createDataFrame([(k, c, p, r, None, "wikidata") for k, (c, p, r) in sorted(edges.items())], EDGES).coalesce(2)


def as_rows(df):
    return sorted((r.root, r.node, r.depth, tuple(tuple(k) for k in r.rank), tuple(r.path)) for r in df.where("root <> node").collect())


@pytest.mark.parametrize("up", [True, False])
def test_equal_to_a_fresh_walk_after_random_changes(spark, tmp_path, up):
    rng = random.Random(up)
    names = spark.createDataFrame([(i, rng.choice(["Ann", "Bob", "Cy"])) for i in range(14)], "entity_id bigint, name string").coalesce(1)
    roots = names.select(F.col("entity_id").alias("root"))
    table = Closure(spark, f"file://{tmp_path}/c")
    edges, number = {}, 0
    for step in range(3):
        for k in rng.sample(sorted(edges), min(len(edges), (0, 4, 3)[step])):
            del edges[k]
        for _ in range((14, 2, 0)[step]):
            number += 1
            edges[number] = (rng.randrange(14), rng.randrange(14), rng.choice(["owned_by", "parent_org"]))  # loops and repeats among them
        now = frame(spark, edges)
        assert table.refresh(steps_of(now, names, up))
        assert as_rows(table.pairs()) == as_rows(graph.walk(now, names, roots, up=up))
    assert not table.refresh(steps_of(now, names, up))


def test_a_small_change_touches_few_files(spark, tmp_path):
    edges = {i: (i, i // 2, "owned_by") for i in range(1, 200)}
    names = spark.createDataFrame([(i, f"n{i}") for i in range(201)], "entity_id bigint, name string")
    table = Closure(spark, f"file://{tmp_path}/c")
    table.refresh(steps_of(frame(spark, edges), names, True))
    before = {p.path for p in table.log.picked()}
    edges[500] = (200, 7, "owned_by")
    table.refresh(steps_of(frame(spark, edges), names, True))
    after = {p.path for p in table.log.picked()}
    assert len(before & after) >= len(before) - 1 and {r.node: r.depth for r in table.pairs([200]).collect()} == {7: 1, 3: 2, 1: 3, 0: 4}
    assert len(table.log.read(ROWS, keep=lambda p: p.path in after - before).select("root").distinct().collect()) < 20


def test_a_chain_longer_than_ten(spark, tmp_path):
    edges = {i: (i, i + 1, "owned_by") for i in range(14)}
    names = spark.createDataFrame([(i, "x") for i in range(16)], "entity_id bigint, name string")
    roots = spark.createDataFrame([(0,), (99,)], "root bigint")
    own = Ownership(spark, tmp_path.name, frame(spark, edges), names)
    assert {r.node: r.depth for r in own.above(roots).where("root = 0").collect()} == {i: i for i in range(15)}
    assert [(r.node, r.path) for r in own.above(roots).where("root = 99").collect()] == [(99, [99])]
    assert {r.node for r in own.below(spark.createDataFrame([(3,)], "root bigint"), include_roots=False).collect()} == {0, 1, 2}
    limited = graph.reach(frame(spark, edges), roots, max_depth=10)
    assert {r.node: r.depth for r in limited.where("root = 0").collect()} == {i: i for i in range(11)}


def test_holds_the_pairs_of_the_roots_asked_for(spark, tmp_path):
    """Not those of all nodes; roots asked for later are added, and changes reach all that are held."""
    edges = {i: (i, i // 2, "owned_by") for i in range(1, 64)}
    names = spark.createDataFrame([(i, f"n{i}") for i in range(65)], "entity_id bigint, name string").coalesce(1)
    table = Closure(spark, f"file://{tmp_path}/c")
    asked = lambda *x: spark.createDataFrame([(i,) for i in x], "root bigint")
    steps = lambda: steps_of(frame(spark, edges), names, True)
    assert table.refresh(steps(), asked(40, 41)) and not table.refresh(steps(), asked(41))
    assert {r.root for r in table.pairs().collect()} == {40, 41}
    assert table.refresh(steps(), asked(9, 40))
    assert as_rows(table.pairs()) == as_rows(graph.walk(frame(spark, edges), names, asked(9, 40, 41)))
    del edges[10]
    edges[70], edges[71] = (10, 7, "owned_by"), (9, 62, "parent_org")
    assert table.refresh(steps(), asked(33))
    assert as_rows(table.pairs()) == as_rows(graph.walk(frame(spark, edges), names, asked(9, 33, 40, 41)))


def test_paths_are_not_sent_through_the_driver(spark, tmp_path):
    """However small they look as files."""
    edges = frame(spark, {i: (i, i // 2, "owned_by") for i in range(1, 20)})
    names = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "entity_id bigint, name string")
    steps = cut(steps_of(edges, names, True))
    plan = extended(cut(beginnings(steps.select("at"))), steps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
