"""The transitive closure of the ownership graph as a stored table, kept up to date edge by edge.

A row is one reachable pair with its shortest path: (root, node, depth, rank, path), in the order `graph.walk` gives (nearest first, ties by
the keys of the edges along the path). Pairs of a node with itself are not stored. The table holds the pairs of the roots it was asked for so
far, so it grows with these, not with all nodes of the graph; roots asked for later are walked then and added.

A refresh compares the edges with those of the last one. Nothing is walked again that the difference can't touch:

* Inserted edges: each extends the paths that end at its start; what gets better is extended in turn, until nothing does.
* Deleted edges: pairs whose shortest path runs through one are deleted, and derived again from the neighbours that are left, by the same
  extension.

Paths are many times longer in memory than in a written table, so joins with them are told to sort by key: a plan by file size would send
them through the driver.

A best path's beginnings are best paths themselves, so extension alone finds every change; a round costs what changed. Only the buckets of
roots with changed pairs are written again, in one commit with the new edges, so a reader sees both or neither.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.operators import graph
from mediagraph.session import cut, cut_folder, is_empty
from mediagraph.sources.tablelog import TableLog

KEY = "struct<r: boolean, n: string, e: bigint>"
ROWS = f"root bigint, node bigint, depth int, rank array<{KEY}>, path array<bigint>"
STEPS = f"at bigint, to bigint, key {KEY}"
BUCKETS = 64


def as_best() -> Column:
    """What the least of is the best path of a pair."""
    return F.struct("depth", "rank", "path")


def steps_of(edges: DataFrame, names: DataFrame | None, up: bool) -> DataFrame:
    """Edges as (at, to, key): the key orders paths of one length. An owner without a name sorts first."""
    nth = F.col("edge_no") if "edge_no" in edges.columns else F.col("parent" if up else "child").cast("bigint")
    named = edges.hint("merge").join(names.select(F.col("entity_id").alias("parent"), F.col("name").alias("_name")), "parent", "left") if names is not None else edges.withColumn("_name", F.lit(""))
    src, dst = ("child", "parent") if up else ("parent", "child")
    key = F.struct((F.col("relation") != "owned_by").alias("r"), F.col("_name").alias("n"), nth.cast("bigint").alias("e")).cast(KEY)
    return named.select(F.col(src).cast("bigint").alias("at"), F.col(dst).cast("bigint").alias("to"), key.alias("key")).distinct()


def best_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("root", "node").agg(F.min(as_best()).alias("best")).select("root", "node", "best.*")


def extended(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths with one more step at their end; none leads back to its root."""
    longer = paths.hint("merge").join(steps, paths["node"] == steps["at"]).where(F.col("to") != F.col("root"))
    return longer.select("root", F.col("to").alias("node"), (F.col("depth") + 1).alias("depth"),
                         F.concat("rank", F.array("key")).alias("rank"), F.concat("path", F.array("to")).alias("path"))


def beginnings(nodes: DataFrame) -> DataFrame:
    """The empty path of each node (one column)."""
    node = F.col(nodes.columns[0])
    return nodes.select(node.alias("root"), node.alias("node"), F.lit(0).alias("depth"), F.array().cast(f"array<{KEY}>").alias("rank"), F.array(node).alias("path"))


def relaxed(candidates: DataFrame, stored: DataFrame, steps: DataFrame) -> DataFrame | None:
    """All pairs that become reachable, or better than in `stored`, from some first candidates on; None if none does."""
    found: list[DataFrame] = []
    while True:
        offered = best_of(candidates)
        # what is known of the offered pairs only: the offers are few, so they are the side that is sent round
        known = [x.hint("merge").join(offered.select("root", "node"), ["root", "node"], "left_semi") for x in (stored, *found)]
        now = best_of(reduce(DataFrame.unionByName, known)).select("root", "node", as_best().alias("now"))
        better = cut(offered.hint("merge").join(now, ["root", "node"], "left").where(F.col("now").isNull() | (as_best() < F.col("now"))).drop("now"))
        if is_empty(better):
            return best_of(reduce(DataFrame.unionByName, found)) if found else None
        found.append(better)
        candidates = extended(better, steps)


def walked(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """The closure from these roots, level by level: what is first met is best."""
    levels = [cut(best_of(extended(beginnings(roots), steps)))]
    while not is_empty(levels[-1]):
        met = reduce(DataFrame.unionByName, levels).select("root", "node")
        levels.append(cut(best_of(extended(levels[-1], steps).hint("merge").join(met, ["root", "node"], "left_anti"))))
    return reduce(DataFrame.unionByName, levels)


def doubtful(stored: DataFrame, deleted: DataFrame) -> DataFrame:
    """(root, node) of stored pairs whose shortest path may use a deleted step: it goes from that step's start straight to its end."""
    ends = F.arrays_zip(F.slice("path", 1, F.col("depth")).alias("at"), F.slice("path", 2, F.col("depth")).alias("to"))
    passed = stored.select("root", "node", F.inline(ends))
    return passed.join(deleted.select("at", "to").distinct(), ["at", "to"], "left_semi").select("root", "node").distinct()


def bucket(root: Column) -> Column:
    return F.pmod(F.xxhash64(root), F.lit(BUCKETS)).cast("string")


class Closure:
    """One direction of the graph, stored in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.log = TableLog(spark, folder)

    def pairs(self, roots: list[int] | None = None) -> DataFrame:
        """Stored pairs. With `roots`, only the files of their buckets are read."""
        if roots is None:
            return self.log.read(ROWS)
        spark = self.log.spark
        wanted = {r[0] for r in spark.createDataFrame([(int(x),) for x in roots], "root bigint").select(bucket(F.col("root"))).distinct().collect()} if roots else set()
        return self.log.read(ROWS, keep=lambda p: p.part in wanted).where(F.col("root").isin([int(x) for x in roots]))

    def from_roots(self, roots: DataFrame, include_roots: bool = True) -> DataFrame:
        """Stored pairs of the given roots (a column `root`), and each root with itself at depth 0."""
        starts = roots.select(F.col("root").cast("bigint")).where("root is not null").distinct()
        rows = self.pairs().join(starts, "root", "left_semi")
        return rows.unionByName(beginnings(starts)) if include_roots else rows

    def refresh(self, steps: DataFrame, roots: DataFrame | None = None) -> bool:
        """Bring the table up to these steps and roots (a column `root`; without them, every node that a step leaves); whether anything had
        changed."""
        log = self.log
        old, held = log.read(STEPS, kind="steps"), log.read("root bigint", kind="roots")
        part = bucket(F.col("root"))
        steps = cut(steps)
        asked = steps.select(F.col("at").alias("root")) if roots is None else roots.select(F.col("root").cast("bigint")).where("root is not null")
        if log.state().version < 0:
            asked = cut(asked.distinct())
            rows = log.write(walked(steps, asked).repartition(part).sortWithinPartitions("root", "node"), part)
            log.commit([*rows, *log.write(steps, kind="steps"), *log.write(asked, kind="roots")])
            return True
        fresh = cut(asked.distinct().join(held, "root", "left_anti"))
        mark = [F.count("*"), F.sum(F.xxhash64("at", "to", "key").cast("decimal(38,0)"))]
        if steps.agg(*mark).first() == old.agg(*mark).first():
            if is_empty(fresh):
                return False
            rows = log.write(walked(steps, fresh).repartition(part).sortWithinPartitions("root", "node"), part)
            log.commit([*rows, *log.write(fresh, kind="roots")])
            return True
        inserted, deleted = cut(steps.subtract(old)), cut(old.subtract(steps))
        stored = log.read(ROWS)
        lost = None
        if not is_empty(deleted):
            lost = cut(doubtful(stored, deleted))
            stored = stored.hint("merge").join(lost, ["root", "node"], "left_anti")
        starts = beginnings(inserted.select("at").distinct().join(held.withColumnRenamed("root", "at"), "at", "left_semi")).unionByName(stored)
        candidates = extended(starts, inserted).unionByName(extended(beginnings(fresh), steps))
        if lost is not None:
            # the last step into a lost pair, from a pair that is left or from the root itself
            last = lost.join(steps.withColumnRenamed("to", "node"), "node").select("root", F.col("at").alias("_from"), "node", "at", "key")
            left = stored.unionByName(beginnings(lost.select("root").distinct())).withColumnRenamed("node", "_from")
            again = left.hint("merge").join(last, ["root", "_from"]).select(
                "root", "node", (F.col("depth") + 1).alias("depth"), F.concat("rank", F.array("key")).alias("rank"), F.concat("path", F.array("node")).alias("path"))
            candidates = candidates.unionByName(again)
        better = relaxed(candidates, stored, steps)
        better = cut(better) if better is not None else log.spark.createDataFrame([], ROWS)
        changed = better.select("root") if lost is None else better.select("root").unionByName(lost.select("root"))
        touched = {r[0] for r in changed.select(bucket(F.col("root"))).distinct().collect()}  # BUCKETS at most
        mine = lambda p: p.part in touched
        worn = log.picked(keep=mine)
        kept = log.read_pieces(ROWS, worn)
        kept = kept if lost is None else kept.hint("merge").join(lost, ["root", "node"], "left_anti")
        kept = kept.hint("merge").join(better.select("root", "node"), ["root", "node"], "left_anti").unionByName(better)
        rows = log.write(kept.repartition(part).sortWithinPartitions("root", "node"), part)
        log.commit([*rows, *log.write(steps, kind="steps"), *log.write(fresh, kind="roots")], [*worn, *log.picked("steps")])
        return True


def stored(spark: SparkSession, name: str, edges: DataFrame, names: DataFrame | None, up: bool, roots: DataFrame | None = None) -> Closure:
    """The application's closure table of that name, up to date with these edges and roots."""
    out = Closure(spark, f"{cut_folder(spark)}/closure-{name}")
    out.refresh(steps_of(edges, names, up), roots)
    return out


class Ownership:
    """What owner queries read: closures of the records in force, up and down, and downward of all records (the feed's owner filter follows
    those set aside as well). Each is brought up to date with the roots that are asked for."""

    def __init__(self, spark: SparkSession, name: str, edges: DataFrame, entities: DataFrame) -> None:
        self.spark, self.name, self.edges, self.entities = spark, name, edges, entities

    def _table(self, view: str, roots: DataFrame) -> Closure:
        edges = self.edges if view == "all" else graph.current(self.edges)
        return stored(self.spark, f"{self.name}-{view}", edges, None if view == "all" else self.entities, view == "up", roots)

    def above(self, roots: DataFrame, include_roots: bool = True) -> DataFrame:
        return self._table("up", roots).from_roots(roots, include_roots)

    def below(self, roots: DataFrame, include_roots: bool = True) -> DataFrame:
        return self._table("down", roots).from_roots(roots, include_roots)

    def below_all(self, roots: DataFrame) -> DataFrame:
        return self._table("all", roots).from_roots(roots)
