"""Embedding near-dedup (operator 8): a subspace pigeonhole join over vectors of one label.

Unit vectors at cosine c or more are at squared distance 2 - 2c or less. A fixed rotation spreads that distance evenly over the axes, which
are split into blocks of `block` axes, each with its share of the squared distance as budget: a pair within the whole distance must be
within budget in one block at least. Each block is a range join: a vector stands in the grid cell of its first `grid` axes there
(cells as wide as the block's radius) and asks in those neighbour cells that its ball reaches, half of them, as the other half asks
back. Cells with many vectors are cut into tiles, each pair of tiles its own group. Candidates of all blocks are made distinct and
checked on the full vectors in double precision. Equal vectors are one from the start and counted by their number.

Defined cases: null labels, null, empty or zero vectors and those with null or non-finite components link with nothing (they are their own
component and kept); vectors of different lengths are not compared; rows that repeat an id are vectors of their own; a null id counts as a
link, and is the component only where no member has an id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mediagraph.llm import words
from mediagraph.llm.components import components
from mediagraph.session import cut

COSINE, BLOCK, GRID, TILE = 0.93, 16, 2, 1024
#: Room for rounding: coordinates travel in single precision.
SLACK = 1e-5


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of `size` axes."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def vector_rows(rows: DataFrame) -> DataFrame:
    """(id, label, node, vector) of (id, label, embedding): node is a hash of label and vector, null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, kept = [], []
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = None
                if label is not None and x.is_valid and len(x) and not x.values.null_count:
                    v = np.ascontiguousarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                    with np.errstate(over="ignore"):
                        norm = float(np.sqrt((v * v).sum()))
                    v = v if np.isfinite(v).all() and v.any() else None
                    if v is not None and not (np.isfinite(norm) and norm > 1e-150):
                        v = v / np.abs(v).max()  # too large or too small to square
                raw = None if v is None else v.tobytes()
                kept.append(raw)
                nodes.append(None if raw is None else int.from_bytes(hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(kept, pa.binary())], ["id", "label", "node", "vector"])

    return rows.mapInArrow(run, "id bigint, label string, node bigint, vector binary")


def cell_rows(vectors: DataFrame, cosine: float, block: int, grid: int) -> DataFrame:
    """(cell, node, home, radius, point): each vector once in its own cell of every block, and once in each cell that it asks in."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=grid) if s > (0,) * grid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, nodes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            data, at = words.text_buffer(batch.column(2))
            lengths = np.diff(at) // 8
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                x = np.frombuffer(data.tobytes(), np.float64)[words.ragged(at[own] // 8, np.full(len(own), size))].reshape(len(own), size)
                x = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(size)
                tag = np.array([int.from_bytes(hashlib.blake2b(f"{size} {labels[i]}".encode(), digest_size=8).digest(), "little") for i in own], np.uint64)
                for b in range(0, size, block):
                    part = np.ascontiguousarray(x[:, b : b + block], np.float32)
                    axes = min(grid, part.shape[1])
                    radius = np.sqrt((2 - 2 * cosine) * part.shape[1] / size) + SLACK
                    place = np.floor(part[:, :axes] / radius).astype(np.int64)
                    inner = part[:, :axes] - place * radius  # distance to the cell's lower side
                    for step in [(0,) * axes, *{s[:axes] for s in steps if s[:axes] > (0,) * axes}]:
                        gap = np.where(np.array(step) > 0, radius - inner, np.where(np.array(step) < 0, inner, 0.0))
                        asks = np.flatnonzero((gap**2).sum(axis=1) <= (radius + SLACK) ** 2)
                        key = tag[asks] ^ np.uint64(b + 1)
                        for k in range(axes):
                            key = words.mix(key + words.mix((place[asks, k] + step[k]).view(np.uint64)))
                        home = not any(step)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key.view(np.int64)), pa.array(nodes[own][asks]), pa.array(np.full(len(asks), home)), pa.array(np.full(len(asks), radius)),
                            words.blobs(part[asks].ravel(), np.full(len(asks), part.shape[1]))], ["cell", "node", "home", "radius", "point"])

    return vectors.select("label", "node", "vector").mapInArrow(run, "cell bigint, node bigint, home boolean, radius double, point binary")


def candidates(rows: DataFrame, tile: int) -> DataFrame:
    """(a, b) within budget of each other in one block."""
    sizes = rows.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("all")).where("homes > 0 and all > 1")
    tiles = F.ceil(F.col("all") / tile)
    mine = F.pmod(F.xxhash64("node"), tiles)
    # a vector goes to the groups (low, high) of all pairs of tiles that have its own tile
    cut_up = rows.join(sizes, "cell").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1)))
    cut_up = cut_up.select("cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "home", "radius", "point")

    def run(table: pa.Table) -> pa.Table:
        node, home, mine = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "home", "mine"))
        data, at = words.text_buffer(table["point"])
        x = np.frombuffer(data.tobytes(), np.float32).reshape(len(node), -1).astype(np.float64)
        budget = (table["radius"][0].as_py() + SLACK) ** 2
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        left = np.flatnonzero(home & (mine == low)) if low == high else np.flatnonzero(home)
        squares = (x * x).sum(axis=1)
        found = []
        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            near = squares[own][:, None] + squares[None, :] - 2 * (x[own] @ x.T) <= budget
            if low != high:
                near &= mine[own][:, None] != mine[None, :]
            near &= (node[own][:, None] < node[None, :]) | (~home[None, :] & (node[own][:, None] != node[None, :]))
            r, c = np.nonzero(near)
            found.append(np.stack([np.minimum(node[own[r]], node[c]), np.maximum(node[own[r]], node[c])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cut_up.groupBy("cell", "low", "high").applyInArrow(run, "a bigint, b bigint").distinct()


def linked(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Those of `pairs` whose cosine reaches the threshold in double precision."""
    of = lambda end: vectors.select(F.col("node").alias(end), F.col("vector").alias(f"vector_{end}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "vector_a", "vector_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.float64), np.frombuffer(q.as_buffer(), np.float64)
                keep.append(len(x) == len(y) and float(x @ y) >= cosine * float(np.sqrt(x @ x) * np.sqrt(y @ y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_vectors(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, tile: int = TILE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    every = cut(vector_rows(rows.select(F.col(id_col).cast(LongType()).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("embedding"))))
    vectors = cut(every.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies")))
    near = candidates(cell_rows(vectors, cosine, block, grid), tile)
    links = cut(linked(near, vectors, cosine))
    clusters = components(links)

    copies = vectors.select("node", "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    known = copies.join(others, "node", "left").join(clusters, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = every.select("id", "node").join(known, "node", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least"))
    return named.join(least, "component", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
