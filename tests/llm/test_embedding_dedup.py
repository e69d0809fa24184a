from __future__ import annotations

import numpy as np
import pytest

from mediagraph.llm import embedding_dedup
from tests.llm.test_ngram_jaccard import roots

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, cosine=0.93):
    good = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    labels = {i: label for i, _, label in rows}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if labels[a] == labels[b] and len(good[a]) == len(good[b])
             and good[a] @ good[b] >= cosine * np.sqrt(good[a] @ good[a]) * np.sqrt(good[b] @ good[b])]
    found, count = roots(labels, links), dict.fromkeys(labels, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], found[i], found[i] == i) for i in labels}


def clustered(seed, n, size, labels=3):
    rng = np.random.default_rng(seed)
    centres, rows = rng.standard_normal((6, size)), []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(size) * rng.choice([0.05, 0.2, 0.35, 2.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.1, 1, 30])], int(rng.integers(labels)) if rng.random() < 0.95 else None))
    return rows


@pytest.mark.parametrize(("seed", "n", "size", "tile"), [(1, 300, 64, 1024), (2, 250, 20, 16), (3, 200, 3, 8), (4, 120, 1, 1024)])
def test_against_all_pairs(spark, seed, n, size, tile):
    rows = clustered(seed, n, size)
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * size, 1), (2003, [None] * size, 1), (2004, [float("nan")] * size, 1), (2005, [float("inf")] * size, 1), (2006, [1.0] * (size + 1), 1)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == plain(rows)


def test_null_ids_repeats_and_empty(spark):
    v = [1.0, 2.0, 3.0]
    docs = spark.createDataFrame([(None, v, 1), (5, v, 1), (5, v, 1), (6, [-1.0, 0.0, 0.0], 1), (None, [0.0, -1.0, 0.0], 1)], SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(docs).collect())
    assert got == [("5", 2, 5, True), ("5", 2, 5, True), ("6", 0, 6, True), ("None", 0, None, True), ("None", 2, 5, True)]
    assert embedding_dedup.near_vectors(docs.limit(0)).count() == 0
