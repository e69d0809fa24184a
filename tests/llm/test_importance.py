"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mediagraph.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def plain(docs, target, percent=5, least=20, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x)[1]) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        n, features = plain_features(x)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault((r[0], r[4]), []).append(k + 1)
    return [(*r, ranks[r[0], r[4]].pop(0) if r[1] >= least and ranks.get((r[0], r[4])) else None) for r in rows]


def random_texts(rng, n, words_of=60):
    bits = ["Ab", "cd", "é", "日本", "9", "x" * 60, "ẞ", "the", "THE", "y" * 49, "z" * 97]
    gaps = [" ", "-", "\n", "\x00", "  ", "_", "\x7f", "{"]
    return ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randrange(words_of))) for _ in range(n)]


def test_equal_to_plain_version(spark):
    rng = random.Random(11)
    texts = [None, "", "...", "one", "one two", "w" * 3_000_000, " ".join(rng.choice("abcdefgh") for _ in range(300_000))]
    docs = list(enumerate(texts + random_texts(rng, 300))) + [(None, "a b " * 20), (None, "a b " * 20)]
    target = random_texts(rng, 20) + [None]
    rows = [(i, t, "mine") for i, t in docs] + [(9, docs[9][1], "again")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, importance string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string").repartition(2)
    out = importance.resampled(frame, goal, percent=30)
    assert out.columns == ["doc_id", "text", "importance", "_importance"]
    got = [tuple(r) for r in out.select("doc_id", "_importance.*").collect()]
    want = plain([(i, t) for i, t, _ in rows], target, percent=30)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    drawn = sum(r[5] is not None for r in got)
    assert drawn == 30 * sum(r[1] >= 20 for r in got) // 100 > 20


def test_combined_checksums_are_those_of_the_whole_run():
    rng = random.Random(2)
    for text in random_texts(rng, 40, 30):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, buckets, n = importance.run_buckets(raw, np.array([0, len(raw)]))
        n_plain, features = plain_features(text)
        assert n.tolist() == [n_plain] and buckets.tolist() == [zlib.crc32(f.encode()) % 10000 for f in features]


def test_planes_sum_exactly():
    rng = np.random.default_rng(1)
    gain = rng.integers(-9000, 9000, importance.BUCKETS)
    rows, buckets = rng.integers(0, 130, 50_000), rng.integers(0, importance.BUCKETS, 50_000)
    buckets[:20_000], rows[:10_000] = 7, 3  # one bucket counted very often
    want = np.bincount(rows, weights=gain[buckets], minlength=131).astype(np.int64)
    assert (importance.summed_gains(rows, buckets, 131, importance.gain_planes(gain)) == want).all()
    assert (importance.summed_gains(rows, buckets, 131, importance.gain_planes(gain * 0)) == 0).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b " * 10)], "doc_id bigint, text string")
    assert importance.resampled(none, none).count() == 0
    assert importance.resampled(some, none, percent=100).select(F.col("importance.rank")).first()[0] == 1
