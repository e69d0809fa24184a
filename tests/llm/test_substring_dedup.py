from __future__ import annotations

import hashlib
import random
import re

import pytest

from mediagraph.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, size=20):
    """The contract, window by window. rows: (doc_id, text), ids distinct and not null."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        found = WORD.findall(text or "")
        gone = [False] * len(found)
        for i in range(len(found) - size + 1):
            window = tuple(found[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out[doc] = (len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g))
    return out


def corpus(seed, n, vocabulary, passages=6):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "é", ","])
    shared = [[word() for _ in range(rng.randrange(5, 70))] for _ in range(passages)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(shared) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(0, 60))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t ", "  "]) for w in parts)
        rows.append((i * 3 - 20, text))
    rows += [(1000 + i, rows[i][1]) for i in range(0, n, 7)] + [(5000, None), (5001, ""), (5002, " \n "), (5003, "a " * 75), (5004, "a " * 19), (5005, "b c " * 30)]
    return rows


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 4000), (2, 3), (3, 40)])
@pytest.mark.parametrize(("size", "base"), [(20, 10), (20, 5), (8, 8), (16, 2)])
def test_against_plain_windows(spark, seed, vocabulary, size, base):
    rows = corpus(seed, 60, vocabulary)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.without_repeats(docs, size, base).collect()}
    assert got == plain(rows, size)


def test_repeated_rows_nulls_and_clashing_names(spark):
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "x", 1), (1, text, "y", 2), (None, text, "z", 3), (2, text, None, None), (1, "short", "x", 1)], "doc_id bigint, text string, n_words string, doc int")
    got = substring_dedup.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "n_words", "doc", "_n_words", "n_removed", "kept_text"]
    rows = sorted((str(r.doc_id), r._n_words, r.n_removed, r.n_words) for r in got.collect())
    assert rows == [("1", 1, 0, "x"), ("1", 30, 0, "x"), ("1", 30, 0, "y"), ("2", 30, 30, None), ("None", 30, 0, "z")]


def test_empty_table_and_long_text(spark):
    assert substring_dedup.without_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    once = " ".join(f"q{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, once), (2, "x" * 3_000_000 + " " + once)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.without_repeats(docs).collect()}
    assert got[1] == (200_000, 0, hashlib.sha256(once.encode()).hexdigest())
    assert got[2] == (200_001, 200_000, hashlib.sha256(b"x" * 3_000_000).hexdigest())
