"""Quality rules and language models against plain versions, planted cases and held-out rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pytest

from mediagraph.llm import language_id, quality_rules, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    found = WORD.findall(text)
    grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times, again, covered = Counter(grams), set(), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= set(range(i, i + 5))
    dups = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in again
            again.add(line)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def samples(seed, n):
    rng = random.Random(seed)
    bits = ["a", "bb", "é", "日本", "#", "*$", "|", "<x>", "\n", "\n\n", " ", "  ", "\t", "\r\n", "\x0b", "\x85", "ok ok ok ok ok ok ", "same line\n", "1 2 3 4 5 "]
    return [None, "", "\n", " \n \n", "x" * 50, "same\nsame\nsame \nsame"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 120))) for _ in range(n)]


def test_counts_are_those_of_plain_code(spark):
    rows = list(enumerate(samples(1, 300)))
    got = quality_rules.with_stats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r.doc_id: tuple(r.stats[c] for c in quality_rules.COUNTS) for r in got} == {i: plain_counts(t) for i, t in rows}


def test_learned_list_is_an_ordered_conditional_and_generalises(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        n, bad = rng.randrange(20, 120), i % 4 == 0
        body = [f"{rng.choice('abcdef')}{rng.choice('mnop')}{rng.randrange(99)}" + ("***" if bad and i % 8 == 0 else "") for _ in range(n)]
        rows.append((i, " ".join(body).upper() if bad and i % 8 else " ".join(body)))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rules = quality_rules.fit_rules(docs, spark.createDataFrame([x for x in labels if x[0] % 3] + [(1, 0), (None, 0), (7, None)], "doc_id bigint, quality int"))
    assert 1 <= len(rules.rules) <= 4
    assert "CASE WHEN" in str(rules.column(quality_rules.with_stats(docs)["stats"]))
    got = {r.doc_id: r.kept for r in quality_rules.judged(docs, rules, keep=["doc_id"]).collect()}
    right = sum(got[i] == (y == 1) for i, y in labels if i % 3 == 0)
    assert right >= 0.97 * 200


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 6), (None, "one two " * 8, 7), (2, "a b c d e f g h i j k", 8)], "doc_id bigint, text string, stats int")
    none = quality_rules.fit_rules(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert none.rules == ()
    rows = quality_rules.judged(docs, none)
    assert rows.columns == ["doc_id", "text", "stats", "_stats", "base_failed", "kept"]
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in rows.collect()) == [("1", True, False), ("1", True, False), ("2", False, True), ("None", True, False)]
    assert quality_rules.judged(docs.limit(0), none).count() == 0


LANGS = {"aa": ["the", "and", "of", "thing", "er", "tion"], "bb": ["der", "und", "ß", "keit", "sch", "ung"], "cc": ["ción", "que", "ll", "ado", "ez", "ñ"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    rows = [(i, lang, speech(rng, lang, rng.randrange(3, 80))) for i, lang in enumerate(["aa", "bb", "cc"] * 150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    return rows, docs, language_id.fit_models(docs.where("doc_id % 4 <> 2"))


def test_held_out_accuracy_and_rejection(spark, spoken):
    rows, docs, models = spoken
    got = {r.doc_id: r.language for r in language_id.with_language(docs, models, keep=["doc_id"]).collect()}
    held = [(got[i], lang) for i, lang, _ in rows if i % 4 == 2]
    assert sum(g.lang_pred == lang for g, lang in held) >= 0.98 * len(held)
    assert sum(g.rejected for g, _ in held) <= 0.02 * len(held) and all(0 <= g.score <= 1 for g in got.values())
    other = spark.createDataFrame([(0, "жщ ыъ эюя " * 30), (1, "qzx wvk jjq xqz " * 30)], "doc_id bigint, text string")
    assert all(r.language.rejected for r in language_id.with_language(other, models).collect())


def test_probabilities_are_interpolated_kneser_ney(spoken):
    """The same numbers from a plain recursion over strings, for one language."""
    rng = random.Random(3)
    counts = defaultdict(Counter)
    texts = [speech(rng, "aa", 40) for _ in range(4)]
    for t in texts:
        for w in t.split():
            s = "\0" * 4 + w + "\1"
            for i in range(4, len(s)):
                counts[5][s[i - 4 : i + 1]] += 1
    for order in (4, 3, 2, 1):
        for g in counts[order + 1]:
            counts[order][g[1:]] += 1
    letters = {c for g in counts[5] for c in g[-1:]} | set()

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(letters) + 1)
        ones, twos = (sum(v == k for v in counts[n].values()) for k in (1, 2))
        d = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
        seen = [v for h, v in counts[n].items() if h[:-1] == g[:-1]]
        if not seen:
            return p(g[1:])
        return max(counts[n][g] - d, 0) / sum(seen) + d * len(seen) / sum(seen) * p(g[1:])

    codes = np.array([[ord(c) for c in g] for g in counts[5]], np.uint32)
    models = language_id.build({"aa": (codes, np.array(list(counts[5].values())))})
    for w in ("thing", "ertion", "zz", "ofq"):
        flat, at = language_id.padded(np.array([ord(c) for c in w], np.uint32), np.array([0]), np.array([len(w)]))
        got = language_id.run_scores(models, flat, at)[:, 0]
        s = "\0" * 4 + w + "\1"
        want = [log(p(s[i - 4 : i + 1])) for i in range(4, len(s))]
        assert np.allclose(got, want, atol=2e-4), (w, exp(got[0]), exp(want[0]))


def test_language_edge_cases(spark, spoken):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, "123 !!", "x"), (None, "der und keit " * 9, "x")], "doc_id bigint, text string, language string")
    rows = language_id.with_language(docs, spoken[2])
    assert rows.columns == ["doc_id", "text", "language", "_language"]
    got = sorted((str(r.doc_id), r._language.lang_pred, r._language.rejected) for r in rows.collect())
    assert got == [("1", "und", True), ("1", "und", True), ("2", "und", True), ("None", "bb", False)]
    assert language_id.with_language(docs.limit(0), spoken[2]).count() == 0
    empty = language_id.fit_models(spark.createDataFrame([("a", None), (None, "b")], "text string, lang string"))
    assert {r.language.lang_pred for r in language_id.with_language(docs.select("doc_id", "text"), empty).collect()} == {"und"}


def test_window_hashes_tell_windows_apart():
    h = words.mix(np.arange(1, 200, dtype=np.uint64) % np.uint64(7))
    for size in (1, 4, 5, 10, 20):
        got = words.window_hashes(h, size)
        want = [tuple(h[i : i + size]) for i in range(len(h) - size + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want)) and len(set(zip(got.tolist(), want))) == len(set(want))
