"""The stored text index against a scan over all documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mediagraph.functions import text as tx
from mediagraph.operators import search, textindex
from mediagraph.operators.textindex import TextIndex

WORDS = ["Senate", "budget", "reform", "réforme", "tax", "taxes", "taxi", "vote", "Ottawa", "the", "the", "the"]


def near(rows):
    return {r.doc_id: round(r.score, 9) for r in rows.collect()}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12))) or None, rng.choice(["Canada tax", None, "", "Ottawa"])) for i in range(1500)]
    rows += [(100_000 + i, "zebra tax " * (i + 1), "") for i in range(3)]
    rows += [(200_000 + 50 * i, "vote vote vote vote", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, about string").coalesce(2).cache()
    index = TextIndex(spark, f"file://{tmp_path_factory.mktemp('ix')}/i")
    old, textindex.WIDTH = textindex.WIDTH, 16
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that even these few rows make several files
    for b in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == b), b)
    yield docs, index
    textindex.WIDTH = old
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scores_are_those_of_a_scan_before_and_after_a_merge(spark, world):
    docs, index = world
    assert index.add(docs, 2) is None  # a replayed batch
    queries = ["budget tax", "tax", "REFORM", "the senate", "zebra t", "nothing here", "?!"]
    before = {q: near(search.rank(docs, q)) for q in queries}
    for merged in (False, True):
        for q in queries[:5] if merged else queries:
            assert near(index.ranked(q)) == before[q]
        terms = search.SearchTerms.parse("budget ta")
        want = {r.doc_id for r in docs.where(terms.matches(F.col("title"), F.col("about"))).collect()}
        assert {r.doc_id for r in index.matching("budget ta").collect()} == want
        if not merged:
            key = lambda r: (r.term, r.doc_id, r.field, r.freq, r.field_len)
            assert sorted(map(key, index.postings().collect())) == sorted(map(key, search.build_postings(docs).collect()))
            assert index.merge() == 0 and index.merge(least=3) == 3 and len({p.batch for p in index.log.picked()}) == 1


def test_top_reads_few_blocks(spark, world):
    docs, index = world
    for q, k in (("zebra t", 2), ("tax", 5), ("budget the", 10)):
        seen = {}
        got, want = ({r.doc_id: r.score for r in x.collect()} for x in (index.top(q, k, slack=1e-11, seen=seen), search.rank(docs, q)))
        least = sorted(want.values())[-k]
        assert set(got) == {d for d, s in want.items() if s >= least - 1e-11} and seen["read"] <= seen["spans"]
        assert all(s == pytest.approx(want[d]) for d, s in got.items())
    seen = {}
    index.top("vote", 2, seen=seen)
    assert seen["read"] < 0.8 * seen["spans"]


def test_only_files_and_pages_of_the_terms_are_read(spark, world):
    _, index = world
    terms = search.SearchTerms.parse("zebra")
    assert 0 < len(index._files(terms)) < len(index.log.picked())
    plan = index._blocks(search.SearchTerms.parse("budget zeb")).select("term", "n")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,zeb)" in plan and "EqualTo(term,budget)" in plan
    assert "entries" not in plan.split("ReadSchema")[-1]


def test_words_are_counted_in_place(spark):
    odd = ["Réforme  l'é\u0301tat", "Straße ﬁx_it a_b", "x\u00a0y\u2003z\x1cw", "İstanbul ΣΑΣ ²½ Ⅷ", "中文 テスト ｆｕｌｌ", "don’t stop—now", "a " * 300, "e\u0301" * 40 + " " + "q" * 100, "", None, "🙂🙂 a🙂b", "Ünïcode ÀÉÎ ǅ \u0301 \u00b4x"]
    docs = spark.createDataFrame([(i if i % 5 else None, t, odd[-i - 1]) for i, t in enumerate(odd)] + [(7, "twice", None), (7, "twice", None)], "doc_id bigint, title string, about string")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tx.index_tokens(F.col(f)).alias("words")) for f in ("title", "about")])
    rows = docs.select("doc_id", F.inline(fields)).select("doc_id", "field", F.size("words").alias("field_len"), F.explode("words").alias("term"))
    want = sorted(map(repr, rows.groupBy("term", "doc_id", "field", F.col("field_len").cast("bigint").alias("field_len")).agg(F.count("*").alias("freq")).select("term", "doc_id", "field", "field_len", "freq").collect()))
    assert sorted(map(repr, search.build_postings(docs).select("term", "doc_id", "field", "field_len", "freq").collect())) == want
    sizes = lambda c: F.coalesce(F.size(tx.index_tokens(F.col(c))), F.lit(0))
    assert sorted(map(repr, search.doc_lengths(docs).collect())) == sorted(map(repr, docs.select("doc_id", (sizes("title") + sizes("about")).cast("double").alias("doc_len")).collect()))


def test_an_index_is_built_with_one_shuffle_of_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the same words of every text", "the") for i in range(300)] + [(3, "the same words of every text", "the")], "doc_id bigint, title string, about string").coalesce(1)
    made = textindex.blocks(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan  # no row of its own for a word of a text
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(docs.repartition(3), 0)
    got = {(r.term, r.doc_id, r.field): r.freq for r in index.postings().collect()}
    assert len(got) == 300 * 7 and got["the", 3, "title"] == 2 and got["the", 4, "about"] == 1
    assert index.log.read(textindex.ROWS).groupBy("term", "span").count().where("count > 1").isEmpty()
