"""The stored feed and its rollup against pages worked out from all articles."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediagraph.operators import feed
from mediagraph.operators.feed import FeedFilters, FeedTables
from mediagraph.operators.feedstore import FeedStore

ARTICLE = "article_id bigint, outlet_id bigint, seen timestamp, stated timestamp, retrieved timestamp, checked timestamp"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng = random.Random(3)
    start = datetime(2026, 9, 20)
    rows = []
    for i in range(300):
        seen = start + timedelta(minutes=rng.randrange(6 * 24 * 60))
        rows.append((i, 0 if i % 3 == 0 else rng.randrange(5), seen, seen - timedelta(minutes=rng.randrange(300)) if i % 2 else None, seen, None))
    articles = spark.createDataFrame(rows, ARTICLE).coalesce(2).cache()
    outlets = spark.createDataFrame([(i, f"o{i}.ca", f"O{i}", "CA" if i < 3 else "FR", None) for i in range(5)],
                                    "outlet_id bigint, domain string, display_name string, country string, entity_id bigint").coalesce(1).cache()
    store = FeedStore(spark, f"file://{tmp_path_factory.mktemp('feed')}/f", articles.schema)
    for b in range(2):
        store.add(articles.where(F.col("article_id") % 2 == b), b)
    assert store.add(articles, 1) is None
    return articles, outlets, store


ASKED = [({}, "UTC"), ({"sort": "oldest", "per": "25", "page": "3"}, "UTC"), ({"mix": "all", "page": "99", "per": "25"}, "UTC"), ({"outlet": "o1.ca"}, "UTC"),
         ({"country": "CA", "from": "2026-09-21", "to": "2026-09-23"}, "-05:00"), ({"from": "2026-09-22", "to": "2026-09-22", "page": "2", "per": "25"}, "+05:30"), ({"from": "2030-01-01"}, "UTC")]


def test_pages_and_counts_are_those_of_all_articles(spark, world):
    articles, outlets, store = world
    for params, zone in ASKED:
        f = FeedFilters.parse(params)
        want, told = feed.feed_page(FeedTables(articles, outlets), f, zone)
        got, info = store.page(outlets, f, zone)
        assert info == told and [(r.article_id, r.display_name) for r in got.collect()] == [(r.article_id, r.display_name) for r in want.collect()]
    f = FeedFilters.parse(ASKED[5][0])
    rows = feed.matching(FeedTables(articles, outlets), f, "+05:30")
    assert sorted(map(tuple, store.counts_per_outlet(outlets, f, "+05:30").collect())) == sorted(map(tuple, feed.counts_per_outlet(rows).collect()))


def test_a_page_reads_its_own_days(world):
    _, outlets, store = world
    page, _ = store.page(outlets, FeedFilters.parse({"per": "25"}))
    assert {f.split("_part=")[1][:10] for f in page.inputFiles() if "_part=" in f} <= {"2026-09-24", "2026-09-25"}


def test_found_dates_move_articles(spark, world, tmp_path):
    articles, outlets, _ = world
    store = FeedStore(spark, f"file://{tmp_path}/f", articles.schema)
    store.add(articles, 0)
    ids = F.col("article_id").isin(0, 2, 4, 100)
    at = F.col("seen") - F.expr("INTERVAL 30 HOURS")
    before = {p.path for p in store.log.picked("articles")}
    store.redate(articles.where(ids).select("article_id", F.coalesce("stated", "seen").alias("shown"), at.alias("stated")), 0)
    assert store.redate(articles.where(ids).select("article_id", F.col("seen").alias("shown"), at.alias("stated")), 0) is None
    assert before & {p.path for p in store.log.picked("articles")}  # other days stay as they were
    now = articles.withColumn("stated", F.when(ids, at).otherwise(F.col("stated")))
    for compacted in (False, True):
        for params, zone in ASKED[:2]:
            f = FeedFilters.parse(params)
            want, told = feed.feed_page(FeedTables(now, outlets), f, zone)
            got, info = store.page(outlets, f, zone)
            assert info == told and [r.article_id for r in got.collect()] == [r.article_id for r in want.collect()]
        if not compacted:
            store.compact(least=2)
            assert len(store.log.picked("hours")) == 1
