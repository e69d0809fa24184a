"""The feed against a plain model: every combination of filters, sorts and mixes over a seeded world."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediagraph.functions.text import fold_text
from mediagraph.operators import feed, search
from mediagraph.operators.feed import FeedFilters, FeedTables

NOW = datetime(2026, 9, 20, 12)
OUTLETS = [(1, "alpha.ca", "Alpha", "CA", 11), (2, "beta.com", "beta News", "US", 12), (3, "gamma.ca", "Gamma", "CA", None)]
WORDS = ["Budget", "élection", "tariffs", "Wildfire", "Hockey", "health", "Health-care", "budgets"]


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(7)
    articles, tags, places, mentions = [], [], [], []
    for i in range(1, 181):
        outlet = 1 if i <= 40 else rnd.choice([1, 2, 3])
        seen = NOW - timedelta(hours=1, minutes=rnd.randrange(20)) if i <= 40 else NOW - timedelta(minutes=rnd.randrange(10 * 24 * 60))
        stated = seen - timedelta(minutes=rnd.randrange(300)) if rnd.random() < 0.6 else None
        title = " ".join(rnd.sample(WORDS, 3))
        about = rnd.choice(["", "Mark Carney · Canada", "France"])
        retrieved = seen + timedelta(minutes=2)
        checked = retrieved + timedelta(minutes=rnd.randrange(1, 40)) if rnd.random() < 0.7 else None
        articles.append((i, outlet, seen, stated, retrieved, checked, title, about))
        tags += [(i, s) for s in rnd.sample(["politics", "climate", "sports"], 2)]
        places += [(i, c) for c in rnd.sample(["CA", "US", "FR"], 1)]
        mentions += [(i, e) for e in rnd.sample([20, 30, 40], 1)]
    entities = [(11, "Q11", "Alpha Co"), (12, "Q12", "Beta Co"), (20, "Q20", "Parent"), (30, "Q30", "Top"), (40, "Q40", "Aside")]
    edges = [(11, 20, "owned_by", None, "wikidata"), (20, 30, "owned_by", None, "wikidata"), (12, 30, "owned_by", None, "manual"), (12, 40, "owned_by", None, "set_aside")]
    make = spark.createDataFrame
    tables = FeedTables(
        articles=make(articles, "article_id bigint, outlet_id bigint, seen timestamp, stated timestamp, retrieved timestamp, checked timestamp, title string, about string").cache(),
        outlets=make(OUTLETS, "outlet_id bigint, domain string, display_name string, country string, entity_id bigint"),
        tags=make(tags, "article_id bigint, slug string"), places=make(places, "article_id bigint, country string"),
        mentions=make(mentions, "article_id bigint, entity_id bigint"),
        edges=make(edges, "child bigint, parent bigint, relation string, share double, source string"),
        entities=make(entities, "entity_id bigint, qid string, name string"))
    return tables, articles, tags, places, mentions


def words(text):
    out, cur = [], ""
    for ch in fold_text(text) + " ":
        if ch.isalnum():
            cur += ch
        elif cur:
            out.append(cur)
            cur = ""
    return out


BELOW = {"Q20": {11}, "Q30": {11, 12}, "Q40": {12}}  # set-aside records count here
ABOVE = {1: {20, 30}, 2: {30}, 3: set()}  # and not here


def model(world, f: FeedFilters):
    _, articles, tags, places, mentions = world
    outlets = {o[0]: o for o in OUTLETS}
    rows = []
    for a in articles:
        o = outlets[a[1]]
        shown = a[3] or a[2]
        have = words(a[6]) + words(a[7])
        asked = words(f.q)
        if f.outlet and o[1] != f.outlet or f.country and o[3] != f.country:
            continue
        if f.tag and (a[0], f.tag) not in tags or f.place and (a[0], f.place) not in places and not (f.place == "EU" and (a[0], "FR") in places):
            continue
        if f.owner and o[4] not in BELOW[f.owner] or f.mentions and not any((a[0], e) in mentions for e in ABOVE[a[1]]):
            continue
        if f.q and not (all(w in have for w in asked[:-1]) and any(h.startswith(asked[-1]) for h in have)):
            continue
        local = (shown - timedelta(hours=4)).date()
        if f.date_from and local < f.date_from or f.date_to and local > f.date_to:
            continue
        rows.append((a[0], a[1], shown, o[2]))
    every = len(rows)
    if f.balanced:
        kept, seen = [], {}
        for r in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
            key = (r[1], r[2].replace(minute=0, second=0, microsecond=0))
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= 3:
                kept.append(r)
        rows = kept
    newest = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)
    order = {"newest": newest, "oldest": newest[::-1], "outlet": sorted(newest, key=lambda r: r[3].lower())}[f.sort]
    return [r[0] for r in order], every - len(rows)


COMBOS = [
    *({"q": q, "tag": t} for q, t in itertools.product(["", "budget", "Élect", "health tar", "carney can", "???x"], ["", "politics"])),
    *({"outlet": o, "mix": m} for o, m in itertools.product(["", "alpha.ca"], ["balanced", "all"])),
    *({"country": c, "place": p} for c, p in itertools.product(["", "CA"], ["", "FR", "EU"])),
    {"owner": "Q20"}, {"owner": "Q30"}, {"owner": "Q40"}, {"mentions": "owner"}, {"mentions": "owner", "country": "US"},
    {"from": "2026-09-15", "to": "2026-09-18"}, {"from": "2026-09-18"}, {"to": "2026-09-12", "tag": "climate"},
    {"sort": "oldest"}, {"sort": "outlet"}, {"sort": "outlet", "mix": "all", "q": "hockey"}, {"sort": "oldest", "tag": "sports", "country": "CA"},
]


@pytest.mark.parametrize("params", COMBOS, ids=str)
def test_matrix(world, params):
    f = FeedFilters.parse(params)
    want, hidden = model(world, f)
    rows = feed.matching(world[0], f, "-04:00")
    shown = feed.capped(rows) if f.balanced else rows
    assert [r.article_id for r in shown.orderBy(*feed.order(f.sort)).select("article_id").collect()] == want
    got = feed.totals(rows, feed.CAP if f.balanced else None).first()
    assert (got.total, got.hidden) == (len(want), hidden)


def test_pages_and_clamping(world):
    f = FeedFilters.parse({"per": "25", "page": "99"})
    want, hidden = model(world, f)
    page, info = feed.feed_page(world[0], f, "-04:00")
    last = -(-len(want) // 25)
    assert info == {"total": len(want), "hidden": hidden, "pages": last, "page": last, "first": (last - 1) * 25 + 1, "last": len(want)}
    assert [r.article_id for r in page.collect()] == want[(last - 1) * 25 :]


def test_invalid_parameters_fall_back():
    f = FeedFilters.parse({"q": "  a   b ", "tag": "Bad Tag", "outlet": "nodot", "country": "CAN", "owner": "X1", "mentions": "all", "sort": "relevance", "page": "0",
                           "per": "7", "mix": "x", "from": "2026-13-01", "place": "ZZ"}, known_places=frozenset({"CA"}))
    assert f == FeedFilters(q="a b", sort="relevance")
    assert FeedFilters.parse({"sort": "relevance"}).sort == "newest"
    swapped = FeedFilters.parse({"from": "2026-09-20", "to": "2026-09-01"})
    assert (swapped.date_from, swapped.date_to) == (date(2026, 9, 1), date(2026, 9, 20))


def test_hold_and_new_articles(world):
    tables, articles, *_ = world
    hold, now, since = timedelta(minutes=15), NOW, NOW - timedelta(hours=30)

    def seen_at(a, t, strict):
        lt = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
        return lt(a[4], t) and (bool(a[5]) and lt(a[5], t) or lt(a[4], t - hold))

    rows = feed.matching(tables, FeedFilters(), shown_if=feed.visible(now, hold))
    want = {a[0] for a in articles if seen_at(a, now, False)}
    assert {r.article_id for r in rows.select("article_id").collect()} == want
    fresh = sum(1 for a in articles if a[0] in want and not seen_at(a, since, True))
    assert feed.count_new(rows, since, hold, cap=None).first().fresh == fresh


def test_positions_cover_the_whole_order(world):
    rows = feed.matching(world[0], FeedFilters())
    got = [r.article_id for r in feed.positions(rows, "newest").orderBy("position").collect()]
    assert got == model(world, FeedFilters(mix="all"))[0]
    assert [r.position for r in feed.positions(rows, "newest").orderBy("position").select("position").collect()] == list(range(len(got)))


def naive_spread(items):
    """(id, outlet, time) in order; a second reading of the spacing rule."""
    rest, out, passed = list(items), [], {}
    while rest:
        head, near = rest[0], [rest[0]]
        for x in rest[1:11]:
            if abs(x[2] - head[2]) > timedelta(minutes=30):
                break
            near.append(x)

        def gap(o):
            tail = [y[1] for y in out[-3:]]
            return next((k + 1 for k in range(len(tail)) if tail[-1 - k] == o), 4)

        most = sum(x[1] == head[1] for x in near) > len(near) / 2
        pick = head
        if gap(head[1]) <= (1 if most else 3) and passed.get(head[0], 0) < 3:
            best = max(gap(x[1]) for x in near)
            if best > gap(head[1]):
                pick = next(x for x in near if gap(x[1]) == best)
                passed[head[0]] = passed.get(head[0], 0) + 1
        rest.remove(pick)
        out.append(pick)
    return [x[0] for x in out]


def test_spread_is_the_rule_and_a_permutation(world):
    rows = feed.capped(feed.matching(world[0], FeedFilters()))
    got = feed.spread(rows, per=50, zone="-04:00").orderBy("slot").collect()
    ids, _ = model(world, FeedFilters())
    by_id = {a[0]: a for a in world[1]}
    want = []
    for start in range(0, len(ids), 50):
        page = [(i, by_id[i][1], by_id[i][3] or by_id[i][2]) for i in ids[start : start + 50]]
        for _, day in itertools.groupby(page, key=lambda x: (x[2] - timedelta(hours=4)).date()):
            want += naive_spread(list(day))
    assert [r.article_id for r in got] == want
    assert sorted(r.article_id for r in got) == sorted(ids)


def test_highlighting(spark):
    df = spark.createDataFrame([("Élections fédérales: l'élection",)], "t string")
    pieces = df.select(search.highlight(F.col("t"), "federales elect").alias("p")).first().p
    assert [(p.text, p.marked) for p in pieces] == [("Élect", True), ("ions", False), (" ", False), ("fédérales", True), (": ", False), ("l", False), ("'", False), ("élect", True), ("ion", False)]


def test_matched_names(spark):
    df = spark.createDataFrame([(["Mark Carney", "Canada"], "Budget day")], "about array<string>, title string")
    names = lambda q: df.select(search.matched_names(F.col("about"), F.col("title"), q).alias("n")).first().n
    assert names("carn") == ["Mark Carney"] and names("ca") == ["Mark Carney", "Canada"] and names("budget ca") == []


def test_search_without_words_finds_nothing(spark):
    docs = spark.createDataFrame([(1, "a b", "c")], "doc_id bigint, title string, about string")
    assert search.rank(docs, "?!").count() == 0


def test_search_finds_korean_titles(spark):
    from mediagraph.operators.search import SearchTerms

    rows = spark.createDataFrame([(1, "한국 경제 뉴스"), (2, "Café du coin")], "doc_id int, title string")
    found = lambda q: sorted(r.doc_id for r in rows.where(SearchTerms.parse(q).matches(F.col("title"))).collect())
    assert (found("한국"), found("경제"), found("cafe"), found(" ".join(["cafe"] * 25 + ["absent", "coin"]))) == ([1], [1], [2], [])


def test_days_are_spaced_side_by_side_and_across_batches(spark, world):
    """Many days at once give what each gives alone, wherever Arrow's batches end."""
    rnd = random.Random(3)
    days = [([rnd.choice([0, 0, 1, 2, 3]) for _ in range(n)], [NOW - timedelta(minutes=m) for m in sorted(rnd.randrange(90) for _ in range(n))]) for n in (1, 2, 50, 7, 100, 33)]
    group = [k for k, (outlets, _) in enumerate(days) for _ in outlets]
    at = [int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for _, times in days for t in times]
    got = feed.spread_orders(np.array(group), np.array([o for outlets, _ in days for o in outlets]), np.array(at)).tolist()
    want, first = [], 0
    for outlets, times in days:
        want += naive_spread([(first + i, o, t) for i, (o, t) in enumerate(zip(outlets, times, strict=True))])
        first += len(outlets)
    assert got == want
    rows = feed.capped(feed.matching(world[0], FeedFilters()))
    whole = sorted(map(tuple, feed.spread(rows).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, feed.spread(rows).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
