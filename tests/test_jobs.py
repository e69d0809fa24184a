"""Dates, crawl rules, tags, mentions, coverage, loading."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mediagraph.functions import fixed
from mediagraph.operators import counts, coverage, dates, load, mentions, robots, tagging
from mediagraph.sources import pages
from tests.test_sources import PAGE

SEEN = datetime(2026, 9, 23, 12)


def page(spark, *bodies, seen=SEEN):
    df = spark.createDataFrame([(i, "https://a.ca/", b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    scanned = pages.scan_pages(df)
    return scanned, dates.candidates(scanned, ["page_id"]), df.select("page_id", F.lit(seen).alias("seen"))


def test_candidates_in_order(spark):
    _, cands, _ = page(spark, PAGE)
    got = [(r.method, r.raw) for r in cands.orderBy("rank").collect()]
    assert got == [("schema.org datePublished", "2026-09-23T10:20:00Z"), ("itemprop datePublished", "2026-09-23T10:30:00Z"), ("meta pubdate", "2026-09-23T10:00:00Z"),
                   ("schema.org datePublished (untyped)", "2026-09-01T00:00:00Z"), ("schema.org datePublished (untyped)", "2026-09-23T10:20:00Z")]


def meta(**tags):
    return "<head>" + "".join(f'<meta name="{k.replace("_", ":", 1)}" content="{v}">' for k, v in tags.items()) + "</head>"


def test_choice_and_conflicts(spark):
    scanned, cands, seen = page(
        spark, meta(article_published_time="2026-09-23T10:00:00", pubdate="2026-09-23T09:00:00Z"),  # no zone: the next one
        meta(article_published_time="2026-09-23T18:50:00-04:00", pubdate="2026-09-23T07:50:00Z"),  # 15 hours apart: no conflict; the first is in the future
        meta(article_published_time="2026-09-23T06:50:00-04:00", pubdate="2026-09-23T06:50:00Z"),  # four hours apart
        meta(pubdate="1994-12-31T00:00:00Z"), "<p>nothing</p>", meta(pubdate="2026-09-23T12:40:00Z"), meta(pubdate="2026-09-23T13:30:00Z"))
    got = {r.page_id: (r.at, r.method, r.conflict) for r in dates.choose(cands, seen).collect()}
    assert got == {0: (datetime(2026, 9, 23, 9), "meta pubdate", False), 1: (datetime(2026, 9, 23, 7, 50), "meta pubdate", False), 2: (None, None, True), 5: (datetime(2026, 9, 23, 12, 40), "meta pubdate", False)}
    why = {(r.page_id, r.method): r.outcome for r in dates.explain(cands, seen, dates.choose(cands, seen)).collect()}
    assert why[0, "article:published_time"].startswith("rejected: not a full") and why[0, "meta pubdate"] == "USED" and why[1, "article:published_time"].startswith("rejected: later")
    assert why[2, "meta pubdate"] == "valid on its own" and why[3, "meta pubdate"] == "rejected: before 1995"


def test_section_labels(spark):
    scanned, _, _ = page(spark, PAGE)
    assert dates.section_labels(scanned).first().sections == ["Politics", "tax", "Budget", "Canada", "a", "b"]


def test_crawl_rules(spark):
    body = """User-agent: *
Disallow: /

User-agent: other
User-agent: MediaGraph
Disallow: /private/  # comment
Allow: /private/open
Disallow: /*.pdf$
Disallow:
"""
    files = spark.createDataFrame([("a.ca", body), ("b.ca", "Disallow: /\nUser-agent: *\nDisallow: /x\nAllow: /x")], "host string, body string")
    rules = robots.parse_rules(files)
    urls = ["https://a.ca/", "https://a.ca/private/1", "https://a.ca/private/open/1", "https://a.ca/f.pdf", "https://a.ca/f.pdf?x=1", "https://a.ca/robots.txt", "https://b.ca/x", "https://b.ca/y", "https://c.ca/", "https://d.ca/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    status = spark.createDataFrame([("a.ca", 200), ("b.ca", 200), ("c.ca", 404), ("d.ca", 503)], "host string, status int")
    got = {r.url: r.verdict for r in robots.verdicts(df, rules, status).collect()}
    assert [got[u] for u in urls] == ["allowed", "disallowed", "allowed", "disallowed", "allowed", "allowed", "allowed", "allowed", "allowed", "unavailable"]


def test_tags(spark):
    themes, sections = tagging.tag_dimensions(spark, [
        {"slug": "climate", "themes": ["ENV", "POLLUTION"], "sections": ["Environnement"]}, {"slug": "sports", "sections": ["hockey", "sports"]}, {"slug": "trade", "themes": ["TRADE"], "sections": ["trade"], "min_mentions": 1}])
    counted = spark.createDataFrame([(1, "ENV", 2), (1, "POLLUTION", 1), (2, "ENV", 2), (3, "TRADE", 1)], "article_id bigint, theme string, n bigint")
    labels = spark.createDataFrame([(1, 0, "News > Trade"), (1, 1, "Sports"), (2, 0, "Nouvelles / ENVIRONNEMENT"), (3, 0, "Environnement"), (4, 0, "Sports, Hockey")], "article_id bigint, pos int, label string")
    got = {(r.article_id, r.slug): r.evidence for r in tagging.retag(counted, labels, themes, sections).collect()}
    assert got == {(1, "climate"): "GDELT themes: ENV (2), POLLUTION (1)", (1, "sports"): "Outlet's section: Sports", (2, "climate"): "Outlet's section: ENVIRONNEMENT",
                   (3, "trade"): "GDELT themes: TRADE (1)", (4, "sports"): "Outlet's section: Hockey"}


def test_mentions(spark):
    entities = spark.createDataFrame([(1, "Q1", "CBC/Radio-Canada", ["CBC", "Radio"]), (2, "Q2", "Rogers Communications", ["Rogers", "RCI"]), (3, "Q3", "Mark Carney", []), (4, "Q4", "mark carney", [])],
                                     "entity_id bigint, qid string, name string, aliases array<string>")
    outlets = spark.createDataFrame([("cbc.ca", "CBC News", 1), ("citynews.ca", "CityNews", None)], "domain string, display_name string, entity_id bigint")
    named = spark.createDataFrame([(1, "cbc.ca", "cbc", 3), (1, "cbc.ca", "Rogers Communications Inc.", 2), (1, "cbc.ca", "rci", 1), (1, "cbc.ca", "Rogers", 9), (2, "citynews.ca", "CBC", 1), (2, "citynews.ca", "Mark Carney", 4)],
                                  "article_id bigint, domain string, name string, count bigint")
    found = mentions.match_names(named, mentions.name_index(entities), mentions.own_keys(outlets, entities))
    assert {(r.article_id, r.qid, r.mentions) for r in found.collect()} == {(1, "Q2", 3), (2, "Q1", 1)}
    stored = spark.createDataFrame([(1, "Q2", 8)], "article_id bigint, qid string, mentions bigint")
    assert {(r.article_id, r.mentions) for r in mentions.add_mentions(stored, found).collect()} == {(1, 8), (2, 1)}


def test_coverage(spark):
    outlets = spark.createDataFrame([("politico.com", "Politico", []), ("cbc.ca", "CBC", ["radio-canada.ca"]), ("time.com", "Time", []), ("news.gone.com", "Gone", [])], "domain string, display_name string, aliases array<string>")
    hosts = spark.createDataFrame([("www.cbc.ca", 5, 4), ("ici.radio-canada.ca", 2, 2), ("politico.eu", 3, 3), ("timesofindia.com", 9, 9), ("fakecbc.ca", 1, 1)], "host string, articles bigint, titled bigint")
    stored = spark.createDataFrame([("cbc.ca", 7)], "domain string, stored_7d bigint")
    got = coverage.report(outlets, hosts, stored).orderBy("place").collect()
    assert [(r.domain, r.verdict, r.carried, r.with_titles, r.stored_7d) for r in got] == [
        ("news.gone.com", "not carried", 0, 0, 0), ("time.com", "not carried", 0, 0, 0), ("politico.com", "check look-alikes", 0, 0, 0), ("cbc.ca", "carried", 7, 6, 7)]
    assert [(s.host, s.articles) for s in got[2].lookalikes] == [("politico.eu", 3)]
    assert {(r.domain, r.host, r.articles) for r in coverage.own_hosts(outlets, hosts).collect()} == {("cbc.ca", "www.cbc.ca", 5), ("cbc.ca", "ici.radio-canada.ca", 2)}


def test_counts_in_records_equal_counts_over_rows(spark):
    packed = spark.createDataFrame([(1, "bce inc,1;BCE Inc,2;mark carney,3;Mark Carney,4;Mark Carney,5;9lives,6;lone,7;lone,8")], "article_id bigint, p string")
    record = packed.select(counts.people_column(counts.names_column(F.col("p"))).alias("r")).first().r
    rows = packed.select("article_id", F.posexplode(F.split("p", ";")).alias("pos", "e")).select("article_id", "pos", F.regexp_extract("e", "^(.*),", 1).alias("name"))
    table = counts.main_people(counts.name_counts(rows)).orderBy("place").collect()
    assert [(c["value"], c["count"]) for c in record] == [(r.name, r.n) for r in table] == [("Mark Carney", 3), ("Bce Inc", 2)]


def test_dedup_and_enrichment(spark):
    batch = spark.createDataFrame([("k1", 2, "second"), ("k1", 1, "first"), ("k2", 3, "x"), ("k3", 4, "y")], "url_key string, arrival int, title string")
    stored = spark.createDataFrame([("k3",)], "url_key string")
    assert {(r.url_key, r.title) for r in load.new_articles(batch, stored).collect()} == {("k1", "first"), ("k2", "x")}
    shape = "url_key string, about array<string>, names array<string>, themes map<string,bigint>"
    old = spark.createDataFrame([("a", [], [], {}), ("b", ["kept"], [], {}), ("c", [], [], {"T": 1})], shape)
    new = spark.createDataFrame([("a", [], [], {}, 0), ("a", ["who"], ["n"], {"X": 2}, 1), ("a", ["later"], [], {"Y": 1}, 2), ("b", ["new"], [], {"Z": 1}, 3), ("c", [], ["n"], {"W": 5}, 4)], shape + ", arrival int")
    got = {r.url_key: (r.about, r.names, r.themes, r.names_filled, r.themes_filled) for r in load.enrich_once(old, new).collect()}
    assert got == {"a": (["who"], ["n"], {"X": 2}, True, True), "b": (["kept"], [], {"Z": 1}, False, True), "c": ([], ["n"], {"T": 1}, True, False)}


def test_window_plan(spark):
    now = datetime(2026, 9, 23, 12)
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "group int, domain string")
    cursors = spark.createDataFrame([("a", now - timedelta(hours=1)), ("b", now - timedelta(hours=20)), ("c", now - timedelta(minutes=5))], "domain string, window_end timestamp")
    never = spark.createDataFrame([], "window_end timestamp")
    span = {"backfill": timedelta(hours=48), "overlap": timedelta(hours=1), "catch_up": timedelta(hours=6)}
    got = [(r.group, r.start) for r in load.group_starts(members, cursors, never, now, **span).orderBy("turn").collect()]
    assert got == [(3, now - timedelta(hours=48)), (1, now - timedelta(hours=6)), (2, now - timedelta(hours=1, minutes=5))]
    last = spark.createDataFrame([(now - timedelta(hours=3),)], "window_end timestamp")
    assert load.group_starts(members, cursors, last, now, **span).where("group = 3").first().start == now - timedelta(hours=4)


def test_settings_rules(spark):
    tags = spark.createDataFrame([("ok", "L", ["A_B"], [], 3), ("Bad Slug", " ", ["a"], [], 0), ("empty", "L", [], [], 3)], "slug string, label string, themes array<string>, sections array<string>, min_mentions int")
    assert {(r.row, r.rule) for r in load.tag_violations(tags).collect()} == {("Bad Slug", "invalid slug"), ("Bad Slug", "label required"), ("Bad Slug", "not a theme name"), ("Bad Slug", "min_mentions must be at least 1"), ("empty", "needs themes or sections")}
    rows = [(1, "a.ca", None, "grant", "L", 5.0, "CAD", "https://x", "2026-01-31"), (2, "a.ca", "Q1", "gift", "", -1.0, None, "x", "2026-02-30"), (3, None, "q5", "grant", "L", None, None, "https://x", "2026-01-31")]
    got = load.curated_violations(spark.createDataFrame(rows, "row int, outlet string, qid string, kind string, label string, amount double, currency string, source_url string, retrieved string"))
    assert {r.row for r in got.collect()} == {"2"} and got.count() == 7
    fixes = [(1, "a.ca", None, "add_owner", "Q1", "https://s", "2026-01-01"), (2, None, None, "drop", "", "s", "now")]
    assert {(r.row) for r in load.correction_violations(spark.createDataFrame(fixes, "row int, outlet string, entity string, action string, target string, source string, checked string")).collect()} == {"2"}


def test_host_backoff(spark):
    rows = [(1, "https://a.ca/1", 1, "allowed", 200, SEEN, "m", False, 0), (2, "https://a.ca/2", 2, "allowed", 403, None, None, None, 0), (3, "https://a.ca/3", 3, "allowed", 200, SEEN, "m", False, 0),
            (4, "https://b.ca/1", 4, "unavailable", None, None, None, None, 1), (5, "https://c.ca/1", 5, "disallowed", None, None, None, None, 0), (6, "https://c.ca/2", 6, "allowed", 404, None, None, None, 1), (7, "https://c.ca/3", 7, "allowed", 200, None, None, True, 0)]
    df = spark.createDataFrame(rows, "article_id bigint, url string, turn int, verdict string, status int, at timestamp, method string, conflict boolean, attempts int")
    got = {r.article_id: (r.outcome, r.attempts) for r in dates.attempt_state(df).collect()}
    assert got == {1: ("found", 1), 2: ("failed", 1), 3: ("skipped", 0), 4: ("skipped", 1), 5: ("disallowed", 2), 6: ("failed", 2), 7: ("conflict", 2)}


def test_many_crawl_rules_of_one_host(spark):
    import random
    import re

    rng = random.Random(8)
    part = lambda: "/" + rng.choice("abc") + str(rng.randrange(30))
    rules = [("a.ca", "".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", "", "", "/", "$", "*x"]), rng.random() < 0.4) for _ in range(600)]
    rules += [("a.ca", "/a1", True), ("a.ca", "/a1", False), ("b.ca", "/", False), ("b.ca", "/*.pdf$", True), ("a.ca", "/é(1)", False)]
    paths = ["".join(part() for _ in range(rng.randrange(0, 5))) + rng.choice(["", "/", "x", "?q=1"]) for _ in range(400)] + ["/robots.txt", "/é(1)2", "/A1"]
    urls = [f"https://{h}{p}" for p in paths for h in ("a.ca", "b.ca", "c.ca")]

    def plain(host, path):
        best = (0, True)
        for h, pattern, allow in rules:
            regex = ".*".join(re.escape(x) for x in pattern.removesuffix("$").split("*")) + ("$" if pattern.endswith("$") else "")
            if h == host and re.match(regex, path or "/"):
                best = max(best, (len(pattern), allow))
        return "allowed" if best[1] or path == "/robots.txt" else "disallowed"

    table = spark.createDataFrame([(h, p, a, len(p)) for h, p, a in rules], "host string, pattern string, allow boolean, length int")
    got = robots.verdicts(spark.createDataFrame([(u,) for u in urls], "url string").repartition(3), table).collect()
    assert len(got) == len(urls) and {r.verdict for r in got} == {"allowed", "disallowed"}
    for r in got:
        host, path = re.match("https://([^/?]*)(.*)", r.url).groups()
        assert r.verdict == plain(host, path if path.startswith("/") else "/" + path), r.url


def test_audit_of_outlets_with_conflicts_only(spark):
    rows = [("a.ca", SEEN, SEEN, "meta pubdate"), ("a.ca", SEEN, None, fixed.ZONE_CONFLICT), ("b.ca", SEEN, None, fixed.ZONE_CONFLICT)]
    df = spark.createDataFrame(rows, "domain string, seen timestamp, stated timestamp, date_method string")
    read = lambda **more: [(r.domain, r.dated, r.zone_conflicts, r.place) for r in dates.audit(df, SEEN, **more).orderBy("place").collect()]
    assert read() == [("a.ca", 1, 1, 1), ("b.ca", 0, 1, 2)]
    assert read(undated=False) == [("a.ca", 1, 1, 1)]
