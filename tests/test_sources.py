"""Scans over hand-made files and payloads."""

from __future__ import annotations

import json
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediagraph.sources import artlist, entities, extension, feeds, filings, lines, pages, sink, slots

NOW = datetime(2026, 9, 24)


def gkg(url, title="Steel tariffs &amp;amp; talks", at="20260923201500", kind="1", **cols):
    c = [""] * 27
    c[1], c[2], c[4], c[26] = at, kind, url, f"<X/><PAGE_TITLE>{title}</PAGE_TITLE>"
    for k, v in cols.items():
        c[int(k[1:])] = v
    return "\t".join(c)


LINES = [
    gkg("https://www.cbc.ca/news/1", c8="TRADE_TARIFF,11;WATER_SUPPLY,64;TRADE_TARIFF,70;TRADE_TARIFF,212;not a theme,3;;",
        c10="1#Canada#CA#a#b#1#2#3#9;1#Canada#CA#####10;1#Canada#CA#####11;1#US#US#####12;1#US#US#####13;1#France#FR#####14",
        c12="ines okoro,10;Ines Okoro,50;Ines Okoro,90;Lone,1;Lone,2", c14="hollin rail,1;Hollin Rail,2;Ines Okoro,3", c18="https://img.ca/a.jpg"),
    gkg("https://fakecbc.ca/news/2"), gkg("https://cbc.ca/3", kind="2"), gkg("not a url"), gkg("https://cbc.ca/4", title=""), gkg("https://cbc.ca/5", at="2026"),
    "short\tline", gkg("https://ici.radio-canada.ca/6", title="Grève", c25="srclc:fra;eng:GT", c18="nope"),
]


@pytest.fixture(scope="module")
def outlets(spark):
    rows = [("cbc.ca", "CBC", ["radio-canada.ca"]), ("ctv.ca", "CTV", [])]
    return spark.createDataFrame(rows, "domain string, display_name string, aliases array<string>")


def pairs(cells):
    return [(c["value"], c["count"]) for c in cells]


def test_lines(spark, outlets, tmp_path):
    (tmp_path / "20260923201500.gkg.csv").write_text("\n".join(LINES[:-1]) + "\n")
    (tmp_path / "20260923201500.translation.gkg.csv").write_bytes((LINES[-1] + "\n").encode() + b"\xff\xfe bad\n" + b"x" * 100)
    got = {r.url: r for r in lines.parse_lines(lines.read_lines(spark, str(tmp_path)), outlets).collect()}
    assert set(got) == {"https://www.cbc.ca/news/1", "https://ici.radio-canada.ca/6"}
    a, b = got["https://www.cbc.ca/news/1"], got["https://ici.radio-canada.ca/6"]
    assert (a.title, a.domain, a.seen, a.language, a.image_url) == ("Steel tariffs & talks", "cbc.ca", datetime(2026, 9, 23, 20, 15), "en", "https://img.ca/a.jpg")
    assert pairs(a.themes) == [("TRADE_TARIFF", 3), ("WATER_SUPPLY", 1)]
    assert pairs(a.places) == [("CA", 3), ("US", 2)]
    assert pairs(a.people) == [("Ines Okoro", 3)]
    assert pairs(a.names) == [("ines okoro", 3), ("Lone", 2), ("hollin rail", 2), ("Ines Okoro", 1)]
    assert (b.domain, b.language, b.image_url, b.title) == ("cbc.ca", "fr", None, "Grève")


def test_very_long_lines_and_lone_carriage_returns(spark, outlets, tmp_path):
    (tmp_path / "a.gkg.csv").write_bytes((gkg("https://cbc.ca/1", c8="T,1;" * 1_200_000) + "\n" + gkg("https://cbc.ca/2", title="One\rtwo") + "\r\n").encode())
    got = {r.url: r.title for r in lines.parse_lines(lines.read_lines(spark, str(tmp_path)), outlets).collect()}
    assert got == {"https://cbc.ca/1": "Steel tariffs & talks", "https://cbc.ca/2": "One two"}


def test_zips(spark, outlets, tmp_path):
    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for m, text in members.items():
                z.writestr(m, text)

    pack("20260923201500.gkg.csv.zip", {"20260923201500.gkg.csv": "\n".join(LINES[:3]), "readme.txt": "x"})
    pack("20260923203000.gkg.csv.zip", {"a.csv": LINES[0], "b.csv": LINES[0]})
    (tmp_path / "20260923204500.gkg.csv.zip").write_bytes(b"not a zip")
    got = lines.read_zips(spark, str(tmp_path))
    errors = {r.file: r.error for r in got.where("error is not null").collect()}
    assert set(errors) == {"20260923203000.gkg.csv.zip", "20260923204500.gkg.csv.zip"} and "2 tables" in errors["20260923203000.gkg.csv.zip"]
    good = lines.good_files(got)
    assert good.count() == 3
    assert [r.url for r in lines.parse_lines(good, outlets).collect()] == ["https://www.cbc.ca/news/1"]
    hosts = {r.host: (r.articles, r.titled) for r in lines.line_hosts(good).collect()}
    assert hosts == {"www.cbc.ca": (1, 1), "fakecbc.ca": (1, 1)}


def test_long_zip_members_come_through():
    import io

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.csv", "short\n" + "x" * 5_000_000 + "\nb\rc\r\n" + "after\n" * 4_500)
    frames = list(lines._member_lines("a.zip", buf.getvalue()))
    assert [v for f in frames for v in f["value"]] == ["short", "x" * 5_000_000, "b\rc"] + ["after"] * 4_500
    assert [n for f in frames for n in f["line"]] == list(range(4_503)) and all(f["error"].isna().all() for f in frames)


def test_article_lists(spark, outlets):
    item = lambda **k: {"url": "https://cbc.ca/a", "title": "T", "seendate": "20260923T201500Z", "language": "English", **k}
    body = json.dumps({"articles": [
        item(socialimage="https://i.ca/x.png"), item(url="https://fakecbc.ca/a", seendate="20260923T230000Z"), item(url="https://sub.ctv.ca/b", language="French", title="Raw\ttab"),
        item(url="https://cbc.ca/c", title=" "), item(url="https://cbc.ca/d", seendate="bad"), item(url="x")]}).replace("\\t", "\t")
    rows = [("ok", body), ("limit", "Please limit requests"), ("empty", "{}"), ("list", '{"articles": 5}'), ("cut", '{"articles": [')]
    df = spark.createDataFrame(rows, "source_url string, body string")
    got = {r.url: r for r in artlist.scan_artlist(df, outlets).collect()}
    assert {u: (r.domain, r.language, r.image_url, r.title) for u, r in got.items()} == {
        "https://cbc.ca/a": ("cbc.ca", "en", "https://i.ca/x.png", "T"), "https://sub.ctv.ca/b": ("ctv.ca", "fr", None, "Raw tab")}
    report = {r.source_url: r for r in artlist.artlist_report(df).collect()}
    assert report["ok"].error is None and report["ok"].raw == 6 and report["ok"].latest == datetime(2026, 9, 23, 23)
    assert report["limit"].error.startswith("not JSON") and report["empty"].error is None and report["empty"].raw == 0
    assert report["list"].error == "'articles' is not a list" and report["cut"].error == "malformed JSON"


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>
<item><title>Rate &lt;b&gt;cut&lt;/b&gt; &amp;amp; more</title><link>https://cbc.ca/1?a=1&b=2</link><pubDate>Wed, 23 Sep 2026 20:00:00 GMT</pubDate></item>
<item><title>Old</title><link>/old</link><pubDate>Tue, 01 Sep 2026 20:00:00 GMT</pubDate></item>
<item><title>Guid</title><guid>https://www.cbc.ca/3</guid></item>
<item><title>No link</title><guid isPermaLink="false">tag:x</guid></item>
<item><title>Else</title><link>https://else.org/1</link></item>
<item><title>Future</title><link>https://cbc.ca/6</link><pubDate>Wed, 30 Sep 2026 20:00:00 GMT</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E1</title><link rel="self" href="https://ctv.ca/self"/><link href="https://ctv.ca/e1"/>
<updated>2026-09-23T20:00:00Z</updated></entry><entry><title>E2</title><link href="e2"/><published>2026-09-23T20:00:00Z</published></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<item><title>R</title><link>https://ctv.ca/r</link><dc:date>2026-09-23T10:00:00Z</dc:date></item></rdf:RDF>"""
BOMB = '<!DOCTYPE x [<!ENTITY a "b">]><rss><channel><item><title>&a;</title></item></channel></rss>'


@pytest.fixture(scope="module")
def feed_docs(spark):
    rows = [("https://cbc.ca/rss", RSS), ("https://ctv.ca/atom/", ATOM), ("https://ctv.ca/rdf", RDF), ("https://ctv.ca/bomb", BOMB), ("https://ctv.ca/html", "<html></html>"), ("https://ctv.ca/broken", "<rss><a>")]
    return spark.createDataFrame([(u, b.encode()) for u, b in rows], "feed_url string, body binary")


def test_feeds(spark, feed_docs, outlets):
    items = feeds.scan_feeds(feed_docs).cache()
    got = {(r.feed_url.rsplit("/", 2)[-1] or "atom", r.pos): r for r in items.collect()}
    assert (got["rss", 0].title, got["rss", 0].link, got["rss", 0].published, got["rss", 0].date_field) == ("Rate cut & more", "https://cbc.ca/1?a=1&b=2", datetime(2026, 9, 23, 20), "pubdate")
    assert got["rss", 1].link == "https://cbc.ca/old" and got["rss", 2].link == "https://www.cbc.ca/3" and got["rss", 3].link == ""
    assert got["atom", 0].link == "https://ctv.ca/e1" and got["atom", 0].published is None
    assert got["atom", 1].link == "https://ctv.ca/atom/e2" and got["atom", 1].published == datetime(2026, 9, 23, 20)
    assert got["rdf", 0].published == datetime(2026, 9, 23, 10)
    assert "entities" in got["bomb", -1].error and "<html>" in got["html", -1].error and got["broken", -1].error
    own = feed_docs.select("feed_url", F.when(F.col("feed_url").contains("cbc"), "cbc.ca").otherwise("ctv.ca").alias("domain"), F.array().cast("array<string>").alias("aliases"), F.lit("en").alias("language"))
    kept = feeds.feed_articles(items, own, NOW)
    assert {r.url for r in kept.collect()} == {"https://cbc.ca/1?a=1&b=2", "https://www.cbc.ca/3", "https://cbc.ca/6", "https://ctv.ca/e1", "https://ctv.ca/atom/e2", "https://ctv.ca/r"}
    assert {r.seen for r in kept.collect()} == {NOW}
    count = {r.feed_url: r for r in feeds.feed_counts(items, own, NOW, timedelta(hours=48)).collect()}["https://cbc.ca/rss"]
    assert (count["items"], count.off_site, count.undated, count.too_old, count.newest) == (6, 1, 2, 1, datetime(2026, 9, 23, 20))
    health = {r.feed_url.rsplit("/", 1)[-1]: r for r in feeds.feed_health(items, own, NOW).collect()}
    assert health["rss"].usable and health["rss"].on_site == 4 and health["rdf"].usable and not health["bomb"].usable
    late = {r.feed_url: r for r in feeds.feed_health(items, own, NOW + timedelta(days=60)).collect()}["https://ctv.ca/rdf"]
    assert late.stale and not late.usable
    weekly = spark.createDataFrame([("cbc.ca", 2), ("ctv.ca", 9)], "domain string, articles int")
    needy = feeds.outlets_needing_feeds(outlets.withColumn("active", F.lit(True)), weekly, feeds.feed_health(items, own, NOW).where("false"), own)
    assert [(r.domain, r.articles) for r in needy.collect()] == [("cbc.ca", 2)]


PAGE = """<html><head><link rel="alternate" type="application/rss+xml" href="/rss" title="News"><link rel="alternate stylesheet" type="text/css" href="/x.css">
<link rel="alternate" type="application/rss+xml" href="/comments/feed/" title="c"><link rel="ALTERNATE" type="application/atom+xml" href="https://a.ca/atom"><link rel="alternate" type="application/rss+xml" href="/rss">
<meta property="article:section" content="Politics"><meta name="news_keywords" content="tax, Budget ,tax"><META NAME="pubdate" CONTENT="2026-09-23T10:00:00Z"><meta name="pubdate" content="2026-01-01T00:00:00Z">
<script type="application/ld+json">{"@graph": [{"@type": "WebPage", "datePublished": "2026-09-01T00:00:00Z"}, {"@type": ["NewsArticle"], "datePublished": "2026-09-23T10:20:00Z", "articleSection": ["Canada", 5], "keywords": "a,b"}]}</script>
<script type="application/ld+json">{broken</script></head><body><time itemprop="datePublished" datetime="2026-09-23T10:30:00Z">x</time><p>unclosed"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://a.ca/x/y", PAGE)], "page_id bigint, url string, html string")
    scanned = pages.scan_pages(df)
    assert [(r.link, r.title) for r in pages.discover_feeds(scanned).orderBy("pos").collect()] == [("https://a.ca/rss", "News"), ("https://a.ca/atom", "")]
    assert pages.first_meta(scanned).first()["first"]["pubdate"] == "2026-09-23T10:00:00Z"


NAME = {"en": {"language": "en", "value": "Alpha"}, "fr": {"language": "fr", "value": "Alpha SA"}}


def statement(value, rank="normal", kind="value", **qualifiers):
    snak = lambda v: {"snaktype": "value", "datavalue": {"value": v}} if v is not None else {"snaktype": "somevalue"}
    return {"rank": rank, "mainsnak": {"snaktype": kind, "datavalue": {"value": value}}, "qualifiers": {p: [snak(v) for v in vs] for p, vs in qualifiers.items()}}


def day(text, precision=11):
    return {"time": text, "precision": precision}


def test_entities(spark):
    item = lambda q: {"id": q}
    alpha = {"id": "Q1", "labels": NAME, "descriptions": {"fr": {"language": "fr", "value": "journal"}}, "aliases": {"en": [{"language": "en", "value": "The A"}, {"language": "en", "value": "Alpha"}]}, "claims": {
        "P31": [statement(item("Q11032")), statement(item("Q5"), rank="deprecated")],
        "P856": [statement("https://alpha.ca"), statement("ftp://alpha.ca"), statement("https://old.ca", P582=[day("+2019-01-01T00:00:00Z")])],
        "P127": [statement(item("Q2"), P1107=[{"amount": "+30"}], P580=[day("+2020-05-00T00:00:00Z", 10)]), statement(item("Q1")), statement(item("Q7"), P582=[None]), statement(item("Q8"), kind="novalue")],
        "P749": [statement(item("Q3")), statement(item("Q4"), rank="preferred")], "P5531": [statement("1234")]}}
    person = {"id": "Q9", "labels": {"de": {"language": "de", "value": "Max"}}, "claims": {"P31": [statement(item("Q5"))], "P570": [statement(day("+2001-00-00T00:00:00Z", 9))], "P127": [statement(item("Q1"))]}}
    rows = [json.dumps({"entities": {"Q1": alpha, "Q404": {"id": "Q404", "missing": ""}}}), json.dumps(person), json.dumps({"id": "P5"})]
    got = {r.qid: r for r in entities.scan_entities(spark.createDataFrame([(b,) for b in rows], "body string"), NOW).collect()}
    assert set(got) == {"Q1", "Q9"}
    a = got["Q1"]
    assert (a.label, a.description, a.aliases, a.instance_of, a.websites) == ("Alpha", "journal", ["Alpha SA", "The A"], ["Q11032"], ["https://alpha.ca"])
    assert [(p.qid, p.relation, p.share, p.start) for p in a.parents] == [("Q2", "owned_by", 0.3, "2020-05"), ("Q4", "parent_org", None, None)]
    assert [(i.scheme, i.value) for i in a.identifiers] == [("sec_cik", "1234")]
    assert (got["Q9"].label, got["Q9"].died, got["Q9"].parents) == ("Max", "2001", [])
    claims = entities.claims_of(entities.scan_entities(spark.createDataFrame([(b,) for b in rows], "body string"), NOW))
    assert {(r.child, r.parent) for r in claims.collect()} == {("Q1", "Q2"), ("Q1", "Q4")}


def test_match_results(spark):
    b = lambda q, site, label: {"item": {"value": f"http://x/entity/{q}"}, "site": {"value": site}, "itemLabel": {"value": label}}
    body = json.dumps({"results": {"bindings": [b("Q20", "https://www.cbc.ca/", "CBC"), b("Q3", "http://cbc.ca", "C"), b("Q20", "http://cbc.ca", "again"), b("X1", "http://cbc.ca", "x"), b("Q9", "http://other.ca", "o")]}})
    got = entities.scan_match_results(spark.createDataFrame([(body,)], "body string"), spark.createDataFrame([("cbc.ca",)], "domain string"))
    assert [(r.qid, r.label, r.website) for r in got.orderBy("nth").collect()] == [("Q3", "C", "http://cbc.ca"), ("Q20", "CBC", "https://www.cbc.ca/")]


def test_filings(spark):
    recent = {"form": ["8-K", "10-K", "10-K"], "accessionNumber": ["1", "0001-24-5", "0001-23-4"], "primaryDocument": ["a.htm", "b.htm", "c.htm"], "filingDate": ["2024-05-01", "2024-03-01", "2023-03-01"], "reportDate": ["", "2023-12-31", ""]}
    bad = {**recent, "accessionNumber": ["1", "../x", "0001-23-4"]}
    rows = [(1, "1234", json.dumps({"filings": {"recent": recent}})), (2, "77", json.dumps({"filings": {"recent": bad}})), (3, "88", "{}"), (4, "zz", "{}")]
    got = filings.company_filings(spark.createDataFrame(rows, "entity_id bigint, value string, body string")).collect()
    assert sorted((r.entity_id, r.label, r.period) for r in got) == [
        (1, "Latest annual report (Form 10-K), filed 2024-03-01", "2023-12-31"), (1, "SEC filings (all)", None), (2, "SEC filings (all)", None), (3, "SEC filings (all)", None)]
    assert {r.source_url for r in got if r.period} == {"https://www.sec.gov/Archives/edgar/data/1234/0001245/b.htm"}
    years = [{"tax_prd_yr": 2021, "totrevenue": 10.5, "totcntrbgftgrnt": 0}, {"tax_prd_yr": "2023", "totrevenue": 1}, {"tax_prd_yr": 2022, "totrevenue": -5, "totcntrbgftgrnt": True}, {"tax_prd_yr": 2020, "totrevenue": 7}, {"tax_prd_yr": 2019, "totrevenue": 9}, 5]
    df = spark.createDataFrame([(5, "12-3456789", json.dumps({"filings_with_data": years})), (6, "12-3456789", "{}")], "entity_id bigint, value string, body string")
    assert sorted((r.kind, r.amount, r.period) for r in filings.nonprofit_filings(df).collect()) == [("grant", 0.0, "Tax year 2021"), ("nonprofit_revenue", 7.0, "Tax year 2020"), ("nonprofit_revenue", 10.5, "Tax year 2021")]


def test_slots(spark):
    got = [r.slot for r in slots.slots_between(spark, datetime(2026, 9, 23, 10, 0), datetime(2026, 9, 23, 10, 44)).orderBy("slot").collect()]
    assert got == [datetime(2026, 9, 23, 10, 15), datetime(2026, 9, 23, 10, 30)]
    cal = slots.slots_between(spark, datetime(2026, 9, 23, 10, 0), datetime(2026, 9, 23, 13, 0))
    present = spark.createDataFrame([(datetime(2026, 9, 23, 10, 15),), (datetime(2026, 9, 23, 10, 45),), (datetime(2026, 9, 23, 12, 45),)], "slot timestamp")
    states = [r.state for r in slots.classify_gaps(cal, present).orderBy("slot").collect()]
    assert states == ["read", "skipped", "read", "pending", "pending", "pending", "pending", *["not tried"] * 5]
    assert slots.slot_files(cal).count() == 24


class FakeSource(extension.ArticleSource):
    name = "fake"

    def groups(self, domains):
        return [[d] for d in domains]

    def fetch(self, domains, start, end):
        at = start.replace(tzinfo=UTC)
        yield {"window_end": at, "source_url": "u1", "records": [("https://x/1", "T", domains[0], at, "en", None)]}
        yield {"window_end": end.replace(tzinfo=UTC), "source_url": "u2", "error": "boom" if domains[0] == "b.ca" else None}


def test_new_sources_plug_in(spark):
    spark.dataSource.register(extension.data_source(FakeSource))
    df = spark.read.format("fake").option("domains", "a.ca,b.ca").option("start", "2026-09-23T00:00:00").option("end", "2026-09-24T00:00:00").load()
    got = sorted((r.group, r.slice, r.error or "", r.domain or "") for r in df.collect())
    assert got == [(0, 0, "", "a.ca"), (0, 1, "", ""), (1, 0, "", "b.ca"), (1, 1, "boom", "")]
    assert df.rdd.getNumPartitions() == 2


def test_sink_replay_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "id bigint, seen timestamp"
    assert sink.read_table(spark, path, schema, day=True).count() == 0
    df = spark.createDataFrame([(1, datetime(2026, 9, 23)), (2, datetime(2026, 9, 24))], schema)
    sink.write_batch(df, path, 0, day="seen")
    sink.write_batch(df, path, 1, day="seen")
    sink.write_batch(df.where("id = 1"), path, 1, day="seen")
    assert sorted((r.id, r.batch) for r in sink.read_table(spark, path, schema, day=True).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_feeds_have_no_item_limit(spark):
    items = "".join(f"<item><title>T{i} & co</title><link>/n/{i}</link></item>" for i in range(301))
    df = spark.createDataFrame([("https://cbc.ca/rss", f"<rss><channel>{items}</channel></rss>".encode())], "feed_url string, body binary")
    got = feeds.scan_feeds(df).collect()
    assert len(got) == 301 and got[300].link == "https://cbc.ca/n/300" and got[0].title == "T0 & co"
