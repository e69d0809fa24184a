"""The collection stream: same result as a batch, across restarts and replays; hold, late rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mediagraph.operators import load, stories, tagging
from mediagraph.functions import url
from mediagraph.sources import lines
from mediagraph.streaming import jobs
from tests.test_sources import gkg


def slot_file(folder, at, rows, stream=""):
    (folder / f"{at}{stream}.gkg.csv").write_text("\n".join(rows) + "\n")


A1 = gkg("https://alpha.ca/1?utm_source=x", "Senate passes budget reform tonight", at="20260923100000", c8="TAX,1;TAX,2;TAX,3", c10="1##CA##;1##CA##", c14="Parent Co,1;Parent Co,2")
B1 = gkg("https://beta.ca/9", "Budget reform passes the Senate", at="20260923101500", c8="OTHER,1")
A1_AGAIN = gkg("http://www.alpha.ca/1", "Same article, other headline", at="20260923101500")
C1 = gkg("https://alpha.ca/2", "Grève des enseignants au Québec", at="20260923101500", c25="srclc:fra;")


@pytest.fixture
def job(spark, tmp_path):
    make = spark.createDataFrame
    outlets = make([(1, "alpha.ca", [], "Alpha", 11), (2, "beta.ca", [], "Beta", None)], "outlet_id bigint, domain string, aliases array<string>, display_name string, entity_id bigint")
    themes, sections = tagging.tag_dimensions(spark, [{"slug": "tax", "themes": ["TAX"]}])
    entities = make([(11, "Q11", "Alpha Inc", []), (12, "Q12", "Parent Co", [])], "entity_id bigint, qid string, name string, aliases array<string>")
    places = make([("CA", "Canada")], "code string, name string")
    html = '<meta property="article:published_time" content="2026-09-23T09:30:00Z">'
    return jobs.CollectJob(spark, str(tmp_path / "tables"), lambda: outlets, lambda: themes, lambda: sections, lambda: entities, lambda: places,
                           pages=lambda new: new.where(F.col("url").contains("alpha")).select("article_id", F.lit(html).alias("html")))


def run(spark, job, source, tmp_path):
    jobs.collect(spark, str(source), job, str(tmp_path / "checkpoint"), files_per_batch=1).awaitTermination()


def test_collect_resumes_and_keeps_the_first(spark, job, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    slot_file(source, "20260923100000", [A1, "junk"])
    run(spark, job, source, tmp_path)
    assert [(r.title, r.batch) for r in job.table("articles").collect()] == [("Senate passes budget reform tonight", 0)]
    slot_file(source, "20260923101500", [B1, A1_AGAIN])
    slot_file(source, "20260923101500", [C1], ".translation")
    run(spark, job, source, tmp_path)
    run(spark, job, source, tmp_path)  # nothing new: nothing happens
    got = {r.url: r for r in job.table("articles").collect()}
    assert set(got) == {"https://alpha.ca/1?utm_source=x", "https://beta.ca/9", "https://alpha.ca/2"}
    first = got["https://alpha.ca/1?utm_source=x"]
    assert first.about == ["Canada"] and first.names == ["Parent Co"] and first.themes == {"TAX": 3}
    assert got["https://alpha.ca/2"].language == "fr" and got["https://beta.ca/9"].themes == {}
    assert [(r.article_id, r.slug) for r in job.table("tags").collect()] == [(first.article_id, "tax")]
    assert [(r.article_id, r.country, r.mentions) for r in job.table("places").collect()] == [(first.article_id, "CA", 2)]
    assert [(r.article_id, r.qid, r.mentions) for r in job.table("mentions").collect()] == [(first.article_id, "Q12", 2)]
    story = {r.article_id: r.story_id for r in job.table("stories").collect()}
    assert story[got["https://beta.ca/9"].article_id] == first.article_id and len(story) == 3
    dated = {r.article_id: r.at for r in job.table("dates").collect()}
    assert dated == {first.article_id: datetime(2026, 9, 23, 9, 30), got["https://alpha.ca/2"].article_id: datetime(2026, 9, 23, 9, 30)}
    # The stream keeps what one batch over all files keeps.
    records = lines.parse_lines(lines.read_lines(spark, str(source)), job.outlets()).withColumn("url_key", url.canonical_key(F.col("url")))
    assert {(r.url_key, r.title) for r in load.first_per_key(records).collect()} == {(r.url_key, r.title) for r in got.values()}
    # Stories linked batch by batch equal stories linked at once.
    pool = job.table("articles").withColumn("story_id", F.lit(None).cast("bigint"))
    assert {r.article_id: r.story_id for r in stories.link_stories(pool).collect()} == story


def test_a_replayed_batch_changes_nothing(spark, job, tmp_path):
    (tmp_path / "in").mkdir()
    slot_file(tmp_path / "in", "20260923100000", [A1, B1])
    batch = lines.read_lines(spark, str(tmp_path / "in"))
    job(batch, 0)
    once = {name: sorted(map(str, job.table(name).drop("checked").collect())) for name in job.schemas}
    job(batch, 0)
    assert {name: sorted(map(str, job.table(name).drop("checked").collect())) for name in job.schemas} == once
    job(batch, 1)  # the same lines in a later batch: known keys
    assert job.table("articles").count() == 2


def stream_of(spark, folder, batches, schema):
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))


def drain(df, mode="append", **options):
    name = f"out{abs(hash(str(df)))}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).options(**options).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, df.sparkSession.table(name)


def test_stream_dedup_equals_batch_keys(spark, tmp_path):
    at = datetime(2026, 9, 23, 10)
    batches = [[("https://a.ca/1", at)], [("http://www.a.ca/1/", at + timedelta(minutes=5)), ("https://a.ca/2", at + timedelta(minutes=6))], [("https://a.ca/2#x", at + timedelta(minutes=7))]]
    _, got = drain(jobs.dedup_stream(stream_of(spark, tmp_path / "d", batches, "url string, seen timestamp")))
    assert sorted(r.url_key for r in got.collect()) == ["a.ca/1", "a.ca/2"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    at = datetime(2026, 9, 23, 0, 10)
    # A batch is judged by the watermark of the batch before it.
    rows = [[(1, at)], [(1, at + timedelta(hours=10))], [(1, at + timedelta(hours=10))], [(1, at + timedelta(minutes=1)), (1, at + timedelta(hours=8))], [(1, at + timedelta(hours=20))]]
    q, got = drain(jobs.slot_counts(stream_of(spark, tmp_path / "l", rows, "outlet_id int, seen timestamp"), ["outlet_id"]))
    seen = {r.slot: r.articles for r in got.collect()}
    assert seen[datetime(2026, 9, 23, 0, 15)] == 1  # the row ten hours late is not in it
    assert seen[datetime(2026, 9, 23, 8, 15)] == 1 and jobs.late_rows(q) == 1


def test_slots_exclude_their_start(spark):
    df = spark.createDataFrame([(1, datetime(2026, 9, 23, 10, 15)), (1, datetime(2026, 9, 23, 10, 15, 1)), (1, datetime(2026, 9, 23, 10, 30))], "outlet_id int, seen timestamp")
    assert sorted((r.slot, r.articles) for r in jobs.slot_counts(df, ["outlet_id"]).collect()) == [(datetime(2026, 9, 23, 10, 15), 1), (datetime(2026, 9, 23, 10, 30), 2)]


def test_hold_then_release(spark, tmp_path):
    jobs.use_rocksdb(spark)
    t = datetime(2026, 9, 23, 10)
    m = lambda n: t + timedelta(minutes=n)
    batches = [[(1, "collected", m(0)), (2, "collected", m(0)), (3, "collected", m(1)), (3, "checked", m(4))], [(1, "checked", m(5))], [(9, "collected", m(30))], [(2, "checked", m(31))], [(8, "collected", m(60))], [(7, "collected", m(61))]]
    _, got = drain(jobs.hold_release(stream_of(spark, tmp_path / "h", batches, "article_id bigint, kind string, at timestamp")))
    rows = {r.article_id: (r.released_at, r.reason) for r in got.collect()}
    assert rows == {3: (m(4), "checked"), 1: (m(5), "checked"), 2: (m(15), "held long enough"), 9: (m(45), "held long enough")}


def test_collect_reads_zips_and_tags_by_section(spark, job, tmp_path):
    import zipfile

    source = tmp_path / "zips"
    source.mkdir()

    def pack(at, rows, stream=""):
        with zipfile.ZipFile(source / f"{at}{stream}.gkg.csv.zip", "w") as z:
            z.writestr(f"{at}{stream}.gkg.csv", "\n".join(rows) + "\n")

    themes, sections = tagging.tag_dimensions(spark, [{"slug": "tax", "themes": ["TAX"]}, {"slug": "labour", "sections": ["Éducation"]}])
    job.tag_themes, job.tag_sections = lambda: themes, lambda: sections
    html = '<meta property="article:section" content="Education"><meta property="article:published_time" content="2026-09-23T09:30:00Z">'
    job.pages = lambda new: new.where(F.col("url").contains("alpha.ca/2")).select("article_id", F.lit(html).alias("html"))
    pack("20260923100000", [A1])
    pack("20260923101500", [B1])
    pack("20260923101500", [C1], ".translation")
    (source / "20260923103000.gkg.csv.zip").write_bytes(b"not a zip")
    jobs.collect(spark, str(source), job, str(tmp_path / "checkpoint"), files_per_batch=4, zipped=True).awaitTermination()
    got = {r.url: r.article_id for r in job.table("articles").collect()}
    assert set(got) == {"https://alpha.ca/1?utm_source=x", "https://beta.ca/9", "https://alpha.ca/2"}
    assert {(r.article_id, r.slug) for r in job.table("tags").collect()} == {(got["https://alpha.ca/1?utm_source=x"], "tax"), (got["https://alpha.ca/2"], "labour")}
    assert [r.label for r in job.table("sections").collect()] == ["Education"]
    assert [r.file for r in job.table("unreadable").collect()] == ["20260923103000.gkg.csv.zip"]


def test_repeats_fill_in_what_is_stored_once(spark, job, tmp_path):
    from mediagraph.operators.feed import FeedFilters
    from mediagraph.operators.feedstore import FeedStore

    article = "article_id bigint, outlet_id bigint, seen timestamp, stated timestamp, title string, about string"
    job.feed = FeedStore(spark, str(tmp_path / "feed"), spark.createDataFrame([], article).schema)
    source = tmp_path / "in"
    source.mkdir()
    bare = gkg("https://beta.ca/9", "Budget reform passes the Senate", at="20260923100000")
    slot_file(source, "20260923100000", [bare, A1])
    run(spark, job, source, tmp_path)
    before = {r.url_key: r for r in job.table("articles").collect()}
    assert before["beta.ca/9"].names == [] and before["beta.ca/9"].themes == {}
    files = {p.path for p in job.log("articles").picked()}
    full = gkg("https://beta.ca/9", "Other headline", at="20260924101500", c8="TAX,1;TAX,2;TAX,3", c10="1##CA##;1##CA##", c14="Parent Co,1;Parent Co,2")
    later = gkg("https://beta.ca/9", "Other headline", at="20260924103000", c8="OTHER,1", c10="1##FR##", c14="Alpha Inc,1;Alpha Inc,2")
    slot_file(source, "20260924101500", [full])
    slot_file(source, "20260924103000", [later])
    run(spark, job, source, tmp_path)
    got = {r.url_key: r for r in job.table("articles").collect()}
    b = got["beta.ca/9"]
    assert set(got) == set(before) and b.title == "Budget reform passes the Senate" and b.names == ["Parent Co"] and b.about == ["Canada"] and b.themes == {"TAX": 3} and b.batch == 0
    assert got["alpha.ca/1"].names == before["alpha.ca/1"].names and files != {p.path for p in job.log("articles").picked()}
    mine = lambda name, *c: [tuple(r[x] for x in c) for r in job.table(name).where(F.col("article_id") == b.article_id).collect()]
    assert mine("places", "country", "mentions", "batch") == [("CA", 2, 1)] and mine("mentions", "qid", "batch") == [("Q12", 1)] and mine("tags", "slug", "batch") == [("tax", 1)]
    # the feed shows the dates that were found
    rows, info = job.feed.page(job.outlets().withColumn("country", F.lit("CA")), FeedFilters())
    assert info["total"] == 2 and {r.article_id: r.stated for r in rows.collect()} == {b.article_id: None, got["alpha.ca/1"].article_id: datetime(2026, 9, 23, 9, 30)}


def test_a_crash_between_tables_is_made_good(spark, job, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    slot_file(tmp_path / "in", "20260923100000", [A1, B1])
    batch = lines.read_lines(spark, str(tmp_path / "in"))
    with monkeypatch.context() as m:
        m.setattr(jobs.CollectJob, "enrich", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            job(batch, 0)
    assert job.table("articles").count() == 2 and job.table("places").count() == 0
    job(batch, 0)
    assert job.table("articles").count() == 2 and job.table("places").count() == 1 and job.table("tags").count() == 1
    for k in range(1, 4):
        job(batch, k)
    job.compact_from = 2
    job.tidy(4)
    assert job.table("articles").count() == 2 and len(job.log("places").picked()) == 1
