"""Column functions against hand-made values."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mediagraph.functions import ids, url, when
from mediagraph.functions import text as tx


@pytest.fixture(scope="module")
def apply(spark):
    def run(values, fn, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("r"))
        return [r.r for r in sorted(df.collect())]

    return run


def test_canonical_keys(apply):
    got = apply(["https://CBC.ca/news/x?utm_source=t&utm_medium=s", "https://cbc.ca/news/x", "http://www.cbc.ca:80/news/x/#top",
                 "https://cbc.ca/news/X", "https://a.cbc.ca/news/x", "https://cbc.ca/p?b=2&a=1&c=", "https://cbc.ca/p?fbclid=1", "https://cbc.ca", "https://cbc.ca:8443/a"], url.canonical_key)
    assert got == ["cbc.ca/news/x", "cbc.ca/news/x", "cbc.ca/news/x", "cbc.ca/news/X", "a.cbc.ca/news/x", "cbc.ca/p?a=1&b=2&c=", "cbc.ca/p", "cbc.ca/", "cbc.ca:8443/a"]


def test_urls(apply):
    assert apply(["https://a.ca/x", "ftp://a.ca", "https://a b.ca", "https://", "javascript:x", None, "https://a.ca/" + "x" * 2048], url.is_http_url) == [True, False, False, False, False, False, True]
    assert apply(["https://User@WWW.Example.COM.:443/x", "http://[::1]/"], url.host_of) == ["www.example.com", "::1"]
    assert apply(["ici.radio-canada.ca", "ca"], url.parent_domains) == [["ici.radio-canada.ca", "radio-canada.ca"], []]


def test_folding_agrees_with_the_unicode_database(apply):
    samples = ["Élysée", "STRASSE straße", "ﬁne", "Ａｂｃ", "Ἀθήνα", "naïve  café x", "Ǆ", "İstanbul", "ŉ", "Đorđe", "Łódź", "Ω", "①②"]
    assert apply(samples, tx.normalize_text) == [tx.fold_text(s) for s in samples]
    assert apply([*samples, "각", "㎏"], tx.normalize_text_exact) == [tx.fold_text(s) for s in [*samples, "각", "㎏"]]


def test_titles(apply):
    assert apply(["A &amp; B\u0007\n C", "x" * 600, "&eacute;t&eacute;"], tx.clean_title) == ["A & B C", "x" * 600, "été"]
    assert apply(["<b>Bold</b> &amp; more", "plain"], lambda c: tx.strip_tags(c, exact=True)) == [" Bold  & more", "plain"]


def test_names(apply):
    assert apply(["The Woodbridge Company Limited", "AP", "BCE Inc.", "Québecor inc.", "Inc"], tx.name_key) == ["woodbridge company", "", "bce", "quebecor", "inc"]
    assert apply(["BCE", "CN2i", "Rogers", "A.B.C.", "TOOLONGNAME"], tx.is_acronym) == [True, True, False, True, False]
    assert apply(["world health organization", "nato", "Mark Carney", "o'brien"], tx.display_name) == ["World Health Organization", "NATO", "Mark Carney", "O'Brien"]


def test_alias_keys(spark):
    df = spark.createDataFrame([("Rogers Communications", ["Rogers", "RCI", "Rogers Communications Inc."])], "n string, a array<string>")
    assert set(df.select(tx.alias_keys(F.col("n"), F.col("a")).alias("k")).first().k) == {"rogers communications", "rci"}


def test_zoned_times(apply):
    got = apply(["2026-09-23 20:14:00+0000", "2026-09-23T20:14:00", "2026-09-23", "2026-09-23T20:14:00-04:00", "2026-02-30T00:00:00Z", "2026-09-23T20:14:05.25Z"], when.parse_zoned_ts)
    assert got == [datetime(2026, 9, 23, 20, 14), None, None, datetime(2026, 9, 24, 0, 14), None, datetime(2026, 9, 23, 20, 14, 5, 250000)]


def test_feed_times(apply):
    got = apply(["Wed, 23 Sep 2026 20:14:00 GMT", "23 Sep 2026 20:14 -0400", "Wed, 23 Sep 2026 20:14:00", "yesterday"], when.parse_feed_ts)
    assert got == [datetime(2026, 9, 23, 20, 14), datetime(2026, 9, 24, 0, 14), None, None]


def test_partial_dates(spark):
    rows = [("+2020-05-01T00:00:00Z", 11), ("+2020-05-00T00:00:00Z", 10), ("+2020-00-00T00:00:00Z", 9), ("-0044-03-15T00:00:00Z", 11), ("+12020-01-01T00:00:00Z", 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p int")
    got = [(r.s, r.d) for r in sorted(df.select("i", when.partial_date_text(F.col("t"), F.col("p")).alias("s"), when.partial_date(F.col("t"), F.col("p")).alias("d")).collect())]
    assert got == [("2020-05-01", datetime(2020, 5, 1)), ("2020-05", datetime(2020, 5, 1)), ("2020", datetime(2020, 1, 1)), (None, None), (None, None)]


def test_identifiers(spark):
    rows = [("sec_cik", " 1234 ", "0000001234"), ("us_ein", "123456789", "12-3456789"), ("us_ein", "12-3456789", "12-3456789"), ("ca_bn", "123456789 rr0001", "123456789RR0001"),
            ("ca_bn", "123", None), ("sec_cik", "12a", None), ("other", "1", None)]
    df = spark.createDataFrame(rows, "s string, v string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", ids.normalize_id(F.col("s"), F.col("v"))).collect())


def test_owner_types(apply):
    kinds = [["broadcaster", "Crown corporation"], ["human", "company"], ["newspaper"], [], ["company", "public company"]]
    assert apply(kinds, ids.owner_type, "array<string>") == ["Crown corporation", "person", "newspaper", "", "public company"]


def test_section_parts(apply):
    assert apply(["News > Politics", "Canada/Health", "A - B", "A-B", "x, y; z|w"], tx.section_parts) == [["News", "Politics"], ["Canada", "Health"], ["A", "B"], ["A-B"], ["x", "y", "z", "w"]]


def test_settings_fold_as_columns_do(apply):
    values = ["한국 경제 뉴스", "Café  Crème", "ﬁn", "STRASSE", "straße", "ÅNGSTRÖM", "日本", "ｆｕｌｌ", "Ελλάδα", "İstanbul", "plain Words"]
    assert apply(values, tx.normalize_text) == [tx.fold_as_columns(v) for v in values]


def test_two_digit_years_of_mail_dates(apply):
    got = apply(["Wed, 23 Sep 26 20:00:00 GMT", "3 Jan 69 01:02 GMT", "Wed, 23 Sep 2026 20:00:00 GMT"], when.parse_mail_ts)
    assert [x.isoformat() for x in got] == ["2026-09-23T20:00:00", "1969-01-03T01:02:00", "2026-09-23T20:00:00"]
