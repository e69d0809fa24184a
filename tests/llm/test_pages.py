"""Archives, URL filters and text extraction."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random

import pytest

from mediagraph.llm import html_text, url_filters, warc

PAGES = "page_id bigint, url string, html string"


def page_rows():
    rng = random.Random(2)
    rows = [(i, f"https://h{i % 7}.example.com/p/{i}", "<p>" + " ".join(rng.choice(["ab", "cd", "é"]) for _ in range(rng.randrange(0, 300))) + "</p>") for i in range(120)]
    rows += [(200 + i, None if i % 2 else "http://x/ y", rows[i % 5][2]) for i in range(40)]
    return [*rows, (300, "http://e/", None), (301, "http://e/", ""), (302, "http://e/", "\r\n\r\nWARC/1.1\r\n"), (303, "u", "z" * 3_000_000)]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(4), f"file://{tmp_path}/a")
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, url, html in rows:
        payload, r = (html or "").encode(), got[i]
        lead = first[html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert r.payload == (payload if lead == i else None) and r.url == (url.replace(" ", "%20") if url else None)
    for m in manifest.collect():
        raw = open(m.path.removeprefix("file://"), "rb").read()
        assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME and len(raw) == m.bytes
        after = 8 + int.from_bytes(raw[4:8], "little")
        assert raw[after : after + 4] == b"\x28\xb5\x2f\xfd"


def test_archives_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(None, "u", "same", 1), (5, "u", "same", 2), (5, "u", "same", 3), (None, None, "alone", 4)], PAGES + ", first int")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(docs, f"file://{tmp_path}/b")).collect())
    assert got == [("5", "response", None), ("5", "response", None), ("None", "response", None), ("None", "revisit", 5)]
    assert warc.read_archives(warc.write_archives(docs.limit(0), f"file://{tmp_path}/c")).count() == 0


RULES = [url_filters.UrlRule("com", "/", True), url_filters.UrlRule("example.com", "/en/", False), url_filters.UrlRule("www.example.com", "/en/", True), url_filters.UrlRule("net", "/es/", False)]


def test_rules_take_the_longest_that_fits(spark):
    cases = [
        ("http://Example.COM/en/x?q=/es/", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/1#f", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("ftp://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"), ("http://x.com", "x.com", "", None, "allow"), ("http://x.com?a/b", "x.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://", "", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    rows = spark.createDataFrame([(i, c[0], "mine") for i, c in enumerate(cases)], "page_id bigint, url string, host string")
    got = url_filters.judged(rows, RULES, keep=["page_id", "host"]).orderBy("page_id").collect()
    assert [(r._host, r.path, r.rule, r.verdict) for r in got] == [c[1:] for c in cases]
    assert {r.host for r in got} == {"mine"} and url_filters.judged(rows.limit(0), RULES).count() == 0


def test_segmented_names_are_scored(spark):
    good = [f"http://{a}-{b}.example.org/en/{k}" for k, (a, b) in enumerate([("green", "garden"), ("news", "daily"), ("river", "news"), ("garden", "daily"), ("green", "river"), ("blue", "stone")] * 3)]
    bad = [f"http://{a}-{b}.example.org/en/{k}" for k, (a, b) in enumerate([("cheap", "pills"), ("free", "casino"), ("cheap", "casino"), ("win", "bets"), ("free", "bets"), ("win", "pills")] * 3)]
    asked = ["http://cheappills.example.org/en/1", "http://freewin.example.org/", "http://greengarden.example.org/en/2", "http://newsdaily.example.org/x", "http://zzyzx.example.org/q"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + asked)], "page_id bigint, url string")
    got = {r.url: r.verdict for r in url_filters.judged(rows, RULES).collect()}
    assert [got[u] for u in asked] == ["block", "block", "allow", "allow", "allow"]
    assert all(got[u] == "allow" for u in good) and all(got[u] == "block" for u in bad)


def test_words_past_the_most_frequent_tell(spark):
    letters = "bcdfghjklm"
    common = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=5), 50_100)]
    good = [f"http://{host}.org/{'-'.join(common[k : k + 1_000])}" for host in ("stone", "river", "light") for k in range(0, len(common), 1_000)]
    asked = {"http://zyzzyx-casino.org/": "block", "http://zyzzyx-offer.org/": "block", "http://zyzzyxoffer.org/": "block", "http://offer.org/": "allow"}
    rows = spark.createDataFrame([(u,) for u in [*good, *asked]], "url string")
    got = {r.url: r.verdict for r in url_filters.judged(rows, RULES).collect()}
    assert {u: got[u] for u in asked} == asked and all(got[u] == "allow" for u in good)


def test_viterbi_takes_the_cheapest_split():
    costs = {"cheap": 2.0, "pills": 2.0, "che": 1.9, "ap": 2.5}
    assert url_filters.segments("cheappills", costs, 8.0) == ["cheap", "pills"]
    assert url_filters.segments("qq", costs, 8.0) == ["qq"] and url_filters.segments("", costs, 8.0) == []


def site(rng, k):
    word = lambda: rng.choice(["stone", "river", "light", "garden", "moves", "under", "the", "a", "of"])
    text = lambda n: (" ".join(word() for _ in range(n)) + ".").capitalize()
    paragraphs = [text(rng.randrange(8, 60)) for _ in range(rng.randrange(1, 7))]
    page = f"<!DOCTYPE html><html><head><title>{text(4)}</title><style>p&gt;a{{}}</style><script>var a='</p><p>not text</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>{word()}</a></ul></nav><div class=\"ad\">{text(9)}</div><article><h1>T{k} &amp; more</h1><p>{'<p>'.join(paragraphs)}</article><footer>&copy; {text(5)}</footer></body>"
    return page, " ".join([f"T{k} & more", *paragraphs])


def test_article_text_of_held_out_pages(spark):
    rng = random.Random(6)
    sites = [site(rng, k) for k in range(300)]
    docs = spark.createDataFrame([(i, f"u{i}", s[0]) for i, s in enumerate(sites)], PAGES)
    weights = html_text.fit(docs.where("page_id < 200"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.with_text(docs, keep=["page_id"], weights=weights).collect()}
    right = sum(got[i] == (t, len(t)) for i, (_, t) in enumerate(sites) if i >= 200)
    assert right >= 97
    odd = [None, "", "   ", "<script>only()</script>", "<p", "<!-- open", "<article><p>x &lt; y <b>bo</b>ld &am", "<div class='x' title=\"a>b\"><p>t</p>"]
    rows = spark.createDataFrame([(i, "u", h, "mine") for i, h in enumerate(odd)], PAGES + ", text string")
    told = html_text.with_text(rows, weights=weights)
    assert told.columns == ["page_id", "url", "html", "text", "_text", "n_chars"] and told.count() == len(odd)
    assert [r._text for r in told.orderBy("page_id").collect()][:6] == [""] * 6
    assert html_text.with_text(docs.limit(0)).count() == 0


def test_blocks_and_their_paths():
    page = "<body><div class='Main-Text' id=a1><p>one <a href='#'>two</a><p>three<br>four &eacute;&#33;</div><ul><li>x<li>y</ul><textarea><p>no</textarea><table><tr><td>c<td>d</table>tail"
    got = [(b.text, b.path, b.linked) for b in html_text.blocks_of(page)]
    box = ("body", "div", ".main", ".text", ".a")
    assert got == [("one two", (*box, "p"), 3), ("three four é!", (*box, "p"), 0), ("x", ("body", "ul", "li"), 0), ("y", ("body", "ul", "li"), 0), ("c", ("body", "table", "tr", "td"), 0), ("d", ("body", "table", "tr", "td"), 0), ("tail", ("body",), 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_gradients_of_the_labeller(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    pages = [[html_text.Block("a b c.", ("html", "p"), 1), html_text.Block("d", ("nav",), 0)], [html_text.Block("e f", ("p",), 0)]]
    weights, counts, labels = html_text.fresh_weights(seed), np.array([2, 1]), np.array([1, 0, 1])
    data, heard = html_text.described(pages, {}), np.array([1.0, 1.0, 0.0])
    _, grads = html_text.learning_step(weights, data, labels, counts, heard)
    for name in ("fw", "bb", "out", "path", "word"):
        at = tuple(x[0] for x in np.nonzero(np.abs(grads[name]) > 1e-6)) if grads[name].ndim > 1 else (int(np.argmax(np.abs(grads[name]))),)
        moved = {}
        for sign in (1, -1):
            near = {k: v.copy() for k, v in weights.items()}
            near[name][at] += sign * 1e-5
            moved[sign] = html_text.learning_step(near, data, labels, counts, heard)[0]
        assert abs((moved[1] - moved[-1]) / 2e-5 - grads[name][at]) < 1e-5, name
