"""Column functions, URL keys, hosts, coverage, slots and crawl rules over pages, documents and the star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import ids, url, when
from mediagraph.functions import text as tx
from mediagraph.operators import coverage, load, robots
from mediagraph.plans.bindings import Tables
from mediagraph.plans.registry import query
from mediagraph.sources import slots

# Page URLs in five shapes, so that both sides of every rule occur.
VARIED = """CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://www.') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'B=2&utm_Medium=x&a=1&FBCLID=9'
  WHEN 2 THEN replace(url, '://', ' ://') WHEN 3 THEN replace(url, 'http', 'ftp') ELSE upper(url) END"""


def varied() -> Column:
    n, u = F.col("page_id") % 5, F.col("url")
    tail = F.concat(F.replace(u, F.lit("://"), F.lit("://www.")), F.when(u.contains("?"), "&").otherwise("?"), F.lit("B=2&utm_Medium=x&a=1&FBCLID=9"))
    return (F.when(n == 0, u).when(n == 1, tail).when(n == 2, F.replace(u, F.lit("://"), F.lit(" ://")))
            .when(n == 3, F.replace(u, F.lit("http"), F.lit("ftp"))).otherwise(F.upper(u)))


HOST = "lower(regexp_extract({u}, '(?i)^https?://([^/?#:]+)', 1))"


@query("url_validity_and_host", sql=f"""SELECT page_id, regexp_matches(u, '(?i)^https?://[^/?#]') AND NOT contains(u, ' ') AS valid,
{HOST.format(u='u')} AS host FROM (SELECT page_id, {VARIED} AS u FROM pages)""")
def _(t: Tables) -> DataFrame:
    rows = t.read("pages").select("page_id", varied().alias("u"))
    return rows.select("page_id", url.is_http_url(F.col("u")).alias("valid"), url.host_of(F.col("u")).alias("host"))


KEY = """regexp_replace({host}, '^www\\.', '') || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END
|| CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_sort(q), '&') END"""
KEYED = f"""keyed AS (SELECT page_id, url, {KEY.format(host=HOST.format(u='u'))} AS url_key FROM (SELECT page_id, url, u, regexp_extract(u, '(?i)^https?://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT regexp_matches(lower(p), '^(fbclid|gclid|ref_src|ref_url)=')) AS q
  FROM (SELECT page_id, url, {{u}} AS u FROM pages)))"""


@query("url_canonical_keys", sql="WITH " + KEYED.format(u=f"CASE WHEN page_id % 5 IN (2, 3) THEN url ELSE {VARIED} END") + "SELECT page_id, url_key FROM keyed")
def _(t: Tables) -> DataFrame:
    shaped = F.when((F.col("page_id") % 5).isin(2, 3), F.col("url")).otherwise(varied())
    return t.read("pages").select("page_id", url.canonical_key(shaped).alias("url_key"))


@query("articles_first_per_key", sql="WITH " + KEYED.format(u="url") + """SELECT min(page_id) AS page_id, url_key, count(*) AS copies FROM keyed GROUP BY url_key""")
def _(t: Tables) -> DataFrame:
    rows = t.read("pages").select("page_id", url.canonical_key(F.col("url")).alias("url_key"), F.col("page_id").alias("arrival"))
    return load.first_per_key(rows).select("page_id", "url_key", "copies")


@query("articles_new_only", sql="WITH " + KEYED.format(u="url") + """, stored AS (SELECT url_key FROM keyed WHERE page_id % 2 = 0)
SELECT min(page_id) AS page_id, url_key FROM keyed WHERE url_key NOT IN (SELECT url_key FROM stored) GROUP BY url_key""")
def _(t: Tables) -> DataFrame:
    rows = t.read("pages").select("page_id", url.canonical_key(F.col("url")).alias("url_key"), F.col("page_id").alias("arrival"))
    stored = rows.where(F.col("page_id") % 2 == 0).select("url_key")
    return load.new_articles(rows, stored).select("page_id", "url_key")


NORMAL = "trim(regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query("text_normalized", sql=f"SELECT doc_id, md5({NORMAL.format(c='text')}) AS folded, length({NORMAL.format(c='text')}) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    folded = tx.normalize_text(F.col("text"))
    return t.read("documents").select("doc_id", F.md5(folded).alias("folded"), F.length(folded).alias("n"))


WORDS = "regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')"


@query("text_words", sql=f"SELECT doc_id, len({WORDS.format(c='text')}) AS words, md5(array_to_string({WORDS.format(c='text')}, ' ')) AS joined FROM documents")
def _(t: Tables) -> DataFrame:
    words = tx.word_tokens(F.col("text"))
    return t.read("documents").select("doc_id", F.size(words).alias("words"), F.md5(F.array_join(words, " ")).alias("joined"))


UNESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
TIDY = "trim(regexp_replace(regexp_replace({c}, '\\p{{C}}', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@query("titles_clean", sql=f"""SELECT page_id, {TIDY.format(c=UNESCAPED.format(c="regexp_extract(html, '<title>([^<]*)</title>', 1)"))} AS title FROM pages""")
def _(t: Tables) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.read("pages").select("page_id", tx.clean_title(title, exact=False).alias("title"))


@query("tags_stripped", sql=f"""SELECT page_id, md5({UNESCAPED.format(c="regexp_replace(html, '<[^>]+>', ' ', 'g')")}) AS plain FROM pages""")
def _(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", F.md5(tx.strip_tags(F.col("html"))).alias("plain"))


PARTY = """concat(CASE WHEN c_custkey % 2 = 0 THEN 'The ' ELSE '' END, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'a.b.C.D' ELSE 'nato' END,
  CASE c_custkey % 3 WHEN 0 THEN ' Co. Ltd' WHEN 1 THEN '' ELSE ' Inc' END)"""


def party() -> Column:
    k = F.col("c_custkey")
    core = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.lower("c_mktsegment")).when(k % 4 == 2, "a.b.C.D").otherwise("nato")
    return F.concat(F.when(k % 2 == 0, "The ").otherwise(""), core, F.when(k % 3 == 0, " Co. Ltd").when(k % 3 == 1, "").otherwise(" Inc"))


KEYTEXT = """regexp_replace(regexp_replace(array_to_string(regexp_extract_all(lower(p), '[\\p{L}\\p{N}_]+'), ' '), '^the( |$)', ''), '( (inc|ltd|co))+$', '')"""


@query("name_keys", sql=f"""SELECT c_custkey, p AS name, CASE WHEN length(replace({KEYTEXT}, ' ', '')) >= 3 THEN {KEYTEXT} ELSE '' END AS name_key,
regexp_matches(trim(replace(p, '.', '')), '^[\\p{{L}}\\p{{N}}]{{3,8}}$') AND len(regexp_extract_all(p, '\\p{{Lu}}')) >= 2 AS acronym,
CASE WHEN lower(p) <> p THEN p WHEN length(p) <= 4 THEN upper(p) ELSE upper(left(p, 1)) || substr(p, 2) END AS display FROM (SELECT c_custkey, {PARTY} AS p FROM customer)""")
def _(t: Tables) -> DataFrame:
    rows = t.read("customer").select("c_custkey", party().alias("name"))
    name = F.col("name")
    return rows.select("c_custkey", "name", tx.name_key(name).alias("name_key"), tx.is_acronym(name).alias("acronym"), tx.display_name(name).alias("display"))


@query("timestamps_zoned", ("b_pages",), """, raw AS (SELECT page_id, regexp_extract(html, 'published_time" content="([^"]*)"', 1) AS v FROM b_pages)
SELECT page_id, CASE WHEN v LIKE '%Z' THEN CAST(replace(v, 'Z', '') AS TIMESTAMP) WHEN v LIKE '%-0500' THEN CAST(replace(v, '-0500', '') AS TIMESTAMP) + INTERVAL '5' HOUR
WHEN v LIKE '%+02:00' THEN CAST(replace(v, '+02:00', '') AS TIMESTAMP) - INTERVAL '2' HOUR END AS at FROM raw""")
def _(t: Tables) -> DataFrame:
    raw = F.regexp_extract("html", 'published_time" content="([^"]*)"', 1)
    return t.pages.select("page_id", when.parse_zoned_ts(raw).alias("at"))


@query("timestamps_mail", sql="SELECT o_orderkey, o_orderdate + INTERVAL '9' HOUR AS at FROM orders")
def _(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    stamp = F.concat(F.date_format(day, "EEE, d MMM yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " 09:00:00 GMT").otherwise(" 4:00 EST"))
    return t.read("orders").select("o_orderkey", when.parse_feed_ts(stamp).alias("at"))


@query("dates_partial", sql="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') END AS shown,
CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN date_trunc('month', o_orderdate) WHEN 2 THEN date_trunc('year', o_orderdate) END AS at FROM orders""")
def _(t: Tables) -> DataFrame:
    n, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    body = F.when(n == 0, F.date_format(day, "yyyy-MM-dd")).when(n == 1, F.date_format(day, "yyyy-MM-'00'")).otherwise(F.date_format(day, "yyyy-'00-00'"))
    text = F.concat(F.when(n == 3, "-").otherwise("+"), body, F.lit("T00:00:00Z"))
    precision = F.when(n == 0, 11).when(n == 1, 10).otherwise(9)
    return t.read("orders").select("o_orderkey", when.partial_date_text(text, precision).alias("shown"), when.partial_date(text, precision).alias("at"))


@query("places_named", ("b_mentions",), """SELECT m.article_id, m.country, CASE WHEN m.country = 24 THEN CAST(m.country AS VARCHAR) ELSE n.n_name END AS place, count(*) AS mentions
FROM b_mentions m LEFT JOIN nation n ON n.n_nationkey = m.country GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    names = t.read("nation").where("n_nationkey <> 24").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    counted = t.mentions.groupBy("article_id", F.col("country").cast("string").alias("country")).agg(F.count("*").alias("mentions"))
    return ids.with_place_names(counted, names).select("article_id", F.col("country").cast("int").alias("country"), "place", "mentions")


@query("stakes_as_fractions", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x > 0 AND x <= 1 THEN round(x, 6) WHEN x > 1 AND x <= 100 THEN round(x / 100, 6) END AS stake, count(*) AS n
FROM (SELECT *, l_quantity * (l_discount * 100 - 5) AS x FROM lineitem) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    x = F.col("l_quantity") * (F.col("l_discount") * 100 - 5)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.read("lineitem").select(*keys, F.round(ids.first_stake(F.array(F.lit(-1.0), x)), 6).alias("stake"))
    return rows.groupBy(*keys, "stake").agg(F.count("*").alias("n"))


@query("identifiers_normalized", sql="""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') WHEN 1 THEN left(d, 2) || '-' || substr(d, 3) WHEN 2 THEN d || 'RR0001' END AS value
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS d FROM orders)""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    digits = F.lpad(k.cast("string"), 9, "0")
    scheme = F.when(k % 4 == 0, "sec_cik").when(k % 4 == 1, "us_ein").otherwise("ca_bn")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 4 == 1, digits).when(k % 4 == 2, F.concat(digits, F.lit(" rr0001"))).otherwise(digits)
    return t.read("orders").select("o_orderkey", ids.normalize_id(scheme, raw).alias("value"))


@query("charity_links", sql="""SELECT o_orderkey, 'Registered charity ' || bn || ': CRA listing and T3010 returns' AS label,
'https://apps.cra-arc.gc.ca/ebci/hacc/srch/pub/dsplyRprtngPrd?selectedCharityBn=' || bn || '&dsrdPg=1' AS source_url
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || 'RR0001' AS bn FROM orders WHERE o_orderkey % 2 = 0)""")
def _(t: Tables) -> DataFrame:
    from mediagraph.sources import filings

    k = F.col("o_orderkey")
    numbers = t.read("orders").select("o_orderkey", F.concat(F.lpad(k.cast("string"), 9, "0"), F.when(k % 2 == 0, "RR0001").otherwise("XX")).alias("value"))
    return filings.charity_records(numbers).select("o_orderkey", "label", "source_url")


@query("section_parts", sql="""SELECT p_partkey, p AS part, CAST(i - 1 AS INT) AS pos FROM (SELECT p_partkey, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i FROM (
SELECT p_partkey, [p_brand, p_type, p_name] AS l FROM part))""")
def _(t: Tables) -> DataFrame:
    label = F.concat("p_brand", F.lit(" > "), "p_type", F.lit(" - "), "p_name")
    return t.read("part").select("p_partkey", F.posexplode(tx.section_parts(label)).alias("pos", "part")).select("p_partkey", "part", "pos")


# Every second distinct three-label domain of the pages is an outlet.
DOMAINS = """hosts AS (SELECT page_id, html, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages)
, domains AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS domain FROM hosts)
, outs AS (SELECT domain FROM domains WHERE length(domain) % 2 = 0)
, matched AS (SELECT h.*, o.domain FROM hosts h LEFT JOIN outs o ON o.domain = regexp_extract(h.host, '([^.]+\\.[^.]+\\.[^.]+)$', 1))"""


def page_outlets(t: Tables) -> tuple[DataFrame, DataFrame]:
    pages = t.read("pages").select("page_id", "html", url.host_of(F.col("url")).alias("host"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return pages, pages.select(domain.alias("domain")).distinct().where(F.length("domain") % 2 == 0)


@query("hosts_to_outlets", sql="WITH " + DOMAINS + "SELECT page_id, host, domain FROM matched")
def _(t: Tables) -> DataFrame:
    pages, outlets = page_outlets(t)
    return coverage.match_hosts(pages.select("page_id", "host"), outlets).select("page_id", "host", "domain")


HOSTCOUNT = """, counts AS (SELECT host, count(*) AS articles, CAST(sum(CASE WHEN regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS titled FROM hosts GROUP BY host)"""


@query("host_counts", sql="WITH " + DOMAINS + HOSTCOUNT + "SELECT host, articles, titled FROM counts")
def _(t: Tables) -> DataFrame:
    rows = t.read("pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return coverage.host_counts(rows)


@query("coverage_own_hosts", sql="WITH " + DOMAINS + HOSTCOUNT + """SELECT o.domain, c.host, c.articles FROM outs o JOIN counts c ON regexp_extract(c.host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) = o.domain""")
def _(t: Tables) -> DataFrame:
    rows = t.read("pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return coverage.own_hosts(page_outlets(t)[1], coverage.host_counts(rows))


@query("coverage_report", sql="WITH " + DOMAINS + HOSTCOUNT + """, own AS (SELECT o.domain, CAST(sum(c.articles) AS BIGINT) AS carried, CAST(sum(c.titled) AS BIGINT) AS with_titles
  FROM outs o JOIN counts c ON regexp_extract(c.host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) = o.domain GROUP BY o.domain)
, free AS (SELECT c.host, c.articles, unnest(string_split(c.host, '.')) AS label FROM counts c WHERE regexp_extract(c.host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) NOT IN (SELECT domain FROM outs))
, labels AS (SELECT domain, unnest(list_filter(list_slice(string_split(domain, '.'), 1, -2), lambda p: length(p) >= 4 AND p NOT IN ('edition', 'news'))) AS label FROM outs)
, pairs AS (SELECT DISTINCT l.domain, f.host, f.articles FROM labels l JOIN free f ON f.label = l.label)
, top AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY articles DESC, host) AS n FROM pairs)
, sim AS (SELECT domain, string_agg(host || '=' || articles, ' ' ORDER BY n) AS lookalikes FROM top WHERE n <= 5 GROUP BY domain)
SELECT o.domain, coalesce(carried, 0) AS carried, coalesce(with_titles, 0) AS with_titles, coalesce(lookalikes, '') AS lookalikes,
CASE WHEN carried > 0 THEN 'carried' WHEN lookalikes IS NOT NULL THEN 'check look-alikes' ELSE 'not carried' END AS verdict
FROM outs o LEFT JOIN own USING (domain) LEFT JOIN sim USING (domain)""")
def _(t: Tables) -> DataFrame:
    rows = t.read("pages").select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    _, outlets = page_outlets(t)
    stored = outlets.select("domain", F.lit(0).alias("stored_7d"))
    got = coverage.report(outlets.withColumn("display_name", F.col("domain")), coverage.host_counts(rows), stored)
    pair = lambda s: F.concat(s["host"], F.lit("="), s["articles"].cast("string"))
    return got.select("domain", "carried", "with_titles", F.coalesce(F.array_join(F.transform("lookalikes", pair), " "), F.lit("")).alias("lookalikes"), "verdict")


CALENDAR = """WITH span AS (SELECT date_trunc('hour', min(ts)) AS lo, min(ts) AS a, max(ts) AS b FROM events)
, cal AS (SELECT slot FROM (SELECT unnest(generate_series(lo, b, INTERVAL '15' MINUTE)) AS slot, a FROM span) WHERE slot > a)
, got AS (SELECT DISTINCT time_bucket(INTERVAL '15' MINUTE, ts - INTERVAL '1' MICROSECOND) + INTERVAL '15' MINUTE AS slot FROM events)"""


def calendar(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return slots.slots_over(t.read("events").agg(F.min(at).alias("start"), F.max(at).alias("end")))


@query("slot_calendar", sql=CALENDAR + """SELECT slot, stream, strftime(slot, '%Y%m%d%H%M%S') || stream || '.gkg.csv.zip' AS file FROM cal, (VALUES (''), ('.translation')) s(stream)""")
def _(t: Tables) -> DataFrame:
    return slots.slot_files(calendar(t))


@query("slot_gaps", sql=CALENDAR + """, f AS (SELECT c.slot, g.slot IS NOT NULL AS got, sum(CAST(g.slot IS NOT NULL AS INT)) OVER (ORDER BY c.slot) AS run FROM cal c LEFT JOIN got g ON g.slot = c.slot)
, r AS (SELECT *, sum(CAST(NOT got AS INT)) OVER (PARTITION BY run ORDER BY slot) AS gap FROM f)
, s AS (SELECT *, coalesce(max(CAST(gap >= 4 AS INT)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM r)
, l AS (SELECT *, coalesce(max(CAST(got AND NOT stopped AS INT)) OVER (ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS later FROM s)
SELECT slot, CASE WHEN stopped THEN 'not tried' WHEN got THEN 'read' WHEN later THEN 'skipped' ELSE 'pending' END AS state FROM l""")
def _(t: Tables) -> DataFrame:
    present = t.read("events").select(slots.slot_of(F.col("ts").cast("timestamp")).alias("slot"))
    return slots.classify_gaps(calendar(t), present)


ROBOT_RULES = """rules AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, pattern, allow, regex FROM pages,
 (VALUES ('/en/', FALSE, '^/en/'), ('/*?', FALSE, '^/.*\\?'), ('/en/*5$', TRUE, '^/en/.*5$'), ('/fr', TRUE, '^/fr'), ('/de/', FALSE, '^/de/')) v(pattern, allow, regex)
 WHERE (length(pattern) + length(regexp_extract(url, '://([^/?#:]+)', 1))) % 2 = 0)
, targets AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages)"""


@query("crawl_verdicts", sql="WITH " + ROBOT_RULES + """, hit AS (SELECT t.page_id, r.allow, row_number() OVER (PARTITION BY t.page_id ORDER BY length(r.pattern) DESC, r.allow DESC) AS n
  FROM targets t JOIN rules r ON r.host = t.host AND regexp_matches(t.path, r.regex))
SELECT t.page_id, CASE WHEN coalesce(h.allow, TRUE) THEN 'allowed' ELSE 'disallowed' END AS verdict FROM targets t LEFT JOIN hit h ON h.page_id = t.page_id AND h.n = 1""")
def _(t: Tables) -> DataFrame:
    listed = [("/en/", False), ("/*?", False), ("/en/*5$", True), ("/fr", True), ("/de/", False)]
    rule = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in listed])).alias("r")
    hosts = t.read("pages").select(url.host_of(F.col("url")).alias("host")).distinct()
    rules = hosts.select("host", rule).select("host", "r.*").where((F.length("pattern") + F.length("host")) % 2 == 0)
    rules = rules.withColumn("length", F.length("pattern"))
    return robots.verdicts(t.read("pages").select("page_id", "url"), rules).select("page_id", "verdict")
