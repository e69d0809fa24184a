"""How the test tables stand in for the engine's tables, as DataFrames and as the same views in ANSI SQL."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.operators.closure import Ownership
from mediagraph.operators.feedstore import FeedStore
from mediagraph.operators.textindex import TextIndex
from mediagraph.session import cut_folder, use_utc

SQL = {
    "b_outlets": """SELECT s_suppkey AS outlet_id, concat('s', CAST(s_suppkey AS STRING), '.example.com') AS domain,
  s_name AS display_name, s_nationkey AS country, s_suppkey % 10 <> 9 AS active,
  CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 100 + s_suppkey * 3 END AS entity_id FROM supplier""",
    "b_articles": """SELECT event_id AS article_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % (SELECT count(*) FROM supplier) END AS outlet_id, event_type AS tag, ts AS seen,
  CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL '5' MINUTE WHEN 2 THEN ts - INTERVAL '240' MINUTE ELSE NULL END AS stated,
  ts + INTERVAL '2' MINUTE AS retrieved,
  CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL '7' MINUTE ELSE NULL END AS checked FROM events""",
    "b_mentions": """SELECT l.l_orderkey AS article_id, l.l_linenumber AS pos, s.s_nationkey AS country, p.p_brand AS name,
  p.p_type AS theme, l.l_suppkey AS entity_id, l.l_partkey AS part_id FROM lineitem l
  JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "b_docs": """SELECT doc_id, doc_id AS article_id, source AS outlet, lang, text AS title, concat(source, ' ', lang) AS about,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '5' MINUTE * doc_id AS seen FROM documents""",
    "b_headlines": """SELECT doc_id * 1000000 + pos AS article_id, source AS outlet, title,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '5' MINUTE * doc_id + INTERVAL '1' SECOND * pos AS seen
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS title, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)""",
    "b_edges": """SELECT c_custkey AS child, CAST(floor((c_custkey - 1) / 4.0) AS BIGINT) AS parent,
  CASE WHEN c_custkey % 3 = 0 THEN 'parent_org' ELSE 'owned_by' END AS relation,
  CASE WHEN c_custkey % 7 = 0 THEN 0.3 ELSE NULL END AS share,
  CASE WHEN c_custkey % 13 = 0 THEN 'set_aside' ELSE 'wikidata' END AS source FROM customer WHERE c_custkey > 0
UNION ALL SELECT c_custkey, CAST(floor(c_custkey / 11.0) AS BIGINT), 'owned_by', NULL, 'manual' FROM customer WHERE c_custkey % 11 = 0 AND c_custkey > 0
UNION ALL SELECT c_custkey, 14, 'owned_by', NULL, 'manual' FROM customer WHERE c_custkey = 3""",
    "b_entities": """SELECT c_custkey AS entity_id, concat('Q', CAST(c_custkey + 1 AS STRING)) AS qid, c_name AS name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'public company' ELSE lower(c_mktsegment) END AS kind, c_nationkey AS country FROM customer""",
    "b_funding": """SELECT o_orderkey AS record_id, o_custkey AS entity_id, o_orderpriority AS kind, concat('Order ', o_orderstatus) AS label,
  o_totalprice AS amount, concat('FY ', CAST(year(o_orderdate) AS STRING)) AS period FROM orders""",
    "b_pages": """SELECT page_id, url, replace(html, '</head>', concat('<meta property="article:published_time" content="2024-01-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'),
  'T10:00:00', CASE page_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '-0500' WHEN 2 THEN '' ELSE '+02:00' END,
  '"><meta name="pubdate" content="2024-01-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'),
  CASE WHEN page_id % 6 = 0 THEN 'T14:00:00Z' ELSE 'T10:20:00Z' END, '"></head>')) AS html FROM pages""",
}


def with_views(*names: str) -> str:
    """`WITH RECURSIVE` prefix defining the named views; the query text follows after a comma or SELECT."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


class Tables:
    """The driver's parquet tables and the bindings over them, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = use_utc(spark)
        self.folder = folder

    @functools.cache  # noqa: B019 - a Tables lives as long as one query
    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def outlets(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            key.alias("outlet_id"), F.concat(F.lit("s"), key.cast("string"), F.lit(".example.com")).alias("domain"),
            F.col("s_name").alias("display_name"), F.col("s_nationkey").alias("country"), (key % 10 != 9).alias("active"),
            F.when(key % 5 != 4, 100 + key * 3).alias("entity_id"))

    @property
    def articles(self) -> DataFrame:
        ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
        user, outlets = F.col("user_id"), self.read("supplier").agg(F.count("*")).scalar()  # a third of the articles are one outlet's
        mins = lambda m: F.expr(f"INTERVAL '{m}' MINUTE")
        return self.read("events").select(
            n.alias("article_id"), F.when(user % 3 == 0, 0).otherwise(user % outlets).alias("outlet_id"), F.col("event_type").alias("tag"), ts.alias("seen"),
            F.when(n % 5 == 0, ts).when(n % 5 == 1, ts - mins(5)).when(n % 5 == 2, ts - mins(240)).alias("stated"),
            (ts + mins(2)).alias("retrieved"), F.when(n % 3 != 0, ts + mins(7)).alias("checked"))

    @property
    def mentions(self) -> DataFrame:
        line = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
        supplier = self.read("supplier").select("s_suppkey", "s_nationkey")
        part = self.read("part").select("p_partkey", "p_brand", "p_type")
        rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
        return rows.select(
            F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("pos"), F.col("s_nationkey").alias("country"),
            F.col("p_brand").alias("name"), F.col("p_type").alias("theme"), F.col("l_suppkey").alias("entity_id"),
            F.col("l_partkey").alias("part_id"))

    @property
    def docs(self) -> DataFrame:
        at = F.timestamp_add("MINUTE", 5 * F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
        return self.read("documents").select(
            "doc_id", F.col("doc_id").alias("article_id"), F.col("source").alias("outlet"), "lang", F.col("text").alias("title"),
            F.concat_ws(" ", "source", "lang").alias("about"), at.alias("seen"))

    @property
    def headlines(self) -> DataFrame:
        """Every line of every document is a headline of its source."""
        lines = self.read("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "title"))
        at = F.timestamp_add("SECOND", 300 * F.col("doc_id").cast("int") + F.col("pos"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
        return lines.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("article_id"), F.col("source").alias("outlet"), "title", at.alias("seen"))

    @property
    def edges(self) -> DataFrame:
        key = F.col("c_custkey")
        customer = self.read("customer").select("c_custkey")
        none = F.lit(None).cast("double")
        tree = customer.where(key > 0).select(
            key.alias("child"), F.floor((key - 1) / 4.0).cast("bigint").alias("parent"),
            F.when(key % 3 == 0, "parent_org").otherwise("owned_by").alias("relation"),
            F.when(key % 7 == 0, F.lit(0.3)).alias("share"), F.when(key % 13 == 0, "set_aside").otherwise("wikidata").alias("source"))
        added = customer.where((key % 11 == 0) & (key > 0)).select(
            key.alias("child"), F.floor(key / 11.0).cast("bigint").alias("parent"), F.lit("owned_by").alias("relation"),
            none.alias("share"), F.lit("manual").alias("source"))
        loop = customer.where(key == 3).select(
            key.alias("child"), F.lit(14).cast("bigint").alias("parent"), F.lit("owned_by").alias("relation"), none.alias("share"),
            F.lit("manual").alias("source"))
        return tree.unionByName(added).unionByName(loop)

    @property
    def entities(self) -> DataFrame:
        kind = F.when(F.col("c_mktsegment") == "MACHINERY", "public company").otherwise(F.lower("c_mktsegment"))
        return self.read("customer").select(
            F.col("c_custkey").alias("entity_id"), F.concat(F.lit("Q"), (F.col("c_custkey") + 1).cast("string")).alias("qid"),
            F.col("c_name").alias("name"), kind.alias("kind"), F.array(kind).alias("kinds"), F.col("c_nationkey").alias("country"))

    @functools.cached_property
    def own(self) -> Ownership:
        """The application's stored closures of these edges."""
        return Ownership(self.spark, hashlib.md5(self.folder.encode()).hexdigest(), self.edges, self.entities)

    @functools.cached_property
    def index(self) -> TextIndex:
        """The application's stored index of `docs`, filled when it is first asked for."""
        index = TextIndex(self.spark, f"{cut_folder(self.spark)}/index-{hashlib.md5(self.folder.encode()).hexdigest()}")
        index.add(self.docs, 0)
        return index

    @functools.cached_property
    def feed(self) -> FeedStore:
        """The application's stored feed of `articles`, filled when it is first asked for."""
        rows = self.articles.withColumn("title", F.col("tag")).withColumn("about", F.lit(""))
        store = FeedStore(self.spark, f"{cut_folder(self.spark)}/feed-{hashlib.md5(self.folder.encode()).hexdigest()}", rows.schema)
        store.add(rows, 0)
        return store

    @property
    def funding(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("kind"),
            F.concat(F.lit("Order "), "o_orderstatus").alias("label"), F.col("o_totalprice").alias("amount"),
            F.concat(F.lit("FY "), F.year("o_orderdate").cast("string")).alias("period"))

    @property
    def pages(self) -> DataFrame:
        n = F.col("page_id")
        day = F.lpad((1 + n % 28).cast("string"), 2, "0")
        zone = F.when(n % 4 == 0, "Z").when(n % 4 == 1, "-0500").when(n % 4 == 2, "").otherwise("+02:00")
        clock = F.when(n % 6 == 0, "T14:00:00Z").otherwise("T10:20:00Z")
        dates = F.concat(
            F.lit('<meta property="article:published_time" content="2024-01-'), day, F.lit("T10:00:00"), zone,
            F.lit('"><meta name="pubdate" content="2024-01-'), day, clock, F.lit('"></head>'))
        return self.read("pages").select("page_id", "url", F.replace("html", F.lit("</head>"), dates).alias("html"))
