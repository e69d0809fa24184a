"""JSON article lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import fixed, url, when
from mediagraph.functions import text as tx
from mediagraph.operators import coverage

ITEM = "struct<url:string,title:string,seendate:string,socialimage:string,domain:string,language:string>"
LENIENT = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}


def _items(bodies: DataFrame) -> DataFrame:
    """(source_url, error, items): a body that is not a JSON object holding a list is an error, not an empty list."""
    body = F.trim("body")
    parsed = F.from_json(body, f"struct<articles:array<{ITEM}>,_corrupt_record:string>", {**LENIENT, "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = bodies.select("source_url", body.alias("body"), parsed.alias("p"))
    kind = F.get_json_object("body", "$.articles")
    error = (
        F.when(~F.col("body").startswith("{"), F.concat(F.lit("not JSON: "), F.left("body", F.lit(160))))
        .when(F.col("p._corrupt_record").isNotNull() & kind.isNotNull() & ~kind.startswith("["), "'articles' is not a list")
        .when(F.col("p._corrupt_record").isNotNull(), "malformed JSON"))
    return rows.select("source_url", error.alias("error"), F.coalesce("p.articles", F.array().cast(f"array<{ITEM}>")).alias("items"))


def scan_artlist(bodies: DataFrame, outlets: DataFrame) -> DataFrame:
    """Article records from (source_url, body): valid URL, exact outlet or its subdomain, a headline, a readable time."""
    rows = _items(bodies).where(F.col("error").isNull()).select("source_url", F.posexplode("items").alias("pos", "a"))
    rows = rows.where(url.is_http_url(F.col("a.url"))).withColumn("host", url.host_of(F.col("a.url")))
    ours = coverage.match_hosts(rows, outlets).where(F.col("domain").isNotNull())
    spoken = F.create_map(*[F.lit(v) for pair in fixed.LIST_LANGUAGES.items() for v in pair])
    records = ours.select(
        F.struct(F.col("source_url").alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("line")).alias("arrival"),
        F.col("a.url").alias("url"), tx.clean_title(F.col("a.title")).alias("title"), "domain",
        when.parse_compact_ts(F.col("a.seendate"), "list").alias("seen"), F.try_element_at(spoken, F.lower("a.language")).alias("language"),
        F.when(url.is_http_url(F.col("a.socialimage")), F.col("a.socialimage")).alias("image_url"), "source_url")
    return records.where((F.col("title") != "") & F.col("seen").isNotNull())


def artlist_report(bodies: DataFrame) -> DataFrame:
    """(source_url, error, raw, latest): list length and the newest time among all items, kept or not."""
    stamps = F.transform("items", lambda a: when.parse_compact_ts(a["seendate"], "list"))
    return _items(bodies).select("source_url", "error", F.size("items").alias("raw"), F.array_max(stamps).alias("latest"))
