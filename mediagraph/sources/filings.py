"""Registry payloads as funding rows: company filings, nonprofit returns, charity registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import fixed, ids

COMPANY = """struct<filings:struct<recent:struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,
filingDate:array<string>,reportDate:array<string>>>>"""
NONPROFIT_YEARS = 3


def _money() -> list[Column]:
    return [F.lit(None).cast("double").alias("amount"), F.lit(None).cast("string").alias("currency")]


def _fill(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def company_filings(payloads: DataFrame) -> DataFrame:
    """Rows of (entity_id, value, body): always a link to all filings, and the newest annual report if its number and
    document are well formed."""
    rows = payloads.withColumn("cik", ids.normalize_id(F.lit("sec_cik"), F.col("value"))).where(F.col("cik").isNotNull())
    keys = [c for c in payloads.columns if c != "body"]
    everything = rows.select(
        *keys, F.lit("public_filing").alias("kind"), F.lit("SEC filings (all)").alias("label"), *_money(),
        F.lit(None).cast("string").alias("period"), F.lit("sec_edgar").alias("source"), _fill(fixed.COMPANY_PAGE, F.col("cik")).alias("source_url"))
    recent = F.from_json("body", COMPANY)["filings"]["recent"]
    parts = rows.select(*keys, "cik", recent.alias("r"))
    zipped = F.arrays_zip(
        F.col("r.form").alias("form"), F.col("r.accessionNumber").alias("number"), F.col("r.primaryDocument").alias("document"),
        F.col("r.filingDate").alias("filed"), F.col("r.reportDate").alias("period"))
    # Lists come newest first: the first annual form is the latest.
    annual = F.get(F.filter(zipped, lambda f: f["form"].isin(*fixed.ANNUAL_FORMS)), F.lit(0))
    latest = parts.select(*keys, "cik", annual.alias("f")).where(
        F.col("f").isNotNull() & F.col("f.number").rlike(r"^[\d-]+$") & F.col("f.document").rlike(r"^[\p{L}\p{N}_.\-]+$") & F.col("f.filed").isNotNull())
    report = latest.select(
        *keys, F.lit("public_filing").alias("kind"),
        F.concat(F.lit("Latest annual report (Form "), "f.form", F.lit("), filed "), "f.filed").alias("label"), *_money(),
        F.coalesce(F.when(F.col("f.period") != "", F.col("f.period")), F.col("f.filed")).alias("period"), F.lit("sec_edgar").alias("source"),
        _fill(fixed.COMPANY_DOCUMENT, F.ltrim("cik", F.lit("0")), F.replace("f.number", F.lit("-"), F.lit("")), F.col("f.document")).alias("source_url"))
    return everything.unionByName(report)


def nonprofit_filings(payloads: DataFrame) -> DataFrame:
    """Rows of (entity_id, value, body): total revenue and contributions of the three newest tax years that are whole
    numbers, where the amount is a number of zero or more."""
    rows = payloads.withColumn("ein", ids.normalize_id(F.lit("us_ein"), F.col("value"))).where(F.col("ein").isNotNull())
    keys = [c for c in payloads.columns if c != "body"]
    # Values are read as text, so a quoted year must be told from a number by the raw JSON.
    raw = F.expr("try_variant_get(try_parse_json(body), '$.filings_with_data', 'array<variant>')")
    items = rows.select(*keys, "ein", F.posexplode(raw).alias("pos", "f"))
    kind = lambda p: F.expr(f"schema_of_variant(variant_get(f, '$.{p}'))")
    number = lambda p: F.when(kind(p).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.expr(f"try_variant_get(f, '$.{p}', 'double')"))
    year = F.when(kind("tax_prd_yr") == "BIGINT", F.expr("try_variant_get(f, '$.tax_prd_yr', 'bigint')"))
    filed = items.select(*keys, "ein", "pos", year.alias("year"), number("totrevenue").alias("revenue"), number("totcntrbgftgrnt").alias("grants"))
    return nonprofit_rows(filed.where(F.col("year").isNotNull()), keys)


def nonprofit_rows(filed: DataFrame, keys: list[str]) -> DataFrame:
    """Newest three years of (keys, ein, pos, year, revenue, grants), unpivoted."""
    w = Window.partitionBy(*keys).orderBy(F.desc("year"), "pos")
    newest = filed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= NONPROFIT_YEARS)
    pair = F.explode(F.array(
        F.struct(F.lit("nonprofit_revenue").alias("kind"), F.lit("Total revenue (IRS Form 990)").alias("label"), F.col("revenue").alias("amount")),
        F.struct(F.lit("grant").alias("kind"), F.lit("Contributions, gifts and grants received (Form 990)").alias("label"), F.col("grants").alias("amount")))).alias("x")
    rows = newest.select(*keys, "ein", "year", pair).where(F.col("x.amount") >= 0)
    return rows.select(
        *keys, "x.kind", "x.label", "x.amount", F.lit("USD").alias("currency"), F.concat(F.lit("Tax year "), F.col("year").cast("string")).alias("period"),
        F.lit("propublica").alias("source"), _fill(fixed.NONPROFIT_PAGE, F.replace("ein", F.lit("-"), F.lit(""))).alias("source_url"))


def charity_records(numbers: DataFrame) -> DataFrame:
    """One link row per valid charity business number."""
    rows = numbers.withColumn("bn", ids.normalize_id(F.lit("ca_bn"), F.col("value"))).where(F.col("bn").isNotNull())
    keys = [c for c in numbers.columns]
    return rows.select(
        *keys, F.lit("charity_registration").alias("kind"),
        F.concat(F.lit("Registered charity "), "bn", F.lit(": CRA listing and T3010 returns")).alias("label"), *_money(),
        F.lit(None).cast("string").alias("period"), F.lit("cra").alias("source"), _fill(fixed.CHARITY_PAGE, F.col("bn")).alias("source_url"))
