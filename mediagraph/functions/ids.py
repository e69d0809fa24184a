"""Identifiers, stakes, kinds, periods and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import fixed


def is_qid(c: Column) -> Column:
    return c.rlike(r"^Q[1-9]\d{0,11}$")


def normalize_id(scheme: Column, value: Column) -> Column:
    """A registry identifier in its standard form, or null when it is not one."""
    v = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    digits = F.replace(v, F.lit("-"), F.lit(""))
    return (
        F.when((scheme == "sec_cik") & v.rlike(r"^\d{1,10}$"), F.lpad(v, 10, "0"))
        .when((scheme == "us_ein") & v.rlike(r"^\d{2}-?\d{7}$"), F.concat_ws("-", F.left(digits, F.lit(2)), F.substr(digits, F.lit(3))))
        .when((scheme == "ca_bn") & v.rlike(r"^\d{9}RR\d{4}$"), v)
    )


def registry_url(scheme: Column, value: Column) -> Column:
    """The public page of an identifier."""
    v = normalize_id(scheme, value)
    page = lambda template, x: F.concat(F.lit(template.split("{}")[0]), x, F.lit(template.split("{}")[1]))
    return (
        F.when(scheme == "sec_cik", page(fixed.COMPANY_PAGE, v))
        .when(scheme == "us_ein", page(fixed.NONPROFIT_PAGE, F.replace(v, F.lit("-"), F.lit(""))))
        .when(scheme == "ca_bn", page(fixed.CHARITY_PAGE, v))
    )


def stake_fraction(x: Column) -> Column:
    """A stated stake as a fraction: some statements give percent."""
    return F.when((x > 0) & (x <= 1), x).when((x > 1) & (x <= 100), x / 100)


def first_stake(amounts: Column) -> Column:
    """The first usable amount of several qualifiers."""
    return F.get(F.filter(F.transform(amounts, stake_fraction), lambda s: s.isNotNull()), F.lit(0))


def owner_type(kinds: Column) -> Column:
    """The one kind that says what an owner is in ownership terms."""
    # A lambda of two parameters would get the position as its second: the word is bound by the outer function.
    holding = lambda word: F.filter(kinds, lambda k: F.lower(k).contains(word))
    named = [F.get(holding(w), F.lit(0)) for w in fixed.OWNERSHIP_FORMS]
    return F.when(F.array_contains(kinds, "human"), "person").otherwise(F.coalesce(*named, F.get(kinds, F.lit(0)), F.lit("")))


def kinds_of(text: Column) -> Column:
    """'; '-joined kinds as an array."""
    return F.filter(F.transform(F.split(text, ";"), lambda k: F.trim(k)), lambda k: k != "")


def period_year(c: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(c, r"(\d{4})", 1), F.lit("9999")).cast("int"), F.lit(0))


def kind_position(kind: Column) -> Column:
    position = F.array_position(F.array(*map(F.lit, fixed.FUNDING_KINDS)), kind)
    return F.when(position > 0, position - 1).otherwise(9).cast("int")


def place_codes(code: str) -> list[str]:
    """The country codes a filter value stands for: a group's members, or itself."""
    return list(fixed.EU_MEMBERS) if code == fixed.EU_CODE else [code]


def place_name(code: Column, name: Column) -> Column:
    """Display name given the (left-joined) name of a `places` dimension: groups first, unknown codes as they are."""
    return F.when(code == fixed.EU_CODE, fixed.EU_NAME).otherwise(F.coalesce(name, code))


def with_place_names(df: DataFrame, places: DataFrame, code: str = "country") -> DataFrame:
    """`places` (code, name) is the caller's table of FIPS 10-4 country names."""
    dim = places.select(F.col("code").alias(code), F.col("name").alias("_place"))
    return df.join(dim, code, "left").withColumn("place", place_name(F.col(code), F.col("_place"))).drop("_place")


def used_themes(counts: Column, used: list[str]) -> Column:
    """Theme counts kept for an article: only themes some tag uses, mentioned at least once."""
    return F.map_filter(counts, lambda k, v: k.isin(used) & (v > 0))


def encode_themes(counts: Column) -> Column:
    """`NAME:count` text, in name order."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")


def decode_themes(text: Column) -> Column:
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p.rlike(r"^.+:\d+$"))
    pairs = F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"^(.+):\d+$", 1).alias("key"), F.regexp_extract(p, r":(\d+)$", 1).cast("bigint").alias("value")))
    return F.map_from_entries(pairs)
