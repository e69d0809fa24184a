"""Entity dumps and website match results from a knowledge graph, parsed on the JVM.

A statement's value is kept as text: an item, a time or a quantity is an object inside it, a website is a plain string.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import fixed, ids, url, when

TEXT = "struct<language:string,value:string>"
SNAK = "struct<snaktype:string,datavalue:struct<value:string>>"
STATEMENT = f"struct<rank:string,mainsnak:{SNAK},qualifiers:map<string,array<{SNAK}>>>"
ENTITY = (f"struct<id:string,missing:string,labels:map<string,{TEXT}>,descriptions:map<string,{TEXT}>,"
          f"aliases:map<string,array<{TEXT}>>,claims:map<string,array<{STATEMENT}>>>")


def _time(snak: Column) -> tuple[Column, Column]:
    value = snak["datavalue"]["value"]
    return F.get_json_object(value, "$.time"), F.get_json_object(value, "$.precision").cast("int")


def _ended(statement: Column, now: datetime) -> Column:
    """Ended by now, or at an unknown time."""
    ends = F.coalesce(F.try_element_at(statement["qualifiers"], F.lit(fixed.P_END)), F.array().cast(f"array<{SNAK}>"))
    past = lambda q: F.coalesce((q["snaktype"] == "value") & (when.partial_date(*_time(q)) <= F.lit(now)), F.lit(False))
    return F.exists(ends, lambda q: (q["snaktype"] == "somevalue") | past(q))


def current_statements(claims: Column, prop: str, now: datetime) -> Column:
    """A property's statements in force: as `ownership.best_statements`, inside one entity's record."""
    listed = F.coalesce(F.try_element_at(claims, F.lit(prop)), F.array().cast(f"array<{STATEMENT}>"))
    usable = F.filter(listed, lambda s: (F.coalesce(s["rank"], F.lit("")) != "deprecated") & (s["mainsnak"]["snaktype"] == "value"))
    preferred = F.filter(usable, lambda s: s["rank"] == "preferred")
    best = F.when(F.size(preferred) > 0, preferred).otherwise(usable)
    return F.filter(best, lambda s: ~_ended(s, now))


def _items(statements: Column) -> Column:
    found = F.transform(statements, lambda s: F.get_json_object(s["mainsnak"]["datavalue"]["value"], "$.id"))
    return F.array_distinct(F.filter(found, lambda q: F.coalesce(ids.is_qid(q), F.lit(False))))


def _strings(statements: Column) -> Column:
    found = F.transform(statements, lambda s: F.trim(s["mainsnak"]["datavalue"]["value"]))
    return F.array_distinct(F.filter(found, lambda v: F.coalesce(v != "", F.lit(False))))


def _qualifiers(statement: Column, prop: str) -> Column:
    return F.coalesce(F.try_element_at(statement["qualifiers"], F.lit(prop)), F.array().cast(f"array<{SNAK}>"))


def _parents(claims: Column, prop: str, relation: str, own: Column, now: datetime) -> Column:
    def claim(s: Column) -> Column:
        stakes = F.transform(_qualifiers(s, fixed.P_SHARE), lambda q: F.get_json_object(q["datavalue"]["value"], "$.amount").try_cast("double"))
        starts = F.filter(_qualifiers(s, fixed.P_START), lambda q: q["snaktype"] == "value")
        shown = F.filter(F.transform(starts, lambda q: when.partial_date_text(*_time(q))), lambda d: d.isNotNull())
        return F.struct(
            F.get_json_object(s["mainsnak"]["datavalue"]["value"], "$.id").alias("qid"), F.lit(relation).alias("relation"), F.lit(prop).alias("prop"),
            ids.first_stake(stakes).alias("share"), F.try_element_at(shown, F.lit(-1)).alias("start"))

    listed = F.transform(current_statements(claims, prop, now), claim)
    return F.filter(listed, lambda p: F.coalesce(ids.is_qid(p["qid"]) & (p["qid"] != own), F.lit(False)))


def explode_bodies(bodies: DataFrame) -> DataFrame:
    """(e) one entity per row, from dump lines or from responses holding a map of entities."""
    parsed = bodies.select(F.from_json("body", f"struct<id:string,entities:map<string,{ENTITY}>>").alias("r"), F.from_json("body", ENTITY).alias("e"))
    many = F.coalesce(F.map_values("r.entities"), F.array().cast(f"array<{ENTITY}>"))
    return parsed.select(F.explode(F.when(F.col("e.id").isNotNull(), F.array("e")).otherwise(many)).alias("e"))


def scan_entities(bodies: DataFrame, now: datetime) -> DataFrame:
    """One row per entity: qid, label, description, aliases, instance_of, country, websites, website, logo, died, parents,
    identifiers. People have no owners; an owner that is the entity itself is dropped."""
    rows = explode_bodies(bodies).where(ids.is_qid(F.col("e.id")) & F.col("e.missing").isNull())
    claims, qid = F.col("e.claims"), F.col("e.id")
    labels = F.coalesce(F.col("e.labels"), F.create_map().cast(f"map<string,{TEXT}>"))
    text = lambda m, lang: F.try_element_at(m, F.lit(lang))["value"]
    label = F.coalesce(*[text(labels, lang) for lang in ("en", "fr", "mul")], F.get(F.map_values(labels), F.lit(0))["value"], qid)
    named = F.transform(F.map_values(labels), lambda v: v["value"])
    others = F.transform(F.flatten(F.map_values(F.coalesce(F.col("e.aliases"), F.create_map().cast(f"map<string,array<{TEXT}>>")))), lambda v: v["value"])
    stage = rows.select(
        qid.alias("qid"), label.alias("label"), F.coalesce(text(F.col("e.descriptions"), "en"), text(F.col("e.descriptions"), "fr"), F.lit("")).alias("description"),
        F.concat(named, others).alias("_names"), _items(current_statements(claims, fixed.P_INSTANCE, now)).alias("instance_of"),
        _items(current_statements(claims, fixed.P_COUNTRY, now)).alias("country"),
        F.filter(_strings(current_statements(claims, fixed.P_WEBSITE, now)), url.is_http_url).alias("websites"),
        F.get(_strings(current_statements(claims, fixed.P_LOGO, now)), F.lit(0)).alias("logo"),
        F.transform(current_statements(claims, fixed.P_DIED, now), lambda s: F.struct(
            when.partial_date(*_time(s["mainsnak"])).alias("at"), when.partial_date_text(*_time(s["mainsnak"])).alias("shown"))).alias("_died"),
        F.concat(_parents(claims, fixed.P_OWNED_BY, "owned_by", qid, now), _parents(claims, fixed.P_PARENT_ORG, "parent_org", qid, now)).alias("_parents"),
        _strings(current_statements(claims, fixed.P_CIK, now)).alias("_cik"), _strings(current_statements(claims, fixed.P_EIN, now)).alias("_ein"))
    human = F.array_contains("instance_of", fixed.Q_HUMAN)
    known = F.filter("_names", lambda n: F.coalesce((F.trim(n) != "") & (n != F.col("label")), F.lit(False)))
    number = lambda scheme, c: F.transform(c, lambda v: F.struct(F.lit(scheme).alias("scheme"), v.alias("value")))
    return stage.select(
        "qid", "label", "description", F.array_distinct(F.transform(known, lambda n: F.trim(n))).alias("aliases"), "instance_of", "country", "websites",
        F.get("websites", F.lit(0)).alias("website"), "logo",
        F.when(human, F.get(F.filter("_died", lambda d: F.coalesce(d["at"] <= F.lit(now), F.lit(False))), F.lit(0))["shown"]).alias("died"),
        F.when(human, F.slice("_parents", 1, 0)).otherwise(F.col("_parents")).alias("parents"),
        F.concat(number("sec_cik", F.col("_cik")), number("us_ein", F.col("_ein"))).alias("identifiers"))


def claims_of(entities: DataFrame) -> DataFrame:
    """(child, parent, relation, share, start, source_url) of scanned entities."""
    rows = entities.select(F.col("qid").alias("child"), F.explode("parents").alias("p"))
    link = F.concat(F.lit("https://www.wikidata.org/wiki/"), "child", F.lit("#"), "p.prop")
    return rows.select("child", F.col("p.qid").alias("parent"), "p.relation", "p.share", "p.start", link.alias("source_url"))


BINDING = "struct<value:string>"
MATCHES = f"struct<results:struct<bindings:array<struct<item:{BINDING},site:{BINDING},itemLabel:{BINDING},itemDescription:{BINDING}>>>>"


def scan_match_results(bodies: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, qid, label, description, website, nth): items listing an outlet's website, once each, by item number."""
    rows = bodies.select(F.posexplode(F.from_json("body", MATCHES)["results"]["bindings"]).alias("pos", "b"))
    parsed = rows.select(
        "pos", F.regexp_extract("b.item.value", "([^/]*)$", 1).alias("qid"), F.col("b.site.value").alias("website"),
        url.without_www(url.host_of(F.col("b.site.value"))).alias("domain"), F.col("b.itemLabel.value").alias("label"),
        F.coalesce("b.itemDescription.value", F.lit("")).alias("description"))
    good = parsed.where(ids.is_qid(F.col("qid"))).join(domains.select("domain").distinct(), "domain", "left_semi")
    first = good.groupBy("domain", "qid").agg(F.min_by(F.struct("label", "description", "website"), "pos").alias("v"))
    return first.select("domain", "qid", F.coalesce("v.label", "qid").alias("label"), "v.description", "v.website", F.substring("qid", 2, 12).cast("bigint").alias("nth"))
