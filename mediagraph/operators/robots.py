"""Crawl permission: rules joined to URLs by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import url

AGENT = "mediagraph"


def parse_rules(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, pattern, allow, length) from robots files (host, body): the groups naming our agent, else those for `*`.

    A file is cut into lines with `posexplode`; groups come from windows over one file's lines. A run of user-agent
    lines after rules starts a new group.
    """
    lines = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw"))
    bare = F.trim(F.regexp_extract("raw", "^([^#]*)", 1))
    parsed = lines.select("host", "pos", F.lower(F.trim(F.regexp_extract(bare, "^([^:]*):", 1))).alias("key"),
                          F.trim(F.regexp_extract(bare, "^[^:]*:(.*)$", 1)).alias("value"), bare.contains(":").alias("_ok"))
    parsed = parsed.where(F.col("_ok") & F.col("key").isin("user-agent", "allow", "disallow"))
    # An empty rule says nothing, and rules before any user-agent belong to nobody.
    parsed = parsed.where((F.col("key") == "user-agent") | (F.col("value") != ""))
    file = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(file), F.lit("")) != "user-agent")
    grouped = parsed.withColumn("_open", opens.cast("int")).withColumn("grp", F.sum("_open").over(file)).where(F.col("grp") > 0)
    agents = grouped.where(F.col("key") == "user-agent").groupBy("host", "grp").agg(
        F.max((F.lower("value") == agent).cast("int")).alias("mine"), F.max((F.col("value") == "*").cast("int")).alias("anyone"))
    chosen = agents.withColumn("_named", F.max("mine").over(Window.partitionBy("host"))).where(
        F.when(F.col("_named") == 1, F.col("mine") == 1).otherwise(F.col("anyone") == 1)).select("host", "grp")
    rules = grouped.where(F.col("key") != "user-agent").join(chosen, ["host", "grp"])
    return rules.select("host", F.col("value").alias("pattern"), (F.col("key") == "allow").alias("allow"), F.length("value").alias("length"))


def as_regex(pattern: Column) -> Column:
    """`*` matches anything, a closing `$` anchors; everything else is literal."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    literal = F.array_join(F.transform(F.split(body, r"\*"), lambda p: F.regexp_replace(p, r"([\\^$.|?*+()\[\]{}])", r"\\$1")), ".*")
    return F.concat(F.lit("^"), literal, F.when(anchored, "$").otherwise(""))


def path_and_query(c: Column) -> Column:
    path, query = url.path_of(c), url.query_of(c)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def wild(pattern: Column) -> Column:
    """Whether a pattern is more than a prefix."""
    return pattern.contains("*") | pattern.endswith("$")


def prefix_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, _path, best) from plain prefixes: the rules are a table keyed by (host, prefix), and a path asks for its beginnings of the lengths that
    its host's rules have. Nothing gathers a host's rules: only their distinct lengths, which paths bound."""
    table = rules.groupBy("host", F.col("pattern").alias("_prefix")).agg(F.max("allow").alias("allow"))
    lengths = table.groupBy("host").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    asked = paths.join(lengths, "host").select("host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n"))
    asked = asked.withColumn("_prefix", F.substr("_path", F.lit(1), F.col("_n")))
    return asked.join(table, ["host", "_prefix"]).groupBy("host", "_path").agg(F.max(F.struct(F.col("_n").alias("length"), "allow")).alias("best"))


def wild_hits(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, _path, best) from patterns with wildcards or an anchor, which are few: those of a host are tried one by one on each of its paths."""
    packed = rules.groupBy("host").agg(F.collect_list(F.struct("length", "allow", as_regex(F.col("pattern")).alias("regex"))).alias("_rules"))
    hits = F.filter("_rules", lambda r: F.rlike(F.col("_path"), r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))))
    return paths.join(packed, "host").select("host", "_path", best.alias("best")).where(F.col("best").isNotNull())


def verdicts(urls: DataFrame, rules: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """URLs with a `verdict`: the longest matching rule wins, Allow on ties. `fetches` (host, status) says how reading
    the robots file went: 4xx means no rules, 5xx or no answer means unavailable.

    Each distinct path of a host is judged once, and only paths that some rule matches are joined back.
    """
    rows = urls.withColumn("host", url.host_of(F.col("url"))).withColumn("_path", path_and_query(F.col("url")))
    paths = rows.select("host", "_path").distinct()
    best = prefix_hits(paths, rules.where(~wild(F.col("pattern")))).unionByName(wild_hits(paths, rules.where(wild(F.col("pattern")))))
    barred = best.groupBy("host", "_path").agg(F.max("best").alias("_best")).where(~F.col("_best.allow")).select("host", "_path", F.lit(True).alias("_barred"))
    rows = rows.join(barred, ["host", "_path"], "left")
    allowed = (F.col("_path") == "/robots.txt") | F.col("_barred").isNull()
    verdict = F.when(allowed, "allowed").otherwise("disallowed")
    if fetches is not None:
        rows = rows.join(fetches.select("host", "status"), "host", "left")
        verdict = (F.when(F.col("status").isNull() | (F.col("status") >= 500), "unavailable")
                   .when(F.col("status").between(400, 499), "allowed").otherwise(verdict))
    return rows.withColumn("verdict", verdict).drop("_barred", "_path")
