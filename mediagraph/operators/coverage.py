"""Which outlets a source carries, and under which hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions import fixed, url

MIN_LABEL, LOOKALIKES = 4, 5


def targets(outlets: DataFrame) -> DataFrame:
    """(target, domain): every domain and alias with the outlet's main domain."""
    own = outlets.select(F.col("domain").alias("target"), "domain")
    if "aliases" not in outlets.columns:
        return own
    return own.unionByName(outlets.select(F.explode("aliases").alias("target"), "domain"))


def match_hosts(rows: DataFrame, outlets: DataFrame, host: str = "host") -> DataFrame:
    """Rows with the outlet `domain` their host belongs to (null when none): the host itself or its longest parent.

    Distinct hosts are matched once, however many rows share one; the result joins back on the host.
    """
    hosts = rows.select(F.col(host).alias("_host")).distinct()
    suffixes = hosts.select("_host", F.posexplode(url.parent_domains(F.col("_host"))).alias("_pos", "target"))
    owned = suffixes.join(targets(outlets), "target").groupBy("_host").agg(F.min_by("domain", "_pos").alias("domain"))
    return rows.join(owned, rows[host] == owned["_host"], "left").drop("_host")


def host_counts(pages: DataFrame) -> DataFrame:
    """(host, articles, titled) of web rows (url, title)."""
    rows = pages.withColumn("host", url.host_of(F.col("url"))).where(F.col("host") != "")
    return rows.groupBy("host").agg(F.count("*").alias("articles"), F.count_if(F.coalesce(F.col("title"), F.lit("")) != "").alias("titled"))


def own_hosts(outlets: DataFrame, counts: DataFrame) -> DataFrame:
    """(domain, host, articles): which hosts an outlet is carried under. Rows, not a list per outlet: a blog platform has any number."""
    return match_hosts(counts, outlets).where(F.col("domain").isNotNull()).select("domain", "host", "articles")


def name_labels(domain: Column) -> Column:
    """Distinctive parts of a domain: all labels but the last, four letters or more, general ones aside."""
    labels = F.split(domain, r"\.")
    inner = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.filter(inner, lambda p: (F.length(p) >= MIN_LABEL) & ~p.isin(*fixed.GENERIC_LABELS))


def report(outlets: DataFrame, counts: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per outlet: articles on its own hosts, look-alike hosts nobody claims, stored articles, and a verdict; `place` puts
    problems first. `stored` is (domain, stored_7d). The hosts themselves are `own_hosts`."""
    owned = match_hosts(counts, outlets)
    mine = owned.where(F.col("domain").isNotNull()).groupBy("domain").agg(
        F.sum("articles").alias("carried"), F.sum("titled").alias("with_titles"))
    free = owned.where(F.col("domain").isNull()).select("host", "articles")
    labels = targets(outlets).select("domain", F.explode(name_labels(F.col("target"))).alias("label")).distinct()
    # A look-alike shares a whole label. The pair is made once even when several labels agree.
    pairs = free.select("host", "articles", F.explode(F.array_distinct(F.split("host", r"\."))).alias("label")).join(labels, "label").select(
        "domain", "host", "articles").distinct()
    w = Window.partitionBy("domain").orderBy(F.desc("articles"), "host")
    top = pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LOOKALIKES)
    similar = top.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "host", "articles"))),
                                                    lambda s: F.struct(s["host"].alias("host"), s["articles"].alias("articles"))).alias("lookalikes"))
    rows = outlets.join(mine, "domain", "left").join(similar, "domain", "left").join(stored, "domain", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    state = F.when(zero("carried") > 0, 2).when(F.size("lookalikes") > 0, 1).otherwise(0)
    verdict = F.when(state == 2, "carried").when(state == 1, "check look-alikes").otherwise("not carried")
    order = Window.orderBy(state, F.lower("display_name"))  # the outlet dimension
    return rows.select("domain", "display_name", zero("carried").alias("carried"), zero("with_titles").alias("with_titles"),
                       "lookalikes", zero("stored_7d").alias("stored_7d"), verdict.alias("verdict"), F.row_number().over(order).alias("place"))
