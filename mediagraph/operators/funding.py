"""Funding records: refresh by source, curated rows, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import ids

# Which registry answers for which kind of identifier.
SCHEME_SOURCE = {"sec_cik": "sec_edgar", "us_ein": "propublica", "ca_bn": "cra"}


def _scheme_source():
    pairs = [F.lit(v) for item in SCHEME_SOURCE.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), F.col("scheme"))


def replace_by_source(stored: DataFrame, refreshed: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("entity_id", "source")) -> DataFrame:
    """Rows of every refreshed key are replaced by the new ones; a lookup that failed is not among `refreshed` and keeps
    its old rows."""
    kept = stored.join(refreshed.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new.select(stored.columns))


def without_identifier(stored: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Registry rows whose identifier is gone are dropped; other sources are untouched."""
    backed = identifiers.select("entity_id", _scheme_source().alias("source")).distinct()
    registry = F.col("source").isin(*SCHEME_SOURCE.values())
    return stored.where(~registry).unionByName(stored.where(registry).join(backed, ["entity_id", "source"], "left_semi").select(stored.columns))


def refresh(stored: DataFrame, due: DataFrame, results: DataFrame, identifiers: DataFrame) -> DataFrame:
    """One refresh: `due` identifiers (entity_id, scheme, value, ok) whose lookup went well are replaced by `results`."""
    good = due.where("ok").select("entity_id", _scheme_source().alias("source"))
    return without_identifier(replace_by_source(stored, good, results), identifiers)


def stamp_checked(identifiers: DataFrame, due: DataFrame, now) -> DataFrame:
    done = due.where("ok").select("entity_id", "scheme", "value", F.lit(True).alias("_done"))
    rows = identifiers.join(done, ["entity_id", "scheme", "value"], "left")
    return rows.withColumn("checked", F.when(F.col("_done"), F.lit(now)).otherwise(F.col("checked"))).drop("_done")


def attach_curated(rows: DataFrame, entities: DataFrame, outlets: DataFrame) -> DataFrame:
    """Curated rows with the `entity_id` they belong to: by item id when given, else through the outlet. Null when neither is
    known (counted as skipped)."""
    by_qid = entities.select("qid", F.col("entity_id").alias("_by_qid"))
    by_outlet = outlets.select(F.col("domain").alias("outlet"), F.col("entity_id").alias("_by_outlet"))
    joined = rows.join(by_qid, "qid", "left").join(by_outlet, "outlet", "left")
    return joined.withColumn("entity_id", F.when(F.col("qid").isNotNull(), F.col("_by_qid")).otherwise(F.col("_by_outlet"))).drop("_by_qid", "_by_outlet")


def mirror_curated(stored: DataFrame, attached: DataFrame) -> DataFrame:
    """Curated rows are replaced as a whole on each run."""
    known = attached.where(F.col("entity_id").isNotNull()).withColumn("source", F.lit("curated"))
    return stored.where(F.col("source") != "curated").unionByName(known.select(stored.columns))


def panel(funding: DataFrame, lineage: DataFrame) -> DataFrame:
    """Funding of each outlet and its owners: `lineage` is (root, node, place). Sort by `order_keys`."""
    return lineage.select("root", F.col("node").alias("entity_id"), "place").join(funding, "entity_id").withColumn(
        "year", ids.period_year(F.col("period"))).withColumn("kind_place", ids.kind_position(F.col("kind")))


def order_keys() -> list:
    return [F.col("place"), F.desc("year"), F.col("kind_place"), F.col("label")]
