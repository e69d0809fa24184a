"""Corpus pipeline: five stages over `documents`, each by one of the operators in mediagraph/llm, each written and reread by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.llm import language_id, ngram_jaccard, packing, quality_rules, substring_dedup
from mediagraph.llm.tables import read
from mediagraph.llm.wanted import split
from mediagraph.llm.words import free_name
from mediagraph.session import checkpoint_dir, cut


def only(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the learned rules keep. Null and empty texts go (too few words); repeated rows go or stay together."""
    rules = quality_rules.fit_rules(docs, read(spark, sf_dir, "labels"))
    rows = quality_rules.judged(docs, rules)
    return only(rows.where(F.col(f"`{rows.columns[-1]}`")), docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are in one of the languages; `lang` becomes the predicted one. Texts without a letter go; repeated rows go or stay together."""
    models = language_id.fit_models(docs)
    rows = language_id.with_language(docs, models)
    told = F.col(f"`{rows.columns[-1]}`")
    return only(rows.where(~told["rejected"]).withColumn("lang", told["lang_pred"]), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (sets of 5-word shingles, 0.8): the one with the smallest id, of rows with that id the one with the
    smallest hash of its text, of equal ones the smallest row. Rows of one id with other texts are judged by themselves. Rows without an id stay."""
    groups = ngram_jaccard.clustered(docs, size=5, percent=80).where("doc is not null and component is not null")
    found = cut(groups.groupBy("component", "doc", "th").agg(F.count(F.lit(1)).alias("rows")))
    first = found.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("first"))
    stays = (F.col("doc") == F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    told = found.join(first, "component").select(F.col("doc").alias("doc_id"), "th", "rows", stays.alias("stays"))
    changes = cut(told.where("not stays or rows > 1"))
    some, rest = split(docs, "doc_id", changes.select("doc_id"))
    th, row = free_name(docs.columns, "th"), free_name(docs.columns, "row")
    changes, key = changes.withColumnRenamed("th", th), ["doc_id", th]
    some = some.withColumn(th, F.xxhash64("text")).join(changes.where("not stays").select(*key), key, "left_anti")
    again = changes.where("stays").select(*key)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = some.join(again, key, "left_semi").groupBy(*key).agg(F.min(whole).alias(row)).select(f"{row}.*")
    return only(some.join(again, key, "left_anti"), docs.columns).unionByName(one).unionByName(rest)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier; those that lose nothing stay as they are, null and empty ones included."""
    rows = substring_dedup.without_repeats(docs)
    _, removed, kept = (F.col(f"`{c}`") for c in rows.columns[len(docs.columns) :])
    text = F.when(removed > 0, kept).otherwise(F.col("text"))
    return only(rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("language_id", language), ("ngram_jaccard", near_duplicates), ("substring_dedup", repeats), ("best_fit_packing", sequences)]
#: The learned stages are beyond SQL; tests/llm compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
