"""URL filters (operator 5): rules of host and path first, then a classifier over segmented names.

Names such as `cheappills` are split into words by a unigram Viterbi pass; a binarised naive Bayes model then scores the different
words of host and path. Both models come from the URLs themselves: the words and their counts from names that are written apart (by dots, hyphens,
digits), the two classes from hosts that do or don't contain one of a few seed words, each distinct host and word counting once, so
that one busy host doesn't outvote the rest. Seed words only label; what decides is every word that goes with them. Counts cover all
rows and all words. Vocabulary, splits and weights are tables of any size: each run of letters meets the words that stand in it by a join,
each (host, path) the weights of its words by another, and the rows their scores by a third.

Defined cases: a null url or one without `://` has an empty host and path, meets no rule and is allowed; words that neither class has seen
say nothing; a tie is allowed; with no labelled host everything that no rule blocks is allowed; rows are judged one by one, so repeated
rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.llm import words
from mediagraph.llm.wanted import split
from mediagraph.session import cut

#: Words that mark a host as unwanted when it is used for learning.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "lottery", "pills", "poker", "porn", "sex", "spam", "viagra", "xxx")
#: The longest word that is looked for, and the keys of a join that are broadcast (which changes no result).
LONGEST, HEAD = 24, 1_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (letters A-Z lowered) and path; empty where there is no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Name of the longest rule that fits host and path, and whether it allows; null where none does."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the last one set wins
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, allow = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.allow)).otherwise(allow)
    return name, allow


def segments(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a run of letters into words. A word that isn't known costs more the longer it is."""
    if name in costs and len(name) <= 3:
        return [name]
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        found = (math.inf, end - 1)
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            cost = costs.get(word)
            found = min(found, (best[start] + (unknown + 2.3 * len(word) if cost is None else cost), start))
        best.append(found[0])
        back.append(found[1])
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def is_joined(name: str, counts: dict[str, int], least: int = 3) -> bool:
    """Is a name of the vocabulary two or more words of it run together, each of them found in more hosts? `counts` has its parts that are words."""
    if len(name) < 2 * least:
        return False
    reached = [True] + [False] * len(name)
    for end in range(least, len(name) + 1):
        reached[end] = any(reached[start] and counts.get(name[start:end], 0) > counts[name] for start in range(max(0, end - LONGEST), end - least + 1) if end - start < len(name))
    return reached[-1]


@dataclass
class UrlModel:
    """The vocabulary (word, n) and the sum of its counts, the splits (run, words) of the names it was learned from, weights (word, weight), prior."""

    vocabulary: DataFrame
    total: int
    splits: DataFrame
    weights: DataFrame
    prior: float


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with a table of one row a key. The keys that most rows have are joined by broadcast, so that none of them fills a task."""
    hot = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), *keys).limit(HEAD).select(*keys))
    told = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    head = cut(table.join(F.broadcast(hot), keys, "left_semi"))
    often = told.where("__hot").drop("__hot").join(F.broadcast(head), keys, how)
    return often.unionByName(told.where("__hot is null").drop("__hot").join(table, keys, how))


def host_runs(rows: DataFrame) -> DataFrame:
    """(host, run, own): the runs of letters of each host and its paths; own: it stands in the host's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found |= {(host, w): found.get((host, w), False) for w in WORD.findall(path.lower())}
                found |= {(host, w): True for w in WORD.findall(host.lower())}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(found.values(), pa.bool_())], ["host", "run", "own"])

    return rows.mapInArrow(run, "host string, run string, own boolean").groupBy("host", "run").agg(F.max("own").alias("own"))


def url_runs(rows: DataFrame) -> DataFrame:
    """(host, path, run): the different runs of letters of each host and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, p, w) for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for w in sorted({*WORD.findall(h.lower()), *WORD.findall(p.lower())})]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in range(3)], ["host", "path", "run"])

    return rows.mapInArrow(run, "host string, path string, run string")


def parts(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(run, word, n): the words of the vocabulary that stand anywhere in each run of letters, or are the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = [], []
            for name in batch.column(0).to_pylist():
                found = sorted({name, *(name[i:j] for i in range(len(name)) for j in range(i + 1, min(len(name), i + LONGEST) + 1))})
                names += [name] * len(found)
                words += found
                if len(names) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string())], ["run", "word"])
                    names, words = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.string())], ["run", "word"])

    some, _ = split(names.mapInArrow(run, "run string, word string"), "word", vocabulary.select("word"))
    return cut(looked_up(cut(some), vocabulary, ["word"]))


def by_run(found: DataFrame) -> DataFrame:
    return found.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("parts"))


def split_names(names: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """(run, words): the cheapest split of each run of letters. It depends on its parts alone, so no task holds the vocabulary."""
    unknown = math.log(total) + 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for name, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told.append(segments(name, {x["word"]: -math.log(x["n"] / total) for x in own or [] if len(x["word"]) <= LONGEST}, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(pa.string()))], ["run", "words"])

    return cut(names.join(by_run(found), "run", "left").select("run", "parts").mapInArrow(run, "run string, words array<string>"))


def fit(urls: DataFrame, seeds: tuple[str, ...] = SEEDS, least_hosts: int = 1, smoothing: float = 0.5) -> UrlModel:
    """Learn from (host, path) of all rows."""
    spark = urls.sparkSession
    rows = cut(urls.where("host <> ''").select("host", "path").distinct())
    named = cut(host_runs(rows))
    seeded = spark.createDataFrame([(s, 1) for s in seeds], "word string, n bigint")
    counted = named.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    known = cut(counted.where(F.col("n") >= least_hosts).unionByName(seeded).groupBy("word").agg(F.sum("n").alias("n")))
    names = named.select("run").distinct()
    found = parts(names.union(seeded.select("word")).distinct(), known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [{x["word"]: x["n"] for x in own} for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, own in zip(batch.column(0).to_pylist(), told, strict=True) if w in own and is_joined(w, own)], pa.string())], ["word"])

    joined = cut(by_run(found).mapInArrow(run, "word string"))
    vocabulary = cut(known.join(joined, "word", "left_anti"))
    total = (vocabulary.agg(F.sum("n")).first()[0] or 0) + 1
    splits = split_names(names, looked_up(found.drop("n"), vocabulary, ["word"]), total)

    spoken = cut(looked_up(named, splits, ["run"]).select("host", "own", F.explode("words").alias("word")).groupBy("host", "word").agg(F.max("own").alias("own")))
    # only a host's own name can mark it, not its paths
    flagged = cut(spoken.where(F.col("own") & F.col("word").isin(*seeds)).select("host").distinct().withColumn("bad", F.lit(True)))
    hosts = rows.select("host").distinct()
    totals = {bool(r["bad"]): r["n"] for r in hosts.join(flagged, "host", "left").groupBy(F.coalesce("bad", F.lit(False)).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(True) or not totals.get(False):
        return UrlModel(vocabulary, total, splits, spark.createDataFrame([], "word string, weight double"), 0.0)
    sums = cut(spoken.join(flagged, "host", "left").groupBy("word").agg(F.count_if("bad").alias("bad"), F.count(F.lit(1)).alias("all")))
    bad, every, size = sums.agg(F.sum("bad"), F.sum("all"), F.count(F.lit(1))).first()
    good = every - bad
    weight = F.log((F.col("bad") + smoothing) / (bad + smoothing * size)) - F.log((F.col("all") - F.col("bad") + smoothing) / (good + smoothing * size))
    return UrlModel(vocabulary, total, splits, cut(sums.select("word", weight.alias("weight"))), math.log(totals[True] / totals[False]))


def scored(rows: DataFrame, model: UrlModel) -> DataFrame:
    """(host, path, score) of different (host, path): log odds of being unwanted. Without a word that tells, the prior alone."""
    rows = cut(rows)
    asked = cut(url_runs(rows))
    new = cut(asked.select("run").distinct().join(model.splits.select("run"), "run", "left_anti"))
    splits = model.splits.unionByName(split_names(new, parts(new, model.vocabulary), model.total))
    words_of = cut(splits.select("run", F.explode(F.array_distinct("words")).alias("word")))
    telling = cut(looked_up(words_of, model.weights, ["word"]).groupBy("run").agg(F.collect_list(F.struct("word", "weight")).alias("telling")))
    found = looked_up(asked, telling, ["run"]).groupBy("host", "path").agg(F.array_distinct(F.flatten(F.collect_list("telling"))).alias("telling"))
    # added up in one order, whatever the tasks
    sums = F.aggregate(F.array_sort(F.transform("telling", lambda x: x["weight"])), F.lit(0.0), lambda a, b: a + b)
    sums = found.select("host", "path", (F.lit(model.prior) + sums).alias("score"))
    return cut(rows.join(sums, ["host", "path"], "left").select("host", "path", F.coalesce("score", F.lit(model.prior)).alias("score")))


def judged(rows: DataFrame, rules: list[UrlRule], url: str = "url", keep: list[str] | None = None, model: UrlModel | None = None) -> DataFrame:
    """`rows` (or its columns `keep`) with host, path, rule, verdict and the method's score (null where a rule decides)."""
    keep = rows.columns if keep is None else keep
    names = []
    for name in ("host", "path", "rule", "verdict", "score"):
        names.append(words.free_name([*keep, *names], name))
    host_name, path_name, rule_name, verdict_name, score_name = names
    host, path = url_parts(F.col(url))
    told = rows.select(*keep, host.alias(host_name), path.alias(path_name))
    model = model or fit(told.select(F.col(host_name).alias("host"), F.col(path_name).alias("path")))
    rule, allow = rule_columns(F.col(host_name), F.col(path_name), rules)
    ruled_name = words.free_name([*keep, *names], "ruled")
    told = told.withColumn(rule_name, rule).withColumn(ruled_name, allow)
    open_ = told.where(F.col(rule_name).isNull() & (F.col(host_name) != ""))
    scores = scored(open_.select(F.col(host_name).alias("host"), F.col(path_name).alias("path")).distinct(), model)
    scores = scores.select(F.col("host").alias(host_name), F.col("path").alias(path_name), F.col("score").alias(score_name))
    told = looked_up(told, scores, [host_name, path_name], "left")
    verdict = F.when(F.coalesce(F.col(ruled_name), F.coalesce(F.col(score_name) <= 0, F.lit(True))), F.lit("allow")).otherwise(F.lit("block"))
    return told.withColumn(verdict_name, verdict).select(*[f"`{c}`" for c in keep], *names)

