"""Quality rules (operator 1): a learned decision list over text statistics, emitted as an ordered Spark conditional expression.

Statistics of whole texts are taken in Arrow batches. Rules are grown and pruned by sequential covering on a bounded sample of labelled
rows: each rule is a conjunction of thresholds (`ratio > 0.12 and words <= 40`), grown by information gain, pruned on rows held back,
kept while it stays precise; the rows it covers are taken out and the next rule is grown from the rest. What no rule rejects is kept.

Defined cases: a null text has no words; a text without words has zero ratios; rows are judged one by one, so repeated rows and ties get
equal verdicts; an empty table gives an empty result; without labelled rows of both kinds the list has no rules. A column of `docs`
named like the added one is left alone (the added one gets a free name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mediagraph.llm import words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "bang_share", "bar_share", "other_share", "word_length", "line_words")
#: Characters that count as symbols, and the window that counts as repeated text.
SYMBOLS, WINDOW = b"#*$%&|<>", 5
#: Bound of the labelled sample the rules are learned from.
SAMPLE_ROWS = 20_000
STATS_TYPE = "struct<" + ", ".join([f"{c}: bigint" for c in COUNTS] + [f"{c}: double" for c in FEATURES]) + ">"


def marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set entries in each row."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_stats(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and the features of each text of one piece."""
    n = len(offsets) - 1
    starts, ends, word_at = words.word_spans(buf, offsets)
    n_words = np.diff(word_at)
    solid = ~words.IS_SPACE[buf] if len(buf) else np.zeros(0, bool)
    chars = per_row(solid & ((buf & 0xC0) != 0x80), offsets)
    symbols = per_row(marks(SYMBOLS)[buf], offsets)

    # lines: at each text's start and after each line feed
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    breaks = np.flatnonzero(buf == 0x0A)
    line_starts = np.union1d(filled, breaks + 1)
    line_starts = line_starts[line_starts < len(buf)]
    line_ends = np.append(line_starts[1:], len(buf)) if len(line_starts) else line_starts
    line_ends = line_ends - (buf[line_ends - 1] == 0x0A) if len(buf) else line_ends
    line_row = np.searchsorted(offsets, line_starts, side="right") - 1
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(solid, out=sums[1:])
    said = sums[line_ends] > sums[line_starts]
    line_row = line_row[said]
    keys = words.mix(words.hash_spans(buf, line_starts[said], line_ends[said]) ^ words.mix(line_row.astype(np.uint64)))
    lines = np.bincount(line_row, minlength=n)
    _, first = np.unique(keys, return_index=True)
    dup_lines = lines - np.bincount(line_row[first], minlength=n)

    # windows of words found twice or more in their text
    grams = words.window_hashes(words.hash_spans(buf, starts, ends), WINDOW)
    good = np.flatnonzero(words.inside(word_at, WINDOW))
    row = np.repeat(np.arange(n), n_words)
    keys = words.mix(grams[good] ^ words.mix(row[good].astype(np.uint64)))
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    repeats = per_row(words.cover(len(starts), good[times[back] > 1], WINDOW), word_at)

    share = lambda x, of: x / np.maximum(of, 1)
    upper, lower = per_row((buf >= 65) & (buf <= 90), offsets), per_row((buf >= 97) & (buf <= 122), offsets)
    letters = upper + lower + per_row(buf >= 0xC0, offsets)
    digits = per_row((buf >= 48) & (buf <= 57), offsets)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats,
        "words": n_words.astype(float), "symbol_share": share(symbols, chars), "repeat_share": share(repeats, n_words),
        "dup_line_share": share(dup_lines, lines), "upper_share": share(upper, upper + lower), "digit_share": share(digits, chars),
        "bang_share": share(per_row(buf == 33, offsets), n_words), "bar_share": share(per_row(buf == 124, offsets), n_words),
        "other_share": share(np.maximum(chars - letters - digits, 0), chars), "word_length": share(chars, n_words), "line_words": share(n_words, lines),
    }


def stats_array(column: pa.Array) -> pa.StructArray:
    buf, offsets = words.text_buffer(column)
    parts = [text_stats(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in words.pieces(offsets)]
    names = [*COUNTS, *FEATURES]
    arrays = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0), pa.int64() if c in COUNTS else pa.float64()) for c in names]
    return pa.StructArray.from_arrays(arrays, names)


def with_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "stats") -> DataFrame:
    """`docs` (or its columns `keep`) with a struct of the statistics of each whole text."""
    keep = docs.columns if keep is None else keep
    name = words.free_name(keep, name)
    given = docs.select(*keep, F.col(text).alias(f"{name}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], stats_array(part.columns[-1])], [*keep, name])

    schema = given.drop(f"{name}_text").schema.add(name, DataType.fromDDL(STATS_TYPE))
    return given.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """All of its conditions (feature, above, threshold) must hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for feature, above, cut in self.conditions:
            out = out & (stats[feature] > cut if above else stats[feature] <= cut)
        return out

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for feature, above, cut in self.conditions:
            out &= (table[feature] > cut) == above
        return out


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds rejects, and what none rejects is kept."""

    rules: tuple[Rule, ...]

    def column(self, stats: Column) -> Column:
        """True where the row is kept."""
        out = None
        for rule in self.rules:
            out = F.when(rule.column(stats), F.lit(False)) if out is None else out.when(rule.column(stats), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def grow(table: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> Rule:
    """Add the threshold with the best information gain until the rule covers no good row or nothing gains."""
    conditions: list[tuple[str, bool, float]] = []
    live = np.ones(len(bad), bool)
    while len(conditions) < most and (live & ~bad).any():
        p0, n0 = int((live & bad).sum()), int((live & ~bad).sum())
        best = (1e-9, None)
        for feature, points in cuts.items():
            bins = np.searchsorted(points, table[feature][live])  # value > points[i] for i < bin
            p = np.bincount(bins[bad[live]], minlength=len(points) + 1)
            n = np.bincount(bins[~bad[live]], minlength=len(points) + 1)
            low_p, low_n = np.cumsum(p)[:-1], np.cumsum(n)[:-1]
            for above, ps, ns in ((True, p0 - low_p, n0 - low_n), (False, low_p, low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 0, ps * (np.log2(ps / np.maximum(ps + ns, 1)) - np.log2(p0 / (p0 + n0))), 0.0)
                i = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[i] > best[0]:
                    best = (float(gain[i]), (feature, above, float(points[i])))
        if best[1] is None:
            break
        conditions.append(best[1])
        live &= Rule((best[1],)).mask(table)
    return Rule(tuple(conditions))


def prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions while the rows held back don't speak against it."""
    best, worth = rule, -2.0
    for k in range(len(rule.conditions), 0, -1):
        shorter = Rule(rule.conditions[:k])
        hit = shorter.mask(table)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value >= worth:
            best, worth = shorter, value
    return best


def learn(table: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.95, least: int = 5, seed: int = 7) -> DecisionList:
    """Sequential covering: grow on two thirds of the rows, prune on the rest, keep rules that are precise on both."""
    rules: list[Rule] = []
    side = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    cuts = {}
    for feature in FEATURES:
        points = np.unique(np.quantile(table[feature], np.linspace(0, 1, 101))) if len(bad) else np.zeros(0)
        cuts[feature] = np.unique(np.round((points[1:] + points[:-1]) / 2, 6))
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules:
        on, off = left & side, left & ~side
        if (on & bad).sum() < least:
            break
        rule = grow({k: v[on] for k, v in table.items()}, bad[on], cuts, most_conditions)
        if not rule.conditions:
            break
        if off.any():
            rule = prune(rule, {k: v[off] for k, v in table.items()}, bad[off])
        hit = rule.mask(table) & left
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum() or (hit & off & bad).sum() < precision * (hit & off).sum():
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text: str = "text", label: str = "quality", **how) -> DecisionList:
    """Learn from at most `sample_rows` labelled documents (those with the smallest id hashes). Ids with both labels are left out."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("labelled_id")).agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where("low = high").select("labelled_id", (F.col("low") == 0).alias("bad"))
        .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample_rows)
    )
    sample = docs.select(F.col(id_col).alias("labelled_id"), F.col(text).alias("sampled_text")).join(F.broadcast(picked), "labelled_id")
    rows = with_stats(sample, "sampled_text", keep=["labelled_id", "bad"]).select("labelled_id", "bad", "stats.*")
    got = rows.toArrow().sort_by("labelled_id")  # bounded: one short row per sampled label
    table = {c: got[c].to_numpy() for c in FEATURES}
    return learn(table, got["bad"].to_numpy(zero_copy_only=False), **how)


def judged(docs: DataFrame, rules: DecisionList, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `stats`, `base_failed` and `kept`, each under a free name if taken."""
    rows = with_stats(docs, text, keep)
    stats = F.col(f"`{rows.columns[-1]}`")
    failed, kept = words.free_name(rows.columns, "base_failed"), words.free_name(rows.columns, "kept")
    base = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
    return rows.withColumn(failed, base).withColumn(kept, ~F.col(failed) & rules.column(stats))
