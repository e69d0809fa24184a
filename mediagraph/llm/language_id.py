"""Language identification (operator 2): one interpolated Kneser-Ney character model per language, kept in sorted hash arrays.

A text is scored as its words, runs of letters in lower case with marks of start and end: each character given the four before it.
For every order the n-grams seen in any language form one sorted array of 64-bit hashes with a column of log probabilities per language,
already interpolated; what no language has seen backs off through a sorted array of contexts. Distinct words of a batch are scored
once. The language with the lowest cross-entropy per character wins. On labelled rows kept out of the models, a logistic curve turns
the lead over the second language into a score, and a limit on the winner's cross-entropy (in standard deviations, wider for short
texts) is set beyond which a text is rejected as none of the languages.

Defined cases: a null text or one without letters is `und` with score 0 and rejected; equal cross-entropies go to the alphabetically first
language; repeated rows get equal answers; with no labelled rows every text is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mediagraph.llm import words

ORDER = 5
#: Bound of the labelled sample: rows of each language that the models are fitted and calibrated on (expected number).
SAMPLE_ROWS = 2_000
START, END = 0, 1
RESULT_TYPE = "struct<lang_pred: string, score: double, cross_entropy: double, rejected: boolean>"


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and its lower case (itself where that is more than one character)."""
    size = 0x110000
    lower = (ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(size))
    return np.fromiter((chr(i).isalpha() for i in range(size)), bool, size), np.fromiter(lower, np.uint32, size)


def chain(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hash of a context followed by one more code point."""
    return words.mix(before * np.uint64(0xD6E8FEB86659FD93) + words.mix(code.astype(np.uint64) + np.uint64(77)))


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last `order` columns of each row of a code matrix."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1] - order, codes.shape[1]):
        h = chain(h, codes[:, k])
    return h


def letter_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of a piece, and start, end and row offsets of its runs of letters."""
    alpha, lower = words.in_worker("letters", letter_tables)
    points, at = words.code_points(buf, offsets)
    starts, ends, run_at = words.spans(alpha[points], at)
    return lower[points], starts, ends, run_at


def padded(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs laid out as START * 4, letters, END; and the index of each predicted code (letters and END), run by run."""
    sizes = ends - starts
    at = np.concatenate(([0], np.cumsum(sizes + ORDER)))
    flat = np.full(int(at[-1]), START, np.uint32)
    flat[words.ragged(at[:-1] + ORDER - 1, sizes)] = points[words.ragged(starts, sizes)]
    flat[at[1:] - 1] = END
    return flat, words.ragged(at[:-1] + ORDER - 1, sizes + 1)


@dataclass
class Models:
    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order - 1: sorted hashes of n-grams
    logs: list[np.ndarray] = field(default_factory=list)  # log probability, a column per language
    contexts: list[np.ndarray] = field(default_factory=list)  # by order - 2: sorted hashes of contexts
    weights: list[np.ndarray] = field(default_factory=list)  # log weight left to the shorter context
    floor: np.ndarray | None = None  # log probability of an unseen character
    curve: tuple[float, float] = (0.0, 1.0)
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = np.inf


def discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 else 0.5


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted hash in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from the distinct 5-grams of each language (a code matrix) and their counts."""
    out = Models(sorted(counts))
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = []  # per order, per language: code matrix, counts
    for lang in out.languages:
        codes, n = counts[lang]
        rows = [(codes, n)]
        for order in range(ORDER - 1, 0, -1):  # below the top, an n-gram counts the characters seen before it
            longer = rows[-1][0]
            short, times = np.unique(longer[:, 1:], axis=0, return_counts=True)
            rows.append((short, times))
        tables.append(rows[::-1])
    letters = np.unique(np.concatenate([t[0][0].ravel() for t in tables]))
    floor = np.zeros(len(out.languages))
    for order in range(1, ORDER + 1):
        codes = np.concatenate([t[order - 1][0] for t in tables])
        hashes = gram_hashes(codes, order)
        keys, first = np.unique(hashes, return_index=True)
        codes = codes[first]
        contexts = gram_hashes(codes[:, :-1], order - 1) if order > 1 else np.zeros(len(keys), np.uint64)
        shared = np.unique(contexts)
        weights = np.zeros((len(shared), len(out.languages)))
        if order > 1:
            at, _ = find(out.keys[-1], gram_hashes(codes, order - 1))
            lower = np.exp(out.logs[-1][at].astype(float))
        logs = np.zeros((len(keys), len(out.languages)))
        for k, t in enumerate(tables):
            own, n = t[order - 1]
            d = discount(n)
            own_at = np.searchsorted(keys, gram_hashes(own, order))
            slot = np.searchsorted(shared, contexts)
            total = np.bincount(slot[own_at], weights=n, minlength=len(shared))
            kinds = np.bincount(slot[own_at], minlength=len(shared))
            left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            base = lower[:, k] if order > 1 else np.full(len(keys), 1.0 / (len(letters) + 1))
            p = left[slot] * base
            p[own_at] += np.maximum(n - d, 0) / total[slot[own_at]]
            logs[:, k] = np.log(p)
            weights[:, k] = np.log(left)
            if order == 1:
                floor[k] = np.log(left[0] / (len(letters) + 1))
        out.keys.append(keys)
        out.logs.append(logs.astype(np.float32))
        if order > 1:
            out.contexts.append(shared)
            out.weights.append(weights.astype(np.float32))
    out.floor = floor.astype(np.float32)
    return out


def run_scores(models: Models, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of each predicted code in each language."""
    prefix = [np.zeros(len(flat), np.uint64)]  # hash of the k codes that end at each place
    for _ in range(ORDER):
        before = np.concatenate((np.zeros(1, np.uint64), prefix[-1][:-1]))
        prefix.append(chain(before, flat))
    out = np.zeros((len(at), len(models.languages)), np.float32)
    open_ = np.arange(len(at))
    for order in range(ORDER, 0, -1):
        where, hit = find(models.keys[order - 1], prefix[order][at[open_]])
        out[open_[hit]] += models.logs[order - 1][where[hit]]
        open_ = open_[~hit]
        if not len(open_):
            return out
        if order > 1:
            where, hit = find(models.contexts[order - 2], prefix[order - 1][at[open_] - 1])
            out[open_[hit]] += models.weights[order - 2][where[hit]]
    out[open_] += models.floor
    return out


def entropies(models: Models, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text in each language, and the number of characters scored."""
    points, starts, ends, run_at = letter_runs(buf, offsets)
    hashes = words.hash_spans(points, starts, ends)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.zeros((len(offsets) - 1, len(models.languages)))
    sizes = ends - starts + 1
    chars = np.concatenate(([0], np.cumsum(sizes)))[run_at]
    chars = chars[1:] - chars[:-1]
    if len(first):
        flat, at = padded(points, starts[first], ends[first])
        heads = np.concatenate(([0], np.cumsum(sizes[first])[:-1]))
        each = np.add.reduceat(run_scores(models, flat, at).astype(float), heads, axis=0)
        sums = np.zeros((len(starts) + 1, total.shape[1]))
        np.cumsum(each[back], axis=0, out=sums[1:])
        total = sums[run_at[1:]] - sums[run_at[:-1]]
    return -total / np.maximum(chars, 1)[:, None], chars


def lead(entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Log of the winner's lead in nats over the whole text."""
    if entropy.shape[1] < 2:
        return np.log1p(chars.astype(float))
    two = np.partition(entropy, 1, axis=1)
    return np.log1p((two[:, 1] - two[:, 0]) * chars)


def excess(models: Models, entropy: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """How many standard deviations the winner's cross-entropy lies above its language's mean."""
    best = entropy.argmin(axis=1)
    return (entropy.min(axis=1) - models.mean[best]) / np.sqrt(models.spread[best] ** 2 + 4.0 / np.maximum(chars, 1))


def calibrate(models: Models, entropy: np.ndarray, chars: np.ndarray, truth: np.ndarray, kept: float = 0.999, margin: float = 1.5) -> None:
    """Fit the score's curve and the rejection limit on labelled texts that the models haven't seen."""
    best = entropy.argmin(axis=1)
    right = best == truth
    models.mean, models.spread = np.zeros(len(models.languages)), np.ones(len(models.languages))
    for k in range(len(models.languages)):
        own = entropy[(truth == k) & right, k]
        own = own if len(own) else entropy.min(axis=1)
        models.mean[k], models.spread[k] = (np.median(own), max(own.std(), 0.02)) if len(own) else (0.0, np.inf)
    if not len(truth):
        return
    models.limit = margin * max(3.0, float(np.quantile(excess(models, entropy, chars)[right], kept))) if right.any() else np.inf
    x, n1, n0 = lead(entropy, chars), right.sum(), (~right).sum()
    target = np.where(right, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b, prior = 0.0, 1.0, 100.0  # the prior keeps a few wrong labels from flattening the curve
    for _ in range(50):  # Newton steps of a logistic fit
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(target - p).sum() - 1e-3 * a, ((target - p) * x).sum() - prior * (b - 1)])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + prior]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], max(b + step[1], 0.01)
        if np.abs(step).max() < 1e-8:
            break
    models.curve = (float(a), float(b))


def gram_counts(rows: DataFrame) -> DataFrame:
    """Counts of each language's 5-grams over (lang, text): summed per batch, then per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            which, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
            for k, lang in enumerate(names):
                buf, offsets = words.text_buffer(batch.column(1).take(pa.array(np.flatnonzero(which == k))))
                for i, j in words.pieces(offsets):
                    points, starts, ends, _ = letter_runs(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    flat, at = padded(points, starts, ends)
                    codes = np.stack([flat[at - s] for s in range(ORDER - 1, -1, -1)], axis=1) if len(at) else np.zeros((0, ORDER), np.uint32)
                    grams, times = np.unique(np.ascontiguousarray(codes).view(f"V{4 * ORDER}").ravel(), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), words.blobs(grams, np.ones(len(grams), np.int64)), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram binary, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_models(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, lang: str = "lang", text: str = "text") -> Models:
    """Fit on labelled rows: about `sample_rows` of each language, picked by text hash; a fifth of them calibrates."""
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not there:
        return Models([])
    share = F.element_at(F.create_map(*[x for k, n in there.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows / n)))]), F.col("lang"))
    dice = F.pmod(F.xxhash64("text"), F.lit(1 << 24)) / F.lit(float(1 << 24))
    picked = rows.where(dice < share)
    checks = F.pmod(F.xxhash64(F.lit("calibration"), F.col("text")), F.lit(5)) == 0
    got = gram_counts(picked.where(~checks)).toArrow()
    counts = {}
    for k in there:
        own = got.filter(pa.compute.equal(got["lang"], k))
        if len(own):
            buf, _ = words.text_buffer(own["gram"])
            codes = np.frombuffer(buf.tobytes(), np.uint32).reshape(-1, ORDER)
            order = np.lexsort(codes.T[::-1])
            counts[k] = (codes[order], own["n"].to_numpy()[order])
    if not counts:
        return Models([])
    models = build(counts)
    shipped, names = rows.sparkSession.sparkContext.broadcast(vars(models)), models.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = words.text_buffer(batch.column(1))
            for i, j in words.pieces(offsets):
                entropy, chars = entropies(Models(**shipped.value), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), words.blobs(entropy.ravel(), np.full(j - i, len(names))), pa.array(chars.astype(np.int64))], ["lang", "entropy", "chars"])

    held = picked.where(checks & F.col("lang").isin(names)).mapInArrow(run, "lang string, entropy binary, chars bigint").where("chars > 0").toArrow()
    entropy = np.frombuffer(words.text_buffer(held["entropy"])[0].tobytes(), np.float64).reshape(-1, len(names))
    truth = np.array([names.index(x) for x in held["lang"].to_pylist()], np.int64)
    calibrate(models, entropy, held["chars"].to_numpy(), truth)
    return models


def answers(models: Models, column: pa.Array) -> pa.StructArray:
    buf, offsets = words.text_buffer(column)
    lang: list[str] = []
    score, best, rejected = [], [], []
    for i, j in words.pieces(offsets) if models.languages else [(0, len(column))]:
        if models.languages:
            entropy, chars = entropies(models, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        else:
            entropy, chars = np.zeros((j - i, 1)), np.zeros(j - i, np.int64)
        known, win = chars > 0, entropy.argmin(axis=1)
        a, b = models.curve
        lang += [models.languages[w] if k else "und" for w, k in zip(win, known, strict=True)]
        score.append(np.where(known, 1 / (1 + np.exp(-np.clip(a + b * lead(entropy, chars), -30, 30))), 0.0))
        best.append(np.where(known, entropy.min(axis=1), np.nan))
        far = excess(models, entropy, chars) > models.limit if models.mean is not None else np.zeros(j - i, bool)
        rejected.append(~known | far)
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    low = cat(best, float)
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(cat(score, float)), pa.array(low, mask=np.isnan(low)), pa.array(cat(rejected, bool))], ["lang_pred", "score", "cross_entropy", "rejected"])


def with_language(docs: DataFrame, models: Models, text: str = "text", keep: list[str] | None = None, name: str = "language") -> DataFrame:
    """`docs` (or its columns `keep`) with a struct of the prediction for each whole text."""
    keep = docs.columns if keep is None else keep
    name = words.free_name(keep, name)
    given = docs.select(*keep, F.col(text).alias(f"{name}_text"))
    shipped = docs.sparkSession.sparkContext.broadcast(vars(models))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], answers(Models(**shipped.value), part.columns[-1])], [*keep, name])

    return given.mapInArrow(run, given.drop(f"{name}_text").schema.add(name, DataType.fromDDL(RESULT_TYPE)))
