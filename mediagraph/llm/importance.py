"""Target-distribution importance resampling (operator 13): documents are drawn by how much likelier a target's bag of hashed n-grams is than
the corpus's, with a random term per id (draws without replacement).

Features are all runs of one to three words, hashed to 10,000 buckets by CRC-32. The checksums of a batch's words are computed at once, and
those of longer runs by combining them (a checksum is linear: what follows only shifts what stands before), so no run is ever spelt out.

The weight of a document is the sum of its buckets' counts times the buckets' gains. It is aggregated bit by bit: the counts of a few
documents become planes of 10,000 bits (plane j has the bit of each bucket whose count has bit j), the gains become planes of their
positive and of their negative magnitudes, and for each pair of planes the population count of their AND goes in with the weight
2^(j + k) and its sign. All of it is integer arithmetic, so weights are exact in any order.

What the corpus and the target hold per bucket is summed over all rows: 10,000 numbers a task are shuffled, and 10,000 reach the driver.
Ranks come from a range partitioning of the short rows that take part.

Defined cases: a null or empty text, or one without words, has no features and weight 0; documents with fewer than `least_words` words get
a score and no rank; equal scores go by id, null ids last; repeated rows count as often as they stand there and draw alike; with an empty target the gains
come from its smoothing alone; an empty table gives an empty result; whole texts are read, whatever their length; a column of `docs` that is
called as a new one keeps its values and the new one gets a free name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mediagraph.llm import words
from mediagraph.operators.load import number_rows
from mediagraph.session import cut

BUCKETS = 10_000
RUN = 3
#: Documents whose counts stand in one dense block (5 MB).
BLOCK_ROWS = 64
#: Longest word whose checksum is computed together with the others of a batch.
SHORT = 48
WEIGHT_TYPE = "struct<n_words: bigint, n_features: bigint, weight: bigint>"


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (A to Z only) and word membership of each byte."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


def shift_tables(most: int) -> np.ndarray:
    """[n, k, b]: a checksum's byte k of value b, followed by n zero bytes."""
    table = crc_table()
    out = np.zeros((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(1, most + 1):
        out[n] = table[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they enter one of themselves and `n` further bytes (`n` is an array of lengths)."""
    tables = words.in_worker("crc shifts", lambda: shift_tables(SHORT))
    out, left = crc, np.asarray(n)
    while True:
        step = np.minimum(left, SHORT)
        out = tables[step, 0, out & 255] ^ tables[step, 1, (out >> np.uint32(8)) & 255] ^ tables[step, 2, (out >> np.uint32(16)) & 255] ^ tables[step, 3, out >> np.uint32(24)]
        left = left - step
        if not left.any():  # words beyond SHORT take further steps, one for each SHORT bytes of the longest
            return out


def span_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span: byte by byte for all short ones at once."""
    table = words.in_worker("crc table", crc_table)
    sizes = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    long = int(np.searchsorted(-np.minimum(sizes[order], SHORT + 1), -SHORT))
    for i in order[:long]:
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    rest = order[long:]
    state, at, size = out[rest], starts[rest], sizes[rest]
    for k in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -k))  # spans of more than k bytes come first
        state[:live] = table[(state[:live] ^ buf[at[:live] + k]) & 255] ^ (state[:live] >> np.uint32(8))
    out[rest] = ~state
    return out


def spaced(crc: np.ndarray) -> np.ndarray:
    """Checksum of what has `crc` and a space."""
    table = words.in_worker("crc table", crc_table)
    state = ~crc
    return ~(table[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8)))


def run_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of some rows, and the rows' numbers of words."""
    lower, word = words.in_worker("importance bytes", byte_tables)
    buf = lower[buf]
    starts, ends, at = words.spans(word[buf], offsets)
    n_words = np.diff(at)
    row, sizes = np.repeat(np.arange(len(n_words)), n_words), ends - starts
    alone = span_crcs(buf, starts, ends)
    crcs, rows, runs = [alone], [row], alone
    for k in range(2, RUN + 1):  # a run of k words is one of k - 1, a space, and a word
        runs = shifted(spaced(runs[:-1]), sizes[k - 1 :]) ^ alone[k - 1 :] if len(runs) else runs
        inner = words.inside(at, k)
        crcs.append(runs[inner]), rows.append(row[: len(runs)][inner])
    return np.concatenate(rows), (np.concatenate(crcs) % np.uint32(BUCKETS)).astype(np.int64), n_words


def pieces_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and row offsets of a few rows at a time."""
    buf, offsets = words.text_buffer(column)
    for i, j in words.pieces(offsets):
        yield buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Features per bucket over all rows: each task hands on its own 10,000 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for buf, offsets in pieces_of(batch.column(0)):
                sums += np.bincount(run_buckets(buf, offsets)[1], minlength=BUCKETS)
        found = np.flatnonzero(sums)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["bucket", "n"])

    sums = docs.select(F.col(text)).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():  # one row per bucket, 10,000 at most
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of each bucket's log likelihood ratio, with one feature added to each bucket on both sides."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: ((t + 1.0) * (s_all + float(BUCKETS))) / ((s + 1.0) * (t_all + float(BUCKETS)))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def planes(values: np.ndarray) -> list[np.ndarray]:
    """Bit planes of rows of non-negative numbers, as rows of 64-bit words; the last one is not empty."""
    pad = -values.shape[1] % 64
    out = []
    for k in range(int(values.max(initial=0)).bit_length()):
        bits = np.packbits((values >> k).astype(np.uint8) & np.uint8(1), axis=1)
        out.append(np.ascontiguousarray(np.pad(bits, ((0, 0), (0, (pad + 7) // 8)))[:, : (values.shape[1] + pad) // 8]).view(np.uint64))
    return out


def gain_planes(gain: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The gains' signed planes: factor and bits."""
    signed = []
    for sign in (1, -1):
        signed += [(sign << k, plane[0]) for k, plane in enumerate(planes(np.maximum(sign * gain, 0)[None, :]))]
    return signed


def summed_gains(rows: np.ndarray, buckets: np.ndarray, n_rows: int, signed: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sum of gains over each row's features, by population counts of ANDed planes."""
    out = np.zeros(n_rows, np.int64)
    order = np.argsort(rows, kind="stable")
    rows, buckets = rows[order], buckets[order]
    for first in range(0, n_rows, BLOCK_ROWS):
        some = min(BLOCK_ROWS, n_rows - first)
        i, j = np.searchsorted(rows, [first, first + some])
        if i == j:
            continue
        counts = np.bincount((rows[i:j] - first) * BUCKETS + buckets[i:j], minlength=some * BUCKETS).reshape(some, BUCKETS)
        for k, plane in enumerate(planes(counts)):
            for factor, bits in signed:
                out[first : first + some] += (factor << k) * np.bitwise_count(plane & bits).sum(axis=1, dtype=np.int64)
    return out


def with_weights(docs: DataFrame, gain: np.ndarray, text: str = "text", keep: list[str] | None = None, name: str = "importance") -> DataFrame:
    """`docs` (or its columns `keep`) with a struct of each text's words, features and weight under the given gains."""
    keep = docs.columns if keep is None else keep
    name = words.free_name(keep, name)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(f"{name}_text"))
    signed = gain_planes(gain)

    def told(column: pa.Array) -> pa.StructArray:
        parts = []
        for buf, offsets in pieces_of(column):
            rows, buckets, n_words = run_buckets(buf, offsets)
            parts.append((n_words, np.bincount(rows, minlength=len(n_words)), summed_gains(rows, buckets, len(n_words), signed)))
        arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * 3
        return pa.StructArray.from_arrays(arrays, ["n_words", "n_features", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], told(part.columns[-1])], [*keep, name])

    return given.mapInArrow(run, given.drop(f"{name}_text").schema.add(name, DataType.fromDDL(WEIGHT_TYPE)))


def luck(id_col: str, seed: int) -> Column:
    """The random term of an id, in floored thousandths: minus the log of an exponential draw from its hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
    id_col: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None, name: str = "importance",
) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct `name`: n_words, n_features, weight, score, rank (from 1, null for the undrawn).

    Of the documents with `least_words` words, `percent` in a hundred are drawn (rounded down), by the highest scores. Only short rows are
    ranked where `keep` is short; with whole texts kept, these are sorted along.
    """
    keep = docs.columns if keep is None else keep
    name = words.free_name([*keep, id_col], name)
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    key = words.free_name([*keep, name], "key")
    rows = with_weights(docs.withColumn(key, F.col(id_col)), gain, text, [*keep, key], name)
    fields = [F.col(f"{name}.{c}").alias(c) for c in ("n_words", "n_features", "weight")]
    scored = cut(rows.withColumn(name, F.struct(*fields, (F.col(f"{name}.weight") + luck(key, seed)).alias("score"))))
    part = F.col(f"{name}.n_words") >= least_words
    drawn = scored.where(part).count() * percent // 100
    order = [F.desc(f"{name}.score"), F.asc_nulls_last(key), F.asc(f"{name}.n_features")]
    place = words.free_name([*keep, name, key], "place")
    ranked = number_rows(scored.where(part), order, place)
    rest = scored.where(~part).withColumn(place, F.lit(None).cast("bigint"))
    rank = F.when(F.col(place) < drawn, F.col(place) + 1)
    result = F.struct(*[F.col(f"{name}.{c}").alias(c) for c in ("n_words", "n_features", "weight", "score")], rank.alias("rank"))
    return ranked.unionByName(rest).select(*[F.col(f"`{c}`") for c in keep], result.alias(name))
