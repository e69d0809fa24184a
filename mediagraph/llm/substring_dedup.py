"""Substring dedup (operator 3): words of passages that already stand earlier, found by level-wise doubling of repeated windows.

A window of `size` words is removed if the same words also start earlier (smaller id; same document, earlier start). Level by level:
windows of `base` words that occur more than once survive, the survivors are extended to twice the length, and so on up to `size`; what
is alone at one length is never looked at again, and with no survivors nothing is left to join. At the lowest level not every window
is compared: of the windows of `base` words in the first places of a full window, the one with the smallest hash stands for it. Equal
full windows choose the same one, so no repeat is missed, and a sixth of the windows is enough. At the last level each surviving
place carries the hashes of the full windows that it stands for; equal ones meet at the hash of their shared place, in order, and all but
the first are covered.

Each Arrow batch compares its own windows first and sends one row of a hash on; later ones travel under a key of their own document, so
that a passage that a third of the documents share gives a reducer one row per batch, not one per document.

Defined cases: a null or short text has no windows and loses nothing; of rows with one id, those of equal text are the same place (none
removes the other, both get the answer), those of different texts are ordered by text hash; rows with a null id are returned whole and
not compared; an empty table gives an empty result. Columns of `docs` are passed through untouched, added ones get free names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mediagraph.llm import words
from mediagraph.llm.wanted import split
from mediagraph.session import cut

SIZE, BASE_SIZE = 20, 10
#: How a row takes part at its key: alone, known to repeat already, or first of several in its batch.
ALONE, KNOWN, FIRST = 0, 1, 2
PLACES = "k bigint, flag tinyint, doc bigint, at int"
WINDOWS = "k bigint, doc bigint, th bigint, at int, hashes binary, flags binary"


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, word_at = words.word_spans(buf, offsets)
    return words.hash_spans(buf, starts, ends), word_at


def anchors(h: np.ndarray, word_at: np.ndarray, size: int, base: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of windows of `base` words; starts of full windows; and the place that stands for each of those: its leftmost smallest
    hash among the first `reach` places."""
    small = words.window_hashes(h, base)
    full = np.flatnonzero(words.inside(word_at, size))
    if not len(full):
        return small, full, full
    least = small[: len(small) - reach + 1].copy()
    for k in range(1, reach):
        np.minimum(least, small[k : k + len(least)], out=least)
    at = np.full(len(full), -1)
    low = least[full]
    for k in range(reach - 1, -1, -1):
        at = np.where(small[full + k] == low, full + k, at)
    return small, full, at


def place_rows(keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """One row per place: the first of a hash in this batch under the hash (odd keys), the others under their document (even keys)."""
    order = np.argsort(keys, kind="stable")
    keys, doc, at = keys[order], doc[order], at[order]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    several = np.zeros(len(keys), bool)
    several[:-1] = same[1:]
    flag = np.where(same, KNOWN, np.where(several, FIRST, ALONE)).astype(np.int8)
    own = words.mix(doc.view(np.uint64)) & ~np.uint64(1)
    k = np.where(same, own, keys | np.uint64(1)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(flag), pa.array(doc), pa.array(at.astype(np.int32))], ["k", "flag", "doc", "at"])


def first_places(docs: DataFrame, size: int, base: int, reach: int) -> DataFrame:
    """Places of the lowest level over (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offsets = words.text_buffer(batch.column(1))
            parts = []
            for i, j in words.pieces(offsets):
                h, word_at = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                small, _, at = anchors(h, word_at, size, base, reach)
                at = np.unique(at)
                row = np.searchsorted(word_at, at, side="right") - 1
                parts.append((small[at], ids[i + row], at - word_at[row]))
            if parts:
                yield place_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return docs.mapInArrow(run, PLACES)


def repeated(places: DataFrame) -> DataFrame:
    """(doc, at) of the places whose hash occurs more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until the next one is known
        prior = None  # the key before it
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            if held is not None:
                now = [np.concatenate((a, b)) for a, b in zip(held, now, strict=True)]
            yield marked(now, prior, len(now[0]) - 1)
            prior = now[0][-2] if len(now[0]) > 1 else prior
            held = [c[-1:] for c in now]
        if held is not None:
            yield marked(held, prior, 1)

    def marked(rows: list[np.ndarray], prior: int | None, upto: int) -> pa.RecordBatch:
        k, flag, doc, at = rows
        same = np.zeros(len(k) + 1, bool)  # same[i]: row i has the key of row i - 1
        same[1:-1] = k[1:] == k[:-1]
        same[0] = prior is not None and k[0] == prior
        stays = ((flag > ALONE) | ((same[:-1] | same[1:]) & (k % 2 != 0)))[:upto]
        return pa.RecordBatch.from_arrays([pa.array(doc[:upto][stays]), pa.array(at[:upto][stays])], ["doc", "at"])

    return places.repartition("k").sortWithinPartitions("k").mapInArrow(run, "doc bigint, at int")


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, text, places) of the documents that have surviving places."""
    listed = cut(places.groupBy("doc").agg(F.collect_list("at").alias("places")))
    return split(docs, "doc", listed.select("doc"))[0].join(listed, "doc")


def lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Row of each list entry, and the entries."""
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), column.flatten()


def extended_places(found: DataFrame, size: int) -> DataFrame:
    """The surviving places at twice their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offsets = words.text_buffer(batch.column(1))
            row, at = lists(batch.column(2))
            at, parts = at.to_numpy(), []
            for i, j in words.pieces(offsets):
                h, word_at = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                longer, fits = words.window_hashes(h, size), words.inside(word_at, size)
                own = (row >= i) & (row < j)
                place = at[own] + word_at[row[own] - i]
                good = (place < len(longer)) & (at[own] < np.diff(word_at)[row[own] - i])
                good[good] = fits[place[good]]
                parts.append((longer[place[good]], ids[row[own][good]], at[own][good]))
            if parts:
                yield place_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return found.mapInArrow(run, PLACES)


def later(keys: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows have the key of another that stands before them. A repeated row of the same place is no other."""
    order = np.lexsort((at, th, doc, keys))
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
    out = np.zeros(len(k), bool)
    out[order] = (doc[first] != doc[order]) | (th[first] != th[order]) | (at[first] != at[order])
    return out


def full_windows(found: DataFrame, size: int, base: int, reach: int) -> DataFrame:
    """For each surviving place, the hashes of the full windows that it stands for, with what their batch already tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            buf, offsets = words.text_buffer(batch.column(1))
            row, place = lists(batch.column(2))
            place, parts = place.to_numpy(), []
            for i, j in words.pieces(offsets):
                h, word_at = word_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                small, full, at = anchors(h, word_at, size, base, reach)
                own = (row >= i) & (row < j)
                alive = np.zeros(len(h) + 1, bool)
                spot = place[own] + word_at[row[own] - i]
                alive[spot[(spot < word_at[row[own] - i + 1])]] = True
                on = alive[at]
                full, at = full[on], at[on]
                r = np.searchsorted(word_at, full, side="right") - 1
                parts.append((small[at], words.window_hashes(h, size)[full], ids[i + r], ths[i + r], full - word_at[r], at - word_at[r]))
            if not parts:
                continue
            key, whole, doc, th, start, spot = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(key):
                continue
            known = later(words.join_hashes(key, whole), doc, th, start)
            head = np.ones(len(key), bool)  # windows of one place follow each other
            head[1:] = (spot[1:] != spot[:-1]) | (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)
            heads = np.flatnonzero(head)
            counts = np.diff(np.append(heads, len(key)))
            settled = np.add.reduceat(~known, heads) == 0
            own_key = words.mix(doc[heads].view(np.uint64)) & ~np.uint64(1)
            k = np.where(settled, own_key, key[heads] | np.uint64(1)).view(np.int64)
            none = np.repeat(settled, counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(k), pa.array(doc[heads]), pa.array(th[heads]), pa.array(start[heads].astype(np.int32)),
                words.blobs(whole[~none], np.where(settled, 0, counts)), words.blobs(known.astype(np.uint8), counts)],
                ["k", "doc", "th", "at", "hashes", "flags"])

    return found.mapInArrow(run, WINDOWS)


def covered(windows: DataFrame) -> DataFrame:
    """(doc, th, at, flags) of the runs of windows of which some stand earlier too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64)]  # of the last key: k, key, doc, th, at
        for batch in batches:
            k, doc, th, at = (c.to_numpy() for c in batch.columns[:4])
            flag_bytes, flag_at = words.text_buffer(batch.column(5))
            hash_bytes, hash_at = words.text_buffer(batch.column(4))
            flags, counts = flag_bytes.copy(), np.diff(flag_at)
            open_row = np.flatnonzero(np.diff(hash_at) > 0)
            n = counts[open_row]
            whole = np.frombuffer(hash_bytes.tobytes(), np.uint64)
            kk, row = np.repeat(k[open_row], n), np.repeat(open_row, n)
            spot = words.ragged(flag_at[open_row], n)
            ask = flags[spot] == 0
            new = [kk[ask], words.join_hashes(kk[ask].view(np.uint64), whole[ask]), doc[row][ask], th[row][ask], (words.ragged(at[open_row].astype(np.int64), n))[ask]]
            old = len(firsts[0])
            both = [np.concatenate(x) for x in zip(firsts, new, strict=True)]
            late = later(*both[1:])
            flags[spot[ask][late[old:]]] = 1
            if len(both[0]):
                last = (both[0] == both[0][-1]) & ~late
                firsts = [x[last] for x in both]
            some = np.add.reduceat(flags, flag_at[:-1]) > 0 if len(flags) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[some]), pa.array(th[some]), pa.array(at[some]),
                words.blobs(flags[np.repeat(some, counts)], counts[some])], ["doc", "th", "at", "flags"])

    rows = windows.repartition("k").sortWithinPartitions("k", "doc", "th", "at")
    return rows.mapInArrow(run, "doc bigint, th bigint, at int, flags binary")


def kept_text(raw: bytes, gone: np.ndarray) -> bytes:
    return b" ".join(compress(raw.split(), (~gone).tolist()) if gone.any() else raw.split())


def without_repeats(docs: DataFrame, size: int = SIZE, base: int = BASE_SIZE, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    keep = docs.columns if keep is None else keep
    lengths = [base]
    while lengths[-1] < size:
        lengths.append(2 * lengths[-1])
    if lengths[-1] != size:
        raise ValueError(f"{size} is not {base} doubled again and again")
    reach = size - lengths[-2] + 1 if len(lengths) > 1 else 1
    if reach + base - 1 > size:
        raise ValueError("the base is too long for the window")
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast(LongType()).alias("doc"), F.col(text).alias("text"))
    places = repeated(first_places(own, size, base, reach))
    for length in lengths[1:-1]:
        places = repeated(extended_places(with_places(own, places), length))
    found = with_places(own, places).select("doc", "text", "places", F.xxhash64("text").alias("th"))
    runs = cut(covered(full_windows(found, size, base, reach)).groupBy("doc", "th").agg(F.collect_list(F.struct("at", "flags")).alias("runs")))

    names = []
    for name in ("n_words", "n_removed", "kept_text"):
        names.append(words.free_name([*keep, *names], name))
    body, doc, th = (words.free_name(keep, f"{x}_to_cut") for x in ("text", "doc", "hash"))
    given = docs.select(*keep, F.col(text).alias(body), F.col(id_col).cast(LongType()).alias(doc), F.xxhash64(F.col(text)).alias(th))
    runs = runs.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("runs").alias(words.free_name(keep, "runs_to_cut")))
    some, rest = split(given, doc, runs.select(doc))  # only texts that may lose words travel
    joined = some.join(runs, [doc, th], "left").unionByName(rest.withColumn(runs.columns[-1], F.lit(None).cast(runs.schema[-1].dataType)))
    joined = joined.select(*[f"`{c}`" for c in keep], body, runs.columns[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = words.text_buffer(batch.column(batch.num_columns - 2))
            row, entries = lists(batch.columns[-1])
            at = entries.field("at").to_numpy().astype(np.int64)
            flag_bytes, flag_at = words.text_buffer(entries.field("flags"))
            spot, of = words.ragged(at, np.diff(flag_at))[flag_bytes != 0], np.repeat(row, np.diff(flag_at))[flag_bytes != 0]
            for i, j in words.pieces(offsets):
                part, part_at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, word_at = words.word_spans(part, part_at)
                mine = (of >= i) & (of < j)
                gone = words.cover(int(word_at[-1]), spot[mine] + word_at[of[mine] - i], size)
                sums = np.concatenate(([0], np.cumsum(gone)))
                texts = [kept_text(part[part_at[r] : part_at[r + 1]].tobytes(), gone[word_at[r] : word_at[r + 1]]) for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(i, j - i) for c in batch.columns[:-2]), pa.array(np.diff(word_at)), pa.array(sums[word_at[1:]] - sums[word_at[:-1]]),
                    pa.array(texts, pa.binary()).cast(pa.string())], [*keep, *names])

    schema = docs.select(*keep).schema.add(names[0], LongType()).add(names[1], LongType()).add(names[2], "string")
    return joined.mapInArrow(run, schema)
