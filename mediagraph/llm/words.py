"""Numpy views of Arrow text: byte buffers, word spans, 64-bit hashes of spans and of word windows.

Everything works on the UTF-8 bytes of a whole batch at once. Words are maximal runs of bytes other than space, tab, line feed,
vertical tab, form feed and carriage return, which in UTF-8 is the same as runs of such characters.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed at a time; bounds the scratch arrays to some tens of MB.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 row offsets into them. Null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and the row offsets among them."""
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), before[offsets]


def in_worker(key: str, make):
    """Build once per Python worker process: functions shipped to tasks lose their module's globals between tasks."""
    import sys

    kept = sys.__dict__.setdefault("_kept_in_worker", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Return freed memory to the system, Arrow's pool first: a Python worker waits beside the JVM between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may not offer it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (or one row), so that scratch arrays stay small however large a batch is."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
    if n and offsets[-1] > most:
        give_back()


def slices(batch: pa.RecordBatch, column: int = -1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of text, so that what is handed back is small as well."""
    _, offsets = text_buffer(batch.columns[column])
    for i, j in pieces(offsets, most):
        yield batch.slice(i, j - i)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 offsets of each row's words among them."""
    return spans(~IS_SPACE[buf], offsets)


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of set entries within a row, and the n + 1 offsets of each row's runs among them."""
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = word[edges]
    lasts = edges[edges > 0] - 1
    ends[lasts] = word[lasts]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes (or of code points). Spans are in order of their starts and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    most = min(BLOCK, len(buf))
    codes, up, down = byte_codes(), powers(BASE, most + 1), powers(INVERSE, most + 1)
    coded = (lambda x: codes[x]) if buf.dtype == np.uint8 else (lambda x: mix((x.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)))
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + most, side="right"))
        if j <= i:  # one span longer than a block
            out[i] = int.from_bytes(hashlib.blake2b(buf[lo : ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        part = buf[lo : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(coded(part) * up[: len(part)], dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of its first and its second part."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F) + np.uint64(1))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive entries of `h` (rows are not told apart). A window of 2n comes from two windows of n."""
    if size == 1:
        return h
    if len(h) < size:
        return np.zeros(0, np.uint64)
    half = size // 2
    part = window_hashes(h, half)
    n = len(h) - 2 * half + 1
    out = join_hashes(part[:n], part[half : half + n])
    if size % 2:
        n = len(h) - size + 1
        out = join_hashes(out[:n], h[size - 1 : size - 1 + n])
    return out


def inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` entries over rows laid end to end: whether it lies in one row."""
    total = int(offsets[-1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return row[: total - size + 1] == row[size - 1 :] if total >= size else np.zeros(0, bool)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ...: the entries of runs, one after another."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else np.zeros(0, np.int64)
    return np.arange(total) + shift


def cover(total: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of `total` entries lie in a window of `size` from one of `starts`."""
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, total), -1)
    return np.cumsum(marks[:-1]) > 0


def blobs(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary column: runs of `data`, `counts` entries each, in native bytes."""
    at = np.concatenate(([0], np.cumsum(counts * data.itemsize))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def free_name(columns: list[str], base: str) -> str:
    """`base`, or a variant that no column has (names compare without case, as Spark's do)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name
