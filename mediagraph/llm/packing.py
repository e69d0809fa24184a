"""Best-fit packing (operator 10) of tokenised documents into sequences of bounded length, by hierarchical residual packing.

Each document is its ids and an end id; only longer ones are cut, into pieces of a full sequence, of which the first takes what is left
over. Every partition packs its pieces best-fit, longest first, and gives out the bins that are nearly full. The others become items
of the next round, in which several partitions' leftovers meet in one; round by round the tree narrows, until one partition packs the
last (or every one has as many as a task should take). A round is a written table, so a lost executor costs one round at most.

Defined cases: a null text is an empty document (its end id alone); repeated rows, rows of one id and null ids are documents of their own;
ties go by order of arrival, which doesn't change any length; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from mediagraph.llm import words
from mediagraph.llm.tokens import encoder
from mediagraph.session import cut

LENGTH, END_ID = 1024, 2
#: A bin with at most so many free places is given out at once; partitions that meet in one; bins that a task takes at most.
SLACK, FAN_IN, TASK_BINS = 4, 8, 200_000
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BIN = "length bigint, members array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>>"


def documents_as_pieces(docs: DataFrame, path: str, pattern: str, most: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Bins of one piece each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        if own is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                doc, piece, start, length, crc = [], [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = own.encode_ordinary(text or "") if own else library.encode(text or "", add_special_tokens=False).ids
                    raw = np.array([*ids, end_id], "<u4")
                    head = len(raw) - most * ((len(raw) - 1) // most)
                    for k, first in enumerate([0, *range(head, len(raw), most)]):
                        own_ids = raw[first : head if k == 0 else first + most]
                        doc.append(key), piece.append(k), start.append(first), length.append(len(own_ids)), crc.append(zlib.crc32(own_ids.tobytes()))
                columns = [pa.array(x, f.type) for x, f in zip((doc, piece, start, length, crc, [0] * len(doc)), MEMBER, strict=True)]
                at = pa.array(np.arange(len(doc) + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([columns[3], pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, fields=list(MEMBER)))], ["length", "members"])

    return docs.select(F.col(id_col).cast(LongType()), F.col(text)).mapInArrow(run, BIN)


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins of item indexes: longest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(most + 1)]  # bins by free places
    free = 0  # bit r: some bin has r free places
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                free ^= 1 << room
            bins[b].append(i)
        else:
            room, b = most, len(bins)
            bins.append([i])
        left = room - n
        if not open_[left]:
            free |= 1 << left
        open_[left].append(b)
    return bins


def merged(length: np.ndarray, members: pa.ListArray, most: int) -> tuple[np.ndarray, pa.ListArray]:
    """Bins packed from bins, with the members' places in them."""
    bins = best_fit(length, most)
    order = np.array([i for b in bins for i in b], np.int64)
    sizes = np.array([len(b) for b in bins], np.int64)
    at, flat = members.offsets.to_numpy().astype(np.int64), members.flatten()
    at = at - at[0]
    counts = np.diff(at)[order]
    flat = flat.take(pa.array(words.ragged(at[order], counts)))
    total = np.add.reduceat(length[order], np.concatenate(([0], np.cumsum(sizes)[:-1])))
    each = np.add.reduceat(counts, np.concatenate(([0], np.cumsum(sizes)[:-1])))
    own = flat.field("length").to_numpy()
    before = np.cumsum(own) - own
    heads = np.concatenate(([0], np.cumsum(each)[:-1]))
    offset = before - np.repeat(before[heads], each)
    fields = [flat.field(f.name) if f.name != "offset" else pa.array(offset) for f in MEMBER]
    where = pa.array(np.concatenate(([0], np.cumsum(each))).astype(np.int32))
    return total, pa.ListArray.from_arrays(where, pa.StructArray.from_arrays(fields, fields=list(MEMBER)))


def packed_round(bins: DataFrame, most: int, slack: int, task_bins: int) -> DataFrame:
    """Best-fit within each partition (in lots of at most `task_bins`); `full` tells which bins are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= task_bins:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        total, members = merged(table["length"].to_numpy(), table["members"].combine_chunks() if isinstance(table["members"], pa.ChunkedArray) else table["members"], most)
        return pa.RecordBatch.from_arrays([pa.array(total), members, pa.array(total >= most - slack)], ["length", "members", "full"])

    return bins.mapInArrow(run, f"{BIN}, full boolean")


def packed_bins(pieces: DataFrame, most: int = LENGTH, slack: int = SLACK, fan_in: int = FAN_IN, task_bins: int = TASK_BINS) -> DataFrame:
    """All bins, from the rounds that finished them."""
    now = cut(packed_round(pieces, most, slack, task_bins))
    parts, done = None, []
    while True:
        left = now.where("not full")
        n = left.count()
        least = -(-n // task_bins)
        if parts == 1 or n <= 1 or (parts is not None and parts <= least):
            return now.drop("full") if not done else done[0].unionByName(now.drop("full"))
        parts = max(1, least, -(-(parts or max(now.rdd.getNumPartitions(), fan_in)) // fan_in))
        finished = now.where("full").drop("full")
        done = [finished if not done else done[0].unionByName(finished)]
        now = cut(packed_round(left.drop("full").repartition(parts), most, slack, task_bins))


def packed_documents(docs: DataFrame, path: str, pattern: str, most: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    bins = packed_bins(documents_as_pieces(docs, path, pattern, most, end_id, id_col, text), most, **how)
    return bins.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
