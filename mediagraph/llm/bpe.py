"""Byte-level BPE encoding and decoding (operator 9), with overlapping chunks for long texts.

Texts of up to `chunk` characters are encoded where they are read. Longer ones are cut into overlapping chunks, which are rows of their own
and are split by the pattern in parallel. Where the starts of pre-tokens that two neighbours found in their overlap meet, both agree from
there on (the pattern looks only forward, and starts near a chunk's end are not trusted), so the text is cut there and the pieces are
encoded apart; ids are put together in order. If two neighbours never meet (one pre-token longer than the overlap), the rest of the
text from the last cut is one piece. Decoding puts the tokens' bytes together.

Defined cases: a null text is empty (no ids); repeated rows and rows of one id each give a row; a null id stays null; an empty table gives
an empty result. The vocabulary's path must be readable on every machine; it is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from mediagraph.llm.tokens import encoder, ranks_of
from mediagraph.llm.words import in_worker

CHUNK, OVERLAP = 32_768, 1_024
#: Starts in so many characters before a chunk's end may be the cut's doing.
UNSURE = 8


def id_lists(encode, texts: list[str | None]) -> pa.Array:
    ids = [encode(t) if t else [] for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.int32)))


def with_ids(rows: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """`rows` with `text` replaced by `ids`, each text encoded whole."""
    rest = [c for c in rows.columns if c != text]
    given = rows.select(*rest, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], id_lists(encode, part.columns[-1].to_pylist())], [*rest, "ids"])

    return given.mapInArrow(run, given.drop(text).schema.add("ids", ArrayType(IntegerType())))


def chunks(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, th, part, first, size, text, heads, tails): overlapping chunks of each long text, and where pre-tokens start in the overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern)
        for batch in batches:
            for doc, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for part, first in enumerate(range(0, len(text), chunk)):
                    own = text[first : first + chunk + overlap]
                    sure = len(own) if first + len(own) == len(text) else len(own) - UNSURE
                    # not after white space: a run of it is split differently where a piece ends
                    starts = np.array([a for m in find.finditer(own) if (a := m.start()) == 0 or not own[a - 1].isspace()], np.int64)
                    starts = starts[starts < sure]
                    heads, tails = starts[starts < overlap] + first, starts[starts >= chunk] + first
                    rows.append((doc, th, part, first, len(text), own, heads.tolist(), tails.tolist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names)

    names = ["doc", "th", "part", "first", "size", "text", "heads", "tails"]
    return docs.select("doc", "th", "text").mapInArrow(run, "doc bigint, th bigint, part int, first bigint, size bigint, text string, heads array<bigint>, tails array<bigint>")


def stitched(parts: DataFrame, chunk: int) -> DataFrame:
    """(doc, th, piece, text): pieces that lie end to end, cut where neighbours' pre-tokens meet."""
    order = Window.partitionBy("doc", "th").orderBy("part")
    cut = F.when(F.col("part") == 0, F.lit(0).cast("bigint")).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(order))))
    rows = parts.dropDuplicates(["doc", "th", "part"]).withColumn("cut", cut)
    # from the first place where neighbours don't meet, the rest is one piece, cut at the chunks' own starts to be put together again
    rows = rows.withColumn("lost", F.max(F.col("cut").isNull()).over(order))
    rows = rows.withColumn("begin", F.when(F.col("lost"), F.col("first")).otherwise(F.col("cut")))
    rows = rows.withColumn("piece", F.sum((~F.col("lost")).cast("int")).over(order))
    rows = rows.withColumn("end", F.coalesce(F.lead("begin").over(order), F.col("size")))
    slices = rows.select("doc", "th", "piece", "part", F.substr("text", (F.col("begin") - F.col("first") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("text"))
    together = slices.groupBy("doc", "th", "piece").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("slices"))
    return together.select("doc", "th", "piece", F.concat_ws("", F.col("slices.text")).alias("text"))


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row."""
    own = docs.select(F.col(id_col).cast(LongType()).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = with_ids(own.where(~long).select("doc", "text"), "text", path, pattern)
    split = own.where(long)
    pieces = with_ids(stitched(chunks(split, pattern, chunk, overlap), chunk), "text", path, pattern)
    whole = pieces.groupBy("doc", "th").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    # rows that repeat an id and a text were encoded once
    times = split.groupBy("doc", "th").agg(F.count(F.lit(1)).cast("int").alias("times"))
    again = whole.join(times, (whole["doc"].eqNullSafe(times["doc"])) & (whole["th"] == times["th"])).select(whole["doc"], "ids", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("again"))
    return short.unionByName(again.drop("again")).withColumnRenamed("doc", "doc_id")


def token_bytes(path: str, pattern: str) -> list[bytes]:
    """The bytes of each id."""
    own = encoder(path, pattern)
    out = [b""] * own.n_vocab
    for token, i in ranks_of(path).items():
        out[i] = token
    return out


def digests(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) over (doc_id, ids): digests of the ids and of the bytes that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        own = encoder(path, pattern)
        names = in_worker(f"numbers {path}", lambda: [str(i) for i in range(own.n_vocab)])
        table = in_worker(f"bytes {path}", lambda: token_bytes(path, pattern))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lists = part.column(1).to_pylist()
                said = [hashlib.sha256(",".join([names[x] for x in ids]).encode()).hexdigest() for ids in lists]
                back = [hashlib.sha256(b"".join([table[x] for x in ids])).hexdigest() for ids in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text_bytes) over (doc_id, ids): the tokens' bytes, put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join([table[x] for x in ids]) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "text_bytes"])

    return rows.mapInArrow(run, "doc_id bigint, text_bytes binary")
