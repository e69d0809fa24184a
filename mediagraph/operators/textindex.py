"""A stored text index: segments of postings sorted by term, in blocks that tell the best a document in them can score.

A block holds one term's postings among `WIDTH` consecutive document ids, with their number, the greatest weighted frequency and the least
document length; a bm25 bound follows from these under any corpus statistics, which are sums kept in the log. Each batch of documents is
a segment; `merge` makes one of many.

A query reads the files whose term range it touches, in them the row groups and pages of its terms, and of most blocks only the heads:

* all words are required, so spans of ids in which a word has no block are out;
* `top` scores the most promising spans first; what is left is read only where its bound reaches the least score wanted.

Nothing is approximate: scores are those of a scan over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.functions import text as tx
from mediagraph.operators.search import B, IDF_FLOOR, K1, WEIGHTS, SearchTerms
from mediagraph.session import cut
from mediagraph.sources.tablelog import Piece, TableLog

ENTRY = "struct<doc: bigint, tf: int, af: int, tl: int, al: int>"
ROWS = f"term string, span bigint, n bigint, w_max double, len_min bigint, entries array<{ENTRY}>"
WIDTH = 1024
FIRST_SPANS = 8
#: Postings that a task gathers before it hands them on as blocks.
HELD = 1 << 20


def weight(entry: Column) -> Column:
    return entry["tf"] * WEIGHTS["title"] + entry["af"] * WEIGHTS["about"]


def entries_of(fields: list[np.ndarray], none: np.ndarray) -> pa.StructArray:
    doc, tf, af, tl, al = fields
    return pa.StructArray.from_arrays([pa.array(doc, pa.int64(), mask=none), *[pa.array(x, pa.int32()) for x in (tf, af, tl, al)]], ["doc", "tf", "af", "tl", "al"])


def boxed(terms: pa.Array, fields: list[np.ndarray], none: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Blocks of postings in the order of term and document. `starts` are the blocks' first postings, `none` tells postings without an id."""
    doc, tf, af, tl, al = fields
    ends = np.append(starts[1:], len(doc))
    weights = tf * WEIGHTS["title"] + af * WEIGHTS["about"]
    entries = pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)).astype(np.int32)), entries_of(fields, none))
    return pa.RecordBatch.from_arrays([
        terms, pa.array(doc[starts] // WIDTH, mask=none[starts]), pa.array(ends - starts), pa.array(np.maximum.reduceat(weights, starts)),
        pa.array(np.minimum.reduceat((tl + al).astype(np.int64), starts)), entries], ["term", "span", "n", "w_max", "len_min", "entries"])


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, title, about), those of a few texts at a time: a term and span can have several. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = tx.IndexWords(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(said(words, part))
                size += len(held[-1][0])
                if size > HELD:
                    yield made(words, held)
                    words.forget()
                    held, size = [], 0
        if size:
            yield made(words, held)

    def said(words: tx.IndexWords, part: pa.RecordBatch) -> list[np.ndarray]:
        """(number, doc, none, tf, af, tl, al) of the terms of each text."""
        (row, number, freq, tl), (row_a, number_a, freq_a, al) = (words.counted(part.column(i).to_pylist()) for i in (1, 2))
        both, back = np.unique(np.concatenate((row << 32 | number, row_a << 32 | number_a)), return_inverse=True)
        tf, af = np.zeros(len(both), np.int32), np.zeros(len(both), np.int32)
        tf[back[: len(row)]], af[back[len(row) :]] = freq, freq_a
        row, doc = both >> 32, part.column(0)
        return [both & 0xFFFFFFFF, doc.fill_null(0).to_numpy()[row], doc.is_null().to_numpy(zero_copy_only=False)[row], tf, af, tl[row].astype(np.int32), al[row].astype(np.int32)]

    def made(words: tx.IndexWords, held: list[list[np.ndarray]]) -> pa.RecordBatch:
        number, doc, none, *counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, none, number))
        number, doc, none = number[order], doc[order], none[order]
        fresh = np.ones(len(number), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (none[1:] != none[:-1]) | (doc[1:] // WIDTH != doc[:-1] // WIDTH)
        starts = np.flatnonzero(fresh)
        return boxed(words.terms(number[starts]), [doc, *(x[order] for x in counts)], none, starts)

    return docs.select(F.col("doc_id").cast("bigint"), "title", "about").mapInArrow(run, ROWS)


def joined(rows: DataFrame) -> DataFrame:
    """Sorted blocks with those of one term and span made one: at most WIDTH entries each, however frequent a term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # blocks of the last term and span, which may go on in the next batch
        for batch in (part for whole in batches for part in parts(whole)):
            now = pa.Table.from_batches([batch.select(["term", "span", "entries"])])
            now = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
            if not now.num_rows:
                continue
            fresh = starts_of(now)
            last = int(np.flatnonzero(fresh)[-1])
            rest = now.slice(last)
            if last:
                yield merged(now.slice(0, last), fresh[:last])
        if rest is not None:
            yield merged(rest, starts_of(rest))

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Blocks of about `HELD` postings at a time."""
        nth = np.cumsum(batch["n"].to_numpy()) // HELD
        cuts = [0, *(np.flatnonzero(np.diff(nth)) + 1).tolist(), batch.num_rows]
        return (batch.slice(a, z - a) for a, z in zip(cuts, cuts[1:], strict=False))

    def starts_of(rows: pa.Table) -> np.ndarray:
        fresh = np.ones(rows.num_rows, bool)
        term, span = rows["term"].combine_chunks(), rows["span"].combine_chunks()
        none, span = span.is_null().to_numpy(zero_copy_only=False), span.fill_null(0).to_numpy()
        fresh[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1]) | (span[1:] != span[:-1])
        return fresh

    def merged(rows: pa.Table, fresh: np.ndarray) -> pa.RecordBatch:
        lists = rows["entries"].combine_chunks()
        block = np.repeat(np.cumsum(fresh) - 1, lists.value_lengths().to_numpy())
        flat = lists.flatten()
        doc, *counts = (flat.field(k) for k in range(5))
        none, doc, (tf, af, tl, al) = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), (x.to_numpy() for x in counts)
        order = np.lexsort((doc, block))
        if ((block[order][1:] == block[order][:-1]) & (doc[order][1:] == doc[order][:-1])).any():
            order = np.lexsort((al, tl, doc, none, block))
        block, doc, none, tf, af, tl, al = (x[order] for x in (block, doc, none, tf, af, tl, al))
        own = np.ones(len(doc), bool)  # rows of one id with as many words are one document
        own[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]) | (none[1:] != none[:-1]) | (tl[1:] != tl[:-1]) | (al[1:] != al[:-1])
        first = np.flatnonzero(own)
        fields = [doc[first], np.add.reduceat(tf, first), np.add.reduceat(af, first), tl[first], al[first]]
        return boxed(rows["term"].combine_chunks().take(pa.array(np.flatnonzero(fresh))), fields, none[first], np.flatnonzero(np.diff(block[first], prepend=-1)))

    return rows.mapInArrow(run, ROWS)


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.log = TableLog(spark, folder)

    def add(self, docs: DataFrame, batch: int) -> int | None:
        """Add a segment. A batch that is already in stays as it is; ids must be new."""
        if self.log.state().batches.get("index", -1) >= batch:
            return None
        made = cut(blocks(docs))
        length = made.agg(F.coalesce(F.sum(F.aggregate("entries", F.lit(0).cast("bigint"), lambda s, e: s + e["tf"] + e["af"])), F.lit(0))).first()[0]
        return self.log.commit(self._segment(made, batch), batches={"index": batch}, notes={"docs": docs.count(), "length": length})

    def _segment(self, made: DataFrame, batch: int | None) -> list[Piece]:
        return self.log.write(joined(made.repartitionByRange("term", "span").sortWithinPartitions("term", "span")), batch=batch, bounds="term")

    def merge(self, least: int = 4) -> int:
        """Make one segment of all, if there are at least `least`; how many there were. Blocks of one term and span become one."""
        old = self.log.picked()
        segments = len({p.batch for p in old})
        if segments < least:
            return 0
        self.log.commit(self._segment(self.log.read_pieces(ROWS, old), max(p.batch for p in old)), old)
        return segments

    # ------------------------------------------------------------ reading

    def _files(self, terms: SearchTerms) -> list[Piece]:
        def touched(p: Piece) -> bool:
            if p.low is None:
                return False  # an empty file
            return any(p.low <= t <= p.high for t in terms.whole) or (p.high >= terms.prefix and (p.low <= terms.prefix or p.low.startswith(terms.prefix)))

        return self.log.picked(keep=touched)

    def _blocks(self, terms: SearchTerms) -> DataFrame:
        """Blocks of the query's terms, once for each phrase they are of."""
        tests = [F.col("term") == t for t in terms.whole] + [F.col("term").startswith(terms.prefix)]
        wanted = tests[0]
        for test in tests[1:]:
            wanted = wanted | test
        phrases = F.filter(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)]), lambda x: x.isNotNull())
        return self.log.read_pieces(ROWS, self._files(terms)).where(wanted).withColumn("phrase", F.explode(phrases))

    def _statistics(self) -> tuple[float, float]:
        notes = self.log.state().notes
        docs = notes.get("docs", 0)
        return float(docs), notes.get("length", 0) / docs if docs else 1.0

    def _part(self, idf: Column, w: Column, length: Column, mean: float) -> Column:
        return idf * (w * (K1 + 1)) / (w + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(mean or 1.0)))

    def _idf(self, frequencies: dict[int, int], docs: float) -> Column:
        """Weight of a row's phrase."""
        out = F.lit(IDF_FLOOR)
        for phrase, df in frequencies.items():
            out = F.when(F.col("phrase") == phrase, F.greatest(F.log(F.lit((docs - df + 0.5) / (df + 0.5))), F.lit(IDF_FLOOR))).otherwise(out)
        return out

    def _frequencies(self, found: DataFrame, heads: DataFrame, terms: SearchTerms) -> dict[int, int]:
        """Documents of each phrase (20 at most): from the heads; the ids are read only where several words begin with the last one."""
        last = len(terms.whole)
        told = {r["phrase"]: (r["n"], r["terms"]) for r in heads.groupBy("phrase").agg(F.sum("n").alias("n"), F.count_distinct("term").alias("terms")).collect()}
        out = {k: n for k, (n, _) in told.items()}
        if told.get(last, (0, 0))[1] > 1:
            out[last] = found.where(F.col("phrase") == last).select(F.explode("entries.doc").alias("doc")).distinct().count()
        return out

    def _scored(self, found: DataFrame, terms: SearchTerms, frequencies: dict[int, int]) -> DataFrame:
        docs, mean = self._statistics()
        entry = F.col("e")
        hits = found.select("phrase", F.explode("entries").alias("e")).groupBy(entry["doc"].alias("doc_id"), "phrase").agg(
            F.sum(weight(entry)).alias("w"), F.first(entry["tl"] + entry["al"]).alias("length"))
        scores = hits.groupBy("doc_id").agg(F.sum(self._part(self._idf(frequencies, docs), F.col("w"), F.col("length"), mean)).alias("score"), F.count("*").alias("_n"))
        return scores.where(F.col("_n") == len(terms.whole) + 1).drop("_n")

    def _none(self) -> DataFrame:
        return self.log.spark.createDataFrame([], "doc_id bigint, score double")

    def ranked(self, query: str) -> DataFrame:
        """(doc_id, score) of all documents with all words of the query."""
        terms = SearchTerms.parse(query)
        if terms is None:
            return self._none()
        found = self._blocks(terms)
        frequencies = self._frequencies(found, found.select("phrase", "term", "n"), terms)
        return self._scored(self._shared(found, terms), terms, frequencies)

    def _shared(self, found: DataFrame, terms: SearchTerms) -> DataFrame:
        """Blocks in spans of ids that have all phrases."""
        if not terms.whole:
            return found
        spans = found.select("span", "phrase").groupBy("span").agg(F.count_distinct("phrase").alias("_n")).where(F.col("_n") == len(terms.whole) + 1)
        return found.join(spans.select("span"), "span", "left_semi")

    def matching(self, query: str) -> DataFrame:
        """(doc_id) of all documents with all words of the query."""
        terms = SearchTerms.parse(query)
        if terms is None:
            return self._none().select("doc_id")
        rows = self._shared(self._blocks(terms), terms).select("phrase", F.explode("entries.doc").alias("doc_id")).distinct()
        return rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(terms.whole) + 1).select("doc_id")

    def top(self, query: str, k: int, slack: float = 0.0, seen: dict | None = None) -> DataFrame:
        """(doc_id, score) of every document that scores at least the k-th best score less `slack`: the k best and what ties with them. `seen` takes the numbers
        of spans that could match and of those that were read."""
        terms = SearchTerms.parse(query)
        if terms is None:
            return self._none()
        found = self._blocks(terms)
        heads = cut(found.select("phrase", "term", "span", "n", "w_max", "len_min"))  # short rows: a block each
        frequencies = self._frequencies(found, heads, terms)
        docs, mean = self._statistics()
        per = heads.groupBy("span", "phrase").agg(F.sum("w_max").alias("w"), F.min("len_min").alias("length"))
        bounds = cut(per.groupBy("span").agg(
            F.sum(self._part(self._idf(frequencies, docs), F.col("w"), F.col("length"), mean)).alias("bound"), F.count("*").alias("_n")).where(F.col("_n") == len(terms.whole) + 1).drop("_n"))
        first = [r["span"] for r in bounds.orderBy(F.desc("bound"), "span").limit(max(k, FIRST_SPANS)).collect()]
        if not first:
            return self._none()

        def kth(scores: DataFrame) -> tuple[float, int]:
            return scores.orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()

        # the k-th of the first spans is at most the k-th of all
        least = kth(self._scored(found.where(F.col("span").isin(first)), terms, frequencies))
        rest = bounds if least[1] < k else bounds.where(F.col("bound") >= least[0] * (1 - 1e-9) - slack)
        if seen is not None:
            seen |= {"spans": bounds.count(), "read": rest.select("span").unionByName(bounds.where(F.col("span").isin(first)).select("span")).distinct().count()}
        scores = cut(self._scored(found.join(rest.select("span"), "span", "left_semi"), terms, frequencies))
        least = kth(scores)
        return scores if least[1] < k else scores.where(F.col("score") >= least[0] - slack)

    def postings(self) -> DataFrame:
        """(term, doc_id, field, freq, field_len) of everything in the index."""
        e = F.col("e")
        fields = F.array(F.struct(F.lit("title").alias("field"), e["tf"].alias("freq"), e["tl"].alias("field_len")), F.struct(F.lit("about").alias("field"), e["af"].alias("freq"), e["al"].alias("field_len")))
        rows = self.log.read(ROWS).select("term", F.explode("entries").alias("e")).select("term", e["doc"].alias("doc_id"), F.inline(fields)).where("freq > 0")
        return rows.select("term", "doc_id", "field", F.col("field_len").cast("bigint").alias("field_len"), F.col("freq").cast("bigint").alias("freq"))
