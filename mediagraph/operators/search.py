"""Text search over headlines and what they are about: match, postings, ranking, highlighting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediagraph.functions import text as tx
from mediagraph.session import cut

K1, B = 1.2, 0.75
WEIGHTS = {"title": 10.0, "about": 1.0}
IDF_FLOOR = 1e-6


@dataclass(frozen=True)
class SearchTerms:
    """A query as the index applies it: every word whole, the last one as the start of a word."""

    whole: tuple[str, ...]
    prefix: str

    @classmethod
    def parse(cls, query: str) -> SearchTerms | None:
        words = [tx.fold_as_columns(w) for w in re.findall(r"\w+", query)]
        words = [piece for w in words for piece in re.split(r"[^\w]|_", w) if piece]
        return cls(tuple(words[:-1]), words[-1]) if words else None

    def hits_word(self, word: Column) -> Column:
        """`word` is already folded."""
        return word.isin(*self.whole) | word.startswith(self.prefix) if self.whole else word.startswith(self.prefix)

    def matches(self, *texts: Column) -> Column:
        """All words required, each in any of the texts."""
        words = F.flatten(F.array(*[F.coalesce(tx.index_tokens(t), F.array().cast("array<string>")) for t in texts]))
        test = F.exists(words, lambda w: w.startswith(self.prefix))
        for w in self.whole:
            test = test & F.array_contains(words, w)
        return test


def build_postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, field, freq, field_len) of the `title` and `about` texts. Bucket by term when stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = tx.IndexWords(), ["term", "doc_id", "field", "field_len", "freq"]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for field in ("title", "about"):
                    row, number, freq, sizes = words.counted(batch[field].to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [words.terms(number), batch["doc_id"].take(pa.array(row)), pa.array([field] * len(row), pa.string()), pa.array(sizes[row]), pa.array(freq)], names)
                words.forget()

    texts = docs.select("doc_id", "title", "about")
    schema = T.StructType().add("term", T.StringType()).add("doc_id", docs.schema["doc_id"].dataType).add("field", T.StringType()).add("field_len", T.LongType()).add("freq", T.LongType())
    # rows of one id with as many words are one document
    return texts.mapInArrow(run, schema).groupBy("term", "doc_id", "field", "field_len").agg(F.sum("freq").alias("freq"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_len): the words of both texts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tx.IndexWords()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                said = sum(words.counted(batch[field].to_pylist())[3] for field in ("title", "about"))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(said.astype(float))], ["doc_id", "doc_len"])
                words.forget()

    return docs.select("doc_id", "title", "about").mapInArrow(run, T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("doc_len", T.DoubleType()))


def store_postings(postings: DataFrame, table: str, buckets: int = 256) -> None:
    """A bucketed table: looking terms up reads only their buckets, and joins on term need no shuffle."""
    postings.write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(table)


def _frequencies(terms: SearchTerms) -> list[tuple[Column, ...]]:
    """Per phrase: how often it occurs in the title words and in the about words."""
    equals = lambda term: lambda w: w == term
    tests = [equals(t) for t in terms.whole] + [lambda w: w.startswith(terms.prefix)]
    return [tuple(F.size(F.filter(F.col(words), test)).cast("double") for words in ("_tw", "_aw")) for test in tests]


def rank(docs: DataFrame, query: str) -> DataFrame:
    """(doc_id, score): documents matching the whole query, with bm25 over the weighted fields.

    One scan tokenises each document once and counts its phrases in place. The counts, a few numbers per document, are written out
    because they are read twice: for the one-row statistics (document count, average length, documents per phrase) and for the scores.
    """
    terms = SearchTerms.parse(query)
    if terms is None:
        return docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    words = docs.select(
        "doc_id",
        tx.index_tokens(F.coalesce(F.col("title"), F.lit(""))).alias("_tw"),
        tx.index_tokens(F.coalesce(F.col("about"), F.lit(""))).alias("_aw"),
    )
    freq = _frequencies(terms)
    counted = cut(words.select(
        "doc_id",
        (F.size("_tw") + F.size("_aw")).cast("double").alias("_len"),
        *[f.alias(f"_t{i}") for i, (f, _) in enumerate(freq)],
        *[f.alias(f"_a{i}") for i, (_, f) in enumerate(freq)],
    ))
    n = range(len(freq))
    stats = counted.agg(
        F.count("*").alias("_docs"),
        F.avg("_len").alias("_avg"),
        *[F.count_if(F.col(f"_t{i}") + F.col(f"_a{i}") > 0).alias(f"_df{i}") for i in n],
    )
    every = F.lit(True)
    score = F.lit(0.0)
    for i in n:
        hits = F.col(f"_t{i}") + F.col(f"_a{i}")
        every = every & (hits > 0)
        weighted = F.col(f"_t{i}") * WEIGHTS["title"] + F.col(f"_a{i}") * WEIGHTS["about"]
        idf = F.greatest(F.log((F.col("_docs") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(IDF_FLOOR))
        damp = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_len") / F.col("_avg"))
        score = score + idf * (weighted * (K1 + 1)) / (weighted + damp)
    # `stats` is a global aggregate: exactly one row.
    return counted.where(every).crossJoin(F.broadcast(stats)).select("doc_id", score.alias("score"))


def rank_postings(postings: DataFrame, doc_lengths: DataFrame, query: str) -> DataFrame:
    """The same ranking from stored postings: reads only the query's terms."""
    terms = SearchTerms.parse(query)
    if terms is None:
        return doc_lengths.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
    phrases = [(i, F.col("term") == t) for i, t in enumerate(terms.whole)]
    phrases.append((len(terms.whole), F.col("term").startswith(terms.prefix)))
    wanted = F.filter(F.array(*[F.when(test, F.lit(i)) for i, test in phrases]), lambda x: x.isNotNull())
    weight = F.when(F.col("field") == "title", WEIGHTS["title"]).otherwise(WEIGHTS["about"])
    test_any = phrases[0][1]
    for _, test in phrases[1:]:
        test_any = test_any | test
    # a few numbers per document, written out because they are read twice
    freq = cut(
        postings.where(test_any)
        .select("doc_id", F.explode(wanted).alias("phrase"), (F.col("freq") * weight).alias("w"))
        .groupBy("doc_id", "phrase").agg(F.sum("w").alias("w"))
    )
    stats = doc_lengths.agg(F.count("*").alias("_docs"), F.avg("doc_len").alias("_avg"))
    df = freq.groupBy("phrase").agg(F.count("*").alias("_df"))  # at most 20 phrases
    idf = F.greatest(F.log((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(IDF_FLOOR))
    damp = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("_avg"))
    return (
        freq.join(F.broadcast(df), "phrase").join(doc_lengths, "doc_id").crossJoin(F.broadcast(stats))
        .groupBy("doc_id")
        .agg(F.sum(idf * F.col("w") * (K1 + 1) / (F.col("w") + damp)).alias("score"), F.count("*").alias("_phrases"))
        .where(F.col("_phrases") == len(phrases)).drop("_phrases")
    )


def highlight(c: Column, query: str) -> Column:
    """array<struct<text, marked>>: the text in pieces, matching words marked; for the last word of the query only
    the part of the original spelling that makes up the prefix."""
    terms = SearchTerms.parse(query)
    pieces = F.regexp_extract_all(c, F.lit(f"({tx.WORD}|(?:(?!{tx.WORD})[\\s\\S])+)"), F.lit(1))
    plain = lambda p: F.array(F.struct(p.alias("text"), F.lit(False).alias("marked")))
    if terms is None:
        return F.flatten(F.transform(pieces, plain))
    marked = lambda p: F.struct(p.alias("text"), F.lit(True).alias("marked"))

    def mark(p: Column) -> Column:
        folded = tx.normalize_text(p)
        # An expanding letter folds to more than one: the shortest head whose folding is the prefix.
        cuts = F.filter(F.sequence(F.lit(1), F.length(p)), lambda i: tx.normalize_text(F.left(p, i)) == terms.prefix)
        cut = F.coalesce(F.get(cuts, F.lit(0)), F.length(p))
        tail = F.substr(p, cut + 1)
        partly = F.when(tail == "", F.array(marked(p))).otherwise(
            F.array(marked(F.left(p, cut)), F.struct(tail.alias("text"), F.lit(False).alias("marked"))))
        whole = folded.isin(*terms.whole) if terms.whole else F.lit(False)
        return F.when(whole, F.array(marked(p))).when(folded.startswith(terms.prefix), partly).otherwise(plain(p))

    return F.flatten(F.transform(pieces, mark))


def matched_names(about: Column, title: Column, query: str) -> Column:
    """The names of `about` (an array) the query hits; none when the headline already shows the hit."""
    terms = SearchTerms.parse(query)
    none = F.array().cast("array<string>")
    if terms is None:
        return none
    hit = lambda t: F.exists(tx.word_tokens(tx.normalize_text(t)), terms.hits_word)
    return F.when(hit(title), none).otherwise(F.filter(about, hit))
