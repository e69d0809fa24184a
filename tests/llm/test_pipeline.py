"""The pipeline stage by stage, and the registered queries on the smallest tables."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_ngram_jaccard, test_substring_dedup
from tests.llm.test_text_models import plain_counts

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean texts in two languages, junk, near copies, a passage that many share, and rows with nulls."""
    rng, folder = random.Random(12), tmp_path_factory.mktemp("tables")
    speech = {"aa": ["the", "and", "thing", "er", "tion", "of"], "bb": ["der", "und", "keit", "sch", "ung", "ein"]}
    word = lambda lang: "".join(rng.choice(speech[lang]) for _ in range(rng.randrange(1, 4)))
    passage = [word("aa") for _ in range(60)]
    rows, labels = [], []
    for i in range(240):
        lang = "bb" if i % 3 == 0 else "aa"
        if i % 5 == 4 and i > 20:
            text = rows[i - 10][1]
            found = text.split(" ")
            found[rng.randrange(len(found))] = word(lang)
            text = text if i % 2 else " ".join(found)
            lang = rows[i - 10][2]
        else:
            found = [word(lang) for _ in range(rng.randrange(80, 300))]
            if i % 7 == 0 and lang == "aa":
                found[40:40] = passage
            text = " ".join(found)
        if i % 11 == 5:
            text = " ".join(w.removesuffix("***") + "***" for w in text.split(" "))
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
        labels.append((i, 0 if "***" in text else 1, 0))
    rows += [(500, None, "aa", None, None), (501, "", None, "s", 0), (502, "1 2 3 4 5 6 7 8 9 10 11 12", "aa", "s", 26)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r for r in rows}


def test_stages_take_effect(spark, tables):
    folder, given = tables
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {name: {r.doc_id: r.text for r in rows} for name, rows in kept.items() if name != "best_fit_packing"}

    judged = texts["quality_rules"]
    for i, row in given.items():
        n, _, _, _, repeats = plain_counts(row[1])
        if i in judged:
            assert n >= 10 and 100 * repeats <= 20 * n
    junk = {i for i in range(240) if "***" in given[i][1]}
    assert not junk & set(judged) and len(judged) >= 0.95 * (240 - len(junk))

    spoken = texts["language_id"]
    assert 502 not in spoken and len(spoken) >= 0.97 * len([i for i in judged if i != 502])
    assert sum(r.lang == given[r.doc_id][2] for r in kept["language_id"]) >= 0.97 * len(spoken)

    groups = test_ngram_jaccard.plain(list(spoken.items()))
    assert set(texts["ngram_jaccard"]) == {i for i, (_, root) in groups.items() if root == i} and len(texts["ngram_jaccard"]) < len(spoken)

    want = test_substring_dedup.plain(list(texts["ngram_jaccard"].items()))
    cleaned = {r.doc_id: r for r in kept["substring_dedup"]}
    assert any(gone for _, gone, _ in want.values())
    for i, (_, gone, text) in want.items():
        assert cleaned[i].text == (text if gone else texts["ngram_jaccard"][i]) and cleaned[i].n_chars == len(cleaned[i].text)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sums = {r.doc_id: 0 for r in kept["best_fit_packing"]}
    for r in kept["best_fit_packing"]:
        sums[r.doc_id] += r.length
    assert set(sums) == set(cleaned)
    for r in kept["best_fit_packing"]:
        ids = [*library.encode(cleaned[r.doc_id].text, add_special_tokens=False).ids, 2]
        assert sums[r.doc_id] == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_near_copies_are_five_words_and_80_percent(spark):
    base = [f"w{i}" for i in range(800)]
    edited = lambda n: " ".join(f"x{i}" if i % 40 == 20 and i < 40 * n else w for i, w in enumerate(base))
    given = [(1, " ".join(base)), (2, edited(17)), (3, edited(20))]
    sets = {i: test_ngram_jaccard.shingles(text, 5) for i, text in given}
    near = {i for i in (2, 3) if 100 * len(sets[1] & sets[i]) >= 80 * len(sets[1] | sets[i])}
    docs = spark.createDataFrame([(i, text, "aa", "s", len(text)) for i, text in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 3"), "").collect()}
    assert near == {2} and kept == {1}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.where("doc_id <> 2"), "").collect()} == {1, 3}


def test_near_copies_on_repeated_ids(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    given = [(1, one), (2, other), (2, other), (3, one), (3, "a text of its own that nothing else is near to"), (4, None), (4, None), (None, one)]
    docs = spark.createDataFrame([(i, text, "aa", "s", 1) for i, text in given], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert kept == sorted([(1, one), (2, other), (3, given[4][1]), (4, ""), (4, ""), (0, one)])


def test_run_gives_the_last_stage(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 100


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_queries_are_registered_and_cover_their_tables(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    for k in range(1, 11):
        assert sum(n.startswith(f"op{k}_") for n in names) == 1
    assert "pipeline" in entry.queries()
    table = {"op4_warc": "pages", "op5_url_filters": "pages", "op7_html_text": "pages", "op8_embedding_dedup": "embeddings"}
    for name in names:
        if name != "op10_packing":
            rows = spark.read.parquet(f"{FOLDER}/{table.get(name, 'documents')}.parquet").count()
            assert (name, entry.queries()[name](spark, str(FOLDER)).count()) == (name, rows)


def test_columns_called_as_the_stages_own(spark, tables):
    from pyspark.sql import functions as F

    folder, _ = tables
    extra = {"kept": F.lit(False), "stats": F.lit(1), "language": F.lit("x"), "n_removed": F.lit(7), "kept_text": F.lit("k"), "th": F.lit(5), "row": F.lit("r"), "stays": F.lit(False)}
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:4]:
        want, got = stage(spark, plain, folder), stage(spark, docs, folder)
        assert got.columns == docs.columns
        key = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
        assert key(got) == key(want), name
        assert [tuple(r) for r in got.select(*extra).distinct().collect()] == [(False, 1, "x", 7, "k", 5, "r", False)]


def test_empty_table(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, folder).count() == 0
