from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from mediagraph.llm import bpe, packing
from mediagraph.llm.tokens import rank_file, vocabulary_file

PATTERN = public_tokenizers.PATTERN
MULTI, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "don't  stop'll  \n\n x\t ", "日本語 テキスト　1234 ½", "🙂🙂 it's\r\n", "<|endoftext|> plain", "x" * 700, " " * 300 + "y", "é   z"]


def texts(seed, n):
    rng = random.Random(seed)
    letters = list("abcdefg  \n\t'.,!1234éßñ日本🙂 ") + ["'ll", "'re ", "   ", "The "]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 900))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 1_024), (64, 40), (20, 10)])
def test_encoding_is_that_of_the_library(spark, chunk, overlap):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=rank_file(MULTI), special_tokens={})
    rows = [(i, t) for i, t in enumerate(texts(1, 150))] + [(3, "a"), (9, ODD[8]), (9, ODD[8])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    ids = bpe.encoded(docs, MULTI, PATTERN, chunk=chunk, overlap=overlap).cache()
    want = sorted((i, own.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == want
    said = sorted(tuple(r) for r in bpe.digests(ids, MULTI, PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert said == sorted((i, len(x), sha(",".join(map(str, x)).encode()), sha(own.decode_bytes(x))) for i, x in want)
    back = sorted((r.doc_id, bytes(r.text_bytes)) for r in bpe.decoded(ids, MULTI, PATTERN).collect())
    assert back == sorted((i, (t or "").encode()) for i, t in rows)
    ids.unpersist()


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "b " * 80, 1), (None, "b " * 80, 2), (None, None, 3)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, len(r.ids)) for r in bpe.encoded(docs, MULTI, PATTERN, chunk=50, overlap=20).collect()]
    assert sorted(n for _, n in got)[0] == 0 and len(got) == 3 and all(d is None for d, _ in got)
    assert bpe.encoded(docs.limit(0), MULTI, PATTERN).count() == 0


def test_json_vocabulary_has_the_ranks_of_its_library():
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary_file(JSON), special_tokens={})
    for t in texts(2, 200):
        assert own.encode_ordinary(t or "") == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("how", [{}, {"slack": 0, "fan_in": 2, "task_bins": 40}, {"task_bins": 7}])
def test_packing_places_every_piece_once(spark, how):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    most = 100
    rows = [(i, t) for i, t in enumerate(texts(3, 150))] + [(1, "twice"), (1, "twice"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    got = packing.packed_documents(docs, JSON, PATTERN, most=most, **how).collect()
    want, total = [], 0
    for doc, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        head = len(ids) % most or most
        total += len(ids)
        for k, a in enumerate([0, *range(head, len(ids), most)]):
            part = ids[a : head if k == 0 else a + most]
            want.append((str(doc), k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    if not how:
        large = sum(w[3] > most // 2 for w in want)
        assert len(filled) <= max(-(-total // most), large) * 1.05 + 1


def test_packing_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.packed_documents(docs, JSON, PATTERN).count() == 0


def test_best_fit_takes_the_fullest_bin_with_room():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(sorted(b) for b in bins) == [[0, 2], [1, 3, 4]]
