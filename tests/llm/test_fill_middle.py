"""Fill-in-middle against a plain version, and back."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mediagraph.llm import fill_middle


def plain_fim(doc_id, text, seed=1, percent=90, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_equal_to_plain_version_and_restored(spark):
    rng = random.Random(3)
    bits = ["a", "Zz", "é", "日本", "🙂", " ", "\n", "<", "<P", "S>", "<S", "M>", "<P>", "<M>", "\x00", "\r\n", "12", "$1", "\\1", "e\u0301", "\x85"]
    texts = [None, "", "a", "\n", "<S>", "<<S", "x" * 5000] + ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += [" ".join(rng.choice(["mot", "Wört", "9"]) for _ in range(200_000)), "word" * 400_000, "é" * 300_000]  # very long ones
    rows = [(i if i % 50 else None, t, "mine") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (7, texts[7], "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fim string")
    out = fill_middle.filled_in_middle(docs.repartition(3))
    assert out.columns == ["doc_id", "text", "fim", "_fim"]
    got = out.select("doc_id", "text", "fim", "_fim.*", fill_middle.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    assert len(got) == len(rows) and sorted(str(r.text) for r in got) == sorted(str(t) for _, t, _ in rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.fim in ("mine", "again")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_other_parameters_and_edges(spark):
    docs = spark.createDataFrame([(i, f"some text {i}, é") for i in range(60)], "doc_id bigint, text string")
    got = fill_middle.filled_in_middle(docs, seed=9, percent=50, spm_percent=50, keep=["doc_id"]).select("doc_id", "fim.*").collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, f"some text {r.doc_id}, é", 9, 50, 50)
    assert fill_middle.filled_in_middle(docs.limit(0)).count() == 0
    clash = docs.withColumn("form", F.lit("f")).withColumn("n", F.lit(1)).withColumn("output", F.lit("o"))
    assert fill_middle.filled_in_middle(clash).columns == ["doc_id", "text", "form", "n", "output", "fim"]
    with pytest.raises(ValueError):
        fill_middle.Sentinels("<a<", "<b", "<c")
