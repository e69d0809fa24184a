"""The registered queries op1 to op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from mediagraph.llm import bpe, embedding_dedup, fill_middle, html_text, importance, language_id, lm_scoring, ngram_jaccard, packing, quality_rules, substring_dedup, url_filters, warc
from mediagraph.llm.tables import query, read


@query("op1_quality_rules")
def op1(spark, folder):
    docs = read(spark, folder, "documents")
    rules = quality_rules.fit_rules(docs, read(spark, folder, "labels"))
    rows = quality_rules.judged(docs, rules, keep=["doc_id"])
    return rows.select("doc_id", *[F.col(f"stats.{c}").alias(c) for c in quality_rules.COUNTS], "base_failed", "kept")


@query("op2_language_id")
def op2(spark, folder):
    docs = read(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    models = language_id.fit_models(docs.where("doc_id is not null").where(~held_out))
    rows = language_id.with_language(docs, models, keep=["doc_id"])
    return rows.select("doc_id", held_out.alias("held_out"), "language.*")


@query("op3_substring_dedup")
def op3(spark, folder):
    rows = substring_dedup.without_repeats(read(spark, folder, "documents"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op6_ngram_jaccard")
def op6(spark, folder):
    return ngram_jaccard.near_duplicates(read(spark, folder, "documents"))


@query("op8_embedding_dedup")
def op8(spark, folder):
    return embedding_dedup.near_vectors(read(spark, folder, "embeddings"))


@query("op9_bpe")
def op9(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encoded(read(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digests(rows, path, public_tokenizers.PATTERN)


@query("op10_packing")
def op10(spark, folder):
    return packing.packed_documents(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op4_warc")
def op4(spark, folder):
    manifest = warc.write_archives(read(spark, folder, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_url_filters")
def op5(spark, folder):
    rules = [
        url_filters.UrlRule("com", "/", allow=True), url_filters.UrlRule("example.com", "/en/", allow=False),
        url_filters.UrlRule("www.example.com", "/en/", allow=True), url_filters.UrlRule("net", "/es/", allow=False),
        url_filters.UrlRule("net", "/fr/", allow=False),
    ]
    return url_filters.judged(read(spark, folder, "pages"), rules, keep=["page_id"])


@query("op7_html_text")
def op7(spark, folder):
    return html_text.with_text(read(spark, folder, "pages"), keep=["page_id", "url"])


@query("op11_lm_scoring")
def op11(spark, folder):
    docs = read(spark, folder, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    corpus, tail = lm_scoring.fitted(docs.where(~held_out), path, public_tokenizers.PATTERN)
    rows = lm_scoring.with_scores(docs, corpus, tail, keep=["doc_id"])
    return rows.select("doc_id", held_out.alias("held_out"), "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")


FIM_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents)
, u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t)
, c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
, p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


@query("op12_fill_middle", FIM_SQL)
def op12(spark, folder):
    rows = fill_middle.filled_in_middle(read(spark, folder, "documents"), keep=["doc_id"])
    back = fill_middle.restored(F.col("fim.output"), F.col("fim.form"))
    return rows.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


# The checksum of a feature, byte by byte from its hex digits, with the usual table of 256 remainders.
CRC = "list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, octet_length(f) + 1), lambda i: CAST(('0x' || hex(f)[2 * i - 1:2 * i]) AS UBIGINT))), " + (
    f"lambda c, x: xor(CAST({importance.crc_table().tolist()} AS UBIGINT[])[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))")
IMPORTANCE_SQL = f"""WITH d AS (SELECT 1 AS side, doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 0, NULL, row_number() OVER (), coalesce(text, '') FROM benchmark)
, w AS (SELECT side, doc_id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d)
, f AS (SELECT side, r, encode(f) AS f, count(*) AS n FROM (SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w) GROUP BY ALL)
, h AS (SELECT f, xor({CRC}, 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM f))
, c AS (SELECT side, r, b, sum(n) AS n FROM f JOIN h USING (f) GROUP BY ALL)
, g AS (SELECT b, coalesce(sum(n) FILTER (side = 1), 0) AS s, coalesce(sum(n) FILTER (side = 0), 0) AS t FROM c GROUP BY b)
, a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM g)
, gain AS (SELECT b, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM g, a)
, per AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN gain USING (b) WHERE side = 1 GROUP BY r)
, scored AS (SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM w LEFT JOIN per USING (r) WHERE side = 1)
, able AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN k END AS rank FROM able"""


@query("op13_importance_resampling", IMPORTANCE_SQL)
def op13(spark, folder):
    rows = importance.resampled(read(spark, folder, "documents"), read(spark, folder, "benchmark"), keep=["doc_id"])
    return rows.select("doc_id", "importance.n_features", "importance.weight", "importance.score", "importance.rank")
