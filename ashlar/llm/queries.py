"""Registered queries of the training-data operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm import (decontaminate, fill_in_middle, packing, quality, sentence_spans, sharding, source_mix, spelling_variants, suffix_dedup,
                        token_counts, toxicity, warc, weighted_minhash)
from ashlar.llm.toxicity import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted", *toxicity.FEATURES)


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).drop("spans")


SQL["op5_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (
  SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM b WHERE len(w) > 0),
v AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + 12], ' ') AS piece FROM i),
x AS (
  SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
y AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS piece FROM x, (SELECT DISTINCT n FROM v) WHERE k + n - 1 <= len(w)),
f AS (
  SELECT y.r, y.k, y.n, v.item_id FROM y JOIN v ON y.n = v.n AND y.piece = v.piece),
h AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM f) GROUP BY r),
t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.MEASURES[:5], "base_failed", "kept", "p_good")


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_counts.byte_vocabulary(tokenizer_path("byte_bpe_50k.json"))
    return token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), tokens)


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses_of(read(spark, sf_dir, "pages")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type",
                          F.size("source_headers").alias("n_source_headers"), "source_block_digest",
                          "source_payload_digest", "block_digest", "content_length")


@query
def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_spans.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                      F.coalesce(F.octet_length("kept_text"), F.lit(0)).cast("long").alias("n_kept"),
                      F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                          "law", "shard", "slot", "grown_shard")


@query
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_substrings(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighted_minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "is_kept")


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")))


SQL["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
g AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])


SQL["op13_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15])::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () - sum(3 * source_size) OVER o AS remain, sum(w) OVER () - sum(w) OVER o AS weight
  FROM s WINDOW o AS (ORDER BY source_size / w, source)),
l AS (
  SELECT share FROM (SELECT (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS share, -1 AS k
    UNION ALL SELECT remain::DOUBLE / weight, row_number() OVER (ORDER BY source_size / w, source) FROM r WHERE weight > 0)
  WHERE share IS NOT NULL ORDER BY share DESC LIMIT 1),
t AS (
  SELECT source, source_size, least(w * share, (3 * source_size)::DOUBLE) AS target FROM s, l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + (below + size <= rest OR below <= rest AND (rest - below) * 2 > size)::INTEGER))::BIGINT AS taken FROM c"""
