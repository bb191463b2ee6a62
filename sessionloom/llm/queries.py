"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import ann, collocations, embed_dedup, html_extract, language_id, lm_score, mixing, packing, simhash, token_codes, toxicity, warc, whitening
from sessionloom.llm.common import table


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("source")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, manifest = token_codes.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return token_codes.read_token_files(spark, directory, manifest, keep_ids=False)


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory, _ = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, directory, keep_payload=False).drop("url")


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, digest=packing.crc32_of)
    return placed.withColumnRenamed("ids", "ids_crc32").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by compression with each language's dictionary."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.fit(docs))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the first 16 whitened components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases by score."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_lattice_lm, op2_embedding_dedup, op3_source_mixing, op4_simhash_golay, op5_token_codes, op6_warc_dictionary, op7_bin_completion, op8_nn_descent, op9_toxicity,
        op10_main_text, op11_language_id, op12_whitening, op13_collocations,
    )
}

ORACLES = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, coalesce(label IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS takes_part
  FROM embeddings),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE a.takes_part AND b.takes_part AND list_cosine_similarity(a.e, b.e) >= 0.98),
reached(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT s, w FROM reached JOIN links ON t = u)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT s, min(t) AS component_id FROM reached GROUP BY s) ON s = vec_id
""",
    "op3_source_mixing": mixing.ORACLE,
    "op13_collocations": collocations.ORACLE,
    "op6_warc_dictionary": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
""",
}
