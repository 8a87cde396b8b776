"""The registered queries opN_<name> of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import (
    centroids, chat, edit_fingerprints, embeddings, language_model, media, minhash, mixing, packing, quality, repeats,
    token_counts, whitening
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    return token_counts.attribute_tokens(docs, _tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source; documents labelled good weigh 2, those labelled bad 1/2, others 1."""
    labels = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("rated"))
    docs = _read(spark, sf_dir, "documents").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).alias("words")
    )
    rated = docs.join(labels, "doc_id", "left")
    return mixing.mix_sources(
        rated, size=F.col("words"),
        weight=F.when(F.col("rated") == 1, 2.0).when(F.col("rated") == 0, 0.5).otherwise(1.0)
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 0.8 and more on shingles of four words, over all whole texts. Null, empty and blank texts link with nothing."""
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, percent=80)


#: SQL text over ``labels``: 0 for toxic, 1 for poor, 2 for good documents; null where a rating that decides is missing.
GRADE = "CASE WHEN toxic = 1 THEN 0 WHEN toxic = 0 AND quality = 0 THEN 1 WHEN toxic = 0 AND quality = 1 THEN 2 END"


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on the labelled ones."""
    docs = _read(spark, sf_dir, "documents")
    model = quality.train_quality(docs, _read(spark, sf_dir, "labels"), F.expr(GRADE))
    return quality.score_quality(docs, model)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among thumbnails of all pages (the tables hold no images of their own)."""
    return media.near_images(media.page_thumbnails(_read(spark, sf_dir, "pages")))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32 of the id, modulo 7, is not 2; remainder 3 tunes the weights."""
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    return language_model.score_texts(_read(spark, sf_dir, "documents"), rest == 2, rest == 3)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens. A null or empty text is its end id alone."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a cosine of 0.95 and more among all vectors. Null, zero and non-finite ones link with nothing."""
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations with its cheapest repair and its rendering. Empty texts are turns, ties have an order."""
    return chat.repair_roles(_read(spark, sf_dir, "conversations"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every text that 400-byte strings with another start cover. A null text is empty; repeated rows repeat each other."""
    return repeats.repeated_bytes(_read(spark, sf_dir, "documents"))


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, and of the text whose second half is the next document's beginning, and the components of
    texts whose fingerprints are 0.8 alike, found by bands of sampled steps. A null text is empty."""
    return edit_fingerprints.compare_edits(_read(spark, sf_dir, "documents"), threshold=0.8)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components in 40 clusters, after 5 rounds; others are left out."""
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"), k=40, rounds=5, width=64, scale=256, salt="2")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of finite components on their first 16 principal components, each with a variance of 1."""
    return whitening.whiten_vectors(_read(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_mix_sources": op2_mix_sources,
    "op3_minhash": op3_minhash,
    "op4_quality": op4_quality,
    "op5_media": op5_media,
    "op6_language_model": op6_language_model,
    "op7_pack": op7_pack,
    "op8_near_vectors": op8_near_vectors,
    "op9_chat": op9_chat,
    "op10_repeats": op10_repeats,
    "op11_edit_fingerprints": op11_edit_fingerprints,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), rated AS (SELECT doc_id, min(quality) AS rated FROM labels GROUP BY doc_id
), keyed AS (
  SELECT d.doc_id, d.source, d.size,
    -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)
      / CASE WHEN rated = 1 THEN 2.0 WHEN rated = 0 THEN 0.5 ELSE 1.0 END AS key
  FROM docs d LEFT JOIN rated r ON d.doc_id = r.doc_id
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes
), levels AS (
  SELECT *, 3 * source_size / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(3.0 * source_size,
    coalesce((SELECT arg_min(level, ratio) FROM levels WHERE ratio >= level) * weight, 3.0 * source_size)) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN target >= 3 * source_size THEN 3 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM targets
), ordered AS (
  SELECT k.*, b.source_size, b.target, b.epochs, CASE WHEN b.epochs >= 3 THEN 0 ELSE b.target - b.epochs * b.source_size END AS budget,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * epochs + CASE WHEN ahead + size / 2 <= budget THEN size ELSE 0 END AS BIGINT) AS taken, source
FROM ordered
""",
}
