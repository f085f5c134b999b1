"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann, fill_middle, html_extract, langid, packing, ppm, quality, secret_scan, sentencepiece_codec, sharding, simhash, toxicity, whitening
from plumbline.llm.common import crc_fold, table


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is of the fold that is not learned from; one without id is neither learned from nor held out."""
    return F.coalesce(crc_fold("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, and decoded again; digests of both."""
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at 4 or fewer differing bits of a fingerprint of four-word shingles."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learned where crc32(doc_id) modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, fold=(4, 2))).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are read only where crc32(doc_id) modulo 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold=5)
    return toxicity.assess(docs, model).select("doc_id", held_out(5, 0), "score", "predicted")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, neighbours on the Hilbert curve together."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048, end_id=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the calibrated regression for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels"))).drop("quality_p")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and PPM score of every document; learned where crc32(doc_id) modulo 7 is not 2."""
    return ppm.score_documents(table(spark, sf_dir, "documents"), fold=(7, 2))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of nearly equal bytes, equal texts together."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened entries of every usable vector on up to 32 components."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), k=32)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: counts and digest of those in the text itself, and all spans, decoded layers included."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["via"] == "")
    counts = [F.size(secret_scan.of_kind(base, kind)).cast("long").alias(f"n_{kind}") for kind, *_ in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at two units drawn by its id, with digests of the output and of the text rebuilt from it."""
    done = fill_middle.transform(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_html_extraction": op5_html_extraction,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_permutation_index": op10_permutation_index,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op13_fill_in_middle": """WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z FROM d),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:z], '') AS middle, array_to_string(units[z + 1:], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
