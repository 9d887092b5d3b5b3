"""The registered opN_* queries: thin wrappers with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_in_middle, html_text, kneser_ney, manifest, merkle, mixing, near_dedup, packing, quality_rules, sharding, toxicity, warc, wavelet
from .common import table
from .sql import ORACLE_SQL as ORACLE_SQL

#: Place of a public tokenizer file; a parameter of the operators.
tokenizer_path = public_tokenizers.path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet.token_index(wavelet.write_token_files(docs, tokenizer_path("byte_bpe_50k.json")))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")))


def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


#: Shards of the placement query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op6_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARDS)


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), kneser_ney.trusted_ids(table(spark, sf_dir, "labels")))


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"), "evidence")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.verify(manifest.manifest(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.restore(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_block_extraction": op2_block_extraction,
    "op3_wavelet_tokens": op3_wavelet_tokens,
    "op4_warc_bundles": op4_warc_bundles,
    "op5_quality_divergence": op5_quality_divergence,
    "op6_lookup_sharding": op6_lookup_sharding,
    "op7_kneser_ney_quality": op7_kneser_ney_quality,
    "op8_pareto_mixing": op8_pareto_mixing,
    "op9_setsketch_dedup": op9_setsketch_dedup,
    "op10_merkle_fingerprints": op10_merkle_fingerprints,
    "op11_toxic_segments": op11_toxic_segments,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, which stands at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
