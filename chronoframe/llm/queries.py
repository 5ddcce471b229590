"""Registered queries of the training-data operators (thin: contract columns only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.collocations import collocations
from chronoframe.llm.common import documents
from chronoframe.llm.decontam import overlaps
from chronoframe.llm.fingerprints import fingerprint_with_edits, hex_signature
from chronoframe.llm.host_rules import apply_host_rules
from chronoframe.llm.license_scan import scan_licenses
from chronoframe.llm.line_dedup import dedup_lines
from chronoframe.llm.packing import pack
from chronoframe.llm.quality import score_quality, train
from chronoframe.llm.sharding import assign_shards
from chronoframe.llm.simhash import simhash_components
from chronoframe.llm.spelling import spelling_variants
from chronoframe.llm.sql import SQL  # noqa: F401 - re-exported for the driver contract
from chronoframe.llm.substring_dedup import dedup_substrings
from chronoframe.llm.url_filter import judge_urls
from chronoframe.sources.tables import load


def tokenizer_path() -> str:
    """Place of the public byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence spans of every document."""
    found = scan_licenses(documents(spark, sf_dir))
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    base, spans = F.col("base_places.label"), F.col("spans.label")
    cover = F.array_max("spans.cover")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.start").alias("first_word"),
        F.array_max("base_places.start").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, spans)).alias("labels"),
        F.when(F.size("base_places") > 0, 1.0).otherwise(F.least(F.coalesce(cover, F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document, at most 1024 tokens each."""
    return pack(documents(spark, sf_dir), tokenizer_path()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that resemble an earlier line."""
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    docs = documents(spark, sf_dir)
    model = train(docs, load(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over 3-word shingles, linked at two bits or fewer."""
    return simhash_components(documents(spark, sf_dir), shingle=3, max_bits=2)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or trees' verdict for every page url."""
    return judge_urls(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent-weighted-sampling fingerprints of every document and its edited text."""
    return fingerprint_with_edits(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_signature(F.col("signature")).alias("fingerprint"),
        hex_signature(F.col("edited_signature")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that 13-word windows of smaller ids do not cover."""
    return dedup_substrings(documents(spark, sf_dir), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every document with the benchmark items."""
    found = overlaps(documents(spark, sf_dir), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "last_word", "n_windows")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded-load ring over 16 shards; the law that holds is ``rows``."""
    return assign_shards(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the corpus with the form and the root of their spelling group."""
    return spelling_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to five words of each language."""
    return collocations(documents(spark, sf_dir), min_count=100, top=2000)


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, with the verdicts of its text and of its source."""
    return apply_host_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprints": op7_fingerprints,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_spelling": op11_spelling,
    "op12_collocations": op12_collocations,
    "op13_host_rules": op13_host_rules,
}


