"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textanomaly.llm import alignment, classifier, decontaminate, fingerprints, lm, mixing, phrases, pii, quality_rules, simhash, suffix, url_rules, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_passages(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    changed = pii.pseudonymise(_table(spark, folder, "documents").select("doc_id", "text"), pii.session_key(spark), found="found")
    counts = {f"n_{kind}": F.coalesce(F.col("found")[kind], F.lit(0)) for kind in pii.KINDS}
    return changed.withColumns(counts).drop("found")


def op5_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, folder, "documents")).drop("spans")


def op6_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = classifier.classify(_table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_table(spark, folder, "documents"))


def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = url_rules.judge(_table(spark, folder, "pages"), _table(spark, folder, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.phrases(_table(spark, folder, "documents")).drop("most_left", "most_right")


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(_table(spark, folder, "documents"))


def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited(_table(spark, folder, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_suffix": op5_suffix,
    "op6_classifier": op6_classifier,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_lm": op9_lm,
    "op10_url_rules": op10_url_rules,
    "op11_phrases": op11_phrases,
    "op12_alignment": op12_alignment,
    "op13_fingerprints": op13_fingerprints,
}
ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op13_fingerprints": fingerprints.ORACLE,
}
