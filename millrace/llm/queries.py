"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, fingerprint, licenses, linededup, packing, quality_lm, quality_rules, simhash, substring


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.encode_and_decode(_table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark, sf_dir):
    return linededup.keep_bitmaps(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "keep_runs")


def op4_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_source_pairs(spark, sf_dir):
    return fingerprint.source_pairs(_table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark, sf_dir):
    return simhash.near_groups(_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "keep", "n_links")


def op6_license_scan(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    return substring.repeated_spans(_table(spark, sf_dir, "documents")).drop("th", "first_th")


def op8_quality_classifier(spark, sf_dir):
    return quality_lm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("th")


def op9_quality_rules(spark, sf_dir):
    return quality_rules.line_frequency_rules(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_line_dedup, op4_fingerprints, op4_source_pairs, op5_simhash_dedup, op6_license_scan, op7_substring_dedup, op8_quality_classifier, op9_quality_rules, op10_chat_format)}
ORACLE_SQL = {"op3_line_dedup": linededup.ORACLE, "op4_fingerprints": fingerprint.ORACLE, "op4_source_pairs": fingerprint.PAIRS_ORACLE, "op7_substring_dedup": substring.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op10_chat_format": chat.ORACLE}
