"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from tidecohort.llm import chat, decontam, divergence, langid, linededup, minhash, mixing, quality, resample, secrets, sql, substrings, toxicity, warc
from tidecohort.llm.common import table

QUERIES = {
    "op1_secret_scan": lambda spark, sf_dir: secrets.report(table(spark, sf_dir, "documents")),
    "op2_near_dedup": lambda spark, sf_dir: minhash.groups(table(spark, sf_dir, "documents")),
    "op3_chat_format": lambda spark, sf_dir: chat.repair(table(spark, sf_dir, "conversations")),
    "op4_quality_rules": lambda spark, sf_dir: quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_warc": lambda spark, sf_dir: warc.round_trip(table(spark, sf_dir, "pages")),
    "op6_suffix_dedup": lambda spark, sf_dir: substrings.report(table(spark, sf_dir, "documents")),
    "op7_mixing": lambda spark, sf_dir: mixing.mix(table(spark, sf_dir, "documents")),
    "op8_toxicity": lambda spark, sf_dir: toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_decontamination": lambda spark, sf_dir: decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op10_language_id": lambda spark, sf_dir: langid.report(table(spark, sf_dir, "documents")),
    "op11_line_dedup": lambda spark, sf_dir: linededup.report(table(spark, sf_dir, "documents")),
    "op12_source_divergence": lambda spark, sf_dir: divergence.report(table(spark, sf_dir, "documents")),
    "op13_importance_resampling": lambda spark, sf_dir: resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
}

ORACLES: dict[str, str] = {"op5_warc": sql.WARC, "op7_mixing": sql.MIXING, "op11_line_dedup": sql.LINES, "op12_source_divergence": sql.DIVERGENCE, "op13_importance_resampling": sql.RESAMPLING}
