"""The corpus operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from . import audit, chat, classifier, decontam, jaccard, licenses, lm, lots, mixing, quality, suffix, urls, warc
from .common import table


def queries():
    return {
        "op1_license_scan": lambda spark, d: licenses.license_scan(table(spark, d, "documents")).drop("matches"),
        "op2_quality_rules": lambda spark, d: quality.quality_rules(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_chat_formatting": lambda spark, d: chat.format_chats(chat.with_made_calls(table(spark, d, "conversations"))),
        "op4_jaccard_join": lambda spark, d: jaccard.jaccard_join(table(spark, d, "documents")).drop("n_links"),
        "op5_decontamination": lambda spark, d: decontam.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_mixing": lambda spark, d: mixing.mix(table(spark, d, "documents")),
        "op7_suffix_dedup": lambda spark, d: suffix.suffix_dedup(table(spark, d, "documents")),
        "op8_url_filters": lambda spark, d: urls.url_filter(table(spark, d, "pages")),
        "op9_lm_score": lambda spark, d: lm.lm_score(table(spark, d, "documents")),
        "op10_quality_classifier": lambda spark, d: classifier.quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
        "op11_return_lots": lambda spark, d: lots.match_returns(table(spark, d, "sale_lines"), table(spark, d, "sales")),
        "op12_warc_index": lambda spark, d: warc.archive_pages(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
        "op13_filter_audit": lambda spark, d: audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels")),
        "pipeline": corpus_pipeline.run,
        # the operators' base columns alone, since the whole has no SQL
        "license_scan_base": lambda spark, d: licenses.license_scan(table(spark, d, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"),
        "quality_rules_base": lambda spark, d: quality.quality_rules(table(spark, d, "documents"), table(spark, d, "labels")).drop("kept", "score"),
        "lm_score_base": lambda spark, d: lm.lm_score(table(spark, d, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score")),
    }


def oracle_sql():
    return {
        "op3_chat_formatting": chat.SQL,
        "op4_jaccard_join": jaccard.SQL,
        "op5_decontamination": decontam.SQL,
        "op6_mixing": mixing.SQL,
        "op7_suffix_dedup": suffix.SQL,
        "op8_url_filters": urls.SQL,
        "op11_return_lots": lots.SQL,
        "op12_warc_index": warc.SQL,
        "op13_filter_audit": audit.SQL,
        "license_scan_base": licenses.SQL_BASE,
        "quality_rules_base": quality.SQL_BASE,
        "lm_score_base": lm.SQL_BASE,
    }
