"""Schemas of the journal's tables, and empty tables of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "files": "path string, content_hash string, last_indexed timestamp, status string, error_message string",
    "entries": "entry_id long, entry_date date, raw_text string, word_count long, mood_score double, summary string, file_path string",
    "entry_readings": "entry_id long, mood_score double, tags array<string>",
    "entry_details": "entry_id long, details string",
    "file_frontmatter": "path string, data map<string,array<string>>",
    "entry_metrics": "entry_id long, key string, value double",
    "entry_tags": "entry_id long, tag string",
    "notes": "note_id long, title string, kind string, raw_text string, aliases array<string>, properties map<string,array<string>>, summary string",
    "note_names": "note_id long, key string, name string",
    "entry_links": "entry_id long, target string",
    "entry_link_labels": "entry_id long, target string, label string",
    "entry_link_anchors": "entry_id long, target string, anchor string",
    "entry_file_keys": "path string, key string",
    "note_property_values": "note_id long, key string, value_key string, name string, value string",
    "note_links": "note_id long, target string",
    "note_day_mentions": "entry_id long, note_id long",
    "note_learned_names": "note_id long, key string, name string, entries long",
    "rollups": "period_type string, period_key string, summary string, dominant_tags array<string>, avg_mood double, entry_count long, input_hash string",
    "note_digests": "link_key string, summary string, entry_count long, avg_mood double, first_date date, last_date date, input_hash string",
    "profile_facts": "fact_id long, text_hash string, entry_date date, category string, fact string, folded boolean",
    "profile_scans": "text_hash string, scanned_at timestamp",
    "entry_sections": "section_id long, entry_id long, heading string, start_line int, end_line int, text string",
    "entry_photos": "photo_id long, entry_id long, name string, path string, description string",
    "themes": "theme_id long, name string, about string, centroid array<double>, named_from array<long>",
    "entry_themes": "entry_id long, theme_id long, distance double",
    "entry_vectors": "entry_id long, embedding array<float>",
    "memo": "key string, kind string, model string, value string, vector array<float>, created_at timestamp",
    "asked": "asked_id long, conversation string, asked_at timestamp, source string, question string, stage string, answer string",
    "meta": "key string, value string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(0).selectExpr(*(f"cast(null as {kind}) as {column}" for column, kind in fields(name)))


def fields(name: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    text = TABLES[name] + ","
    for k, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            column, kind = text[start:k].strip().split(" ", 1)
            out.append((column, kind))
            start = k + 1
    return out
