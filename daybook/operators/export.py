"""Sinks: JSON, Markdown and CSV of entries with their tags, notes and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import csv_guard

FIXED = ("entry_id", "entry_date", "mood_score", "word_count", "tags")


def collected(entries: DataFrame, tags: DataFrame, metrics: DataFrame) -> DataFrame:
    """Entries with their tags (a list) and metrics (a map)."""
    own_tags = tags.groupBy("entry_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    own_metrics = metrics.groupBy("entry_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metrics"))
    return entries.join(own_tags, "entry_id", "left").join(own_metrics, "entry_id", "left")


def csv_rows(entries: DataFrame, tags: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The fixed columns and one for each metric; text cells guarded; metrics named like a fixed column get a suffix."""
    rows = collected(entries, tags, metrics)
    values = [F.try_element_at("metrics", F.lit(k)).alias(f"{k}_metric" if k in FIXED else k) for k in keys]
    return rows.select("entry_id", "entry_date", "mood_score", "word_count", csv_guard(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "; ")).alias("tags"), *values)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).csv(path)


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def markdown(entries: DataFrame) -> DataFrame:
    """One block of Markdown for each entry: heading, a line of facts, its text; `entries` (entry_id, entry_date, mood_score, tags, text)."""
    facts = F.concat_ws(" · ", F.when(F.col("mood_score").isNotNull(), F.concat(F.lit("mood "), F.format_number("mood_score", 1))), F.when(F.size("tags") > 0, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " ")))
    return entries.select("entry_id", F.concat(F.lit("## "), F.date_format("entry_date", "yyyy-MM-dd"), F.lit("\n\n"), F.when(facts != "", F.concat(facts, F.lit("\n\n"))).otherwise(F.lit("")), "text", F.lit("\n")).alias("value"))


def safe_path(path: str, vault: str) -> str:
    """Refuses to write inside the folder that is read."""
    from pathlib import PurePosixPath

    if PurePosixPath(path).is_relative_to(PurePosixPath(vault)):
        raise ValueError(f"{path} lies in {vault}")
    return path
