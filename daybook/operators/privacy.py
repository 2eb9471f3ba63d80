"""The view without withheld entries and notes, and without whatever was derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def withheld_entries(tags: DataFrame, excluded: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Entries with an excluded tag, wherever it came from; `extra` (entry_id): tags written in text or frontmatter."""
    found = tags.where(F.lower("tag").isin(*[t.lower() for t in excluded])).select("entry_id")
    return (found if extra is None else found.union(extra.select("entry_id"))).distinct()


def withhold(tables: dict[str, DataFrame], entries_out: DataFrame, notes_out: DataFrame, days: str = "entry_date") -> dict[str, DataFrame]:
    """The tables without the withheld rows: by entry_id, by note_id, and digests of periods that cover a withheld day.

    The withheld days are broadcast: as distinct dates they are some 36,500 a century, whatever the number of entries.
    """
    out = {}
    lost_days = tables["entries"].join(entries_out, "entry_id", "left_semi").select(F.col(days).alias("lost")).distinct()
    for name, df in tables.items():
        if "entry_id" in df.columns:
            df = df.join(entries_out, "entry_id", "left_anti")
        if "note_id" in df.columns:
            df = df.join(notes_out, "note_id", "left_anti")
        if {"first_day", "last_day"} <= set(df.columns):
            df = df.join(F.broadcast(lost_days), (F.col("lost") >= F.col("first_day")) & (F.col("lost") <= F.col("last_day")), "left_anti")
        out[name] = df
    return out
