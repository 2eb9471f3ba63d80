"""Filters on entries: date range, tag, notes, property group. Semi-joins, so that Catalyst can push them around."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, functions as F


def in_range(entries: DataFrame, since: date | str | None = None, until: date | str | None = None, column: str = "entry_date") -> DataFrame:
    """Either end may be open; both are inside."""
    if since is not None:
        entries = entries.where(F.col(column) >= F.lit(since).cast("date"))
    if until is not None:
        entries = entries.where(F.col(column) <= F.lit(until).cast("date"))
    return entries


@dataclass(frozen=True)
class EntryFilter:
    """tag AND (any of the notes) AND (any member of the group). No condition matches all; an empty table of notes, nothing."""

    tag: str | None = None
    notes: DataFrame | None = field(default=None, compare=False)
    group: DataFrame | None = field(default=None, compare=False)

    def apply(self, entries: DataFrame, tags: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
        if self.tag is not None:
            entries = entries.join(tags.where(F.col("tag") == self.tag.lower()), "entry_id", "left_semi")
        for notes in (self.notes, self.group):
            if notes is not None:
                entries = entries.join(entities.join(notes.select("note_id"), "note_id", "left_semi"), "entry_id", "left_semi")
        return entries


def candidates(entries: DataFrame, only: EntryFilter, names: DataFrame | None, tags: DataFrame, entities: DataFrame) -> DataFrame:
    """Entries for retrieval. Names that a router guessed are dropped if they leave nothing; `only` is strict."""
    strict = only.apply(entries, tags, entities)
    if names is None:
        return strict
    narrowed = EntryFilter(notes=names).apply(strict, tags, entities)
    return strict if narrowed.isEmpty() else narrowed


def group_members(properties: DataFrame, key: str, value: str) -> DataFrame:
    """Notes whose property has the value; case and outer spaces don't matter."""
    same = (F.lower(F.trim("key")) == key.strip().lower()) & (F.lower(F.trim("value")) == value.strip().lower())
    return properties.where(same).select("note_id").distinct()
