"""Lookups: rows by ids in order, statuses, sorts, pages with their total, who writes what, snippets, names in a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import words


def ascii_lower(name: Column) -> Column:
    """A-Z as a-z, as a sort without case takes them; other letters as they are."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows that `wanted` (place, key) names, with the place: of a key wanted twice the first place counts."""
    first = wanted.groupBy(key).agg(F.min("place").alias("place"))
    return rows.join(first, key).select("place", *rows.columns)


def exists(rows: DataFrame) -> DataFrame:
    """One row, `found`: whether there is any."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def with_status(rows: DataFrame, files: DataFrame, status: str = "indexed") -> DataFrame:
    """Rows (file_path) of files in one state."""
    return rows.join(files.where(F.col("status") == status).select(F.col("path").alias("file_path")), "file_path", "left_semi")


def status_first(files: DataFrame, status: str = "indexed") -> DataFrame:
    """Files with their place in a list: those in another state first, each part by path without case."""
    return files.orderBy((F.col("status") == status), ascii_lower(F.col("path")), "path")


def named_in_order(rows: DataFrame, name: str) -> DataFrame:
    """By name without case, then as written."""
    return rows.orderBy(ascii_lower(F.col(name)), F.col(name))


def page_with_total(rows: DataFrame, most: int, skip: int, *order) -> DataFrame:
    """A page, each row with `total`: how many rows there are on all pages. A negative limit is none."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(skip)
    return (page if most < 0 else page.limit(most)).join(F.broadcast(total))


def reverse_day_links(links: DataFrame, day_entries: DataFrame, file_keys: DataFrame) -> DataFrame:
    """Entries that link any entry of a day, by its date or by its file's name, themselves not of it: `links` (entry_id, target),
    `day_entries` (entry_id, entry_date), `file_keys` (key, entry_id).

    The day's entries have few names, and the links are asked for those; no pairs of entries are made.
    """
    own = day_entries.where("entry_id IS NOT NULL")
    dates = own.select(F.date_format("entry_date", "yyyy-MM-dd").alias("target"))
    files = file_keys.join(own.select("entry_id"), "entry_id", "left_semi").select(F.col("key").alias("target"))
    linking = links.where("entry_id IS NOT NULL").join(dates.union(files).distinct(), "target", "left_semi").select("entry_id").distinct()
    return linking.join(own.select("entry_id"), "entry_id", "left_anti")


def writers(entry_links: DataFrame, note_links: DataFrame, target: str) -> DataFrame:
    """(kind, id) of the entries and notes that write a target."""
    entries = entry_links.where(F.col("target") == target).select(F.lit("entry").alias("kind"), F.col("entry_id").alias("id"))
    return entries.union(note_links.where(F.col("target") == target).select(F.lit("note"), F.col("note_id"))).distinct()


def backlinks(note_links: DataFrame, targets: DataFrame, note_id: int) -> DataFrame:
    """Notes that link a note, itself left out: `note_links` (note_id, target), `targets` (key, note_id)."""
    keys = targets.where(F.col("note_id") == note_id).select(F.col("key").alias("target"))
    return note_links.where(F.col("note_id") != note_id).join(keys, "target", "left_semi").select("note_id").distinct()


def orphan_entries(entries: DataFrame, *children: DataFrame) -> DataFrame:
    """Entries that no child table (entry_id) has a row of."""
    for child in children:
        entries = entries.join(child.select("entry_id"), "entry_id", "left_anti")
    return entries.select("entry_id")


def tags_of(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """(entry_id, tags) for some entries, the tags sorted."""
    return tags.join(ids.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


def metric_mood_pairs(entries: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """(entry_id, value, mood_score) of scored entries with a metric."""
    return metrics.where(F.col("key") == key).join(entries.where("mood_score IS NOT NULL").select("entry_id", "mood_score"), "entry_id").select("entry_id", "value", "mood_score")


def digests_overlapping(digests: DataFrame, first: str, last: str) -> DataFrame:
    """Digests (first_day, last_day) of periods that share a day with a range."""
    return digests.where((F.col("first_day") <= F.lit(last).cast("date")) & (F.col("last_day") >= F.lit(first).cast("date")))


def metrics_named(metrics: DataFrame, question: str) -> DataFrame:
    """Keys of metrics that stand in a question as whole words, the longest first."""
    asked = F.concat(F.lit(" "), words(F.lit(question)), F.lit(" "))
    keys = metrics.select("key").distinct().where(F.contains(asked, F.concat(F.lit(" "), words(F.col("key")), F.lit(" "))))
    return keys.orderBy(F.desc(F.length("key")), "key")


def snippet(text: Column, key: Column, most: int = 160) -> Column:
    """The sentence around the first place of a key, whatever its case; a longer one from the key on, cut at a word to `most`
    characters. Null without the key."""
    at = F.instr(F.lower(text), F.lower(key))
    end = F.regexp_extract(F.substr(text, at), r"^([^.!?…\n]*[.!?…]?)", 1)
    whole = F.trim(F.concat(F.element_at(F.split(F.substr(text, F.lit(1), at - 1), r"[.!?…\n]"), -1), end))
    rest = F.trim(end)
    cut = F.concat(F.regexp_replace(F.substring(rest, 1, most - 1), r"\s+\S*$", ""), F.lit("…"))
    return F.when(at > 0, F.when(F.length(whole) <= most, whole).when(F.length(rest) <= most, rest).otherwise(cut))


def glob_match(paths: DataFrame, pattern: str) -> DataFrame:
    """Rows whose `path` fits a glob: * within a folder, ** over folders, ? one character."""
    import re

    out = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part) for part in re.split(r"(\*\*/|\*\*|\*|\?)", pattern))
    return paths.where(F.col("path").rlike(f"^{out}$"))


#: Marks of a vault's own date patterns, and the same as strftime writes them.
DATE_MARKS = {"YYYY": "%Y", "YY": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "DD": "%d", "dddd": "%A", "ddd": "%a", "HH": "%H", "mm": "%M"}


def date_format(pattern: str) -> str:
    """A vault's date pattern as strftime's; text between brackets stands as it is."""
    import re

    marks = "|".join(sorted(DATE_MARKS, key=len, reverse=True))
    return re.sub(rf"\[([^\]]*)\]|({marks})", lambda m: m[1] if m[1] is not None else DATE_MARKS[m[2]], pattern)


def adjacent_moves(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Each row with the one before it of the same key, for views that step through days."""
    window = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("previous", F.lag(order).over(window))
