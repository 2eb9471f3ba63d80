"""Grouped statistics over entries, tags, notes, properties and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.periods import KEYS, month_key
from ..functions.rounding import avg2, hundredths, ratio2


def mood_by(entries: DataFrame, key: Column, name: str) -> DataFrame:
    """Average mood of the scored entries, and the number of all."""
    return entries.groupBy(key.alias(name)).agg(avg2(F.col("mood_score")).alias("avg_mood"), F.count("*").alias("entry_count"))


def monthly_mood(entries: DataFrame) -> DataFrame:
    return mood_by(entries, month_key(F.col("entry_date")), "month")


def overall_mood(entries: DataFrame) -> DataFrame:
    return entries.agg(avg2(F.col("mood_score")).alias("avg_mood"), F.count("mood_score").alias("n"))


def scored(entries: DataFrame) -> DataFrame:
    return entries.where("mood_score IS NOT NULL")


def weekday_mood(entries: DataFrame) -> DataFrame:
    """0 is Sunday."""
    return scored(entries).groupBy((F.dayofweek("entry_date") - 1).alias("weekday")).agg(F.count("*").alias("n"), avg2(F.col("mood_score")).alias("avg_mood"))


def month_of_year_mood(entries: DataFrame) -> DataFrame:
    return scored(entries).groupBy(F.month("entry_date").alias("month")).agg(F.count("*").alias("n"), avg2(F.col("mood_score")).alias("avg_mood"))


def _mood_of(rows: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), avg2(F.col("mood_score")).alias("avg_mood")).where(F.col("n") >= least)


def tag_mood(entries: DataFrame, tags: DataFrame, least: int = 3) -> DataFrame:
    return _mood_of(scored(entries).select("entry_id", "mood_score").join(tags, "entry_id"), "tag", least=least)


def note_mood(entries: DataFrame, entities: DataFrame, notes: DataFrame, least: int = 3) -> DataFrame:
    """By title and kind, so notes of one title and kind count together."""
    linked = scored(entries).select("entry_id", "mood_score").join(entities, "entry_id").join(notes.select("note_id", "title", "kind"), "note_id")
    return _mood_of(linked, "title", "kind", least=least)


def group_entries(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """(key, value, entry_id), each once, however many members an entry links."""
    return properties.join(entities, "note_id").select("key", "value", "entry_id").distinct()


def group_mood(entries: DataFrame, entities: DataFrame, properties: DataFrame, least: int = 3) -> DataFrame:
    """Groups of two notes or more."""
    large = properties.groupBy("key", "value").agg(F.min("note_id").alias("least"), F.max("note_id").alias("most")).where("least <> most").select("key", "value")
    rows = group_entries(entities, properties).join(large, ["key", "value"]).join(scored(entries).select("entry_id", "mood_score"), "entry_id")
    return _mood_of(rows, "key", "value", least=least)


def property_groups(entries: DataFrame, entities: DataFrame, properties: DataFrame, key: str) -> DataFrame:
    """Every value of a property, also those without entries in range: notes, entries, mood, first and last day."""
    own = properties.where(F.lower("key") == key.lower()).withColumn("folded", F.lower(F.trim("value")))
    notes = own.groupBy("folded").agg(F.min("value").alias("value"), F.countDistinct("note_id").alias("notes"))
    linked = own.select("folded", "note_id").join(entities, "note_id").select("folded", "entry_id").distinct().join(entries, "entry_id")
    found = linked.groupBy("folded").agg(
        F.count("*").alias("entries"), avg2(F.col("mood_score")).alias("avg_mood"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date")
    )
    return notes.join(found, "folded", "left").select("value", "notes", F.coalesce("entries", F.lit(0)).alias("entries"), "avg_mood", "first_date", "last_date")


def property_keys(properties: DataFrame) -> DataFrame:
    """Rows are dealt by note first: one small file of many rows would be one task's, which would hold all its notes and values."""
    return properties.repartition("note_id").groupBy(F.lower("key").alias("key")).agg(F.min("key").alias("name"), F.countDistinct("note_id").alias("notes"), F.countDistinct("value").alias("n_values"))


def tag_stats(entries: DataFrame, tags: DataFrame) -> DataFrame:
    rows = tags.join(entries.select("entry_id", "entry_date", "mood_score"), "entry_id")
    return rows.groupBy("tag").agg(
        F.count("*").alias("n"), avg2(F.col("mood_score")).alias("avg_mood"), F.count("mood_score").alias("scored"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date")
    )


def limited(df: DataFrame, most: int) -> DataFrame:
    """A negative limit is none."""
    return df if most < 0 else df.limit(most)


def top_tags(entries: DataFrame, tags: DataFrame, most: int = 10) -> DataFrame:
    counted = tags.join(entries.select("entry_id"), "entry_id", "left_semi").groupBy("tag").agg(F.count("*").alias("n"))
    return limited(counted.orderBy(F.desc("n"), "tag"), most)


def top_notes(entries: DataFrame, entities: DataFrame, notes: DataFrame, most: int = 10, kind: str | None = None) -> DataFrame:
    """By title and kind, with the least note id; ties by title, then kind."""
    of = notes if kind is None else notes.where(F.col("kind") == kind)
    linked = entities.join(entries.select("entry_id"), "entry_id", "left_semi").join(of.select("note_id", "title", "kind"), "note_id")
    counted = linked.groupBy("title", "kind").agg(F.count("*").alias("n"), F.min("note_id").alias("note_id"))
    return limited(counted.orderBy(F.desc("n"), "title", "kind"), most)


def kinds(notes: DataFrame) -> DataFrame:
    return notes.groupBy("kind").agg(F.count("*").alias("n"))


def mention_stats(entries: DataFrame, entities: DataFrame) -> DataFrame:
    rows = entities.join(entries.select("entry_id", "entry_date"), "entry_id")
    return rows.groupBy("note_id").agg(F.count("*").alias("mentions"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"))


def mentions_by_year(entries: DataFrame, entities: DataFrame) -> DataFrame:
    rows = entities.join(entries.select("entry_id", "entry_date"), "entry_id")
    return rows.groupBy("note_id", F.year("entry_date").alias("year")).agg(F.count("*").alias("n"))


def notes_from_entries(entities: DataFrame, some: DataFrame, most: int) -> DataFrame:
    counted = entities.join(some.select("entry_id"), "entry_id", "left_semi").groupBy("note_id").agg(F.count("*").alias("n"))
    return limited(counted.orderBy(F.desc("n"), "note_id"), most)


def lapsed_notes(entries: DataFrame, entities: DataFrame, least: int, quiet_since, kind_of: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Notes once linked often and quiet since: links, last day, and the year with most (of equals, the latest)."""
    if kind is not None:
        entities = entities.join(kind_of.where(F.col("kind") == kind), "note_id", "left_semi")
    yearly = entities.join(entries.select("entry_id", "entry_date"), "entry_id").groupBy("note_id", F.year("entry_date").alias("year"))
    yearly = yearly.agg(F.count("*").alias("n"), F.max("entry_date").alias("last"))
    found = yearly.groupBy("note_id").agg(F.sum("n").alias("links"), F.max("last").alias("last_date"), F.max(F.struct("n", "year")).alias("b"))
    found = found.where((F.col("links") >= least) & (F.col("last_date") < F.lit(quiet_since).cast("date")))
    return found.select("note_id", "links", "last_date", F.col("b.year").alias("busiest_year"), F.col("b.n").alias("busiest_links"))


def first_linked_in(entries: DataFrame, entities: DataFrame, since, until, most: int = -1) -> DataFrame:
    """Notes whose first link falls into the range; n counts entries up to its end."""
    rows = entities.join(entries.select("entry_id", "entry_date"), "entry_id")
    last = F.lit(until).cast("date")
    found = rows.groupBy("note_id").agg(F.min("entry_date").alias("first_date"), F.count_if(F.col("entry_date") <= last).alias("n"))
    return limited(found.where(F.col("first_date").between(F.lit(since).cast("date"), last)).orderBy(F.desc("n"), "note_id"), most)


def metric_summary(entries: DataFrame, metrics: DataFrame) -> DataFrame:
    rows = metrics.join(entries.select("entry_id", "entry_date"), "entry_id")
    return rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), avg2(F.col("value")).alias("average"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date")
    )


def monthly_metric(entries: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    rows = metrics.where(F.col("key") == key).join(entries.select("entry_id", "entry_date"), "entry_id")
    return rows.groupBy(month_key(F.col("entry_date")).alias("month")).agg(avg2(F.col("value")).alias("average"), F.count("*").alias("n"))


def metric_days(entries: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    rows = metrics.where(F.col("key") == key).join(entries.select("entry_id", "entry_date"), "entry_id")
    return rows.groupBy("entry_date").agg(avg2(F.col("value")).alias("value"), F.min("entry_id").alias("entry_id"))


def entries_by_metric(entries: DataFrame, metrics: DataFrame, key: str, most: int, highest: bool = True) -> DataFrame:
    rows = metrics.where(F.col("key") == key).join(entries.select("entry_id", "entry_date"), "entry_id").select("entry_id", "entry_date", "value")
    return limited(rows.orderBy(F.desc("value") if highest else F.asc("value"), "entry_date", "entry_id"), most)


def metric_yes_no(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("key").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("yes_no"))


def metric_mood_split(entries: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mood below a metric's upper median, and from it on; yes/no metrics split at 1. The median is found by rank, not by a list."""
    rows = metrics.join(scored(entries).select("entry_id", "mood_score"), "entry_id")
    counts = rows.groupBy("key", "value").agg(F.count("*").alias("n"), F.sum(hundredths(F.col("mood_score"))).alias("s"))
    by = Window.partitionBy("key")
    counts = counts.withColumns({"upto": F.sum("n").over(by.orderBy("value")), "all": F.sum("n").over(by), "binary": F.bool_and(F.col("value").isin(0.0, 1.0)).over(by)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("value"))).over(by)
    counts = counts.withColumn("median", F.when(F.col("binary"), F.lit(1.0)).otherwise(middle))
    low = F.col("value") < F.col("median")
    total = lambda c, side: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0))
    return counts.groupBy("key", "median").agg(
        total("n", low).alias("n_low"), ratio2(total("s", low), total("n", low)).alias("mood_low"), total("n", ~low).alias("n_high"), ratio2(total("s", ~low), total("n", ~low)).alias("mood_high")
    )


def date_bounds(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"))


def cache_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def member_stats(entries: DataFrame, tags: DataFrame, kind: str, most: int = 5) -> DataFrame:
    """Per period: entries, average mood, and its commonest tags; ties by first appearance (day, entry, tag)."""
    dated = entries.withColumn("period", KEYS[kind](F.col("entry_date")))
    mood = dated.groupBy("period").agg(F.count("*").alias("entry_count"), avg2(F.col("mood_score")).alias("avg_mood"))
    seen = dated.select("entry_id", "entry_date", "period").join(tags, "entry_id").groupBy("period", "tag").agg(F.count("*").alias("n"), F.min(F.struct("entry_date", "entry_id", "tag")).alias("first"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= most)
    best = ranked.groupBy("period").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ",").alias("dominant_tags"))
    return mood.join(best, "period", "left").select("period", "entry_count", "avg_mood", F.coalesce("dominant_tags", F.lit("")).alias("dominant_tags"))


def mood_cube(entries: DataFrame) -> DataFrame:
    """Mood by year and month with subtotals."""
    rows = entries.select(F.year("entry_date").alias("year"), F.month("entry_date").alias("month"), "mood_score")
    return rows.rollup("year", "month").agg(avg2(F.col("mood_score")).alias("avg_mood"), F.count("*").alias("n"))
