"""Operators over order: streaks, neighbours, even samples, ranks. All as windows, by author or user where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.periods import month_day
from ..functions.rounding import ratio2
from .stats import limited


def islands(days: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Runs of consecutive days: first, last and length. `days` has each day once for each key."""
    order = Window.partitionBy(*by).orderBy(day)
    rows = days.withColumn("island", F.date_sub(F.col(day), F.row_number().over(order)))
    return rows.groupBy(*by, "island").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("days")).drop("island")


def streaks(days: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Days, the longest run (of equals, the first) and the one that ends on the last day written."""
    runs = islands(days, by, day)
    longest = F.max(F.struct(F.col("days").alias("n"), (-F.unix_date("first")).alias("early"), F.col("last").alias("end")))
    return runs.groupBy(*by).agg(F.sum("days").alias("days"), longest.alias("l"), F.max(F.struct("last", "days")).alias("c")).select(
        *by, "days", F.col("l.n").alias("longest"), F.col("l.end").alias("longest_end"), F.col("c.days").alias("current")
    )


def writing_stats(entries: DataFrame, by: list[str]) -> DataFrame:
    """Entries, words, days, words an entry, and streaks."""
    counted = entries.groupBy(*by).agg(F.count("*").alias("entries"), F.sum("word_count").alias("words"))
    runs = streaks(entries.select(*by, F.col("entry_date").alias("day")).distinct(), by)
    joined = counted.join(runs, by) if by else counted.crossJoin(runs)
    return joined.withColumn("avg_words", ratio2(F.col("words") * 100, F.col("entries")))


def adjacent_entries(entries: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("entry_date", "entry_id")
    return entries.select("entry_id", F.lag("entry_id").over(order).alias("previous_id"), F.lead("entry_id").over(order).alias("next_id"))


def even_sample(entries: DataFrame, by: list[str], most: int) -> DataFrame:
    """At most so many rows of each key, evenly spaced, with the first and the last; one keeps the last."""
    order = Window.partitionBy(*by).orderBy("entry_date", "entry_id")
    rows = entries.withColumns({"at": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*by))})
    if most == 1:
        return rows.where("at = n - 1").drop("at", "n")
    step = (F.col("n") - 1) / F.lit(float(most - 1))
    near = F.floor(F.col("at") / step)
    held = F.bround(near * step) == F.col("at")
    for k in (-1, 1):
        held = held | ((near + k).between(0, most - 1) & (F.bround((near + k) * step) == F.col("at")))
    return rows.where((F.col("n") <= most) | held).drop("at", "n")


def on_month_day(entries: DataFrame, day: str) -> DataFrame:
    """Entries of this month and day in any year."""
    return entries.where(month_day(F.col("entry_date")) == day)


def by_mood(entries: DataFrame, most: int, highest: bool) -> DataFrame:
    order = F.desc("mood_score") if highest else F.asc("mood_score")
    return limited(entries.where("mood_score IS NOT NULL").orderBy(order, "entry_date", "entry_id"), most)


def best_per(entries: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best days of each key."""
    order = Window.partitionBy(*by).orderBy(F.desc("mood_score"), "entry_date", "entry_id")
    return entries.where("mood_score IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def page(entries: DataFrame, most: int, skip: int, newest: bool = True) -> DataFrame:
    order = [F.desc("entry_date"), F.desc("entry_id")] if newest else [F.asc("entry_date"), F.asc("entry_id")]
    return entries.orderBy(*order).offset(skip).limit(most)


def last_turns(turns: DataFrame, most: int = 6) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def keep_history(asked: DataFrame, keep: int, since=None) -> DataFrame:
    """The newest `keep` rows of each conversation, none older than `since`."""
    order = Window.partitionBy("conversation").orderBy(F.desc("asked_at"), F.desc("asked_id"))
    rows = asked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("rank")
    return rows if since is None else rows.where(F.col("asked_at") >= F.lit(since))


def moving_mood(entries: DataFrame, days: int = 7) -> DataFrame:
    """For each day written, mood over it and the days before. The window orders days, of which a lifetime has some ten thousand."""
    daily = entries.groupBy("entry_date").agg(F.sum(F.round(F.col("mood_score") * 100).cast("long")).alias("s"), F.count("mood_score").alias("n"))
    window = Window.orderBy(F.unix_date("entry_date")).rangeBetween(1 - days, 0)
    return daily.select("entry_date", ratio2(F.coalesce(F.sum("s").over(window), F.lit(0)), F.sum("n").over(window)).alias("avg_mood"), F.sum("n").over(window).alias("n"))
