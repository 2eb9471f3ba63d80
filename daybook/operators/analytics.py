"""Insights, comparisons and reviews: one DataFrame for each kind of finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.periods import month_key
from ..functions.rounding import avg2
from . import filters, links, stats

#: Least sample and least deviation of a finding; most findings of each kind.
SAMPLE, DEVIATION = 3, 0.8
CAPS = {"tag": 6, "note": 5, "group": 4, "metric": 4, "together": 3}


def _findings(rows: DataFrame, kind: str, name: Column, baseline: DataFrame) -> DataFrame:
    with_base = rows.join(F.broadcast(baseline.select(F.col("avg_mood").alias("baseline"))))
    magnitude = F.round(F.col("avg_mood") - F.col("baseline"), 2)
    found = with_base.select(F.lit(kind).alias("kind"), name.alias("name"), F.col("n").cast("long").alias("n"), "avg_mood", magnitude.alias("magnitude"))
    found = found.where(F.abs("magnitude") >= DEVIATION)
    order = Window.partitionBy("kind").orderBy(F.desc(F.abs("magnitude")), "name")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CAPS[kind]).drop("rank")


def _rhythm(rows: DataFrame, kind: str, bucket: str) -> DataFrame:
    """The best and the worst bucket, where they lie far enough apart."""
    usable = rows.where(F.col("n") >= SAMPLE)
    ends = usable.agg(F.max(F.struct("avg_mood", (-F.col(bucket)).alias("b"), "n")).alias("hi"), F.min(F.struct("avg_mood", F.col(bucket).alias("b"), "n")).alias("lo"), F.count("*").alias("k"))
    spread = F.round(F.col("hi.avg_mood") - F.col("lo.avg_mood"), 2)
    name = F.concat((-F.col("hi.b")).cast("string"), F.lit(">"), F.col("lo.b").cast("string"))
    found = ends.where("k >= 2").select(F.lit(kind).alias("kind"), name.alias("name"), F.col("hi.n").alias("n"), F.col("hi.avg_mood").alias("avg_mood"), spread.alias("magnitude"))
    return found.where(F.col("magnitude") >= DEVIATION)


def insights(entries: DataFrame, tags: DataFrame, entities: DataFrame, notes: DataFrame, properties: DataFrame, metrics: DataFrame) -> DataFrame:
    """(kind, name, n, avg_mood, magnitude) against the overall mood: tags, notes, groups, weekdays, seasons, metrics, pairs of tags."""
    base = stats.overall_mood(entries)
    tag = _findings(stats.tag_mood(entries, tags, SAMPLE), "tag", F.col("tag"), base)
    note = _findings(stats.note_mood(entries, entities, notes, SAMPLE), "note", F.concat_ws("/", "title", "kind"), base)
    grouped = _findings(stats.group_mood(entries, entities, properties, SAMPLE), "group", F.concat_ws("=", "key", "value"), base)
    split = stats.metric_mood_split(entries, metrics).where((F.col("n_low") >= SAMPLE) & (F.col("n_high") >= SAMPLE))
    gap = F.round(F.col("mood_high") - F.col("mood_low"), 2)
    metric = split.select(F.lit("metric").alias("kind"), F.col("key").alias("name"), F.col("n_high").alias("n"), F.col("mood_high").alias("avg_mood"), gap.alias("magnitude")).where(F.abs("magnitude") >= DEVIATION)
    pairs = links.tag_pairs(tags.join(entries.select("entry_id"), "entry_id", "left_semi"), SAMPLE)
    pairs = pairs.orderBy(F.desc("n"), "tag_a", "tag_b").limit(CAPS["together"])
    together = pairs.select(F.lit("together").alias("kind"), F.concat_ws("+", "tag_a", "tag_b").alias("name"), "n", F.lit(None).cast("double").alias("avg_mood"), F.col("n").cast("double").alias("magnitude"))
    parts = [tag, note, grouped, _rhythm(stats.weekday_mood(entries), "weekday", "weekday"), _rhythm(stats.month_of_year_mood(entries), "season", "month"), metric, together]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_counts(first: DataFrame, second: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """How often each name comes up in two sets of entries, with shares of the entries; `names` (entry_id, key)."""
    a = names.join(first.select("entry_id"), "entry_id", "left_semi").groupBy(key).agg(F.count("*").alias("n_first"))
    b = names.join(second.select("entry_id"), "entry_id", "left_semi").groupBy(key).agg(F.count("*").alias("n_second"))
    totals = first.agg(F.count("*").alias("all_first")).join(F.broadcast(second.agg(F.count("*").alias("all_second"))))
    both = a.join(b, key, "full").na.fill(0, ["n_first", "n_second"]).join(F.broadcast(totals))
    share = lambda n, all_: F.round(F.when(F.col(all_) > 0, F.col(n) / F.col(all_)).otherwise(0.0), 6)
    return both.select(key, "n_first", "n_second", share("n_first", "all_first").alias("share_first"), share("n_second", "all_second").alias("share_second"))


def changes(counts: DataFrame, key: str, least: int = 2, most: int = 8) -> DataFrame:
    """rising, falling, new and gone names, the largest change of share first."""
    delta = F.round(F.col("share_second") - F.col("share_first"), 6)
    change = (
        F.when(F.col("n_first") == 0, F.when(F.col("n_second") >= least, "new"))
        .when(F.col("n_second") == 0, F.when(F.col("n_first") >= least, "gone"))
        .when((delta > 0) & (F.col("n_second") >= least), "rising")
        .when((delta < 0) & (F.col("n_first") >= least), "falling")
    )
    rows = counts.select(key, "n_first", "n_second", delta.alias("delta"), change.alias("change")).where("change IS NOT NULL")
    order = Window.partitionBy("change").orderBy(F.desc(F.abs("delta")), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def fell_away(before: DataFrame, now: DataFrame, names: DataFrame, key: str, least: int = 3, most: int = 5) -> DataFrame:
    """Names that came up `least` times before, and now half as often or less."""
    counts = compare_counts(before, now, names, key).where((F.col("n_first") >= least) & (2 * F.col("n_second") <= F.col("n_first")))
    return counts.select(key, "n_first", "n_second").orderBy(F.desc(F.col("n_first") - F.col("n_second")), key).limit(most)


def review_months(entries: DataFrame, year: int) -> DataFrame:
    """Every month of a year, also without entries."""
    months = entries.sparkSession.range(12).select(F.format_string(f"{year}-%02d", (F.col("id") + 1).cast("int")).alias("month"))
    found = filters.in_range(entries, f"{year}-01-01", f"{year}-12-31").groupBy(month_key(F.col("entry_date")).alias("month")).agg(F.count("*").alias("entry_count"), avg2(F.col("mood_score")).alias("avg_mood"))
    return months.join(F.broadcast(found), "month", "left").na.fill(0, ["entry_count"])


def review_weeks(entries: DataFrame, first: str, last: str) -> DataFrame:
    """The ISO weeks of a range, cut to it: first and last day, entries, mood."""
    rows = filters.in_range(entries, first, last)
    monday = F.date_trunc("week", "entry_date").cast("date")
    found = rows.groupBy(monday.alias("monday")).agg(F.count("*").alias("entry_count"), avg2(F.col("mood_score")).alias("avg_mood"))
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    return found.select(F.greatest("monday", start).alias("week_first"), F.least(F.date_add("monday", 6), end).alias("week_last"), "entry_count", "avg_mood")


def profile_new(facts: DataFrame, since: str, until: str) -> DataFrame:
    """Facts first noted in a range, each text once, whatever its case."""
    order = Window.partitionBy(F.lower("fact")).orderBy("entry_date", "fact_id")
    rows = facts.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    return filters.in_range(rows, since, until)
