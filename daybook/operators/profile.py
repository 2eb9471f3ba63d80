"""What is known of the writer: facts found by scans, kept once each, folded into a profile, forgotten with their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Entries a scan reads at a time, facts folded at a time.
SCAN_BATCH, FOLD_BATCH = 8, 120


def unread(entries: DataFrame, scans: DataFrame) -> DataFrame:
    """Entries (text_hash) that no scan has read yet."""
    return entries.join(scans.select("text_hash"), "text_hash", "left_anti")


def batches(entries: DataFrame, size: int = SCAN_BATCH) -> DataFrame:
    """Entries with the number of the batch a scan reads them in, by day within each year, so that years are read side by side."""
    order = Window.partitionBy(F.year("entry_date")).orderBy("entry_date", "entry_id")
    return entries.withColumn("batch", F.concat_ws("-", F.year("entry_date"), F.floor((F.row_number().over(order) - 1) / size)))


def add_facts(known: DataFrame, found: DataFrame, entries: DataFrame) -> DataFrame:
    """Known facts and the new ones (text_hash, entry_date, category, fact): each once a text whatever its case, and only if its
    date is that of an entry with the text."""
    dated = found.join(entries.select("text_hash", "entry_date").distinct(), ["text_hash", "entry_date"], "left_semi")
    folded = dated.withColumn("folded_fact", F.lower(F.trim("fact")))
    once = folded.withColumn("rank", F.row_number().over(Window.partitionBy("text_hash", "folded_fact").orderBy("entry_date", "fact"))).where("rank = 1")
    new = once.join(known.select("text_hash", F.lower(F.trim("fact")).alias("folded_fact")), ["text_hash", "folded_fact"], "left_anti")
    return known.unionByName(new.select("text_hash", "entry_date", "category", "fact", F.lit(False).alias("folded")))


def to_fold(facts: DataFrame, most: int = FOLD_BATCH) -> DataFrame:
    """The oldest facts that aren't in the profile yet."""
    return facts.where("NOT folded").orderBy("entry_date", "text_hash", "fact").limit(most)


def mark_folded(facts: DataFrame, done: DataFrame) -> DataFrame:
    keys = ["text_hash", "fact"]
    marked = facts.join(done.select(*keys).withColumn("now", F.lit(True)), keys, "left")
    return marked.select("text_hash", "entry_date", "category", "fact", (F.col("folded") | F.coalesce("now", F.lit(False))).alias("folded"))


def prune(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Facts or scans of texts that still are an entry's."""
    return rows.join(entries.select("text_hash"), "text_hash", "left_semi")


def needs_update(facts: DataFrame) -> DataFrame:
    """One row: facts not folded yet, and whether any are."""
    return facts.agg(F.count_if(~F.col("folded")).alias("open"), (F.count_if(~F.col("folded")) > 0).alias("needed"))


def fold(facts: DataFrame, profile: str, write, size: int = FOLD_BATCH) -> tuple[str, DataFrame]:
    """The profile after write(profile, facts) has taken in all open facts, `size` at a time; and the facts, marked.

    The writer is a model's call on the driver: each call reads at most `size` facts.
    """
    while rows := to_fold(facts, size).collect():
        profile = write(profile, [r.fact for r in rows])
        done = facts.sparkSession.createDataFrame([(r.text_hash, r.fact) for r in rows], facts.select("text_hash", "fact").schema)
        facts = mark_folded(facts, done)
    return profile, facts
