"""Why a link finds nothing, and what to do about it: ten reasons in their order, and the name that a mistyped link is most like."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .links import near_keys

#: Least likeness of a lost link and a name, and least letters of such a link.
LIKENESS, LEAST_LETTERS = 0.85, 4
#: An alike name may have one letter less; within LIKENESS no more than 0.3 of the longer one's letters are edits.
NAME_LETTERS, NEAR = 3, 0.7
#: The reasons in the order in which they are looked for (fixed values).
REASONS = ("private", "errored", "hidden", "ignored", "outside", "shared_alias", "no_entry", "not_a_date", "typo", "missing")


def _alike(batches):
    for batch in batches:
        found = [SequenceMatcher(None, name, target).ratio() for target, name in zip(batch.column("target").to_pylist(), batch.column("key").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("target"), batch.column("key"), pa.array(found, pa.float64())], ["target", "key", "ratio"])


def closest(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(target, like_key): of each target the name that is most like it, of equals the last by its letters.

    Targets and names meet by equal parts (`near_keys`), so that none within LIKENESS is lost and not every name is tried.
    """
    long_ = targets.select(F.col("target").alias("key")).where(F.length("target") >= LEAST_LETTERS).distinct()
    pairs = near_keys(long_, NEAR, NAME_LETTERS, names.select("key").distinct()).select(F.col("a").alias("target"), F.col("b").alias("key"))
    tried = pairs.mapInArrow(_alike, "target string, key string, ratio double").where(F.col("ratio") >= LIKENESS)
    return tried.groupBy("target").agg(F.max(F.struct("ratio", "key")).alias("best")).select("target", F.col("best.key").alias("like_key"))


def diagnose(targets: DataFrame, tracked: DataFrame, files: DataFrame, shared: DataFrame, names: DataFrame) -> DataFrame:
    """(target, entries, notes, last, reason, path, like, like_id, why, fix) for each of `targets` (target, entries, notes, last).

    `tracked` (key, path, status, error_message): files in error or private. `files` (key, path, state): the vault's other files, state
    hidden, ignored or outside. `shared` (key, titles): aliases of several notes. `names` (key, name, title, note_id). Of several files
    of a key the first by path counts, of several names the least note. Every target has one row and one reason.
    """
    held = tracked.groupBy(F.col("key").alias("target")).agg(F.min(F.struct("path", "status", "error_message")).alias("t"))
    other = files.groupBy(F.col("key").alias("target")).agg(F.min(F.struct("path", "state")).alias("f"))
    alias = shared.groupBy(F.col("key").alias("target")).agg(F.sort_array(F.flatten(F.collect_set("titles"))).alias("titles"))
    rows = targets.join(held, "target", "left").join(other, "target", "left").join(alias, "target", "left")
    is_day = F.col("target").rlike(r"^\d{4}-\d{2}-\d{2}$")
    day = F.when(is_day & F.col("target").try_cast("date").isNotNull(), "no_entry").when(is_day, "not_a_date")
    known = F.when(F.col("t.status") == "private", "private").when(F.col("t").isNotNull(), "errored")
    known = F.coalesce(known, F.col("f.state"), F.when(F.col("titles").isNotNull(), "shared_alias"), day)
    rows = rows.withColumn("known", known)
    like = closest(rows.where("known IS NULL"), names)
    named = names.groupBy(F.col("key").alias("like_key")).agg(F.min(F.struct("note_id", "title", "name")).alias("n"))
    rows = rows.join(like.join(named, "like_key"), "target", "left")
    rows = rows.withColumn("reason", F.coalesce("known", F.when(F.col("n").isNotNull(), "typo"), F.lit("missing"))).withColumn("path", F.coalesce("t.path", "f.path"))
    why, fix = _words()
    return rows.select("target", "entries", "notes", "last", "reason", "path", F.col("n.title").alias("like"), F.col("n.note_id").alias("like_id"), why.alias("why"), fix.alias("fix"))


def _words():
    """What is said of each reason, and what may be done."""
    titles = F.array_join("titles", " and ")
    said = {
        "private": (F.concat("path", F.lit(" is private: links to it don't count.")), "Nothing, unless it should be public."),
        "errored": (F.concat(F.col("path"), F.lit(" could not be indexed: "), F.coalesce("t.error_message", F.lit("unknown"))), "Mend the file and index again."),
        "hidden": (F.concat("path", F.lit(" lies in a hidden folder.")), "Move it out if it is still used."),
        "ignored": (F.concat("path", F.lit(" is left out by the settings.")), "Take it out of the ignored files if it should count."),
        "outside": (F.concat("path", F.lit(" lies in no folder of notes.")), "Add its folder to the notes, or read other files too."),
        "shared_alias": (F.concat(F.lit("An alias of "), titles), "Link the note that is meant by its title."),
        "no_entry": (F.concat(F.lit("No entry of "), F.col("target")), "Write that day's entry, or mend the date."),
        "not_a_date": (F.concat("target", F.lit(" is no day of any year.")), "Mend the date."),
        "typo": (F.concat(F.lit("No note has that name, "), F.col("n.name"), F.lit(" is close.")), None),
        "missing": (F.lit("No note has that name yet."), "Write the note: links count from the next index."),
    }
    meant = F.concat(F.lit("Is [["), F.col("n.title"), F.lit("]] meant?"))
    pick = lambda k: F.coalesce(*(F.when(F.col("reason") == r, meant if x[k] is None else x[k] if k == 0 else F.lit(x[k])) for r, x in said.items()))
    return pick(0), pick(1)
