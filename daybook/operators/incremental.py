"""Keyed writes and change detection: plans as DataFrames, one writer at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.periods import KEYS


def content_hash(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def dedupe_by_hash(docs: DataFrame, key: str) -> DataFrame:
    """One row for each content: the least key, and how many share it."""
    return docs.groupBy("content_hash").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def plan(listing: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """(path, change): new, changed, retry, switching, forced, unchanged or vanished. An empty listing lets nothing vanish."""
    found = listing.select("path", F.col("content_hash").alias("now"), "kind").join(files.select("path", F.col("content_hash").alias("was"), "status", F.col("kind").alias("was_kind")), "path", "full")
    some = listing.limit(1).select(F.lit(True).alias("some"))
    change = (
        F.when(F.col("now").isNull(), "vanished")
        .when(F.col("was").isNull(), "new")
        .when(F.col("was") != F.col("now"), "changed")
        .when(F.col("status") == "error", "retry")
        .when(~F.col("kind").eqNullSafe(F.col("was_kind")), "switching")
        .when(F.lit(force), "forced")
        .otherwise("unchanged")
    )
    return found.select("path", change.alias("change")).join(F.broadcast(some), F.lit(True), "left").where("change <> 'vanished' OR some").drop("some")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows without the new keys, and the new rows. Of new rows with one key the last by all columns wins."""
    rest = [c for c in new.columns if c not in keys]
    if rest:
        latest = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    else:
        latest = new.distinct()
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*old.columns))


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Rows of vanished files go from every table, by path or by the entries that the files held."""
    gone = tables["entries"].join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("entry_id")
    out = {}
    for name, df in tables.items():
        if "file_path" in df.columns:
            df = df.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        elif "path" in df.columns:
            df = df.join(paths.select("path"), "path", "left_anti")
        elif "entry_id" in df.columns:
            df = df.join(gone, "entry_id", "left_anti")
        out[name] = df
    return out


def period_hashes(entries: DataFrame, kind: str) -> DataFrame:
    """(period, n, input_hash): a digest is stale when its members' hash isn't the one it was written from."""
    member = F.xxhash64("entry_id", "entry_date", "mood_score", "word_count")
    return entries.groupBy(KEYS[kind](F.col("entry_date")).alias("period")).agg(F.count("*").alias("n"), F.bit_xor(member).alias("input_hash"))


def stale_periods(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Periods to write anew, and stored ones without entries (gone)."""
    both = stored.select("period", F.col("input_hash").alias("was")).join(current.select("period", F.col("input_hash").alias("now")), "period", "full")
    state = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "stale")
    return both.select("period", state.alias("state")).where("state IS NOT NULL")


def last_events(events: DataFrame, quiet_seconds: int, now) -> DataFrame:
    """The debounce of a batch: of each path the last event, if it has been quiet for so long."""
    order = Window.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_id"))
    last = events.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")
    return last.where(F.col("ts") <= F.lit(now) - F.expr(f"INTERVAL {quiet_seconds} SECONDS"))


#: Seconds between two attempts at what failed, the first and the longest; and minutes between two profile updates.
FIRST_WAIT, LONGEST_WAIT, PROFILE_MINUTES = 30, 3600, 30


def targeted(listing: DataFrame, named: list[str]) -> DataFrame:
    """The listed files that are named, or lie in a named folder. A name that fits nothing gives nothing."""
    wanted = F.lit(False)
    for name in named:
        name = name.strip("/")
        wanted = wanted | (F.col("path") == name) | F.startswith(F.col("path"), F.lit(name + "/"))
    return listing.where(wanted)


def backfill_order(plan_: DataFrame, listing: DataFrame) -> DataFrame:
    """(place, path, change) of what a run has to do: notes before entries, each by path."""
    todo = plan_.where("change NOT IN ('unchanged', 'vanished')").join(listing.select("path", "kind"), "path")
    order = Window.partitionBy(F.col("kind").isNull()).orderBy("path")
    rows = todo.select(F.col("kind").isNull().cast("int").alias("phase"), F.row_number().over(order).alias("place"), "path", "change")
    return rows.orderBy("phase", "place")


def outcomes(done: DataFrame) -> DataFrame:
    """(path, status, error_message) of a run's rows (path, error): one bad file is an error of its own, not the run's."""
    return done.select("path", F.when(F.col("error").isNull(), "indexed").otherwise("error").alias("status"), F.substring("error", 1, 500).alias("error_message"))


def call_counts(plan_: DataFrame, entries: DataFrame) -> DataFrame:
    """Model calls that a run will make: `entries` (path, sections, photos): a reading and an embedding, and one for each part."""
    todo = plan_.where("change NOT IN ('unchanged', 'vanished')").join(entries, "path")
    return todo.agg(F.count("*").alias("entries"), (2 * F.count("*") + F.coalesce(F.sum("sections"), F.lit(0)) + F.coalesce(F.sum("photos"), F.lit(0))).alias("calls"))


def requeue(waiting: DataFrame, failed: DataFrame, now) -> DataFrame:
    """The queue (path, kind, ts, attempts) with what an outage left undone, later with each attempt; a newer event of a path stays."""
    wait = F.least(F.lit(LONGEST_WAIT), FIRST_WAIT * F.pow(F.lit(2), F.col("attempts"))).cast("long")
    due = (F.unix_seconds(F.lit(now).cast("timestamp")) + wait).cast("timestamp")
    back = failed.join(waiting.select("path"), "path", "left_anti").select("path", "kind", due.alias("ts"), (F.col("attempts") + 1).alias("attempts"))
    return waiting.select("path", "kind", F.col("ts").cast("timestamp").alias("ts"), "attempts").union(back)


def due(last_run, now, minutes: int = PROFILE_MINUTES, waiting: int = 0) -> bool:
    """Whether a follow-up may run: its time has come, and nothing waits."""
    return not waiting and (last_run is None or (now - last_run).total_seconds() >= 60 * minutes)


def expand_delete(files: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """What a delete event takes: the path, or everything below it, that really is gone. An empty listing takes nothing."""
    under = files.where((F.col("path") == path) | F.startswith(F.col("path"), F.lit(path.rstrip("/") + "/"))).select("path")
    some = listing.limit(1).select(F.lit(True).alias("some"))
    return under.join(listing.select("path"), "path", "left_anti").join(F.broadcast(some)).select("path")


def fingerprint(settings: dict) -> str:
    """One hash of the settings that a table was made under."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=list).encode()).hexdigest()


def changed_settings(meta: DataFrame, wanted: dict[str, dict]) -> list[str]:
    """The groups of settings (private, photos, sections, links, tags) whose stored fingerprint isn't the one of `wanted`."""
    stored = {r["key"]: r["value"] for r in meta.where(F.col("key").isin(*[f"settings.{n}" for n in wanted])).collect()}
    return [n for n, group in wanted.items() if stored.get(f"settings.{n}") != fingerprint(group)]


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).select("value").first()
    return row.value if row else None


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(meta, meta.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def check_model(meta: DataFrame, model: str, width: int) -> None:
    """Refuses vectors of another model or width than the stored ones."""
    stored = get_meta(meta, "embed_model")
    if stored not in (None, f"{model}/{width}"):
        raise ValueError(f"vectors were made by {stored}, not {model}/{width}: index anew")


def prune_tags(tags: DataFrame, entries: DataFrame) -> DataFrame:
    """Tags of entries that still are."""
    return tags.join(entries.select("entry_id"), "entry_id", "left_semi")


def keep_notes(digests: DataFrame, inputs: DataFrame, key: str = "note_id") -> DataFrame:
    """Stored digests of what still has one."""
    return digests.join(inputs.select(key), key, "left_semi")
