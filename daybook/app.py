"""The engine as a user meets it: index a folder of Markdown into tables, then ask. `python -m daybook --help`."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import config as settings
from .functions import periods, text
from .operators import analytics, answer, broken, buckets, calls, digests, export, filters, incremental, links, model, privacy, search, sequences, stats, themes
from .sources import markdown, vault

TABLES = ("files", "entries", "entry_links", "entry_link_labels", "entry_tags", "entry_sections", "entry_metrics", "notes", "note_names", "titles", "note_property_values", "note_links", "entry_vectors")


def rules(config: settings.Config) -> markdown.Rules:
    v = config.vault
    return markdown.Rules(v.date_format, v.split, v.notes_path, tuple(v.private_tags), min_section=config.indexing.min_section, other_files=v.other_files, ignore=tuple(v.ignore))


#: The settings that a table hangs on beside its files: where they change, it is made anew of all files, from answers that are known.
#: `files` is how files are parsed: everything hangs on it.
HANGS_ON = {"entries": "mood", "entry_tags": "tags", "entry_metrics": "metrics"}


def fingerprints(config: settings.Config) -> dict[str, str]:
    """A hash of each group of settings."""
    v = config.vault
    groups = {
        "files": vars(rules(config)) | {"notes": v.notes_path},
        "mood": {"key": config.metrics.mood_key, "least": v.mood_scale_min, "most": v.mood_scale_max},
        "tags": {"merge": config.tags.merge, "ignore": config.tags.ignore},
        "metrics": {"keys": config.metrics.keys},
    }
    return {f"settings.{name}": incremental.fingerprint(group) for name, group in groups.items()}


def planned(spark: SparkSession, config: settings.Config, store: buckets.BucketStore, force: bool = False, named: list[str] | DataFrame = ()) -> tuple[DataFrame, DataFrame, set[str]]:
    """What a run has to do: the listing, the plan (path, change) and the tables that changed settings make anew. Nothing is written.

    `named` files and folders (or a table of files, path) alone are looked at; then nothing else is changed, and nothing vanishes but
    what is named.
    """
    listed = vault.listing(spark, config.vault.path, rules(config))
    known = store.table("files") if store.number else spark.createDataFrame([], "path string, content_hash string, status string, kind string")
    now = fingerprints(config)
    other = {name.partition(".")[2] for name, mark in now.items() if store.number and store.meta.get(name) != mark}
    if isinstance(named, DataFrame) or named:
        own = (lambda df: df.join(named.select("path").distinct(), "path", "left_semi")) if isinstance(named, DataFrame) else (lambda df: incremental.targeted(df, named))
        plan = incremental.plan(own(listed).select("path", "content_hash", "kind"), own(known), force)
        gone = own(known).join(listed.select("path"), "path", "left_anti").select("path", F.lit("vanished").alias("change"))
        return listed, plan.where("change <> 'vanished'").union(gone), set()
    plan = incremental.plan(listed.select("path", "content_hash", "kind"), known, force or "files" in other)
    return listed, plan, {table for table, group in HANGS_ON.items() if group in other}


class Staged:
    """What a run works on, written once: files as they were listed, parsed once. Gone when the run ends."""

    def __init__(self, store: buckets.BucketStore):
        self.store, self.folder = store, f"{store.folder}/staged/{uuid.uuid4().hex}"

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *_) -> None:
        buckets.remove(self.store.spark, self.folder)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.store.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def index(spark: SparkSession, config: settings.Config, folder: str, client: model.Client | None = None, force: bool = False, named: list[str] | DataFrame = (), dry_run: bool = False) -> DataFrame:
    """Brings the tables up to date with the vault; gives the plan (path, change).

    Only new and changed files are parsed and read by the model, one reading and one embedding an entry, and only their buckets are
    written. An entry whose reading fails is stored without one; its file is in error, and the next run tries it again. Changed settings
    make their tables anew without the model. A run that breaks off leaves the old state; what the model has said is kept. A vault that
    can't be listed, or is empty after it wasn't, changes nothing.
    """
    client = client or model.Offline()
    store = buckets.BucketStore(spark, folder)
    listed, plan, anew = planned(spark, config, store, force, named)
    if dry_run or (store.number and listed.isEmpty()):
        return plan
    plan.write.mode("overwrite").parquet(f"{store.folder}/plans/{store.number + 1}")
    plan = spark.read.schema("path string, change string").parquet(f"{store.folder}/plans/{store.number + 1}")
    touched = plan.where("change <> 'unchanged'").select("path")
    some = not touched.isEmpty()
    if store.number and not anew and not some:
        return plan
    log = calls.CallLog(spark, f"{store.folder}/calls")
    with Staged(store) as staged:
        changes = {}
        if some or not store.number:
            files = listed.join(plan.where("change NOT IN ('unchanged', 'vanished')"), "path", "left_semi")
            changes = {name: (df, touched) for name, df in _made(files, config, log, client, staged).items()}
        if anew:
            whole = _made(listed, config, log, client, staged, "all-")
            every = staged.table(listed.select("path").union(touched).distinct(), "every")
            changes |= {name: (whole[name], every) for name in anew}
        only_named = isinstance(named, DataFrame) or bool(named)
        store.commit(changes, None if only_named and store.number else fingerprints(config))
    return plan


def _made(files: DataFrame, config: settings.Config, log: calls.CallLog, client: model.Client, staged: Staged, name: str = "") -> dict[str, DataFrame]:
    """All tables' rows of some files, with the file's path. The model's answers come from its log."""
    own = rules(config)
    files = staged.table(files, f"{name}files")
    parsed, notes = (staged.table(df.withColumn(buckets.PATH, F.col("path")), f"{name}{kind}") for kind, df in (("entries", vault.entries(files, own)), ("notes", vault.notes(files, own))))
    mood = text.mood_scale(F.try_element_at("frontmatter", F.lit(config.metrics.mood_key))[0], config.vault.mood_scale_min, config.vault.mood_scale_max)
    read = model.read(log.answers(model.reading_prompts(parsed), client, "text"))
    entries = parsed.join(read.withColumnsRenamed({"mood_score": "read_mood", "tags": "read_tags"}), "entry_id", "left").withColumn("mood_score", F.coalesce(mood, "read_mood"))
    vectors = log.answers(model.embedding_prompts(entries.select(F.col("entry_id").alias("id"), "summary", F.col("raw_text").alias("text"))), client, "vector")
    tags = text.final_tags(F.coalesce("read_tags", F.array().cast("array<string>")), F.col("tags"), config.tags.merge, tuple(config.tags.ignore))
    numbers = parsed.select("entry_id", buckets.PATH, F.explode("frontmatter").alias("key", "values")).select("entry_id", F.lower("key").alias("key"), text.metric_value(F.col("values")[0]).alias("value"), buckets.PATH)
    if config.metrics.keys:
        numbers = numbers.where(F.col("key").isin(*[k.lower() for k in config.metrics.keys]))
    failed = entries.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error_message"))
    state = files.join(failed, "path", "left").select("path", "content_hash", F.when(F.col("error_message").isNull(), "indexed").otherwise("error").alias("status"), "kind", "error_message", F.col("path").alias(buckets.PATH))
    return vault.child_tables(parsed, notes, buckets.PATH) | {
        "files": state,
        "entries": entries.select("entry_id", "entry_date", F.col("raw_text").alias("text"), "word_count", "mood_score", "summary", F.col("path").alias("file_path"), buckets.PATH),
        "entry_tags": entries.select("entry_id", F.explode(tags).alias("tag"), buckets.PATH),
        "entry_metrics": numbers.where("value IS NOT NULL AND key <> 'date'").dropDuplicates(["entry_id", "key"]),
        "notes": notes.select("note_id", "title", "kind", F.col("raw_text").alias("text"), F.col("path").alias("file_path"), buckets.PATH),
        "entry_vectors": model.vectors(vectors).withColumnRenamed("id", "entry_id").join(parsed.select("entry_id", buckets.PATH), "entry_id"),
    }


@dataclass(frozen=True)
class Daybook:
    """The tables of one index run, and the questions a user asks of them. Every method gives a DataFrame."""

    spark: SparkSession
    folder: str
    version: int
    withheld_tags: tuple[str, ...] = ()
    withheld_kinds: tuple[str, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, folder: str, missing: bool = False, **withheld) -> Daybook | None:
        number = buckets.BucketStore(spark, folder).number
        if not number and not missing:
            raise ValueError(f"{folder} holds no tables: index first")
        return cls(spark, folder, number, **withheld) if number else None

    @cached_property
    def store(self) -> buckets.BucketStore:
        return buckets.BucketStore(self.spark, self.folder, self.version)

    def table(self, name: str) -> DataFrame:
        return self.store.table(name)

    @cached_property
    def view(self) -> dict[str, DataFrame]:
        """All tables, without what is withheld."""
        tables = {n: self.table(n) for n in TABLES}
        if not self.withheld_tags and not self.withheld_kinds:
            return tables
        hidden = tables["notes"].where(F.col("kind").isin(*self.withheld_kinds)).select("note_id") if self.withheld_kinds else tables["notes"].limit(0).select("note_id")
        targets = links.link_targets(tables["titles"], tables["note_names"])
        linking = links.resolve(tables["entry_links"], targets).join(hidden, "note_id", "left_semi").select("entry_id")
        return privacy.withhold(tables, privacy.withheld_entries(tables["entry_tags"], list(self.withheld_tags) or [""], linking), hidden)

    @property
    def entries(self) -> DataFrame:
        return self.view["entries"]

    @cached_property
    def entities(self) -> DataFrame:
        return links.resolve(self.view["entry_links"], links.link_targets(self.view["titles"], self.view["note_names"]))

    def note_ids(self, name: str) -> DataFrame:
        return links.find_notes(self.view["note_names"], self.view["titles"], name)

    def chosen(self, since=None, until=None, tag=None, about=None, group=None) -> DataFrame:
        """Entries by range, tag, note and group (key=value)."""
        notes = self.note_ids(about) if about else None
        members = filters.group_members(self.view["note_property_values"].select("note_id", "key", "value"), *group.split("=", 1)) if group else None
        return filters.EntryFilter(tag, notes, members).apply(filters.in_range(self.entries, since, until), self.view["entry_tags"], self.entities)

    def mood(self, **which) -> DataFrame:
        return stats.monthly_mood(self.chosen(**which)).orderBy("month")

    def stats(self) -> DataFrame:
        return stats.cache_stats({n: self.view[n] for n in ("entries", "notes", "entry_tags", "entry_links", "entry_metrics")})

    def streaks(self, **which) -> DataFrame:
        return sequences.writing_stats(self.chosen(**which), [])

    def tags(self, most: int = 20, **which) -> DataFrame:
        return stats.top_tags(self.chosen(**which), self.view["entry_tags"], most)

    def similar_tags(self) -> DataFrame:
        return links.similar_tags(self.view["entry_tags"]).orderBy("a", "b")

    def notes(self, most: int = 20, kind: str | None = None, **which) -> DataFrame:
        return stats.top_notes(self.chosen(**which), self.entities, self.view["notes"], most, kind)

    def linked_with(self, name: str) -> DataFrame:
        note = self.note_ids(name).agg(F.min("note_id")).first()[0]
        return links.linked_with(self.entities, note).join(self.view["notes"].select("note_id", "title", "kind"), "note_id").orderBy(F.desc("n"), "title")

    def groups(self, key: str, **which) -> DataFrame:
        return stats.property_groups(self.chosen(**which), self.entities, self.view["note_property_values"].select("note_id", "key", "value"), key).orderBy(F.desc("entries"), "value")

    def metric(self, key: str, **which) -> DataFrame:
        return stats.monthly_metric(self.chosen(**which), self.view["entry_metrics"], key.lower()).orderBy("month")

    def metrics(self) -> DataFrame:
        return stats.metric_summary(self.entries, self.view["entry_metrics"]).orderBy(F.desc("n"), "key")

    def lapsed(self, least: int = 5, months: int = 6, today: dt.date | None = None) -> DataFrame:
        cut = periods.months_before(today or dt.date.today(), months)
        return stats.lapsed_notes(self.entries, self.entities, least, cut).join(self.view["notes"].select("note_id", "title"), "note_id").orderBy(F.desc("links"), "title")

    def on_this_day(self, day: dt.date) -> DataFrame:
        found = sequences.on_month_day(self.entries, day.strftime("%m-%d")).where(F.col("entry_date") != F.lit(day))
        return found.select("entry_id", "entry_date", "mood_score", "summary").orderBy("entry_date")

    def show(self, day: dt.date) -> DataFrame:
        return export.collected(self.entries.where(F.col("entry_date") == F.lit(day)), self.view["entry_tags"], self.view["entry_metrics"])

    def note(self, name: str) -> DataFrame:
        """The notes of a name, with mentions, first and last day, and how many notes link them."""
        found = self.note_ids(name).select("note_id").distinct()
        targets = links.link_targets(self.view["titles"], self.view["note_names"]).withColumnRenamed("note_id", "to")
        linking = self.view["note_links"].join(targets, F.col("target") == F.col("key")).where("note_id <> to").groupBy(F.col("to")).agg(F.countDistinct("note_id").alias("backlinks"))
        linking = linking.withColumnRenamed("to", "note_id")
        mentions = stats.mention_stats(self.entries, self.entities)
        return self.view["notes"].join(found, "note_id", "left_semi").join(mentions, "note_id", "left").join(linking, "note_id", "left").orderBy("title")

    def similar(self, day: dt.date, most: int = 8) -> DataFrame:
        """Entries nearest to a day's first entry, the day's own left out."""
        own = self.entries.where(F.col("entry_date") == F.lit(day)).select("entry_id")
        vectors = self.view["entry_vectors"].withColumnRenamed("entry_id", "vec_id")
        query = vectors.join(own.withColumnRenamed("entry_id", "vec_id"), "vec_id", "left_semi").orderBy("vec_id").select("embedding")
        others = vectors.join(own.withColumnRenamed("entry_id", "vec_id"), "vec_id", "left_anti")
        near = search.nearest(others, query, most).withColumnRenamed("vec_id", "entry_id")
        return near.join(self.entries.select("entry_id", "entry_date", "summary"), "entry_id").orderBy("distance", "entry_id")

    def themes(self, count: int | None = None) -> DataFrame:
        """The entries' themes: how many entries, first and last day, the commonest tags."""
        placed = themes.group(self.view["entry_vectors"].withColumnRenamed("entry_id", "vec_id"), count)
        named = themes.shared_names(placed.select(F.col("vec_id").alias("entry_id"), "theme"), self.view["entry_tags"].select("entry_id", F.col("tag").alias("name")))
        tags = named.groupBy("theme").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("tags"))
        return themes.overview(placed, self.entries).drop("months").join(tags, "theme", "left").orderBy("theme")

    def ask(self, question: str, client: model.Client | None = None, today: dt.date | None = None, history=()) -> DataFrame:
        """(stage, answer): see operators/answer.py."""
        known = self.view["notes"].select("title", F.substring("text", 1, 280).alias("summary"), "text")
        stage, said = answer.answer(question, self.entries, client or model.Offline(), today or dt.date.today(), notes=known, history=list(history))
        return self.spark.createDataFrame([(stage, said)], "stage string, answer string")

    def prompts(self, client: model.Client | None = None, today: dt.date | None = None, days: int = 14) -> DataFrame:
        """Things to write about, from the last days' entries."""
        told = [r.text for r in answer.prompts_context(self.entries, today or dt.date.today(), days).select("text").collect()]
        reply = (client or model.Offline()).complete("\n\n".join(told)) if told else ""
        return self.spark.createDataFrame([(k, x) for k, x in enumerate(answer.listed(reply), 1)], "place int, prompt string")

    def rollup(self, kind: str = "all", client: model.Client | None = None, dry_run: bool = False, **which) -> DataFrame:
        """Writes the digests that are missing or stale and gives all stored ones; with dry_run the plan alone (kind, key, reason)."""
        kinds = digests.ORDER if kind == "all" else (kind,)
        own = digests.Digests(self.spark, f"{self.folder}/digests", client)
        if dry_run:
            return own.plan(self.entries, kinds=kinds, **which).orderBy("place", "key").select("kind", "key", "reason")
        own.refresh(self.entries, self.view["entry_tags"], kinds, **which)
        return own.stored().where(F.col("kind").isin(*kinds)).orderBy("kind", "key")

    def doctor(self) -> DataFrame:
        """(check, found, ok): tables that are there, entries without files, files in error, vectors that are missing."""
        files = self.table("files")
        lost = self.entries.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
        bare = self.entries.join(self.view["entry_vectors"], "entry_id", "left_anti")
        checks = {"entries": (self.entries, False), "files in error": (files.where("status = 'error'"), True), "entries without a file": (lost, True), "entries without a vector": (bare, True)}
        out = None
        for name, (df, none) in checks.items():
            one = df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found", ((F.col("found") == 0) == F.lit(none)).alias("ok"))
            out = one if out is None else out.union(one)
        return out

    def compare(self, first: str, second: str) -> DataFrame:
        sides = [filters.in_range(self.entries, *periods.bounds(*periods.parse(p))) for p in (first, second)]
        tags = analytics.changes(analytics.compare_counts(*sides, self.view["entry_tags"], "tag"), "tag").withColumnRenamed("tag", "name").withColumn("of", F.lit("tag"))
        titled = self.entities.join(self.view["notes"].select("note_id", "title"), "note_id").select("entry_id", F.col("title").alias("name")).distinct()
        notes = analytics.changes(analytics.compare_counts(*sides, titled, "name"), "name").withColumn("of", F.lit("note"))
        return tags.unionByName(notes).orderBy("of", "change", F.desc(F.abs("delta")), "name")

    def review(self, period: str) -> DataFrame:
        kind, key = periods.parse(period)
        first, last = periods.bounds(kind, key)
        return analytics.review_months(self.entries, first.year).orderBy("month") if kind == "year" else analytics.review_weeks(self.entries, str(first), str(last)).orderBy("week_first")

    def insights(self, **which) -> DataFrame:
        properties = self.view["note_property_values"].select("note_id", "key", "value")
        return analytics.insights(self.chosen(**which), self.view["entry_tags"], self.entities, self.view["notes"], properties, self.view["entry_metrics"])

    def unresolved(self) -> DataFrame:
        written = self.view["entry_links"].join(self.entries.select("entry_id", "entry_date"), "entry_id")
        keys = self.entries.select(text.folded(F.regexp_replace("file_path", r"^.*/|\.md$", "")).alias("key"), "entry_id")
        return links.unresolved(written, links.link_targets(self.view["titles"], self.view["note_names"]), keys).orderBy(F.desc("n"), "target")

    def broken(self) -> DataFrame:
        """Links that find nothing, most written first: why, and what may be done."""
        lost = self.unresolved().select("target", F.col("n").alias("entries"), F.lit(0).alias("notes"), F.col("last_date").alias("last"))
        key = text.folded(F.regexp_replace("path", r"^.*/|\.md$", "")).alias("key")
        tracked = self.table("files").where("status IN ('error', 'private')").select(key, "path", "status", "error_message")
        named = self.view["note_names"].join(self.view["notes"].select("note_id", "title"), "note_id")
        shared = links.shared_aliases(self.view["titles"], self.view["note_names"]).select("key").join(named, "key").groupBy("key").agg(F.collect_set("title").alias("titles"))
        none = self.spark.createDataFrame([], "key string, path string, state string")
        return broken.diagnose(lost, tracked, none, shared, named.select("key", "name", "title", "note_id")).orderBy(F.desc("entries"), "target")

    def unlinked(self) -> DataFrame:
        found = search.unlinked_mentions(self.entries.select("entry_id", "text"), self.view["note_names"], self.entities)
        return found.join(self.entries.select("entry_id", "entry_date"), "entry_id").orderBy(F.desc("entry_date"), "key")

    def search(self, question: str, most: int = 8, client: model.Client | None = None, **which) -> DataFrame:
        """Best first, with the best sentence: keywords and, where a model can embed the question, nearest vectors, fused."""
        rows = self.chosen(**which)
        words = [w for w in question.lower().split() if len(w) > 2 and w not in text.STOP_WORDS][:8]
        if client is None:
            found = answer.retrieve(answer.Plan(keywords=words), rows, most)
        else:
            asked = self.spark.createDataFrame([(client.embed(question),)], "embedding array<double>")
            docs = self.entries.select(F.col("entry_id").alias("doc_id"), "text")
            vectors = self.view["entry_vectors"].withColumnRenamed("entry_id", "vec_id")
            fused = search.hybrid(docs, vectors, words, asked, most, rows.select(F.col("entry_id").alias("doc_id")))
            found = rows.join(fused.withColumnRenamed("doc_id", "entry_id"), "entry_id").orderBy(F.desc("score"), "entry_id").drop("score")
        best = search.best_sentences(found.select(F.col("entry_id").alias("doc_id"), "text"), question).withColumnRenamed("doc_id", "entry_id")
        return found.join(best, "entry_id", "left").select("entry_id", "entry_date", "summary", "sentence")

    def digest(self, kind: str) -> DataFrame:
        return stats.member_stats(self.entries, self.view["entry_tags"], kind).orderBy("period")

    def export(self, **which) -> DataFrame:
        keys = [r.key for r in self.metrics().select("key").collect()]  # the metrics' names: columns of the result
        return export.csv_rows(self.chosen(**which), self.view["entry_tags"], self.view["entry_metrics"], keys).orderBy("entry_date", "entry_id")


def init(spark: SparkSession, path: str) -> DataFrame:
    """Writes settings for a vault where there are none yet."""
    from pathlib import Path

    file = Path(path)
    made = not file.exists()
    if made:
        file.write_text('[vault]\npath = "."\nnotes_path = "Links"\n\n[tags]\nignore = []\n')
    return spark.createDataFrame([(str(file), made)], "path string, made boolean")


def apply_due(spark: SparkSession, config: settings.Config, folder: str, due: DataFrame, waiting: str, client: model.Client | None = None) -> bool:
    """Indexes the files of `due` (path, kind, ts, event_id, attempts) in one commit. Where the model can't be reached they are written
    to `waiting`, with one attempt more, and nothing is changed."""
    if due.isEmpty():
        return True
    rows = due.persist()
    try:
        index(spark, config, folder, client, named=rows.select("path"))
        return True
    except Exception as wrong:
        if "ConnectionError" not in str(wrong):
            raise
        rows.select("path", "kind", "ts", "event_id", (F.col("attempts") + 1).alias("attempts")).write.mode("append").parquet(waiting)
        return False
    finally:
        rows.unpersist()


def watch(spark: SparkSession, config: settings.Config, folder: str, client: model.Client | None = None, quiet: float = 45.0, every: str = "1 second"):
    """Indexes what changes, once it has been quiet for a while; gives the running stream.

    The folder's changes are a stream of listings' differences, the debounce is its state, and each batch of due files is one commit.
    Where the model can't be reached the files wait again, unless something newer has happened to them. Both survive a restart: listings,
    state and waiting files lie beside the tables.
    """
    from .sources import changes
    from .streaming.debounce import debounced

    changes.register(spark)
    index(spark, config, folder, client)
    waiting, columns = f"{folder}/watch/again", "path string, kind string, ts timestamp, event_id long, attempts int"
    spark.createDataFrame([], columns).write.mode("append").parquet(waiting)
    found = spark.readStream.format("vault_changes").option("path", config.vault.path).option("state", f"{folder}/watch/listings").load()
    new = found.select("path", F.when(F.col("kind") == "delete", "delete").otherwise("change").alias("kind"), F.coalesce("ts", F.current_timestamp()).alias("ts"), "event_id", F.lit(0).alias("attempts"), F.lit(False).alias("again"))
    again = spark.readStream.schema(columns).parquet(waiting).withColumn("again", F.lit(True))

    def apply(batch: DataFrame, number: int) -> None:
        apply_due(spark, config, folder, batch, waiting, client)

    stream = debounced(new.unionByName(again), quiet).writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/watch/checkpoint")
    return stream.trigger(processingTime=every).start()


def _names(book: Daybook, kind: str) -> DataFrame:
    from .serve import completions

    return book.spark.createDataFrame([(x,) for x in completions(book, kind, "")], "name string")


def _serve(book: Daybook, port: int | None) -> DataFrame:
    from .serve import Rpc, http_server

    if port is None:
        Rpc(book).serve()
    else:
        http_server(book, port).serve_forever()
    return book.spark.range(0)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("daybook", description="Questions to a folder of dated writing.")
    p.add_argument("--tables", default="daybook-tables", help="folder of the tables")
    p.add_argument("--config", help="settings (TOML)")
    p.add_argument("--json", action="store_true", help="one JSON object for each row")
    common = argparse.ArgumentParser(add_help=False)
    for name in ("since", "until", "tag", "about", "group"):
        common.add_argument(f"--{name}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("mood", "streaks", "tags", "notes", "insights", "export"):
        sub.add_parser(name, parents=[common])
    rollup = sub.add_parser("rollup")
    rollup.add_argument("kind", choices=["all", *digests.ORDER])
    rollup.add_argument("--dry-run", action="store_true")
    indexing = sub.add_parser("index")
    indexing.add_argument("paths", nargs="*")
    indexing.add_argument("--force", action="store_true")
    indexing.add_argument("--dry-run", action="store_true")
    for name in ("watch", "stats", "metrics", "links", "unlinked", "lapsed", "similar-tags", "themes", "prompts", "doctor", "mcp"):
        sub.add_parser(name)
    for name, argument in (("search", "question"), ("groups", "key"), ("metric", "key")):
        sub.add_parser(name, parents=[common]).add_argument(argument)
    for name, argument in (("linked-with", "name"), ("on-this-day", "day"), ("show", "day"), ("review", "period"), ("digest", "kind"), ("note", "name"), ("similar", "day"), ("ask", "question"), ("complete", "kind"), ("browse", "port"), ("init", "path")):
        sub.add_parser(name).add_argument(argument)
    compare = sub.add_parser("compare")
    compare.add_argument("first")
    compare.add_argument("second")
    return p


def run(spark: SparkSession, arguments: list[str]) -> DataFrame:
    a = _parser().parse_args(arguments)
    config = settings.load(a.config) if a.config else settings.Config()
    if a.command == "index":
        return index(spark, config, a.tables, force=a.force, named=a.paths, dry_run=a.dry_run)
    if a.command == "init":
        return init(spark, a.path)
    if a.command == "watch":
        watch(spark, config, a.tables).awaitTermination()
        return spark.range(0)
    book = Daybook.open(spark, a.tables, withheld_tags=tuple(config.withheld_tags), withheld_kinds=tuple(config.withheld_kinds))
    which = {k: v for k in ("since", "until", "tag", "about", "group") if (v := getattr(a, k, None))}
    day = lambda: dt.date.fromisoformat(a.day)
    return {
        "mood": lambda: book.mood(**which), "streaks": lambda: book.streaks(**which), "tags": lambda: book.tags(**which), "notes": lambda: book.notes(**which),
        "insights": lambda: book.insights(**which), "export": lambda: book.export(**which), "stats": book.stats, "metrics": book.metrics, "links": book.broken,
        "unlinked": book.unlinked, "lapsed": book.lapsed, "similar-tags": book.similar_tags, "search": lambda: book.search(a.question, **which), "groups": lambda: book.groups(a.key, **which),
        "metric": lambda: book.metric(a.key, **which), "linked-with": lambda: book.linked_with(a.name), "on-this-day": lambda: book.on_this_day(day()), "show": lambda: book.show(day()),
        "note": lambda: book.note(a.name), "similar": lambda: book.similar(day()), "themes": book.themes, "ask": lambda: book.ask(a.question), "prompts": book.prompts,
        "rollup": lambda: book.rollup(a.kind, dry_run=a.dry_run), "doctor": book.doctor, "complete": lambda: _names(book, a.kind), "mcp": lambda: _serve(book, None), "browse": lambda: _serve(book, int(a.port)),
        "review": lambda: book.review(a.period), "digest": lambda: book.digest(a.kind), "compare": lambda: book.compare(a.first, a.second),
    }[a.command]()


def main() -> None:
    spark = SparkSession.builder.appName("daybook").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    found = run(spark, sys.argv[1:])
    if "--json" in sys.argv:
        for row in found.toLocalIterator():
            print(json.dumps(row.asDict(True), default=str, ensure_ascii=False))
    else:
        found.show(200, 100)


if __name__ == "__main__":
    main()
