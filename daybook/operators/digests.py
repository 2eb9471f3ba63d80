"""Stored digests of periods as a graph: weeks, months and spans of days from entries, years from their months.

A digest's input has a hash: of its entries, or for a year of its months' hashes, so what changes in an entry runs up the graph. A
digest is written anew where its hash isn't the one it was written from. Levels are written in an order that a stopped run profits from
(months, years, weeks, spans), each in a commit of its own, and only the buckets of periods that change are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.periods import KEYS
from . import model
from .buckets import PATH, BucketStore
from .calls import CallLog

#: Levels in the order in which they are written. Years need their months first; weeks are the most, and asked for least.
ORDER = ("month", "year", "week", "range")
#: Characters of lines that a prompt holds at most: what is beyond isn't told to the model, but counts in the hash and the numbers.
PROMPT_CHARS = 60_000
#: Tags that a digest names.
DOMINANT = 5
STORED = "kind string, key string, summary string, dominant_tags array<string>, avg_mood double, entry_count long, input_hash long"


def members(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, key) beside each entry of its week, its month and the spans that hold its day; `spans` (key, first, last).

    A span is joined by its days, of which it has a bounded number, so no entry is compared with a span that doesn't hold it.
    """
    dated = entries.where("entry_date IS NOT NULL")
    own = F.array(*(F.struct(F.lit(kind).alias("kind"), KEYS[kind](F.col("entry_date")).alias("key")) for kind in ("month", "week")))
    days = spans.select("key", F.explode(F.sequence("first", "last")).alias("entry_date"))
    in_spans = dated.join(days, "entry_date").withColumn("kind", F.lit("range"))
    return dated.withColumn("p", F.explode(own)).select("*", "p.kind", "p.key").drop("p").unionByName(in_spans)


def inputs(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, key, entry_count, input_hash) of every period that has entries."""
    mark = F.xxhash64("entry_id", "entry_date", "mood_score", F.coalesce("summary", F.lit("")))
    parts = members(entries, spans).groupBy("kind", "key").agg(F.count("*").alias("entry_count"), F.bit_xor(mark).alias("input_hash"))
    years = parts.where("kind = 'month'").groupBy(F.substring("key", 1, 4).alias("key")).agg(F.sum("entry_count").alias("entry_count"), F.bit_xor(F.xxhash64("key", "input_hash")).alias("input_hash"))
    return parts.unionByName(years.withColumn("kind", F.lit("year")))


def bounds(kind, key):
    """The first and last day of a period, as columns."""
    start = F.when(kind == "month", F.to_date(F.concat(key, F.lit("-01")))).when(kind == "year", F.to_date(F.concat(key, F.lit("-01-01")))).when(kind == "range", F.to_date(F.substring(key, 1, 10)))
    fourth = F.to_date(F.concat(F.substring(key, 1, 4), F.lit("-01-04")))  # always in the first week
    monday = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (F.substring(key, 7, 2).try_cast("int") - 1) * 7)
    start = F.coalesce(start, F.when(kind == "week", monday))
    end = F.when(kind == "month", F.last_day(start)).when(kind == "year", F.to_date(F.concat(key, F.lit("-12-31")))).when(kind == "week", F.date_add(start, 6)).otherwise(F.to_date(F.substring(key, 13, 10)))
    return start, end


def plan(now: DataFrame, stored: DataFrame, kinds: tuple[str, ...] = ORDER, only_stale: bool = True, since: str | None = None, until: str | None = None) -> DataFrame:
    """(place, kind, key, reason) of what is to be written: missing, stale or, unless only_stale, rebuild; and gone for stored digests
    without entries. `place` is the level's. `since` and `until` choose the periods that overlap them."""
    both = now.select("kind", "key", F.col("input_hash").alias("now")).join(stored.select("kind", "key", F.col("input_hash").alias("was")), ["kind", "key"], "full")
    reason = F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), "missing").when(F.col("was") != F.col("now"), "stale")
    reason = reason if only_stale else reason.otherwise("rebuild")
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    rows = both.select(place.alias("place"), "kind", "key", reason.alias("reason")).where(F.col("kind").isin(*kinds) & F.col("reason").isNotNull())
    start, end = bounds(F.col("kind"), F.col("key"))
    if since:
        rows = rows.where(end >= F.to_date(F.lit(since)))
    return rows.where(start <= F.to_date(F.lit(until))) if until else rows


def prompts(lines: DataFrame) -> DataFrame:
    """(kind, key, prompt) of `lines` (kind, key, day, place, line): in order, as many as a prompt holds."""
    order = Window.partitionBy("kind", "key").orderBy("day", "place")
    held = lines.withColumn("upto", F.sum(F.length("line") + 1).over(order)).where(F.col("upto") <= PROMPT_CHARS)
    told = F.sort_array(F.collect_list(F.struct("day", "place", "line")))
    return held.groupBy("kind", "key").agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("prompt"))


class Digests:
    """The digests in a folder."""

    def __init__(self, spark: SparkSession, folder: str, client: model.Client | None = None):
        self.spark, self.folder, self.client = spark, folder.rstrip("/"), client or model.Offline()
        self.store = BucketStore(spark, self.folder)
        self.log = CallLog(spark, f"{self.folder}/calls")

    def stored(self) -> DataFrame:
        return self.store.table("digests") if self.store.number else self.spark.createDataFrame([], STORED)

    def spans(self) -> DataFrame:
        """(key, first, last) of the spans of days that were asked for."""
        keys = self.stored().where("kind = 'range'")
        return keys.select("key", F.to_date(F.substring("key", 1, 10)).alias("first"), F.to_date(F.substring("key", 13, 10)).alias("last"))

    def plan(self, entries: DataFrame, **which) -> DataFrame:
        return plan(inputs(entries, self.spans()), self.stored(), **which)

    def ask_for(self, entries: DataFrame, tags: DataFrame, first: str, last: str) -> None:
        """Writes the digest of a span of days, which is kept up to date from then on."""
        span = self.spark.createDataFrame([(f"{first}..{last}",)], "key string").select("key", F.to_date(F.substring("key", 1, 10)).alias("first"), F.to_date(F.substring("key", 13, 10)).alias("last"))
        spans = self.spans().union(span).distinct()
        self._write("range", plan(inputs(entries, spans), self.stored(), ("range",)), entries, tags, spans)

    def refresh(self, entries: DataFrame, tags: DataFrame, kinds: tuple[str, ...] = ORDER, **which) -> list[tuple[str, int]]:
        """Writes what the plan says, level by level; how many of each. `entries` (entry_id, entry_date, mood_score, summary), `tags`
        (entry_id, tag). The model is asked once for each input; an answer that fails leaves its digest as it was."""
        out = []
        for kind in (k for k in ORDER if k in kinds):
            spans = self.spans()
            todo = plan(inputs(entries, spans), self.stored(), (kind,), **which)
            out.append((kind, self._write(kind, todo, entries, tags, spans)))
        return out

    def _write(self, kind: str, todo: DataFrame, entries: DataFrame, tags: DataFrame, spans: DataFrame) -> int:
        named = f"{self.folder}/plans/{self.store.number + 1}-{kind}"
        todo.write.mode("overwrite").parquet(named)
        todo = self.spark.read.schema("place int, kind string, key string, reason string").parquet(named)
        count = todo.count()
        if not count:
            return 0
        written = todo.where("reason <> 'gone'").select("kind", "key")
        if kind == "year":
            lines = self.stored().where("kind = 'month'").select(F.lit("year").alias("kind"), F.substring("key", 1, 4).alias("key"), F.col("key").alias("day"), F.lit(0).cast("long").alias("place"), F.concat_ws(": ", "key", "summary").alias("line"))
            rows = entries.where("entry_date IS NOT NULL").select("*", F.lit("year").alias("kind"), F.date_format("entry_date", "yyyy").alias("key"))
        else:
            rows = members(entries, spans)
            lines = rows.where(F.coalesce("summary", F.lit("")) != "").select("kind", "key", F.col("entry_date").cast("string").alias("day"), F.col("entry_id").alias("place"), F.concat_ws(": ", F.col("entry_date").cast("string"), "summary").alias("line"))
        rows, lines = (df.join(written, ["kind", "key"], "left_semi") for df in (rows, lines))
        asked = written.join(prompts(lines), ["kind", "key"], "left").select("kind", "key", F.xxhash64("kind", "key").alias("id"), F.coalesce("prompt", F.lit("")).alias("prompt"))
        answers = self.log.answers(asked.select("id", "prompt"), self.client, "text", {"for": "digest"})
        said = asked.select("kind", "key", "id").join(answers.where("error IS NULL"), "id").select("kind", "key", F.coalesce(F.get_json_object("value", "$.summary"), F.col("value")).alias("summary"))
        numbers = rows.groupBy("kind", "key").agg(F.round(F.avg("mood_score"), 2).alias("avg_mood"))
        counted = rows.select("kind", "key", "entry_id").join(tags, "entry_id").groupBy("kind", "key", "tag").agg(F.count("*").alias("n"))
        best = counted.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.desc("n"), "tag"))).where(F.col("nth") <= DOMINANT)
        dominant = best.groupBy("kind", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "tag"))), lambda x: x["tag"]).alias("dominant_tags"))
        made = said.join(inputs(entries, spans), ["kind", "key"]).join(numbers, ["kind", "key"], "left").join(dominant, ["kind", "key"], "left")
        path = F.concat_ws("/", "kind", "key").alias(PATH)
        made = made.select("kind", "key", "summary", F.coalesce("dominant_tags", F.array().cast("array<string>")).alias("dominant_tags"), "avg_mood", "entry_count", "input_hash", path)
        done = made.select(F.col(PATH).alias("path")).union(todo.where("reason = 'gone'").select(F.concat_ws("/", "kind", "key")))
        self.store = self.store.commit({"digests": (made, done)})
        return count
