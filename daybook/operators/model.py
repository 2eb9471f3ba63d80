"""Calls of a language model as columns: an injected client, an offline stand-in, and a memo of results."""

from __future__ import annotations

import hashlib
import json
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class Client(Protocol):
    """What a model has to offer; it must pickle."""

    name: str

    def complete(self, prompt: str) -> str: ...

    def embed(self, text: str) -> list[float]: ...


class Offline:
    """Deterministic answers without a model: the first sentence as a summary, a hash as a vector."""

    name = "offline"

    def complete(self, prompt: str) -> str:
        from ..functions.text import sentences

        found = sentences(prompt)
        return json.dumps({"summary": (found or [""])[0][:200], "mood": None, "tags": []})

    def embed(self, text: str) -> list[float]:
        return [b / 255 for b in hashlib.sha256(text.encode()).digest()[:8]]


def memo_key(kind: str, model: str, prompt, options: dict | None = None):
    """Every input of a call in one hash; the size of the window doesn't count."""
    rest = json.dumps({k: v for k, v in sorted((options or {}).items()) if k != "num_ctx"})
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(model).alias("model"), prompt.alias("prompt"), F.lit(rest).alias("options"))), 256)


def identity(client: Client) -> str:
    """A model's name with its weights, where the client tells them: answers of other weights aren't the same answers."""
    weights = getattr(client, "weights", None)
    return f"{client.name}@{weights}" if weights else client.name


def call(prompts: DataFrame, client: Client, kind: str, memo: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """(id, key, value, error) for `prompts` (id, prompt): remembered results, else the model's. One bad row doesn't stop the rest.

    A connection error does: an outage must not be remembered as an answer.
    """

    def ask(batches):
        for batch in batches:
            values, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    values.append(client.complete(prompt) if kind == "text" else json.dumps(client.embed(prompt)))
                    errors.append(None)
                except ConnectionError:
                    raise
                except Exception as wrong:
                    values.append(None)
                    errors.append(str(wrong)[:500])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(values, pa.string()), pa.array(errors, pa.string())], ["id", "key", "value", "error"])

    keyed = prompts.select(F.col("id").cast("long").alias("id"), "prompt", memo_key(kind, identity(client), F.col("prompt"), options).alias("key"))
    schema = "id long, key string, value string, error string"
    if memo is None:
        return keyed.mapInArrow(ask, schema)
    known = memo.select("key", "value").dropDuplicates(["key"])
    held = keyed.join(known, "key").select("id", "key", "value", F.lit(None).cast("string").alias("error"))
    return held.union(keyed.join(known, "key", "left_anti").mapInArrow(ask, schema))


def remember(memo: DataFrame, results: DataFrame, kind: str, model: str) -> DataFrame:
    new = results.where("error IS NULL").select("key", F.lit(kind).alias("kind"), F.lit(model).alias("model"), "value").dropDuplicates(["key"])
    return memo.select("key", "kind", "model", "value").unionByName(new.join(memo.select("key"), "key", "left_anti"))


def readings(entries: DataFrame, client: Client | None = None, memo: DataFrame | None = None, top: float = 10.0) -> DataFrame:
    """(entry_id, mood_score, summary, tags, error): the model's reading of each entry, clamped to the scale."""
    return read(call(reading_prompts(entries), client or Offline(), "text", memo), top)


def reading_prompts(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("entry_id").alias("id"), F.col("raw_text").alias("prompt"))


def read(found: DataFrame, top: float = 10.0) -> DataFrame:
    """Answers (id, value, error) as readings."""
    fields = F.from_json("value", "summary string, mood double, tags array<string>")
    rows = found.select(F.col("id").alias("entry_id"), fields.alias("r"), "error")
    mood = F.when(F.col("r.mood").isNotNull(), F.greatest(F.lit(1.0), F.least(F.col("r.mood"), F.lit(float(top)))))
    return rows.select("entry_id", mood.alias("mood_score"), F.substring("r.summary", 1, 200).alias("summary"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"), "error")


def digests(members: DataFrame, client: Client | None = None, memo: DataFrame | None = None) -> DataFrame:
    """(id, summary) for `members` (period_id, day, line): one call for each period, over its lines in order."""
    lines = members.groupBy("period_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "line"))), lambda x: x["line"]), "\n").alias("prompt"))
    found = call(lines.select(F.col("period_id").alias("id"), "prompt"), client or Offline(), "text", memo)
    return found.select("id", F.get_json_object("value", "$.summary").alias("summary"), "error")


#: Attempts at a connection, seconds before the second; characters up to which a note is its own summary, photos of an
#: entry that are described and their largest file, characters of a description.
ATTEMPTS, FIRST_PAUSE, OWN_SUMMARY, PHOTOS, PHOTO_BYTES, DESCRIPTION = 3, 0.5, 280, 4, 20 << 20, 300


class Retrying:
    """A client that tries a lost connection again; a timeout is not tried again, since the model may still be at work."""

    def __init__(self, client: Client, attempts: int = ATTEMPTS, pause: float = FIRST_PAUSE):
        self.client, self.attempts, self.pause, self.name = client, attempts, pause, client.name

    def _again(self, call):
        import time

        for attempt in range(self.attempts):
            try:
                return call()
            except TimeoutError:
                raise
            except ConnectionError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.pause * 2**attempt)

    def complete(self, prompt: str) -> str:
        return self._again(lambda: self.client.complete(prompt))

    def embed(self, text: str) -> list[float]:
        return self._again(lambda: self.client.embed(text))


def structured(client: Client, prompt: str, fields: dict[str, type]) -> dict:
    """A reply as JSON with every field of its type; one that isn't is asked for once more, with what was wrong."""
    wrong = ""
    for _ in range(2):
        try:
            found = json.loads(client.complete(prompt + wrong))
            for name, kind in fields.items():
                if not isinstance(found.get(name), kind):
                    raise ValueError(f"{name} must be {kind.__name__}")
            return found
        except (ValueError, AttributeError) as error:
            wrong, last = f"\n\nThe last reply was not usable: {error}", error
    raise ValueError(f"no usable reply: {last}")


def note_summaries(notes: DataFrame, client: Client | None = None, memo: DataFrame | None = None) -> DataFrame:
    """(note_id, summary): a short note is its own summary, with spaces folded; others are the model's."""
    folded = F.trim(F.regexp_replace("raw_text", r"\s+", " "))
    short = notes.where(F.length(folded) <= OWN_SUMMARY).select("note_id", folded.alias("summary"))
    rest = notes.where(F.length(folded) > OWN_SUMMARY).select(F.col("note_id").alias("id"), F.col("raw_text").alias("prompt"))
    found = call(rest, client or Offline(), "text", memo)
    return short.union(found.select("id", F.substring(F.get_json_object("value", "$.summary"), 1, OWN_SUMMARY)))


def embeddings(rows: DataFrame, client: Client | None = None, memo: DataFrame | None = None, most: int = 8000) -> DataFrame:
    """(id, embedding) of `rows` (id, summary, text)."""
    return vectors(call(embedding_prompts(rows, most), client or Offline(), "vector", memo))


def vectors(found: DataFrame) -> DataFrame:
    return found.where("error IS NULL").select("id", F.from_json("value", "array<float>").alias("embedding"))


def embedding_prompts(rows: DataFrame, most: int = 8000) -> DataFrame:
    """(id, prompt): where the text is too long its summary leads, and it is cut."""
    lead = F.when((F.length("text") > most) & (F.coalesce("summary", F.lit("")) != ""), F.concat("summary", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return rows.select("id", F.substring(lead, 1, most).alias("prompt"))


def photos_to_describe(photos: DataFrame, most: int = PHOTOS) -> DataFrame:
    """Of each entry the first photos that aren't too large: `photos` (entry_id, place, path, bytes)."""
    from pyspark.sql import Window

    ranked = photos.where(F.col("bytes") <= PHOTO_BYTES).withColumn("nth", F.row_number().over(Window.partitionBy("entry_id").orderBy("place", "path")))
    return ranked.where(F.col("nth") <= most).drop("nth")


def detail_tier(words, short: int = 400, long_: int = 1000):
    """How much detail an entry's reading takes: none, some or full, by its words."""
    return F.when(words >= long_, "full").when(words >= short, "some").otherwise("none")


def register(spark) -> list[str]:
    """Makes the engine's column rules callable in SQL: as SQL functions where they are expressions, as Arrow functions elsewhere."""
    from ..functions.text import sentences, stem

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION week_key(d DATE) RETURNS STRING RETURN concat(lpad(extract(YEAROFWEEK FROM d), 4, '0'), '-W', lpad(weekofyear(d), 2, '0'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION month_key(d DATE) RETURNS STRING RETURN date_format(d, 'yyyy-MM')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_distance_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - vec_dot(a, b) / sqrt(vec_dot(a, a) * vec_dot(b, b))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(a, x -> x / sqrt(vec_dot(a, a)))")
    spark.udf.register("word_stem", F.pandas_udf(lambda words: words.map(lambda w: None if w is None else stem(w)), "string"))
    spark.udf.register("text_sentences", F.pandas_udf(lambda texts: texts.map(lambda t: sentences(t or "")), "array<string>"))
    return ["week_key", "month_key", "vec_dot", "vec_distance_cosine", "vec_normalize", "word_stem", "text_sentences"]
