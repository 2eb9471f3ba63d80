"""Search in notes, sections and photos, and the hybrid retrieval over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import search

#: Notes that an answer reads at most, mentions from which a note has a digest.
NOTES_READ, DIGEST_MENTIONS = 12, 8


def notes_search(notes: DataFrame, names: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, note_id, score, rank) by title, names and text, all of equal weight: `notes` (note_id, title, text)."""
    named = names.groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("names"))
    docs = notes.join(named, "note_id", "left").select(F.col("note_id").alias("doc_id"), F.concat_ws(" ", "title", "names", "text").alias("text"))
    return search.bm25(docs, queries, most).withColumnRenamed("doc_id", "note_id")


def sections_search(sections: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, entry_id, section_id, score, rank): an entry ranks by its best section. `sections` (section_id, entry_id, heading, text)."""
    docs = sections.select(F.col("section_id").alias("doc_id"), F.concat_ws(" ", "heading", "text").alias("text"))
    owner = sections.select(F.col("section_id").alias("doc_id"), "entry_id")
    found = search.scores(docs, queries).join(owner, "doc_id")
    best = found.groupBy("query_id", "entry_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("early"))).alias("b"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    best = best.select("query_id", "entry_id", (-F.col("b.early")).alias("section_id"), F.col("b.score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def section_vectors(vectors: DataFrame, query: DataFrame, most: int) -> DataFrame:
    """(entry_id, section_id, distance): the entries of the nearest sections, each by its nearest. `vectors` (section_id, entry_id, embedding)."""
    near = search.distances(vectors.withColumnRenamed("section_id", "vec_id"), query).withColumnRenamed("vec_id", "section_id")
    best = near.groupBy("entry_id").agg(F.min(F.struct("distance", "section_id")).alias("b"))
    return best.select("entry_id", F.col("b.section_id").alias("section_id"), F.col("b.distance").alias("distance")).orderBy("distance", "entry_id").limit(most)


def photos_search(photos: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, entry_id, rank): entries by their best described photo. `photos` (photo_id, entry_id, description)."""
    return sections_search(photos.select(F.col("photo_id").alias("section_id"), "entry_id", F.lit("").alias("heading"), F.col("description").alias("text")), queries, most).select("query_id", "entry_id", "rank")


def linked_boost(entities: DataFrame, notes: DataFrame, entries: DataFrame, most: int) -> DataFrame:
    """(doc_id, rank): the newest entries that link any of some notes, as one more ranking."""
    linked = entities.join(notes.select("note_id"), "note_id", "left_semi").select("entry_id").distinct()
    newest = entries.join(linked, "entry_id", "left_semi").orderBy(F.desc("entry_date"), F.desc("entry_id")).limit(most)
    order = Window.orderBy(F.desc("entry_date"), F.desc("entry_id"))
    return newest.select(F.col("entry_id").alias("doc_id"), F.row_number().over(order).alias("rank"))


def retrieve(entries: DataFrame, rankings: list[DataFrame], most: int) -> DataFrame:
    """The entries that the rankings (doc_id, rank) fuse to, with their place; where they give none, the newest of those allowed."""
    spark = entries.sparkSession
    lists = None
    for k, one in enumerate(rankings):
        one = one.select(F.lit(k).alias("list"), "doc_id", F.col("rank").cast("int").alias("rank"))
        lists = one if lists is None else lists.union(one)
    newest = entries.orderBy(F.desc("entry_date"), F.desc("entry_id")).limit(most).select(F.lit(2).alias("way"), F.lit(0.0).alias("score"), "entry_id", "entry_date")
    if lists is None:
        fused = spark.range(0).select(F.col("id").alias("entry_id"), F.lit(0.0).alias("score"))
    else:
        fused = search.fuse(lists.join(entries.select(F.col("entry_id").alias("doc_id")), "doc_id", "left_semi"), most).withColumnRenamed("doc_id", "entry_id")
    found = fused.join(entries.select("entry_id", "entry_date"), "entry_id").select(F.lit(1).alias("way"), "score", "entry_id", "entry_date")
    both = found.union(newest)
    way = both.agg(F.min("way").alias("best"))
    order = Window.orderBy(F.desc("score"), F.desc("entry_date"), F.desc("entry_id"))
    return both.join(F.broadcast(way), F.col("way") == F.col("best")).select("entry_id", "entry_date", F.row_number().over(order).alias("place"))


def notes_for_answer(matched: DataFrame, entities: DataFrame, candidates: DataFrame, most: int = NOTES_READ) -> DataFrame:
    """(note_id, place): matched notes (note_id, rank) first, then those that the candidate entries link most, `most` in all."""
    linked = entities.join(candidates.select("entry_id"), "entry_id", "left_semi").groupBy("note_id").agg(F.count("*").alias("n"))
    rows = matched.select("note_id", F.lit(0).alias("way"), F.col("rank").cast("long").alias("by")).union(linked.select("note_id", F.lit(1), -F.col("n")))
    first = rows.groupBy("note_id").agg(F.min(F.struct("way", "by")).alias("f"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("f", "note_id"))).where(F.col("place") <= most).select("note_id", "place")


def digest_inputs(entries: DataFrame, entities: DataFrame, least: int = DIGEST_MENTIONS) -> DataFrame:
    """(note_id, mentions, avg_mood, usual_mood, first_date, last_date, input_hash) of notes with enough mentions.

    A digest is stale where its stored hash isn't this one.
    """
    from ..functions.rounding import avg2

    rows = entities.join(entries.select("entry_id", "entry_date", "mood_score"), "entry_id")
    found = rows.groupBy("note_id").agg(
        F.count("*").alias("mentions"), avg2(F.col("mood_score")).alias("avg_mood"), F.min("entry_date").alias("first_date"), F.max("entry_date").alias("last_date"),
        F.bit_xor(F.xxhash64("entry_id", "entry_date", "mood_score")).alias("input_hash"),
    )
    usual = entries.agg(avg2(F.col("mood_score")).alias("usual_mood"))
    return found.where(F.col("mentions") >= least).join(F.broadcast(usual)).select("note_id", "mentions", "avg_mood", "usual_mood", "first_date", "last_date", "input_hash")


def digest_sample(entries: DataFrame, entities: DataFrame, a_year: int = 6) -> DataFrame:
    """(note_id, entry_id, entry_date): of each note and year some entries, evenly spaced, for its digest."""
    from .sequences import even_sample

    rows = entities.join(entries.select("entry_id", "entry_date"), "entry_id").withColumn("year", F.year("entry_date"))
    return even_sample(rows, ["note_id", "year"], a_year).select("note_id", "entry_id", "entry_date")
