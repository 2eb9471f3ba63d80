"""Quotes for the days that an answer cites: of each day's entries the sentence that says most of what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as rules

#: What a sentence of the part that matched counts for, and characters of a quote.
PART_BONUS, QUOTE_CHARS = 1.5, 280


def clipped(sentence: Column, terms: list[str], most: int = QUOTE_CHARS) -> Column:
    """At most so many characters of a sentence, around the first of the terms that it holds, with what is left out marked."""
    places = F.filter(F.array(*(F.instr(F.lower(sentence), F.lit(t)) for t in terms)), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(F.lit(0), F.least(first - most // 3, F.length(sentence) - most))
    cut = F.trim(F.substr(sentence, start + 1, F.lit(most)))
    before = F.when(start > 0, "…").otherwise("")
    after = F.when(start + most < F.length(sentence), "…").otherwise("")
    return F.when(F.length(sentence) <= most, sentence).otherwise(F.concat(before, cut, after))


def for_days(entries: DataFrame, days: DataFrame, terms: list[str], parts: DataFrame, most: int = QUOTE_CHARS, withheld: bool = False) -> DataFrame:
    """(entry_date, entry_id, quote, score) for each of `days` (entry_date) with an entry that holds a term.

    A term counts less the more sentences of its entry have it, so a name beats a common word; a sentence of the entry's part that the
    search matched (`parts`: entry_id, part) counts PART_BONUS times. The first sentence of equals, and the first entry of equals, are
    taken. Only the cited days' entries are cut. Where raw text is withheld there are no quotes. `terms` are as `tokens` gives them.
    """
    if withheld or not terms:
        return entries.limit(0).select("entry_date", "entry_id", F.lit("").alias("quote"), F.lit(0.0).alias("score"))
    own = entries.select("entry_date", "entry_id", "text").join(days.select("entry_date").distinct(), "entry_date", "left_semi")
    part = parts.groupBy("entry_id").agg(F.min("part").alias("part"))
    cut = own.join(part, "entry_id", "left").select("entry_date", "entry_id", "part", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("place", "sentence"))
    said = cut.withColumn("said", F.array_intersect(rules.tokens(F.col("sentence")), F.array(*map(F.lit, terms)))).where(F.size("said") > 0)
    words = said.select("entry_date", "entry_id", "part", "place", "sentence", F.explode("said").alias("term"))
    hits = words.groupBy("entry_id", "term").agg(F.count("*").alias("hits"))
    bonus = F.when(F.contains("part", "sentence"), PART_BONUS).otherwise(1.0)
    scored = words.join(hits, ["entry_id", "term"]).groupBy("entry_date", "entry_id", "place").agg(F.first("sentence").alias("sentence"), F.round(F.sum(1.0 / F.col("hits")) * F.first(bonus), 9).alias("score"))
    best = scored.groupBy("entry_date").agg(F.max(F.struct("score", (-F.col("entry_id")).alias("entry"), (-F.col("place")).alias("early"), "sentence")).alias("b"))
    return best.select("entry_date", (-F.col("b.entry")).alias("entry_id"), clipped(F.col("b.sentence"), terms, most).alias("quote"), F.col("b.score").alias("score"))
