"""Table functions and parameters for SQL text: bursts and links as rows of a query, JSON arrays as relations, filters that may be absent."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn, OrderingColumn
from pyspark.sql.types import LongType, StringType, StructType, TimestampNTZType, TimestampType

from ..sources import markdown


class Bursts:
    """bursts(TABLE(rows), quiet_seconds): of each key's times the runs without a gap of `quiet_seconds`: key, first, last, n.

    The first column of the table is the key, the second the time. The function asks for its partitioning and order itself; a task holds
    one run's ends and count of a key, whatever the key's number of rows. Rows without a time belong to no burst.
    """

    def __init__(self):
        self.key, self.first, self.last, self.n, self.quiet = None, None, None, 0, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, quiet: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(rows.dataType, StructType) or len(rows.dataType) < 2:
            raise ValueError("bursts takes a table of a key and a time")
        key, time = rows.dataType.fields[:2]
        if not isinstance(time.dataType, (TimestampType, TimestampNTZType)):
            raise ValueError(f"{time.name} is no time")
        schema = StructType().add("key", key.dataType).add("first", time.dataType).add("last", time.dataType).add("n", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.name)], orderBy=[OrderingColumn(time.name)])

    def eval(self, row, quiet):
        key, time = row[0], row[1]
        self.quiet = quiet
        if time is None:
            return
        if self.n and time - self.last >= timedelta(seconds=quiet):
            yield self.key, self.first, self.last, self.n
            self.n = 0
        if not self.n:
            self.key, self.first = key, time
        self.last, self.n = time, self.n + 1

    def terminate(self):
        if self.n:
            yield self.key, self.first, self.last, self.n


class Links:
    """text_links(text): the links between double square brackets, in order: place, target (null for attachments), anchor, label."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType().add("place", LongType()).add("target", StringType()).add("anchor", StringType()).add("label", StringType()))

    def eval(self, text):
        for place, t in enumerate(markdown.targets(text or "")):
            yield place, t.key, t.anchor or None, t.label


def register(spark: SparkSession) -> list[str]:
    """Makes the table functions callable in SQL."""
    spark.udtf.register("bursts", F.udtf(Bursts))
    spark.udtf.register("text_links", F.udtf(Links))
    return ["bursts", "text_links"]


#: A filter whose parameters may each be absent: a JSON array of ids, the first and last day, the least mood.
CHOSEN = """
SELECT * FROM {entries}
WHERE (:ids IS NULL OR entry_id IN (SELECT explode(from_json(:ids, 'array<bigint>'))))
  AND (:since IS NULL OR entry_date >= CAST(:since AS DATE))
  AND (:until IS NULL OR entry_date <= CAST(:until AS DATE))
  AND (:mood IS NULL OR mood_score >= CAST(:mood AS DOUBLE))
"""


def chosen(entries: DataFrame, ids: str | None = None, since: str | None = None, until: str | None = None, mood: float | None = None) -> DataFrame:
    """Entries by parameters of a query. `ids` is a JSON array, of any length that fits a message: it's a relation, joined, not a list
    in the plan; an empty one chooses nothing, an absent one everything. A text that is no array of numbers chooses nothing."""
    if ids is None:
        text = CHOSEN.replace("(:ids IS NULL OR entry_id IN (SELECT explode(from_json(:ids, 'array<bigint>'))))", "true")
        return entries.sparkSession.sql(text, args={"since": since, "until": until, "mood": mood}, entries=entries)
    text = CHOSEN.replace(":ids IS NULL OR ", "")
    return entries.sparkSession.sql(text, args={"ids": ids, "since": since, "until": until, "mood": mood}, entries=entries)
