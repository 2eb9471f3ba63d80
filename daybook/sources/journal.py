"""The journal's tables as DataFrames: from a folder of Parquet tables, or mapped from the driver's star schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Journal:
    """Lazy tables over the star schema: orders are entries, parts notes, lineitems links, events a stream."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def entries(self) -> DataFrame:
        mood = F.when(F.col("o_orderstatus") != "P", (2 * F.substring("o_orderpriority", 1, 1).cast("int")).cast("double"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("entry_id"),
            F.to_date("o_orderdate").alias("entry_date"),
            F.col("o_custkey").alias("author"),
            mood.alias("mood_score"),
            F.floor("o_totalprice").cast("long").alias("word_count"),
        )

    @cached_property
    def notes(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("note_id"), F.col("p_name").alias("title"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").cast("string").alias("size")
        )

    @cached_property
    def written_entities(self) -> DataFrame:
        """As they are written: a note that an entry names twice is two rows."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("note_id"))

    @cached_property
    def entry_entities(self) -> DataFrame:
        return self.written_entities.distinct()

    @cached_property
    def entry_tags(self) -> DataFrame:
        item = self.table("lineitem")
        tags = item.select(F.col("l_orderkey").alias("entry_id"), F.explode(F.array(F.lower("l_returnflag"), F.lower("l_linestatus"))).alias("tag"))
        return tags.union(self.table("orders").select("o_orderkey", F.lower("o_orderpriority"))).distinct()

    @cached_property
    def entry_metrics(self) -> DataFrame:
        sums = self.table("lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("quantity"), F.count("*").cast("double").alias("lines"))
        both = F.array(F.struct(F.lit("quantity").alias("key"), F.col("quantity").alias("value")), F.struct(F.lit("lines").alias("key"), F.col("lines").alias("value")))
        return sums.select("entry_id", F.inline(both))

    @cached_property
    def property_values(self) -> DataFrame:
        pairs = F.array(F.struct(F.lit("brand").alias("key"), F.col("brand").alias("value")), F.struct(F.lit("size").alias("key"), F.col("size").alias("value")))
        return self.notes.select("note_id", F.inline(pairs))

    @cached_property
    def note_names(self) -> DataFrame:
        parts = self.notes.select("note_id", F.lower("title").alias("key"), F.col("title").alias("name"))
        people = self.table("supplier").select((1_000_000 + F.col("s_suppkey")).alias("note_id"), F.lower("s_name").alias("key"), F.col("s_name").alias("name"))
        return parts.union(people)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def user_days(self) -> DataFrame:
        return self.events.select("user_id", F.to_date("ts").alias("day")).distinct()


#: The same views in SQL, for the oracles.
VIEWS = {
    "entries": "SELECT o_orderkey AS entry_id, CAST(o_orderdate AS DATE) AS entry_date, o_custkey AS author, CASE WHEN o_orderstatus <> 'P' THEN CAST(2 * CAST(substr(o_orderpriority, 1, 1) AS INT) AS DOUBLE) END AS mood_score, CAST(floor(o_totalprice) AS BIGINT) AS word_count FROM orders",
    "notes": "SELECT p_partkey AS note_id, p_name AS title, lower(p_type) AS kind, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part",
    "entry_entities": "SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS note_id FROM lineitem",
    "entry_tags": "SELECT l_orderkey AS entry_id, lower(l_returnflag) AS tag FROM lineitem UNION SELECT l_orderkey, lower(l_linestatus) FROM lineitem UNION SELECT o_orderkey, lower(o_orderpriority) FROM orders",
    "entry_metrics": "SELECT l_orderkey AS entry_id, 'quantity' AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'lines', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1",
    "property_values": "SELECT p_partkey AS note_id, 'brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part",
    "note_names": "SELECT p_partkey AS note_id, lower(p_name) AS key, p_name AS name FROM part UNION ALL SELECT 1000000 + s_suppkey, lower(s_name), s_name FROM supplier",
    "user_days": "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events",
}
