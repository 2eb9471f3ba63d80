"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A text holds a test item if it has 3/4 of the item's distinct five-word shingles. An item of n shingles may then miss n/4 of
them, so of any n/4 + 1 it has one: the item's bottom MinHash sketch is that long, by size partition. Documents that hold a
sketch value are candidates (none is lost), and only their whole texts are read again and compared exactly.
Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, spaced_words

WIDTH = 5
#: Of an item's shingles, in a hundred, that a contaminated text has at least.
PERCENT = 75
#: Upper sizes of the partitions of items, in shingles; each has one sketch length. Larger items: their own size.
SIZES = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: A side of at most so many rows (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def _shingles(words: Column) -> Column:
    """Distinct hashes of the runs of five words; fewer words are one run; none without words. `words` must be a plain column."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _shingled(df: DataFrame, *keys: str) -> DataFrame:
    words = df.select(*keys, spaced_words(F.lower("text")).alias("words"))
    return words.select(*keys, _shingles(F.col("words")).alias("shingles"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _pairs(documents: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, hash, item_id, n_item, n_shared) of every text, named by its hash too, and version of an item that it holds."""
    items = _shingled(benchmark.select("item_id", "text"), "item_id").where("item_id IS NOT NULL")
    items = items.select("item_id", F.array_distinct("shingles").alias("shingles")).where("size(shingles) > 0").distinct()
    items = scratch.table(items.select("item_id", "shingles", F.size("shingles").alias("n_item"), F.xxhash64("shingles").alias("variant")), "items")
    upper = F.coalesce(*(F.when(F.col("n_item") <= s, F.lit(s)) for s in SIZES), F.col("n_item"))
    ranked = F.transform(F.sort_array(F.transform("shingles", lambda h: F.struct(F.xxhash64(h).alias("order"), h.alias("h")))), lambda x: x["h"])
    missing = F.floor(upper * F.lit(100 - PERCENT) / 100).cast("int")
    sketch = items.select(F.explode(F.slice(ranked, F.lit(1), missing + 1)).alias("h")).distinct()
    sketch = scratch.table(sketch, "sketch")

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    # explode_outer: for explode, the optimiser adds a filter that computes the shingles' words anew for each shingle
    probes = _shingled(texts, "doc_id", "hash").select("doc_id", "hash", F.explode_outer("shingles").alias("h"))
    candidates = scratch.table(probes.join(_small(sketch), "h", "left_semi").select(F.col("doc_id").alias("id"), F.col("hash").alias("of")).distinct(), "candidates")
    read = texts.join(candidates, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")), "left_semi")
    exact = _shingled(read, "doc_id", "hash").select("doc_id", "hash", F.explode_outer("shingles").alias("h")).distinct()
    every = items.select("item_id", "variant", "n_item", F.explode("shingles").alias("h"))
    shared = exact.join(_small(every), "h").groupBy("doc_id", "hash", "item_id", "variant", "n_item").agg(F.count("*").alias("n_shared"))
    found = shared.where(100 * F.col("n_shared") >= PERCENT * F.col("n_item"))
    return found.select("doc_id", "hash", "item_id", "n_item", "n_shared")


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every pair of which the document holds 3/4 of the item.

    Letters are compared in lower case. Null and empty texts and items have no shingles and match nothing; an item of fewer than five
    words matches only documents that are those words. Repeated documents or items give each pair once, its largest containment;
    documents without doc_id are told apart by their text. Other columns are not read; no documents or no items give no rows.
    """
    scratch = Scratch(documents.sparkSession, "decontam")
    found = _pairs(documents, benchmark, scratch).withColumn("nameless", F.when(F.col("doc_id").isNull(), F.col("hash")))
    best = found.groupBy("doc_id", "nameless", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("b"))
    return scratch.result(best.select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").alias("n_shared"), F.col("b.containment").alias("containment")))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, unchanged, that hold no benchmark item. Each text is judged by itself, whatever its doc_id."""
    scratch = Scratch(documents.sparkSession, "decontam")
    found = scratch.result(_pairs(documents, benchmark, scratch).select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")).distinct())
    return documents.join(_small(found), documents.doc_id.eqNullSafe(F.col("__id")) & (F.xxhash64(documents.text) == F.col("__hash")), "left_anti")


SQL = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, lower(coalesce(text, '')) AS text FROM documents
  UNION ALL SELECT 'b', item_id, lower(coalesce(text, '')) FROM benchmark
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t
), s AS (
  SELECT side, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), items AS (SELECT id AS item_id, len(s) AS n_item, unnest(s) AS x FROM s WHERE side = 'b'),
docs AS (SELECT id AS doc_id, unnest(s) AS x FROM s WHERE side = 'd')
SELECT doc_id, item_id, CAST(n_item AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM docs JOIN items ON docs.x = items.x GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""
