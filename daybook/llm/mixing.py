"""Mixing sources to target weights: a low-discrepancy source schedule over shuffled equal-token blocks.

Slot i's golden-ratio point falls into one source's share of the target tokens. A source's documents, shuffled and repeated, are a
stream that is cut into blocks of BLOCK tokens, of which the last one taken ends where the target does. Slots are ranked per source
in parallel runs, and a source's k-th block is joined to its k-th slot.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACED_WORD, Scratch

#: Weights by a source's place in code-point order, repeating; the mix's tokens over all tokens; most repeats of a source.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Tokens of a block, at every size of the corpus.
BLOCK = 1024
#: Slots that a task places.
RUN = 1 << 18
GOLDEN = 0.6180339887498949
SEED = "daybook-mix-2"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, place, source_size, target) of each source of `sizes` (source, size): a small table, a row for each source.

    Water-filling: the level at which the weighted shares, each stopped at MOST times its source's size, spend the total.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("place", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rows = rows.withColumn("weight", weight).withColumn("most", (MOST * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", TOTAL * F.sum("source_size").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumns({"level": level, "nth": F.row_number().over(order)})
    held = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct("nth", "level"))).over(everything)["level"]
    rows = rows.withColumn("held", held)
    return rows.select("source", "place", "source_size", "total", F.least(F.col("most"), F.coalesce("held", F.lit(0.0)) * F.col("weight")).alias("target"))


def _placed(batches, uptos: np.ndarray, places: np.ndarray, counts: bool):
    """The slots' sources, ranked within each run: (place, run, nth, slot); or (place, run, n), how many each source has."""
    for batch in batches:
        for run, count in zip(batch.column("run").to_pylist(), batch.column("count").to_pylist(), strict=True):
            slot = np.arange(run * RUN, min((run + 1) * RUN, count))
            point = (slot + 0.5) * GOLDEN
            at = np.searchsorted(uptos, (point - np.floor(point)) * uptos[-1], side="right")
            order = np.argsort(at, kind="stable")
            order = order[at[order] < len(places)]
            own = at[order]
            if counts:
                which, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(places[which]), pa.array(np.full(len(which), run)), pa.array(n)], ["place", "run", "n"])
            else:
                nth = np.arange(len(own)) - np.searchsorted(own, own)
                yield pa.RecordBatch.from_arrays([pa.array(places[own]), pa.array(np.full(len(own), run)), pa.array(nth), pa.array(slot[order])], ["place", "run", "nth", "slot"])


def schedule(spark: SparkSession, shares: DataFrame, scratch: Scratch) -> DataFrame:
    """(place, block, slot): each source's slots in order, as many as all targets have blocks.

    Runs of slots are placed in parallel, first to count each source's slots of each run, then to number them from where the run
    before ends. The driver reads a row for each source.
    """
    rows = shares.select("place", "blocks", F.sum("target").over(Window.orderBy("place")).alias("upto")).orderBy("upto", "place").collect()
    uptos, places = np.array([r.upto for r in rows], np.float64), np.array([r.place for r in rows], np.int64)
    count = sum(r.blocks for r in rows)
    if not count:
        return spark.range(0).select(F.col("id").alias("place"), F.col("id").alias("block"), F.col("id").alias("slot"))
    n = math.ceil(count / RUN)
    runs = spark.range(0, n, 1, n).select(F.col("id").alias("run"), F.lit(count).cast("long").alias("count"))
    placing = partial(_placed, uptos=uptos, places=places)
    each = runs.mapInArrow(partial(placing, counts=True), "place long, run long, n long")
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    each = scratch.table(each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    slots = runs.mapInArrow(partial(placing, counts=False), "place long, run long, nth long, slot long")
    return slots.join(each, ["place", "run"]).select("place", (F.col("before") + F.col("nth")).alias("block"), "slot")


def mix_blocks(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, size, source_size, target), and (row, block, slot, words) for each block that takes words of one.

    A source's documents are shuffled by a hash of doc_id (of the text where that is null), in 4096 runs by the hash's head, so that
    no task orders a whole source; starts add up over runs. Ties of hash and size are alike. A block that the schedule has no slot
    for, of the few that it is off by, comes after all slots.
    """
    spark = documents.sparkSession
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce("text", F.lit("")))))
    sized = documents.select("doc_id", "source", token_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(SEED + ":"), name)).alias("h"))
    sized = scratch.table(sized.select("*", F.substring("h", 1, 3).alias("run"), F.monotonically_increasing_id().alias("row")), "sizes")
    shares = targets(sized).withColumn("spent", F.floor(F.col("target") + 0.5).cast("long"))
    shares = scratch.table(shares.withColumn("blocks", F.ceil(F.col("spent") / BLOCK).cast("long")), "targets")
    slots = scratch.table(schedule(spark, shares, scratch), "slots")
    total, sources = F.sum("blocks").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    plan = shares.select(F.col("source").alias("of"), "place", "source_size", "target", "spent", total.alias("count"), sources.alias("sources"))
    runs = sized.groupBy("source", "run").agg(F.sum("size").alias("tokens"))
    ahead = F.sum("tokens").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("source").alias("of_run"), F.col("run").alias("in_run"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    runs = runs.join(plan, F.col("of_run").eqNullSafe(F.col("of"))).drop("of")
    within = F.sum("size").over(Window.partitionBy("source", "run").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = sized.withColumn("within", F.coalesce(within, F.lit(0)))
    rows = rows.join(runs, F.col("source").eqNullSafe(F.col("of_run")) & (F.col("run") == F.col("in_run")))
    rows = rows.withColumn("start", F.col("ahead") + F.col("within"))
    rows = scratch.table(rows.select("row", "doc_id", "size", "source_size", "target", "place", "spent", "count", "sources", "start"), "placed")

    passes = F.array(*(F.col("start") + k * F.col("source_size") for k in range(MOST)))
    parts = rows.where("size > 0").select("row", "size", "place", "spent", "count", "sources", F.explode(passes).alias("start")).where("start < spent")
    parts = parts.withColumn("end", F.least(F.col("start") + F.col("size"), "spent"))
    first, last = F.floor(F.col("start") / BLOCK).cast("long"), F.floor((F.col("end") - 1) / BLOCK).cast("long")
    parts = parts.select("*", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least("end", (F.col("block") + 1) * BLOCK) - F.greatest("start", F.col("block") * BLOCK)
    after = F.col("count") + F.col("block") * F.col("sources") + F.col("place") - 1
    # numbers compress so well that a file of millions of slots looks small enough to broadcast
    joined = parts.join(slots.hint("merge"), ["place", "block"], "left")
    return rows, joined.select("row", "block", F.coalesce("slot", after).alias("slot"), words.alias("words"))


def mix(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and first_slot, the slot
    of the schedule at which its words first come (null where none do).

    Null text has size 0; a null source is a source of its own, the last. Reruns agree. No document is taken more than MOST times,
    and a source's taken words are its target, rounded. An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    rows, blocks = mix_blocks(documents, scratch)
    taken = blocks.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.select("row", "doc_id", "size", "source_size", "target").join(taken, "row", "left")
    return scratch.result(out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('daybook-mix-2:' || coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, '')))) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][(place - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * source_size AS most, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, row_number() OVER o AS nth,
         (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, place)
), t AS (SELECT source, place, source_size, least(most, coalesce((SELECT level FROM l WHERE level <= most / weight ORDER BY nth LIMIT 1), 0) * weight) AS target FROM l),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS spent, CAST(ceil(floor(target + 0.5) / 1024) AS BIGINT) AS blocks, sum(target) OVER (ORDER BY place) AS upto FROM t),
c AS (SELECT CAST(sum(blocks) AS BIGINT) AS n, count(*) AS sources, max(upto) AS upto FROM b),
i AS (SELECT unnest(range(0, (SELECT n FROM c))) AS slot),
p AS (SELECT ((slot + CAST(0.5 AS DOUBLE)) * CAST(0.6180339887498949 AS DOUBLE) - floor((slot + CAST(0.5 AS DOUBLE)) * CAST(0.6180339887498949 AS DOUBLE))) * (SELECT upto FROM c) AS u, slot FROM i),
g AS (SELECT slot, min(place) AS place FROM p JOIN b ON upto > u GROUP BY slot),
k AS (SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block FROM g),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
e AS (
  SELECT row, place, spent, start + pass * source_size AS a, least(start + pass * source_size + size, spent) AS z
  FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source, (VALUES (0), (1)) AS x(pass) WHERE size > 0 AND start + pass * source_size < spent
), f AS (SELECT row, place, a, z, unnest(range(CAST(floor(a / 1024) AS BIGINT), CAST(floor((z - 1) / 1024) AS BIGINT) + 1)) AS block FROM e),
r AS (
  SELECT row, sum(least(z, (f.block + 1) * 1024) - greatest(a, f.block * 1024)) AS taken, min(coalesce(slot, (SELECT n FROM c) + f.block * (SELECT sources FROM c) + f.place - 1)) AS first_slot
  FROM f LEFT JOIN k ON k.place = f.place AND k.block = f.block GROUP BY row
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(first_slot AS BIGINT) AS first_slot
FROM o JOIN b ON o.source IS NOT DISTINCT FROM b.source LEFT JOIN r ON r.row = o.row
"""
