"""Filter interaction audit: what each filter of a chain removes, in every order, from counts of failure masks.

A document's failures are a mask with one bit for each filter. Counts of masks by part are all that is shuffled: a subset-zeta transform
of them gives the documents that survive every subset of the filters, for all and for those with a label. A step of an order is then the
difference between two subsets that differ in that step's filter, and a filter's Shapley sum a weighted sum of such differences.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, spaced_words

#: The filters asked for (fixed values): least words, least per cent of distinct words, most per cent of capitals, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, "[#$%&*|]"
FILTERS = "ABCDE"
#: So many filters at most, since every order is a row for each part and step: six have 720 orders.
MOST_FILTERS = 6


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D fail. Null counts as empty, which fails A alone."""
    words = spaced_words(text)
    n = F.size(words)
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0)).cast("int")


def failure_counts(documents: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each lang by the filters A to E that they fail, as bits 0 to 4.

    Texts are read once: what is known of each is written, a short row. Rows of one doc_id and text are summed before anything meets. A
    text's least doc_id joins the rows that have both, so that no task gathers a text's copies: what it joins doesn't fail E, nor does a
    null doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), text_failures(text).alias("mask"))
    # digests as two longs: shorter keys
    rows = rows.select("doc_id", "part", "mask", *(F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(name) for name, at in (("d1", 1), ("d2", 16))))
    rows = scratch.table(rows.groupBy("doc_id", "part", "d1", "d2", "mask").agg(F.count("*").alias("n")), "rows")
    first = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(first, ["doc_id", "d1", "d2"], "left").join(marks, "doc_id", "left")
    later = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    counted = lambda name: F.sum(F.col("n") * F.coalesce(name, F.lit(0))).alias(name)
    return rows.groupBy("part", (F.col("mask") + later).alias("mask")).agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def subset_sums(cells: DataFrame, names: tuple[str, ...], bits: int) -> DataFrame:
    """The columns `names`, arrays over all masks, with each mask's cell summed over all its subsets: the zeta transform, a pass a bit."""
    for k in range(bits):
        bit = 1 << k
        added = lambda c, b=bit: F.transform(c, lambda x, i: x + F.when(i.bitwiseAND(F.lit(b)) != 0, F.get(F.col(c), i - b)).otherwise(F.lit(0)))
        cells = cells.withColumns({c: added(c) for c in names})
    return cells


def shapley_weights(filters: int, k: int) -> list[int]:
    """Of each mask, how many orders count its subset sum towards what filter k removes: those in which all filters outside the mask
    come first, before filter k (added) or with it as the last of them (taken off)."""
    full = (1 << filters) - 1
    out = []
    for mask in range(full + 1):
        applied = (full ^ mask).bit_count()
        out.append(-factorial(applied - 1) * factorial(filters - applied) if not mask >> k & 1 else factorial(applied) * factorial(filters - 1 - applied))
    return out


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of all filters and step, from `counts` (part, mask, n, good, toxic): filter k fails where bit k is set.

    Returns part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Zeros are rows
    too; without counts there are no rows. A part has a cell a mask, in one row; parts are spread over tasks. A null part is a part.
    """
    size = len(filters)
    if not 0 < size <= MOST_FILTERS or len(set(filters)) < size:
        raise ValueError(f"1 to {MOST_FILTERS} filters of a letter each, not {filters!r}")
    full = (1 << size) - 1
    names = ("n", "good", "toxic")
    once = counts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in names))
    found = once.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("cells"))
    masks = F.sequence(F.lit(0), F.lit(full))
    dense = lambda c: F.transform(masks, lambda m: F.coalesce(F.try_element_at("cells", m)[c], F.lit(0).cast("long")))
    sums = subset_sums(found.select("part", *(dense(c).alias(c) for c in names)), names, size)
    # what survives a set of filters fails only others: the sum over the subsets of the set's complement
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    weighed = lambda k: F.aggregate(F.zip_with("n", F.lit(shapley_weights(size, k)), lambda x, w: x * w), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = sums.select("part", *names, F.array(*(weighed(k) for k in range(size))).alias("shares"), F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.posexplode(F.split("filter_order", "")).alias("nth", "letter")).withColumn("k", F.instr(F.lit(filters), F.col("letter")) - 1)
    earlier = F.transform(F.split(F.substring("filter_order", F.lit(1), F.col("nth")), ""), lambda x: F.when(x == "", 0).otherwise(F.power(F.lit(2), F.instr(F.lit(filters), x) - 1).cast("int")))
    rows = rows.withColumns({"bit": F.power(F.lit(2), F.col("k")).cast("int"), "before": F.lit(full) - F.aggregate(earlier, F.lit(0), lambda a, x: a + x)})
    at = lambda c, mask: F.get(F.col(c), mask)
    after = F.col("before") - F.col("bit")
    lost = lambda c: at(c, F.col("before")) - at(c, after)
    failing = at("n", F.lit(full)) - at("n", F.lit(full) - F.col("bit"))
    return rows.select(
        "part", "filter_order", (F.col("nth") + 1).alias("step"),
        at("n", after).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"),
        (at("n", F.col("bit")) - at("n", F.lit(0))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("k")).alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over all of `documents` (doc_id, text, lang), by lang; `labels` (doc_id, quality, toxic) mark what is lost.

    Null text and lang count as empty. A doc_id is good or toxic if any of its labels says so. Repeated rows count each; of copies of a
    text those with the least doc_id pass E, and those without a doc_id. Other columns are not read. No documents give no rows.
    """
    scratch = Scratch(documents.sparkSession, "audit")
    return scratch.result(audit(failure_counts(documents, labels, scratch)))


SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(first < doc_id, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)
), counts AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step) WHERE length(o) = 5
), judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS alone,
         failed <> '' AND regexp_matches(failed, '[' || earlier || '0]') AS gone FROM counts, steps
), summed AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed
"""
