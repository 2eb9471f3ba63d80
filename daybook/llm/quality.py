"""Quality rules: counted text signals, and a hashed n-gram log-likelihood ratio against trusted documents.

Main path: DataFrame functions only. Nothing but 2 * BUCKETS counts and weights leaves the rows' own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import spaced_words

#: Hash buckets of single words, and as many of word pairs.
BUCKETS = 1 << 14
#: Documents of fewer words, or with more repeated words in a hundred, fail the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Trusted ids (8 bytes each) that are broadcast at most; with more of them the texts are shuffled to meet their marks.
BROADCAST_ROWS = 500_000
#: N-grams that a bucket is taken to have beforehand.
PRIOR = 10
#: Nats per n-gram: a document whose n-grams are on average this much rarer in trusted text than in all text is rejected.
THRESHOLD = -0.175


def _joined(a: Column, b: Column, shift: int, n: Column) -> Column:
    """The hash of each of the first n values of `a` with the one of `b` that lies `shift` places on."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), lambda x, y: F.xxhash64(x, y))


def hashed(rows: DataFrame, words: str = "__words") -> DataFrame:
    """`rows` with the hashes of the words and of each two neighbours, made once for all that follows."""
    out = rows.withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
    return out.withColumn("__pairs", _joined(F.col("__hashes"), F.col("__hashes"), 1, F.size("__hashes") - 1))


def _grams() -> Column:
    """The bucket of each word, then of each pair of neighbours."""
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    return F.concat(F.transform("__hashes", bucket), F.transform("__pairs", lambda h: bucket(h) + F.lit(BUCKETS)))


def weights(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, `weights` array<double>: log(p_trusted / p_all) of every bucket, both multinomials smoothed alike.

    PRIOR n-grams are added to each bucket of all text, and the trusted share of as many to the trusted ones, so a bucket seen
    a few times says little however small the corpus. Trusted are documents that `labels` marks quality 1; without any, every
    weight is 0.
    The documents meet the trusted ids, broadcast where they are few; counts are summed before the shuffle, at most 2 * BUCKETS a task.
    """
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("trusted", F.lit(1))
    few = trusted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    marked = documents.select("doc_id", "text").join(F.broadcast(trusted) if few else trusted.hint("shuffle_hash"), "doc_id", "left")
    words = hashed(marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), spaced_words(F.col("text")).alias("__words")))
    counted = (
        words.select("trusted", F.explode(_grams()).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n_all"), F.sum("trusted").alias("n_trusted"))
    )
    every = documents.sparkSession.range(2 * BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counted, "bucket", "left").na.fill(0, ["n_all", "n_trusted"])
    kind = (F.col("bucket") >= BUCKETS).cast("int").alias("kind")
    sums = full.groupBy(kind).agg(F.sum("n_all").alias("all"), F.sum("n_trusted").alias("trusted"))
    share = F.col("trusted") / F.col("all")
    ratio = F.when(F.col("trusted") > 0, F.log((F.col("n_trusted") + PRIOR * share) / (share * (F.col("n_all") + PRIOR)))).otherwise(0.0)
    one = full.withColumn("kind", kind).join(F.broadcast(sums), "kind").groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", ratio.alias("w")))).alias("all"))
    return one.select(F.transform("all", lambda x: x["w"]).alias("weights"))


def signals(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with the counted signals, as columns `__words` (the words) and `__n_words`, `__word_chars`, ...

    Null or empty text: all zero. Repeated words are those inside a five-word window found twice or more in the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = hashed(documents.withColumns({"__words": spaced_words(F.col(text)), "__lines": lines}))
    n = F.size("__words")
    fours = _joined(F.col("__pairs"), F.col("__pairs"), 2, n - 3)
    windows = _joined(fours, F.slice("__hashes", F.lit(5), F.greatest(n - 4, F.lit(0))), 0, n - 4)
    out = out.withColumns(
        {
            "__n_words": n.cast("long"),
            "__word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": windows,
        }
    ).drop("__lines")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("__sorted", F.when(repeats, F.sort_array(placed))).drop("__windows")
    same = lambda x, k: F.coalesce(F.get(F.col("__sorted"), k)["h"] == x["h"], F.lit(False))
    starts = F.transform("__sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    out = out.withColumn("__starts", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.filter(starts, lambda x: x.isNotNull())))).drop("__sorted")
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(5), x - s["last"])).alias("n"), x.alias("last")),
        lambda s: s["n"],
    )
    return out.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__starts")


def judged(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`documents` with the signals, `__score` (nats per n-gram; 0 without words), `__base_failed` and `__kept`.

    Every row is judged alone, so repeated rows get equal verdicts; null or empty text fails the base rules.
    """
    model = weights(documents, labels).scalar()
    out = signals(documents)
    grams = F.greatest(2 * F.col("__n_words") - 1, F.lit(1))
    total = F.aggregate(_grams(), F.lit(0.0), lambda acc, g: acc + F.get(F.col("__model"), g))
    out = out.withColumn("__model", model).withColumn("__score", total / grams)
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    return out.withColumn("__base_failed", failed).withColumn("__kept", ~failed & (F.col("__score") >= threshold)).drop("__words", "__hashes", "__pairs", "__model")


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: the counts, base_failed, kept, and the ratio's score.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged each and come out alike; each counts in the raw
    corpus. A label without a doc_id marks nothing. Other columns are not read; no documents give no rows; without trusted labels the
    trusted counts are the prior's alone.
    """
    out = judged(documents.select("doc_id", "text"), labels)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return out.select("doc_id", *(F.col(f"__{x}").alias(x) for x in names))


def keep_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, unchanged, that quality_rules keeps.

    The row number is always true in the filter: beside it the optimiser can't push the verdict below the columns it is made
    from, where it would compute a text's words anew for every word.
    """
    out = judged(documents, labels).withColumn("__row", F.monotonically_increasing_id())
    return out.where("__kept AND __row >= 0").select(*(F.col(f"`{c}`") for c in documents.columns))


#: The base columns, which SQL can express.
SQL_BASE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT row, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, s) AS n FROM g) WHERE n > 1),
covered AS (SELECT row, sum(c) AS n FROM (SELECT row, least(5, coalesce(i - lag(i) OVER (PARTITION BY row ORDER BY i), 5)) AS c FROM again) GROUP BY 1),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN covered ON covered.row = l.row)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""
