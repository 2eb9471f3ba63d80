"""Search: BM25 over postings, exact vector neighbours, reciprocal rank fusion, best sentences."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as rules
from ..functions.vectors import cosine_distance, l2

#: Fixed values of the ranking function, and the damping of rank fusion.
K1, B, DAMPING = 1.2, 0.75, 60
#: An inverse document frequency is this at least: a word in over half of all texts still counts a little.
LEAST_IDF = 1e-6


#: Words that are sorted at a time.
AT_ONCE = 1 << 20


def pieces(batches):
    """Batches with lists of terms, cut where AT_ONCE words are reached: a text is whole in its row."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        low = 0
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, side="right")))
            yield batch.slice(low, high - low)
            low = high


def places(lengths):
    """For the words of texts one behind the other: the number of each one's text, and where it stands there."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)


def _by_term(batches):
    """Each text's words as a row a term: a text is whole in its row, so nothing is shuffled for it."""
    for part in pieces(batches):
        lengths = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        words = part.column("terms").flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text, place = places(lengths)
        key = text * max(len(words.dictionary), 1) + codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        at = text[order[first]]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order]))
        columns = [words.dictionary.take(pa.array(codes[order[first]])), part.column("doc_id").take(pa.array(at)), lists, pa.array(lengths[at], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "positions", "length"])


def by_term(docs: DataFrame) -> DataFrame:
    """(term, doc_id, positions, length) of `docs` (doc_id, text), a row for each row's words: where they stand, from 0."""
    rows = docs.select("doc_id", rules.tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return rows.mapInArrow(_by_term, f"term string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, positions array<int>, length int")


def _counted(docs: DataFrame) -> DataFrame:
    return by_term(docs).select("doc_id", "term", F.size("positions").cast("long").alias("tf"), "length")


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, length) of `docs` (doc_id, text), and a row without term for each text: to be written by term, and read by
    every search from then on."""
    rows = docs.select("doc_id", F.size(rules.tokens(F.col("text"))).alias("length"))
    return _counted(docs).union(rows.select("doc_id", F.lit(None).cast("string"), F.lit(0).cast("long"), "length"))


def scores(docs: DataFrame, queries: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): every text that has any of a query's terms (query_id, term).

    Statistics are of all texts. Texts are taken apart once: without `stored` postings only the terms that are asked for leave the
    scan, with the text's length. `stored` is what `postings` gives, written by the caller: then no text is read at all.
    """
    queries = queries.select("query_id", "term").distinct()
    asked = queries.select("term").distinct()
    if stored is None:
        corpus = docs.select(F.size(rules.tokens(F.col("text"))).alias("length")).agg(F.count("*").alias("docs"), F.sum("length").alias("words"))
        hits = _counted(docs).join(asked, "term", "left_semi").select("term", "doc_id", "length", "tf")
    else:
        corpus = stored.where("term IS NULL").agg(F.count("*").alias("docs"), F.sum("length").alias("words"))
        hits = stored.join(asked, "term", "left_semi").select("term", "doc_id", "length", "tf")
    return weighed(hits, corpus, queries)


def weighed(hits: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) from `hits` (term, doc_id, length, tf) of all asked terms and the one row of `corpus` (docs, words).

    Hits are dealt by text once, for the counts and for the sums: a text's sums are made where its hits are, and of the pairs of
    queries and texts, which are many more than hits, none is shuffled while the queries are few enough to be broadcast.
    """
    hits = hits.repartition("doc_id").groupBy("term", "doc_id", "length").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count("tf").alias("df"))  # tf, so that both read one shuffle
    rows = hits.join(F.broadcast(df), "term").join(F.broadcast(corpus))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    size = 1 - B + B * F.col("length") / (F.col("words") / F.col("docs"))
    rows = rows.withColumn("w", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * size))
    scored = rows.select("term", "doc_id", "w").join(queries, "term").groupBy("query_id", "doc_id").agg(F.sum("w").alias("score"))
    return scored.withColumn("score", F.round("score", 6))


def bm25(docs: DataFrame, queries: DataFrame, most: int, allowed: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the best texts for each query's terms. `allowed` (doc_id) only limits what may be returned,
    so a text is found however low it ranks."""
    return best(scores(docs, queries, stored), most, allowed)


def best(scored: DataFrame, most: int, allowed: DataFrame | None = None) -> DataFrame:
    if allowed is not None:
        scored = scored.join(allowed, "doc_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def phrase_ids(docs: DataFrame, phrase: str) -> DataFrame:
    """Texts that hold these words in a row."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(rules.tokens(c), " "), F.lit(" "))
    return docs.where(F.contains(spaced(F.col("text")), spaced(F.lit(phrase)))).select("doc_id")


def distances(vectors: DataFrame, query: DataFrame, metric: str = "l2") -> DataFrame:
    """The vectors with their distance from one query row (embedding)."""
    one = query.limit(1).select(F.col("embedding").alias("q"))
    measure = {"l2": l2, "cosine": cosine_distance}[metric]
    return vectors.join(F.broadcast(one)).withColumn("distance", F.round(measure(F.col("embedding"), F.col("q")), 6)).drop("embedding", "q")


def nearest(vectors: DataFrame, query: DataFrame, most: int, metric: str = "l2", allowed: DataFrame | None = None) -> DataFrame:
    """(vec_id, distance) of the vectors nearest to one query row: an exact scan, with the top kept in each task."""
    if allowed is not None:
        vectors = vectors.join(allowed, "vec_id", "left_semi")
    return distances(vectors.select("vec_id", "embedding"), query, metric).orderBy("distance", "vec_id").limit(most)


def similar_to(vectors: DataFrame, vec_id: int, most: int, metric: str = "l2") -> DataFrame:
    """Neighbours of a stored vector, itself left out."""
    own = vectors.where(F.col("vec_id") == vec_id)
    return nearest(vectors.where(F.col("vec_id") != vec_id), own, most, metric)


def fuse(rankings: DataFrame, most: int) -> DataFrame:
    """Reciprocal rank fusion of `rankings` (list, doc_id, rank): ties go to the earlier list, then to the better rank there."""
    merged = rankings.groupBy("doc_id").agg(F.round(F.sum(1.0 / (DAMPING + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return merged.orderBy(F.desc("score"), "first", "doc_id").limit(most).select("doc_id", "score")


def hybrid(docs: DataFrame, vectors: DataFrame, terms: list[str], query: DataFrame | None, most: int, allowed: DataFrame | None = None, parts: list[DataFrame] = ()) -> DataFrame:
    """Vector neighbours, keyword hits and any further rankings (doc_id, rank), fused. Vectors are keyed by doc_id as vec_id."""
    spark, lists = docs.sparkSession, []
    if query is not None:
        near = nearest(vectors, query, most, allowed=None if allowed is None else allowed.withColumnRenamed("doc_id", "vec_id"))
        lists.append(near.select(F.col("vec_id").alias("doc_id"), F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank")))
    if terms:
        words = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(F.array(*map(F.lit, terms))).alias("term"))
        lists.append(bm25(docs, words, most, allowed).select("doc_id", "rank"))
    lists += [p.select("doc_id", "rank") for p in parts]
    rankings = None
    for k, one in enumerate(lists):
        one = one.withColumn("list", F.lit(k))
        rankings = one if rankings is None else rankings.unionByName(one)
    return fuse(rankings, most)


def rerank(found: DataFrame, scorer, most: int) -> DataFrame:
    """Order `found` (doc_id, passage, rank) anew by scorer(passages) -> scores; where it fails the old order stays."""

    def scored(batches):
        for batch in batches:
            passages = batch.column("passage").to_pylist()
            try:
                values = [float(x) for x in scorer(passages)]
            except Exception:  # a scorer is optional: a failure must not lose the search
                values = [-float(r) for r in batch.column("rank").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rank"), pa.array(values)], ["doc_id", "rank", "score"])

    rows = found.select("doc_id", "passage", F.col("rank").cast("long").alias("rank")).coalesce(1).mapInArrow(scored, "doc_id long, rank long, score double")
    return rows.orderBy(F.desc("score"), "rank").limit(most)


def _best(batches, wanted: dict[str, float], most: int):
    stems = set(wanted)
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            best, score = "", 0.0
            words = rules.words_among(text or "", stems)
            for sentence in rules.sentences(text) if words else ():
                own = sum(wanted[t] for t in sorted(rules.stems_of(sentence, words)))
                if own > score:
                    best, score = sentence, own
            out.append((best if len(best) <= most else best[:most].rsplit(" ", 1)[0] + "…", score))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "sentence", "score"])


def best_sentences(docs: DataFrame, question: str, most: int = 280) -> DataFrame:
    """(doc_id, sentence, score) of each text that shares a term: the sentence whose shared stems are rarest, the first of equals."""
    stems = rules.terms(question)
    if not stems:
        return docs.limit(0).select("doc_id", F.lit("").alias("sentence"), F.lit(0.0).alias("score"))

    def seen(batches):
        for batch in batches:
            sets = [sorted({*rules.words_among(t or "", stems).values()}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string()))], ["stems"])

    df = {r.stem: r.n for r in docs.select("text").mapInArrow(seen, "stems array<string>").select(F.explode("stems").alias("stem")).groupBy("stem").count().withColumnRenamed("count", "n").toLocalIterator()}
    wanted = {s: 1.0 / n for s, n in df.items()}
    return docs.select("doc_id", "text").mapInArrow(partial(_best, wanted=wanted, most=most), "doc_id long, sentence string, score double").where("score > 0")


def best_sentence_columns(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The same without stems or Python: sentences end at . ! ? or a line's end; a term counts 1 / its texts.

    A text without any of the terms' letters is passed over before it is cut into sentences, and a sentence before it is cut into
    words. `terms` are as `tokens` gives them; letters that may lose an accent are let through.
    """
    maybe = "|".join("".join(f"(?:{c}|[^\\x00-\\x7F])[^\\x00-\\x7F]*" for c in t) for t in terms)
    some = docs.where(F.lower("text").rlike(maybe))
    cut = F.split("text", r"(?<=[.!?])\s+|\n+")
    placed = F.filter(F.transform(cut, lambda s, k: F.struct(k.alias("place"), s.alias("sentence"))), lambda x: F.lower(x["sentence"]).rlike(maybe))
    rows = some.select("doc_id", F.explode(placed).alias("s")).select("doc_id", "s.place", "s.sentence")
    words = rows.select("doc_id", "place", "sentence", F.explode(F.array_distinct(rules.tokens(F.col("sentence")))).alias("term")).where(F.col("term").isin(*terms))
    df = words.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    scored = words.join(F.broadcast(df), "term").groupBy("doc_id", "place", "sentence").agg(F.round(F.sum(1.0 / F.col("df")), 9).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("place")).alias("early"), "sentence")).alias("b"))
    return best.select("doc_id", F.col("b.sentence").alias("sentence"), F.col("b.score").alias("score"))


def unlinked_mentions(texts: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """(entry_id, note_id, key): names that stand in an entry which doesn't link the note."""
    from .links import names_in

    found = names_in(texts.select(F.col("entry_id").alias("text_id"), "text"), names).withColumnRenamed("text_id", "entry_id")
    return found.join(links, ["entry_id", "note_id"], "left_anti").select("entry_id", "note_id", "key").distinct()
