"""A stored full-text index: positional postings by term in segments, which changes are added to and merged, and match expressions.

A segment holds the postings of the texts that one change brought, sorted by term and dealt into folders by a term's first letter, and
which texts the change replaced or removed. Nothing that is there is rewritten: a text counts in the last segment that has it. A search
reads the folders and row groups of the terms that it asks for, of all segments; `merge` makes one segment of them. A commit is a row
that names the segments, written last, so that readers see all of a change or nothing of it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as rules
from . import search

POSTINGS = "segment int, term string, doc_id long, positions array<int>, length int, head string"
TEXTS = "segment int, doc_id long, length int, gone boolean"


def query_tokens(text: str) -> list[str]:
    """A question's words as `tokens` has a text's."""
    bare = regex.sub(r"\p{M}+", "", text.lower()).translate(str.maketrans(rules.ACCENTED, rules.PLAIN))
    return regex.findall(r"[\p{L}\p{N}]+", bare)


# --- match expressions ---


def _less(n: int):
    return lambda x: x - n


@dataclass(frozen=True)
class Words:
    """A word, or a phrase of several; the last one may be a beginning."""

    words: tuple[str, ...]
    beginning: bool = False

    def test(self, found: Column) -> Column:
        """Whether the postings of a text, a map from its asked terms to their places, hold it."""
        *whole, last = self.words
        places = [F.try_element_at(found, F.lit(w)) for w in whole]
        if self.beginning:
            places.append(F.flatten(F.map_values(F.map_filter(found, lambda k, _: F.startswith(k, F.lit(last))))))
        else:
            places.append(F.try_element_at(found, F.lit(last)))
        starts = [F.transform(p, _less(n)) if n else p for n, p in enumerate(places)]
        return F.coalesce(F.size(reduce(F.array_intersect, starts)) > 0, F.lit(False))

    def leaves(self) -> list[Words]:
        return [self]

    def of_nothing(self) -> bool:
        return False


@dataclass(frozen=True)
class Both:
    parts: tuple

    def test(self, found: Column) -> Column:
        return reduce(lambda a, b: a & b, (p.test(found) for p in self.parts))

    def leaves(self) -> list[Words]:
        return [x for p in self.parts for x in p.leaves()]

    def of_nothing(self) -> bool:
        return all(p.of_nothing() for p in self.parts)


@dataclass(frozen=True)
class Either:
    parts: tuple

    def test(self, found: Column) -> Column:
        return reduce(lambda a, b: a | b, (p.test(found) for p in self.parts))

    def leaves(self) -> list[Words]:
        return [x for p in self.parts for x in p.leaves()]

    def of_nothing(self) -> bool:
        return any(p.of_nothing() for p in self.parts)


@dataclass(frozen=True)
class Not:
    part: Words | Both | Either | Not

    def test(self, found: Column) -> Column:
        return ~self.part.test(found)

    def leaves(self) -> list[Words]:
        return self.part.leaves()

    def of_nothing(self) -> bool:
        return not self.part.of_nothing()


_SIGN = regex.compile(r'\s*(?:"([^"]*)"(\*?)|([()])|([^\s()"]+))')


def parse(expression: str):
    """An expression of words, "phrases", beginnings*, AND, OR, NOT and brackets; words side by side mean AND, NOT binds most, OR least.

    A word that falls apart into several (well-known) is a phrase of them. ValueError for brackets that don't match and for an operator
    without its words; None where no word is left.
    """
    signs, at = [], 0
    while at < len(expression.rstrip()):
        m = _SIGN.match(expression, at)
        if not m:
            raise ValueError(f'a quotation mark is open: {expression[at:]!r}')
        at = m.end()
        phrase, star, bracket, word = m.groups()
        if bracket:
            signs.append(bracket)
        elif word in ("AND", "OR", "NOT"):
            signs.append(word)
        else:
            beginning = bool(star) or (word is not None and word.endswith("*"))
            words = tuple(query_tokens(phrase if word is None else word))
            signs.append(Words(words, beginning) if words else None)
    found, rest = _either(signs)
    if rest:
        raise ValueError(f"not expected: {rest[0]}")
    return found


def _either(signs: list):
    parts = []
    while True:
        part, signs = _both(signs)
        parts.append(part)
        if not signs or signs[0] != "OR":
            break
        signs = signs[1:]
    kept = [p for p in parts if p is not None]
    return (Either(tuple(kept)) if len(kept) > 1 else kept[0] if kept else None), signs


def _both(signs: list):
    parts, asked = [], True
    while asked or (signs and signs[0] not in ("OR", ")")):
        if signs and signs[0] == "AND" and not asked:
            signs, asked = signs[1:], True
            continue
        part, signs = _one(signs)
        parts.append(part)
        asked = False
    kept = [p for p in parts if p is not None]
    return (Both(tuple(kept)) if len(kept) > 1 else kept[0] if kept else None), signs


def _one(signs: list):
    if not signs or signs[0] in ("AND", "OR", ")"):
        raise ValueError(f"words are missing before {signs[0] if signs else 'the end'}")
    first, signs = signs[0], signs[1:]
    if first == "NOT":
        part, signs = _one(signs)
        return (None if part is None else Not(part)), signs
    if first == "(":
        part, signs = _either(signs)
        if not signs or signs[0] != ")":
            raise ValueError("a bracket is open")
        return part, signs[1:]
    return first, signs


# --- the stored index ---


def head(term: Column) -> Column:
    """The folder of a term: its first letter or digit where that is a plain one."""
    first = F.substring(term, 1, 1)
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise("other")


#: In the place of a term: a row of a text itself, which lies in the folder of its first term ("other" where it has none).
TEXT = " "


def _placed(batches):
    """Each text's words as rows of the index in the order of its files, search.AT_ONCE words at a time, and a row a text.

    Rows come as few sorted runs, which Spark's sort only has to merge.
    """
    names = ["head", "term", "doc_id", "positions", "length"]
    for part in search.pieces(batches):
        part = part.take(pc.array_sort_indices(part.column("doc_id")))
        docs, n = part.column("doc_id"), len(part)
        lengths = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        words = part.column("terms").flatten().dictionary_encode()
        letters = pc.utf8_slice_codeunits(words.dictionary, 0, 1)
        heads = pc.if_else(pc.string_is_ascii(letters), letters, "other")
        by = pc.sort_indices(pa.table({"head": heads, "term": words.dictionary}), [("head", "ascending"), ("term", "ascending")])
        heads, terms, rank = heads.take(by), words.dictionary.take(by), np.empty(len(by), np.int64)
        rank[by.to_numpy()] = np.arange(len(by))
        text, place = search.places(lengths)
        key = rank[words.indices.to_numpy(zero_copy_only=False)] * n + text
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        code, at = np.divmod(key[first], n)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order]))
        least = np.full(n, -1)
        least[at[::-1]] = code[::-1]
        own = pc.fill_null(heads.take(pa.array(least, mask=least < 0)), "other")
        none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([own, pa.array([TEXT] * n, pa.string()), docs, none, pa.array(lengths, pa.int32())], names).take(pc.array_sort_indices(own))
        yield pa.RecordBatch.from_arrays([heads.take(pa.array(code)), terms.take(pa.array(code)), docs.take(pa.array(at)), lists, pa.array(lengths[at], pa.int32())], names)


def positional(docs: DataFrame) -> DataFrame:
    """(head, term, doc_id, positions, length): where each of a text's words stands, from 0, and a row of term TEXT for the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rules.tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return rows.mapInArrow(_placed, "head string, term string, doc_id long, positions array<int>, length int")


class FullText:
    """The index in a folder. Every change gives a new state; searches are of the state that `FullText` was opened with."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.refresh()

    def refresh(self) -> FullText:
        """Takes the last committed state."""
        try:
            last = self.spark.read.schema("number int, segments array<int>, docs long, words long").parquet(f"{self.folder}/commits").orderBy(F.desc("number")).first()
        except AnalysisException as wrong:
            if "PATH_NOT_FOUND" not in str(wrong):
                raise
            last = None
        self.number, self.segments, self.docs, self.words = (last.number, list(last.segments), last.docs, last.words) if last else (0, [], 0, 0)
        return self

    def _commit(self, number: int, segments: list[int], docs: int, words: int) -> None:
        row = self.spark.createDataFrame([(number, segments, docs, words)], "number int, segments array<int>, docs long, words long")
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        self.number, self.segments, self.docs, self.words = number, segments, docs, words

    def _read(self, kind: str, schema: str, segments: list[int]) -> DataFrame:
        """Of some segments; each one's number is a column."""
        columns = ", ".join(c for c in schema.split(", ") if not c.startswith("segment "))
        if not segments:
            return self.spark.range(0).selectExpr(*(f"cast(null as {k}) as {c}" for c, k in (x.split(" ", 1) for x in schema.split(", "))))
        parts = [self.spark.read.schema(columns).parquet(f"{self.folder}/{kind}/{n}").withColumn("segment", F.lit(n)) for n in segments]
        return reduce(DataFrame.unionByName, parts)

    def _write_postings(self, number: int, placed: DataFrame) -> None:
        """`placed`: postings as they are dealt to tasks, each of which writes a sorted file for every folder."""
        placed.sortWithinPartitions("head", "term", "doc_id").write.mode("overwrite").partitionBy("head").parquet(f"{self.folder}/postings/{number}")

    def _write_texts(self, number: int, texts: DataFrame) -> None:
        texts.write.mode("overwrite").parquet(f"{self.folder}/texts/{number}")

    def live_texts(self) -> DataFrame:
        """(doc_id, length, segment) of the texts that are there."""
        last = self._read("texts", TEXTS, self.segments).groupBy("doc_id").agg(F.max(F.struct("segment", "length", "gone")).alias("t"))
        return last.where("NOT t.gone").select("doc_id", "t.length", "t.segment")

    def apply(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> FullText:
        """Adds the texts `changed` (doc_id, text), each in the place of an older one of its doc_id, and removes `gone` (doc_id).

        A doc_id in both is changed. A doc_id that stands twice in `changed` isn't allowed: it would be two texts. Null texts are empty.
        """
        spark, number = self.spark, self.number + 1
        changed = spark.createDataFrame([], "doc_id long, text string") if changed is None else changed.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
        gone = spark.createDataFrame([], "doc_id long") if gone is None else gone.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        without = gone.join(changed.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("length"), F.lit(True).alias("gone"))
        # texts are dealt, which are a fraction of their postings, and taken apart once: their lengths are read from where they were written.
        # They are dealt anew even if they come by doc_id: few changed texts among many would make a file for every task and folder
        self._write_postings(number, positional(changed.hint("rebalance", "doc_id")))
        now = self._read("postings", POSTINGS, [number]).where(F.col("term") == TEXT).select("doc_id", "length", F.lit(False).alias("gone"))
        self._write_texts(number, now.union(without))
        written = self._read("texts", TEXTS, [number])
        seen, distinct, more, words = written.agg(F.count("*"), F.countDistinct("doc_id"), F.count_if(~F.col("gone")), F.coalesce(F.sum("length"), F.lit(0))).first()
        if seen != distinct:
            raise ValueError("a doc_id stands twice among the changed texts")
        less, old_words = self.live_texts().join(written.select("doc_id"), "doc_id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._commit(number, [*self.segments, number], self.docs + more - less, self.words + words - old_words)
        return self

    def merge(self) -> FullText:
        """One segment of all: what was replaced is left behind."""
        number = self.number + 1
        live = self.live_texts()
        rows = self._read("postings", POSTINGS, self.segments).where(F.col("term") != TEXT).join(live.select("doc_id", "segment"), ["doc_id", "segment"], "left_semi")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.select("head", "term", "doc_id", "positions", "length").repartitionByRange(n, "term", "doc_id")
        self._write_postings(number, placed)
        self._write_texts(number, live.select("doc_id", "length", F.lit(False).alias("gone")))
        self._commit(number, [number], self.docs, self.words)
        return self

    def postings(self, words: list[Words]) -> DataFrame:
        """(term, doc_id, positions, length) of what `words` ask for, of texts that are there. Other letters' folders aren't listed, other
        terms' row groups not read."""
        exact = sorted({w for x in words for w in (x.words[:-1] if x.beginning else x.words)})
        begins = sorted({x.words[-1] for x in words if x.beginning})
        heads = sorted({w[0] if w[0].isascii() else "other" for w in (*exact, *begins)})
        tests = [F.startswith(F.col("term"), F.lit(b)) for b in begins] + ([F.col("term").isin(*exact)] if exact else [])
        rows = self._read("postings", POSTINGS, self.segments).where(F.col("head").isin(*heads) & rules.any_of(tests)).drop("head")
        if len(self.segments) > 1:  # only the texts of later segments can have taken an earlier one's place
            later = self._read("texts", TEXTS, self.segments[1:]).groupBy("doc_id").agg(F.max("segment").alias("last"))
            rows = rows.join(later, "doc_id", "left").where("last IS NULL OR last = segment").drop("last")
        return rows.drop("segment")

    def match(self, expression: str) -> DataFrame:
        """(doc_id) of the texts that an expression fits. An expression of what a text must not hold fits all others."""
        tree = parse(expression)
        if tree is None:
            return self.live_texts().limit(0).select("doc_id")
        rows = self.postings(tree.leaves()).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("found"))
        hits = rows.select("doc_id", tree.test(F.col("found")).alias("fits"))
        if not tree.of_nothing():
            return hits.where("fits").select("doc_id")
        return self.live_texts().select("doc_id").join(hits.where("NOT fits"), "doc_id", "left_anti")

    def bm25(self, queries: DataFrame, most: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) for `queries` (query_id, term), as `search.bm25`. Terms are joined, not listed."""
        asked = queries.select("term").distinct().withColumn("head", head(F.col("term")))
        rows = self._read("postings", POSTINGS, self.segments).join(asked, ["head", "term"], "left_semi")
        if len(self.segments) > 1:
            later = self._read("texts", TEXTS, self.segments[1:]).groupBy("doc_id").agg(F.max("segment").alias("last"))
            rows = rows.join(later, "doc_id", "left").where("last IS NULL OR last = segment")
        hits = rows.select("term", "doc_id", "length", F.size("positions").cast("long").alias("tf"))
        corpus = self.spark.createDataFrame([(self.docs, self.words)], "docs long, words long")
        return search.best(search.weighed(hits, corpus, queries.select("query_id", "term").distinct()), most, allowed)
