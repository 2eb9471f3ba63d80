"""Connected components by alternating large and small stars: every round is joins and sums, nothing goes to the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: So many edges at most are joined up in one task, which holds them; more by rounds over all tasks.
TASK = 100_000


def _joined_up(batches):
    """The components of all edges, each node pointing at a lesser one until the least is reached."""
    parent: dict = {}

    def least(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        sides = (batch.column(c).to_pylist() for c in ("a", "b"))
        for x, y in zip(*(([tuple(v.values()) if isinstance(v, dict) else v for v in side]) for side in sides), strict=True):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = least(x), least(y)
            parent[max(x, y)] = min(x, y)
    if parent:
        kind = schema.field("a").type
        named = [f.name for f in kind] if pa.types.is_struct(kind) else None
        back = lambda x: dict(zip(named, x, strict=True)) if named else x
        nodes = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array([back(x) for x in nodes], kind), pa.array([back(least(x)) for x in nodes], kind)], ["node", "label"])


def _largest(edges: DataFrame) -> DataFrame:
    """Large star: each node's larger neighbours meet its least one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    """Small star: each node and its smaller neighbours meet the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): the least node it reaches. Loops and repeated edges don't matter.

    Each round's edges are written to the shared folder; the driver reads a count and a checksum. Rounds are few: their number
    grows as the logarithm of the longest path.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(now, f"{name}-0")
    if now.limit(TASK + 1).count() <= TASK:
        kind = now.schema["a"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_joined_up, f"node {kind}, label {kind}")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    seen, k = mark(now), 0
    while seen[0]:
        k += 1
        now = scratch.table(_smallest(_largest(now)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        last, seen = seen, mark(now)
        if last == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b")).distinct()
