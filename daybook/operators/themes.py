"""Themes: spherical k-means over entry vectors, the same for the same input."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import unit
from ..scratch import new_folder

#: Vectors that a grouping needs, its seed, its most rounds, and the share of vectors that must still move for another.
LEAST, SEED, ROUNDS, MOVING = 20, 7, 30, 1 / 500


def theme_count(entries: int, least: int = 5) -> int:
    return max(2, min(max(3, min(15, round(math.sqrt(entries / 4)))), entries // least))


def _nearest(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, u, theme, distance): the centroids are a literal of k vectors; ties go to the lower theme."""
    table = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centroids))
    distances = F.transform(table, lambda c, k: F.struct((1 - F.aggregate(F.zip_with("u", c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).alias("d"), k.alias("k")))
    return vectors.withColumn("near", F.array_min(distances)).select("vec_id", "u", F.col("near.k").alias("theme"), F.col("near.d").alias("distance"))


def _matrix(batch) -> np.ndarray:
    return batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lengths(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return 1 - units @ centroids.T


def _luck(hashes: np.ndarray, draw: int) -> np.ndarray:
    """Numbers between 0 and 1 that follow from a vector's hash and the draw alone."""
    x = hashes.view(np.uint64) + np.uint64(draw * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (2.0**53 + 1)


def _seeds(batches, centroids: np.ndarray):
    """A task's vector with the best luck for its squared distance from all seeds; without seeds, the one of least hash."""
    best = None
    for batch in batches:
        units, hashes, ids = _matrix(batch), batch.column("hash").to_numpy(), batch.column("vec_id").to_numpy()
        if len(centroids):
            weight = np.maximum(_lengths(units, centroids).min(1), 0) ** 2
            turn = np.where(weight > 1e-24, -np.log(_luck(hashes, len(centroids))) / np.maximum(weight, 1e-24), np.inf)
        else:
            turn = hashes.astype(np.float64)
        at = np.lexsort((ids, turn))[0] if len(ids) else None
        if at is not None and (best is None or (turn[at], ids[at]) < best[:2]):
            best = (float(turn[at]), int(ids[at]), units[at].tolist())
    if best is not None:
        yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]])], ["turn", "vec_id", "u"])


def _sums(batches, centroids: np.ndarray, before: np.ndarray | None):
    """Of a task's vectors: per theme how many, how many had another before, and their sum in whole 1e-9, which no order of adding
    changes; and the furthest vector of all."""
    k, width = centroids.shape
    sums, sizes, moved, far = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), (-1.0, 0, [0.0] * width)
    for batch in batches:
        units, ids = _matrix(batch), batch.column("vec_id").to_numpy()
        lengths = _lengths(units, centroids)
        theme = lengths.argmin(1)
        np.add.at(sums, theme, np.rint(units * 1e9).astype(np.int64))
        sizes += np.bincount(theme, minlength=k)
        if before is not None:
            moved += np.bincount(theme[theme != _lengths(units, before).argmin(1)], minlength=k)
        own = lengths.min(1)
        at = np.lexsort((ids, -own))[0] if len(ids) else None
        if at is not None and (-own[at], ids[at]) < (-far[0], far[1]):
            far = (float(own[at]), int(ids[at]), units[at].tolist())
    rows = [(t, int(sizes[t]), int(moved[t]), sums[t].tolist(), 0.0, 0) for t in range(k)] + [(-1, 0, 0, np.rint(np.array(far[2]) * 1e9).astype(np.int64).tolist(), far[0], far[1])]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64()), strict=True)]
    yield pa.RecordBatch.from_arrays(columns, ["theme", "n", "moved", "sums", "far", "vec_id"])


def _round(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The themes' means, their sizes, and how many vectors changed theme: the driver reads a row for each task and theme."""
    found = rows.mapInArrow(partial(_sums, centroids=centroids, before=before), "theme long, n long, moved long, sums array<long>, far double, vec_id long").collect()
    total, sizes, moved = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), 0
    for r in found:
        if r.theme >= 0:
            total[r.theme] += np.array(r.sums)
            sizes[r.theme] += r.n
            moved += r.moved
    means = total.astype(float)
    furthest = sorted((r for r in found if r.theme < 0 and r.far >= 0), key=lambda r: (-r.far, r.vec_id))
    for theme, far in zip(np.flatnonzero(sizes == 0), furthest, strict=False):
        means[theme] = far.sums
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    return means / np.where(norms > 0, norms, 1), sizes, moved


def group(vectors: DataFrame, count: int | None = None, least: int = 5) -> DataFrame:
    """(vec_id, theme, distance), themes from 1, the largest first. ValueError under LEAST vectors.

    Seeds: the vector of least hash, then again and again one drawn with its squared distance from all seeds as weight; a vector's
    luck is a hash, so equal input gives equal themes. Rounds end when under MOVING of the vectors change their theme. A theme left
    empty takes the furthest vector; a theme under `least` is folded into the others while over two are left. Each pass sums in its
    tasks, and k * tasks short rows reach the driver.
    """
    rows = vectors.select("vec_id", unit(F.col("embedding")).alias("u"), F.xxhash64("vec_id", F.lit(SEED)).alias("hash"))
    folder = new_folder(vectors.sparkSession, "themes")  # every seed and round reads them: they are worked out once
    rows.where("u IS NOT NULL").write.parquet(folder)
    rows = vectors.sparkSession.read.schema(rows.schema).parquet(folder)
    n = rows.count()
    if n < LEAST:
        raise ValueError(f"{LEAST} vectors at least, not {n}")
    k = min(count or theme_count(n, least), n)
    centroids = np.empty((0, 0))
    while len(centroids) < k:
        drawn = min(rows.mapInArrow(partial(_seeds, centroids=centroids), "turn double, vec_id long, u array<double>").collect(), key=lambda r: (r.turn, r.vec_id))
        centroids = np.vstack([centroids, drawn.u]) if len(centroids) else np.array([drawn.u])
    while True:
        before = None
        for _ in range(ROUNDS):
            moved, sizes, changed = _round(rows, centroids, before)
            if before is not None and changed < max(1, n * MOVING):
                break
            before, centroids = centroids, moved
        if len(centroids) <= 2 or sizes.min() >= least:
            break
        centroids = np.delete(centroids, int(np.argmin(sizes)), axis=0)
    order = np.lexsort((np.arange(len(centroids)), -sizes))
    names = F.array(*(F.lit(int(np.flatnonzero(order == k)[0]) + 1) for k in range(len(centroids))))
    return _nearest(rows, centroids).select("vec_id", F.get(names, F.col("theme")).cast("long").alias("theme"), F.round("distance", 6).alias("distance"))


def _near(rows: DataFrame, centroids: DataFrame, distance) -> DataFrame:
    """(vec_id, theme, distance): each vector looks through the centroids, one row of at most a few dozen, in its own row."""
    one = centroids.agg(F.sort_array(F.collect_list(F.struct("theme", "centroid"))).alias("all"))
    near = F.array_min(F.transform("all", lambda c: F.struct(distance(c["centroid"]).alias("d"), c["theme"].alias("theme"))))
    return rows.join(F.broadcast(one)).withColumn("near", near).select("vec_id", F.col("near.theme").alias("theme"), F.col("near.d").alias("distance"))


def membership(stored: DataFrame, vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Stored places, and for newer vectors the nearest centroid by angle."""
    newer = vectors.join(stored.select("vec_id"), "vec_id", "left_anti").select("vec_id", unit(F.col("embedding")).alias("u"))
    angle = lambda c: 1 - F.aggregate(F.zip_with("u", c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = _near(newer, centroids.select("theme", unit(F.col("centroid")).alias("centroid")), angle)
    return stored.select("vec_id", "theme").union(near.select("vec_id", "theme"))


def nearest_theme(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, theme, distance) by distance to each centroid; ties go to the lower theme."""
    own = F.col("embedding").cast("array<double>")
    square = lambda c: F.aggregate(F.zip_with(own, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return _near(vectors, centroids, lambda c: F.round(F.sqrt(square(c)), 6))


def overview(placed: DataFrame, entries: DataFrame) -> DataFrame:
    """Per theme: entries, first and last day, entries by month as a map."""
    rows = placed.join(entries, placed.vec_id == entries.entry_id)
    monthly = rows.groupBy("theme", F.date_format("entry_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min("entry_date").alias("a"), F.max("entry_date").alias("b"))
    return monthly.groupBy("theme").agg(
        F.sum("n").alias("entries"), F.min("a").alias("first_date"), F.max("b").alias("last_date"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("month", "n")))).alias("months")
    )


def central(placed: DataFrame, most: int = 8) -> DataFrame:
    """The entries nearest to each theme's middle."""
    order = Window.partitionBy("theme").orderBy("distance", "vec_id")
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


#: Share of placed entries from which a grouping is stale, entries a theme needs in a range and how many are named,
#: the newest entries and the names that a theme's page shows.
STALE_SHARE, IN_RANGE, SHOWN, NEWEST, NAMES = 0.2, 2, 5, 30, 8


def shared_names(placed: DataFrame, names: DataFrame, most: int = NAMES) -> DataFrame:
    """(theme, name, n, rank): what the entries of a theme share; `placed` (entry_id, theme), `names` (entry_id, name): tags or notes."""
    counted = placed.join(names, "entry_id").groupBy("theme", "name").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("n"), "name"))).where(F.col("rank") <= most)


def in_range(placed: DataFrame, entries: DataFrame, since, until, least: int = IN_RANGE, most: int = SHOWN) -> DataFrame:
    """(theme, n): the themes that come up most in a range."""
    rows = placed.join(entries.where(F.col("entry_date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))).select("entry_id"), "entry_id")
    return rows.groupBy("theme").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "theme").limit(most)


def status(stored: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: vectors in all, those of the stored grouping, those only placed since, and whether it is stale."""
    marked = vectors.select("vec_id").join(stored.select("vec_id", F.lit(True).alias("known")), "vec_id", "left")
    new = F.count_if(F.col("known").isNull())
    return marked.agg(F.count("*").alias("total"), F.count("known").alias("stored"), new.alias("placed"), (new > STALE_SHARE * F.count("*")).alias("stale"))


def newest(placed: DataFrame, entries: DataFrame, most: int = NEWEST) -> DataFrame:
    """(theme, entry_id, entry_date, rank): the newest entries of each theme."""
    rows = placed.join(entries.select("entry_id", "entry_date"), "entry_id")
    order = Window.partitionBy("theme").orderBy(F.desc("entry_date"), F.desc("entry_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("theme", "entry_id", "entry_date", "rank")


def label(name: str, tags: list[str], notes: list[str]) -> str:
    """A model's name of a theme, or what its entries share where it gave none."""
    return name.strip().strip('"').rstrip(".") or ", ".join([*notes[:2], *tags[:3]][:3]) or "unnamed"


def named(placed: DataFrame, tags: DataFrame, notes: DataFrame, entries: DataFrame, write) -> DataFrame:
    """(theme, name): write(prompt) for each theme over its central entries' summaries and what they share; a failure keeps the grouping.

    `placed` (vec_id, theme, distance), `entries` (entry_id, summary). The driver reads a row for each theme.
    """
    members = placed.select(F.col("vec_id").alias("entry_id"), "theme")
    listed = lambda names: shared_names(members, names).groupBy("theme").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    middle = central(placed).join(entries.select(F.col("entry_id").alias("vec_id"), "summary"), "vec_id")
    lines = middle.groupBy("theme").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "summary"))), lambda x: x["summary"]).alias("lines"))
    rows = lines.join(listed(tags).withColumnRenamed("names", "tags"), "theme", "left").join(listed(notes).withColumnRenamed("names", "notes"), "theme", "left")
    out = []
    for row in rows.orderBy("theme").collect():
        try:
            name = write("\n".join(row.lines))
        except Exception:  # a model's failure must not lose the grouping
            name = ""
        out.append((row.theme, label(name, row.tags or [], row.notes or [])))
    return placed.sparkSession.createDataFrame(out, "theme long, name string")


def persist(placed: DataFrame, vectors: DataFrame, folder: str) -> None:
    """Writes a grouping: its themes with their centroids and central entries, and every entry's place."""
    unit_ = vectors.select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("at", "x")).join(placed.select("vec_id", "theme"), "vec_id")
    means = unit_.groupBy("theme", "at").agg(F.avg("x").alias("x")).groupBy("theme").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centroid"))
    from_ = central(placed).groupBy("theme").agg(F.sort_array(F.collect_list("vec_id")).alias("named_from"))
    means.join(from_, "theme").write.mode("overwrite").parquet(f"{folder}/themes")
    placed.write.mode("overwrite").parquet(f"{folder}/entry_themes")
