"""Streams with state: the debounce over random orders and restarts, and a folder's changes."""

from __future__ import annotations

import datetime as dt
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from daybook.operators import incremental
from daybook.sources import changes
from daybook.streaming.debounce import debounced

EVENTS = "path string, kind string, ts timestamp, event_id long, attempts int, again boolean"
START = dt.datetime(2024, 5, 1)


def ran(spark, source, out, checkpoint, **how):
    query = debounced(spark.readStream.schema(EVENTS).parquet(source), **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def put(spark, folder, rows):
    spark.createDataFrame([(*r, 0, False) if len(r) == 4 else r for r in rows], EVENTS).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folders(tmp_path):
    return [str(tmp_path / x) for x in ("in", "out", "checkpoint")]


def test_bursts_are_given_once_each(spark, folders):
    """Over batches and restarts: of events that lie less than 45 s apart the last, once the watermark has passed it."""
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(6)}.md", rng.choice(["change", "delete"]), START + dt.timedelta(seconds=rng.randrange(3000)), k) for k in range(300)]
    rows.sort(key=lambda r: (r[2], r[3]))
    for part in range(3):
        own = rows[part * 100 : part * 100 + 100]
        rng.shuffle(own)
        put(spark, folders[0], own)
        query = ran(spark, *folders, quiet=45, by_event=True, late="1 minute")
    put(spark, folders[0], [("end.md", "change", START + dt.timedelta(hours=3), 1000)])
    query = ran(spark, *folders, quiet=45, by_event=True, late="1 minute")
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the state of the last path alone: its event and its timer
    want = []
    for path in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == path]
        want += [a for a, b in zip(own, [*own[1:], None], strict=True) if b is None or b[2] - a[2] >= dt.timedelta(seconds=45)]
    got = [(r.path, r.kind, r.ts, r.event_id) for r in spark.read.parquet(folders[1]).collect()]
    assert sorted(got) == sorted(want)
    batch = incremental.last_events(spark.createDataFrame([r for r in rows], "path string, kind string, ts timestamp, event_id long"), 45, START + dt.timedelta(hours=2))
    last = {r[0]: r for r in sorted(got, key=lambda r: (r[2], r[3]))}
    assert last == {r.path: (r.path, r.kind, r.ts, r.event_id) for r in batch.collect()}


def test_by_the_clock_a_newer_event_sets_the_timer_anew(spark, folders):
    """What came back after an outage waits, and never takes a newer event's place."""
    put(spark, folders[0], [("a.md", "change", START, 1), ("b.md", "change", START, 2)])
    source = spark.readStream.schema(EVENTS).parquet(folders[0])
    query = debounced(source, quiet=2).writeStream.format("parquet").option("path", folders[1]).option("checkpointLocation", folders[2]).trigger(processingTime="200 milliseconds").start()
    try:
        put(spark, folders[0], [("a.md", "delete", START + dt.timedelta(seconds=1), 3), ("b.md", "delete", START - dt.timedelta(seconds=9), 4, 1, True), ("c.md", "change", START, 5, 2, True)])
        for _ in range(100):
            time.sleep(0.5)
            if query.exception() or os.path.exists(folders[1]) and spark.read.schema(EVENTS).parquet(folders[1]).count() >= 3:
                break
        assert query.exception() is None
    finally:
        query.stop()
    got = sorted((r.path, r.kind, r.event_id, r.attempts) for r in spark.read.parquet(folders[1]).collect())
    assert got[-2:] == [("b.md", "change", 2, 0), ("c.md", "change", 5, 2)] and got[-3] == ("a.md", "delete", 3, 0)


def test_changes_of_a_folder(spark, tmp_path):
    """A random sequence of file operations: applied one after the other, the events lead to the folder as it is."""
    changes.register(spark)
    vault, out = tmp_path / "vault", str(tmp_path / "out")
    vault.mkdir()
    rng = random.Random(8)
    options = {"path": str(vault), "state": str(tmp_path / "state")}

    def step():
        query = spark.readStream.format("vault_changes").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start()
        query.awaitTermination()

    clock = 1_700_000_000
    known: dict[str, bool] = {}
    for round_ in range(5):
        for _ in range(12):
            files = sorted(p for p in vault.rglob("*.md"))
            what, clock = rng.choice(["write", "write", "edit", "move", "delete", "folder"]), clock + 1
            if what == "write" or not files:
                new = vault / f"d{rng.randrange(3)}" / f"{rng.randrange(20)}.md"
                new.parent.mkdir(exist_ok=True)
                new.write_text("x" * rng.randrange(99))
                os.utime(new, (clock, clock))
            elif what == "edit":
                files[0].write_text("y" * rng.randrange(99))
                os.utime(files[0], (clock, clock))
            elif what == "move":
                files[-1].rename(files[-1].with_name(f"moved{clock}.md"))
            elif what == "delete":
                files[rng.randrange(len(files))].unlink()
            else:
                files[0].parent.rename(vault / f"dir{clock}")
        (vault / ".hidden").mkdir(exist_ok=True)
        (vault / ".hidden/no.md").write_text("no")
        (vault / "no.txt").write_text("no")
        before = set(known)
        step()
        rows = spark.read.schema(changes.SCHEMA).parquet(out).where(F.col("event_id") == round_ + 1).collect()
        assert len({r.path for r in rows}) == len(rows)
        for r in rows:
            assert (r.kind == "delete") == (not (vault / r.path).exists()) and (r.kind in ("create", "move")) == (r.path not in before and r.kind != "delete")
            if r.kind == "move":
                assert r.moved_from in {x.path for x in rows if x.kind == "delete"}
            known[r.path] = True
            if r.kind == "delete":
                del known[r.path]
        assert set(known) == {str(p.relative_to(vault)) for p in vault.rglob("*.md") if ".hidden" not in p.parts}
    count = spark.read.parquet(out).count()
    shutil.move(vault, tmp_path / "away")
    step()
    (tmp_path / "vault").mkdir()
    step()  # an unplugged root, or an empty one in its place, drops nothing
    assert spark.read.parquet(out).count() == count
    shutil.rmtree(tmp_path / "vault")
    shutil.move(tmp_path / "away", vault)
    step()
    assert spark.read.parquet(out).count() == count
    assert len([p for p in (tmp_path / "state").iterdir() if p.suffix == ".done"]) <= 3
