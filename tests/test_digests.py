"""The graph of digests: what a change makes stale, in which order it is written, and what is asked of the model."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daybook.functions import periods
from daybook.operators import buckets, digests

ENTRIES = "entry_id long, entry_date date, mood_score double, summary string"


class Client:
    name = "digests"

    def __init__(self, folder):
        self.folder = str(folder)

    def complete(self, prompt):
        with open(f"{self.folder}/asked", "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return json.dumps({"summary": f"{len(prompt.splitlines())} lines"})

    def embed(self, text):
        return [0.0]

    def asked(self):
        try:
            with open(f"{self.folder}/asked") as f:
                found = f.read().splitlines()
        except FileNotFoundError:
            return []
        open(f"{self.folder}/asked", "w").close()
        return [json.loads(x) for x in found]


def test_bounds_of_all_kinds(spark):
    days = [dt.date(2019, 12, 1) + dt.timedelta(days=k) for k in range(0, 800, 3)]
    rows = {("month", f"{d:%Y-%m}") for d in days} | {("year", f"{d:%Y}") for d in days} | {("week", "{}-W{:02d}".format(*d.isocalendar()[:2])) for d in days} | {("range", f"{d}..{d + dt.timedelta(days=9)}") for d in days}
    df = spark.createDataFrame(sorted(rows), "kind string, key string")
    start, end = digests.bounds(F.col("kind"), F.col("key"))
    assert {(r.kind, r.key): (r.a, r.b) for r in df.select("kind", "key", start.alias("a"), end.alias("b")).collect()} == {(k, key): periods.bounds(k, key) for k, key in rows}


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(buckets, "BUCKETS", 4)


def test_one_change_runs_up_the_graph(spark, tmp_path):
    rng = random.Random(1)
    rows = {k: (k, dt.date(2023, 12, 20) + dt.timedelta(days=rng.randrange(60)), rng.choice([None, 3.0, 8.0]), f"said {k}") for k in range(25)}
    rows[99] = (99, None, 1.0, "no day")
    frame = lambda: spark.createDataFrame(list(rows.values()), ENTRIES)
    tags = spark.createDataFrame([(k, t) for k in range(25) for t in ("a", "b" if k % 2 else "c")], "entry_id long, tag string")
    client = Client(tmp_path)
    book = digests.Digests(spark, str(tmp_path / "d"), client)
    book.ask_for(frame(), tags, "2023-12-28", "2024-01-03")
    plan = book.plan(frame()).collect()
    assert {r.reason for r in plan} == {"missing"} and "range" not in {r.kind for r in plan}
    wrote = dict(book.refresh(frame(), tags))
    assert list(wrote) == list(digests.ORDER) and wrote["year"] == 2 and wrote["range"] == 0 and book.plan(frame()).count() == 0
    stored = {(r.kind, r.key): r for r in book.stored().collect()}
    january = [r for r in rows.values() if r[1] and r[1].strftime("%Y-%m") == "2024-01"]
    moods = [r[2] for r in january if r[2] is not None]
    one = stored["month", "2024-01"]
    assert one.entry_count == len(january) and one.avg_mood == round(sum(moods) / len(moods) + 1e-9, 2) and one.dominant_tags[0] == "a" and one.summary == f"{len(january)} lines"
    months = {r[1].strftime("%Y-%m") for r in rows.values() if r[1] and r[1].year == 2024}
    assert stored["year", "2024"].summary == f"{len(months)} lines"  # a year is told from its months
    client.asked()
    assert dict(book.refresh(frame(), tags)) == dict.fromkeys(digests.ORDER, 0) and client.asked() == []

    changed = next(r for r in rows.values() if r[1] and dt.date(2023, 12, 28) <= r[1] <= dt.date(2024, 1, 3))
    rows[changed[0]] = (*changed[:3], "said otherwise")
    day = changed[1]
    want = {("month", f"{day:%Y-%m}"), ("week", "{}-W{:02d}".format(*day.isocalendar()[:2])), ("year", f"{day:%Y}"), ("range", "2023-12-28..2024-01-03")}
    assert {(r.kind, r.key) for r in book.plan(frame()).where("reason = 'stale'").collect()} == want and book.plan(frame()).count() == len(want)
    assert {(r.kind, r.key) for r in book.plan(frame(), since="2025-01-01").collect()} == set()
    before = {(r.kind, r.key): r for r in book.stored().collect()}
    book.refresh(frame(), tags)
    after = {(r.kind, r.key): r for r in book.stored().collect()}
    assert {k for k in after if after[k] != before.get(k)} == want and len(client.asked()) <= len(want)

    gone = [k for k, r in rows.items() if r[1] and r[1].year == 2023]
    for k in gone:
        del rows[k]
    left = {(r.kind, r.key) for r in book.plan(frame()).where("reason = 'gone'").collect()}
    assert ("year", "2023") in left and ("month", "2023-12") in left
    book.refresh(frame(), tags)
    assert book.plan(frame()).count() == 0 and not {k for k in left} & {(r.kind, r.key) for r in book.stored().collect()}


@pytest.mark.parametrize("seed", range(2))
def test_random_changes(spark, seed):
    rng = random.Random(seed)
    make = lambda k: (k, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(400)), rng.choice([None, 5.0]), rng.choice(["x", "y", None]))
    old = {k: make(k) for k in range(40)}
    new = {k: r for k, r in old.items() if rng.random() < 0.8} | {k: make(k) for k in (rng.randrange(50) for _ in range(5))}
    spans = [(dt.date(2024, 2, 1), dt.date(2024, 3, 15)), (dt.date(2024, 12, 25), dt.date(2025, 1, 5))]
    table = spark.createDataFrame([(f"{a}..{b}", a, b) for a, b in spans], "key string, first date, last date")

    def held(rows):
        out = defaultdict(set)
        for r in rows.values():
            d = r[1]
            for key in (("month", f"{d:%Y-%m}"), ("year", f"{d:%Y}"), ("week", "{}-W{:02d}".format(*d.isocalendar()[:2])), *(("range", f"{a}..{b}") for a, b in spans if a <= d <= b)):
                out[key].add((*r[:3], r[3] or ""))
        return out

    was, now = held(old), held(new)
    want = {k: "gone" if k not in now else "missing" if k not in was else "stale" for k in was.keys() | now.keys() if was.get(k) != now.get(k)}
    sides = [digests.inputs(spark.createDataFrame(list(x.values()), ENTRIES), table) for x in (new, old)]
    assert {(r.kind, r.key): r.reason for r in digests.plan(*sides).collect()} == want
