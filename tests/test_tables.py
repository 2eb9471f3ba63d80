"""Table functions and parameters in SQL text."""

from __future__ import annotations

import datetime as dt

import pytest

from daybook.operators import tables

AT = dt.datetime(2024, 1, 1)


def test_bursts(spark):
    tables.register(spark)
    rows = [("a", AT + dt.timedelta(seconds=s)) for s in (0, 5, 5, 16, 40)] + [(None, AT), ("b", None)]
    df = spark.createDataFrame(rows, "k string, t timestamp").repartition(3)
    found = spark.sql("SELECT * FROM bursts(TABLE(SELECT k, t FROM {df}), 12)", df=df).collect()
    at = lambda s: AT + dt.timedelta(seconds=s)
    assert sorted(map(tuple, found), key=repr) == sorted([("a", at(0), at(16), 4), ("a", at(40), at(40), 1), (None, AT, AT, 1)], key=repr)
    assert spark.sql("SELECT * FROM bursts(TABLE(SELECT k, t FROM {df}), 12)", df=df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no time"):
        spark.sql("SELECT * FROM bursts(TABLE(SELECT k, k AS t FROM {df}), 12)", df=df)


def test_links(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, "[[A#h|x]] ![[p.avif]]"), (2, None), (3, "none")], "id int, text string")
    found = spark.sql("SELECT id, l.* FROM {df} AS d, LATERAL text_links(d.text) AS l ORDER BY id, place", df=df).collect()
    assert [tuple(r) for r in found] == [(1, 0, "a", "h", "x"), (1, 1, None, None, None)]


def test_parameters_may_be_absent(spark):
    rows = [(k, dt.date(2024, 1, k), float(k)) for k in range(1, 6)] + [(6, None, None)]
    df = spark.createDataFrame(rows, "entry_id long, entry_date date, mood_score double")
    ids = lambda **which: sorted(r.entry_id for r in tables.chosen(df, **which).collect())
    assert ids() == [1, 2, 3, 4, 5, 6] and ids(ids="[2, 9, 2, null]") == [2] and ids(ids="[]") == [] and ids(ids="no array") == []
    assert ids(since="2024-01-03") == [3, 4, 5] and ids(until="2024-01-02", mood=2) == [2] and ids(ids="[1, 5]", since="2024-01-02") == [5]
