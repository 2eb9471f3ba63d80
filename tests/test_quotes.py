"""Quotes of cited days."""

from __future__ import annotations

import datetime as dt

from daybook.operators import quotes

DAY = dt.date(2024, 1, 1)


def test_quotes(spark):
    rows = [
        (1, DAY, "We went out. Ann came today.\nToday was long. Today ended."), (2, DAY, "Ann and Ann alone today."), (3, DAY + dt.timedelta(1), "Nothing here."),
        (4, DAY + dt.timedelta(2), "ann first. Ann second."), (5, DAY + dt.timedelta(3), "x " * 300 + "ann " + "y " * 300), (6, DAY + dt.timedelta(4), "Ann uncited."), (7, DAY + dt.timedelta(2), None),
    ]
    entries = spark.createDataFrame(rows, "entry_id long, entry_date date, text string")
    days = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in (0, 0, 1, 2, 3)], "entry_date date")
    parts = spark.createDataFrame([(4, "Ann second.")], "entry_id long, part string")
    found = {r.entry_date: r for r in quotes.for_days(entries, days, ["ann", "today"], parts).collect()}
    assert set(found) == {DAY, DAY + dt.timedelta(2), DAY + dt.timedelta(3)}
    assert (found[DAY].entry_id, found[DAY].quote, found[DAY].score) == (2, "Ann and Ann alone today.", 2.0)
    assert (found[DAY + dt.timedelta(2)].quote, found[DAY + dt.timedelta(2)].score) == ("Ann second.", 0.75)  # the part that matched
    long_ = found[DAY + dt.timedelta(3)].quote
    assert long_.startswith("…") and long_.endswith("…") and " ann " in long_ and len(long_) <= quotes.QUOTE_CHARS + 2
    assert quotes.for_days(entries, days, ["ann"], parts, withheld=True).count() == 0 and quotes.for_days(entries, days, [], parts).count() == 0
    assert quotes.for_days(entries, days.limit(0), ["ann"], parts).count() == 0
