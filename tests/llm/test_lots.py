"""Return lot matching against a loop over returns, with groups that span many ranges."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from datetime import date, datetime, timedelta
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import lots

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
SALES = "sale_id long, client_id long, status string, total double"


def by_loop(lines, sales):
    buyers = defaultdict(list)
    for sale, client, *_ in sales:
        if sale is not None and client is not None:
            buyers[sale].append(client)
    owned, back = defaultdict(list), defaultdict(list)
    low = lambda x: (x is not None, x or 0)
    for sale, line, item, _, q, amount, discount, flag, at in lines:
        for client in buyers.get(sale, []):
            if None in (item, q, amount, at) or q < 1:
                continue
            c, d = floor(100 * amount + 0.5), floor(100 * (discount or 0) + 0.5)
            day = (at.date() - date(1970, 1, 1)).days
            owned[client, item].append((day, sale, low(line), q, c, d, line))
            if flag == "returned":
                h = zlib.crc32(f"{sale}:{'' if line is None else line}".encode())
                back[client, item].append((day + 1 + h % 7, sale, low(line), q, c, d, 1 + h % (q + 1)))
    out = []
    for group, returns in back.items():
        stock = [[x, x[3]] for x in sorted(owned[group])]
        for number, (day, sale, _, q, c, d, units) in enumerate(sorted(returns), 1):
            done, piece = 0, 0
            refund = lambda n: n * c * (100 - d) // (100 * q)  # noqa: B023, E731
            for lot in stock:
                (shipped, lot_sale, _, lq, lc, _, line), left = lot
                n = min(left, units - done)
                if shipped >= day or not n:
                    continue
                lot[1], piece = left - n, piece + 1
                paid, cost = refund(done + n) - refund(done), (lq - left + n) * lc // lq - (lq - left) * lc // lq
                out.append((*group, number, piece, day, sale, lot_sale, line, n, left - n, paid, paid - cost))
                done += n
            if done < units:
                out.append((*group, number, piece + 1, day, sale, None, None, units - done, None, refund(units) - refund(done), None))
    return sorted(out, key=repr)


def made(seed, n, clients, items, sales, most):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    flag = lambda: rng.choice(["kept", "returned", "returned", "swapped", None])
    rows = []
    for _ in range(n):
        maybe = lambda x: None if rng.random() < 0.02 else x
        rows.append((maybe(rng.randrange(sales)), maybe(rng.randint(1, 5)), maybe(rng.randrange(items)), 1, maybe(rng.randint(1, most)), maybe(rng.randint(100, 9999) / 100), maybe(rng.choice([0.0, -0.0, 0.05, 0.1])), flag(), maybe(start + timedelta(hours=rng.randrange(24 * 30)))))
    rows += rows[:20] + [(0, 1, 0, 1, 0, 1.0, 0.0, "returned", start), (0, 1, 0, 1, -3, 1.0, 0.0, "returned", start)]
    return rows, [(k, None if rng.random() < 0.05 else rng.randrange(clients), "done", 1.0) for k in range(sales)] + [(1, 0, "done", 1.0), (None, 0, "done", 1.0)]


@pytest.mark.parametrize(("seed", "n", "clients", "items", "most", "parts"), [(1, 300, 9, 9, 50, 4), (2, 900, 1, 1, 3, 7), (3, 900, 2, 1, 200, 13), (4, 500, 3, 2, 1, 40), (5, 60, 1, 2, 9, 30)])
def test_return_lots(spark, seed, n, clients, items, most, parts):
    lines, sales = made(seed, n, clients, items, 40, most)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = lots.match_returns(spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(sales, SALES))
        assert sorted(map(tuple, found.collect()), key=repr) == by_loop(lines, sales)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_one_huge_lot_and_one_that_is_short(spark):
    """A lot that all returns of many ranges share, and a client whose returns find nothing left."""
    at = datetime(2024, 1, 1)
    lines = [(0, 1, 7, 1, 10**6, 5.0, 0.0, "kept", at)] + [(k, 1, 7, 1, 3, 9.99, 0.1, "returned", at + timedelta(days=k % 9)) for k in range(1, 80)] + [(100, k, 7, 1, 1, 2.0, 0.0, "returned", at) for k in range(30)]
    sales = [(k, 5, "", 0.0) for k in range(80)] + [(100, 6, "", 0.0)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 25)
    try:
        found = lots.match_returns(spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, SALES))
        assert sorted(map(tuple, found.collect()), key=repr) == by_loop(lines, sales)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_no_rows_and_clashing_columns(spark):
    lines, sales = made(6, 120, 3, 3, 20, 9)
    some, buyers = spark.createDataFrame(lines, LINES), spark.createDataFrame(sales, SALES)
    assert lots.match_returns(some.limit(0), buyers).count() == 0
    assert lots.match_returns(some, buyers.limit(0)).count() == 0
    assert lots.match_returns(some.where("flag = 'kept'"), buyers).count() == 0
    clash = some.withColumns({c: F.lit("x") for c in ("client_id", "q", "c", "d", "u", "day", "row", "lot", "x", "part", "piece")})
    assert sorted(map(tuple, lots.match_returns(clash, buyers.withColumn("item_id", F.lit(1))).collect()), key=repr) == by_loop(lines, sales)


def test_prefix_minima_and_cutoffs():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 40)
    values = rng.integers(-50, 50, sizes.sum())
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    assert lots.least_so_far(values, first).tolist() == [int(values[f : k + 1].min()) for k, f in enumerate(first)]
    starts = np.sort(rng.integers(0, 100, 50))
    low, x = rng.integers(0, 50, 30), rng.integers(-5, 105, 30)
    assert lots.cutoffs(starts, low, np.full(30, 50), x).tolist() == [max([k for k in range(a, 50) if starts[k] <= v], default=a - 1) for a, v in zip(low, x, strict=True)]
