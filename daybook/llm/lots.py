"""Return lot matching: units that come back are taken from the earliest lots, by bisection over prefix sums.

A client's lots of an item stand on a line of units, earliest shipped first. What has been taken back is always a beginning of that line:
after a return it ends at its boundary, S + min(0, M), where S are the units returned so far and M the least A - S so far, with A the
units shipped before a return's day: a prefix sum that is reflected where no units are left. All boundaries of a task search their
lots' ranks at once, halving each one's range of ranks by testing the lots' prefix sums; between two neighbouring boundaries lie a
return's pieces, one for each rank.

Lots and returns are sorted once, in ranges of equal size, so a client's and item's events may span many ranges. Groups that lie within
a range are matched there. Of the others each range writes its sums from its own start; the sums before it are chained over the ranges
(two rows a range), and the unit line is then sorted in ranges of its own, where a piece begins at a lot or at a boundary, and what was
under way at a range's start is chained in the same way. So no task, and not the driver, holds a group.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, partitions

GROUP = ("client_id", "item_id")
#: What an event sorts by within its group: returns of a day stand before its lots, since they only take what was shipped before.
ORDER = ("day", "lot", "sale_id", "line_no", "q", "c", "d")
#: A piece, as ranges of units: [a, b) of the return, from t on of the lot; lot columns are null for what no lot is left for.
PIECE = ("client_id", "item_id", "return_no", "piece_no", "return_day", "return_sale_id", "rq", "rc", "rd", "a", "b", "lot_sale_id", "lot_line_no", "lq", "lc", "t")
LOT_PART = PIECE[11:]
#: An event of a group that may go on in another range, with the group's sums in this range up to it: units shipped and returned, least
#: difference before it, lots and returns. side: twice the range, and one more for its last group where that isn't its first too.
OPEN = ("side", "client_id", "item_id", "day", "lot", "sale_id", "line_no", "q", "c", "d", "u", "shipped", "back", "least", "lots", "returns")
#: A lot or a return on the unit line: from x to y, and what its pieces need. nth: a lot's or return's rank in its group; before: lots
#: shipped before a return.
CUT = ("client_id", "item_id", "x", "lot", "y", "nth", "before", "day", "sale_id", "line_no", "q", "c", "d", "u")
#: Stands for no number, of a line and of a least difference: beyond all that is compared with it.
NONE = np.iinfo(np.int64).min
FAR = 1 << 60


def events(sale_lines: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per lot: its key, shipping day, units q, cents c, per cent d; and for returned ones units u and day of the return."""
    units = F.col("quantity").cast("long")
    lines = sale_lines.where("sale_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND shipped_at IS NOT NULL AND quantity > 0")
    hundredths = lambda c: F.floor(100 * c + F.lit(0.5)).cast("long")
    line_no = F.col("line_no").cast("long")
    h = F.crc32(F.concat(F.col("sale_id").cast("string"), F.lit(":"), F.coalesce(line_no.cast("string"), F.lit(""))))
    returned = F.col("flag") == "returned"
    day = F.unix_date(F.col("shipped_at").cast("date")).cast("long")
    rows = lines.select(
        "sale_id", F.col("item_id").cast("long").alias("item_id"), day.alias("day"), F.coalesce(line_no, F.lit(int(NONE))).alias("line_no"), units.alias("q"),
        hundredths(F.col("amount")).alias("c"), hundredths(F.coalesce("discount", F.lit(0.0))).alias("d"),
        F.when(returned, 1 + h % (units + 1)).alias("u"), F.when(returned, day + 1 + h % 7).alias("return_day"),
    )
    buyers = sales.where("client_id IS NOT NULL AND sale_id IS NOT NULL").select("sale_id", F.col("client_id").cast("long").alias("client_id"))
    return rows.join(buyers.hint("merge"), "sale_id").withColumn("sale_id", F.col("sale_id").cast("long"))


def _table(batches) -> dict[str, np.ndarray]:
    """A task's rows as columns of long; NONE for null."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return {}
    whole = pa.Table.from_batches(found)
    return {c: whole.column(c).fill_null(int(NONE)).to_numpy() for c in whole.column_names}


def _starts(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Where groups begin, and the number of rows."""
    new = (rows["client_id"][1:] != rows["client_id"][:-1]) | (rows["item_id"][1:] != rows["item_id"][:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(rows["client_id"])]])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Prefix sums that begin anew in each group; first: of each row, where its group begins."""
    whole = np.cumsum(values)
    return whole - (whole - values)[first]


def least_so_far(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Prefix minima within groups, by doubling."""
    out, n = values.copy(), len(values)
    place = np.arange(n) - first
    step, longest = 1, int(place.max(initial=0))
    while step <= longest:
        reach = np.flatnonzero(place >= step)
        out[reach] = np.minimum(out[reach], out[reach - step])
        step *= 2
    return out


def cutoffs(starts: np.ndarray, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each x the last rank in [low, high) at which `starts` is no more than x, or low - 1: all halve their ranges at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        passed = open_ & (starts[np.minimum(middle, len(starts) - 1)] <= x)
        low = np.where(passed, middle + 1, low)
        high = np.where(open_ & ~passed, middle, high)
    return low - 1


def _struct(columns: dict[str, np.ndarray], names: tuple[str, ...]) -> pa.StructArray:
    """Columns of long as a struct; NONE is null."""
    return pa.StructArray.from_arrays([pa.array(columns[n], pa.int64(), mask=columns[n] == NONE) for n in names], list(names))


def _out(**kinds: tuple[dict[str, np.ndarray], tuple[str, ...]]):
    """Rows of several kinds in one batch: a column for each, null in the others' rows."""
    for kind, (columns, names) in kinds.items():
        n = len(columns[names[0]])
        if n:
            yield pa.RecordBatch.from_arrays([_struct(columns, names) if k == kind else pa.nulls(n, pa.struct([(c, pa.int64()) for c in other])) for k, (_, other) in kinds.items()], list(kinds))


def _schema(**kinds: tuple[str, ...]) -> str:
    return ", ".join(f"{kind} struct<{', '.join(f'{n}: bigint' for n in names)}>" for kind, names in kinds.items())


def _joined(tables: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([t[n] for t in tables]) for n in tables[0]}


def _pieces(back: dict[str, np.ndarray], lot: dict[str, np.ndarray] | None, number: np.ndarray, a: np.ndarray, b: np.ndarray, t: np.ndarray | None) -> dict[str, np.ndarray]:
    """PIECE columns of returns beside their lots (None: no lot is left)."""
    none = np.full(len(a), NONE)
    of_lot = (none,) * 5 if lot is None else (lot["sale_id"], lot["line_no"], lot["q"], lot["c"], t)
    of_return = (back["client_id"], back["item_id"], back["nth"], number, back["day"], back["sale_id"], back["q"], back["c"], back["d"], a, b)
    return dict(zip(PIECE, (*of_return, *of_lot), strict=True))


def _take(rows: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {n: v[at] for n, v in rows.items()}


def _ranges(batches):
    """A range of sorted events: the pieces of all groups that lie within it, and the events of its first and last group."""
    rows = _table(batches)
    if not rows:
        return
    bounds = _starts(rows)
    sizes = np.diff(bounds)
    groups, n = len(sizes), len(rows["lot"])
    group, first = np.repeat(np.arange(groups), sizes), np.repeat(bounds[:-1], sizes)
    is_lot = rows["lot"] == 1
    rows["shipped"] = sums(np.where(is_lot, rows["q"], 0), first)
    rows["back"] = sums(np.where(is_lot, 0, rows["u"]), first)
    rows["lots"], rows["returns"] = sums(is_lot.astype(np.int64), first), sums((~is_lot).astype(np.int64), first)
    back = np.flatnonzero(~is_lot)
    own = np.searchsorted(group[back], group[back])
    least = least_so_far((rows["shipped"] - rows["back"])[back], own)
    begins = own == np.arange(len(back))
    rows["least"] = np.full(n, FAR)
    rows["least"][back] = np.where(begins, FAR, np.concatenate([[FAR], least])[:-1])
    rows["side"] = 2 * TaskContext.get().partitionId() + (group > 0)

    within = (group > 0) & (group < groups - 1)
    lots = _take(rows, np.flatnonzero(is_lot & within))
    lot_group = group[is_lot & within]
    start = lots["shipped"] - lots["q"]
    group = group[~is_lot & within]
    back = _take(rows, np.flatnonzero(~is_lot & within))
    back["nth"] = back["returns"]
    low_at, high_at = reflected(back["shipped"], back["back"], back["u"], back["least"])
    some = high_at > low_at
    low, high = np.searchsorted(lot_group, group), np.searchsorted(lot_group, group, side="right")
    rank = np.where(some, cutoffs(start, low, high, low_at), 0)
    count = np.where(some, cutoffs(start, low, high, high_at - 1) - rank + 1, 0)
    each = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    k = rank[each] + nth
    left, right = np.maximum(low_at[each], start[k]), np.minimum(high_at[each], lots["shipped"][k])
    found = _pieces(_take(back, each), _take(lots, k), nth + 1, left - low_at[each], right - low_at[each], left - start[k])
    short = np.flatnonzero(high_at - low_at < back["u"])
    rest = _pieces(_take(back, short), None, count[short] + 1, (high_at - low_at)[short], back["u"][short], None)
    yield from _out(piece=(_joined([found, rest]), PIECE), event=(_take(rows, np.flatnonzero(~within)), OPEN))


def reflected(shipped, back, units, least, smaller=np.minimum):
    """A return's boundaries on the unit line: before it and after it."""
    return back - units + smaller(least, 0), back + smaller(smaller(least, shipped - back), 0)


def _matched(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The pieces that begin at the lots and returns of `rows`, sorted along unit lines. Rows marked `old` only tell what is under way:
    an old return knows the rank `nth0` of the lot that it began in."""
    bounds = _starts(rows)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    is_lot = rows["lot"] == 1
    lots, back = _take(rows, np.flatnonzero(is_lot)), _take(rows, np.flatnonzero(~is_lot))
    lot_group, back_group = group[is_lot], group[~is_lot]
    made = [_pieces(_take(back, np.array([], int)), None, *(np.array([], np.int64),) * 3, None)]

    low = np.searchsorted(lot_group, back_group)
    k = cutoffs(lots["x"], low, np.searchsorted(lot_group, back_group, side="right"), back["x"])
    begun = back["nth0"].copy()
    seen = (k >= low) & (begun == NONE)
    begun[seen] = lots["nth"][k[seen]]
    new = np.flatnonzero(seen & (back["old"] == 0))
    own, lot = _take(back, new), _take(lots, k[new])
    none = np.zeros(len(new), np.int64)
    made.append(_pieces(own, lot, none + 1, none, np.minimum(own["y"], lot["y"]) - own["x"], own["x"] - lot["x"]))
    short = np.flatnonzero(own["y"] - own["x"] < own["u"])
    less = _take(own, short)
    made.append(_pieces(less, None, less["before"] - begun[new][short] + 2, less["y"] - less["x"], less["u"], None))

    low = np.searchsorted(back_group, lot_group)
    r = cutoffs(back["x"], low, np.searchsorted(back_group, lot_group, side="right"), lots["x"] - 1)
    at = np.flatnonzero((r >= low) & (lots["old"] == 0))
    at = at[back["y"][r[at]] > lots["x"][at]]
    lot, own = _take(lots, at), _take(back, r[at])
    made.append(_pieces(own, lot, lot["nth"] - begun[r[at]] + 1, lot["x"] - own["x"], np.minimum(own["y"], lot["y"]) - own["x"], np.zeros(len(at), np.int64)))
    return _joined(made)


STATE = (*CUT, "nth0", "old")
HEAD = ("part", *STATE)
#: Of a range's last group the last lot and the last return; alone: 1 if it is the first group too.
TAIL = ("part", "alone", *(f"lot_{c}" for c in STATE), *(f"back_{c}" for c in STATE))


def _lines(batches):
    """A range of sorted unit lines: the pieces that its rows tell, its first rows, which hang on the ranges before, and its last lot
    and return."""
    rows = _table(batches)
    if not rows:
        return
    part = TaskContext.get().partitionId()
    n = len(rows["x"])
    rows |= {"nth0": np.full(n, NONE), "old": np.zeros(n, np.int64)}
    bounds = _starts(rows)
    is_lot = rows["lot"] == 1
    first_lot = np.flatnonzero(is_lot[: bounds[1]])[:1]
    sure = np.flatnonzero(~is_lot[first_lot[0] : bounds[1]])[:1] + first_lot[0] if len(first_lot) else first_lot
    begin = int(sure[0]) if len(sure) else int(bounds[1])
    head = _take(rows, np.arange(begin))
    before = _take(rows, np.flatnonzero(is_lot[:begin])[-1:] if len(sure) else np.array([], int))
    before["old"] = before["old"] + 1
    rest = _joined([before, _take(rows, np.arange(begin, n))])
    found = _matched(rest) if len(rest["x"]) else _pieces(rest, None, rest["x"], rest["x"], rest["x"], None)

    last = np.arange(bounds[-2], n)
    tail = {"part": np.array([part]), "alone": np.array([int(len(bounds) == 2)])}
    for name, which in (("lot", last[is_lot[last]][-1:]), ("back", last[~is_lot[last]][-1:])):
        tail |= {f"{name}_{c}": rows[c][which] if len(which) else np.array([NONE]) for c in STATE}
    if tail["back_x"][0] != NONE:
        begun = last[is_lot[last] & (rows["x"][last] <= tail["back_x"][0])][-1:]
        tail["back_nth0"] = rows["nth"][begun] if len(begun) else np.array([NONE])
    head["part"] = np.full(begin, part)
    yield from _out(piece=(found, PIECE), head=(head, HEAD), tail=(tail, TAIL))


def _headed(table: pa.Table) -> pa.Table:
    """The pieces of a range's first rows, with the lot and the return that were under way."""
    rows = {c: table.column(c).fill_null(int(NONE)).to_numpy() for c in STATE}
    rows = _take(rows, np.lexsort((1 - rows["lot"], rows["x"], rows["item_id"], rows["client_id"])))
    return pa.Table.from_struct_array(_struct(_matched(rows), PIECE))


def _sorted(df: DataFrame, *keys) -> DataFrame:
    """In ranges of about equally many rows, sorted."""
    return df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def _before(summaries) -> np.ndarray:
    """By side: a group's sums before the range (units shipped and returned, least difference, lots, returns), and how far its line is
    taken back in the end.

    `summaries`: (side, client_id, item_id, shipped, back, least, lots, returns).
    """
    rows = sorted(map(tuple, summaries))
    out = np.zeros((6, rows[-1][0] + 1 if rows else 1), np.int64)
    state, group, taken = (0,) * 5, None, {}
    for side, *own_group, own_shipped, own_back, own_least, own_lots, own_returns in rows:
        if own_group != group:
            group, state = own_group, (0,) * 5
        out[:5, side] = state
        shipped, back, least, lots, returns = state
        least = least if own_least is None else min(least, shipped - back + own_least)
        state = (shipped + own_shipped, back + own_back, least, lots + own_lots, returns + own_returns)
        taken[tuple(group)] = state[1] + min(0, least)
    for side, client, item, *_ in rows:
        out[5, side] = taken[client, item]
    return out


def _under_way(tails) -> list[tuple[int, ...]]:
    """HEAD rows, marked old: the lot and the return that are under way where each range of lines begins."""
    out, lot, back = [], None, None
    group = lambda x: x and (x["client_id"], x["item_id"])
    part = lambda t, name: None if t[f"{name}_x"] is None else {c: t[f"{name}_{c}"] for c in STATE}
    for t in sorted((r.asDict() for r in tails), key=lambda t: t["part"]):
        out += [(t["part"], *(x[c] if c != "old" else 1 for c in STATE)) for x in (lot, back) if x]
        own_lot, own_back = part(t, "lot"), part(t, "back")
        goes_on = t["alone"] and group(own_lot or own_back) == group(lot or back)
        if own_back and own_back["nth0"] is None:
            own_back["nth0"] = lot["nth"]
        lot, back = (own_lot or lot, own_back or back) if goes_on else (own_lot, own_back)
    return out


def _longs(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} long" for n in names)


def pieces(sale_lines: DataFrame, sales: DataFrame, scratch: Scratch) -> DataFrame:
    """PIECE rows: which units of which lot each return takes.

    The driver holds two rows a range and a lot and a return a range, and gives them back as constants of the plan: there are as many
    ranges as spark.sql.shuffle.partitions.
    """
    spark = sale_lines.sparkSession
    lots = scratch.table(events(sale_lines, sales).withColumn("row", F.monotonically_increasing_id()), "lots")
    of_lot = F.struct("day", F.lit(1).cast("long").alias("lot"), F.lit(0).cast("long").alias("u"))
    of_return = F.struct(F.col("return_day").alias("day"), F.lit(0).cast("long").alias("lot"), "u")
    both = lots.select(*GROUP, "sale_id", "line_no", "q", "c", "d", "row", F.explode(F.when(F.col("u").isNull(), F.array(of_lot)).otherwise(F.array(of_lot, of_return))).alias("e"))
    both = both.select(*GROUP, "e.day", "e.lot", "sale_id", "line_no", "q", "c", "d", "e.u", "row")
    ranges = _sorted(both, *GROUP, *ORDER, "row").drop("row").mapInArrow(_ranges, _schema(piece=PIECE, event=OPEN))
    ranges = scratch.table(ranges, "ranges")

    at_ends = ranges.where("event IS NOT NULL").select("event.*")
    least = F.min(F.when(F.col("lot") == 0, F.col("shipped") - F.col("back")))
    summaries = at_ends.groupBy("side", *GROUP).agg(F.max("shipped"), F.max("back"), least, F.max("lots"), F.max("returns")).collect()
    shipped0, back0, least0, lots0, returns0, taken = (F.get(F.lit(x), F.col("side").cast("int")) for x in _before(summaries))
    shipped, back = F.col("shipped") + shipped0, F.col("back") + back0
    least = F.least(least0, shipped0 - back0 + F.col("least"))
    low, high = reflected(shipped, back, F.col("u"), least, lambda a, b: F.least(a, F.lit(b) if isinstance(b, int) else b))
    is_lot = F.col("lot") == 1
    before = F.col("lots") + lots0
    cuts = at_ends.withColumns({"taken": taken, "x": F.when(is_lot, shipped - F.col("q")).otherwise(low), "y": F.when(is_lot, shipped).otherwise(high), "before": before, "nth": F.when(is_lot, before).otherwise(F.col("returns") + returns0)})
    none = F.lit(None).cast("long")
    unmatched = cuts.where("lot = 0 AND x = y").select(
        *GROUP, F.col("nth").alias("return_no"), F.lit(1).cast("long").alias("piece_no"), F.col("day").alias("return_day"), F.col("sale_id").alias("return_sale_id"),
        F.col("q").alias("rq"), F.col("c").alias("rc"), F.col("d").alias("rd"), F.lit(0).cast("long").alias("a"), F.col("u").alias("b"), *(none.alias(c) for c in LOT_PART),
    )
    cuts = cuts.where("lot = 1 AND x < taken OR lot = 0 AND x < y").select(*CUT)
    lines = _sorted(cuts, *GROUP, "x", F.desc("lot")).mapInArrow(_lines, _schema(piece=PIECE, head=HEAD, tail=TAIL))
    lines = scratch.table(lines, "lines")

    under_way = _under_way(lines.where("tail IS NOT NULL").select("tail.*").collect())
    heads = lines.where("head IS NOT NULL").select("head.*").union(spark.createDataFrame(under_way, _longs(HEAD)))
    headed = heads.groupBy("part").applyInArrow(_headed, _longs(PIECE))
    made = lambda df: df.where("piece IS NOT NULL").select("piece.*")
    return made(ranges).union(unmatched).union(made(lines)).union(headed)


def floored(x: Column, y: Column) -> Column:
    """x / y rounded down, in whole numbers; y is positive."""
    return F.call_function("div", x - F.pmod(x, y), y)


def match_returns(sale_lines: DataFrame, sales: DataFrame) -> DataFrame:
    """One row per piece of a return: client_id, item_id, return_no, piece_no, return_day, return_sale_id, lot_sale_id, lot_line_no, units,
    lot_left, refund_cents, margin_cents.

    A row of `sale_lines` (sale_id, line_no, item_id, quantity, amount, discount, flag, shipped_at) is a lot if `sales` (sale_id, client_id)
    has its sale and client, and neither item, amount nor day is null and its quantity is at least 1; a sale that stands twice in
    `sales` makes two lots of it. A null discount is none, a null line_no comes first and reads as nothing in the checksum. Repeated rows
    are lots each; equal ones are alike, so it doesn't matter which is taken first. Other columns are not read; no returns give no rows.
    """
    scratch = Scratch(sale_lines.sparkSession, "lots")
    units = F.col("b") - F.col("a")
    refund = lambda n: floored(n * F.col("rc") * (100 - F.col("rd")), 100 * F.col("rq"))
    cost = lambda n: floored(n * F.col("lc"), F.col("lq"))
    refunded = refund(F.col("b")) - refund(F.col("a"))
    return scratch.result(
        pieces(sale_lines, sales, scratch).select(
            *PIECE[:6], "lot_sale_id", "lot_line_no", units.alias("units"), (F.col("lq") - F.col("t") - units).alias("lot_left"),
            refunded.alias("refund_cents"), (refunded - (cost(F.col("t") + units) - cost(F.col("t")))).alias("margin_cents"),
        )
    )


#: The checksum is worked out bit by bit, over the text of sale_id:line_no.
SQL = r"""
WITH joined AS (
  SELECT s.client_id, l.item_id, l.sale_id, l.line_no, CAST(l.quantity AS BIGINT) AS q, CAST(floor(100 * l.amount + 0.5) AS BIGINT) AS c,
         CAST(floor(100 * coalesce(l.discount, 0) + 0.5) AS BIGINT) AS d, coalesce(l.flag = 'returned', false) AS returned,
         CAST(date_diff('day', DATE '1970-01-01', CAST(l.shipped_at AS DATE)) AS BIGINT) AS day, l.sale_id || ':' || coalesce(CAST(l.line_no AS VARCHAR), '') AS name
  FROM sale_lines l JOIN sales s USING (sale_id)
  WHERE s.client_id IS NOT NULL AND l.item_id IS NOT NULL AND l.amount IS NOT NULL AND l.shipped_at IS NOT NULL AND l.quantity >= 1
), hashed AS (
  SELECT name, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(name, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: xor((CASE WHEN x < 0 THEN a ELSE xor(a, x) END) >> 1, CASE WHEN (CASE WHEN x < 0 THEN a ELSE xor(a, x) END) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h
  FROM (SELECT DISTINCT name FROM joined WHERE returned)
), events AS (
  SELECT client_id, item_id, day, 1 AS lot, sale_id, line_no, q, c, d, CAST(0 AS BIGINT) AS u FROM joined
  UNION ALL
  SELECT client_id, item_id, day + 1 + h % 7, 0, sale_id, line_no, q, c, d, 1 + h % (q + 1) FROM joined JOIN hashed USING (name) WHERE returned
), sums AS (
  SELECT *, sum(lot * q) OVER w AS shipped, sum(u) OVER w AS back, row_number() OVER w AS place FROM events
  WINDOW w AS (PARTITION BY client_id, item_id ORDER BY day, lot, sale_id, line_no NULLS FIRST, q, c, d ROWS UNBOUNDED PRECEDING)
), lots AS (SELECT *, shipped - q AS x, shipped AS y FROM sums WHERE lot = 1),
ends AS (
  SELECT *, back + least(0, min(shipped - back) OVER w) AS y, row_number() OVER w AS return_no FROM sums WHERE lot = 0
  WINDOW w AS (PARTITION BY client_id, item_id ORDER BY place ROWS UNBOUNDED PRECEDING)
), back AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY client_id, item_id ORDER BY place), 0) AS x FROM ends),
parts AS (
  SELECT b.client_id, b.item_id, return_no, b.day AS return_day, b.sale_id AS return_sale_id, b.q, b.c, b.d, greatest(b.x, l.x) - b.x AS a, least(b.y, l.y) - b.x AS b,
         l.sale_id AS lot_sale_id, l.line_no AS lot_line_no, l.q AS lq, l.c AS lc, greatest(b.x, l.x) - l.x AS t
  FROM back b JOIN lots l ON l.client_id = b.client_id AND l.item_id = b.item_id AND l.x < b.y AND l.y > b.x AND b.y > b.x
  UNION ALL
  SELECT client_id, item_id, return_no, day, sale_id, q, c, d, y - x, u, NULL, NULL, NULL, NULL, NULL FROM back WHERE u > y - x
)
SELECT client_id, item_id, CAST(return_no AS BIGINT) AS return_no, row_number() OVER (PARTITION BY client_id, item_id, return_no ORDER BY a) AS piece_no, return_day,
       return_sale_id, lot_sale_id, CAST(lot_line_no AS BIGINT) AS lot_line_no, CAST(b - a AS BIGINT) AS units, CAST(lq - t - (b - a) AS BIGINT) AS lot_left,
       CAST(b * c * (100 - d) // (100 * q) - a * c * (100 - d) // (100 * q) AS BIGINT) AS refund_cents,
       CAST(b * c * (100 - d) // (100 * q) - a * c * (100 - d) // (100 * q) - ((t + b - a) * lc // lq - t * lc // lq) AS BIGINT) AS margin_cents
FROM parts
"""
