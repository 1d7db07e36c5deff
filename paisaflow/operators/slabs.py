"""Greedy pairing within amount and time bands, settled by slabs of time, for keys of very many rows.

A task takes the rows of a slab and of a margin on both sides and makes the sequential choice over them, edges
within growing radii first. What lies beyond the margin is unknown: a row whose distance to it costs ``sure`` may be
taken from there by anything that costs as much. From such a cost on the row is open, and so is whoever an open row
could take. Pairs of rows that are not open are those of the choice over all rows, whatever is outside, and a row left
without a pair that nobody outside reaches stays without. Open rows go to the next pass, where slabs are wider, as they
are fewer, until one slab holds all. What a pass cannot settle is left to ``hot_pairing``.
"""

from __future__ import annotations

import heapq
from functools import reduce
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from paisaflow.operators import folding
from paisaflow.schemas import Tolerance
from paisaflow.session import cut, forget

# Keys of fewer rows need no slabs; rows of a slab, as many at most in both margins; cells of time per reach of a row.
LEAST_ROWS = 20_000
SLAB_ROWS = 40_000
CELLS = 32
# Edges listed at once, per class; and as many passes as leave this share of the rows open at most.
EDGES_PER_CLASS = 8
OPEN_SHARE = 0.7
RADII = [2.0 ** -e for e in range(20, -1, -1)] + [inf]
OUT = "order_key string, l_row long, b_row long, l_id string, b_id string, diff double, hours double"
c = F.col


# ---- one slab ------------------------------------------------------------------------------------

class _Side:
    """Rows of a side in classes of equal time and amounts; inside a class in order of ids."""

    def __init__(self, rows: pd.DataFrame, hours: float):
        t, v, a = (rows[x].to_numpy() for x in ("t", "v", "a"))
        rank = np.unique(rows["id"].to_numpy(object), return_inverse=True)[1]
        order = np.lexsort((rank, a, v, t))
        self.t, self.v, self.a = t[order], v[order], a[order]
        new = np.append(True, (np.diff(self.t) != 0) | (np.diff(self.v) != 0) | (np.diff(self.a) != 0))
        self.begin = np.flatnonzero(new)[:len(order)]
        self.row, self.id = rows["row"].to_numpy()[order], rows["id"].to_numpy(object)[order]
        self.core, self.rank = rows["core"].to_numpy()[order], rank[order].tolist()
        edge = np.minimum(self.t - rows["low"].to_numpy()[order], rows["high"].to_numpy()[order] - self.t)
        reach = hours * 3600e6
        # a little less, for the rounding of costs
        sure = np.where(edge > reach, inf, edge / reach * 0.999999 - 1e-12)[self.begin]
        self.sure, self.maybe = sure.tolist(), [False] * len(self.begin)
        self.at, self.end = self.begin.tolist(), np.append(self.begin[1:], len(order)).tolist()

    def free(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.at, np.int64) < np.array(self.end, np.int64))

    def open_rows(self) -> np.ndarray:
        """Rows of the slab itself of which it is not known whom they pair with."""
        left = [range(self.at[k], self.end[k]) for k in range(len(self.at)) if self.maybe[k] or self.sure[k] < inf]
        places = np.fromiter((i for r in left for i in r), np.int64)
        return self.row[places[self.core[places]]]


def _cost(l: _Side, b: _Side, i: np.ndarray, j: np.ndarray, hours: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diff, hours and cost of rows ``i`` and ``j``, as ``pairing.fuzzy_cost`` has them."""
    diff = np.abs(b.v[j] - l.v[i])
    apart = np.abs((l.t[i] - b.t[j]) / 1e6) / 3600.0
    return diff, apart, diff / np.maximum(l.a[i], 1.0) + apart / float(hours)


def _near(l: _Side, b: _Side, ls: np.ndarray, bs: np.ndarray, radius: float, tolerance: Tolerance):
    """Per class of ``ls``, twice, the stretch of ``bs``, in an order that is given, that may lie within the radius."""
    i, j = l.begin[ls], b.begin[bs]
    reach = int(tolerance.hours * 3600e6 * min(radius, 1.0) * 1.000001) + 2
    half = np.maximum(tolerance.amount_abs, tolerance.amount_pct * l.a[i])
    if radius != inf:
        half = np.minimum(half, radius * np.maximum(l.a[i], 1.0))
    # room for rounding
    half = half * 1.000001 + 1e-6 + 1e-12 * np.abs(l.v[i])
    amounts = np.unique(b.v[j])
    width = len(amounts) + 1
    bins = b.t[j] // (2 * reach)
    first = bins.min()
    key = (bins - first) * width + np.searchsorted(amounts, b.v[j])
    order = np.argsort(key, kind="stable")
    key = key[order]
    low, high = np.searchsorted(amounts, l.v[i] - half, "left"), np.searchsorted(amounts, l.v[i] + half, "right")
    here, there = (l.t[i] - reach) // (2 * reach) - first, (l.t[i] + reach) // (2 * reach) - first
    begin = np.concatenate([np.searchsorted(key, x * width + low) for x in (here, there)])
    size = np.concatenate([np.searchsorted(key, x * width + high) for x in (here, there)]) - begin
    size[len(i):][here == there] = 0
    return begin, np.maximum(size, 0), bs[order]


def _edges(l: _Side, b: _Side, ls: np.ndarray, near, radius: float, tolerance: Tolerance) -> list[tuple]:
    begin, size, bs = near
    x = np.repeat(np.concatenate([ls, ls]), size)
    y = bs[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
    i, j = l.begin[x], b.begin[y]
    diff, apart, cost = _cost(l, b, i, j, tolerance.hours)
    wide = np.maximum(tolerance.amount_abs, tolerance.amount_pct * l.a[i])
    near = (diff <= wide) & (apart <= tolerance.hours) & (cost <= radius)
    x, y, cost = x[near], y[near], cost[near]
    heads = [np.array(s.rank, np.int64)[np.array(s.at, np.int64)[k]] for s, k in ((l, x), (b, y))]
    order = np.lexsort((heads[1], heads[0], cost))
    return list(zip(*(v[order].tolist() for v in (cost, heads[0], heads[1], x, y))))


def _choose(edges: list[tuple], l: _Side, b: _Side) -> list[tuple[int, int]]:
    """Places of the rows that pair for certain, in the order of the sequential choice."""
    pairs, later, k = [], [], 0
    while k < len(edges) or later:
        if later and (k == len(edges) or later[0] < edges[k]):
            edge = heapq.heappop(later)
        else:
            edge, k = edges[k], k + 1
        cost, l_head, b_head, x, y = edge
        i, j = l.at[x], b.at[y]
        if i >= l.end[x] or j >= b.end[y]:
            continue
        if l.maybe[x] or b.maybe[y] or cost >= l.sure[x] or cost >= b.sure[y]:
            l.maybe[x] = b.maybe[y] = True
        elif l.rank[i] != l_head or b.rank[j] != b_head:
            heapq.heappush(later, (cost, l.rank[i], b.rank[j], x, y))
        else:
            pairs.append((i, j))
            l.at[x], b.at[y] = i + 1, j + 1
            if i + 1 < l.end[x] and j + 1 < b.end[y]:
                heapq.heappush(later, (cost, l.rank[i + 1], b.rank[j + 1], x, y))
    return pairs


def settle(rows: pd.DataFrame, tolerance: Tolerance) -> pd.DataFrame:
    """Certain pairs of a slab with a row in it, and its open rows, as pairs with nothing."""
    key, is_ledger = rows["order_key"].iloc[0], (rows["side"] == "l").to_numpy()
    l, b = (_Side(rows[x], tolerance.hours) for x in (is_ledger, ~is_ledger))
    pairs: list[tuple[int, int]] = []
    radii = RADII
    while radii:
        ls, bs = l.free(), b.free()
        if not len(ls) or not len(bs):
            break
        budget = EDGES_PER_CLASS * max(len(ls) + len(bs), 1000)
        near, wider = _near(l, b, ls, bs, radii[0], tolerance), 1
        if near[1].sum() > 50 * budget:
            # nothing is known of what is left
            for side, free in ((l, ls), (b, bs)):
                for k in free.tolist():
                    side.maybe[k] = True
            break
        while wider < len(radii):
            following = _near(l, b, ls, bs, radii[wider], tolerance)
            if following[1].sum() > budget:
                break
            near, wider = following, wider + 1
        radius, radii = radii[wider - 1], radii[wider:]
        pairs += _choose(_edges(l, b, ls, near, radius, tolerance), l, b)
    i, j = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    own = l.core[i] | b.core[j]
    i, j = i[own], j[own]
    diff, apart, _ = _cost(l, b, i, j, tolerance.hours)
    l_open, b_open = l.open_rows(), b.open_rows()
    no_l, no_b = np.zeros(len(b_open), np.int64), np.zeros(len(l_open), np.int64)
    nothing = np.full(len(l_open) + len(b_open), None)
    kind = np.repeat([0, 1, 2], [len(i), len(l_open), len(b_open)])
    return pd.DataFrame({
        "order_key": key,
        "l_row": pd.arrays.IntegerArray(np.concatenate([l.row[i], l_open, no_l]), kind == 2),
        "b_row": pd.arrays.IntegerArray(np.concatenate([b.row[j], no_b, b_open]), kind == 1),
        "l_id": np.concatenate([l.id[i], nothing]), "b_id": np.concatenate([b.id[j], nothing]),
        "diff": np.append(diff, np.zeros(len(nothing))), "hours": np.append(apart, np.zeros(len(nothing))),
    })


# ---- all slabs -----------------------------------------------------------------------------------

def _numbered(points: DataFrame) -> DataFrame:
    """Points with ``row``, as ids may repeat."""
    return cut(points.withColumn("row", F.monotonically_increasing_id()))


def _rows(points: DataFrame, side: str) -> DataFrame:
    amount = c("net") if side == "l" else c("b_amount")
    return points.select(
        "order_key", F.lit(side).alias("side"), "row", c(f"{side}_id").alias("id"), amount.alias("v"),
        (c("l_amount") if side == "l" else F.lit(0.0)).alias("a"),
        (F.expr(f"cast({side}_at - timestamp_ntz'1970-01-01 00:00:00' as interval second)").cast("decimal(24,6)") * 1_000_000)
        .cast("long").alias("t"),
    )


def _regular(rows: DataFrame) -> DataFrame:
    """Keys of many rows, all of them with an id and finite amounts."""
    fit = c("id").isNotNull() & (F.abs("v") < 1e15) & (F.abs("a") < 1e15) & (F.abs("t") < (1 << 61))
    return rows.groupBy("order_key").agg(F.count("*").alias("n"), F.min(F.coalesce(fit, F.lit(False))).alias("fit")).filter(
        c("fit") & (c("n") > LEAST_ROWS)
    ).select("order_key")


def _placed(rows: DataFrame, size: int, cell: int) -> DataFrame:
    """Which slabs a cell's rows go to (``core``: it is the slab's own), and how far the slab with its margin reaches.

    Cells in order of time fill slabs of about ``size`` rows. A margin is as many cells as hold half of that for sure,
    at most as far as a row reaches. Keys with a cell of more rows are left out.
    """
    counts = rows.groupBy("order_key", "cell").agg(F.count("*").alias("n"))
    keys = counts.groupBy("order_key").agg(F.max("n").alias("most")).filter(2 * c("most") <= size).select(
        "order_key", F.least(F.lit(CELLS + 1), F.floor(F.lit(size / 2) / c("most"))).cast("long").alias("margin")
    )
    earlier = Window.partitionBy("order_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    own = cut(counts.join(keys, "order_key").withColumn(
        "slab", F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / F.lit(size)).cast("long")
    ).drop("n"))
    ends = own.groupBy("order_key", "slab").agg(
        ((F.min("cell") - F.min("margin")) * cell).alias("low"),
        ((F.max("cell") + 1 + F.min("margin")) * cell).alias("high"), F.lit(True).alias("some"),
    ).drop("some")
    around = own.select(
        "order_key", "cell", c("slab").alias("own"), F.explode(F.sequence(c("cell") - c("margin"), c("cell") + c("margin"))).alias("at")
    )
    reached = around.join(own.select("order_key", c("cell").alias("at"), "slab"), ["order_key", "at"]).groupBy(
        "order_key", "cell", "slab"
    ).agg(F.max(c("slab") == c("own")).alias("core"))
    return cut(reached.join(ends, ["order_key", "slab"]))


def pair_in_slabs(l_points: DataFrame, b_points: DataFrame, tolerance: Tolerance) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Pairs (``order_key, l_id, b_id, diff, hours``) found by slabs, and the points they leave to be paired."""
    l_points, b_points = _numbered(l_points), _numbered(b_points)
    rows = _rows(l_points, "l").unionByName(_rows(b_points, "b"))
    keys = cut(_regular(rows))
    if keys.isEmpty():
        return [], l_points.drop("row"), b_points.drop("row")
    cell = max(1, int(tolerance.hours * 3600e6) // CELLS)
    size = min(SLAB_ROWS, folding.FOLD_ROWS)
    still = cut(rows.join(keys, "order_key", "left_semi").withColumn("cell", F.floor(c("t") / F.lit(cell)).cast("long")))
    count, pairs = still.count(), []
    while count:
        places = _placed(still, size, cell)
        if places.isEmpty():
            break
        out = cut(still.join(places, ["order_key", "cell"]).groupBy("order_key", "slab").applyInPandas(
            lambda slab: settle(slab, tolerance), OUT
        ))
        found = cut(out.filter("l_row is not null and b_row is not null").dropDuplicates(["l_row"]))
        pairs.append(found)
        # keys that have no slabs wait for the other way
        waiting = still.join(places.select("order_key").distinct(), "order_key", "left_anti")
        left = []
        for side in "lb":
            mine = c(f"{side}_row").alias("row")
            opened = out.filter(f"{'b' if side == 'l' else 'l'}_row is null").select(mine)
            left.append(still.filter(c("side") == side).join(opened, "row", "left_semi").join(
                found.select(mine), "row", "left_anti"
            ).select(still.columns))
        before, last = count, still
        still = cut(reduce(DataFrame.unionByName, [waiting, *left]))
        forget(last)
        count = still.count()
        if count > OPEN_SHARE * before:
            break
    columns = ["order_key", "l_id", "b_id", "diff", "hours"]
    settled = keys.withColumn("settled", F.lit(True))

    def rest(points: DataFrame, side: str) -> DataFrame:
        own = still.filter(c("side") == side).select("row", F.lit(True).alias("open"))
        return points.join(settled, "order_key", "left").join(own, "row", "left").filter(
            c("settled").isNull() | c("open")
        ).drop("row", "settled", "open")

    return [p.select(*columns) for p in pairs], cut(rest(l_points, "l")), cut(rest(b_points, "b"))
