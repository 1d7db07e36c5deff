"""Sequential choices that fit one task, for the parts of a hot key that nothing outside can touch."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Rows or edges a task folds in memory.
FOLD_ROWS = 200_000
# Rows of small parts that a task takes in one call, and the most tasks they are dealt to.
BUCKET_ROWS = 20_000
MOST_TASKS = 1_000


def in_buckets(table: DataFrame, by: list[str], rows: int) -> DataFrame:
    """``table`` of about ``rows`` rows with ``bucket``: whole parts, told by ``by``, of about ``BUCKET_ROWS`` rows.

    Most parts are a few rows; a call of Python for each would take far longer than their folds.
    """
    n = max(1, ceil(rows / BUCKET_ROWS))
    return table.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(n))).repartition(min(n, MOST_TASKS), "bucket")


def nearest_on_axis(rows: pd.DataFrame, limit: float) -> Iterator[tuple[str, str]]:
    """(l_id, b_id) in the order of the sequential choice, up to cost ``limit``.

    ``rows``: side, id, v. Rows of one amount are a node with a queue of ids; the cheapest pair is always between
    the heads of neighbouring nodes, so only neighbours wait in the heap.
    """
    nodes: list[dict] = []
    ordered = rows.sort_values(["v", "side", "id"], kind="stable")
    # NaN equals no group key, as in a grouping of pandas
    points = ((v, side, i) for v, side, i in zip(*(ordered[c].tolist() for c in ("v", "side", "id"))) if v == v)
    for v, same in groupby(points, key=lambda p: p[0]):
        own = {"v": v, "l": [], "b": [], "at": 0}
        for _, side, i in same:
            own[side].append(i)
        both = min(len(own["l"]), len(own["b"]))
        # equal amounts cost nothing: in order of ids, before anything else
        yield from zip(own["l"][:both], own["b"][:both])
        side = "l" if len(own["l"]) > both else "b"
        if len(own[side]) > both:
            nodes.append({"v": v, "side": side, "ids": own[side][both:], "at": 0})
    before = list(range(-1, len(nodes) - 1))
    after = list(range(1, len(nodes))) + [-1]
    heap: list[tuple] = []

    def alive(i: int) -> bool:
        return i >= 0 and nodes[i]["at"] < len(nodes[i]["ids"])

    def offer(x: int, y: int) -> None:
        if not (alive(x) and alive(y)) or nodes[x]["side"] == nodes[y]["side"]:
            return
        cost = nodes[y]["v"] - nodes[x]["v"]
        if cost <= limit:
            heads = {nodes[i]["side"]: nodes[i]["ids"][nodes[i]["at"]] for i in (x, y)}
            heapq.heappush(heap, (cost, heads["l"], heads["b"], x, y))

    for i in range(len(nodes) - 1):
        offer(i, i + 1)
    while heap:
        _, l_id, b_id, x, y = heapq.heappop(heap)
        if not (alive(x) and alive(y)):
            continue
        heads = {nodes[i]["side"]: nodes[i]["ids"][nodes[i]["at"]] for i in (x, y)}
        if (heads["l"], heads["b"]) != (l_id, b_id):
            offer(x, y)
            continue
        yield l_id, b_id
        for i in (x, y):
            nodes[i]["at"] += 1
        for i in (x, y):
            if not alive(i):
                left, right = before[i], after[i]
                if left >= 0:
                    after[left] = right
                if right >= 0:
                    before[right] = left
                offer(left, right)
        if alive(x) and alive(y):
            offer(x, y)


def cheapest_edges(
    edges: Iterable[tuple[str, str, float]], l_ids: dict[str, list[str]], b_ids: dict[str, list[str]]
) -> Iterator[tuple[str, str, int, int]]:
    """(l_class, b_class, place in l_class, place in b_class) of each pair in the order of the sequential choice.

    ``edges``: l_class, b_class, cost.

    Classes hand out their ids in order. Their heads only grow, so an entry of the heap whose heads have
    gone waits again with the present ones.
    """
    at = {("l", k): 0 for k in l_ids} | {("b", k): 0 for k in b_ids}
    heap = [
        (cost, l_ids[l][0], b_ids[b][0], l, b) for l, b, cost in edges
    ]
    heapq.heapify(heap)
    while heap:
        cost, l_id, b_id, l, b = heap[0]
        i, j = at["l", l], at["b", b]
        if i >= len(l_ids[l]) or j >= len(b_ids[b]):
            heapq.heappop(heap)
        elif (l_ids[l][i], b_ids[b][j]) != (l_id, b_id):
            heapq.heapreplace(heap, (cost, l_ids[l][i], b_ids[b][j], l, b))
        else:
            yield l, b, i, j
            at["l", l] += 1
            at["b", b] += 1
