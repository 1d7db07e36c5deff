"""Greedy pairing within amount and time bands for keys with too many rows for one task.

Gives exactly the pairs of ``pairing.take_greedily``, without listing a group's pairs:

* Rows equal in all that the cost sees form one class; copies of a row, however many, are
  one class with a count. Ids inside a class are ranked, and classes are paired in rank order.
* Classes are compared only within a radius, through grid cells. All pairs cheaper than the
  radius are settled before a larger radius is looked at, so few classes are still near each
  other when it grows. Pairs are counted per cell before any is made, and the largest radius
  that keeps their number low is used.
* Keys of very many rows are settled by slabs of time first (``slabs``); only what these leave is paired here.
* Inside a radius, edges fall into connected parts that cannot touch each other. Parts of at most
  ``folding.FOLD_ROWS`` edges and rows are folded by one task each, so ties, however long their chains,
  cost no rounds. In larger parts, classes that are each other's cheapest partner are paired and leave; with
  the order (cost, ledger id, bank id) that is what the sequential choice would do. What is left
  falls into parts again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions.money import band
from paisaflow.functions.times import epoch_seconds
from paisaflow.operators import folding, pairing, slabs
from paisaflow.operators.components import connected
from paisaflow.operators.numbering import rank_in_groups
from paisaflow.schemas import Tolerance
from paisaflow.session import cut

PAIRS_PER_CLASS = 32
# Rounds in large parts before their rest is looked at for small parts again.
ROUNDS_BETWEEN = 3
SPAN = "l_class string, b_class string, l_start long, b_start long, k long"
CELL = ["order_key", "scale", "amount_cell", "time_cell"]


@dataclass(frozen=True)
class Grid:
    """What a cost looks at and how rows within a radius of each other share a cell."""

    ledger_class: list[str]
    bank_class: list[str]
    cost: Column
    allowed: Column
    radii: list[float]
    ledger_cells: Callable[[DataFrame, float], DataFrame]
    bank_cells: Callable[[DataFrame, DataFrame, float], DataFrame]


def _span(center: Column, half: Column, width: Column) -> Column:
    """Numbers of the cells that ``center ± half`` touches, with room for rounding."""
    wide = half * 1.000001 + 1e-6
    return F.sequence(
        F.floor((center - wide) / width).cast("bigint"),
        F.floor((center + wide) / width).cast("bigint"),
    )


def _band_grid(tolerance: Tolerance) -> Grid:
    def half(radius: float) -> Column:
        limit = band(F.col("l_amount"), tolerance.amount_abs, tolerance.amount_pct)
        if radius == inf:
            return limit
        return F.least(limit, F.lit(radius) * F.greatest(F.col("l_amount"), F.lit(1.0)))

    def time_half(radius: float) -> float:
        return tolerance.hours * 3600.0 * min(radius, 1.0)

    def ledger_cells(df: DataFrame, radius: float) -> DataFrame:
        w = time_half(radius)
        df = df.withColumn("scale", F.ceil(F.log2(half(radius))).cast("int"))
        df = df.withColumn(
            "amount_cell", F.explode(_span(F.col("net"), half(radius), F.pow(2.0, "scale")))
        )
        return df.withColumn("time_cell", F.explode(
            _span(epoch_seconds(F.col("l_at")), F.lit(w), F.lit(2 * w))
        ))

    def bank_cells(df: DataFrame, ledger: DataFrame, radius: float) -> DataFrame:
        # powers of two between the smallest and largest half width: a few dozen at most
        scales = [r.scale for r in ledger.select("scale").distinct().collect()]
        df = df.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
        return df.withColumns({
            "amount_cell": F.floor(F.col("b_amount") / F.pow(2.0, "scale")).cast("bigint"),
            "time_cell": F.floor(
                epoch_seconds(F.col("b_at")) / (2 * time_half(radius))
            ).cast("bigint"),
        })

    return Grid(
        ["order_key", "net", "l_amount", "l_at"], ["order_key", "b_amount", "b_at"],
        pairing.fuzzy_cost(tolerance), pairing.in_band(tolerance),
        [2.0 ** -e for e in range(20, 0, -2)] + [inf], ledger_cells, bank_cells,
    )


def _classes(rows: DataFrame, columns: list[str], side: str) -> tuple[DataFrame, DataFrame]:
    """Rows with class and rank in it, and one row per class."""
    ranked = rank_in_groups(rows, columns, [f"{side}_id"], "rank")
    classes = ranked.groupBy(*columns).agg(
        F.min(f"{side}_id").alias(f"{side}_class"), F.count("*").alias("n")
    )
    return cut(ranked.join(classes.drop("n"), columns)), cut(classes)


def _state(
    classes: DataFrame, ranked: DataFrame, taken: DataFrame | None, side: str
) -> DataFrame:
    """Classes with free rows: how many are taken, how many are left, the first free id."""
    key = f"{side}_class"
    if taken is None:
        return classes.withColumns({
            f"{side}_start": F.lit(0).cast("bigint"), f"{side}_left": F.col("n"),
            f"{side}_head": F.col(key),
        }).drop("n")
    used = taken.groupBy(key).agg(F.sum("k").alias("used"))
    open_classes = classes.join(used, key, "left").withColumns({
        f"{side}_start": F.coalesce("used", F.lit(0)).cast("bigint"),
        f"{side}_left": F.col("n") - F.coalesce("used", F.lit(0)),
    }).filter(F.col(f"{side}_left") > 0).drop("n", "used")
    return _with_head(open_classes, ranked, side)


def _with_head(open_classes: DataFrame, ranked: DataFrame, side: str) -> DataFrame:
    key, start = f"{side}_class", f"{side}_start"
    heads = ranked.select(
        key, F.col("rank").alias(start), F.col(f"{side}_id").alias(f"{side}_head")
    )
    return open_classes.join(heads, [key, start])


def _edges(l_cells: DataFrame, b_cells: DataFrame, grid: Grid, radius: float) -> DataFrame:
    pairs = l_cells.join(b_cells, CELL).filter(grid.allowed)
    pairs = pairs.withColumn("cost", grid.cost)
    if radius != inf:
        pairs = pairs.filter(F.col("cost") <= radius)
    sides = [f"{s}_{c}" for s in "lb" for c in ("class", "head", "start", "left")]
    return pairs.select("order_key", *sides, "cost")


# ---- parts that one task can fold -------------------------------------------------------------

def _weighed(edges: DataFrame, by: str) -> DataFrame:
    """Per ``by`` whether its edges and the rows they may pair fit one task."""
    rows = F.sum(1 + F.least("l_left", "b_left"))
    return edges.groupBy(by).agg((rows <= folding.FOLD_ROWS).alias("fits"))


def _in_parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of small parts, with ``part``, and the edges of large ones.

    A key that fits is one part. Only larger keys are taken apart along their edges.
    """
    keys = cut(_weighed(edges, "order_key"))
    by_key = edges.join(keys.filter("fits").select("order_key"), "order_key").withColumn("part", F.col("order_key"))
    large = edges.join(keys.filter("not fits").select("order_key"), "order_key")
    if keys.filter("not fits").isEmpty():
        return by_key, large
    nodes = connected(large.select(
        F.concat(F.lit("l"), "l_class").alias("a"), F.concat(F.lit("b"), "b_class").alias("b")
    ))
    placed = cut(large.join(nodes.select(
        F.expr("substring(node, 2)").alias("l_class"), "part", F.left("node", F.lit(1)).alias("side")
    ).filter("side = 'l'").drop("side"), "l_class"))
    parts = cut(_weighed(placed, "part"))
    small = placed.join(parts.filter("fits").select("part"), "part")
    rest = placed.join(parts.filter("not fits").select("part"), "part").drop("part")
    return by_key.unionByName(small), rest


def _folded(edges: DataFrame, l_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """Pairs of whole parts, as spans of one row each. A task folds a bucket of parts, one after the other."""
    text = F.lit(None).cast("string")

    def members(rows: DataFrame, side: str) -> DataFrame:
        start, key, head = f"{side}_start", f"{side}_class", f"{side}_head"
        open_ids = edges.select("part", key, start, head, F.least("l_left", "b_left").alias("most")).groupBy(
            "part", key, start, head
        ).agg(F.sum("most").alias("most"))
        # no more rows of a class than all its edges could pair; the first is known
        firsts = open_ids.select("part", key, F.col(start).alias("rank"), F.col(head).alias("id"))
        later = rows.select(key, "rank", F.col(f"{side}_id").alias("id")).join(
            open_ids.filter("most > 1"), key
        ).filter((F.col("rank") > F.col(start)) & (F.col("rank") < F.col(start) + F.col("most"))).select(
            "part", key, "rank", "id"
        )
        return firsts.unionByName(later).select(
            "part", F.lit(side).alias("kind"), F.col(key).alias("l_class"), text.alias("b_class"),
            F.lit(0.0).alias("cost"), F.col("rank").cast("bigint").alias("rank"), "id",
        )

    links = edges.select(
        "part", F.lit("e").alias("kind"), "l_class", "b_class", "cost", F.lit(0).cast("bigint").alias("rank"),
        text.alias("id"),
    )
    table = links.unionByName(members(l_rows, "l")).unionByName(members(b_rows, "b"))

    def fold(bucket: pd.DataFrame) -> pd.DataFrame:
        parts: dict = {}
        rows = bucket.sort_values("rank", kind="stable")
        columns = ("part", "kind", "l_class", "b_class", "cost", "rank", "id")
        for part, kind, l, b, cost, rank, row_id in zip(*(rows[c].tolist() for c in columns)):
            own = parts.setdefault(part, {"e": [], "l": {}, "b": {}, "first": {}})
            if kind == "e":
                own["e"].append((l, b, cost))
            else:
                own[kind].setdefault(l, []).append(row_id)
                own["first"].setdefault((kind, l), rank)
        return pd.DataFrame(
            [(l, b, own["first"]["l", l] + i, own["first"]["b", b] + j, 1) for own in parts.values()
             for l, b, i, j in folding.cheapest_edges(own["e"], own["l"], own["b"])],
            columns=["l_class", "b_class", "l_start", "b_start", "k"],
        )

    rows = edges.agg(F.sum(1 + 2 * F.least("l_left", "b_left"))).first()[0] or 0
    return folding.in_buckets(table, ["part"], rows).groupBy("bucket").applyInPandas(fold, SPAN)


def _cheapest(edges: DataFrame, side: str, other: str) -> DataFrame:
    """Per class its cheapest partner, and whether another class costs the same."""
    me, you = f"{side}_class", f"{other}_class"
    by_cost = edges.groupBy(me, "cost").agg(
        F.min(F.struct(f"{other}_head", you)).alias("pick"), F.count("*").alias("ties")
    )
    best = by_cost.groupBy(me).agg(F.min_by(F.struct("pick", "ties"), "cost").alias("b"))
    return best.select(me, F.col(f"b.pick.{you}").alias(you), F.col("b.ties").alias(f"{side}_ties"))


def _settle(edges: DataFrame) -> DataFrame:
    """Class pairs that choose each other, with the number of rows they may pair at once."""
    mutual = _cheapest(edges, "l", "b").join(_cheapest(edges, "b", "l"), ["l_class", "b_class"])
    unique = (F.col("l_ties") == 1) & (F.col("b_ties") == 1)
    return mutual.join(edges, ["l_class", "b_class"]).select(
        "l_class", "b_class", "l_start", "b_start", "l_left", "b_left",
        F.when(unique, F.least("l_left", "b_left")).otherwise(F.lit(1)).cast("bigint").alias("k"),
    )


def _advance(edges: DataFrame, settled: DataFrame, ranked: DataFrame, side: str) -> DataFrame:
    """Edges after a round: used-up classes leave, the others start at their next free row."""
    key, start, left, head = (f"{side}_{c}" for c in ("class", "start", "left", "head"))
    moved = settled.select(
        key, (F.col(start) + F.col("k")).alias(start), (F.col(left) - F.col("k")).alias(left)
    )
    still_open = _with_head(moved.filter(F.col(left) > 0), ranked, side)
    untouched = edges.join(moved, key, "left_anti")
    going_on = edges.drop(start, left, head).join(still_open, key)
    return untouched.unionByName(going_on)


def _pick_radius(
    l: DataFrame, b: DataFrame, grid: Grid, radii: list[float]
) -> tuple[float, DataFrame, DataFrame, bool]:
    """The largest radius whose cells hold few enough pairs, and both sides in its cells."""
    budget = PAIRS_PER_CLASS * max(l.count() + b.count(), 1000)
    for radius in reversed(radii):
        l_cells = grid.ledger_cells(l, radius)
        b_cells = grid.bank_cells(b, l_cells, radius)
        per_cell = l_cells.groupBy(*CELL).agg(F.count("*").alias("nl")).join(
            b_cells.groupBy(*CELL).agg(F.count("*").alias("nb")), CELL
        )
        pairs = per_cell.agg(F.sum(F.col("nl").cast("double") * F.col("nb"))).first()[0] or 0.0
        if pairs <= budget or radius == radii[0]:
            break
    return radius, l_cells, b_cells, pairs > 0


def _row() -> list[Column]:
    return [
        F.col("order_key"), F.col("l_id"), F.col("b_id"), pairing.diff().alias("diff"),
        pairing.hours().alias("hours"),
    ]


def _pair(ledger: DataFrame, bank: DataFrame, grid: Grid) -> DataFrame:
    l_rows, l_classes = _classes(ledger, grid.ledger_class, "l")
    b_rows, b_classes = _classes(bank, grid.bank_class, "b")
    rounds: list[DataFrame] = []
    radii = grid.radii
    while radii:
        taken = reduce(DataFrame.unionByName, rounds) if rounds else None
        l = cut(_state(l_classes, l_rows, taken, "l"))
        b = cut(_state(b_classes, b_rows, taken, "b"))
        if l.isEmpty() or b.isEmpty():
            break
        radius, l_cells, b_cells, some = _pick_radius(l, b, grid, radii)
        radii = [r for r in radii if r > radius]
        if not some:
            continue
        edges = cut(_edges(l_cells, b_cells, grid, radius))
        while not edges.isEmpty():
            small, edges = _in_parts(edges)
            rounds.append(cut(_folded(cut(small), l_rows, b_rows)))
            edges = cut(edges)
            for _ in range(ROUNDS_BETWEEN):
                if edges.isEmpty():
                    break
                settled = cut(_settle(edges))
                rounds.append(settled.select("l_class", "b_class", "l_start", "b_start", "k"))
                edges = _advance(edges, settled, l_rows, "l")
                edges = cut(_advance(edges, settled, b_rows, "b"))
    if not rounds:
        nothing = ledger.join(bank, "order_key").filter(F.lit(False))
        return nothing.select(*_row())
    spans = reduce(DataFrame.unionByName, rounds)
    in_span = (F.col("rank") >= F.col("l_start")) & (F.col("rank") < F.col("l_start") + F.col("k"))
    left = l_rows.join(spans, "l_class").filter(in_span).withColumn(
        "b_rank", F.col("b_start") + F.col("rank") - F.col("l_start")
    ).drop("rank")
    right = b_rows.withColumnRenamed("rank", "b_rank").drop("order_key")
    return left.join(right, ["b_class", "b_rank"]).select(*_row())


def pair_in_bands(ledger: DataFrame, bank: DataFrame, tolerance: Tolerance) -> DataFrame:
    known = lambda df, *cols: df.dropna(subset=list(cols))
    found, l, b = slabs.pair_in_slabs(
        known(pairing.ledger_points(ledger), "net", "l_amount", "l_at"),
        known(pairing.bank_points(bank), "b_amount", "b_at"), tolerance,
    )
    return reduce(DataFrame.unionByName, [_pair(l, b, _band_grid(tolerance)), *found])
