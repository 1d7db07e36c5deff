"""Nearest-amount pairing for keys with too many rows for one task.

On the amount axis a key is a sequence of runs, each of rows of one side. Where two runs meet,
the sequential choice pairs outward from the border: first row with first row, second with
second, and so on. So a row has only two possible partners now, one across each border of its
run, found by its index.

* A key of at most ``folding.FOLD_ROWS`` rows is folded by one task.
* In a larger key, pairs cheaper than anything that could take one of their rows from the other border
  first leave together, and so do first rows nearest to each other.
* Where runs are single rows, first pairs form a path, each excluding its neighbours. Along a path whose costs
  grow from such a nearest pair on, every second pair is taken, as long as it costs less than the rows
  left outside would: places along paths are running counts, so a path of any length is settled in one round.
* After that the axis is cut where neighbouring amounts are farther apart than a radius, the largest that leaves
  segments of at most ``FOLD_ROWS`` rows; pairs up to the radius cannot leave their segment, and each
  segment is folded by one task. Then runs that remain grow together, and the next round starts.

Equal amounts keep the order of ids from either border.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paisaflow.functions.times import hours_between
from paisaflow.operators import folding, pairing
from paisaflow.operators.numbering import running_counts
from paisaflow.session import cut

FAR = float("inf")


def _points(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    l = pairing.ledger_points(ledger).select(
        "order_key", F.lit("l").alias("side"), F.col("l_id").alias("id"), F.col("net").alias("v")
    )
    b = pairing.bank_points(bank).select(
        "order_key", F.lit("b").alias("side"), F.col("b_id").alias("id"),
        F.col("b_amount").alias("v"),
    )
    return l.unionByName(b).filter(F.col("v").isNotNull())


def _other() -> Column:
    return F.when(F.col("side") == "l", "b").otherwise("l")


def _with_runs(points: DataFrame) -> DataFrame:
    """Each row with its place on its side, its block of equal amounts and its run.

    ``place``: rows of its side before it; ``across``: rows of the other side before it, equal
    for all rows of a run. ``run_start``, ``run_end``: places of the run; ``left_rows``,
    ``right_rows``: sizes of the neighbouring runs; ``left_nearest``, ``right_nearest``: their
    nearest amounts.
    """
    counted = cut(running_counts(points, ["order_key"], ["v", "side", "id"], {
        "n_l": F.col("side") == "l", "n_b": F.col("side") == "b",
    }).select(
        "order_key", "side", "id", "v",
        F.when(F.col("side") == "l", F.col("n_l")).otherwise(F.col("n_b")).alias("place"),
        F.when(F.col("side") == "l", F.col("n_b")).otherwise(F.col("n_l")).alias("across"),
    ))
    blocks = counted.groupBy("order_key", "side", "v").agg(
        F.min("place").alias("block_first"), F.max("place").alias("block_last")
    )
    runs = counted.groupBy("order_key", "side", "across").agg(
        F.min("place").alias("run_start"), (F.max("place") + 1).alias("run_end"),
        F.min("v").alias("low"), F.max("v").alias("high"),
    )

    def neighbour(edge: str, name: str, nearest: str) -> DataFrame:
        return runs.select(
            "order_key", _other().alias("side"), F.col("across").alias(edge),
            (F.col("run_end") - F.col("run_start")).alias(f"{name}_rows"),
            F.col(nearest).alias(f"{name}_nearest"),
        )

    left, right = neighbour("run_start", "left", "high"), neighbour("run_end", "right", "low")
    runs = (
        runs.drop("low", "high")
        .join(left, ["order_key", "side", "run_start"], "left")
        .join(right, ["order_key", "side", "run_end"], "left")
        .na.fill(0, ["left_rows", "right_rows"])
    )
    return counted.join(blocks, ["order_key", "side", "v"]).join(
        runs, ["order_key", "side", "across"]
    )


def _with_bounds(rows: DataFrame) -> DataFrame:
    """The least cost at which anything beyond either border could take the row's block."""
    c = F.col
    left_place = F.greatest(
        c("across") - (c("block_first") - c("run_start") + 1), c("across") - c("left_rows")
    )
    right_place = F.least(
        c("across") + (c("run_end") - c("block_last")) - 1, c("across") + c("right_rows") - 1
    )
    rows = rows.withColumns({
        "other": _other(),
        "left_place": F.when(c("left_rows") > 0, left_place),
        "right_place": F.when(c("right_rows") > 0, right_place),
    })

    def value_at(place: str, name: str) -> DataFrame:
        return rows.select(
            "order_key", c("side").alias("other"), c("place").alias(place), c("v").alias(name)
        )

    at = lambda p: ["order_key", "other", p]
    return (
        rows.join(value_at("left_place", "left_v"), at("left_place"), "left")
        .join(value_at("right_place", "right_v"), at("right_place"), "left")
        .withColumns({
            "left_bound": F.coalesce(c("v") - c("left_v"), F.lit(FAR)),
            "right_bound": F.coalesce(c("right_v") - c("v"), F.lit(FAR)),
        })
    )


def _border_pairs(rows: DataFrame) -> DataFrame:
    """Rows of a run with their partner in the run to the right."""
    c = F.col
    # among equal amounts the lowest id stands nearest to either border
    from_right = c("run_end") - (c("block_first") + c("block_last") - c("place"))
    left = rows.withColumn("nth", from_right).filter(c("nth") <= c("right_rows")).select(
        "order_key", "nth", "side", c("id").alias("x"), c("v").alias("x_v"), "left_bound",
        (c("v") - c("left_nearest")).alias("left_gap"),
        (c("block_first") == c("run_start")).alias("x_at_border"),
        (c("run_end") - c("run_start") == 1).alias("x_single"), (c("place") + c("across")).alias("rank"),
        c("left_nearest").alias("left_rest"),
        c("other").alias("y_side"), (c("across") + c("nth") - 1).alias("y_place"),
    )
    right = rows.select(
        "order_key", c("side").alias("y_side"), c("place").alias("y_place"), c("id").alias("y"),
        c("v").alias("y_v"), "right_bound", (c("right_nearest") - c("v")).alias("right_gap"),
        (c("block_last") + 1 == c("run_end")).alias("y_at_border"),
        (c("run_end") - c("run_start") == 1).alias("y_single"), c("right_nearest").alias("right_rest"),
    )
    is_ledger = c("side") == "l"
    return left.join(right, ["order_key", "y_side", "y_place"]).select(
        "order_key", "nth", (c("y_v") - c("x_v")).alias("cost"), "left_bound", "right_bound",
        "left_gap", "right_gap", "x_at_border", "y_at_border", "x_single", "y_single", "rank",
        c("x_v"), c("y_v"), "left_rest", "right_rest",
        F.when(is_ledger, c("x")).otherwise(c("y")).alias("l_id"),
        F.when(is_ledger, c("y")).otherwise(c("x")).alias("b_id"),
    )


def _settled(pairs: DataFrame) -> DataFrame:
    """Pairs cheaper than any claim from the other border, and first rows nearest to each
    other; a tie with the other border is decided by ids between the first rows of both."""
    c = F.col
    certain = (c("cost") < c("left_bound")) & (c("cost") < c("right_bound"))
    sure = pairs.filter(certain).select("order_key", "l_id", "b_id")

    def nearest(gap: str, at_border: str) -> Column:
        tied = (c(gap) == c("cost")) & c(at_border)
        return c(gap).isNull() | (c(gap) > c("cost")) | tied

    firsts = pairs.filter(c("nth") == 1)
    rank = F.struct("cost", "l_id", "b_id")
    l_best = firsts.groupBy("l_id").agg(F.min(rank).alias("l_best"))
    b_best = firsts.groupBy("b_id").agg(F.min(rank).alias("b_best"))
    mutual = (
        firsts.filter(nearest("left_gap", "x_at_border") & nearest("right_gap", "y_at_border"))
        .join(l_best, "l_id").join(b_best, "b_id")
        .filter((c("l_best.b_id") == c("b_id")) & (c("b_best.l_id") == c("l_id")))
    )
    found = mutual.select("order_key", "l_id", "b_id")
    return sure.unionByName(found).unionByName(_along_paths(firsts, found)).distinct()


# ---- paths of first pairs -------------------------------------------------------------------------

def _along_paths(firsts: DataFrame, mutual: DataFrame) -> DataFrame:
    """Further first pairs that follow from the nearest ones, every second along paths of growing cost.

    A first pair excludes the one after it if they share a single-row run. From a nearest pair on, places
    0, 2, 4, ... of the growing path are taken while the cost stays below the distance to the nearest
    row outside the path's beginning; where two paths meet, the last pair is taken if both leave it free.
    A path's last row may begin a longer run: there nothing beyond that run may be cheaper.
    """
    c = F.col
    order = F.struct("cost", "l_id", "b_id")
    edges = cut(firsts.select(
        "order_key", "rank", "cost", "l_id", "b_id", "x_single", "y_single", "x_v", "y_v", "left_rest", "right_rest",
        "left_bound", "right_bound", order.alias("order"),
    ))
    before = edges.filter("y_single").select("order_key", (c("rank") + 1).alias("rank"), c("order").alias("order_before"))
    after = edges.filter("x_single").select("order_key", (c("rank") - 1).alias("rank"), c("order").alias("order_after"))
    # x_single says that the pair before, if there is one, ends in this pair's x
    linked = edges.join(before, ["order_key", "rank"], "left").join(after, ["order_key", "rank"], "left").withColumns({
        "grows_right": F.coalesce(c("x_single") & (c("order_before") < c("order")), F.lit(False)),
        "grows_left": F.coalesce(c("y_single") & (c("order_after") < c("order")), F.lit(False)),
    })
    placed = running_counts(linked, ["order_key"], ["rank"], {
        "begun": ~c("grows_right"), "ended": ~c("grows_left"),
    }).withColumns({
        # paths to the right are numbered by their first pair, paths to the left by their last
        "right_path": c("begun") + F.when(c("grows_right"), 0).otherwise(1), "left_path": c("ended"),
    })
    placed = cut(placed.drop("order_before", "order_after", "begun", "ended").join(
        mutual.select("l_id", "b_id", F.lit(True).alias("nearest")), ["l_id", "b_id"], "left"
    ))
    starts = placed.filter(~c("grows_right")).select(
        "order_key", "right_path", c("rank").alias("right_start"), c("left_rest").alias("right_limit"),
        F.coalesce("nearest", F.lit(False)).alias("right_sure"),
    )
    ends = placed.filter(~c("grows_left")).select(
        "order_key", "left_path", c("rank").alias("left_start"), c("right_rest").alias("left_limit"),
        F.coalesce("nearest", F.lit(False)).alias("left_sure"),
    )
    far = F.lit(FAR)
    known = placed.join(starts, ["order_key", "right_path"]).join(ends, ["order_key", "left_path"]).withColumns({
        "from_left": c("rank") - c("right_start"), "from_right": c("left_start") - c("rank"),
    }).withColumns({
        "right_fails": (c("from_left") % 2 == 0) & (c("from_left") > 0)
        & ((c("cost") >= F.coalesce(c("x_v") - c("right_limit"), far)) | (~c("y_single") & (c("cost") >= c("right_bound")))),
        "left_fails": (c("from_right") % 2 == 0) & (c("from_right") > 0)
        & ((c("cost") >= F.coalesce(c("left_limit") - c("y_v"), far)) | (~c("x_single") & (c("cost") >= c("left_bound")))),
    })
    known = cut(known)
    right_stop = known.filter("right_fails").groupBy("order_key", "right_path").agg(F.min("from_left").alias("right_stop"))
    left_stop = known.filter("left_fails").groupBy("order_key", "left_path").agg(F.min("from_right").alias("left_stop"))
    free_right = c("right_sure") & (c("from_left") % 2 == 0) & (c("right_stop").isNull() | (c("from_left") < c("right_stop")))
    free_left = c("left_sure") & (c("from_right") % 2 == 0) & (c("left_stop").isNull() | (c("from_right") < c("left_stop")))
    return known.join(right_stop, ["order_key", "right_path"], "left").join(left_stop, ["order_key", "left_path"], "left").filter(
        (c("grows_right") | c("grows_left")) & (~c("grows_right") | free_right) & (~c("grows_left") | free_left)
    ).select("order_key", "l_id", "b_id")


# ---- segments that one task can fold ----------------------------------------------------------------

CELL_LEVELS = range(20, -1, -2)
SPAN = "order_key string, l_id string, b_id string"


def _fold(points: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of whole segments: ``points`` has the columns ``by`` and ``radius``."""
    def fold(bucket: pd.DataFrame) -> pd.DataFrame:
        pairs = [
            (part.order_key.iloc[0], l, b) for _, part in bucket.groupby(by, sort=False, dropna=False)
            for l, b in folding.nearest_on_axis(part, float(part.radius.iloc[0]))
        ]
        return pd.DataFrame(pairs, columns=["order_key", "l_id", "b_id"], dtype=object)

    return folding.in_buckets(points, by, points.count()).groupBy("bucket").applyInPandas(fold, SPAN)


def _segments(points: DataFrame) -> DataFrame | None:
    """Points of keys that can be cut, with ``segment`` and the ``radius`` up to which it is closed.

    Amounts fall into 2**20 cells per key, each level four times as wide; a gap of a whole empty cell is
    farther than a cell's width. Only counts per cell are looked at.
    """
    c = F.col
    ranges = points.groupBy("order_key").agg(F.min("v").alias("low"), ((F.max("v") - F.min("v")) / 2 ** 20).alias("step"))
    celled = cut(points.join(ranges.filter("step > 0"), "order_key").withColumn(
        "cell", F.floor((c("v") - c("low")) / c("step")).cast("bigint")
    ))
    counts = cut(celled.groupBy("order_key", "cell", "step").count())
    order = Window.partitionBy("order_key").orderBy("wide")
    chosen = None
    for level in CELL_LEVELS:
        wide = counts.groupBy("order_key", "step", F.shiftright("cell", level).alias("wide")).agg(F.sum("count").alias("n"))
        cuts = wide.withColumn("new", F.coalesce(c("wide") - F.lag("wide").over(order) > 1, F.lit(True)).cast("int"))
        numbered = cuts.withColumn("segment", F.sum("new").over(order))
        fits = numbered.groupBy("order_key", "segment").agg(F.sum("n").alias("n")).groupBy("order_key").agg(
            F.max("n").alias("most")
        ).filter(c("most") <= folding.FOLD_ROWS).select("order_key")
        if chosen is not None:
            fits = fits.join(chosen.select("order_key").distinct(), "order_key", "left_anti")
        now = cut(numbered.join(fits, "order_key").select(
            "order_key", "wide", "segment", F.lit(level).alias("level"),
            # a little less than a cell, for the rounding of its borders
            (c("step") * 2.0 ** level * 0.999).alias("radius"),
        ))
        chosen = now if chosen is None else chosen.unionByName(now)
    chosen = cut(chosen)
    if chosen.isEmpty():
        return None
    levels = chosen.select("order_key", "level").distinct()
    return celled.join(levels, "order_key").withColumn("wide", F.expr("shiftright(cell, level)")).join(
        chosen.drop("level"), ["order_key", "wide"]
    ).select("order_key", "side", "id", "v", "segment", "radius")


def _without(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Points in no pair, of keys that have both sides left."""
    used = pairs.select(F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.col("l_id").alias("id")),
        F.struct(F.lit("b").alias("side"), F.col("b_id").alias("id")),
    )).alias("u")).select("u.*")
    left = cut(points.join(used, ["side", "id"], "left_anti"))
    both = left.groupBy("order_key").agg(F.min("side").alias("a"), F.max("side").alias("z")).filter("a < z")
    return left.join(both.select("order_key"), "order_key", "left_semi")


def pair_nearest(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """``order_key, l_id, b_id, diff, hours`` for the rows of hot keys."""
    open_points = cut(_points(ledger, bank))
    rounds: list[DataFrame] = []
    while True:
        sizes = cut(open_points.groupBy("order_key").count())
        fits = F.col("count") <= folding.FOLD_ROWS
        small = open_points.join(sizes.filter(fits).select("order_key"), "order_key")
        rounds.append(cut(_fold(small.withColumn("radius", F.lit(FAR)), ["order_key"])))
        open_points = cut(open_points.join(sizes.filter(~fits).select("order_key"), "order_key"))
        if open_points.isEmpty():
            break
        rows = cut(_with_bounds(_with_runs(open_points)))
        settled = cut(_settled(_border_pairs(rows)))
        rounds.append(settled)
        # a run without neighbours is all that is left of its key
        still = rows.filter((F.col("left_rows") > 0) | (F.col("right_rows") > 0)).select("order_key", "side", "id", "v")
        open_points = cut(_without(still, settled))
        segments = _segments(open_points)
        if segments is not None:
            folded = cut(_fold(segments, ["order_key", "segment"]))
            rounds.append(folded)
            open_points = cut(_without(open_points, folded))
    pairs = reduce(DataFrame.unionByName, rounds)
    l = pairing.ledger_points(ledger).drop("order_key")
    b = pairing.bank_points(bank).drop("order_key")
    return pairs.join(l, "l_id").join(b, "b_id").select(
        "order_key", "l_id", "b_id", pairing.diff().alias("diff"),
        hours_between(F.col("b_at"), F.col("l_at")).alias("hours"),
    )
