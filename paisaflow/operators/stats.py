"""Counts, shares, profiles and histograms over any of the tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from paisaflow.functions.frames import one_row
from paisaflow.operators.numbering import BROADCAST_ROWS
from paisaflow.schemas import TIER_ORDER, TIER_TOLERANCES
from paisaflow.session import cut


def count_by(df: DataFrame, *columns: str, name: str = "rows") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def with_share(counts: DataFrame, name: str = "rows") -> DataFrame:
    """Percent of the total, over an already small table of counts."""
    everything = Window.partitionBy()
    return counts.withColumn("share_pct", F.col(name) * 100.0 / F.sum(name).over(everything))


def by_reason_and_side(exceptions: DataFrame) -> DataFrame:
    counted = count_by(exceptions, "reason", "side")
    return counted.groupingSets([["reason"], ["side"]], "reason", "side").agg(
        F.sum("rows").alias("rows")
    )


def filter_by_reason(exceptions: DataFrame, reason: str | None = None) -> DataFrame:
    return exceptions.filter(F.col("reason") == reason) if reason else exceptions


def tier_waterfall(matches: DataFrame) -> DataFrame:
    """Tier counts with the sum of the earlier tiers; tiers without matches count zero."""
    spark = matches.sparkSession
    tiers = spark.createDataFrame(list(enumerate(TIER_ORDER)), "step int, tier string")
    counts = count_by(matches, "tier", name="matches")
    steps = tiers.join(counts, "tier", "left").select(
        "step", "tier", F.coalesce("matches", F.lit(0)).alias("matches")
    )
    before = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("offset", F.coalesce(F.sum("matches").over(before), F.lit(0)))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, one row per column."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column_name", "nulls")


def flag_sums(df: DataFrame, *flags: str) -> DataFrame:
    return df.agg(*[F.sum(F.col(f).cast("int")).alias(f) for f in flags])


# ---- exact quantiles -------------------------------------------------------------------------

QUANTILE_BINS = 1024


def _by_group(table: DataFrame) -> DataFrame:
    """Marked for broadcast while it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def exact_quantiles(
    df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """``by``, ``n``, ``low``, ``high`` and ``q``, the interpolated quantiles, of the known values.

    A wanted rank lies in a range of values with a known number of rows below it, at first the whole group. Each
    pass counts the rows of the ranges in bins and goes on with the bins that hold the ranks, until these
    have one value. Only counts are shuffled, and no task holds a group's values or its distinct values.
    """
    c = F.col
    keys = [f"_by{i}" for i in range(len(by) or 1)]
    rows = df.select(
        *[c(name).alias(k) for name, k in zip(by, keys)], c(column).cast("double").alias("v")
    ).filter(c("v").isNotNull())
    if not by:
        rows = rows.withColumn("_by0", F.lit(0))
    groups = cut(rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    ).filter("n > 0"))
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("bigint").alias("rank"))
        for i, share in enumerate(shares)
        for side, rank in (("lower", F.floor((c("n") - 1) * share)), ("upper", F.ceil((c("n") - 1) * share)))
    ])
    targets = cut(groups.select(*keys, c("low").alias("lo"), c("high").alias("hi"), F.inline(ranks)).withColumn(
        "base", F.lit(0).cast("bigint")
    ))
    found = targets.filter("lo = hi")
    open_targets = cut(targets.filter("lo < hi"))
    while not open_targets.isEmpty():
        ranges = cut(open_targets.select(*[c(k).alias(f"{k}_r") for k in keys], "lo", "hi", "base").distinct())
        within = c("v").between(c("lo"), c("hi"))
        if by:
            inside = rows.join(_by_group(ranges), reduce(and_, [c(k).eqNullSafe(c(f"{k}_r")) for k in keys], within))
        else:
            # two ranges per share at most
            listed = F.array(*[
                F.struct(F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), F.lit(r.base).alias("base"))
                for r in ranges.collect()
            ])
            inside = rows.select("*", F.inline(listed)).filter(within)
        place = F.floor((c("v") - c("lo")) / (c("hi") - c("lo")) * QUANTILE_BINS)
        bins = inside.groupBy(*keys, "lo", "base", F.least(place, F.lit(QUANTILE_BINS - 1)).alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi")
        )
        below = Window.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counted = cut(bins.withColumn("first", c("base") + F.coalesce(F.sum("n").over(below), F.lit(0))).drop("base"))
        t, u = open_targets.alias("t"), counted.alias("u")
        held = t.join(u, reduce(
            and_, [c(f"t.{k}").eqNullSafe(c(f"u.{k}")) for k in keys], c("t.lo") == c("u.lo")
        )).filter((c("rank") >= c("first")) & (c("rank") < c("first") + c("u.n"))).select(
            *[c(f"t.{k}").alias(k) for k in keys], c("bin_lo").alias("lo"), c("bin_hi").alias("hi"), "i", "side", "rank",
            c("first").alias("base"),
        )
        held = cut(held)
        found = found.unionByName(held.filter("lo = hi"))
        open_targets = cut(held.filter("lo < hi"))
    both = found.groupBy(*keys, "i").agg(
        F.max(F.when(c("side") == "lower", c("lo"))).alias("a"), F.max(F.when(c("side") == "upper", c("lo"))).alias("z")
    ).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "a", "z"))).alias("pairs"))
    g, b = groups.alias("g"), both.alias("b")
    values = F.array(*[
        (lambda e, x: e["a"] + (x - F.floor(x)) * (e["z"] - e["a"]))(c("pairs")[i], (c("n") - 1) * share)
        for i, share in enumerate(shares)
    ])
    return g.join(b, reduce(and_, [c(f"g.{k}").eqNullSafe(c(f"b.{k}")) for k in keys], F.lit(True))).select(
        *[c(f"g.{k}").alias(name) for k, name in zip(keys, by)], "n", "low", "high", values.alias("q")
    )


def _quartiles(df: DataFrame, column: str, *by: str) -> DataFrame:
    found = exact_quantiles(df, column, (0.25, 0.5, 0.75), by)
    kind = df.schema[column].dataType
    return found.select(
        *by, F.col("low").cast(kind).alias("low"), *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))],
        F.col("high").cast(kind).alias("high"),
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and interpolated quartiles of a column."""
    moments = df.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev(column).alias("std")
    )
    quartiles = _quartiles(df, column)
    if quartiles.isEmpty():
        kind = df.schema[column].dataType
        return moments.select("n", "mean", "std", *[
            F.lit(None).cast(kind if name in ("low", "high") else "double").alias(name)
            for name in ("low", "q25", "q50", "q75", "high")
        ])
    return one_row(moments, quartiles).select("n", "mean", "std", "low", "q25", "q50", "q75", "high")


def quartiles_by(df: DataFrame, column: str, by: str) -> DataFrame:
    return _quartiles(df, column, by)


def integer_histogram(df: DataFrame, column: str) -> DataFrame:
    return count_by(df, column)


def equal_width_histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """Counts in equal bins between the extremes, the last bin closed."""
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull())
    low, high = values.agg(F.min("v"), F.max("v")).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    place = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * bins)
    return values.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("rows")
    )


def tolerance_of(tier: Column) -> Column:
    """The band of a tier as a struct; null for tiers without one."""
    out = F.lit(None)
    for name, t in TIER_TOLERANCES.items():
        out = F.when(tier == name, F.struct(
            F.lit(float(t.amount_abs)).alias("amount_abs"),
            F.lit(float(t.amount_pct)).alias("amount_pct"),
            F.lit(float(t.hours)).alias("timestamp_hours"),
        )).otherwise(out)
    return out


def list_matches(
    matches: DataFrame,
    ledger: DataFrame,
    bank: DataFrame,
    tier: str | None = None,
    by_drift: bool = False,
    limit: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """(total before the limit, first matches with both source rows and the tier's band).

    The limit comes first; the few rows kept are then looked up in the big tables.
    """
    rows = matches.filter(F.col("tier") == tier) if tier else matches
    total = rows.agg(F.count("*").alias("total"))
    ids = ["ledger_row_id", "bank_row_id"]
    order = [F.desc(F.abs("amount_diff")), *ids] if by_drift else ids
    top = rows.orderBy(*order).limit(limit)

    def look_up(table: DataFrame, key: str, name: str) -> DataFrame:
        few = F.broadcast(top.select(F.col(key).alias("row_id")))  # at most ``limit`` ids
        return table.join(few, "row_id").select(
            F.col("row_id").alias(key), F.struct("order_id", "amount", "timestamp").alias(name)
        )

    found = top.join(look_up(ledger, "ledger_row_id", "ledger"), "ledger_row_id", "left")
    found = found.join(look_up(bank, "bank_row_id", "bank"), "bank_row_id", "left")
    return total, found.select(
        *matches.columns, "ledger", "bank", tolerance_of(F.col("tier")).alias("tolerance")
    )
