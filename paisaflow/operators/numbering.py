"""Row numbers without gathering the rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from paisaflow.session import cut


# One row per file split or task: small even for very large inputs, and checked all the same.
BROADCAST_ROWS = 100_000


def _small(table: DataFrame) -> DataFrame:
    """The table stored, and marked for broadcast if it is as small as expected."""
    stored = cut(table)
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def running_counts(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], flags: dict[str, Column]
) -> DataFrame:
    """For each row, how many earlier rows of its group have each flag set.

    "Earlier" is by ``order`` within ``groups``. Rows are
    range-partitioned, so a group of any size spreads over tasks; each task counts in its part
    and adds the group's counts in earlier parts, a table with one row per part.
    """
    names = list(flags)
    placed = cut(
        df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    ).withColumns({f"_is_{n}": c.cast("bigint") for n, c in flags.items()})
    here = (
        Window.partitionBy("_part", *groups).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = placed.groupBy("_part", *groups).agg(
        *[F.sum(f"_is_{n}").alias(f"_all_{n}") for n in names]
    )
    earlier = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    none = F.lit(0).cast("bigint")
    before = totals.select("_part", *groups, *[
        F.coalesce(F.sum(f"_all_{n}").over(earlier), none).alias(f"_before_{n}") for n in names
    ])
    inside = placed.withColumns({
        f"_here_{n}": F.coalesce(F.sum(f"_is_{n}").over(here), none) for n in names
    })
    return inside.join(before, ["_part", *groups]).select(
        *df.columns, *[(F.col(f"_before_{n}") + F.col(f"_here_{n}")).alias(n) for n in names]
    )


def rank_in_groups(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """Zero-based rank in ``order`` within ``groups`` (none: over the whole frame).

    As ``running_counts``, but a row's place in its part is read off the row's sequence number,
    so the rows are shuffled and sorted once.
    """
    placed = cut(
        df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_seq", 33))
    parts = placed.groupBy("_part", *groups).agg(
        F.count("*").alias("_n"), F.min("_seq").alias("_first")
    )
    earlier = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = parts.select(
        "_part", *groups, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col("_seq") - F.col("_first")
    return placed.join(before if groups else _small(before), ["_part", *groups]).select(
        *df.columns, place.cast("bigint").alias(name)
    )


def file_row_number(scan: DataFrame, name: str = "row_num") -> DataFrame:
    """One-based position of each row of a text scan, files in path order.

    ``scan`` must come straight from a file reader. A task reads a split front to back, so a
    row's place is the count of all earlier splits plus its place in its own.
    """
    marked = scan.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_split": F.col("_metadata.file_block_start"),
        "_seq": F.monotonically_increasing_id(),
    })
    splits = marked.groupBy("_file", "_split").agg(
        F.count("*").alias("_n"), F.min("_seq").alias("_first")
    )
    earlier = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place: Column = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    return (
        marked.join(_small(offsets), ["_file", "_split"])
        .withColumn(name, place.cast("bigint"))
        .drop("_file", "_split", "_seq", "_first", "_before")
    )
