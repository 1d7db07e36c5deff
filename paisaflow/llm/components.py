"""Connected components of a link table, as star contractions over Spark joins.

Each round moves every link towards the smallest neighbour (large star, then small star) until
nothing changes; nothing but a count and a checksum of the links reaches the driver. A node with
very many neighbours is an aggregation with map-side combine and a join that adaptive execution
can split, never a list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.session import cut

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (``a``, ``b``) of longs to ``node``, ``root``: the smallest node it reaches.

    Nodes without links, and roots themselves, are not in the result.
    """
    now = cut(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = cut(_small_star(_large_star(now)))
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
