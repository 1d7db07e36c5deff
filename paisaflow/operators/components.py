"""Connected parts of a table of links between two kinds of nodes, by contraction to the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.session import cut, forget


def connected(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any one orderable type to ``node``, ``part``: the smallest node it reaches.

    Each node points to the smallest node it sees; pointers are doubled and links carried over to the nodes
    pointed to, so that the links left shrink by a factor each round and long chains take logarithmic rounds.
    """
    open_links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    named = None
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        while True:
            ahead = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
            doubled = cut(up.join(ahead, "to").select("a", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            moved = not doubled.filter("moved").isEmpty()
            forget(up)
            up = doubled.drop("moved")
            if not moved:
                break
        up = cut(up)
        if named is None:
            named = up.select(F.col("a").alias("node"), F.col("to").alias("part"))
        else:
            named = named.join(up.select(F.col("a").alias("part"), "to"), "part", "left").select(
                "node", F.coalesce("to", "part").alias("part")
            )
        named = cut(named)
        to = lambda side: up.select(F.col("a").alias(side), F.col("to").alias(f"{side}_to"))
        carried = open_links.join(to("a"), "a").join(to("b"), "b").filter("a_to <> b_to").select(
            F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")
        ).distinct()
        open_links = cut(carried)
    if named is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("part")).limit(0)
    return named
