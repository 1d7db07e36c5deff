"""Links within buckets of similar sets, without making all pairs of a bucket.

Sets meet in buckets by shared keys; wanted are links enough to give the components of
``100 * intersection >= percent * union``. In a bucket one member is the hub H. All others are compared with
it, which is linear. Write X' for the difference of X and H, ``theta = (100 - percent) / (100 + percent)``,
and count tokens: A and B link exactly if ``|A'| + |B'| - 2 |A' & B'| <= theta (|A| + |B|)``. A token that only
B has among all candidates cannot be in A', so ``|A' & B'|`` is at most B's difference without those. So each
member gets two numbers

    D = |X'| - theta |X|          R = 2 (|X'| - alone) - |X'| + theta |X|

and a pair can link only if ``D_A <= R_B`` and ``D_B <= R_A``. X links with H exactly if ``D <= theta |H|``; two
members that both do are in one component and need no comparison.

What may still link has ``(D_A + D_B) / 2`` difference tokens in common at least. So differences are indexed by
a prefix again: rarest first, ``(R - D) / 2 + 1`` tokens with the least D a partner has, few where the margin
is small. Sets that meet under such a token, in different components and within the bounds, are compared in pairs.
Where these buckets are large again, which takes a group within the group, they first have a round
with hubs of their own, up to ``rounds``. Nothing that may link is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.llm.components import components
from paisaflow.session import cut, forget

SALTS = 16
ROUNDS = 4
PAIRS_PER_ROW = 64
c = F.col


def distinct_buckets(members: DataFrame) -> DataFrame:
    """One key of each set of two or more members (``key``, ``cid``), told by number and two xors of hashes."""
    same = ["size", "one", "two"]
    return members.join(members.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("cid")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit(7), "cid")).alias("two"),
    ).filter("size > 1").groupBy(*same).agg(F.min("key").alias("key")).select("key"), "key")


def _salted(frame: DataFrame, by: str) -> DataFrame:
    return frame.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _copied(frame: DataFrame) -> DataFrame:
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def _with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", c("cid"))
    return members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "comp", F.coalesce("root", "cid")
    ).drop("root")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``n_a``, ``n_b`` and ``common``, the number of tokens both have."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(
            c("cid").alias(side), c("n").alias(f"n_{side}"), c("tokens").alias(f"tokens_{side}")
        ), side)
    return pairs.select(
        "a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("common")
    )


def linked(percent: int) -> Column:
    return (100 * c("common") >= percent * (c("n_a") + c("n_b") - c("common"))) & (c("common") > 0)


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Keys of the next round: a prefix of each member's difference to its hub, as any order that all members of a
    hub share allows: tokens the hub lacks, rarest of all first, then the hub's own, missing in the fewest members first.
    Only the prefix becomes rows.

    Tokens that only the hub has are missing in all others and listed nowhere. A bucket in which they
    alone may be enough of a common difference goes on as a whole, without this hub.
    """
    tokens = sets.select("cid", "tokens")
    whole = members.filter("as_whole").select(F.xxhash64("hub").alias("key"), "cid", "n", "alone", "d", "r", "apart", "comp")
    apart = cut(members.filter("not as_whole").join(tokens, "cid").join(
        tokens.select(c("cid").alias("hub"), c("tokens").alias("hub_tokens")), "hub"
    ).select(
        "hub", "cid", "n", "alone", "d", "r", "apart", "comp", "prefix",
        F.array_except("tokens", "hub_tokens").alias("added"), F.array_except("hub_tokens", "tokens").alias("missing"),
    ))
    # one order of the hub's own tokens for all its members, as long as the hub's set at most
    order = apart.select("hub", F.explode("missing").alias("token")).groupBy("hub", "token").agg(
        F.count("*").alias("df")
    ).groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o")).select(
        "hub", c("o.token").alias("in_order")
    )
    missing = F.array_intersect(F.coalesce("in_order", "missing"), "missing")
    keyed = apart.join(order, "hub", "left").select(
        "hub", "cid", "n", "alone", "d", "r", "apart", "comp",
        F.explode(F.slice(F.concat("added", missing), F.lit(1), c("prefix").cast("int"))).alias("token"),
    ).select(F.xxhash64("hub", "token").alias("key"), "cid", "n", "alone", "d", "r", "apart", "comp")
    found = cut(whole.unionByName(keyed))
    forget(apart)
    return found


def resolve(
    members: DataFrame, sets: DataFrame, percent: int, rounds: int = ROUNDS, found: Sequence[DataFrame] = (),
    possible: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """Components (``node``, ``root``) of all sets that link with another; None if none do.

    ``members``: key, cid, n, alone (how many tokens no other candidate has). ``sets``: cid, n, tokens (at least
    those that another candidate has). ``found``: links known before. ``possible``: leaves out pairs (a, b) that need
    no comparison.
    """
    near, far = 100 - percent, 100 + percent
    members, found, labels = cut(distinct_buckets(members)), list(found), None
    for round_number in range(rounds):
        if members.isEmpty():
            break
        hubs = members.groupBy("key").agg(F.min(F.struct("alone", "cid", "n")).alias("hub")).select(
            "key", c("hub.cid").alias("hub"), c("hub.n").alias("n_hub"), c("hub.alone").alias("alone_hub")
        )
        # buckets with one hub are one bucket
        rows = cut(_salted(members, "cid").join(_copied(hubs), ["key", "salt"]).filter("cid <> hub").select(
            "hub", "n_hub", "alone_hub", "cid", "n", "alone"
        ).distinct())
        seen = cut(compared(rows.select(c("cid").alias("a"), c("hub").alias("b")), sets))
        found.append(cut(seen.filter(linked(percent)).select("a", "b")))
        differ = c("n") + c("n_hub") - 2 * c("common")
        placed = cut(rows.join(seen.select(c("a").alias("cid"), c("b").alias("hub"), "common"), ["cid", "hub"]).select(
            "hub", "alone_hub", "cid", "n", "alone", (far * differ - near * c("n")).alias("d"),
            (far * (differ - 2 * c("alone")) + near * c("n")).alias("r"),
            (far * differ > near * (c("n") + c("n_hub"))).alias("apart"),
        ))
        forget(members, rows, seen)
        limits = placed.groupBy("hub").agg(
            F.min(F.when(c("apart"), c("d"))).alias("least_apart"), F.max("r").alias("most_r"),
            F.max(F.when(c("apart"), c("r"))).alias("most_r_apart"), F.min("d").alias("least_d"),
        ).filter("least_apart is not null")
        # the least a partner's d may be
        partner = F.when(c("apart"), c("least_d")).otherwise(c("least_apart"))
        open_rows = cut(_salted(placed, "cid").join(_copied(limits), ["hub", "salt"]).filter(
            (c("d") <= F.when(c("apart"), c("most_r")).otherwise(c("most_r_apart"))) & (c("r") >= partner)
        ).select(
            "hub", "cid", "n", "alone", "d", "r", "apart", (F.floor((c("r") - partner) / (2 * far)) + 1).alias("prefix"),
            (c("least_apart") + c("least_d") <= 2 * far * c("alone_hub")).alias("as_whole"),
        ))
        forget(placed)
        if open_rows.isEmpty():
            break
        labels = components(reduce(DataFrame.unionByName, found))
        known = _with_component(open_rows, labels)
        mixed = known.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        keyed = _differences(known.join(mixed.select("hub"), "hub", "left_semi"), sets)
        forget(open_rows)
        size = keyed.groupBy("key").count().agg(
            F.sum("count").alias("rows"), F.sum(c("count") * (c("count") - 1) / 2).alias("pairs")
        ).first()
        if size["rows"] and size["pairs"] > PAIRS_PER_ROW * size["rows"] and round_number < rounds - 1:
            members = cut(distinct_buckets(keyed.select("key", "cid", "n", "alone")))
            continue
        facts = ("cid", "d", "r", "apart", "comp")
        one = keyed.select("key", *[c(x).alias(f"x_{x}") for x in facts])
        two = keyed.select("key", *[c(x).alias(f"y_{x}") for x in facts])
        pairs = one.join(two, "key").filter(
            (c("x_cid") < c("y_cid")) & (c("x_comp") != c("y_comp")) & (c("x_apart") | c("y_apart"))
            & (c("x_d") <= c("y_r")) & (c("y_d") <= c("x_r"))
        ).select(c("x_cid").alias("a"), c("y_cid").alias("b")).distinct()
        if possible is not None:
            pairs = possible(pairs)
        found.append(cut(compared(pairs, sets).filter(linked(percent)).select("a", "b")))
        break
    if not found:
        return None
    links = reduce(DataFrame.unionByName, found)
    return None if links.isEmpty() else components(links)
