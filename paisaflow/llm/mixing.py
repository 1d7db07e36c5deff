"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

The documents of a source, in shuffled order, are laid end to end on an axis of words; the axis
is cut into blocks of equal size, and a second pass over the source follows the first. A van der
Corput sequence gives the schedule: point ``k`` of ``2**m`` is the bit reversal of ``k``, and the
cumulative block counts of the sources, laid over the points, say which source the slot takes
from. The ``j``-th slot of a source takes its ``j``-th block. Any stretch of the schedule so holds
every source close to its share, and no random state is kept.

- Targets: the budget is shared by weight; a source's target stops at ``max_repeats`` times its
  size and the rest is shared again by weight (a water level over the sources, found by ranking).
- Offsets on the axis are running sums over buckets of the shuffle key, so a source with a third
  of all rows spreads over many tasks. The rank of a slot within its source is a formula on the
  bits of its number, not a sort.

Null text or no words: size 0, taken 0. Null source: a source of its own, after all others.
Null ``doc_id`` or repeated rows: each row has its own place on the axis. An empty table gives an
empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paisaflow.llm.frames import documents, n_words
from paisaflow.session import cut

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 256
SLOTS_PER_ROW = 65_536
ROWS_PER_BUCKET = 5_000


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """Per source its size and target; one row per source is all that windows here see."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ).withColumn("ratio", F.col("source_size") / F.col("weight"))
    up_to = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    everything = Window.partitionBy()
    levels = ranked.withColumns({
        "total": F.sum("source_size").over(everything),
        "all_weight": F.sum("weight").over(everything),
        "size_to": F.sum("source_size").over(up_to),
        "weight_to": F.sum("weight").over(up_to),
    }).withColumns({
        # the level if all with a smaller ratio stop at their limit
        "before": (
            F.lit(budget) * F.col("total")
            - max_repeats * (F.col("size_to") - F.col("source_size"))
        ) / (F.col("all_weight") - F.col("weight_to") + F.col("weight")),
    }).withColumn("full", F.col("before") * F.col("weight") >= max_repeats * F.col("source_size"))
    # sources stop in the order of their ratio; the first that does not gives the level of all
    # others, and it is the highest: those after it are reckoned as if it had stopped
    level = F.max(F.when(~F.col("full"), F.col("before"))).over(everything)
    return levels.withColumn("common", level).select(
        "source", "source_size",
        F.when(F.col("full"), max_repeats * F.col("source_size").cast("double"))
        .otherwise(F.col("common") * F.col("weight")).alias("target"),
    )


def slots(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The schedule: ``slot`` (order of use), ``source``, ``rank`` of the slot in its source."""
    blocks = F.ceil(F.floor("target") / F.lit(block)).cast("bigint")
    counted = targets.withColumn("blocks", blocks).filter("blocks > 0")
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    laid = counted.withColumns({
        "low": F.coalesce(F.sum("blocks").over(before), F.lit(0)),
        "bits": F.greatest(F.lit(0), F.ceil(
            F.log2(F.sum("blocks").over(Window.partitionBy()).cast("double"))
        )).cast("int"),
    }).withColumn("high", F.col("low") + F.col("blocks"))
    parts = laid.select(
        "source", "low", "high", "bits",
        F.explode(F.sequence("low", F.col("high") - 1, F.lit(SLOTS_PER_ROW).cast("bigint"))).alias("from"),
    ).repartition("source", "from")
    points = parts.select(
        "source", "low", "high", "bits",
        F.explode(F.sequence(
            "from", F.least(F.col("from") + SLOTS_PER_ROW, F.col("high")) - 1
        )).alias("point"),
    )

    @F.pandas_udf("slot bigint, rank bigint")
    def numbered(point: pd.Series, low: pd.Series, high: pd.Series, bits: pd.Series) -> pd.DataFrame:
        return schedule_rank(*(x.to_numpy(np.int64) for x in (point, low, high, bits)))

    return points.select("source", numbered("point", "low", "high", "bits").alias("n")).select(
        "source", "n.slot", "n.rank"
    )


def schedule_rank(point, low, high, bits) -> pd.DataFrame:
    """Slot number of each point and its rank among the slots of the points in [low, high).

    The slot is the bit reversal of the point. A slot ``j`` before slot ``k`` agrees with it
    above some set bit ``t`` of ``k`` and has 0 at ``t``; the reversal of ``j`` is so fixed in its
    low ``bits - t`` bits and free above, and how many such values lie in [low, high) is a division.
    """
    slot, rank = np.zeros_like(point), np.zeros_like(point)
    for m in np.unique(bits):
        at = bits == m
        p, lo, hi = point[at], low[at], high[at]
        k = np.zeros_like(p)
        for b in range(int(m)):
            k |= ((p >> b) & 1) << (int(m) - 1 - b)
        r = np.zeros_like(p)
        for t in range(int(m)):
            # bit t of the slot is bit m-1-t of the point; the slot's higher bits are the point's lower
            c = int(m) - t
            fixed = p & ((1 << (c - 1)) - 1)

            def below(bound):
                return np.maximum(0, (bound - fixed + (1 << c) - 1) >> c)

            r += np.where((k >> t) & 1 == 1, below(hi) - below(lo), 0)
        slot[at], rank[at] = k, r
    return pd.DataFrame({"slot": slot, "rank": rank})


def shuffle_key() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat(name, F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle key, stored: all that the mix needs of a row."""
    return cut(docs.select("doc_id", "source", n_words().alias("size"), shuffle_key().alias("key")))


def on_axis(rows: DataFrame) -> DataFrame:
    """``rows`` with ``offset``: words of the source before the row, in the order of ``key``."""
    digits = 1
    many = rows.count()
    while many > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    put = rows.withColumn("bucket", F.substring("key", 1, digits))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0).cast("bigint")
    before = put.groupBy("source", "bucket").agg(F.sum("size").alias("here")).select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("here").over(earlier), zero).alias("before"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return put.withColumn("inside", F.coalesce(F.sum("size").over(inside), zero)).join(
        before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))
    ).select(*rows.columns, (F.col("before") + F.col("inside")).alias("offset"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """The rows on their axes with their source's figures, and the pieces of the mix.

    Pieces: ``slot``, ``source``, ``offset`` (of the row on the axis), ``from_word``, ``words``.
    """
    rows = sized_rows(docs)
    targets = cut(source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_repeats
    ))
    own = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    placed = cut(on_axis(rows).join(own, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source"))
    start = F.col("epoch") * F.col("source_size") + F.col("offset")
    stop = F.least(start + F.col("size"), F.floor("target"))
    pieces = placed.filter("size > 0").select(
        "source", "offset", "size", "source_size", "target",
        F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"),
    ).select("source", "offset", start.alias("start"), stop.alias("stop")).filter("start < stop").select(
        "*", F.explode(F.sequence(
            F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
        )).alias("block"),
    ).select(
        "source", "offset", "block",
        (F.greatest("start", F.col("block") * block) - F.col("start")).alias("from_word"),
        (F.least("stop", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
        .alias("words"),
    )
    # stored, so that the join is planned with its true size and not that of the few sources
    plan = cut(slots(targets, block)).select(F.col("source").alias("s_source"), "slot", "rank")
    taken = pieces.join(
        plan, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("rank"))
    ).select("slot", "source", "offset", "from_word", "words")
    return placed, taken


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per row how many words the mix takes of it, repeats counted."""
    sums = pieces.groupBy("source", "offset").agg(F.sum("words").alias("taken")).select(
        F.col("source").alias("p_source"), F.col("offset").alias("p_offset"), "taken"
    )
    # equal offsets of one source differ in that all but one have no words
    return placed.join(
        sums,
        F.col("source").eqNullSafe(F.col("p_source")) & (F.col("offset") == F.col("p_offset"))
        & (F.col("size") > 0), "left",
    ).drop("p_source", "p_offset").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` repeated as the mix takes them, with all their columns.

    The one document of a source that the mix ends in counts as taken. Rows that repeat
    ``doc_id``, source and text pool their copies.
    """
    placed, pieces = mix(docs, **settings)
    copies = taken_words(placed, pieces).filter("taken > 0").groupBy("doc_id", "source", "key").agg(
        F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__copies")
    ).select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__key"), "__copies"
    )
    one = docs.withColumn("__own", shuffle_key()).dropDuplicates(["doc_id", "source", "__own"])
    return one.join(
        copies,
        F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__own") == F.col("__key")),
    ).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    placed, pieces = mix(documents(spark, sf_dir))
    return taken_words(placed, pieces).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = f"""
with sized as (
  select doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(text, '')) as key
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighed as (
  select *, [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last)) - 1) % 3 + 1] as weight
  from sources
), levels as (
  select *,
    ({BUDGET}::double * (sum(source_size) over ())
      - {MAX_REPEATS} * ((sum(source_size) over (order by source_size / weight, source nulls last
          rows unbounded preceding)) - source_size))
    / ((sum(weight) over ()) - (sum(weight) over (order by source_size / weight, source nulls last
          rows unbounded preceding)) + weight) as before
  from weighed
), marked as (
  select *, before * weight >= {MAX_REPEATS} * source_size as is_full from levels
), targets as (
  select source, source_size,
    case when is_full then {MAX_REPEATS} * cast(source_size as double)
      else (max(case when not is_full then before end) over ()) * weight end as target
  from marked
), axis as (
  select d.doc_id, d.size, t.source_size, t.target, cast(floor(t.target) as bigint) as goal,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id
      rows between unbounded preceding and 1 preceding), 0) as shift
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(greatest(0, least(shift + size, goal) - shift)
    + greatest(0, least(source_size + shift + size, goal) - source_size - shift) as bigint) as taken
from axis
"""
