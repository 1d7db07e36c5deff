"""Shards of near-equal bytes, tokens and rows by vector bin packing.

Items to pack are groups of equal texts. A group that would fill a noticeable part of a shard is
an item of its own; the many small ones are hashed into a fixed number of parcels; a group larger
than a shard's fair part is split into pieces, as no placing of it whole could keep the shards
level. The number of items so has a bound that depends on the number of shards alone
(``parcels + dimensions * shards * SMALL`` and a few pieces), and only their summed vectors reach
the driver. Items are placed from the largest down: each goes to the shard whose residual
capacity has the highest dot product with the item's vector.

The law kept is ``bytes``: bytes weigh most in the product, and the last, smallest items level them.
Null text has no bytes of its own and lies with the empty texts. Null ``doc_id`` and repeated rows
are placed as any other: a large group is split by its rows' stored numbers, not by their ids. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import documents, n_words
from paisaflow.operators.numbering import rank_in_groups
from paisaflow.session import cut

SHARDS = 24
ROW_BYTES = 8
SMALL = 1_000          # a group under 1/SMALL of a shard goes into a parcel
PARCELS_PER_SHARD = 500
PIECES_PER_SHARD = 16
DIMENSIONS = ("size", "tokens", "n_rows")
WEIGHTS = (1.0, 0.1, 0.1)


def pack(items: np.ndarray, shards: int = SHARDS, weights=WEIGHTS) -> np.ndarray:
    """A shard for each row of ``items`` (one column per dimension), largest first in turn.

    Residuals are in parts of a fair share. They may fall under zero, so that every item has a
    place; ties go to the lowest shard.
    """
    fair = items.sum(axis=0) / shards
    part = items / np.where(fair > 0, fair, 1.0)
    residual = np.ones((shards, items.shape[1]))
    scale = np.asarray(weights)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-part.max(axis=1), kind="stable"):
        at = int(np.argmax(residual @ (part[i] * scale)))
        out[i] = at
        residual[at] -= part[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, tokens, the item and its shard for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        n_words().alias("tokens"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text).alias("group"), F.monotonically_increasing_id().alias("row"),
    ))
    groups = cut(rows.groupBy("group").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")
    ))
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    fair = {d: max(1.0, (total[d] or 0) / shards) for d in DIMENSIONS}
    part = F.greatest(*[F.col(d) / F.lit(fair[d]) for d in DIMENSIONS])
    parcel = F.concat(F.lit("parcel "), F.pmod(F.xxhash64("group"), F.lit(shards * PARCELS_PER_SHARD)))
    # few groups are not small: they and their pieces have a bound, the rest needs no look-up
    large = cut(groups.filter(part >= 1 / SMALL).select(
        "group", F.when(part > 1, F.ceil(part * PIECES_PER_SHARD)).otherwise(1).cast("long").alias("pieces")
    ))
    named = rows.join(F.broadcast(large), "group", "left").withColumn(
        "item",
        F.when(F.col("pieces").isNull(), parcel).when(F.col("pieces") == 1, F.col("group"))
        .otherwise(F.concat_ws(" ", "group", F.pmod(F.xxhash64("row"), F.col("pieces")))),
    )
    items = named.groupBy("item").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")
    ).toPandas().sort_values("item", ignore_index=True)
    placed = pd.DataFrame({
        "item": items["item"].astype(str),
        "shard": pack(items[list(DIMENSIONS)].to_numpy(float), shards).astype("int32"),
    })
    table = docs.sparkSession.createDataFrame(placed, "item string, shard int")
    return named.join(F.broadcast(table), "item").select(
        "doc_id", "size", "tokens", "text_crc32", "group", "shard"
    )


def numbered(placed: DataFrame) -> DataFrame:
    """With ``slot``: gapless from 0 within the shard, by a range partitioning of all rows."""
    return rank_in_groups(placed, ["shard"], ["doc_id", "group"], "slot")


def sharded(docs: DataFrame) -> DataFrame:
    """Every row with its shard and slot, and the law that holds."""
    return numbered(shard(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
