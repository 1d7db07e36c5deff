"""Exact duplicates: static binary-fuse filters over a snapshot screen a new batch.

A snapshot never changes, so its digests get static filters, one per bucket of the digest: a
bucket holds a bounded number of distinct digests, and a filter about nine bits for each. The
distinct digests of a new batch are screened against them. What a filter rejects is certainly
new and is grouped within the batch alone; what it lets through is joined with the snapshot's
exact buckets, where length and SHA-256 of the normalised bytes must agree. Copies collapse
before every shuffle, so a text with a third of all rows is one row per task.

Null text counts as empty. A null ``doc_id`` stays only if no other row of its group has one.
Rows that repeat both ``doc_id`` and text are one document: both say the same. An empty table, or
an empty snapshot or batch, gives the empty or the other part's result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.llm.frames import documents
from paisaflow.llm.words import mix
from paisaflow.session import cut

KEYS_PER_FILTER = 32_768
FILTER_SCHEMA = "bucket long, seed long, segment long, span long, table binary"


# ---- the filter -------------------------------------------------------------------------------

def _slots(keys: np.ndarray, seed: int, segment: int, span: int):
    """Three slots in neighbouring segments, and an 8-bit fingerprint, per key."""
    h = mix(keys ^ np.uint64(seed))
    first = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    print_ = (h ^ (h >> np.uint64(32))).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), print_


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A three-wise binary-fuse filter over distinct 64-bit keys: seed, segment, span, table."""
    n = len(keys)
    segment = 1 << max(2, min(18, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    count = max(1, math.ceil(max(n, 1) * factor / segment) - 2)
    for seed in range(1, 1000):
        span = segment * (count + (seed >> 3))
        at, prints = _slots(keys, seed * 0x9E3779B9, segment, span)
        size = span + 2 * segment
        load = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(n))
        rounds, left = [], n
        while left:
            single = np.flatnonzero(load == 1)
            key = who[single]
            key, pick = np.unique(key, return_index=True)
            if not len(key):
                break
            rounds.append((key, single[pick]))
            left -= len(key)
            for row in at[:, key]:
                np.subtract.at(load, row, 1)
                np.bitwise_xor.at(who, row, key)
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(rounds):
            table[slot] = 0
            a, b, c = at[:, key]
            table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
        return seed * 0x9E3779B9, segment, span, table.tobytes()
    raise RuntimeError("no seed peels these keys; are they distinct?")


def filter_contains(keys: np.ndarray, seed: int, segment: int, span: int, table: bytes) -> np.ndarray:
    at, prints = _slots(keys, seed, segment, span)
    cells = np.frombuffer(table, np.uint8)
    return cells[at[0]] ^ cells[at[1]] ^ cells[at[2]] == prints


# ---- the operator -----------------------------------------------------------------------------

def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest columns and length of each row, stored."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    return cut(docs.select("doc_id", plain.alias("plain"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars")).select(
        "doc_id", F.sha2("plain", 256).alias("text_sha256"), F.xxhash64("plain").alias("short"),
        F.octet_length("plain").alias("n_bytes"), "n_chars",
    ))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: its size and the row that stays (longest text, then smallest id)."""
    return rows.groupBy("text_sha256", "short", "n_bytes").agg(
        F.max(F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("rev"))).alias("best"),
        F.count("*").alias("n"),
    )


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """The snapshot's filters, one row per bucket of its digests."""
    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(part["short"].to_numpy(np.int64)).view(np.uint64)
        return pd.DataFrame([(key[0], *build_filter(keys))], columns=[
            "bucket", "seed", "segment", "span", "table"])

    return groups.select(bucket_of(buckets).alias("bucket"), "short").groupBy("bucket").applyInPandas(
        build, FILTER_SCHEMA
    )


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("short"), F.lit(buckets)).cast("long")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``incoming`` groups with ``maybe``: false if the snapshot certainly lacks the digest."""
    def look(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(part), bool)
        if len(found) and len(part):
            f = found.iloc[0]
            maybe = filter_contains(
                part["short"].to_numpy(np.int64).view(np.uint64), int(f.seed), int(f.segment),
                int(f.span), f.table,
            )
        return pd.DataFrame({"text_sha256": part["text_sha256"], "maybe": maybe})

    keyed = incoming.select(bucket_of(buckets).alias("bucket"), "short", "text_sha256")
    told = keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(
        look, "text_sha256 string, maybe boolean"
    )
    return incoming.join(told, "text_sha256")


def merge_batch(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups over snapshot and batch rows (as from ``digests``), by way of the filters."""
    old, new = cut(groups_of(snapshot)), cut(groups_of(batch))
    buckets = max(1, -(-max(old.count(), new.count()) // KEYS_PER_FILTER))
    screened = cut(screen(new, cut(build_filters(old, buckets)), buckets))
    exact = old.select(
        "short", "text_sha256", "n_bytes", F.col("best").alias("o_best"), F.col("n").alias("o_n")
    )
    checked = cut(screened.filter("maybe").join(exact, ["short", "text_sha256", "n_bytes"], "left"))
    fresh = screened.filter("not maybe").select("text_sha256", "best", "n").unionByName(
        checked.filter("o_n is null").select("text_sha256", "best", "n")
    )
    known = checked.filter("o_n is not null").select(
        "text_sha256", F.greatest("best", "o_best").alias("m_best"),
        (F.col("n") + F.col("o_n")).alias("m_n"),
    )
    return old.join(known, "text_sha256", "left").select(
        "text_sha256", F.coalesce("m_best", "best").alias("best"), F.coalesce("m_n", "n").alias("n")
    ).unionByName(fresh)


def dedup(docs: DataFrame, is_new: Column) -> DataFrame:
    """Each row with its group; ``is_new`` tells the batch from the snapshot."""
    rows = digests(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    new = F.coalesce(is_new, F.lit(True))
    groups = merge_batch(rows.filter(~new), rows.filter(new))
    return rows.join(groups, "text_sha256").select(
        "doc_id", F.bitwise_not("best.rev").alias("keep_id"), F.col("n").alias("group_size"),
        (F.bitwise_not("doc_id").eqNullSafe(F.col("best.rev")) & (F.col("n_chars") == F.col("best.n_chars")))
        .alias("kept"), "text_sha256",
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: those with an odd id hash come as a new batch onto a snapshot of the rest."""
    return dedup(documents(spark, sf_dir), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)


OP6_SQL = """
with plain as (
  select doc_id, length(coalesce(text, '')) as n_chars,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256
  from documents
), ranked as (
  select *, first_value(doc_id) over w as keep_id,
    count(*) over (partition by text_sha256) as group_size
  from plain window w as (partition by text_sha256 order by n_chars desc, doc_id)
)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256
from ranked
"""
