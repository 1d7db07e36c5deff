"""Bounded labelled samples and held-out rows, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(parts: int, which: int) -> Column:
    """Rows whose crc32 of the id as text leaves ``which``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == which


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, held: Column, limit: int
) -> DataFrame:
    """doc_id, text, label of at most ``limit`` labelled rows that are not held out.

    The rows are those with the smallest id hash: a top-k over the labels, so small that it can be
    broadcast to the texts. Labels that contradict each other for one id count as their maximum;
    null ids and null labels are left out. Of several rows with one id the text with the smallest
    hash is taken (a null as the empty text), so ids that repeat on many rows cannot swell the sample.
    """
    order = F.xxhash64(F.lit(label), "doc_id")
    chosen = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label")
    ).orderBy(order, "doc_id").limit(limit)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("own")).join(
        F.broadcast(chosen), "doc_id"
    ).groupBy("doc_id").agg(F.min("own").alias("own"), F.max("label").alias("label")).select(
        "doc_id", F.col("own.text").alias("text"), "label"
    )
