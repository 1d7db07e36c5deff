"""Small shared pieces of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(name: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, null having none."""
    return F.coalesce(
        F.regexp_count(F.col(name), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)
    ).cast("bigint")


def by_batch(
    step: Callable[[pa.RecordBatch], Iterator[dict]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``step`` yields columns by name for parts of a batch."""
    def run(batches):
        for batch in batches:
            for columns in step(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                     for f, c in ((f, columns[f.name]) for f in schema)],
                    schema=schema,
                )
    return run
