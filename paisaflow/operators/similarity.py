"""Record index and cosine search over vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from paisaflow.functions.text import record_text
from paisaflow.functions.vectors import dot, l2_normalize

Embedder = Callable[[DataFrame], DataFrame]
#: a query of at most so many entries that are not zero is scored by those alone
SPARSE = 64


def tfidf_model(texts: DataFrame, features: int = 256) -> PipelineModel:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="weights"),
        Normalizer(inputCol="weights", outputCol="vector"),
    ]).fit(texts)


def tfidf_embedder(model: PipelineModel) -> Embedder:
    """An embedder: adds a unit-length ``embedding`` to a frame with ``text``."""

    def embed(df: DataFrame) -> DataFrame:
        made = model.transform(df)
        return made.select(
            *df.columns, vector_to_array("vector", "float32").alias("embedding")
        )

    return embed


def index_texts(records: DataFrame) -> DataFrame:
    return records.select("txn_id", record_text().alias("text"))


def missing_from_index(texts: DataFrame, index: DataFrame | None) -> DataFrame:
    if index is None:
        return texts
    return texts.join(index.select("txn_id"), "txn_id", "left_anti")


def changed_in_index(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Texts that have no entry with the same content: regenerated data is embedded anew."""
    key = ["txn_id", "text_hash"]
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    held = index.select("txn_id", F.xxhash64("text").alias("text_hash"))
    return hashed.join(held, key, "left_anti").drop("text_hash")


def extend_index(records: DataFrame, index: DataFrame | None, embed: Embedder) -> DataFrame:
    """Only the new index rows, to be appended: records without an entry, embedded."""
    return embed(missing_from_index(index_texts(records), index)).select(
        "txn_id", "text", "embedding"
    )


def normalize_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, l2_normalize(F.col(column)))


def score(vectors: DataFrame, query: list[float]) -> Column:
    """The dot product of ``embedding`` and ``query``, bit for bit that of ``dot``.

    Terms of a zero in the query add nothing if all numbers are finite, so a query of few other entries reads only
    those, as compiled code; vectors of another length, with nulls or without finite numbers go the long way.
    """
    v, target = F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])
    entries = [(i, float(x)) for i, x in enumerate(query) if x != 0]
    number = vectors.schema["embedding"].dataType.elementType
    if len(entries) > SPARSE or not isinstance(number, (T.FloatType, T.DoubleType)):
        return dot(v, target)
    infinite = F.lit(float("inf")).cast(number)
    # array_contains is null where a null is among the numbers, and NaN is the largest
    plain = (F.size(v) == len(query)) & ~F.array_contains(v, infinite) & ~F.isnan(F.array_max(v)) & (F.array_min(v) > -infinite)
    few = F.lit(0.0)
    for i, x in entries:
        few = few + F.get(v, F.lit(i)).cast("double") * F.lit(x)
    return F.when(plain, few).otherwise(dot(v, target))


def top_k(
    vectors: DataFrame, query: list[float], k: int = 15, id_column: str = "txn_id"
) -> DataFrame:
    """Exact cosine top-k of unit vectors: each task keeps k rows, then k of those."""
    return (
        vectors.select(id_column, score(vectors, query).alias("score"))
        .orderBy(F.desc("score"), id_column).limit(k)
    )


def top_k_many(
    vectors: DataFrame, queries: list[tuple[str, list[float]]], k: int = 15,
    id_column: str = "txn_id",
) -> DataFrame:
    """Top-k for a handful of queries in one pass over the vectors.

    Spark applies the rank limit in every task before the shuffle (WindowGroupLimit), so k rows
    per query and task move, whatever the number of vectors.
    """
    scored = vectors.select(id_column, F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("query_id"),
            score(vectors, q).alias("score"),
        ) for name, q in queries
    ])).alias("s")).select(id_column, "s.*")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def semantic_search(
    question_vector: list[float], records: DataFrame, index: DataFrame, k: int = 15
) -> DataFrame:
    """The records behind the best k index entries, best first."""
    hits = F.broadcast(top_k(index, question_vector, k))  # k rows
    return records.join(hits, "txn_id").orderBy(F.desc("score"), "txn_id")
