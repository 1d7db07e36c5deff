"""Quality by random-indexing word vectors and a small calibrated network.

Every word has a sparse random index vector that follows from its hash. A word's vector is the sum
of the index vectors of its neighbours over all documents, of length one; words share
``1 << WORD_BITS`` hashed places, so the table has a fixed size: each task sums its own, and Spark
adds them by place. Beside each word stands a word for its
shape (case, digits, marks at its end, length, the word before repeated), whose index vector is
pooled as well: junk differs from prose in shapes more than in words. A text is the mean over its
words of both. A network of one hidden layer gives a logit, and a temperature, fitted on rows the
network has not seen, makes it a probability.

The network is fitted on at most ``SAMPLE_ROWS`` labelled rows (a documented bound) on the driver and
sent with the table to the tasks that score every row; no text but the sample's is shuffled. Null or empty texts pool to zeros and get
the network's answer to that. Null ids are scored too. Repeated rows score alike. Without any
labelled row every score is 1, so that a filter drops nothing. Only ``doc_id`` and ``text`` are read;
``doc_id`` decides who is held out and is no input of a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.llm.labelled import held_out, training_sample
from paisaflow.llm.words import Chunk, chunks, mix, words

SAMPLE_ROWS = 6_000
WORD_BITS, DIMENSIONS, NONZERO, REACH = 15, 48, 4, 2
SHAPE_BITS, SHAPE_DIMENSIONS = 9, 48
HIDDEN = 32
BLOCK_WORDS = 50_000
THRESHOLD = 0.3


class Network(NamedTuple):
    vectors: np.ndarray       # word place -> vector
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def index_vectors(keys: np.ndarray, dimensions: int, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Per key the places of its non-zero entries and their signs."""
    at, sign = [], []
    for k in range(nonzero):
        h = mix(keys.astype(np.uint64) * np.uint64(2 * nonzero + 1) + np.uint64(k + 1))
        at.append((h % np.uint64(dimensions)).astype(np.int64))
        sign.append(np.where(h >> np.uint64(63), 1.0, -1.0))
    return np.stack(at, axis=1), np.stack(sign, axis=1)


def _shape_table() -> np.ndarray:
    at, sign = index_vectors(np.arange(1 << SHAPE_BITS, dtype=np.uint64), SHAPE_DIMENSIONS)
    table = np.zeros((1 << SHAPE_BITS, SHAPE_DIMENSIONS))
    for k in range(at.shape[1]):
        np.add.at(table, (np.arange(len(at)), at[:, k]), sign[:, k])
    return table


SHAPES = _shape_table()
_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[ord("A"):ord("Z") + 1] = 1
_LOWER[ord("a"):ord("z") + 1] = 1
_DIGIT[ord("0"):ord("9") + 1] = 1
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = 1


def text_words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of a chunk: its text, its hashed place and its shape."""
    found = words(chunk, fold=True)
    owner = np.repeat(np.arange(chunk.rows), np.diff(found.first))
    place = (found.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    if not len(place):
        return owner, place, place
    size = found.end - found.start
    count = [np.append(0, np.cumsum(t[chunk.data]))  for t in (_UPPER, _LOWER, _DIGIT, _MARK)]
    upper, lower, digit, mark = (c[found.end] - c[found.start] for c in count)
    tail = _MARK[chunk.data[found.end - 1]] + _MARK[chunk.data[np.maximum(found.end - 2, found.start)]] * (size > 1)
    again = np.zeros(len(place), np.int64)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (owner[1:] == owner[:-1])
    shape = (
        ((upper > 1) & (lower == 0)) * 1 + (digit > 0) * 2 + (tail > 1) * 4 + (mark == size) * 8
        + again * 16 + (mark > tail) * 32 + np.minimum(size // 8, 3) * 64 + (tail > 0) * 256
    )
    return owner, place, shape.astype(np.int64)


def add_neighbours(table: np.ndarray, index, owner: np.ndarray, place: np.ndarray) -> None:
    """Add to ``table`` (flat) the index vectors of each word's neighbours; words of one text only."""
    at, sign = index
    for reach in range(1, REACH + 1):
        for lo in range(0, len(place) - reach, BLOCK_WORDS):
            hi = min(lo + BLOCK_WORDS, len(place) - reach)
            near = owner[lo + reach:hi + reach] == owner[lo:hi]
            left, right = place[lo:hi][near], place[lo + reach:hi + reach][near]
            for a, b in ((right, left), (left, right)):
                for k in range(NONZERO):
                    np.add.at(table, a * DIMENSIONS + at[b, k], sign[b, k])


_SUMS = pa.schema([("place", pa.int64()), *[(f"v{k}", pa.int64()) for k in range(DIMENSIONS)]])


def _partial_sums(batches):
    index = index_vectors(np.arange(1 << WORD_BITS, dtype=np.uint64) + np.uint64(1 << 40), DIMENSIONS)
    table = np.zeros((1 << WORD_BITS) * DIMENSIONS)
    for batch in batches:
        for chunk in chunks(batch.column("text")):
            owner, place, _ = text_words(chunk)
            add_neighbours(table, index, owner, place)
    table = table.reshape(-1, DIMENSIONS).astype(np.int64)
    live = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(live), *[pa.array(table[live, k]) for k in range(DIMENSIONS)]], schema=_SUMS
    )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Sums of the neighbours' index vectors over all texts, each of length one.

    They are sums of whole numbers, so no order of tasks can change them.
    """
    ddl = ", ".join(f"{name} long" for name in _SUMS.names)
    found = docs.select("text").mapInArrow(_partial_sums, ddl).groupBy("place").agg(
        *[F.sum(name).alias(name) for name in _SUMS.names[1:]]
    ).toArrow()
    table = np.zeros((1 << WORD_BITS, DIMENSIONS))
    place = found.column("place").to_numpy()
    for k, name in enumerate(_SUMS.names[1:]):
        table[place, k] = found.column(name).to_numpy()
    size = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(size > 0, size, 1.0)).astype(np.float32)


def pooled(vectors: np.ndarray, rows: int, owner: np.ndarray, place: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Per text the mean of its words' vectors and of its shapes' index vectors.

    ``owner`` is sorted; words are taken in blocks, as a vector per word is many times its text.
    """
    n = np.bincount(owner, minlength=rows)
    out = np.zeros((rows, DIMENSIONS + SHAPE_DIMENSIONS))
    for lo in range(0, len(owner), BLOCK_WORDS):
        own = owner[lo:lo + BLOCK_WORDS]
        texts, begin = np.unique(own, return_index=True)
        out[texts, :DIMENSIONS] += np.add.reduceat(vectors[place[lo:lo + BLOCK_WORDS]], begin, axis=0)
        first = own[0]
        kinds = np.bincount(
            (own - first) * len(SHAPES) + shape[lo:lo + BLOCK_WORDS],
            minlength=(own[-1] - first + 1) * len(SHAPES),
        ).reshape(-1, len(SHAPES))
        out[first:own[-1] + 1, DIMENSIONS:] += kinds @ SHAPES
    return out / np.maximum(n, 1)[:, None]


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum((x - net.mean) / net.scale @ net.w1 + net.b1, 0)
    return hidden @ net.w2 + net.b2


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, passes: int = 60, seed: int = 5) -> Network:
    """Adam on four rows of five; the fifth gives the temperature by a one-dimensional search."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    cut = max(1, len(y) // 5) if len(y) > 20 else 0
    probe, train = order[:cut], order[cut:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    x = (x - mean) / scale
    p = [
        random.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1),
    ]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
    step = 0
    for _ in range(passes):
        random.shuffle(train)
        for lo in range(0, len(train), 64):
            own = train[lo:lo + 64]
            a = x[own] @ p[0] + p[1]
            h = np.maximum(a, 0)
            e = (_sigmoid(h @ p[2] + p[3]) - y[own]) / len(own)
            back = np.outer(e, p[2]) * (a > 0)
            grads = [x[own].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m, s = moments[i]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p[i] = p[i] - 3e-3 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if not cut:
        return net
    z = _logits(net, x[probe] * scale + mean)

    def loss(t):
        q = np.clip(_sigmoid(z / t), 1e-9, 1 - 1e-9)
        return -np.mean(y[probe] * np.log(q) + (1 - y[probe]) * np.log(1 - q))

    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    return net._replace(temperature=float(min(grid, key=loss)))


_SAMPLE = pa.schema([
    ("doc_id", pa.int64()), ("label", pa.int32()), ("places", pa.binary()), ("shapes", pa.binary()),
])


def _sample_words(batch: pa.RecordBatch):
    label = batch.column("label").to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id")
    for chunk in chunks(batch.column("text")):
        owner, place, shape = text_words(chunk)
        first = np.searchsorted(owner, np.arange(chunk.rows + 1))
        part = lambda x: [x[a:b].astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:])]
        yield {
            "doc_id": ids.slice(chunk.first, chunk.rows),
            "label": label[chunk.first:chunk.first + chunk.rows], "places": part(place), "shapes": part(shape),
        }


def fit(sample: DataFrame, docs: DataFrame) -> Network | None:
    """The network for a bounded sample (doc_id, text, label) and the words of all ``docs``; None
    without rows in the sample."""
    seen = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(
        by_batch(_sample_words, _SAMPLE), "doc_id long, label int, places binary, shapes binary"
    ).toArrow()
    if not seen.num_rows:
        return None
    rows = sorted(zip(*(seen.column(c).to_pylist() for c in _SAMPLE.names)))
    places, shapes = ([np.frombuffer(r[i], np.uint16) for r in rows] for i in (2, 3))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in places])
    place, shape = np.concatenate(places).astype(np.int32), np.concatenate(shapes).astype(np.int32)
    vectors = word_vectors(docs)
    return fit_network(
        vectors, pooled(vectors, len(rows), owner, place, shape), np.array([r[1] for r in rows], float)
    )


def probabilities(net: Network, chunk: Chunk) -> np.ndarray:
    return _sigmoid(_logits(net, pooled(net.vectors, chunk.rows, *text_words(chunk))) / net.temperature)


SCORE = "__quality_score"


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """All columns of ``docs`` and ``SCORE`` of every row."""
    if net is None:
        return docs.withColumn(SCORE, F.lit(1.0))

    @F.pandas_udf("double")
    def rate(text):
        import pandas as pd

        parts = [probabilities(net, chunk) for chunk in chunks(pa.array(text, pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(SCORE, rate(F.coalesce("text", F.lit(""))))


def filtered(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, as they are."""
    return score(docs, net).filter(F.col(SCORE) >= THRESHOLD).drop(SCORE)


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    return fit(training_sample(docs, labels, "quality", held_out(5, 0), SAMPLE_ROWS), docs)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out(5, 0).alias("held_out"), F.col(SCORE).alias("score"),
        (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"),
    )
