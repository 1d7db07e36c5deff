"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (ASCII case folded, punctuation apart) and the first four
bytes of each, hashed. The score adds a weight per term and, for every pair of terms, the product
of their factor vectors, so that an insult beside a mention of a group can weigh more than both
apart. Weights are learned first alone, with a penalty that sets those of chance terms to zero;
factors then for the terms that are left, which keeps the model small and long texts from drowning
in noise. The model is fitted on at most ``SAMPLE_ROWS`` labelled rows (a documented bound) on
the driver and is sent to the tasks that score every row; no text but the sample's is shuffled.

Null or empty texts have no terms: their score is that of the intercept. Null ids are scored too.
Repeated rows score alike. Without any labelled row every score is 0. Only ``doc_id`` and ``text``
are read; ``doc_id`` decides who is held out and is no input of a score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.llm.labelled import held_out, training_sample
from paisaflow.llm.words import NOT_ALPHANUMERIC, Chunk, chunks, prefix_hashes, range_hash, words

SAMPLE_ROWS = 16_000
BITS = 18
PREFIX_BYTES = 4
FACTORS = 4
THRESHOLD = 0.3


class Machine(NamedTuple):
    intercept: float
    terms: np.ndarray     # sorted hashed terms with a weight
    weight: np.ndarray
    factor: np.ndarray    # one row per term


def text_terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs of a chunk, by text."""
    found = words(chunk, fold=True, between=NOT_ALPHANUMERIC)
    if not len(found.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums, inverse = prefix_hashes(chunk.data, True)
    head = range_hash(sums, inverse, found.start, np.minimum(found.end, found.start + PREFIX_BYTES))
    owner = np.repeat(np.arange(chunk.rows), np.diff(found.first))
    shift = np.uint64(64 - BITS)
    term = np.concatenate([found.hash >> shift, (head >> shift) + np.uint64(1 << BITS)]).astype(np.int64)
    pair = np.unique(np.concatenate([owner, owner]) << (BITS + 1) | term)
    return pair >> (BITS + 1), pair & ((1 << (BITS + 1)) - 1)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(row, value, rows):
    return np.bincount(row, value, minlength=rows)


def fit_machine(row: np.ndarray, term: np.ndarray, label: np.ndarray, passes: int = 12, seed: int = 7) -> Machine:
    """Logistic loss by AdaGrad in small batches; ``row`` is sorted and indexes ``label``."""
    random = np.random.default_rng(seed)
    terms, at, seen = np.unique(term, return_inverse=True, return_counts=True)
    use = seen >= 3
    rank = np.cumsum(use) - 1
    keep = use[at]
    row, at, terms = row[keep], rank[at[keep]], terms[use]
    n = len(label)
    prior = np.clip(label.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    intercept, w = float(np.log(prior / (1 - prior))), np.zeros(len(terms))
    penalty, rate = 5e-4, 0.3
    first = np.searchsorted(row, np.arange(n + 1))

    def batches(size=128):
        order = random.permutation(n)
        for lo in range(0, n, size):
            own = order[lo:lo + size]
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            local = np.repeat(np.arange(len(own)), first[own + 1] - first[own])
            yield label[own], local, at[take]

    squares, square0 = np.full(len(terms), 1e-2), 1e-2
    for _ in range(passes):
        for y, local, t in batches():
            error = _sigmoid(intercept + _sums(local, w[t], len(y))) - y
            g0 = error.mean()
            square0 += g0 * g0
            intercept -= rate * g0 / np.sqrt(square0)
            g = np.bincount(t, error[local], minlength=len(w)) / len(y)
            squares += g * g
            step = rate / np.sqrt(squares)
            w -= step * g
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    live = np.abs(w) > 1e-3
    rank = np.cumsum(live) - 1
    keep = live[at]
    row, at, terms, w = row[keep], rank[at[keep]], terms[live], w[live]
    first = np.searchsorted(row, np.arange(n + 1))
    v = random.normal(0, 0.04, (len(w), FACTORS))
    squares_w, squares_v = np.full(len(w), 1e-2), np.full(v.shape, 1e-2)
    decay, factor_decay = 1e-4, 1e-4
    for _ in range(passes if len(w) else 0):
        for y, local, t in batches():
            rows = len(y)
            total = np.stack([_sums(local, v[t, k], rows) for k in range(FACTORS)], axis=1)
            own = np.stack([_sums(local, v[t, k] ** 2, rows) for k in range(FACTORS)], axis=1)
            z = intercept + _sums(local, w[t], rows) + 0.5 * (total ** 2 - own).sum(axis=1)
            error = _sigmoid(z) - y
            g0 = error.mean()
            square0 += g0 * g0
            intercept -= 0.1 * g0 / np.sqrt(square0)
            g = np.bincount(t, error[local], minlength=len(w)) / rows + decay * w
            squares_w += g * g
            w = w - 0.1 * g / np.sqrt(squares_w)
            for k in range(FACTORS):
                gk = np.bincount(t, error[local] * (total[local, k] - v[t, k]), minlength=len(w)) / rows + factor_decay * v[:, k]
                squares_v[:, k] += gk * gk
                v[:, k] -= 0.1 * gk / np.sqrt(squares_v[:, k])
    return Machine(intercept, terms, w, v)


def scores(model: Machine, rows: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
    z = np.full(rows, model.intercept)
    if len(model.terms) and len(term):
        at = np.minimum(np.searchsorted(model.terms, term), len(model.terms) - 1)
        known = model.terms[at] == term
        row, at = row[known], at[known]
        z += _sums(row, model.weight[at], rows)
        for k in range(model.factor.shape[1]):
            own = model.factor[at, k]
            z += 0.5 * (_sums(row, own, rows) ** 2 - _sums(row, own * own, rows))
    return _sigmoid(z)


def _sample_terms(batch: pa.RecordBatch):
    label = batch.column("label").to_numpy(zero_copy_only=False)
    ids = batch.column("doc_id")
    for chunk in chunks(batch.column("text")):
        row, term = text_terms(chunk)
        first = np.searchsorted(row, np.arange(chunk.rows + 1))
        yield {
            "doc_id": ids.slice(chunk.first, chunk.rows),
            "label": label[chunk.first:chunk.first + chunk.rows],
            "terms": [term[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:])],
        }


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.binary())])


def fit(sample: DataFrame) -> Machine | None:
    """The machine for a bounded sample (doc_id, text, label); None without rows."""
    seen = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(
        by_batch(_sample_terms, _SAMPLE), "doc_id long, label int, terms binary"
    ).toArrow()
    if not seen.num_rows:
        return None
    # one order whatever task came first, so that reruns fit the same machine
    rows = sorted(zip(*(seen.column(c).to_pylist() for c in ("doc_id", "terms", "label"))))
    terms = [np.frombuffer(t, np.int32) for _, t, _ in rows]
    row = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    return fit_machine(row, np.concatenate(terms), np.array([y for _, _, y in rows], float))


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """doc_id and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batch):
        ids = batch.column("doc_id")
        for chunk in chunks(batch.column("text")):
            value = np.zeros(chunk.rows) if model is None else scores(model, chunk.rows, *text_terms(chunk))
            yield {"doc_id": ids.slice(chunk.first, chunk.rows), "score": value}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        by_batch(run, schema), "doc_id long, score double"
    )


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), held_out(4, 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(training_sample(docs, labels, "toxic", held, SAMPLE_ROWS))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
