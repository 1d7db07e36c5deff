"""Removing every 35-word window that occurs anywhere else, by prefix-partitioned suffix trees.

All suffixes of the corpus would be one tree. It is cut by prefixes: of each window only the
suffix at its smallest 8-word gram is looked at, that gram is the prefix its group goes by, and
prefixes that occur once are dropped before any text moves (steps 1 to 4 of ``repeats``). The
prefix of a group too large for a task is lengthened to 20 words, then to the whole window. A task builds the
subtree of its groups in array form: leaves (suffixes) in order and, between neighbours, the depth
of the node that joins them. A node of 35 words or deeper with two places under it is a repeat,
and every word of its windows goes, the first place included.

Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged; null or empty texts have none. Of equal texts of 35
words or more every one is removed whole. Ids play no part, so null or repeated ids are as any
other. Empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.llm.repeats import (
    Method, distinct_texts, mark_columns, repeated_spans, sort_suffixes, word_windows,
)
from paisaflow.llm.suffix_array_dedup import merged
from paisaflow.llm.words import chunks, words
from paisaflow.session import cut, forget

WINDOW, GRAMS = 35, (8, 20, 35)
METHOD = Method(word_windows, WINDOW, GRAMS, within_text=True)


def neighbour_depths(order: np.ndarray, levels, left: np.ndarray) -> np.ndarray:
    """Depth of the node between each leaf and the one before it, in symbols.

    From the ranks of each doubling step: the longest step on which both agree, then on from there.
    """
    a, b = order[:-1].copy(), order[1:].copy()
    depth = np.zeros(len(order), np.int64)
    last = len(left) - 1
    for length, rank in reversed(levels[:-1]):
        same = (rank[a] == rank[b]) & (left[a] >= length) & (left[b] >= length)
        depth[1:] += length * same
        a = np.minimum(a + length * same, last)
        b = np.minimum(b + length * same, last)
    return depth


def index_pieces(table: pa.Table, window: int = WINDOW):
    """Marks: per piece the runs of windows that have another place."""
    contents = pa.chunked_array(table.column("content")).combine_chunks().cast(pa.string())
    hashes, sizes = [], []
    for part in chunks(contents):
        found = words(part)
        hashes.append(found.hash)
        sizes.append(np.diff(found.first))
    size = np.concatenate(sizes)
    ends = np.cumsum(size + 1) - 1
    n = int(ends[-1]) + 1
    _, ids = np.unique(np.concatenate(hashes), return_inverse=True)
    symbol = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    symbol[inside] = ids + 1
    piece = np.repeat(np.arange(len(size)), size + 1)
    left = ends[piece] - np.arange(n)
    order, levels = sort_suffixes(symbol, left, 1, 64)
    begin = np.flatnonzero(neighbour_depths(order, levels, left) < window)
    weight = table.column("weight").to_numpy()[piece[order]]
    places = np.add.reduceat(weight, begin)
    repeated = np.zeros(n, bool)
    repeated[order] = np.repeat(places > 1, np.diff(np.append(begin, n)))
    at = np.flatnonzero(repeated & (left >= window))
    if not len(at):
        return
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1] + 1) | (piece[at][1:] != piece[at][:-1])
    run = np.flatnonzero(change)
    lo, hi = at[run], at[np.append(run[1:], len(at)) - 1] + 1
    zero = (ends - size)[piece[lo]]
    yield mark_columns(table, piece[lo], lo - zero, hi - zero, np.zeros(len(lo), np.int64))


_KEPT = pa.schema([
    ("sha", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
])


def _results(batch: pa.RecordBatch, window: int):
    out = {f.name: [] for f in _KEPT}
    for sha, copies, text, spans in zip(*[batch.column(c) for c in ("sha", "copies", "text", "spans")]):
        # bytes split at exactly [\x20\x09-\x0D]
        own = text.as_py().encode().split()
        cuts = merged(spans.as_py())
        if copies.as_py() > 1 and len(own) >= window:
            cuts = [(0, len(own))]
        edges = [0, *[x for s in cuts for x in s], len(own)]
        kept = [w for a, b in zip(edges[::2], edges[1::2]) for w in own[a:b]]
        for name, value in zip(_KEPT.names, (
            sha.as_py(), len(own), len(own) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(),
        )):
            out[name].append(value)
    yield out


def dedup(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    rows, texts = distinct_texts(docs)
    spans = repeated_spans(texts, METHOD, index_pieces, F.lit(True), *([limit] if limit else []))
    results = cut(texts.select("tid", "sha", "copies", "text").join(spans, "tid", "left").mapInArrow(
        by_batch(lambda batch: _results(batch, WINDOW), _KEPT),
        "sha binary, n_words long, n_removed long, kept_sha256 string",
    ))
    forget(texts, spans)
    return rows.join(results, "sha").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
