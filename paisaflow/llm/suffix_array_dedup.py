"""Removing every 50-byte string that an earlier document has, by a threshold-bounded BWT index.

Candidate pieces come from ``repeats``. A task sorts the suffixes of its pieces, which gives the
Burrows-Wheeler transform as a permutation: the row before row ``i`` in the text, and back. Common
prefixes then follow breadth-first, by increasing value. If all boundaries of rows with fewer than ``v``
symbols in common are closed, two neighbouring rows with ``v`` or more are the backward extension, by ``s <= v``
symbols, of two rows further on, and have ``v + s`` in common unless a closed boundary lies between those. The
sort's ranks close all below 32 at once, so that one round of 18 symbols leads to 50. The boundaries that are
still open then have 50 bytes or more in common, and the rows between closed ones are the places of one string.
The smallest document id of an interval decides for all its rows.

Null text counts as empty. A document with a null id comes after all others; documents of the same
id, or several without one, have no earlier one among themselves. A copy of an earlier document's
text is removed whole, if it has 50 bytes. Empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.llm.repeats import (
    Method, byte_windows, dense_ranks, distinct_texts, mark_columns, repeated_spans, sort_suffixes,
)
from paisaflow.session import cut, forget

WINDOW, GRAMS = 50, (24, 40, 50)


def open_boundaries(
    symbol: np.ndarray, order: np.ndarray, depth: int, closed: np.ndarray | None = None, known: int = 1
) -> np.ndarray:
    """Per row whether it has ``depth`` symbols or more in common with the row before.

    ``symbol`` is the text, 0 ending each piece; ``order`` its suffixes in order (to a depth above
    ``depth``, ties by position). ``closed``: the rows known to have fewer than ``known`` in common.
    """
    n = len(order)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    if closed is None:
        first = symbol[order]
        closed = np.ones(n, bool)
        closed[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
        known = 1
    else:
        closed = closed.copy()
    waiting = np.flatnonzero(~closed)
    while known < depth and len(waiting):
        step = min(known, depth - known)
        # the rows that a row and the one before extend backwards; open ones do not end within ``step``
        one, two = row[order[waiting - 1] + step], row[order[waiting] + step]
        before = np.cumsum(closed, dtype=np.int32)
        ends = before[one] != before[two]
        closed[waiting[ends]] = True
        waiting, known = waiting[~ends], known + step
    return ~closed


def index_pieces(table: pa.Table, window: int = WINDOW):
    """Marks: per piece the runs of windows, each with the smallest id that has such a window."""
    contents = table.column("content").to_pylist()
    size = np.array([len(c) for c in contents])
    raw = np.frombuffer(b"\0".join(contents) + b"\0", np.uint8)
    n = len(raw)
    ends = np.cumsum(size + 1) - 1
    piece = np.repeat(np.arange(len(contents)), size + 1)
    left = ends[piece] - np.arange(n)
    symbol = raw.astype(np.int64) + 1
    symbol[ends] = 0
    key = np.zeros(n, np.int64)
    for k in range(4):
        ahead = np.zeros(n, np.int64)
        ahead[:n - k] = symbol[k:]
        ahead[left < k] = 0
        key = (key << 9) | ahead
    order, levels = sort_suffixes(dense_ranks(key), left, 4, window + 1)
    known, rank = [level for level in levels if level[0] <= window][-1]
    closed = np.ones(n, bool)
    closed[1:] = (np.diff(rank[order]) != 0) | (left[order[1:]] < known)
    together = open_boundaries(symbol, order, window, closed, known)
    begin = np.flatnonzero(~together)
    least = np.minimum.reduceat(table.column("d").to_numpy()[piece[order]], begin)
    g = np.empty(n, np.int64)
    g[order] = np.repeat(least, np.diff(np.append(begin, n)))
    at = np.flatnonzero(left >= window)
    change = np.ones(len(at), bool)
    change[1:] = (g[at][1:] != g[at][:-1]) | (piece[at][1:] != piece[at][:-1])
    run = np.flatnonzero(change)
    lo = at[run]
    hi = at[np.append(run[1:], len(at)) - 1] + 1
    zero = (ends - size)[piece[lo]]
    yield mark_columns(table, piece[lo], lo - zero, hi - zero, g[lo])


METHOD = Method(byte_windows, WINDOW, GRAMS, within_text=False)
_KEPT = pa.schema([
    ("sha", pa.binary()), ("t_d", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
    ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
])


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _results(batch: pa.RecordBatch):
    out = {f.name: [] for f in _KEPT}
    columns = [batch.column(c) for c in ("sha", "d", "text", "spans")]
    for sha, d, text, spans in zip(*columns):
        raw = text.as_py().encode()
        cuts = merged(spans.as_py())
        kept = kept_bytes(raw, cuts)
        for name, value in zip(_KEPT.names, (
            sha.as_py(), d.as_py(), len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(),
        )):
            out[name].append(value)
    yield out


def dedup(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows, texts = distinct_texts(docs)
    spans = repeated_spans(
        texts, METHOD, index_pieces, F.col("m.g") < F.col("d"), *([limit] if limit else [])
    )
    results = cut(texts.select("tid", "sha", "d", "text").join(spans, "tid", "left").mapInArrow(
        by_batch(_results, _KEPT),
        "sha binary, t_d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    ))
    forget(texts, spans)
    # a later copy of a text is one span, whole
    copy = (F.col("d") > F.col("t_d")) & (F.col("n_bytes") >= WINDOW)
    return rows.join(results, "sha").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
