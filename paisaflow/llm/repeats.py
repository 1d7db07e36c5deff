"""Finding every window of a fixed length that occurs more than once, in parts that fit a task.

Shared by the byte-wise and the word-wise operator. A window's *minimum* is the smallest hash of the
grams in it: equal windows have equal minima. So

1. equal texts become one (a group of copies is one row per task before the shuffle);
2. the minima of all texts, about two per window length, are dealt out by their value, and those
   that occur once are dropped: none of their windows can occur twice;
3. texts get back the minima that remain, and each run of windows with one such minimum becomes a
   *piece*, sent by its minimum: all equal windows meet in one task. Equal pieces combine first;
4. pieces of a minimum with too many bytes or words are cut anew by longer grams, in the end by
   whole windows. All windows under such a last key are equal, however long their run is, so an
   aggregation over the key settles them, and no group that is indexed outgrows a task;
5. the operator's own index over the other pieces of a task tells which windows are repeats (``marks``);
6. marks go back to the pieces' places, and spans to their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch
from paisaflow.llm.words import CHUNK_BYTES, Chunk, chunks, mix, prefix_hashes, sequence_hash, words
from paisaflow.session import cut, forget

PART_BYTES = 8 << 20
PIECE_WINDOWS = 2_048
GROUP_UNITS = 1 << 20
LAST_ID = (1 << 63) - 1


class Windows(NamedTuple):
    grams: np.ndarray                    # per start in the chunk the hash of its gram
    minima: np.ndarray                   # and the smallest in its window
    first: np.ndarray                    # per text its first unit, and the number of units
    content: Callable[[int, int], bytes]  # what lies from one unit to another


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` (min or max) over each run of ``width`` values, in doubling steps."""
    if len(x) < width:
        return x[:0]
    out, done = x, 1
    while 2 * done <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = op(out[:len(x) - width + 1], out[width - done:])
    return out


def byte_windows(chunk: Chunk, window: int, gram: int) -> Windows:
    n = len(chunk.data)
    if n < window:
        none = np.zeros(0, np.uint64)
        return Windows(none, none, chunk.offsets, lambda lo, hi: b"")
    sums, inverse = prefix_hashes(chunk.data, False)
    grams = mix((sums[gram:] - sums[:n - gram + 1]) * inverse[:n - gram + 1])
    raw = chunk.data.tobytes()
    least = sliding(np.minimum, grams, window - gram + 1)
    return Windows(grams, least, chunk.offsets, lambda lo, hi: raw[lo:hi])


def word_windows(chunk: Chunk, window: int, gram: int) -> Windows:
    """Contents are the words joined by one space, whatever stood between them."""
    found = words(chunk)
    raw = chunk.data.tobytes()
    start, end = found.start, found.end
    grams = sequence_hash(found.hash, gram)
    return Windows(
        grams, sliding(np.minimum, grams, window - gram + 1), found.first,
        lambda lo, hi: b" ".join(raw[start[lo]:end[hi - 1]].split()),
    )


class Method(NamedTuple):
    """What the two operators differ in."""
    windows: Callable[[Chunk, int, int], Windows]
    window: int
    grams: tuple[int, ...]   # the first is used for all texts, the last is the window
    within_text: bool     # does a second place in the same text make a repeat?


def _runs(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    change = np.flatnonzero(minima[1:] != minima[:-1]) + 1
    return np.concatenate([[0], change]), np.concatenate([change, [len(minima)]])


# ---- steps 1 and 2 ----------------------------------------------------------------------------

def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, d, sha) and the distinct texts (tid, sha, d, copies, text); both stored.

    ``d`` orders documents: the id, a null after all others.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), text.alias("text"),
    ).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = cut(keyed.select("doc_id", "d", "sha"))
    texts = cut(keyed.groupBy("sha").agg(
        F.min("d").alias("d"), F.count("*").alias("copies"), F.first("text").alias("text")
    ).withColumn("tid", F.monotonically_increasing_id()))
    return rows, texts


_BLOB = pa.schema([("part", pa.int64()), ("tids", pa.binary()), ("hashes", pa.binary())])


def _bucket(tid: np.ndarray, parts: int) -> np.ndarray:
    return (mix(tid.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _blobs(part: np.ndarray, tid: np.ndarray, value: np.ndarray) -> dict:
    """One row per part: its values and their texts, packed."""
    order = np.argsort(part, kind="stable")
    part, tid, value = part[order], tid[order], value[order]
    begin, end = _runs(part)
    return {
        "part": part[begin], "tids": [tid[a:b].tobytes() for a, b in zip(begin, end)],
        "hashes": [value[a:b].tobytes() for a, b in zip(begin, end)],
    }


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tid = np.frombuffer(b"".join(table.column("tids").to_pylist()), np.int64)
    return tid, np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)


def _minima_blobs(batch: pa.RecordBatch, method: Method, parts: int) -> Iterator[dict]:
    ids = batch.column("tid").to_numpy(zero_copy_only=False)
    gram = method.grams[0]
    for chunk in chunks(batch.column("text")):
        win = method.windows(chunk, method.window, gram)
        values, owners = [], []
        for i, (lo, hi) in enumerate(zip(win.first[:-1], win.first[1:])):
            if hi - lo < method.window:
                continue
            own = win.minima[lo:hi - method.window + 1]
            value = np.unique(own[_runs(own)[0]])
            if method.within_text:
                grams, times = np.unique(win.grams[lo:hi - gram + 1], return_counts=True)
                value = np.concatenate([value, value[times[np.searchsorted(grams, value)] > 1]])
            values.append(value)
            owners.append(np.full(len(value), ids[chunk.first + i], np.int64))
        if values:
            value = np.concatenate(values)
            yield _blobs((value % np.uint64(parts)).astype(np.int64), np.concatenate(owners), value)


def _shared(table: pa.Table, parts: int) -> pa.Table:
    """Of one part: the values that occur again, packed by the bucket of their text."""
    tid, value = _unpacked(table)
    order = np.argsort(value, kind="stable")
    value, tid = value[order], tid[order]
    same = value[1:] == value[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    value, tid = value[again], tid[again]
    if not len(tid):
        return _BLOB.empty_table()
    return pa.table(_blobs(_bucket(tid, parts), tid, value), schema=_BLOB)


def shared_minima(texts: DataFrame, method: Method, parts: int) -> DataFrame:
    packed = "part long, tids binary, hashes binary"
    blobs = texts.select("tid", "text").mapInArrow(
        by_batch(lambda batch: _minima_blobs(batch, method, parts), _BLOB), packed
    )
    return cut(blobs.groupBy("part").applyInArrow(lambda table: _shared(table, parts), packed))


# ---- step 3 and 4 -----------------------------------------------------------------------------

_PIECE = pa.schema([
    ("key", pa.int64()), ("tid", pa.int64()), ("d", pa.int64()), ("copies", pa.int64()),
    ("start", pa.int64()), ("units", pa.int64()), ("content", pa.binary()),
])


def _pieces(rows: pa.RecordBatch | pa.Table, method: Method, gram: int, known) -> Iterator[dict]:
    """Runs of windows with one minimum; ``known`` gives the minima that count in a row, or is None.

    If grams are windows, the first window stands for the content of its run.
    """
    ids, order_, copies, starts = (rows.column(c).to_numpy() for c in ("tid", "d", "copies", "start"))
    for chunk in chunks(rows.column("content")):
        win = method.windows(chunk, method.window, gram)
        out, held = {f.name: [] for f in _PIECE}, 0
        for i, (lo, hi) in enumerate(zip(win.first[:-1].tolist(), win.first[1:].tolist())):
            row = chunk.first + i
            if hi - lo < method.window:
                continue
            begin, end = _runs(win.minima[lo:hi - method.window + 1])
            value = win.minima[lo + begin]
            if known is not None:
                own = known(ids[row])
                if not len(own):
                    continue
                hit = own[np.minimum(np.searchsorted(own, value), len(own) - 1)] == value
                begin, end, value = begin[hit], end[hit], value[hit]
            for a, b, key in zip(begin.tolist(), end.tolist(), value.view(np.int64).tolist()):
                for at in range(a, b, PIECE_WINDOWS):
                    stop = min(at + PIECE_WINDOWS, b) + method.window - 1
                    out["key"].append(key)
                    out["tid"].append(ids[row])
                    out["d"].append(order_[row])
                    out["copies"].append(copies[row])
                    out["start"].append(starts[row] + at)
                    out["units"].append(stop - at)
                    out["content"].append(win.content(lo + at, lo + (at + gram if gram == method.window else stop)))
                    held += 100 + len(out["content"][-1])
                    if held > 4 * CHUNK_BYTES:
                        yield out
                        out, held = {f.name: [] for f in _PIECE}, 0
        if out["key"]:
            yield out


_PIECE_DDL = "key long, tid long, d long, copies long, start long, units long, content binary"


def pieces_of(texts: DataFrame, shared: DataFrame, method: Method, parts: int) -> DataFrame:
    """Texts meet their minima in buckets of a bounded number of bytes."""
    @F.pandas_udf("long")
    def bucket(tid):
        import pandas as pd

        return pd.Series(_bucket(tid.to_numpy(np.int64), parts))

    def cut_texts(own: pa.Table, blobs: pa.Table) -> pa.Table:
        if not own.num_rows or not blobs.num_rows:
            return _PIECE.empty_table()
        tid, value = _unpacked(blobs)
        order = np.lexsort((value, tid))
        tid, value = tid[order], value[order]

        def known(i):
            lo, hi = np.searchsorted(tid, [i, i + 1])
            return value[lo:hi]

        return pa.Table.from_batches([
            pa.RecordBatch.from_pydict(out, schema=_PIECE)
            for out in _pieces(own.combine_chunks(), method, method.grams[0], known)
        ], schema=_PIECE)

    own = texts.select(
        bucket("tid").alias("part"), "tid", "d", "copies", F.lit(0).cast("long").alias("start"),
        F.col("text").cast("binary").alias("content"),
    )
    return cut(own.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(
        cut_texts, _PIECE_DDL
    ).withColumn("ck", F.xxhash64("content")))


def bounded_pieces(
    pieces: DataFrame, method: Method, limit: int = GROUP_UNITS
) -> tuple[DataFrame, DataFrame | None]:
    """The pieces, those of a minimum with over ``limit`` symbols (bytes or words, and an end each) of
    different ones cut by longer grams; and apart the runs of equal windows that the last cut leaves.
    """
    done = []
    for gram in method.grams[1:]:
        heavy = cut(pieces.groupBy("key", "ck").agg(
            F.first("units").alias("units")
        ).groupBy("key").agg(F.sum(F.col("units") + 1).alias("units")).filter(F.col("units") > limit).select("key"))
        if not heavy.limit(1).count():
            break
        done.append(pieces.join(heavy, "key", "left_anti"))
        again = by_batch(lambda batch, gram=gram: _pieces(batch, method, gram, None), _PIECE)
        pieces = cut(pieces.join(heavy, "key", "left_semi").select(*_PIECE.names).mapInArrow(
            again, _PIECE_DDL
        ).withColumn("ck", F.xxhash64("content")))
    if not done:
        return pieces, None
    settled = pieces if len(done) == len(method.grams) - 1 else None
    if settled is None:
        done.append(pieces)
    indexed = done[0]
    for part in done[1:]:
        indexed = indexed.unionByName(part)
    return cut(indexed), settled


# ---- steps 5 and 6 ----------------------------------------------------------------------------

def marks_of(pieces: DataFrame, index, schema: pa.Schema, ddl: str) -> DataFrame:
    """``index`` over the different pieces of whole groups, at most ``GROUP_UNITS`` symbols at a time
    or one larger group.

    It gets keys, contents, smallest ``d`` and total weight, and yields columns of ``schema``,
    which starts with ``key`` and ``ck``.
    """
    different = pieces.groupBy("key", "ck", "content").agg(
        F.min("d").alias("d"), F.sum("copies").alias("weight"), F.max("units").alias("units")
    ).repartition("key").sortWithinPartitions("key")

    def run(batches):
        # whole groups, and what has come so far of the last one
        held: list[pa.RecordBatch] = []
        group: list[pa.RecordBatch] = []
        size = group_size = 0

        def flush(table):
            for columns in index(table):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                     for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            units_to = np.append(0, np.cumsum(batch.column("units").to_numpy(zero_copy_only=False) + 1))
            lo = 0
            last = group[-1].column("key")[-1].as_py() if group else None
            for hi in ends.tolist():
                if group and keys[lo] != last:
                    if held and size + group_size > GROUP_UNITS:
                        yield from flush(pa.Table.from_batches(held))
                        held, size = [], 0
                    held += group
                    size += group_size
                    group, group_size = [], 0
                group.append(batch.slice(lo, hi - lo))
                group_size += int(units_to[hi] - units_to[lo])
                last, lo = keys[lo], hi
        if held and size + group_size > GROUP_UNITS:
            yield from flush(pa.Table.from_batches(held))
            held = []
        if group:
            yield from flush(pa.Table.from_batches(held + group))

    return cut(different.mapInArrow(run, ddl))


def settled_marks(settled: DataFrame, method: Method) -> DataFrame:
    """tid, d, start and mark of each run whose one window has two places or more."""
    windows = F.col("units") - (method.window - 1)
    least = settled.groupBy("key", "ck", "content").agg(
        F.min("d").alias("g"), F.sum(F.col("copies") * windows).alias("places")
    ).filter(F.col("places") > 1).select("key", "ck", "g")
    return settled.select("key", "ck", "tid", "d", "start", "units").join(least, ["key", "ck"]).select(
        "tid", "d", "start",
        F.struct(F.lit(0).cast("long").alias("from"), windows.alias("to"), F.col("g").alias("g")).alias("m"),
    )


def spans_in_texts(pieces: DataFrame, marks: DataFrame, settled: DataFrame | None, method: Method, counts) -> DataFrame:
    """tid and its spans (start, stop in units, unordered) from marks (key, ck, from, to, g arrays).

    ``counts`` is a condition on ``d`` of the place and ``m.g`` of the mark.
    """
    found = pieces.select("key", "ck", "tid", "d", "start").join(marks, ["key", "ck"]).select(
        "tid", "d", "start", F.explode(F.arrays_zip("from", "to", "g")).alias("m")
    )
    if settled is not None:
        found = found.unionByName(settled_marks(settled, method))
    return cut(found.filter(counts).groupBy("tid").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("m.from")).alias("start"),
        (F.col("start") + F.col("m.to") + method.window - 1).alias("stop"),
    )).alias("spans")))


def repeated_spans(texts: DataFrame, method: Method, index, counts, limit: int = GROUP_UNITS) -> DataFrame:
    """Steps 2 to 6: ``tid`` and ``spans`` of every text that holds a repeat."""
    schema = pa.schema([
        ("key", pa.int64()), ("ck", pa.int64()), ("from", pa.list_(pa.int64())),
        ("to", pa.list_(pa.int64())), ("g", pa.list_(pa.int64())),
    ])
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    shared = shared_minima(texts, method, parts)
    every = pieces_of(texts, shared, method, parts)
    forget(shared)
    pieces, settled = bounded_pieces(every, method, limit)
    if pieces is not every:
        forget(every)
    marks = marks_of(
        pieces, index, schema, "key long, ck long, from array<long>, to array<long>, g array<long>"
    )
    spans = spans_in_texts(pieces, marks, settled, method, counts)
    forget(pieces, marks, *([settled] if settled is not None else []))
    return spans


# ---- arrays for the indexes -------------------------------------------------------------------

POSITION_BITS = 21


def dense_ranks(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys, of keys of at most 43 bits: one sort of keys with their positions."""
    n = len(key)
    assert n < 1 << POSITION_BITS
    bits = np.uint64(POSITION_BITS)
    packed = (key.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64)
    packed.sort()
    value = packed >> bits
    new = np.ones(n, np.int64)
    np.cumsum(value[1:] != value[:-1], out=new[1:])
    new[1:] += 1
    rank = np.empty(n, np.int64)
    rank[(packed & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)] = new
    return rank


def sort_suffixes(rank: np.ndarray, left: np.ndarray, length: int, depth: int):
    """Suffixes in order of their first ``depth`` symbols or more, by doubling.

    ``rank`` orders the first ``length`` symbols (0 past an end), ``left`` is the number of symbols
    up to the end of the suffix's piece. Yields (length, ranks) per step and returns the order.
    """
    n = len(rank)
    assert n < 1 << POSITION_BITS
    bits = np.uint64(POSITION_BITS)
    position = np.arange(n, dtype=np.uint64)
    levels = [(length, rank)]
    order = None
    while length < depth:
        ahead = np.zeros(n, np.uint64)
        ahead[:n - length] = rank[length:]
        ahead[left <= length] = 0
        key = (rank.astype(np.uint64) << (bits + bits)) | (ahead << bits) | position
        key.sort()
        order = (key & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
        pair = key >> bits
        new = np.empty(n, np.int64)
        new[0] = 1
        np.cumsum(pair[1:] != pair[:-1], out=new[1:])
        new[1:] += 1
        rank = np.empty(n, np.int64)
        rank[order] = new
        length *= 2
        levels.append((length, rank))
    return order, levels


def mark_columns(table: pa.Table, piece: np.ndarray, start: np.ndarray, stop: np.ndarray, g: np.ndarray) -> dict:
    """Marks per piece as list columns; rows are ordered by piece."""
    named, counts = np.unique(piece, return_counts=True)
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64()))
    rows = pa.array(named)
    return {
        "key": table.column("key").combine_chunks().take(rows),
        "ck": table.column("ck").combine_chunks().take(rows),
        "from": lists(start), "to": lists(stop), "g": lists(g),
    }
