"""Jaccard join of documents on word shingles, by prefixes of tokens and of token pairs.

1. Equal sets become one class; all further work is on classes.
2. Shingles are counted over all classes. Those that one class alone has are never shared; a class with more
   such shingles than it may have in difference to a partner links with nothing and leaves. This is
   counted again twice over the rest. Of the others only shared shingles are kept: intersections need no more.
3. Shingles are ordered by rarity. Among the ``n`` of a class at most ``d = n * (100 - percent) / 100`` are missing in
   a partner, so if the first common shingle is rare (at most ``RARE`` classes have it), it is among the first
   ``d + 1`` of both: rare shingles index alone. Otherwise no rare shingle is common, and pairs of shingles that
   follow each other among the frequent ones index, in a prefix extended so far that one such pair must be common: a
   shingle the partner lacks breaks two pairs, a shingle only the partner has breaks one, and there are
   no more of either than the threshold leaves after the rare ones. (All combinations would say no more and
   grow with the square of the prefix.) Where a set is too short for this rule, its frequent shingles
   index alone as well.
4. Sets that meet under a key are verified on full sets through hubs (``hubs.resolve``), so that a group of thousands of
   near copies makes no pair of each two of them.

Shingles are hashes of 64 bits, by a mixing step that is not linear in the words' bytes; intersections are of these.

Null, empty or blank texts have no shingles and are linked with nothing. A null ``doc_id`` takes part by its text but
never names a component; a component of such rows alone has a null id. Rows that repeat a ``doc_id`` are rows
of their own; ties in rarity go by hash. A very long text is a chunk of its own and needs some fifty times its
size in a task. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.llm.hubs import resolve
from paisaflow.llm.words import Chunk, chunks, mix, word_places
from paisaflow.session import cut, forget

RARE = 16
PART_BYTES = 8 << 20
PART_SHINGLES = 1 << 19
COMMON = 20_000
MOST_BITS = 1 << 26
HOT_SHARE = 1000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- sets ---------------------------------------------------------------------------------------------

def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits per word, eight bytes a step, each step through a non-linear mix."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    h = mix((end - start).astype(np.uint64) + _STEP)
    at, left = start.copy(), np.arange(len(start))
    while len(left):
        rest = np.minimum(end[left] - at[left], 8)
        mask = np.where(rest == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (rest.astype(np.uint64) * np.uint64(8) % np.uint64(64))) - np.uint64(1))
        h[left] = mix((h[left] ^ (block[at[left]] & mask)) + _STEP)
        at[left] += 8
        left = left[at[left] < end[left]]
    return h


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    out = np.full(max(len(h) - length + 1, 0), np.uint64(length), np.uint64)
    for k in range(length):
        out = mix((out ^ h[k:k + len(out)]) + _STEP)
    return out


def shingle_sets(chunk: Chunk, length: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles; of fewer words than ``length`` the whole sequence."""
    start, end, first = word_places(chunk)
    h = word_hashes(_FOLD[chunk.data], start, end)
    runs = _runs(h, length)
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= length:
            out.append(np.unique(runs[lo:hi - length + 1]))
        else:
            out.append(_runs(h[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary())])


def _sketch(batch: pa.RecordBatch, shingle: int):
    for part in chunks(batch.column("text")):
        sets = shingle_sets(part, shingle)
        yield {
            "doc_id": batch.column("doc_id").slice(part.first, part.rows),
            "fp": batch.column("fp").slice(part.first, part.rows),
            "n_shingles": np.array([len(s) for s in sets], np.int64),
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
        }


def classes_of(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the digest of their sets; one row per distinct set; the classes' texts."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")
    rows = cut(source.mapInArrow(
        by_batch(lambda batch: _sketch(batch, shingle), _SKETCH),
        "doc_id long, fp long, n_shingles long, digest binary",
    ))
    classes = cut(rows.filter("digest is not null").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "fp")).alias("best"),
        F.first("n_shingles").alias("n"), F.count("*").alias("copies"),
    ).withColumn("cid", F.monotonically_increasing_id()))
    one = classes.select(
        "cid", "n", F.col("best.doc_id").alias("one_id"), F.col("best.fp").alias("fp"),
    )
    texts = cut(source.join(
        one, (source.fp == one.fp) & source.doc_id.eqNullSafe(one.one_id)
    ).select("cid", "n", "text"))
    return rows, classes, texts


# ---- shared shingles ------------------------------------------------------------------------------------

_PACKED = pa.schema([("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_DF = pa.schema([("h", pa.int64()), ("df", pa.int64())])
_MAYBE = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _packed(batch: pa.RecordBatch, shingle: int, parts: int):
    for chunk in chunks(batch.column("text")):
        sets = shingle_sets(chunk, shingle)
        value, n = np.unique(np.concatenate(sets), return_counts=True)
        part = (value % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        value, n, part = value[order], n[order].astype(np.uint32), part[order]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        end = np.append(begin[1:], len(part))
        yield {
            "part": part[begin], "hashes": [value[a:b].tobytes() for a, b in zip(begin, end)],
            "counts": [n[a:b].tobytes() for a, b in zip(begin, end)],
        }


def _summed(table: pa.Table) -> pa.Table:
    value = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64)
    n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
    order = np.argsort(value, kind="stable")
    value, n = value[order], n[order].astype(np.int64)
    begin = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    df = np.add.reduceat(n, begin) if len(begin) else n
    often = df > 1
    return pa.table({"h": value[begin][often].view(np.int64), "df": df[often]}, schema=_DF)


def shared_counts(texts: DataFrame, shingle: int) -> DataFrame:
    """h, df of every shingle that more than one row has; a task sends each shingle once per chunk."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    return texts.select("text").mapInArrow(
        by_batch(lambda batch: _packed(batch, shingle, parts), _PACKED), "part long, hashes binary, counts binary"
    ).groupBy("part").applyInArrow(_summed, "h long, df long")


def _flags(shared: DataFrame) -> np.ndarray:
    """Which cells of a bitmap of at most 8 MB the shared shingles fall into."""
    bits = 1 << min(max(20, (2 * shared.count()).bit_length()), MOST_BITS.bit_length() - 1)
    cell = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    flags = np.zeros(bits // 8, np.uint8)
    for block, bitmap in shared.select(cell.alias("cell")).groupBy(F.shiftright("cell", 15)).agg(
        F.bitmap_construct_agg(F.col("cell").bitwiseAND(F.lit(32767).cast("long")))
    ).toLocalIterator():
        flags[block << 12:(block + 1) << 12] = np.frombuffer(bytes(bitmap), np.uint8)
    return flags


def _maybe_shared(batch: pa.RecordBatch, shingle: int, percent: int, flags: np.ndarray):
    for part in chunks(batch.column("text")):
        cids, ns, found = [], [], []
        for i, s in enumerate(shingle_sets(part, shingle)):
            cell = s & np.uint64(8 * len(flags) - 1)
            some = s[(flags[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            if 100 * len(some) >= percent * len(s):
                cids.append(batch.column("cid")[part.first + i].as_py())
                ns.append(len(s))
                found.append(some.view(np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield {"cid": cids, "n": ns, "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))}


# ---- counts among what is left ---------------------------------------------------------------------------

_SENT = pa.schema([
    ("part", pa.int64()), ("cid", pa.binary()), ("n", pa.binary()), ("h", pa.binary()), ("df", pa.binary()),
])
_SENT_COLUMNS = "part long, cid binary, n binary, h binary, df binary"
_TYPES = {"cid": np.int64, "n": np.int64, "h": np.int64, "df": np.int64}
_PROFILE = pa.schema([
    ("cid", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("df", pa.list_(pa.int64())),
])


def _dealt(part: np.ndarray, **columns: np.ndarray) -> dict:
    """Rows by ``part`` with each column's values packed, one row per part."""
    narrow = np.uint16 if len(part) == 0 or part.max() < 1 << 16 else np.int64
    order = np.argsort(part.astype(narrow), kind="stable")
    part = part[order]
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    end = np.append(begin[1:], len(part))
    packed = {name: values[order] for name, values in columns.items()}
    return {"part": part[begin]} | {
        name: [values[a:b].tobytes() for a, b in zip(begin, end)] for name, values in packed.items()
    }


def _sent(batch: pa.RecordBatch, parts: int, often: np.ndarray, often_df: np.ndarray):
    """The shingles of sets, dealt by hash to be counted; those of ``often`` with their known counts, dealt by class."""
    cids, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n"))
    lists = batch.column("tokens")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(cids):
        hi = max(int(np.searchsorted(ends, ends[lo] + PART_SHINGLES, side="right")) - 1, lo + 1)
        row, h = np.repeat(np.arange(lo, hi), np.diff(ends[lo:hi + 1])), values[ends[lo]:ends[hi]]
        at = np.minimum(np.searchsorted(often, h), len(often) - 1) if len(often) else np.zeros(len(h), np.int64)
        known = often[at] == h if len(often) else np.zeros(len(h), bool)
        new = ~known
        deal = lambda x: (mix(x.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        if new.any():
            out = _dealt(deal(h[new]), cid=cids[row[new]], n=ns[row[new]], h=h[new])
            yield out | {"df": [b""] * len(out["part"])}
        if known.any():
            own = row[known]
            yield _dealt(parts + deal(cids[own]), cid=cids[own], n=ns[own], h=h[known], df=often_df[at[known]])
        lo = hi


def _unpacked(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in _TYPES.items()}


def _counted(table: pa.Table, homes: int) -> pa.Table:
    """Shingles of more than one class with their counts, dealt by class."""
    cid, n, h, df = _unpacked(table).values()
    if not len(df):
        order = np.lexsort((cid, h))
        cid, n, h = cid[order], n[order], h[order]
        first = np.append(True, (h[1:] != h[:-1]) | (cid[1:] != cid[:-1]))
        cid, n, h = cid[first], n[first], h[first]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(begin, len(h)))
        df = np.repeat(size, size)
        shared = df > 1
        cid, n, h, df = cid[shared], n[shared], h[shared], df[shared]
    home = (mix(cid.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
    columns = _dealt(home, cid=cid, n=n, h=h, df=df)
    return pa.table([pa.array(columns[f.name], f.type) for f in _SENT], schema=_SENT)


def _gathered(table: pa.Table, percent: int) -> pa.Table:
    """The classes whose shared shingles are enough for a link, their shingles by rarity."""
    cid, n, h, df = _unpacked(table).values()
    order = np.lexsort((h, df, cid))
    order = order[np.append(True, (cid[order][1:] != cid[order][:-1]) | (h[order][1:] != h[order][:-1]))]
    cid, n, h, df = cid[order], n[order], h[order], df[order]
    begin = np.flatnonzero(np.append(True, cid[1:] != cid[:-1]))
    size = np.diff(np.append(begin, len(cid)))
    enough = 100 * size >= percent * n[begin]
    rows = np.repeat(enough, size)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size[enough])]), pa.int32())
    return pa.table([
        pa.array(cid[begin][enough]), pa.array(n[begin][enough]),
        pa.ListArray.from_arrays(offsets, pa.array(h[rows])), pa.ListArray.from_arrays(offsets, pa.array(df[rows])),
    ], schema=_PROFILE)


def _recounted(sets: DataFrame, parts: int, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """``sets`` (cid, n, tokens) with only shingles that two of them have, without sets that have too few.

    Shingles travel packed, to be counted and back. One that very many sets have is not gathered: it keeps the count it had.
    """
    sent = sets.select("cid", "n", "tokens").mapInArrow(
        by_batch(lambda batch: _sent(batch, parts, *common), _SENT), _SENT_COLUMNS
    )
    back = sent.groupBy("part").applyInArrow(lambda table: _counted(table, parts), _SENT_COLUMNS)
    return cut(back.groupBy("part").applyInArrow(
        lambda table: _gathered(table, percent), "cid long, n long, tokens array<long>, df array<long>"
    ))


def profiles(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """cid, n, tokens and df (both by rarity) of the classes whose shared shingles are enough for a link.

    ``df`` counts the sets that were left, or for a shingle of over ``COMMON`` texts those texts; it is one number per shingle.
    """
    shared = cut(shared_counts(texts, shingle))
    flags = texts.sparkSession.sparkContext.broadcast(_flags(shared))
    often = shared.filter(F.col("df") > COMMON).toPandas().sort_values("h")
    common = (often["h"].to_numpy(np.int64), often["df"].to_numpy(np.int64))

    def maybe(batches):
        return by_batch(lambda batch: _maybe_shared(batch, shingle, percent, flags.value), _MAYBE)(batches)

    held = cut(texts.select("cid", "text").mapInArrow(maybe, "cid long, n long, tokens array<long>"))
    forget(shared)
    parts = max(1, -(-(held.agg(F.sum(F.size("tokens"))).first()[0] or 0) // PART_SHINGLES))
    for _ in range(3):
        rest = _recounted(held, parts, common, percent)
        forget(held)
        held = rest
    return held


# ---- keys -----------------------------------------------------------------------------------------------

def pairs_needed(n: int, before: int, percent: int) -> int:
    """How many leading pairs of frequent shingles hold one that a partner shares, if all ``before`` others differ."""
    most = n * (100 - percent) // 100
    broken = lambda x: 2 * (x - before) + max((n - x) * 100 // percent - n, 0)
    return max(broken(before), broken(most)) + 1


def short_below(percent: int) -> int:
    """Sets of fewer shingles than this may have too few pairs for the rule, or meet such a set."""
    last = max((n for n in range(1, 2001) if pairs_needed(n, 0, percent) > n - 1), default=0)
    return (1 << 62) if last == 2000 else (last + 1) * 100 // percent + 1


_KEYS = pa.schema([("cid", pa.int64()), ("key", pa.int64())])


def keys(h: np.ndarray, df: np.ndarray, n: int, percent: int, rare: int, short: int) -> np.ndarray:
    """Index keys of a set of ``n`` shingles with the shared ones ``h`` in order of rarity."""
    most = n * (100 - percent) // 100
    alone = n - len(h)
    r = int(np.searchsorted(df, rare, side="right"))
    single = h[:max(0, min(len(h) if n < short else r, most + 1 - alone))]
    out = [mix(single)]
    if alone + r <= most:
        often = h[r:]
        k = min(pairs_needed(n, alone + r, percent), len(often) - 1)
        if k > 0:
            out.append(mix(mix(often[:k]) + (often[1:k + 1] ^ _STEP)))
    return np.concatenate(out)


def _indexed(batch: pa.RecordBatch, percent: int, rare: int):
    short = short_below(percent)
    cid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cid", "n"))
    for i in range(batch.num_rows):
        h, df = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tokens", "df"))
        own = np.unique(keys(h.astype(np.int64).view(np.uint64), df, int(n[i]), percent, rare, short))
        yield {"cid": np.full(len(own), cid[i]), "key": own.view(np.int64)}


def class_components(texts: DataFrame, shingle: int, percent: int, rare: int = RARE) -> DataFrame | None:
    sets = profiles(texts, shingle, percent)
    found = cut(sets.mapInArrow(
        by_batch(lambda batch: _indexed(batch, percent, rare), _KEYS), "cid long, key long"
    ))
    buckets = found.join(
        sets.select("cid", "n", (F.col("n") - F.size("tokens")).alias("alone")), "cid"
    )
    return resolve(buckets, sets, percent)


def join_classes(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of their class; classes of over a thousandth of all rows, at most a thousand, by broadcast."""
    often = F.col("copies") > max(total // HOT_SHARE, 1000)
    hot, rest = table.filter(often).drop("copies"), table.filter(~often).drop("copies")
    in_hot = rows.join(F.broadcast(hot), "digest")
    in_rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest")
    return in_hot.unionByName(in_rest)


def ngram_join(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, classes, texts = classes_of(docs, shingle)
    labels = class_components(texts, shingle, percent)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, root long")
    rooted = cut(classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "digest", "copies", "best", F.coalesce("root", "cid").alias("root")
    ))
    least = rooted.groupBy("root").agg(F.min("best").alias("first"))
    named = rooted.join(least, "root").select("digest", "copies", F.col("first.doc_id").alias("component_id"))
    some = rows.filter("digest is not null").select("digest", "doc_id", "n_shingles")
    without = rows.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_classes(some, cut(named), rows.count()).drop("digest").unionByName(without)


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


OP12_SQL = """
with recursive tokens as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from tokens
), sizes as (select doc_id, cast(len(s) as bigint) as n from sets),
items as (select doc_id, unnest(s) as g from sets),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n_both
  from items a join items b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * n_both >= 80 * (x.n + y.n - n_both)
), edges as (select a, b from links union all select b, a from links),
reach(node, peer) as (
  select doc_id, doc_id from sizes
  union
  select r.node, e.b from reach r join edges e on r.peer = e.a
)
select n.doc_id, n.n as n_shingles, min(r.peer) as component_id
from sizes n join reach r on r.node = n.doc_id group by n.doc_id, n.n
"""
