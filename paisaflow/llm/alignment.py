"""How the tokens of two tokenizers lie over each other in every text.

Both tokenizations cover the same bytes. Each token points to the farthest-right token that
overlaps it (a token that ends where its counterpart ends points to that counterpart's B token, which
points to itself); doubling these pointers until nothing moves gives every token the last
one of its component, and components are the groups between common token ends. Every stretch between
neighbouring ends of either side lies in exactly one A and one B token, so the stretches are the links.

1. Texts are encoded once, in tasks; token ids are stored with what only the text itself decides.
2. Links give, per pair of ids, in how many documents it is linked: combined per chunk, summed by Spark.
3. The pair counts are cut by A id into slices of at most ``slice_pairs`` pairs, so that a broadcast
   slice has a fixed size; every slice is looked up in one pass over the stored ids. With one slice,
   the usual case, the rows are complete after that pass; with more, their sums are added up by row.

A is encoded by ``tiktoken`` from the vocabulary in the JSON file (its ids are merge ranks), which gives
the ids of the file's own library several times faster; texts it cannot take go to that library. A text
whose tokens do not spell it (the second tokenizer may normalise), a null and an empty text have no
tokens: zeros and an empty ``groups_sha256``. Rows that repeat a ``doc_id``, or have none, are rows of
their own, and documents of their own in the counts. Ties count as highest. A very long text is a chunk
of its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.session import cut

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_PAIRS = 1 << 22
CHUNK_BYTES = 2 << 20
#: fixed value: how the byte-level vocabulary splits a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---- vocabularies -------------------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabularies(NamedTuple):
    encode_a: object           # text to ids
    encode_b: object           # texts to lists of ids
    bytes_a: list[bytes]       # per id
    bytes_b: list[bytes]
    size_a: np.ndarray
    size_b: np.ndarray


@lru_cache(maxsize=2)
def vocabularies(folder: str) -> Vocabularies:
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    path = os.path.join(folder, A_FILE)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in spec["model"]["vocab"].items() if token not in special
    }
    fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def encode_a(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as fault:  # the library's own panic is no Exception
            if isinstance(fault, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow.encode(text, add_special_tokens=False).ids

    size = max([*ranks.values(), *special.values()]) + 1
    bytes_a = [b""] * size
    for token, i in special.items():
        bytes_a[i] = token.encode()
    for token, i in ranks.items():
        bytes_a[i] = token
    pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
    bytes_b = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        bytes_b.append(
            bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()
        )
    return Vocabularies(
        encode_a, lambda texts: pieces.encode(texts, num_threads=1), bytes_a, bytes_b,
        np.array([len(b) for b in bytes_a], np.int64), np.array([len(b) for b in bytes_b], np.int64),
    )


# ---- many texts side by side ------------------------------------------------------------------------

class Side(NamedTuple):
    ids: np.ndarray
    end: np.ndarray        # byte after each token, texts one after the other
    first: np.ndarray      # per text its first token, and the number of tokens


def side(ids: list[np.ndarray], size: np.ndarray) -> Side:
    joined = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
    return Side(joined, np.cumsum(size[joined]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))


def ends_below(end: np.ndarray, limit: int) -> np.ndarray:
    """For every byte place up to ``limit`` how many ends are smaller: one pass over the bytes, no search per end."""
    out = np.zeros(limit + 2, np.int32)
    np.cumsum(np.bincount(end, minlength=limit + 1), out=out[1:])
    return out[:-1]


def _limit(a: Side, b: Side) -> int:
    return max(int(x.end[-1]) if len(x.end) else 0 for x in (a, b))


def links(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every overlapping pair, in text order."""
    limit = _limit(a, b)
    marked = np.zeros(limit + 1, bool)
    marked[a.end] = marked[b.end] = True
    ends = np.flatnonzero(marked)
    return ends_below(a.end, limit)[ends].astype(np.int64), ends_below(b.end, limit)[ends].astype(np.int64)


def terminals(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """For every A and B token the B token at which its component ends, by pointer jumping."""
    n = len(a.end)
    # the token that holds the last byte reaches farthest right of all that overlap
    limit = _limit(a, b)
    to_b = ends_below(b.end, limit)[a.end]
    to_a = ends_below(a.end, limit)[b.end]
    last = np.arange(n, n + len(b.end), dtype=np.int32)
    shared = np.zeros(len(b.end), bool)
    if n:
        shared = a.end[np.minimum(to_a, n - 1)] == b.end
    pointer = np.concatenate([to_b + np.int32(n), np.where(shared, last, to_a)])
    ahead = pointer[pointer]
    moving = np.flatnonzero(ahead != pointer)
    pointer = ahead
    while len(moving):
        ahead = pointer[pointer[moving]]
        moved = ahead != pointer[moving]
        pointer[moving] = ahead
        moving = moving[moved]
    return pointer[:n] - n, pointer[n:] - n


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the numbers that fit 16 bits: their letters in eight bytes, which bytes they and one more fill, their lengths."""
    n = np.arange(1 << 16)
    digits = np.ones(len(n), np.int64)
    for k in range(1, 5):
        digits += n >= 10 ** k
    place = np.arange(8)
    power = 10 ** np.maximum(digits[:, None] - 1 - place, 0)
    letters = np.where(place < digits[:, None], 48 + n[:, None] // power % 10, 0).astype(np.uint8)
    filled = (place <= digits[:, None]).astype(np.uint8)
    return letters.view("<u8").ravel(), filled.view("<u8").ravel(), digits


def _text_of(ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each followed by a byte, as one array; and where each begins."""
    letters, filled, digits = _decimals()
    size = digits[ids]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    spelled = letters[ids] | (after.astype("<u8") << (8 * size).astype("<u8"))
    return spelled.view(np.uint8)[filled[ids].view(bool)], begin


def group_digests(a: Side, b: Side) -> tuple[np.ndarray, list[str]]:
    """Number of groups and SHA-256 of their spelling, per text."""
    end_a, end_b = terminals(a, b)
    texts = len(a.first) - 1
    closes = end_b == np.arange(len(end_b))
    closing = np.flatnonzero(closes)
    group_of = np.cumsum(closes) - closes
    group_a, group_b = group_of[end_a], group_of[end_b]
    before_b = np.append(0, np.cumsum(np.bincount(group_b, minlength=len(closing))))
    upto_a = np.append(0, np.cumsum(np.bincount(group_a, minlength=len(closing))))
    n = len(a.ids) + len(b.ids)
    ids, after = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    place_a = np.arange(len(a.ids)) + before_b[group_a]
    place_b = np.arange(len(b.ids)) + upto_a[group_b + 1]
    ids[place_a], ids[place_b] = a.ids, b.ids
    after[place_a[upto_a[1:] - 1]] = ord("|")
    after[place_b[before_b[1:] - 1]] = ord(";")
    spelled, begin = _text_of(ids, after)
    view = memoryview(spelled)
    bounds = a.first + b.first
    return np.diff(np.searchsorted(closing, b.first)), [
        hashlib.sha256(view[begin[bounds[i]]:begin[bounds[i + 1]] - 1]).hexdigest() if bounds[i + 1] > bounds[i] else ""
        for i in range(texts)
    ]


# ---- passes -------------------------------------------------------------------------------------------

_STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("groups_sha256", pa.string()), ("ids_a", pa.binary()), ("ids_b", pa.binary()),
])


def _parts(size: list[int], limit: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, s in enumerate(size):
        if i > lo and held + s > limit:
            yield lo, i
            lo, held = i, 0
        held += s
    if lo < len(size):
        yield lo, len(size)


def _encoded(batch: pa.RecordBatch, folder: str):
    v = vocabularies(folder)
    texts = batch.column("text").to_pylist()
    for lo, hi in _parts([len(t or "") for t in texts], CHUNK_BYTES):
        some = [t or "" for t in texts[lo:hi]]
        ids_a, ids_b = [], []
        for text, own_b in zip(some, v.encode_b(some)):
            whole = (" " + text).encode() if text else b""
            own_a = v.encode_a(" " + text) if text else []
            fits = b"".join(map(v.bytes_a.__getitem__, own_a)) == whole == b"".join(map(v.bytes_b.__getitem__, own_b))
            ids_a.append(np.frombuffer(array("H", own_a if fits else ()), np.uint16))
            ids_b.append(np.frombuffer(array("H", own_b if fits else ()), np.uint16))
        groups, digests = group_digests(side(ids_a, v.size_a), side(ids_b, v.size_b))
        yield {
            "doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_a": [len(x) for x in ids_a],
            "n_b": [len(x) for x in ids_b], "n_groups": groups, "groups_sha256": digests,
            "ids_a": [x.tobytes() for x in ids_a], "ids_b": [x.tobytes() for x in ids_b],
        }


def _linked(batch: pa.RecordBatch, folder: str):
    """Per chunk of stored rows: where it starts and ends, each link's row and pair."""
    v = vocabularies(folder)
    size = (2 * (batch.column("n_a").to_numpy(zero_copy_only=False) + batch.column("n_b").to_numpy(zero_copy_only=False))).tolist()
    for lo, hi in _parts(size, 2 * CHUNK_BYTES):
        a, b = (
            side([np.frombuffer(x, np.uint16) for x in batch.column(c).slice(lo, hi - lo).to_pylist()], table)
            for c, table in (("ids_a", v.size_a), ("ids_b", v.size_b))
        )
        at_a, at_b = links(a, b)
        row = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(at_a, a.first)))
        yield lo, hi, row, (a.ids[at_a] << 16) | b.ids[at_b]


_PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])


def _pair_counts(batch: pa.RecordBatch, folder: str):
    for _, _, row, pair in _linked(batch, folder):
        once = np.sort((row << 32) | pair)
        once = np.sort(once[np.append(np.diff(once) > 0, True)] & 0xFFFFFFFF) if len(once) else once
        begin = np.flatnonzero(np.diff(once, prepend=-1))
        yield {"pair": once[begin], "n": np.diff(np.append(begin, len(once)))}


_SUMS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
])


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` (32 bits) stands among the sorted ``keys``; each different one is looked up once."""
    packed = np.sort((wanted.astype(np.uint64) << np.uint64(32)) | np.arange(len(wanted), dtype=np.uint64))
    value, position = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.diff(value, prepend=-1))
    out = np.empty(len(wanted), np.int64)
    out[position] = np.repeat(np.searchsorted(keys, value[begin]), np.diff(np.append(begin, len(value))))
    return out


def _looked_up(batch: pa.RecordBatch, folder: str, pairs: np.ndarray, n: np.ndarray):
    """Sums over the links whose pairs are in the slice ``pairs`` (sorted) with counts ``n``."""
    begin = np.flatnonzero(np.diff(pairs >> 16, prepend=-1))
    most = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(n)))) if len(n) else n
    best = n == most
    for lo, hi, row, pair in _linked(batch, folder):
        inside = (pair >= pairs[0]) & (pair <= pairs[-1]) if len(pairs) else np.zeros(len(pair), bool)
        row, pair = row[inside], pair[inside]
        at = places(pairs, pair)
        rows = hi - lo
        total = np.zeros(rows, np.int64)
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        if len(row):
            total[row[begin]] = np.add.reduceat(n[at], begin)
        yield {
            **{c: batch.column(c).slice(lo, rows) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")},
            "n_links": np.bincount(row, minlength=rows), "n_best": np.bincount(row[best[at]], minlength=rows),
            "count_sum": total,
        }


def pair_slices(pairs: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of A ids that hold at most ``limit`` pairs each (one id alone may hold a whole B vocabulary)."""
    per_id = pairs.groupBy(F.shiftright("pair", 16).alias("a")).count().orderBy("a").collect()
    return [
        (per_id[lo]["a"], per_id[hi - 1]["a"]) for lo, hi in _parts([r["count"] for r in per_id], limit)
    ]


def encoded(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Per row: doc_id, numbers of tokens and groups, digest of the groups, ids of both sides (16 bits each)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        by_batch(lambda batch: _encoded(batch, folder), _STORED),
        "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, ids_a binary, ids_b binary",
    )


def alignment(docs: DataFrame, folder: str = TOKENIZERS, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    spark = docs.sparkSession
    stored = cut(encoded(docs, folder).withColumn("row", F.monotonically_increasing_id()))
    pairs = cut(stored.select("n_a", "n_b", "ids_a", "ids_b").mapInArrow(
        by_batch(lambda batch: _pair_counts(batch, folder), _PAIRS), "pair long, n long"
    ).groupBy("pair").agg(F.sum("n").alias("n")))
    passes = []
    for low, high in pair_slices(pairs, slice_pairs) or [(0, 0)]:
        own = pairs.filter(F.shiftright("pair", 16).between(low, high)).toArrow()
        key, n = (own.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
        order = np.argsort(key)
        shared = spark.sparkContext.broadcast((key[order].astype(np.uint32), n[order]))

        def looked_up(batches, shared=shared):
            key, n = shared.value
            return by_batch(lambda batch: _looked_up(batch, folder, key.astype(np.int64), n), _SUMS)(batches)

        passes.append(stored.mapInArrow(
            looked_up, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
            "count_sum long, groups_sha256 string",
        ))
    if len(passes) == 1:
        return passes[0].drop("row")
    union = passes[0]
    for one in passes[1:]:
        union = union.unionByName(one)
    same = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    sums = ["n_links", "n_best", "count_sum"]
    return union.groupBy("row").agg(
        *[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in sums]
    ).select(*same[:4], *sums, "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir))
