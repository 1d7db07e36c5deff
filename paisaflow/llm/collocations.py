"""Phrases of two to four words that occur together more often than their parts, per language.

Counts come from a depth-truncated suffix tree over words, cut vertically so that each part fits a
memory budget:

1. One pass counts words per language and, in cells by hash, the occurrences below every prefix of
   one to ``max_words - 1`` words. A cell with more than a quarter of the budget is heavy.
2. Each word begins a suffix of up to ``max_words`` words inside its piece of text. It goes to a group
   named by the shortest of its prefixes that is not heavy, so that no group holds much more than
   the budget; heavy prefixes on the way are nodes of their own and are counted in a group named by
   themselves. A task combines equal suffixes first, so a phrase in a third of all texts
   sends one entry per chunk. Words rarer than ``min_count`` end a suffix (told by a bitmap of fixed
   size, which may keep a rare word but never drops a frequent one).
3. Each group builds its subtree level by level: the children of a node are its next words, and a
   node's count is the total of the leaves below it. Nodes below ``min_count`` are not grown further.

Cuts, scores and the dropping of absorbed phrases are joins and aggregations over the frequent nodes;
products are decimals. Words are compared as words; hashes only choose cells and groups.

A null text has no words, a null ``lang`` is ``und``; rows that repeat each other count each; ties go by
the order of the ranking (score, count, phrase), which is total. A very long text is a chunk of its own and
needs some forty times its size in a task. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from paisaflow.llm.frames import by_batch, documents
from paisaflow.llm.words import Chunk, chunks, mix, words
from paisaflow.session import cut, forget

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[list(SEPARATORS)] = True
_BETWEEN = _ENDS_PIECE.copy()
_BETWEEN[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32

CHUNK_BYTES = 2 << 20
GROUP_BUDGET = 1 << 21          # suffixes
WORD_BITS = 23                  # cells of the bitmap of frequent words
MOST_CELLS = 1 << 24


class Tokens(NamedTuple):
    code: np.ndarray            # per word occurrence, its name: language and word
    piece: np.ndarray           # per word occurrence, increasing with its piece
    lang: pa.Array              # per name
    word: pa.Array
    hash: np.ndarray

    def names(self) -> pa.Array:
        """Language, tab, word; words hold no tab."""
        return pc.binary_join_element_wise(self.lang.cast(pa.binary()), self.word, b"\t")


def tokens(chunk: Chunk, lang: pa.Array) -> Tokens:
    data = _FOLD[chunk.data]
    found = words(chunk, fold=True, between=_BETWEEN)
    row = np.repeat(np.arange(chunk.rows), np.diff(found.first))
    ends = np.concatenate([[0], np.cumsum(found.end - found.start)])
    inside = np.ascontiguousarray(data[~_BETWEEN[data]])
    each = pa.Array.from_buffers(
        pa.large_binary(), len(found.start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(inside)]
    ).dictionary_encode()
    langs = lang.dictionary_encode()
    word = each.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    n = max(len(langs.dictionary), 1)
    both, code = np.unique(word * n + own, return_inverse=True)
    of_word = np.zeros(len(each.dictionary), np.uint64)
    of_word[word] = found.hash
    of_lang = np.array([zlib.crc32(t.encode()) for t in langs.dictionary.to_pylist()] or [0], np.uint64)
    piece = np.cumsum(_ENDS_PIECE[data])[found.start] + row if len(row) else row
    return Tokens(
        code, piece, langs.dictionary.take(pa.array(both % n)),
        each.dictionary.cast(pa.binary()).take(pa.array(both // n)), mix(of_word[both // n] ^ mix(of_lang[both % n])),
    )


def _extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _together(piece: np.ndarray, k: int) -> int | np.ndarray:
    """Whether the ``k``-th word after each is in the same piece."""
    out = np.zeros(len(piece), bool)
    if k < len(piece):
        out[:len(piece) - k] = piece[k:] == piece[:len(piece) - k]
    return out


def _shifted(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[:max(len(values) - k, 0)] = values[k:]
    return out


def _tagged(batch: pa.RecordBatch):
    for part in chunks(batch.column("text"), CHUNK_BYTES):
        yield tokens(part, batch.column("lang").slice(part.first, part.rows).fill_null("und"))


# ---- first pass: words, and how much lies below each prefix -----------------------------------------

_COUNTS = pa.schema([
    ("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("level", pa.int32()),
    ("cell", pa.int32()), ("n", pa.int64()),
])


def _prefix_counts(batch: pa.RecordBatch, max_words: int, cells: int):
    for t in _tagged(batch):
        if not len(t.code):
            continue
        yield {
            "lang": t.lang, "word": t.word.cast(pa.string()), "h": t.hash.view(np.int64),
            "level": np.ones(len(t.hash), np.int32), "cell": np.zeros(len(t.hash), np.int32),
            "n": np.bincount(t.code, minlength=len(t.hash)),
        }
        h = t.hash[t.code]
        for level in range(2, max_words):
            h = _extend(h, t.hash[_shifted(t.code, level - 1)])
            n = np.bincount((h[_together(t.piece, level - 1)] & np.uint64(cells - 1)).astype(np.int64))
            cell = np.flatnonzero(n)
            none = pa.nulls(len(cell), pa.string())
            yield {
                "lang": none, "word": none, "h": np.zeros(len(cell), np.int64),
                "level": np.full(len(cell), level, np.int32), "cell": cell.astype(np.int32), "n": n[cell],
            }


def _bitmap(found: DataFrame, bits: int) -> np.ndarray:
    """A flag per cell; ``found`` has the set ones in ``bit``. At most ``bits / 8`` bytes reach the driver."""
    blocks = found.groupBy(F.shiftright("bit", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767).cast("long"))).alias("set")
    ).collect()
    flags = np.zeros(max(bits, 32768), bool)
    for block, bitmap in blocks:
        flags[block << 15:(block + 1) << 15] = np.unpackbits(np.frombuffer(bytes(bitmap), np.uint8), bitorder="little")
    return flags[:bits]


# ---- second pass: suffixes to their groups --------------------------------------------------------

_PACKED = pa.schema([("part", pa.int64()), ("raw", pa.int64()), ("packed", pa.binary())])


def pack(names: pa.Array, codes: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[int, bytes]:
    """Names and entries (codes from 1 on, 0 after the end), column after column, compressed."""
    bounds = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1]
    wide = np.uint16 if len(names) < 65535 else np.uint32
    raw = b"".join([
        np.array([len(names), len(low), codes.shape[1], np.dtype(wide).itemsize], np.int64).tobytes(),
        np.diff(bounds).astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(),
        np.ascontiguousarray(codes.T).astype(wide).tobytes(), low.astype(np.uint8).tobytes(),
        names.buffers()[2][int(bounds[0]):int(bounds[-1])].to_pybytes() if len(names) else b"",
    ])
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(size: int, packed: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    n_names, rows, depth, width = np.frombuffer(raw, np.int64, 4).tolist()
    at = 32
    parts = []
    for count, kind in ((n_names, np.uint32), (rows, np.uint32), (rows * depth, np.uint16 if width == 2 else np.uint32), (rows, np.uint8)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    ends = np.concatenate([[0], np.cumsum(parts[0])]).astype(np.int32)
    names = pa.Array.from_buffers(pa.binary(), n_names, [None, pa.py_buffer(ends), pa.py_buffer(raw[at:])])
    return names, parts[2].reshape(depth, rows).T.astype(np.int32), parts[3], parts[1]


def _combined(cols: np.ndarray, low: np.ndarray, h: np.ndarray):
    """Equal entries together, with their number; hashes only order, columns decide."""
    order = np.argsort(h, kind="stable")
    cols, low, h = cols[order], low[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (cols[1:] != cols[:-1]).any(axis=1) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    return cols[at], low[at], np.diff(np.append(at, len(h)))


def entries(t: Tokens, frequent: np.ndarray, heavy: list[np.ndarray], max_words: int):
    """Suffixes as name codes (-1 after the end), the least depth each counts for, and its group's hash.

    A suffix counts for the nodes from its shortest light prefix on; heavy prefixes of two words and more
    become entries that count for just their own node.
    """
    usable = frequent[(t.hash & np.uint64(len(frequent) - 1)).astype(np.int64)][t.code]
    goes_on = usable.copy()
    cols = np.full((len(t.code), max_words), -1, np.int32)
    cols[:, 0] = t.code
    prefix = np.zeros((len(t.code), max_words), np.uint64)
    prefix[:, 0] = t.hash[t.code]
    for k in range(1, max_words):
        goes_on = goes_on & _together(t.piece, k) & _shifted(usable, k)
        nxt = _shifted(t.code, k)
        cols[:, k] = np.where(goes_on, nxt, -1)
        prefix[:, k] = np.where(goes_on, _extend(prefix[:, k - 1], t.hash[nxt]), prefix[:, k - 1])
    some = cols[:, 1] >= 0
    cols, prefix = cols[some], prefix[some]
    low = np.zeros(len(cols), np.int64)
    found = []
    for depth in range(1, max_words + 1):
        long_enough = cols[:, depth - 1] >= 0
        still = (low == 0) & long_enough
        h = prefix[:, depth - 1]
        if depth < max_words:
            is_heavy = heavy[depth - 1][(h & np.uint64(len(heavy[depth - 1]) - 1)).astype(np.int64)]
            if depth > 1:
                node = still & is_heavy
                own = cols[node].copy()
                own[:, depth:] = -1
                found.append((*_combined(own, np.full(len(own), depth), h[node]), depth))
            still = still & ~is_heavy
        low[still] = depth
    # a suffix that ends at a heavy prefix has been counted as that node
    kept = low > 0
    cols, low, prefix = cols[kept], low[kept], prefix[kept]
    found.append((*_combined(cols, low, prefix[:, -1]), 0))
    all_cols = np.concatenate([f[0] for f in found])
    all_low = np.concatenate([f[1] for f in found])
    n = np.concatenate([f[2] for f in found])
    h = np.zeros(len(all_cols), np.uint64)
    running = None
    for depth in range(1, max_words + 1):
        c = np.maximum(all_cols[:, depth - 1], 0)
        running = t.hash[c] if running is None else _extend(running, t.hash[c])
        h = np.where(all_low == depth, running, h)
    return all_cols, all_low, n, h


def _suffixes(batch: pa.RecordBatch, frequent, heavy, max_words: int, parts: int):
    for t in _tagged(batch):
        if not len(t.code):
            continue
        cols, low, n, h = entries(t, frequent, heavy, max_words)
        part = ((mix(h) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part * len(t.hash) + cols[:, 0], kind="stable")
        cols, low, n, part = cols[order], low[order], n[order], part[order]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        place = np.zeros(len(t.hash) + 1, np.int64)
        every = t.names()
        packed = []
        for a, b in zip(begin, np.append(begin[1:], len(part))):
            mine = cols[a:b] + 1
            used = np.unique(mine)
            used = used[used > 0]
            place[used] = np.arange(1, len(used) + 1)
            packed.append(pack(every.take(pa.array(used - 1)), place[mine], low[a:b], n[a:b]))
        yield {"part": part[begin], "raw": [p[0] for p in packed], "packed": [p[1] for p in packed]}


# ---- subtrees ---------------------------------------------------------------------------------------

_NODES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("a", pa.int64())])


def subtree(table: pa.Table, max_words: int, min_count: int) -> pa.Table:
    """Nodes of at least ``min_count`` of one group, grown level by level from its suffixes."""
    codes, low, n, names = [], [], [], []
    first = 1
    for size, packed in zip(table.column("raw").to_pylist(), table.column("packed")):
        own_names, own, own_low, own_n = unpack(size, packed.as_buffer())
        names.append(own_names)
        codes.append(np.where(own > 0, own + np.int32(first - 1), np.int32(0)))
        low.append(own_low)
        n.append(own_n)
        first += len(own_names)
    spelled = pa.chunked_array(names).combine_chunks().dictionary_encode() if first > 1 else None
    lang, phrase, size, count = [], [], [], []
    if spelled is not None:
        merged = np.concatenate([[0], spelled.indices.to_numpy(zero_copy_only=False) + 1]).astype(np.int32)
        codes, low, n = merged[np.concatenate(codes)], np.concatenate(low), np.concatenate(n).astype(np.int64)
        base = len(spelled.dictionary) + 1
        node = codes[:, 0].astype(np.int64)
        for depth in range(2, max_words + 1):
            # the subtree of an entry whose light prefix is longer begins there
            grown = codes[:, depth - 1] > 0
            codes, low, n, node = codes[grown], low[grown], n[grown], node[grown]
            key, first_at, node = np.unique(node * base + codes[:, depth - 1], return_index=True, return_inverse=True)
            counted = low <= depth
            total = np.zeros(len(key), np.int64)
            np.add.at(total, node[counted], n[counted])
            often = total >= min_count
            for k in np.flatnonzero(often).tolist():
                parts = [spelled.dictionary[int(c) - 1].as_py().rsplit(b"\t", 1) for c in codes[first_at[k], :depth]]
                lang.append(parts[0][0].decode())
                phrase.append(b" ".join(p[1] for p in parts).decode())
                size.append(depth)
                count.append(int(total[k]))
            stays = often[node] | ~counted
            codes, low, n, node = codes[stays], low[stays], n[stays], node[stays]
    return pa.table([lang, phrase, pa.array(size, pa.int32()), pa.array(count, pa.int64())], schema=_NODES)


def phrase_counts(
    docs: DataFrame, min_count: int = 30, max_words: int = 4, budget: int = GROUP_BUDGET
) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n), all of them, and phrases (lang, phrase, words, a) of ``min_count`` and more."""
    source = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    suffixes = max(size // 5, 1)
    cells = 1 << max(10, min(MOST_CELLS, 16 * suffixes // budget).bit_length())
    counts = cut(source.mapInArrow(
        by_batch(lambda batch: _prefix_counts(batch, max_words, cells), _COUNTS),
        "lang string, word string, h long, level int, cell int, n long",
    ).groupBy("lang", "word", "level", "cell").agg(F.max("h").alias("h"), F.sum("n").alias("n")))
    single = counts.filter("level = 1")
    below = counts.select(
        "level", F.when(F.col("level") == 1, F.col("h").bitwiseAND(F.lit(cells - 1).cast("long"))).otherwise(
            F.col("cell").cast("long")).alias("bit"), "n"
    ).groupBy("level", "bit").agg(F.sum("n").alias("n")).filter(F.col("n") > budget // 4)
    heavy = [_bitmap(below.filter(F.col("level") == level), cells) for level in range(1, max_words)]
    frequent = _bitmap(single.filter(F.col("n") >= min_count).select(
        F.col("h").bitwiseAND(F.lit((1 << WORD_BITS) - 1).cast("long")).alias("bit")
    ), 1 << WORD_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(
        (np.packbits(frequent), [np.packbits(flags) for flags in heavy])
    )
    parts = max(1, -(-2 * suffixes // budget))

    def suffixes_of(batches):
        packed, packed_heavy = shared.value
        flags = np.unpackbits(packed).view(bool)
        heavies = [np.unpackbits(p).view(bool) for p in packed_heavy]
        return by_batch(lambda batch: _suffixes(batch, flags, heavies, max_words, parts), _PACKED)(batches)

    nodes = cut(source.mapInArrow(
        suffixes_of, "part long, raw long, packed binary"
    ).repartition(parts, "part").groupBy("part").applyInArrow(
        lambda table: subtree(table, max_words, min_count), "lang string, phrase string, words int, a long"
    ))
    return single.select("lang", "word", "n"), nodes


# ---- scores -------------------------------------------------------------------------------------------

def collocations(
    docs: DataFrame, min_count: int = 30, max_words: int = 4, absorb_percent: int = 80, top: int = 2000,
    budget: int = GROUP_BUDGET,
) -> DataFrame:
    """The first ``top`` phrases per language: lang, rank, phrase, a, l, r, n, score."""
    c = F.col
    single, nodes = phrase_counts(docs, min_count, max_words, budget)
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    known = nodes.select("lang", "phrase", c("a").alias("f")).unionByName(
        single.filter(c("n") >= min_count).select("lang", c("word").alias("phrase"), c("n").alias("f"))
    )
    # every way to cut a phrase in two
    listed = nodes.withColumn("w", F.split("phrase", " "))
    cuts = listed.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), c("k")), " ").alias("left"),
        F.array_join(F.slice("w", c("k") + 1, c("words") - c("k")), " ").alias("right"),
    )
    one = known.select("lang", c("phrase").alias("left"), c("f").alias("l"))
    other = known.select("lang", c("phrase").alias("right"), c("f").alias("r"))
    score = F.expr("2000000BD * cast(a as decimal(20, 0)) div cast(l + r as decimal(20, 0))").cast("long")
    best = cuts.join(one, ["lang", "left"]).join(other, ["lang", "right"]).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    )
    # what lies inside longer phrases
    spans = listed.filter("words > 2").select("lang", "a", "words", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("k")).select(
        "lang", "a", "w", "k", F.explode(F.expr("sequence(1, words - k + 1)")).alias("at")
    ).select("lang", F.array_join(F.slice("w", c("at"), c("k")), " ").alias("phrase"), "a")
    longer = spans.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(
        c("most").isNull()
        | (c("most").cast("decimal(20,0)") * 100 < c("a").cast("decimal(20,0)") * absorb_percent)
    )
    order = Window.partitionBy("lang").orderBy(c("cut.score").desc(), c("a").desc(), c("phrase"))
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(c("rank") <= top).join(
        totals, "lang"
    ).select("lang", "rank", "phrase", "a", c("cut.l").alias("l"), c("cut.r").alias("r"), "n", c("cut.score").alias("score"))


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP11_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\\x0A-\\x0D]+')) as piece
  from documents
), lists as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from lists group by lang),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
runs as (
  select lang, unnest(range(1, 5)) as k, w, i from places
), counted as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, cast(count(*) as bigint) as f
  from runs where i + k - 1 <= len(w) group by all having count(*) >= 30
), candidates as (select lang, k as words, phrase, string_split(phrase, ' ') as w, f as a from counted where k > 1),
cuts as (select *, unnest(range(1, words)) as c from candidates),
scored as (
  select x.lang, x.phrase, x.a, x.c, l.f as l, r.f as r,
    cast((cast(2000000 as hugeint) * x.a) // (l.f + r.f) as bigint) as score
  from cuts x
  join counted l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:x.c], ' ')
  join counted r on r.lang = x.lang and r.phrase = array_to_string(x.w[x.c + 1:x.words], ' ')
), best as (
  select lang, phrase, a, l, r, score from scored
  qualify row_number() over (partition by lang, phrase order by score, c) = 1
), lengths as (select lang, words, w, a, unnest(range(2, words)) as k from candidates where words > 2),
spans as (select lang, a, w, k, unnest(range(1, words - k + 2)) as s from lengths),
longer as (select lang, array_to_string(w[s:s + k - 1], ' ') as phrase, max(a) as most from spans group by all),
kept as (
  select b.* from best b left join longer g on g.lang = b.lang and g.phrase = b.phrase
  where g.most is null or 100 * cast(g.most as hugeint) < 80 * cast(b.a as hugeint)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select r.lang, rank, phrase, a, l, r, t.n, score from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""
