"""Benchmark passages in documents: an exact containment join with prefix filtering.

An item's windows of ten words (an item of fewer words is one window) are looked for in whole texts.
A window is contained only if every one of its shingles is, so under a rarity order one prefix
token is necessary and enough to find candidates: its rarest shingle of three words.

1. One pass over the corpus counts the benchmark's shingles in it. Each window takes its rarest;
   a window with a shingle that never occurs cannot occur itself and is dropped.
2. A second pass joins every document position with the chosen shingles. The shingle's place in
   the window gives the window's start and end, which must lie within the text (positional and
   length bounds), and then all words are compared. This happens in the generated code of the
   scan: a position that is no occurrence leaves no row, and the text is never shuffled.

The passes use DataFrame functions only. The side of the windows is broadcast in blocks of
``BLOCK_WINDOWS``, so its size is bounded whatever the benchmark's size; another block is another
pass. A shingle of the benchmark that a third of the corpus holds costs a comparison where it
stands, no shuffle.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Null or empty texts have no
words and no hits; null or empty items have no windows. An item with a null ``item_id`` marks words
but is neither counted nor listed. Rows that repeat ``doc_id`` and text are one document and give
one row. Empty tables give empty results, an empty benchmark no hits; other columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.llm.frames import documents
from paisaflow.session import cut

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
BLOCK_WINDOWS = 50_000
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _folded(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _shingle_key(words: str, at: Column, size: int) -> Column:
    """A hash of ``size`` words from ``at``; ``lower`` may join more than A-Z does, never less."""
    return F.xxhash64(*[F.lower(F.get(words, at + k)) for k in range(size)])


def _raw_words(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), _BETWEEN)


def item_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, words, len, span), and which items have them."""
    split = benchmark.select("item_id", F.array_remove(F.split(_folded(F.coalesce("text", F.lit(""))), _BETWEEN), "").alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = cut(split.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at")).select(
        "item_id", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("span")
    ))
    windows = cut(each.select("span").distinct().withColumn("w", F.split("span", " ")).withColumns({
        "len": F.size("w"), "q": F.least(F.size("w"), F.lit(SHINGLE_WORDS)),
        "window_id": F.monotonically_increasing_id(),
    }))
    owners = each.filter("item_id is not null").distinct().join(windows.select("span", "window_id"), "span").select(
        "window_id", F.col("item_id").cast("string").alias("item")
    )
    return windows, owners


def _positions(docs: DataFrame, size: int) -> DataFrame:
    """Every word position of every text with the key of the shingle that starts there."""
    return docs.select("doc_id", F.xxhash64("text").alias("fp"), _raw_words("text").alias("w")).select(
        "doc_id", "fp", "w", F.posexplode("w").alias("pos", "_word")
    ).withColumn("key", _shingle_key("w", F.col("pos"), size))


def _shingles(windows: DataFrame, size: int) -> DataFrame:
    places = F.sequence(F.lit(0), F.col("len") - size)
    return windows.filter(F.col("q") == size).select("window_id", "w", F.explode(places).alias("off")).select(
        "window_id", "off", _shingle_key("w", F.col("off"), size).alias("key")
    )


def _blocks(table: DataFrame) -> list[DataFrame]:
    """``table`` in parts small enough to broadcast, by a hash of ``key``."""
    parts = max(1, -(-table.count() // BLOCK_WINDOWS))
    return [
        F.broadcast(table.filter(F.pmod(F.hash("key"), F.lit(parts)) == i) if parts > 1 else table)
        for i in range(parts)
    ]


def prefix_tokens(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Each window that can occur with its rarest shingle: window_id, key, off, len, span."""
    shingles = cut(_shingles(windows, size))
    counts = [
        _positions(docs, size).join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
        for keys in _blocks(cut(shingles.select("key").distinct()))
    ]
    rarity = cut(reduce(DataFrame.unionByName, counts))
    ranked = shingles.join(rarity, "key", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "key", "off")).alias("rarest")
    ).filter("rarest.n > 0")
    return cut(ranked.join(windows, "window_id").select(
        "window_id", "rarest.key", "rarest.off", "len", "span"
    ))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, n_words, start, len, window_id) of verified occurrences, and the windows' items.

    Each document also has a row without a window, which carries its number of words.
    """
    windows, owners = item_windows(benchmark, window)
    sizes = sorted({r["q"] for r in windows.select("q").distinct().collect()} | {SHINGLE_WORDS})
    blank = lambda at: F.when(F.element_at("w", at) == "", 1).otherwise(0)
    n_words = F.greatest(F.size("w") - blank(1) - blank(-1), F.lit(0)).cast("bigint")
    found = []
    for size in sizes:
        for block in _blocks(prefix_tokens(docs, windows, size)):
            start = F.col("pos") - F.col("off")
            fits = (start >= 0) & (start + F.col("len") <= F.size("w"))
            same = _folded(F.array_join(F.slice("w", start + 1, F.col("len")), " ")) == F.col("span")
            hit = F.col("window_id").isNotNull() & fits & F.when(fits, same).otherwise(False)
            first = F.lit(not found) & (F.col("pos") == 0)
            joined = _positions(docs, size).join(block, "key", "left" if not found else "inner")
            found.append(joined.withColumn("hit", hit).filter(F.col("hit") | first).select(
                "doc_id", "fp", n_words.alias("n_words"), F.when(F.col("hit"), start).alias("start"),
                F.when(F.col("hit"), F.col("len")).alias("len"),
                F.when(F.col("hit"), F.col("window_id")).alias("window_id"),
            ))
    return cut(reduce(DataFrame.unionByName, found)), owners


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """One row per document: doc_id, fp, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, owners = occurrences(docs, benchmark, window)
    spans = F.sort_array(F.collect_set(F.when(
        F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("stop"))
    )))
    # words under at least one span, the spans in order: what each adds past the furthest end
    state = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        "spans", state, lambda a, s: F.struct(
            F.greatest(a["stop"], s["stop"]).alias("stop"),
            (a["n"] + F.greatest(s["stop"] - F.greatest(a["stop"], s["start"]), F.lit(0))).alias("n"),
        ), lambda a: a["n"],
    )
    counted = hits.groupBy("doc_id", "fp").agg(F.max("n_words").alias("n_words"), spans.alias("spans")).select(
        "doc_id", "fp", "n_words", covered.alias("n_hit")
    )
    items = hits.filter("window_id is not null").select("doc_id", "fp", "window_id").distinct().join(
        owners, "window_id"
    ).groupBy(F.col("doc_id").alias("i_doc"), F.col("fp").alias("i_fp")).agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(
        items, F.col("doc_id").eqNullSafe(F.col("i_doc")) & (F.col("fp") == F.col("i_fp")), "left"
    ).select(
        "doc_id", "fp", "n_words", "n_hit", F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns."""
    bad = decontaminate(docs, benchmark, window).filter("contaminated").select(
        F.col("doc_id").alias("__id"), F.col("fp").alias("__fp")
    )
    return docs.withColumn("__own", F.xxhash64("text")).join(
        bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp")), "left_anti"
    ).drop("__own")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("fp")


OP1_SQL = """
with fold as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as up, 'abcdefghijklmnopqrstuvwxyz' as low),
docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents, fold
), items as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), up, low),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark, fold
), windows as (
  select distinct item_id, least(len(w), 10) as n,
    unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) as span
  from items where len(w) > 0
), lengths as (select distinct n from windows),
places as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as at_word from docs, lengths where len(w) >= n
), hits as (
  select p.doc_id, p.at_word, p.n, x.item_id
  from places p join windows x on x.n = p.n and x.span = array_to_string(p.w[p.at_word:p.at_word + p.n - 1], ' ')
), words as (
  select doc_id, count(distinct pos) as n_hit
  from (select doc_id, unnest(range(at_word, at_word + n)) as pos from hits) group by doc_id
), owners as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from docs d left join words using (doc_id) left join owners using (doc_id)
"""
