"""Every operator on odd input, against plain versions; empty tables and clashing columns too."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paisaflow.llm import (
    components, decontamination, exact_dedup, line_dedup, mixing, near_dedup, quality, sharding,
    substring_dedup, suffix_array_dedup, toxicity,
)
from tests.llm import brute


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def test_near_dedup(table, odd_rows):
    got = tuples(near_dedup.near_dedup(table(odd_rows, extra=True), 4, 80), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(odd_rows, 4, 80), key=str)


def test_near_dedup_large_group_of_near_copies(table):
    chance = random.Random(5)
    base = [f"w{chance.randrange(10 ** 6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(chance.randrange(0, 5)):
            words[chance.randrange(len(words))] = f"v{chance.randrange(10 ** 6)}"
        rows.append((1000 - i, " ".join(words), "en", "a", 0))
    got = tuples(near_dedup.near_dedup(table(rows), 4, 80), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(rows, 4, 80), key=str)


def test_near_dedup_just_under_the_threshold_makes_few_pairs(table, monkeypatch):
    chance = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    fresh = iter(f"x{i}" for i in range(10 ** 6))
    rows = [(0, " ".join(base), "en", "a", 0)]
    for i in range(1, 300):
        words = list(base)
        for at in chance.sample(range(5, 115), chance.choice([1, 2, 3, 3, 4, 5])):
            words[at] = next(fresh)
        rows.append((i, " ".join(words), "en", "a", 0))
    made = []
    plain = near_dedup.likely_pairs

    def counted(pairs, sketches, percent):
        made.append(pairs.count())
        return plain(pairs, sketches, percent)

    monkeypatch.setattr(near_dedup, "likely_pairs", counted)
    got = tuples(near_dedup.near_dedup(table(rows), 4, 80), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(rows, 4, 80), key=str)
    assert sum(made) < 20 * len(rows)


def test_built_words_are_told_apart(table):
    """Words of one polynomial hash (a Thue-Morse word and its complement) have nothing in common."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 4), "en", "a", 0), (2, " ".join([two] * 4), "en", "a", 0)]
    got = tuples(near_dedup.near_dedup(table(rows), 4, 80), "doc_id", "component_id")
    assert got == [(1, 1), (2, 2)]


def test_survivors_are_one_of_each_component(table, odd_rows):
    docs = table(odd_rows, extra=True)
    kept = near_dedup.survivors(docs, 5, 80)
    assert kept.columns == docs.columns
    named = near_dedup.survivors(docs.withColumn("__own", F.lit("mine")), 5, 80)
    assert {r["__own"] for r in named.collect()} == {"mine"}
    got = [r for r in kept.collect()]
    want = {c for _, n, c in brute.components(odd_rows, 5, 80) if n}
    with_words = [r["doc_id"] for r in got if brute.shingles(r["text"], 5)]
    assert sorted(with_words, key=str) == sorted(want, key=str)


def test_estimate_follows_similarity():
    chance = np.random.default_rng(1)
    pool = chance.integers(0, 2 ** 64 - 1, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    regs = near_dedup.registers([a, b])
    likely, used = near_dedup.estimate(regs[:1], regs[1:], np.array([2000.0]), np.array([2000.0]))
    assert used[0] == near_dedup.REGISTERS and abs(likely[0] - 0.6) < 0.15


def test_components(spark):
    chance = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + chance.randrange(30), 100 + chance.randrange(30)) for _ in range(25)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert got == {x: root(x) for x in parent if root(x) != x}


@pytest.mark.parametrize("limit", [None, 200])
def test_suffix_array(table, odd_rows, limit):
    got = tuples(suffix_array_dedup.dedup(table(odd_rows, extra=True), limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.byte_repeats(odd_rows), key=str)


@pytest.mark.parametrize("limit", [None, 200])
def test_substring(table, odd_rows, limit):
    got = tuples(substring_dedup.dedup(table(odd_rows, extra=True), limit), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.word_repeats(odd_rows), key=str)


def test_long_runs_of_one_symbol_of_every_length(table):
    """One window in pieces of 1 to 2,048 windows, together over the 2**21 symbols an index can hold."""
    rows = [(i, "A" * (50 + i), "en", "a", 0) for i in range(2048)]
    got = suffix_array_dedup.dedup(table(rows)).collect()
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {
        (i, 50 + i, 50 + i if i else 0, int(i > 0)) for i in range(2048)
    }
    rows = [(i, "a " * (35 + i), "en", "a", 0) for i in range(2048)] + [(5000, "b " * 35, "en", "a", 0), (5001, "c " * 36, "en", "a", 0)]
    got = substring_dedup.dedup(table(rows)).collect()
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in got} == {
        *((i, 35 + i, 35 + i) for i in range(2048)), (5000, 35, 0), (5001, 36, 36)
    }


@pytest.mark.parametrize("limit", [60, 2000])
def test_runs_settled_without_an_index(table, limit):
    chance = random.Random(11)
    rows = []
    for i in range(60):
        runs = [chance.choice("AB") * chance.choice([5, 49, 50, 51, 80, 130]) + chance.choice(["", "x", "some more text"]) for _ in range(3)]
        rows.append((chance.choice([None, *range(40)]), "".join(runs), "en", "a", 0))
    got = tuples(suffix_array_dedup.dedup(table(rows), limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.byte_repeats(rows), key=str)
    rows = [(r[0], " ".join(r[1]), "en", "a", 0) for r in rows] + [(900, "once " * 35, "en", "a", 0), (901, "twice " * 36, "en", "a", 0)]
    got = tuples(substring_dedup.dedup(table(rows), limit), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.word_repeats(rows), key=str)


def test_open_boundaries_equal_common_prefixes():
    from paisaflow.llm.repeats import sort_suffixes

    chance = np.random.default_rng(4)
    symbol = chance.integers(1, 4, 500).astype(np.int64)
    symbol[[99, 260, 499]] = 0
    ends = np.flatnonzero(symbol == 0)
    left = ends[np.searchsorted(ends, np.arange(500))] - np.arange(500)
    order, _ = sort_suffixes(symbol, left, 1, 16)
    got = suffix_array_dedup.open_boundaries(symbol, order, 6)
    piece = [symbol[i:i + left[i]].tolist() for i in range(500)]
    for k in range(1, 500):
        a, b = piece[order[k - 1]], piece[order[k]]
        assert a <= b
        assert got[k] == (len(a) >= 6 and a[:6] == b[:6])


def test_open_boundaries_go_on_from_the_ranks_of_the_sort():
    """One round from boundaries closed below 32 says the same as rounds from the first symbol on."""
    from paisaflow.llm.repeats import dense_ranks, sort_suffixes

    chance = np.random.default_rng(5)
    symbol = np.tile(chance.integers(1, 4, 120), 30).astype(np.int64)
    symbol[chance.integers(0, len(symbol), 40)] = 9
    symbol[[700, 1900, 2500, -1]] = 0
    n, ends = len(symbol), np.flatnonzero(symbol == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    rank = dense_ranks(symbol)
    assert rank.tolist() == (np.unique(symbol, return_inverse=True)[1] + 1).tolist()
    order, levels = sort_suffixes(rank * (symbol > 0), left, 1, 51)
    piece = [tuple(symbol[i:i + left[i]]) for i in order]
    want = [False] + [len(b) >= 50 and a[:50] == b[:50] for a, b in zip(piece, piece[1:])]
    known, ranks = next(level for level in levels if level[0] == 32)
    closed = np.ones(n, bool)
    closed[1:] = (np.diff(ranks[order]) != 0) | (left[order[1:]] < known)
    assert suffix_array_dedup.open_boundaries(symbol, order, 50, closed, known).tolist() == want
    assert suffix_array_dedup.open_boundaries(symbol, order, 50).tolist() == want
    assert 100 < sum(want) < n - 100


def test_exact_dedup(table, odd_rows):
    docs = table(odd_rows, extra=True)
    from pyspark.sql import functions as F

    for new in (F.col("doc_id") % 2 == 1, F.lit(True), F.lit(False)):
        got = tuples(exact_dedup.dedup(docs, new), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
        groups = {}
        plain = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        for r in odd_rows:
            groups.setdefault(plain(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0]))
        want = []
        for r in odd_rows:
            own = groups[plain(r[1])]
            best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
            want.append((r[0], best[2], len(own), r[0] == best[2] and -len(r[1] or "") == best[0], brute.sha(plain(r[1]))))
        assert got == sorted(want, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 30000])
def test_static_filter(n):
    chance = np.random.default_rng(n)
    keys = np.unique(chance.integers(0, 2 ** 63, n).astype(np.uint64))
    built = exact_dedup.build_filter(keys)
    assert exact_dedup.filter_contains(keys, *built).all()
    other = chance.integers(0, 2 ** 63, 20000).astype(np.uint64)
    assert exact_dedup.filter_contains(other, *built).mean() < 0.02
    assert n < 1000 or len(built[3]) < 1.4 * n + 200


def test_decontamination(spark, table, odd_rows):
    passage = odd_rows[5][1]
    items = [(1, " ".join(passage.split()[10:25])), (2, "ONE"), (3, None), (4, ""), (None, "one two"), (5, "nowhere at all"),
             (12, " ".join(passage.split()[10:25])), (6, "ärger été"), (7, "same " * 30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = tuples(decontamination.decontaminate(table(odd_rows, extra=True), benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(odd_rows, items), key=str)
    docs = table(odd_rows, extra=True)
    clean = decontamination.clean(docs, benchmark)
    assert clean.columns == docs.columns
    bad = {(x[0], x[5]) for x in brute.contamination(odd_rows, items)}
    assert clean.count() == sum((r[0], True) not in bad or (r[0], False) in bad and r[1] is None for r in odd_rows)


def test_decontamination_in_blocks(spark, table, odd_rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 7)
    items = [(i, odd_rows[5][1][i:i + 200]) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = tuples(decontamination.decontaminate(table(odd_rows), benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(odd_rows, items), key=str)


def test_decontamination_is_native(spark, table, odd_rows):
    import inspect

    code = inspect.getsource(decontamination)
    assert "pandas" not in code and "mapIn" not in code and ".rdd" not in code and "udf" not in code


def test_lines(table, odd_rows):
    rows = [(i, f"Header\nown {i}\n  Footer \nsame", "en", f"s{i % 7}" if i % 7 else None, 0) for i in range(30)]
    rows += [(100 + i, "rare line\nrare line", "en", "s1", 0) for i in range(20)] + odd_rows
    got = {(r["doc_id"], r["n_lines"], r["n_removed"], r["kept"]) for r in line_dedup.dedup_lines(table(rows, extra=True), 5).collect()}
    sites = {}
    for r in rows:
        for line in (r[1] or "").split("\n"):
            sites.setdefault(line.strip(" \t\n\x0b\x0c\r"), set()).add(r[3])
    want = set()
    for r in rows:
        lines = r[1].split("\n") if r[1] else []
        gone = [bool(x.strip(" \t\n\x0b\x0c\r")) and len(sites[x.strip(" \t\n\x0b\x0c\r")]) >= 5 for x in lines]
        want.add((r[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    assert got == want


def test_mixing(table, odd_rows):
    rows = odd_rows + [(500 + i, "word " * (i % 40), "en", "hot", 0) for i in range(150)]
    docs = table(rows, extra=True)
    placed, pieces = mixing.mix(docs, block=16)
    got = mixing.taken_words(placed, pieces).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    per = got.assign(source=got.source.fillna("~null")).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), s=("source_size", "first"))
    assert (per["size"] == per.s).all() and (abs(per.taken - per.target) < 1).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6 * per.target.sum()
    # water level: sources under their limit get target in proportion to weight
    weight = dict(zip(sorted(per.index), [5, 2, 1] * 3))
    level = {round(r.target / weight[k], 6) for k, r in per.iterrows() if r.target < 2 * r.s}
    assert len(level) <= 1
    assert all(2 * r.s <= max(level, default=1e18) * weight[k] + 1e-6 for k, r in per.iterrows() if r.target >= 2 * r.s)
    schedule = sorted((r["slot"], r["source"] or "~null") for r in pieces.select("slot", "source").distinct().collect())
    # any stretch holds the sources near their shares
    third = [s for _, s in schedule[:len(schedule) // 3]]
    hot = sum(s == "hot" for _, s in schedule) / len(schedule)
    assert abs(third.count("hot") / len(third) - hot) < 0.1
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns


def test_schedule_rank_is_the_rank():
    bits, cuts = 7, [0, 3, 50, 51, 110]
    for lo, hi in zip(cuts, cuts[1:]):
        n = hi - lo
        out = mixing.schedule_rank(np.arange(lo, hi), np.full(n, lo), np.full(n, hi), np.full(n, bits))
        assert list(out["slot"].rank().astype(int) - 1) == list(out["rank"])
        assert all(int(format(p, "07b")[::-1], 2) == s for p, s in zip(range(lo, hi), out["slot"]))


def test_sharding(table, odd_rows):
    chance = random.Random(1)
    rows = odd_rows + [(500 + i, "copy of one text", "en", "a", 0) for i in range(900)]
    rows += [(2000 + i, f"{i} " * chance.randrange(1, 60), "en", "b", 0) for i in range(1500)]
    got = sharding.sharded(table(rows, extra=True)).toPandas()
    assert len(got) == len(rows) and got["shard"].between(0, 23).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    again = sharding.sharded(table(rows, extra=True)).toPandas()
    key = ["doc_id", "size", "shard", "slot"]
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))


def test_sharding_is_level_and_keeps_small_groups():
    chance = np.random.default_rng(1)
    items = chance.pareto(2, (4000, 3)) + 0.1
    at = sharding.pack(items)
    sums = np.stack([items[at == s].sum(axis=0) for s in range(24)])
    assert (sums[:, 0].max() / sums[:, 0].mean()) < 1.01


def test_sharding_is_level_with_null_and_repeated_ids(table):
    chance = random.Random(3)
    for hot in (None, 7):
        rows = [(hot, "hot " * 25, "en", "a", 0) for _ in range(2000)]
        rows += [(5000 + i, f"{i} " * chance.randrange(1, 60), "en", "b", 0) for i in range(4000)]
        sums = sharding.sharded(table(rows)).toPandas().groupby("shard")["size"].sum()
        assert len(sums) == sharding.SHARDS and sums.max() < 1.01 * sums.mean() and sums.min() > 0.99 * sums.mean()


def test_sharding_keeps_its_law(table):
    """Bytes near equal over shards, with many copies and one group of many shards' bytes."""
    import zlib

    chance = random.Random(2)
    rows = [(i, "copy of one text", "en", "a", 0) for i in range(900)]
    rows += [(2000 + i, "hot " * 25, "en", "a", 0) for i in range(2000)]
    rows += [(5000 + i, f"{i} " * chance.randrange(1, 60), "en", "b", 0) for i in range(4000)]
    got = sharding.sharded(table(rows, extra=True)).toPandas()
    sums = got.groupby("shard")["size"].sum()
    hot = got[got["doc_id"].between(2000, 3999)]
    assert hot["size"].sum() > sums.mean() and hot["shard"].nunique() > 1
    assert len(sums) == sharding.SHARDS and sums.max() < 1.01 * sums.mean() and sums.min() > 0.99 * sums.mean()
    assert set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    text = {r[0]: r[1].encode() for r in rows}
    assert all(c == zlib.crc32(text[i]) and n == len(text[i]) + 8 for i, c, n in zip(got["doc_id"], got["text_crc32"], got["size"]))


def labelled(spark, table):
    chance = random.Random(8)
    calm = "the of and house river morning bread window paper road cloud stone green quiet".split()
    rows, labels = [], []
    for i in range(600):
        words = [chance.choice(calm) for _ in range(chance.randrange(20, 60))]
        bad, junk = i % 7 == 0, i % 5 == 0
        if bad:
            words[3:3] = ["You", "stupid", "idiot,"]
        text = " ".join(words)
        if junk:
            text = " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", "a", 0))
        labels.append((i, int(not junk), int(bad)))
    labels += [(None, 1, 1), (5, None, None), (10 ** 6, 1, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sample_has_one_row_per_id(spark, table):
    from paisaflow.llm.labelled import training_sample

    rows = [(7, f"text {i}" if i else None, "en", "a", 0) for i in range(300)] + [(8, "other", "en", "a", 0)]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    never = exact_dedup.F.lit(False)
    got = [tuples(training_sample(table(rows).repartition(n), labels, "toxic", never, 10), "doc_id", "text", "label") for n in (1, 5)]
    assert [(r[0], r[2]) for r in got[0]] == [(7, 1), (8, 0)] and got[0] == got[1]


def accuracy(got, rows, wanted):
    label = {r[0]: wanted(r[0]) for r in rows}
    return sum(label[i] == (s >= 0.3) for i, s in got) / len(got)


def test_toxicity(spark, table, odd_rows):
    rows, labels = labelled(spark, table)
    docs, held = table(rows, extra=True), toxicity.held_out(4, 2)
    model = toxicity.fit(toxicity.training_sample(docs, labels, "toxic", held, 1000))
    out = toxicity.score(docs, model).filter(held).collect()
    assert accuracy([(r["doc_id"], r["score"]) for r in out], rows, lambda i: i % 7 == 0) > 0.95
    odd = toxicity.score(table(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    again = toxicity.fit(toxicity.training_sample(docs.repartition(5), labels, "toxic", held, 1000))
    assert np.array_equal(model.weight, again.weight) and np.array_equal(model.factor, again.factor)


def test_machine_learns_interactions():
    """One of two terms, but not both: no sum of single weights can tell."""
    chance = np.random.default_rng(2)

    def made(n):
        row, term, label = [], [], []
        for i in range(n):
            a, b = (bool(x) for x in chance.random(2) < 0.5)
            own = [10] * a + [11] * b + list(chance.integers(20, 60, 5))
            row += [i] * len(own)
            term += own
            label.append(float(a != b))
        return np.array(row), np.array(term), np.array(label)

    model = toxicity.fit_machine(*made(3000))
    row, term, label = made(1000)
    assert ((toxicity.scores(model, 1000, row, term) > 0.5) == label).mean() > 0.95


def test_quality(spark, table, odd_rows):
    rows, labels = labelled(spark, table)
    docs = table(rows, extra=True)
    net = quality.trained(docs, labels)
    kept = quality.filtered(docs, net)
    assert kept.columns == docs.columns
    assert accuracy([(r["doc_id"], r[quality.SCORE]) for r in quality.score(docs, net).collect()], rows, lambda i: i % 5 != 0) > 0.97
    odd = quality.score(table(odd_rows), net).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r[quality.SCORE] <= 1 for r in odd)


def test_word_vectors_cover_all_documents(spark, table, odd_rows):
    import pyarrow as pa

    rows, labels = labelled(spark, table)
    rows = rows + odd_rows + [(10 ** 7 + i, "never labelled words stand here", "en", "a", 0) for i in range(3)]
    net = quality.trained(table(rows, extra=True).repartition(4), labels)
    at, sign = quality.index_vectors(np.arange(1 << quality.WORD_BITS, dtype=np.uint64) + np.uint64(1 << 40), quality.DIMENSIONS)
    want = np.zeros(net.vectors.shape)
    for r in rows:
        own = [p for c in quality.chunks(pa.array([r[1]], pa.string())) for p in quality.text_words(c)[1].tolist()]
        for i, word in enumerate(own):
            for other in own[max(0, i - quality.REACH):i] + own[i + 1:i + 1 + quality.REACH]:
                for k in range(quality.NONZERO):
                    want[word, at[other, k]] += sign[other, k]
    size = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(net.vectors, want / np.where(size > 0, size, 1), atol=1e-5)
    new = [p for c in quality.chunks(pa.array([rows[-1][1]])) for p in quality.text_words(c)[1].tolist()]
    assert np.allclose(np.linalg.norm(net.vectors[new], axis=1), 1, atol=1e-4)


def test_empty_tables(spark, table):
    none = table([])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = table([(1, "one two three", "en", "a", 13)])
    for df in (
        near_dedup.near_dedup(none), suffix_array_dedup.dedup(none), substring_dedup.dedup(none),
        line_dedup.dedup_lines(none), decontamination.decontaminate(none, benchmark),
        mixing.taken_words(*mixing.mix(none)), sharding.sharded(none), near_dedup.survivors(none),
        exact_dedup.dedup(none, exact_dedup.F.lit(True)), quality.filtered(none, quality.trained(none, labels)),
        toxicity.score(none, toxicity.fit(toxicity.training_sample(none, labels, "toxic", toxicity.held_out(4, 2), 10))),
    ):
        assert df.collect() == []
    assert decontamination.decontaminate(some, benchmark).collect()[0]["n_hit"] == 0
    assert quality.filtered(some, quality.trained(some, labels)).count() == 1
    assert toxicity.score(some, None).collect()[0]["score"] == 0
