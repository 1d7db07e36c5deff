"""Jaccard join by token-pair prefixes: components against all pairs, keys against every linked pair."""

import random
from collections import Counter

import numpy as np
import pytest

from paisaflow.llm import hubs, ngram_join as nj
from tests.llm import brute
from tests.llm.conftest import rows_of


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def expected(rows, shingle=5, percent=80):
    return sorted(brute.components(rows, shingle, percent), key=repr)


def edited(base, chance, edits, vocabulary):
    """``base`` with words replaced, dropped or put in, so that some copies lie over and some under the threshold."""
    out = list(base)
    for _ in range(edits):
        at, how = chance.randrange(len(out)), chance.random()
        word = chance.choice(vocabulary)
        if how < 0.5:
            out[at] = word
        elif how < 0.75:
            out.insert(at, word)
        elif len(out) > 1:
            del out[at]
    return " ".join(out)


@pytest.mark.parametrize("seed,size,edits,words", [(1, 60, 6, 40), (2, 30, 3, 5), (3, 12, 2, 3), (4, 70, 7, 4000)])
def test_groups_of_near_copies(spark, table, seed, size, edits, words):
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    texts = []
    for _ in range(4):
        base = [chance.choice(vocabulary) for _ in range(size)]
        second = edited(base, chance, edits, vocabulary).split()
        texts += [edited(chance.choice([base, base, second]), chance, chance.randrange(edits + 1), vocabulary) for _ in range(25)]
    chance.shuffle(texts)
    rows = rows_of(texts)
    assert answer(nj.ngram_join(table(rows, extra=True).repartition(5))) == expected(rows)


def test_odd_rows(spark, table, odd_rows):
    for shingle, percent in ((5, 80), (3, 90), (2, 55)):
        assert answer(nj.ngram_join(table(odd_rows, extra=True).repartition(4), shingle, percent)) == expected(odd_rows, shingle, percent)


@pytest.mark.parametrize("common,part", [(20_000, 1 << 19), (3, 50), (1, 7)])
def test_shared_shingles_travel_packed(spark, table, monkeypatch, common, part):
    """Profiles are those of a plain count, common shingles kept apart or not, and no shingle becomes a row."""
    monkeypatch.setattr(nj, "COMMON", common)
    monkeypatch.setattr(nj, "PART_SHINGLES", part)
    plans, plain = [], nj.cut
    monkeypatch.setattr(nj, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or plain(df))
    chance = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[chance.choice(vocabulary) for _ in range(40)] for _ in range(5)]
    texts = [edited(chance.choice(bases), chance, chance.randrange(4), vocabulary) for _ in range(60)]
    texts += [" ".join(chance.choice(vocabulary) for _ in range(40)) for _ in range(20)]
    texts += [edited(texts[0].split(), chance, 12, vocabulary) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*docs, docs[0], docs[7]], "cid long, text string").repartition(4)
    got = {r.cid: r for r in nj.profiles(frame, 3, 80).collect()}
    assert not any("Generate" in plan for plan in plans)
    left = {i: brute.shingles(t, 3) for i, t in docs}
    n = {i: len(s) for i, s in left.items()}
    for _ in range(20):
        df = Counter(x for s in left.values() for x in s)
        left = {i: s for i, s in left.items() if 100 * sum(df[x] > 1 for x in s) >= 80 * n[i]}
    # further rounds could drop more, and what stays must keep all shingles it shares
    assert left.keys() <= got.keys()
    if common == 20_000:
        df = Counter(x for s in left.values() for x in s)
        for i, s in left.items():
            assert got[i].n == n[i] and len(got[i].tokens) >= sum(df[x] > 1 for x in s)
            assert sorted(zip(got[i].df, got[i].tokens)) == list(zip(got[i].df, got[i].tokens))
    known = {}
    for r in got.values():
        assert len(set(r.tokens)) == len(r.tokens)
        for token, number in zip(r.tokens, r.df):
            assert known.setdefault(token, number) == number


def test_large_group_under_the_threshold_makes_few_pairs(spark, table, monkeypatch):
    """Thousands of copies, most just under the threshold to each other, are told apart without all pairs."""
    chance = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    fresh = iter(f"x{i}" for i in range(10 ** 6))
    texts = [" ".join(base)]
    for _ in range(400):
        own = list(base)
        for at in chance.sample(range(5, 115), chance.choice([1, 2, 3, 3, 4, 4])):
            own[at] = next(fresh)
        texts.append(" ".join(own))
    rows = rows_of(texts)
    made = []
    plain = hubs.compared

    def counted(pairs, sets):
        made.append(pairs.count())
        return plain(pairs, sets)

    monkeypatch.setattr(hubs, "compared", counted)
    assert answer(nj.ngram_join(table(rows).repartition(4))) == expected(rows)
    assert sum(made) < 20 * len(rows)


def test_linked_sets_share_a_key():
    """Any two sets over the threshold, with any mix of rare and frequent shingles, meet under a key."""
    chance = np.random.default_rng(6)
    seen = 0
    for _ in range(3000):
        percent = int(chance.choice([80, 80, 70, 90]))
        tokens = chance.permutation(5000)[:400].astype(np.uint64)
        df = np.sort(chance.integers(2, 40, 400))
        common = int(chance.integers(1, 120))
        sides = []
        pool = chance.permutation(400)
        both = pool[:common]
        extra = int(common * 100 / percent - common)
        cut = int(chance.integers(0, extra + 1))
        for own in (pool[common:common + cut], pool[common + cut:common + extra]):
            at = np.sort(np.concatenate([both, own]))
            unique = int(chance.integers(0, len(own) + 1)) if len(own) else 0
            at = np.setdiff1d(at, own[:unique])
            sides.append((tokens[at], df[at], len(at) + unique))
        n_a, n_b = sides[0][2], sides[1][2]
        if 100 * common < percent * (n_a + n_b - common):
            continue
        short = nj.short_below(percent)
        a, b = (set(nj.keys(h, d, n, percent, 16, short).tolist()) for h, d, n in sides)
        assert a & b or sides[0][0].tolist() == sides[1][0].tolist() and n_a == n_b < 5
        seen += 1
    assert seen > 1000


def test_words_with_one_polynomial_hash_differ():
    """Thue-Morse words collide under any polynomial hash modulo 2**64 with an odd base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    data = (word + " " + word.translate(str.maketrans("ab", "ba"))).encode()
    n = len(word)
    h = nj.word_hashes(np.frombuffer(data, np.uint8), np.array([0, n + 1]), np.array([n, 2 * n + 1]))
    assert h[0] != h[1]


def test_empty_table(spark, table):
    out = nj.ngram_join(table([]))
    assert sorted(out.columns) == ["component_id", "doc_id", "n_shingles"] and out.count() == 0


def test_differences_become_rows_only_up_to_their_prefix(spark, monkeypatch):
    """Members that miss many of the hub's tokens, of which two decide."""
    hub = list(range(100))
    sets = spark.createDataFrame(
        [(0, 100, hub)] + [(i, 100, [t for t in hub if (t + i) % 4]) for i in range(1, 9)],
        "cid long, n long, tokens array<long>",
    )
    members = spark.createDataFrame(
        [(0, i, 100, 0, 0, 0, True, i, 2, False) for i in range(1, 9)],
        "hub long, cid long, n long, alone long, d long, r long, apart boolean, comp long, prefix long, as_whole boolean",
    )
    rows, plain = [], hubs.cut

    def counted(frame):
        kept = plain(frame)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(hubs, "cut", counted)
    keyed = hubs._differences(members, sets).groupBy("key").agg({"cid": "count"}).collect()
    # members 1 and 5, 2 and 6, 3 and 7, 4 and 8 miss the same tokens
    assert sorted(r[1] for r in keyed) == [2] * 8
    assert max(rows) <= 16
