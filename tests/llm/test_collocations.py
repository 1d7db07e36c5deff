"""Collocations against plain counting, at budgets that make everything, something and nothing heavy."""

import random
import re
from collections import Counter

import pytest

from paisaflow.llm import collocations as co
from tests.llm import brute
from tests.llm.conftest import rows_of


def plain(rows, min_count=30, max_words=4, absorb=80, top=2000):
    total, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(brute.FOLD)):
            w = tuple(re.findall(r"[^ \t]+", piece))
            total[lang] += len(w)
            f.update((lang, w[i:i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    often = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= min_count}
    longest = Counter()
    for (lang, w), n in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i:i + k]] = max(longest[lang, w[i:i + k]], n)
    out = {}
    for (lang, w), a in often.items():
        if 100 * longest[lang, w] >= absorb * a and longest[lang, w]:
            continue
        score, _, l, r = min(
            (2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))
        )
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def answer(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows(odd_rows):
    chance = random.Random(8)
    vocabulary = ["the", "The", "of", "Île", "a-b", "x\x00y", "日本", "w1", "w2", "rare"]
    out = list(odd_rows)
    for i in range(120):
        text = "".join(chance.choice(vocabulary) + chance.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(60))
        out.append((1000 + i, text + " pay the bill in full", chance.choice(["en", "de", None, "und", "a\tb"]), "s", 1))
    return out


@pytest.mark.parametrize("budget", [40, 400, 1 << 21])
def test_equals_plain_counting(spark, table, rows, budget):
    docs = table(rows, extra=True).repartition(3)
    want = plain(rows, min_count=20)
    assert len(want) > 50 and {w[0] for w in want} >= {"en", "de", "und"}
    assert answer(co.collocations(docs, min_count=20, budget=budget)) == want


def test_other_depths_and_tops(spark, table, rows):
    docs = table(rows)
    assert answer(co.collocations(docs, 5, 3, 60, 7, budget=300)) == plain(rows, 5, 3, 60, 7)
    assert answer(co.collocations(docs, 9, 2)) == plain(rows, 9, 2)


def test_scores_pass_64_bits(spark, table, monkeypatch):
    """Counts of 10**13 and more are scored exactly."""
    docs = table(rows_of(["a b"]))
    big = 9_999_999_999_999
    single = spark.createDataFrame([("en", "a", big), ("en", "b", big + 2)], "lang string, word string, n long")
    nodes = spark.createDataFrame([("en", "a b", 2, big - 1)], "lang string, phrase string, words int, a long")
    monkeypatch.setattr(co, "phrase_counts", lambda *_: (single, nodes))
    assert answer(co.collocations(docs))[0][-1] == 2000000 * (big - 1) // (2 * big + 2)


def test_empty_table(spark, table):
    assert answer(co.collocations(table([]))) == []
