"""Alignment of two tokenizers against a plain walk over every text."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from paisaflow.llm import alignment
from tests.llm.conftest import rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.TOKENIZERS), reason="no tokenizer files")


def plain(rows):
    """One overlap at a time, with the library the JSON file belongs to."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.A_FILE}")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.B_FILE}")
    letters = alignment._byte_letters()
    out, held = [], Counter()
    for row in rows:
        doc_id, text = row[0], row[1]
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelled_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
        spelled_b = [
            bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
            for p in map(second.id_to_piece, b)
        ]
        if not text or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(s) for s in spelled_a]).tolist(), np.cumsum([len(s) for s in spelled_b]).tolist()
        links, i, j, groups = [], 0, 0, [([], [])]
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            if x <= y:
                groups[-1][0].append(a[i])
                i += 1
            if y <= x:
                groups[-1][1].append(b[j])
                j += 1
            if x == y:
                groups.append(([], []))
        groups.pop()
        held.update(set(links))
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted((
        (d, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha)
        for d, na, nb, ng, links, sha in out
    ), key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain text", "日本語の文章と emoji 👩‍👩‍👧 together", "a b c▁d",
    "  two  spaces   three\n\n\n\tlines\r\n", "naïve café Ελληνικά русский", "aaaa" * 4000, " " * 3000, "\x00\x01\x7f", "﻿bom",
    "don't we'll I'M they'RE", "12345 67890.12", "é combining", "퟿\U0010ffff",
]


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_equals_plain_walk(spark, table, odd_rows):
    rows = odd_rows + [(100 + i, *r[1:]) for i, r in enumerate(rows_of(ODD))]
    docs = table(rows, extra=True).repartition(3)
    want = plain(rows)
    assert collected(alignment.alignment(docs)) == want
    assert sum(r[1] > 0 for r in want) > len(rows) // 2
    # slices of the pair counts, one A id at least in each
    assert collected(alignment.alignment(docs, slice_pairs=40)) == want


def test_query_equals_plain_walk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert collected(alignment.op13_alignment(spark, sf_dir)) == plain(rows)


def test_pointer_jumping_crosses_long_components():
    """Tokens of two and of three bytes, staggered so that only the very last ends meet."""
    a = alignment.side([np.zeros(3000, np.uint16)], np.array([2]))
    b = alignment.Side(np.zeros(2001, np.int64), np.append(np.arange(1, 6000, 3), 6000), np.array([0, 2001]))
    end_a, end_b = alignment.terminals(a, b)
    ends = np.array(sorted(set(a.end.tolist()) & set(b.end.tolist())))
    closing = np.searchsorted(b.end, ends)
    assert end_a.tolist() == closing[np.searchsorted(ends, a.end)].tolist()
    assert end_b.tolist() == closing[np.searchsorted(ends, b.end)].tolist()


def test_ends_and_places_equal_binary_search():
    chance = np.random.default_rng(6)
    for n in (0, 1, 7, 500):
        end = np.sort(chance.integers(0, 3 * n + 1, n))
        limit = 3 * n + 5
        assert alignment.ends_below(end, limit).tolist() == np.searchsorted(end, np.arange(limit + 1)).tolist()
        keys = np.unique(chance.integers(0, 1 << 32, n))
        wanted = chance.choice(keys, 3 * n) if n else keys
        assert alignment.places(keys, wanted).tolist() == np.searchsorted(keys, wanted).tolist()
    spelled, begin = alignment._text_of(np.array([0, 9, 10, 65535, 999, 10000]), np.frombuffer(b",|;,;,", np.uint8))
    assert spelled.tobytes() == b"0,9|10;65535,999;10000," and begin.tolist() == [0, 2, 4, 7, 13, 17, 23]


def test_empty_table(spark, table):
    out = alignment.alignment(table([]))
    assert out.columns == COLUMNS and out.count() == 0
