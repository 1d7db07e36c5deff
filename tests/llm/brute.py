"""Plain versions of the operators, over lists of rows (doc_id, text, lang, source, n_chars)."""

import hashlib
import re
from collections import Counter

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def shingles(text, n):
    w = SPACE_WORDS.findall((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def components(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    out = []
    for i, r in enumerate(rows):
        if not sets[i]:
            out.append((r[0], 0, r[0]))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return out


def byte_repeats(rows, window=50):
    least = {}
    key = lambda r: LAST if r[0] is None else r[0]
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - window + 1):
            s = b[i:i + window]
            least[s] = min(least.get(s, LAST), key(r))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if least[b[i:i + window]] < key(r):
                gone[i:i + window] = b"\1" * window
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out.append((r[0], len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def word_repeats(rows, window=35):
    words = [SPACE_WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((r[0], len(w), sum(gone), sha(" ".join(kept))))
    return out


def contamination(rows, items, window=10):
    spans = {}
    for item, text in items:
        w = WORDS.findall((text or "").translate(FOLD))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            spans.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = set()
    for r in rows:
        w = WORDS.findall((r[1] or "").translate(FOLD))
        hit, found = set(), set()
        for size in {len(s) for s in spans}:
            for i in range(len(w) - size + 1):
                own = spans.get(tuple(w[i:i + size]))
                if own:
                    hit.update(range(i, i + size))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.add((r[0], len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out
