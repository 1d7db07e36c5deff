import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: names that the operators use inside
CLASHING = "fp key size n tid sha d copies label score pos w hit start cid root offset shard slot group item".split()


def rows_of(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, extra=False):
        schema = SCHEMA
        if extra:
            schema = T.StructType([*SCHEMA.fields, *[T.StructField(c, T.StringType()) for c in CLASHING]])
            rows = [(*r, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd characters."""
    chance = random.Random(3)
    word = lambda: chance.choice("alpha beta gamma delta eps zeta eta theta iota kappa Ärger été ΣΑΣ".split())
    passage = " ".join(word() + str(i % 7) for i in range(60))
    texts = [
        None, "", "   \n\t ", "one", "one two", passage, passage.upper(), passage + " tail", "head " + passage,
        passage, " ".join(["same"] * 400), "x" * 3000, "\x00odd\x01 bytes\x7f", "\n".join(["line"] * 50),
        " ".join(word() for _ in range(9000)),
    ] + [" ".join(word() + str(chance.randrange(50)) for _ in range(80)) for _ in range(6)]
    rows = rows_of(texts)
    rows += [(None, passage, None, None, None), (None, None, None, None, None), (3, "one", "en", "a", 3), rows[5]]
    return rows
