"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import check
import corpus_pipeline
from paisaflow.llm import quality
from paisaflow.llm.queries import ORACLES, QUERIES
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = check.connect(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


def test_every_number_is_registered():
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES} - {"pipeline"}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf_dir).cache())
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    for df in seen[1:5]:
        assert df.columns == docs.columns
    net = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(docs, net).collect() if r[quality.SCORE] >= quality.THRESHOLD}
    assert {r[0] for r in rows(seen[1])} == good and 0 < len(good) < docs.count()
    assert {r[0] for r in rows(seen[2])} == {c for i, n, c in brute.components(rows(seen[1]), 5, 80)}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {x[0] for x in brute.contamination(rows(seen[2]), items) if not x[5]}
    assert {r[0] for r in rows(seen[3])} == clean and len(clean) < seen[2].count()
    copies = [r[0] for r in rows(seen[4])]
    assert set(copies) <= clean and max(map(copies.count, set(copies))) == 2
    assert sorted(r["doc_id"] for r in seen[5].collect()) == sorted(copies)
    run = corpus_pipeline.run(spark, sf_dir)
    assert check.rows_of(run.columns, run.collect()) == check.rows_of(seen[5].columns, seen[5].collect())
