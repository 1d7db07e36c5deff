"""Every registered query against its SQL, as multisets, with a look at its plan."""

import pytest

import __spark_entry__ as spark_entry
import check
import oracles
import registry

ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, duck, name):
    df = spark_entry.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(columns, cursor.fetchall())


def test_registry_is_complete():
    assert set(ORACLES) <= set(registry.QUERIES) <= set(spark_entry.queries())
    assert set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, sf_dir):
    from paisaflow.operators.exact import single_pairs

    w = registry.workspace(spark, sf_dir)
    assert plan_of(single_pairs(w.ledger_txns, w.bank_txns)).count("Exchange") == 1
    assert "TakeOrderedAndProject" in plan_of(registry.QUERIES["cosine_topk"](w))
    assert "TakeOrderedAndProject" in plan_of(registry.QUERIES["search_settlements"](w))
    assert "WindowGroupLimit" in plan_of(registry.QUERIES["cosine_topk_many"](w))
    assert "PushedFilters: [IsNotNull(order_id), EqualTo(order_id,order_7)]" in plan_of(
        registry.QUERIES["point_lookup"](w)
    )
    tax = plan_of(registry.QUERIES["tax_rules"](w))
    assert "txn_amount" not in tax and "Exchange" not in tax
