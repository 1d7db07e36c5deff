"""DuckDB SQL for the registered queries, composed from named common table expressions."""

from __future__ import annotations

import re

import shapes
from paisaflow.schemas import (
    CASH_POSITION_KEYWORDS, DEFAULT_EXCEPTION_EXPLANATION, DEFAULT_TAX_REASONING,
    FORWARD_LOOKING_KEYWORDS, REVIEW_DECISIONS,
)

_HOLIDAYS = ", ".join(f"DATE '{d}'" for d in shapes.HOLIDAYS)
_EXCEPTION_TEXT = DEFAULT_EXCEPTION_EXPLANATION.replace("'", "''")
_TAX_TEXT = DEFAULT_TAX_REASONING.replace("'", "''")
_KEY = "cast(substring(row_id, 5, 9) as bigint)"


def _money(x: str) -> str:
    return f"cast(cast({x} as decimal(18,2)) as double)"


def _msum(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(18,2))) as double)"


def _float_text(x: str) -> str:
    """Plain decimal text with at least one decimal, for paisa amounts."""
    return f"regexp_replace(cast(cast({x} as decimal(18,2)) as varchar), '(\\.\\d)0$', '\\1')"


def _side(value: str, p: int, q: int, prefix: str) -> str:
    return f"""
select *, '{prefix}' || lpad(cast(k as varchar), 9, '0') || '_' || copy as row_id,
  cast({shapes.by_kind(2, '//')} as bigint) as row_paise,
  created_at + to_minutes(cast({shapes.by_kind(3, '//')} as int)) as ts
from (select *, {shapes.KIND} as kind from (
  select *, {value} as v, (k * {p}) % {q} % 100 as h, (k * {p} + 17) % 9857 as x from paise))
  cross join (select unnest([0, 1]) as copy)
where kind <> 'missing' and (copy = 0 or kind = 'duplicate')"""


def _least_squares(
    name: str, source: str, columns: list[str], target: str, where: str = "not is_test"
) -> dict[str, str]:
    """Least squares over the rows of ``source`` that ``where`` names: the normal equations as a list of rows,
    solved column by column. Gives every row of ``source`` with its ``prediction``.

    A column that is zero throughout is left out; categories come without their first level.
    """
    z = ["1.0::double", *[f"cast({c} as double)" for c in columns]]
    p = len(z)
    rows = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in [*z, f"cast({target} as double)"]) + "]" for a in z)
    total = " + ".join(f"m[{i + 1}][{p + 1}] * {a}" for i, a in enumerate(z))
    return {
        f"{name}_steps(k, m)": f"""
select 0, [{rows}] from {source} where {where}
union all
select k + 1, list_transform(m, lambda r, i: case when abs(m[k + 1][k + 1]) < 1e-9 then r
    when i = k + 1 then list_transform(r, lambda x: x / r[k + 1])
    else list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end)
from {name}_steps where k < {p}""",
        name: f"select s.*, {total} as prediction from {source} s cross join (select m from {name}_steps where k = {p})",
    }


_AMOUNT = "(txn_amount / 100000)"
_METHOD_LEVELS = [f"(payment_method = '{row[0]}')::int" for row in shapes.METHODS[1:]]
_MERCHANT_LEVELS = [
    f"(merchant_category = '{m}')::int" for m in ("building", "furniture", "household", "machinery")
]


def _model_report(name: str, label: str, target: str) -> str:
    """As the library reports a model whose linear form stays."""
    return f"""
select '{label}' as label, '{target}' as target, count(*) filter (not is_test) as n_train,
  count(*) filter (is_test) as n_test, round(avg(abs({target} - prediction)) filter (is_test), 6) as mae,
  round(100 * avg(abs(({target} - prediction) / {target})) filter (is_test and abs({target}) > 1e-6), 4) as mape_pct,
  'linear' as chosen_model,
  coalesce(abs(corr({target} - prediction, txn_amount ** 2) filter (not is_test)) > 0.15, false) as curvature_detected
from {name}"""


def _mutual(name: str, edges: str) -> dict[str, str]:
    """The same choice over one large key: pairs that prefer each other leave together, round by round."""
    first = "row_number() over (partition by {} order by score, l_id, b_id) = 1"
    return {
        f"{name}_rounds(l_id, b_id, score, diff, hours, taken)": f"""
select l_id, b_id, score, diff, hours, false from {edges}
union all
select l_id, b_id, score, diff, hours, taken from (
  select *, bool_or(taken) over (partition by l_id) as l_gone, bool_or(taken) over (partition by b_id) as b_gone
  from (select l_id, b_id, score, diff, hours, {first.format('l_id')} and {first.format('b_id')} as taken
    from {name}_rounds where not taken))
where taken or not (l_gone or b_gone)""",
        f"{name}": f"select l_id, b_id, diff, hours from {name}_rounds where taken",
    }


def _greedy(name: str, edges: str) -> dict[str, str]:
    """Sequential greedy choice over an edge table, one step per list element."""
    return {
        f"{name}_list": f"""
select order_key, list({{'s': score, 'l': l_id, 'b': b_id, 'd': diff, 'h': hours}}
  order by score, l_id, b_id) as es from {edges} group by order_key""",
        f"{name}_steps(order_key, es, i, ul, ub, picked)": f"""
select order_key, es, 0, cast([] as varchar[]), cast([] as varchar[]), false from {name}_list
union all
select order_key, es, i + 1, case when clash then ul else list_append(ul, es[i + 1].l) end,
  case when clash then ub else list_append(ub, es[i + 1].b) end, not clash
from (select *, list_contains(ul, es[i + 1].l) or list_contains(ub, es[i + 1].b) as clash
  from {name}_steps where i < len(es))""",
        f"{name}": f"""
select order_key, es[i].l as l_id, es[i].b as b_id, es[i].d as diff, es[i].h as hours
from {name}_steps where picked""",
    }


_HOURS = "abs(epoch_us(b.created_at) - epoch_us(l.created_at)) / 1000000.0::double / 3600.0::double"


def _history(total: str, count: str, p: str, c: str, target: str, source: str) -> str:
    def mean(col: str, n: int) -> str:
        w = f"over (order by date rows between {n} preceding and 1 preceding)"
        return (
            f"case when count({col}) {w} = {n} then"
            f" cast(sum(cast({col} as decimal(18,2))) {w} as double) / {n} end"
        )

    o = "over (order by date)"
    return f"""
select *, lag({total}, 1) {o} as {p}_lag_1, lag({total}, 7) {o} as {p}_lag_7,
  {mean(total, 7)} as {p}_rolling_7, {mean(total, 30)} as {p}_rolling_30,
  lag({count}, 1) {o} as {c}_lag_1, lag({count}, 7) {o} as {c}_lag_7,
  {mean(count, 7)} as {c}_rolling_7, lead({total}, 1) {o} as {target}
from {source}"""


def _naive(features: str, today: str, target: str, p: str, c: str) -> str:
    columns = (f"{p}_lag_1", f"{p}_lag_7", f"{p}_rolling_7", f"{p}_rolling_30", f"{c}_lag_1",
               f"{c}_lag_7", f"{c}_rolling_7", target)
    full = " and ".join(f"{x} is not null" for x in columns)
    return f"""
select count(*) as n_test, cast(sum(abs(cast({target} as decimal(18,2)) -
  cast({today} as decimal(18,2)))) as double) / count(*) as naive_mae
from (select *, row_number() over (order by date) as position, count(*) over () as n
  from {features} where {full}) where position > floor(n * 0.8::double)"""


def _daily_model(label: str, features: str, today: str, target: str, p: str, c: str, extra: tuple = ()) -> dict[str, str]:
    """Days of a series in order, the last fifth held out, and the fit on the others."""
    history = (f"{p}_lag_1", f"{p}_lag_7", f"{p}_rolling_7", f"{p}_rolling_30", f"{c}_lag_1", f"{c}_lag_7", f"{c}_rolling_7")
    full = " and ".join(f"{x} is not null" for x in (*history, target))
    days = {f"{label}_series": f"""
select *, {today} as today, {target} as target, position > floor(n * 0.8::double) as is_test
from (select *, row_number() over (order by date) as position, count(*) over () as n
  from {features} where {full})"""}
    scaled = [f"({x} / 1000000)" for x in (*history[:4], *(x for x in extra if x.startswith("total")))]
    plain = [f"({x} / 10)" for x in (*history[4:], *(x for x in extra if not x.startswith("total")))]
    return days | _least_squares(f"{label}_model", f"{label}_series", [*scaled, *plain], target)


_DAILY_MODELS = (
    ("gmv", "gmv_feat", "total_gmv", "target_gmv", "gmv", "txn_count", ("is_weekend::int",)),
    ("gmv_experiment", "gmv_feat", "total_gmv", "target_gmv", "gmv", "txn_count", ("is_weekend::int", "total_gmv")),
    ("refund_experiment", "refund_feat", "total_refunds", "target_refund", "refund", "refund_count", ("total_refunds",)),
    ("settlement_experiment", "settle_feat", "total_settlement", "target_settlement", "settlement", "settlement_count", ()),
)
_DAILY_REPORT = "\nunion all\n".join(f"""
select '{label}' as label, count(*) filter (not is_test) as n_train, count(*) filter (is_test) as n_test,
  round(avg(abs(target - prediction)) filter (is_test), 2) as mae,
  round(sqrt(avg((target - prediction) ** 2) filter (is_test)), 2) as rmse,
  round(avg(abs(target - today)) filter (is_test), 2) as naive_mae,
  round((1 - avg(abs(target - prediction)) filter (is_test) / avg(abs(target - today)) filter (is_test)) * 100, 4)
    as improvement_pct
from {label}_model""" for label, *_ in _DAILY_MODELS)

_BASE_COLUMNS = (
    "txn_id, source, gateway_payment_id, order_id, txn_amount, payment_method, created_at,"
    " day_of_week, is_weekend_or_holiday, merchant_category, had_dispute_flag, had_refund,"
    " refund_amount, gst_on_fee_flag, fee_amount, fee_amount_pending, tax_on_fee, fee_pct,"
    " days_to_settle, deduction_pct, settled_at, status, true_tax_category"
)

CTES: dict[str, str] = {
    "paise0": f"""
select cast(o_orderkey as bigint) as k, cast(round(o_totalprice * 100) as bigint) as amt,
  o_orderdate + to_seconds((o_orderkey * 151) % 86399) as created_at,
  (o_orderkey * 31) % 9949 % 100 as m, lower(c_mktsegment) as merchant_category
from orders join customer on o_custkey = c_custkey""",
    "paise1": f"""
select *, 'TXN' || lpad(cast(k as varchar), 9, '0') as txn_id, 'order_' || k as order_id,
  {shapes.METHOD} as payment_method, {shapes.DISPUTED} as had_dispute_flag,
  {shapes.REFUNDED} as had_refund, {shapes.TAXED} as gst_on_fee_flag,
  {shapes.PENDING} as fee_amount_pending,
  cast(isodow(created_at) - 1 as int) as day_of_week,
  isodow(created_at) >= 6 or cast(created_at as date) in ({_HOLIDAYS}) as is_weekend_or_holiday,
  {shapes.FEE_POINTS} as bp, {shapes.DAYS} as base_days
from paise0""",
    "paise": f"""
select *, case when gst_on_fee_flag then {shapes.tax('//')} else 0 end as tax,
  case when had_refund then {shapes.refund('//')} else 0 end as refund,
  cast(base_days + {shapes.LATER_DAYS} + {shapes.DISPUTE_DAYS} as int) as days_to_settle
from (select *, (amt * bp + 5000) // 10000 as fee from paise1)""",
    "base": """
select k, txn_id, 'synthetic' as source, cast(null as varchar) as gateway_payment_id, order_id,
  amt::double / 100 as txn_amount, payment_method, created_at, day_of_week,
  is_weekend_or_holiday, merchant_category, had_dispute_flag, had_refund,
  refund::double / 100 as refund_amount, gst_on_fee_flag, fee::double / 100 as fee_amount,
  fee_amount_pending, tax::double / 100 as tax_on_fee, bp::double / 10000 as fee_pct,
  days_to_settle, case when amt = 0 then 0.0::double
    else round((fee + tax + refund)::double / amt, 4) end as deduction_pct,
  created_at + to_days(days_to_settle) as settled_at,
  case when had_refund then 'refunded' when had_dispute_flag then 'disputed' else 'settled' end
    as status,
  case when had_refund then 'refund_credit_note' when not gst_on_fee_flag then 'exempt'
    when fee > 0 then 'gst_on_fee' else 'taxable_sale' end as true_tax_category
from paise""",
    "lside": _side("amt", 7919, 9973, "LEDG"),
    "bside": _side("greatest(amt - fee - tax - refund, 0)", 6007, 9967, "BANK"),
    "ledger": """
select k, row_id, row_id as source_id, order_id, row_paise::double / 100 as amount,
  ts as created_at, payment_method as method,
  case when had_refund then 'refunded' when had_dispute_flag then 'disputed' else 'settled' end
    as status,
  fee::double / 100 as fee, tax::double / 100 as tax, refund::double / 100 as refund_amount,
  row_paise::double / 100 - fee::double / 100 - tax::double / 100 - refund::double / 100 as net
from lside""",
    "bank": """
select k, row_id, row_id as source_id, order_id, row_paise::double / 100 as amount,
  ts as created_at, 'UTR' || lpad(cast(k as varchar), 12, '0') as utr_reference from bside""",
    "singles": f"""
select l.order_id, l.row_id as l_id, b.row_id as b_id, abs(b.amount - l.net) as diff,
  {_HOURS} as hours, l.amount as l_amount
from (select *, count(*) over (partition by order_id) as n from ledger) l
join (select *, count(*) over (partition by order_id) as n from bank) b
  on l.order_id = b.order_id and l.n = 1 and b.n = 1""",
    "exact": """
select l_id as ledger_row_id, b_id as bank_row_id, order_id, 'exact' as tier,
  diff as amount_diff, hours as timestamp_diff_hours, cast(null as varchar) as explanation
from singles where diff <= greatest(5.0::double, 0.015::double * l_amount) and hours <= 6""",
    "lrest": "select * from ledger where row_id not in (select ledger_row_id from exact)",
    "brest": "select * from bank where row_id not in (select bank_row_id from exact)",
    "edges": f"""
select order_key, diff / greatest(l_amount, 1.0::double) + hours / 96.0::double as score, l_id,
  b_id, diff, hours
from (select l.order_id as order_key, l.row_id as l_id, b.row_id as b_id, l.amount as l_amount,
    abs(b.amount - l.net) as diff, {_HOURS} as hours
  from lrest l join brest b on l.order_id = b.order_id)
where diff <= greatest(30.0::double, 0.08::double * l_amount) and hours <= 96""",
    **_greedy("fuzzy_pairs", "edges"),
    "fuzzy": """
select l_id as ledger_row_id, b_id as bank_row_id, order_key as order_id, 'fuzzy' as tier,
  diff as amount_diff, hours as timestamp_diff_hours, cast(null as varchar) as explanation
from fuzzy_pairs""",
    "lrest2": "select * from lrest where row_id not in (select ledger_row_id from fuzzy)",
    "brest2": "select * from brest where row_id not in (select bank_row_id from fuzzy)",
    "near_edges": f"""
select l.order_id as order_key, l.row_id as l_id, b.row_id as b_id,
  abs(b.amount - l.net) as score, abs(b.amount - l.net) as diff, {_HOURS} as hours
from lrest2 l join brest2 b on l.order_id = b.order_id""",
    **_greedy("near_pairs", "near_edges"),
    "blank_edges": f"""
select * from (
  select l.row_id as l_id, b.row_id as b_id, abs(b.amount - l.net) as diff, {_HOURS} as hours,
    abs(b.amount - l.net) / greatest(l.amount, 1.0::double) + {_HOURS} / 96.0::double as score, l.amount as l_amount
  from lrest l join brest b
    on b.created_at >= l.created_at - to_hours(96) and b.created_at <= l.created_at + to_hours(96))
where diff <= greatest(30.0::double, 0.08::double * l_amount) and hours <= 96""",
    **_mutual("blank_pairs", "blank_edges"),
    "blank_near_edges": f"""
select l.row_id as l_id, b.row_id as b_id, abs(b.amount - l.net) as score, abs(b.amount - l.net) as diff,
  {_HOURS} as hours
from (select * from lrest where row_id not in (select l_id from blank_pairs)) l
  cross join (select * from brest where row_id not in (select b_id from blank_pairs)) b""",
    **_mutual("blank_near", "blank_near_edges"),
    "model_rows": """
select *, is_weekend_or_holiday::int as off, had_dispute_flag::int as disputed, gst_on_fee_flag::int as taxed,
  (fee_amount + tax_on_fee) / txn_amount as fee_deduction_pct, refund_amount / txn_amount as refund_deduction_pct,
  ('0x' || left(md5(txn_id), 8))::bigint % 5 = 0 as is_test
from base""",
    "refunded_rows": "select * from model_rows where had_refund",
    **_least_squares("days_model", "model_rows", [
        _AMOUNT, "day_of_week", "off", "disputed", *_METHOD_LEVELS, *_MERCHANT_LEVELS,
    ], "days_to_settle"),
    # fitted on training rows for the report, on all rows for use
    **{
        key: text for suffix, where in (("", "not is_test"), ("_all", "true")) for key, text in {
            **_least_squares(
                f"fee_model{suffix}", "model_rows", [_AMOUNT, "taxed", *_METHOD_LEVELS], "fee_deduction_pct", where
            ),
            **_least_squares(
                f"refund_model{suffix}", "refunded_rows", [_AMOUNT, "(refund_amount / 100000)", *_METHOD_LEVELS],
                "refund_deduction_pct", where,
            ),
        }.items()
    },
    "items": """
select l.row_id, 'ledger' as side, l.order_id, p.b_id as candidate_id, p.diff, p.hours
from lrest2 l left join near_pairs p on l.row_id = p.l_id
union all
select row_id, 'bank', order_id, null, null, null from brest2
where row_id not in (select b_id from near_pairs)""",
    "answers": f"""
select row_id, case kind when 1 then 'likely_duplicate' else 'matched' end as resolution,
  case kind when 0 then candidate_id when 2 then 'BANK_other' end as matched_row_id,
  'answer ' || row_id as said
from (select *, {_KEY} % 4 as kind from items) where kind < 3""",
    "judged": """
select i.*, a.resolution, a.said, coalesce(a.resolution = 'matched'
  and a.matched_row_id = i.candidate_id, false) as agreed
from items i left join answers a using (row_id)""",
    "judged_exceptions": f"""
select row_id, side, order_id, candidate_id, coalesce(resolution, 'unexplained') as reason,
  coalesce(said, '{_EXCEPTION_TEXT}') as explanation
from judged where not agreed""",
    "exceptions": f"""
select row_id, side, order_id, reason, explanation from judged_exceptions""",
    "matches": """
select * from exact union all select * from fuzzy union all
select row_id, candidate_id, order_id, 'llm', diff, hours, said from judged where agreed""",
    "truth": """
select txn_id, order_id, ledger_row_count, bank_row_count, ledger_mismatch, bank_mismatch,
  verdict = 'must_match' as should_fully_reconcile, verdict as reconcile_verdict
from (select *, case when ledger_mismatch = 'missing' or bank_mismatch = 'missing'
    then 'no_counterpart'
    when ledger_mismatch = 'partial_settlement' or bank_mismatch = 'partial_settlement'
    then 'ambiguous' else 'must_match' end as verdict
  from (select b.txn_id, b.order_id, coalesce(l.n, 0) as ledger_row_count,
      coalesce(r.n, 0) as bank_row_count, coalesce(l.kind, 'missing') as ledger_mismatch,
      coalesce(r.kind, 'missing') as bank_mismatch
    from base b
    left join (select txn_id, min(kind) as kind, count(*) as n from lside group by 1) l
      on b.txn_id = l.txn_id
    left join (select txn_id, min(kind) as kind, count(*) as n from bside group by 1) r
      on b.txn_id = r.txn_id))""",
    "owner": "select row_id, txn_id from lside union all select row_id, txn_id from bside",
    "pair_judged": """
select m.*, case when l.txn_id = r.txn_id then l.txn_id end as txn_id
from matches m left join owner l on m.ledger_row_id = l.row_id
left join owner r on m.bank_row_id = r.row_id""",
    "hits": "select distinct txn_id from pair_judged where txn_id is not null",
    "score_row": """
select total_ground_truth_txns, should_fully_reconcile, reported_matches, true_positives,
  false_positives, false_negatives, true_positives - recall_tp as ambiguous_resolved,
  round(true_positives / (true_positives + false_positives), 4) as precision,
  round(recall_tp / should_fully_reconcile, 4) as recall,
  round(reported_matches / total_ground_truth_txns, 4) as match_rate, exception_count
from (select count(*) as total_ground_truth_txns,
    count(*) filter (should_fully_reconcile) as should_fully_reconcile,
    count(*) filter (txn_id in (select txn_id from hits)) as true_positives,
    count(*) filter (should_fully_reconcile and txn_id in (select txn_id from hits)) as recall_tp,
    count(*) filter (should_fully_reconcile and txn_id not in (select txn_id from hits))
      as false_negatives from truth),
  (select count(*) as reported_matches, count(*) filter (txn_id is null) as false_positives
    from pair_judged),
  (select count(*) as exception_count from exceptions)""",
    "by_rules": f"""
select txn_id, case when had_refund then 'refund_credit_note' when not gst_on_fee_flag
    then 'exempt' when fee_amount > 0 then 'gst_on_fee' else 'taxable_sale' end as category,
  'rule' as method,
  case when had_refund
    then 'had_refund=True — refunded amount requires a credit-note adjustment.'
    when not gst_on_fee_flag
    then 'gst_on_fee_flag=False — this transaction''s fee arrangement is GST-exempt.'
    when fee_amount > 0 then 'Nonzero gateway fee (' || {_float_text('fee_amount')}
      || ') with GST applicable — classified as GST-on-fee.'
    else 'No refund, no fee, GST-on-fee not applicable — standard taxable sale.' end as reasoning
from base where not fee_amount_pending""",
    "by_answers": f"""
select txn_id, case when kind = 0 then 'taxable_sale' else 'unresolved' end as category,
  'llm' as method, case when kind < 2 then 'answer ' || txn_id else '{_TAX_TEXT}' end as reasoning
from (select *, k % 3 as kind from base where fee_amount_pending)""",
    "classified": "select * from by_rules union all select * from by_answers",
    "reasons": """
select order_id, reason, explanation, count(*) as rows from exceptions group by all""",
    "records": """
select b.*, case when m.tier is not null then 'matched' when e.rows is not null
    then 'exception' else 'no_settlement_data' end as reconciliation_status,
  m.tier as reconciliation_tier, case when m.tier is null then coalesce(e.rows, 0) else 0 end
    as exception_rows,
  t.category as tax_category, t.reasoning as tax_reasoning
from base b
left join (select order_id, arg_max(tier, (case tier when 'exact' then 1 else 2 end,
    ledger_row_id)) as tier from matches group by 1) m on b.order_id = m.order_id
left join (select order_id, cast(sum(rows) as bigint) as rows from reasons group by 1) e
  on b.order_id = e.order_id
left join classified t on b.txn_id = t.txn_id""",
    "log_keys": f"""
select row_id, side, order_id, {_KEY} as k,
  TIMESTAMP '2025-01-01 00:00:00' + to_seconds({_KEY} % 86400) as decided_at from exceptions""",
    "latest_log": f"""
select row_id, side,
  case when k % 6 = 0 then 'written_off' when k % 3 = 0 then 'approved_match'
    when k % 3 = 1 then 'written_off' else 'manually_paired' end as decision,
  case when k % 6 > 0 and k % 3 = 2 then 'P' || k end as paired_row_id,
  case when k % 6 = 0 then 'second' else 'note ' || k end as note,
  case when k % 6 = 0 then 'reviewer_9' else 'reviewer_' || (k % 7) end as reviewer,
  decided_at
from log_keys where k % 2 = 0 and k % 12 > 0 and not (k % 3 = 2 and k % 5 = 0)""",
    "opposite": """
select order_id, 'ledger' as side, row_id as candidate_row_id, amount from bank
union all select order_id, 'bank', row_id, amount from ledger""",
    "gmv_days": f"""
select cast(created_at as date) as date, {_msum('txn_amount')} as total_gmv,
  count(*) as txn_count from base group by 1""",
    "refund_days": f"""
select cast(created_at as date) as date, {_msum('refund_amount')} as total_refunds,
  cast(sum(case when had_refund then 1 else 0 end) as bigint) as refund_count
from base group by 1""",
    "gross_days": f"""
select cast(settled_at as date) as date, {_msum('txn_amount')} as total_settlement,
  count(*) as settlement_count from base group by 1""",
    "net_days": f"""
select cast(settled_at as date) as date,
  {_msum('txn_amount - refund_amount - fee_amount - tax_on_fee')} as total_settlement,
  count(*) as settlement_count from base where status = 'settled' group by 1""",
    "gmv_feat0": _history("total_gmv", "txn_count", "gmv", "txn_count", "target_gmv", "gmv_days"),
    "gmv_feat": """
select *, case when isodow(date) >= 6 then 1 else 0 end as is_weekend from gmv_feat0""",
    "refund_feat": _history(
        "total_refunds", "refund_count", "refund", "refund_count", "target_refund", "refund_days"
    ),
    "settle_feat": _history(
        "total_settlement", "settlement_count", "settlement", "settlement_count",
        "target_settlement", "net_days",
    ),
    "gmv_split": """
select *, position <= floor(n * 0.8::double) as is_train
from (select *, row_number() over (order by date) as position, count(*) over () as n
  from gmv_feat where gmv_rolling_30 is not null and target_gmv is not null)""",
    "refund_next": """
select total_refunds as value, 'naive_previous_day' as method,
  cast(date + 1 as date) as forecast_date, date as based_on_date, cast(null as varchar) as note
from refund_days order by date desc limit 1""",
    "settle_next": """
select total_settlement as value, 'naive_previous_day' as method,
  cast(date + 1 as date) as forecast_date, date as based_on_date, cast(null as varchar) as note
from net_days order by date desc limit 1""",
    "cashflow": """
select d.date, coalesce(round(net, 2), 0)::double as expected_amount,
  coalesce(round(low, 2), 0)::double as lower_bound,
  coalesce(round(high, 2), 0)::double as upper_bound
from (select cast(DATE '1996-06-03' + i as date) as date
  from (select unnest(range(7))::int as i)) d
left join (select cast(settled_at as date) as date,
    sum(cast(txn_amount * (1.0::double - deduction_pct) as decimal(28,8))) as net,
    sum(cast(txn_amount * (1.0::double - least(1.0::double, deduction_pct + 0.0037::double))
      as decimal(28,8))) as low,
    sum(cast(txn_amount * (1.0::double - greatest(0.0::double, deduction_pct - 0.0037::double))
      as decimal(28,8))) as high
  from base group by 1) s on d.date = s.date""",
    "questions": """
select txn_id, case k % 5 when 0 then 'What happened to ' || order_id || ' and ' || txn_id || '?'
  when 1 then 'Show me the Forecast for next week'
  when 2 then 'Is my CASH position fine after ' || txn_id || '?'
  when 3 then 'How many disputed payments are there?'
  else 'Will I be paid for (' || order_id || ')? cashflow' end as question from base""",
    "csvl": """
select row_number() over (order by row_id) as row_num, k,
  case when k % 7 = 0 then null else row_id end as row_id,
  case when k % 11 = 0 then null else order_id end as order_id,
  case when k % 97 = 0 then 'blank' when k % 89 = 0 then 'nan' when k % 83 = 0 then 'n/a' end
    as fault, amount,
  case when k % 101 = 0 then 'missing' when k % 103 = 0 then 'soon' end as ts_fault,
  case when k % 4 = 3 then cast(cast(created_at as date) as timestamp) else created_at end as ts,
  case when k % 5 = 0 then null else method end as method, fee,
  case when k % 13 = 0 then 0.0::double else tax end as tax, refund_amount,
  case when k % 17 = 0 then 'unknown' else status end as status
from ledger""",
    "csvb": """
select row_number() over (order by row_id) as row_num, k,
  case when k % 7 = 0 then null else row_id end as row_id, order_id,
  case when k % 97 = 0 then 0.0::double else amount end as amount, k % 101 = 0 as no_ts,
  created_at as ts, case when k % 19 = 0 then null else utr_reference end as utr_reference
from bank""",
    "gw": """
select 'pay_' || b.k || '_' || n.n as source_id, b.order_id, b.txn_amount as amount,
  'INR' as currency, b.payment_method as method,
  case when fee_amount_pending then null else fee_amount end as fee,
  case when fee_amount_pending then null else tax_on_fee end as tax_on_fee,
  case when b.k % 5 > 0 and b.k % 100000 in (select c_custkey from customer where c_custkey % 10 < 7)
    then TIMESTAMP '1970-01-01' + to_seconds(800000000 + (b.k % 100000) * 3601) end as settled_at,
  date_trunc('second', b.created_at) + to_seconds(n.n) as created_at, b.refund_amount
from base b join (select unnest([1, 2]) as n) n on n.n = 1 or b.k % 10 = 0 where b.k % 9 > 0""",
    "embed": "select vec_id, cast(embedding as double[]) as e from embeddings",
    "json_texts": r"""
select txn_id, k % 6 as kind from base""",
}
CTES |= {key: text for model in _DAILY_MODELS for key, text in _daily_model(*model).items()}


def _topk(query_id: int) -> str:
    return f"(select e from embed where vec_id = {query_id})"


_REJECTS = """
select row_num, 'ledger' as side, 'Row ' || row_num || ': ' || case
    when fault = 'blank' then 'missing required column ''amount''.'
    when fault = 'nan' then 'amount is not a finite number ''nan''.'
    when ts_fault = 'missing' then 'missing required column ''timestamp''.'
    else 'unrecognized timestamp format ''soon''.' end as error
from csvl where fault in ('blank', 'nan') or ts_fault is not null
union all
select row_num, 'bank', 'Row ' || row_num || ': missing required column ''timestamp''.'
from csvb where no_ts"""


def _grouped(whole: str) -> str:
    """Lakh grouping of a whole number's text."""
    head = f"left({whole}, length({whole}) - 3)"
    odd = f"length({head}) % 2"
    return (
        f"case when length({whole}) <= 3 then {whole} else rtrim(left({head}, {odd}) ||"
        f" case when {odd} = 1 and length({head}) > 1 then ',' else '' end ||"
        f" regexp_replace(substring({head}, {odd} + 1), '(..)', '\\1,', 'g'), ',')"
        f" || ',' || right({whole}, 3) end"
    )


def _inr(x: str) -> str:
    text = f"cast(cast(abs({x}) as decimal(30,2)) as varchar)"
    whole = f"split_part({text}, '.', 1)"
    return (
        f"'₹' || (case when {x} < 0 then '-' else '' end) || ({_grouped(whole)}) || '.' ||"
        f" split_part({text}, '.', 2)"
    )


_PAYMENT_FILTER = "payment_method = 'wallet' and had_refund"
_SETTLED_FILTER = (
    "status = 'settled' and settled_at >= TIMESTAMP '1995-01-01'"
    " and settled_at < TIMESTAMP '1995-12-31'"
)
_MATCH = (
    "ledger_row_id, bank_row_id, order_id, tier, amount_diff, timestamp_diff_hours, explanation"
)
_REST = "source_id, order_id, amount, created_at"
_GMV_COLUMNS = (
    "date, total_gmv, txn_count, gmv_lag_1, gmv_lag_7, gmv_rolling_7, gmv_rolling_30,"
    " txn_count_lag_1, txn_count_lag_7, txn_count_rolling_7, target_gmv, is_weekend"
)
_STATS = f"""count(*) as total_transactions,
  count(*) filter (reconciliation_status = 'matched') as reconciled,
  count(*) filter (reconciliation_status = 'exception') as exceptions,
  count(*) filter (had_dispute_flag) as disputed_count,
  count(*) filter (had_refund) as refunded_count,
  {_msum('refund_amount')} as total_refund_amount"""
_HISTOGRAM = """
select cast(least(floor((v - lo) / (hi - lo) * 20), 19) as int) as bin, count(*) as rows
from (select v, min(v) over () as lo, max(v) over () as hi
  from (select deduction_pct - fee_pct as v from base)) group by 1"""

BODIES: dict[str, str] = {
    "ledger_normalize": """
select 'internal_ledger' as source, source_id, order_id, amount, 'INR' as currency, method,
  status, fee, cast(null as double) as tax_on_fee, cast(null as timestamp) as settled_at,
  created_at, tax as raw_tax_on_fee, refund_amount from ledger""",
    "bank_normalize": """
select 'bank_statement' as source, source_id, order_id, amount, 'INR' as currency,
  cast(null as varchar) as method, 'credited' as status, created_at as settled_at, created_at,
  utr_reference from bank""",
    "expected_net": "select source_id, net as expected_net from ledger",
    "csv_ledger_parse": """
select coalesce(row_id, 'LEDG' || lpad(cast(row_num as varchar),
    greatest(5, length(cast(row_num as varchar)))::int, '0')) as source_id, order_id,
  case when fault = 'n/a' then 0.0::double else amount end as amount, status, ts as created_at,
  method, fee, tax as tax_on_fee, refund_amount
from csvl where coalesce(fault, '') not in ('blank', 'nan') and ts_fault is null""",
    "csv_bank_parse": """
select coalesce(row_id, 'BANK' || lpad(cast(row_num as varchar),
    greatest(5, length(cast(row_num as varchar)))::int, '0')) as source_id, order_id, amount,
  'credited' as status, ts as created_at, ts as settled_at, utr_reference
from csvb where not no_ts""",
    "csv_file_ledger": """
select coalesce(row_id, 'LEDG' || lpad(cast(row_num as varchar),
    greatest(5, length(cast(row_num as varchar)))::int, '0')) as source_id, order_id,
  case when fault = 'n/a' then 0.0::double else amount end as amount, status, ts as created_at,
  method, fee, tax as tax_on_fee, refund_amount
from csvl where coalesce(fault, '') not in ('blank', 'nan') and ts_fault is null""",
    "csv_file_bank": """
select coalesce(row_id, 'BANK' || lpad(cast(row_num as varchar),
    greatest(5, length(cast(row_num as varchar)))::int, '0')) as source_id, order_id, amount,
  'credited' as status, ts as created_at, ts as settled_at, utr_reference
from csvb where not no_ts""",
    "json_file_rows": f"""
select row_id, order_id, amount, utr_reference from bank where {_KEY} % 50 <> 0""",
    "json_file_rejects": f"""
select left('{{"row_id":"' || row_id || '","txn_id_hint":"', 30) as raw from bank where {_KEY} % 50 = 0""",
    "csv_rejects": _REJECTS,
    "gateway_normalize": """
select source_id, order_id, amount, currency, method, fee, tax_on_fee, settled_at, created_at
from gw""",
    "gateway_transactions": """
select 'S_' || source_id as txn_id, amount as txn_amount,
  cast(isodow(created_at) - 1 as int) as day_of_week,
  isodow(created_at) >= 6 as is_weekend_or_holiday, refund_amount > 0 as had_refund,
  refund_amount, coalesce(tax_on_fee, 0) > 0 as gst_on_fee_flag,
  coalesce(fee, 0) as fee_amount, fee is null as fee_amount_pending,
  coalesce(tax_on_fee, 0) as tax_on_fee from gw""",
    "calibration_rows": "select source_id, order_id, amount, method, created_at from gw",
    "narration": f"""
select row_id, case when k % 3 = 0 then 'text for ' || row_id
  else 'Settlement - Order ' || order_id || ' - INR ' || {_float_text('amount')} end as narration
from ledger""",
    "json_repair": """
select txn_id, case when kind < 5 then txn_id end as answered_id,
  case kind when 0 then 'exempt' when 1 then 'exempt' when 2 then 'gst_on_fee'
    when 3 then 'taxable_sale' when 4 then 'taxable_sale' end as category,
  case kind when 0 then 'a' when 1 then 'b' when 2 then 'c' when 3 then 'd' when 4 then 'e' end
    as reasoning from json_texts""",
    "transactions_in_time_order": """
select txn_id, created_at, txn_amount from base order by created_at, txn_id""",
    "point_lookup": """
select txn_id, order_id, txn_amount, status from base where order_id = 'order_7' order by txn_id limit 1""",
    "exact_matches": f"select {_MATCH} from exact",
    "exact_residue_ledger": f"select {_REST} from lrest",
    "exact_residue_bank": f"select {_REST} from brest",
    "blank_key_fuzzy": "select l_id, b_id, diff, hours from blank_pairs",
    "blank_key_pairs": "select l_id, b_id, diff, hours from blank_near",
    "fuzzy_candidates": "select order_key, score, l_id, b_id, diff, hours from edges",
    "fuzzy_matches": f"select {_MATCH} from fuzzy",
    "fuzzy_residue_ledger": f"select {_REST} from lrest2",
    "fuzzy_residue_bank": f"select {_REST} from brest2",
    "exception_pairs": "select order_key, l_id, b_id, diff, hours from near_pairs",
    "open_items": "select row_id, side, order_id, candidate_id, diff, hours from items",
    "exceptions": "select row_id, side, order_id, reason, explanation from exceptions",
    "exceptions_by_reason_side": """
select reason, side, count(*) as rows from exceptions
group by grouping sets ((reason), (side))""",
    "exceptions_of_reason": """
select row_id, side, order_id, reason, explanation from judged_exceptions
where reason = 'likely_duplicate'""",
    "adjudicated_matches": """
select row_id as ledger_row_id, candidate_id as bank_row_id, order_id, 'llm' as tier,
  diff as amount_diff, hours as timestamp_diff_hours, said as explanation
from judged where agreed""",
    "adjudicated_exceptions": """
select row_id, side, order_id, reason, explanation from judged_exceptions""",
    "exceptions_both_sides": """
select row_id, side, order_id, reason, explanation from judged_exceptions union all
select candidate_id, 'bank', order_id, reason, explanation from judged_exceptions
where candidate_id is not null""",
    "all_matches": f"select {_MATCH} from matches",
    "tier_counts": "select tier, count(*) as matches from matches group by tier",
    "tier_waterfall": """
select step, tier, coalesce(n, 0) as matches, cast(coalesce(sum(coalesce(n, 0)) over
  (order by step rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
from (select unnest([0, 1, 2])::int as step, unnest(['exact', 'fuzzy', 'llm']) as tier)
left join (select tier, count(*) as n from matches group by tier) using (tier)""",
    "tier_shares": """
select tier, count(*) as matches, count(*) * 100.0::double / sum(count(*)) over () as share_pct
from matches group by tier""",
    "matches_by_drift": """
select m.ledger_row_id, m.bank_row_id, m.tier, m.amount_diff, l.amount as ledger_amount,
  b.amount as bank_amount, case m.tier when 'exact' then 5.0::double when 'fuzzy' then
  30.0::double end as amount_abs, case m.tier when 'exact' then 6.0::double when 'fuzzy' then
  96.0::double end as tolerance_hours
from (select * from matches order by abs(amount_diff) desc, ledger_row_id, bank_row_id limit 50) m
left join ledger l on m.ledger_row_id = l.row_id left join bank b on m.bank_row_id = b.row_id""",
    "matches_of_tier_total": "select count(*) as total from fuzzy",
    "ground_truth": "select * from truth",
    "ground_truth_row_ids": """
select b.txn_id, coalesce(l.ids, '') as ledger_row_ids, coalesce(r.ids, '') as bank_row_ids
from base b
left join (select txn_id, string_agg(row_id, '|' order by row_id) as ids from lside group by 1) l
  on b.txn_id = l.txn_id
left join (select txn_id, string_agg(row_id, '|' order by row_id) as ids from bside group by 1) r
  on b.txn_id = r.txn_id""",
    "mismatch_combos": """
select ledger_mismatch, bank_mismatch, count(*) as txns from truth group by 1, 2""",
    "verdict_breakdown": """
select reconcile_verdict, count(*) as txns from truth group by 1""",
    "ingest_summary": """
select count(*) as truth_txns, count(*) filter (should_fully_reconcile) as reconcilable_txns
from truth""",
    "reconciliation_score": "select * from score_row",
    "official_report": """
select round(match_rate * 100, 2) as match_rate_pct, precision, recall, reported_matches,
  exception_count as exception_rows_needing_review from score_row""",
    "unmatchable_txns": """
select total_ground_truth_txns - should_fully_reconcile as unmatchable from score_row""",
    "false_negative_txns": """
select txn_id from truth where should_fully_reconcile
  and txn_id not in (select txn_id from hits)""",
    "first_unresolved_txns": """
select txn_id from truth where should_fully_reconcile
  and txn_id not in (select txn_id from hits) order by txn_id limit 15""",
    "tax_rules": "select * from by_rules",
    "tax_fallback": "select * from by_answers",
    "tax_fallback_items": """
select txn_id, cast(null as double) as fee_amount, cast(null as double) as tax_on_fee, had_refund
from base where fee_amount_pending""",
    "tax_summary": """
select category, count(*) as txns, count(*) filter (method = 'rule') as by_rules,
  count(*) filter (method = 'llm') as by_answers from classified group by 1""",
    "tax_totals": """
select count(*) as total, count(*) filter (method = 'rule') as resolved_by_rules,
  count(*) filter (method = 'llm') as resolved_by_llm,
  count(*) filter (category = 'unresolved') as unresolved from classified""",
    "tax_accuracy": """
select count(*) filter (c.category = b.true_tax_category) as correct, count(*) as total,
  count(*) filter (c.category = b.true_tax_category) / count(*) as accuracy
from classified c left join base b using (txn_id)""",
    "tax_shares": """
select category, count(*) as txns, count(*) * 100.0::double / sum(count(*)) over () as share_pct
from classified group by 1""",
    "tax_list": "select * from classified where category = 'exempt' order by txn_id limit 50",
    "settlement_records": """
select txn_id, order_id, txn_amount, payment_method, status, reconciliation_status,
  reconciliation_tier, exception_rows, tax_category, tax_reasoning from records""",
    "record_reasons": """
select r.txn_id, e.reason, e.explanation, e.rows from records r join reasons e
on r.order_id = e.order_id where r.reconciliation_tier is null""",
    "record_text": f"""
select txn_id, concat_ws(' ', 'Transaction ' || txn_id || ' for order ' || order_id || '.',
  'Amount ₹' || {_float_text('txn_amount')} || ' via ' || payment_method || '.',
  'Reconciliation status: ' || reconciliation_status || '.',
  'Matched via ' || reconciliation_tier || ' tier.',
  case when exception_rows > 0 then (select string_agg(rtrim(repeat('Exception: ' || e.reason || ' — '
    || e.explanation || '. ', cast(e.rows as int))), ' ' order by e.reason, e.explanation)
    from reasons e where e.order_id = records.order_id) end,
  'Tax category: ' || tax_category || '.',
  case when had_refund then 'Refunded amount: ₹' || {_float_text('refund_amount')} || '.' end,
  case when had_dispute_flag then 'This transaction had a dispute.' end,
  'Settled in ' || days_to_settle || ' day(s), status ' || status || '.') as text
from records""",
    "aggregate_stats": f"select {_STATS} from records",
    "stat_breakdowns": """
select 'tax_category' as breakdown, coalesce(tax_category, 'unclassified') as value,
  count(*) as txns from records group by 2
union all select 'payment_method', coalesce(payment_method, 'unknown'), count(*)
from records group by 2""",
    "audit_report": f"""
select s.*, round(100 * reconciled / total_transactions, 2) as match_rate_pct, t.*
from (select {_STATS} from records) s,
  (select count(*) as tax_total, count(*) filter (method = 'rule') as tax_resolved_by_rules,
    count(*) filter (method = 'llm') as tax_resolved_by_llm,
    count(*) filter (category = 'unresolved') as tax_unresolved from classified) t""",
    "relation_lookup": """
select txn_id, order_id, txn_amount, reconciliation_status, reconciliation_tier as tier,
  tax_category as category, case when had_refund then refund_amount end as refund_amount,
  case when had_dispute_flag then true end as dispute
from records where order_id = 'order_7' order by txn_id limit 1""",
    "search_payments": f"""
select txn_id, order_id, txn_amount, payment_method, created_at, status, had_refund,
  refund_amount, had_dispute_flag, reconciliation_status
from records where {_PAYMENT_FILTER} order by txn_id limit 10""",
    "search_payments_total": f"""
select count(*) as total_matched from records where {_PAYMENT_FILTER}""",
    "search_settlements": f"""
select txn_id, order_id, txn_amount, settled_at, days_to_settle, fee_amount, tax_on_fee
from records where {_SETTLED_FILTER} order by txn_id limit 20""",
    "search_settlements_total": f"""
select count(*) as total_matched, {_msum('txn_amount')} as total_settlement_amount
from records where {_SETTLED_FILTER}""",
    "search_invoices": """
select txn_id, order_id, txn_amount, tax_category, tax_reasoning from records
where tax_category = 'exempt' order by txn_id limit 10""",
    "search_invoices_total": """
select count(*) as total_matched from records where tax_category = 'exempt'""",
    "review_queue": """
select e.row_id, e.side, e.order_id, e.reason, coalesce(l.amount, b.amount) as source_amount,
  coalesce(c.n, 0) as candidates, g.decision, g.paired_row_id, g.reviewer, g.decided_at
from exceptions e left join latest_log g using (row_id, side)
left join ledger l on e.row_id = l.row_id left join bank b on e.row_id = b.row_id
left join (select order_id, side, count(*) as n from opposite group by 1, 2) c
  on e.order_id = c.order_id and e.side = c.side""",
    "review_queue_pending": """
select row_id, side from exceptions e
where not exists (select 1 from latest_log g where g.row_id = e.row_id and g.side = e.side)""",
    "review_candidates": """
select order_id, side, candidate_row_id, amount from opposite o
where exists (select 1 from exceptions e where e.order_id = o.order_id and e.side = o.side)""",
    "review_latest": """
select row_id, side, decision, paired_row_id, note, reviewer, decided_at from latest_log""",
    "review_counts": """
select count(*) as total, count(*) filter (g.row_id is null) as pending,
  count(*) filter (g.row_id is not null) as resolved
from exceptions e left join latest_log g using (row_id, side)""",
    "review_rejected": f"""
select row_id, side, case when k % 4 = 2 then 'manually_paired' else 'ignored' end as decision,
  case when k % 4 = 2 then 'paired_row_id is required when decision is ''manually_paired'''
    else 'decision must be one of {str(sorted(REVIEW_DECISIONS)).replace("'", "''")}' end as error
from log_keys where k % 4 = 3 or (k % 4 = 2 and k % 8 <> 2)""",
    "question_ids": """
select txn_id, array_to_string(
  regexp_extract_all(question, '\\b(?:order_[A-Za-z0-9_]+|TXN\\d+)\\b'), '|') as ids
from questions""",
    "question_intent": f"""
select txn_id,
  regexp_matches(lower(question), '{'|'.join(FORWARD_LOOKING_KEYWORDS)}') as forward_looking,
  regexp_matches(lower(question), '{'|'.join(CASH_POSITION_KEYWORDS)}') as cash_question
from questions""",
    "cosine_topk": f"""
select vec_id, round(list_dot_product(e, {_topk(7)}), 6) as score from embed
order by list_dot_product(e, {_topk(7)}) desc, vec_id limit 15""",
    "cosine_topk_many": """
select query_id, cast(rank as int) as rank, vec_id, round(score, 6) as score from (
  select 'q' || q.vec_id as query_id, v.vec_id, list_dot_product(v.e, q.e) as score,
    row_number() over (partition by q.vec_id
      order by list_dot_product(v.e, q.e) desc, v.vec_id) as rank
  from embed v join embed q on q.vec_id in (1, 2, 3)) where rank <= 10""",
    "unit_vectors": """
select vec_id, round(list_dot_product(e, e) * 9 / (list_dot_product(e, e) * 9), 6)
  as squared_length, round(e[1] * 3 / sqrt(list_dot_product(e, e) * 9), 6) as first_component
from embed""",
    "daily_gmv": "select * from gmv_days",
    "daily_refunds": "select * from refund_days",
    "daily_settlement_gross": "select * from gross_days",
    "daily_settlement_net": "select * from net_days",
    "gmv_features": f"select {_GMV_COLUMNS} from gmv_feat",
    "refund_features": "select * from refund_feat",
    "settlement_features": "select * from settle_feat",
    "calendar_columns": """
select date, txn_count, cast(day(date) as int) as day_of_month, cast(month(date) as int) as month,
""" + ", ".join(
        f"case when isodow(date) = {d + 1} then 1 else 0 end as dow_{d}" for d in range(7)
    ) + " from gmv_days",
    "chrono_split": "select date, cast(position as int) as position, is_train from gmv_split",
    "latest_complete_day": """
select date, total_gmv, gmv_rolling_30 from gmv_feat where gmv_rolling_30 is not null
order by date desc limit 1""",
    "naive_gmv_mae": _naive("gmv_feat", "total_gmv", "target_gmv", "gmv", "txn_count"),
    "naive_refund_mae": _naive(
        "refund_feat", "total_refunds", "target_refund", "refund", "refund_count"
    ),
    "naive_settlement_mae": _naive(
        "settle_feat", "total_settlement", "target_settlement", "settlement", "settlement_count"
    ),
    "refund_baseline": "select * from refund_next",
    "settlement_baseline": "select * from settle_next",
    "cash_position": """
select 1000000.0::double as current_cash, s.value as expected_settlement,
  r.value as expected_refunds,
  cast(cast(s.value as decimal(18,2)) - cast(r.value as decimal(18,2)) as double)
    as expected_net_cash_flow,
  cast(1000000 + cast(s.value as decimal(18,2)) - cast(r.value as decimal(18,2)) as double)
    as projected_cash, s.forecast_date, s.method as settlement_method,
  s.based_on_date as settlement_based_on, r.method as refunds_method,
  r.based_on_date as refunds_based_on
from settle_next s, refund_next r""",
    "date_spine_cashflow": "select * from cashflow",
    "cashflow_window_total": f"""
select {_msum('expected_amount')} as window_expected from cashflow""",
    "stage_status": """
select *, case when total_transactions > 0 then 'passed' else 'pending' end as ingest_gate,
  case when matches + exceptions > 0 then 'passed' else 'pending' end as reconcile_gate,
  case when classified > 0 then 'passed' else 'pending' end as classify_gate,
  'pending' as forecast_gate, 'pending' as qa_gate
from (select (select count(*) from base) as total_transactions,
  (select count(*) from ledger) as ledger_rows, (select count(*) from bank) as bank_rows,
  (select count(*) from matches) as matches, (select count(*) from exceptions) as exceptions,
  (select count(*) from classified) as classified,
  (select count(*) from classified where method = 'rule') as resolved_by_rules,
  (select count(*) from classified where method = 'llm') as resolved_by_llm,
  cast(0 as bigint) as core_models, cast(0 as bigint) as indexed_records)""",
    "source_counts": "select source, count(*) as rows from base group by 1",
    "null_profile": " union all ".join(
        f"select '{c.strip()}' as column_name, count(*) filter ({c.strip()} is null) as nulls"
        " from base" for c in _BASE_COLUMNS.split(",")
    ),
    "flag_sums": "select " + ", ".join(
        f"cast(sum({c}::int) as bigint) as {c}"
        for c in ("is_weekend_or_holiday", "had_dispute_flag", "had_refund", "gst_on_fee_flag")
    ) + " from base",
    "target_describe": """
select count(days_to_settle) as n, round(avg(days_to_settle), 6) as mean,
  round(stddev_samp(days_to_settle), 6) as std, min(days_to_settle) as low,
  quantile_cont(days_to_settle::double, 0.25) as q25,
  quantile_cont(days_to_settle::double, 0.5) as q50,
  quantile_cont(days_to_settle::double, 0.75) as q75, max(days_to_settle) as high from base""",
    "model_days_to_settle": _model_report("days_model", "model_a", "days_to_settle"),
    "model_deduction": f"""
{_model_report("fee_model", "model_b_fee", "fee_deduction_pct")}
union all
{_model_report("refund_model", "model_b_refund", "refund_deduction_pct")}
union all
select 'model_b_combined', 'deduction_pct', (select count(*) from model_rows where not is_test), count(*),
  round(avg(abs(gap)), 6), round(100 * avg(abs(gap / deduction_pct)) filter (abs(deduction_pct) > 1e-6), 4),
  'fee + refund', null
from (select f.deduction_pct, f.deduction_pct - f.prediction - coalesce(r.prediction, 0) as gap
  from fee_model_all f left join refund_model_all r on r.txn_id = f.txn_id where f.is_test)""",
    "model_daily": _DAILY_REPORT,
    "amount_describe": """
select count(txn_amount) as n, round(avg(txn_amount), 4) as mean, round(stddev_samp(txn_amount), 4) as std,
  min(txn_amount) as low, round(quantile_cont(txn_amount, 0.25), 6) as q25,
  round(quantile_cont(txn_amount, 0.5), 6) as q50, round(quantile_cont(txn_amount, 0.75), 6) as q75,
  max(txn_amount) as high from base""",
    "amount_quartiles_by_method": """
select payment_method, min(txn_amount) as low, round(quantile_cont(txn_amount, 0.25), 6) as q25,
  round(quantile_cont(txn_amount, 0.5), 6) as q50, round(quantile_cont(txn_amount, 0.75), 6) as q75,
  max(txn_amount) as high from base group by 1""",
    "status_counts": "select status, count(*) as rows from base group by 1",
    "days_histogram": "select days_to_settle, count(*) as rows from base group by 1",
    "days_quartiles_by_method": """
select payment_method, min(days_to_settle) as low,
  quantile_cont(days_to_settle::double, 0.25) as q25,
  quantile_cont(days_to_settle::double, 0.5) as q50,
  quantile_cont(days_to_settle::double, 0.75) as q75, max(days_to_settle) as high
from base group by 1""",
    "residual_histogram": _HISTOGRAM,
    "deduction_features": """
select txn_id, is_weekend_or_holiday::int as is_weekend_or_holiday,
  had_dispute_flag::int as had_dispute_flag, had_refund::int as had_refund,
  gst_on_fee_flag::int as gst_on_fee_flag,
  case when txn_amount <> 0 then (fee_amount + tax_on_fee) / txn_amount end as fee_deduction_pct,
  case when txn_amount <> 0 then refund_amount / txn_amount end as refund_deduction_pct,
  deduction_pct,
  txn_amount - refund_amount - fee_amount - tax_on_fee as net_settlement from base""",
    "calendar_flags": """
select txn_id, day_of_week, is_weekend_or_holiday, cast(created_at as date) as created_date,
  cast(day(created_at) as int) as day_of_month, cast(month(created_at) as int) as month
from base""",
    "money_text": f"""
select txn_id, {_inr('txn_amount')} as full_text,
  {_inr('(txn_amount * 100 - 3000000)')} as large_text,
  case when d > 0 then '+' when d < 0 then '-' else '' end || '₹'
    || cast(cast(abs(d) as decimal(30,2)) as varchar) as drift_text,
  {_grouped("cast(cast(floor(txn_amount) as bigint) as varchar)")} as count_text
from (select *, cast(round(fee_amount - 10.0::double, 2) as decimal(18,2)) as d from base)""",
    "upload_summary": """
select (select count(*) from ledger) as total_ledger_rows,
  (select count(*) from bank) as total_bank_rows, (select count(*) from matches) as matched,
  (select count(*) from exact) as exact, (select count(*) from fuzzy) as fuzzy,
  (select count(*) from matches where tier = 'llm') as llm, (select count(*) from exceptions) as exception_count,
  (select min(cast(created_at as date)) from (select created_at from ledger union all
    select created_at from bank)) as start_date,
  (select max(cast(created_at as date)) from (select created_at from ledger union all
    select created_at from bank)) as end_date,
  (select count(*) from matches) / (select count(*) from ledger) as matched_share""",
    "upload_records": """
select 'S_' || row_id as txn_id, order_id, amount as txn_amount, refund_amount > 0 as had_refund,
  tax > 0 as gst_on_fee_flag, false as fee_amount_pending,
  cast(isodow(created_at) - 1 as int) as day_of_week,
  case when row_id in (select ledger_row_id from matches) then 'matched' else 'exception' end
    as reconciliation_status from ledger""",
    "upload_date_range": """
select min(cast(created_at as date)) as start_date, max(cast(created_at as date)) as end_date
from (select created_at from ledger union all select created_at from bank)""",
    "model_errors": """
select count(*) as n, round(avg(abs(deduction_pct - fee_pct)), 6) as mae,
  round(avg(case when abs(deduction_pct) > 1e-6
    then abs((deduction_pct - fee_pct) / deduction_pct) end) * 100, 6) as mape_pct,
  round(sqrt(avg((deduction_pct - fee_pct) * (deduction_pct - fee_pct))), 6) as rmse from base""",
    "curvature": """
select round(corr(r, s), 6) as corr_with_amount_sq,
  coalesce(stddev_pop(r) >= 1e-9 and stddev_pop(s) >= 1e-9 and abs(corr(r, s)) > 0.15, false)
    as curved, count(*) as n
from (select (fee_amount + tax_on_fee) / txn_amount - fee_pct as r, txn_amount ** 2 as s
  from base)""",
}


def _compose(body: str) -> str:
    names = {key.split("(")[0]: key for key in CTES}
    needed: set[str] = set()
    stack = [body]
    while stack:
        words = set(re.findall(r"\b\w+\b", stack.pop()))
        for name in names.keys() & words - needed:
            needed.add(name)
            stack.append(CTES[names[name]])
    parts = [f"{names[n]} as ({CTES[names[n]]}\n)" for n in names if n in needed]
    return f"with recursive {', '.join(parts)}\n{body}" if parts else body


def oracle_sql() -> dict[str, str]:
    return {name: _compose(body.strip()) for name, body in BODIES.items()}


