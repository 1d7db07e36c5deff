"""Every query of the library over the driver's tables, by name.

A ``Workspace`` stands for the stored tables of one run: a stage's result is written once and
read by the queries of later stages, as separate jobs of a deployment would.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

import fixtures
import shapes
from paisaflow.functions import money, text, times, vectors
from paisaflow.operators import (
    adjudicate, daily, exact, fuzzy, nearest, records, reviews, scoring, similarity, stats, tax,
    truth,
)
from paisaflow.operators.keys import find_hot_keys
from paisaflow.operators.numbering import rank_in_groups
from paisaflow.plans import cash, forecast, learning_curve, reconcile, status, upload
from paisaflow.schemas import BANK_ROWS, RESOLUTIONS
from paisaflow.session import cut, ensure_checkpoint_dir, side_by_side
from paisaflow.sources import csv_rows, gateway, narration, normalize, tables

REFERENCE_DAY = "1996-06-03"
KEY_NUMBER = "cast(substring(row_id, 5, 9) as bigint)"


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixtures.read(self.spark, self.sf_dir, name)

    @cached_property
    def base(self) -> DataFrame:
        return cut(fixtures.base_transactions(self.spark, self.sf_dir))

    @cached_property
    def _sides(self) -> list[DataFrame]:
        """Both sides; matching does not read the base transactions."""
        make = (fixtures.ledger_rows, fixtures.bank_rows)
        return side_by_side(cut, *[m(self.spark, self.sf_dir) for m in make])

    @property
    def _ledger_side(self) -> DataFrame:
        return self._sides[0]

    @property
    def _bank_side(self) -> DataFrame:
        return self._sides[1]

    @property
    def ledger(self) -> DataFrame:
        """What the matcher sees; which mismatch a row carries is kept for the truth."""
        return self._ledger_side.drop("kind")

    @property
    def bank(self) -> DataFrame:
        return self._bank_side.drop("kind")

    @property
    def kinds(self) -> tuple[DataFrame, DataFrame]:
        own = lambda side: side.selectExpr("txn_id_hint as txn_id", "kind", "row_id")
        return own(self._ledger_side), own(self._bank_side)

    @property
    def ledger_txns(self) -> DataFrame:
        return normalize.ledger_to_txn(self.ledger)

    @property
    def bank_txns(self) -> DataFrame:
        return normalize.bank_to_txn(self.bank)

    @cached_property
    def hot_keys(self) -> DataFrame | None:
        """Looked for in what the exact tier leaves: an order it matched has one row on each side."""
        return find_hot_keys(self.tier1.ledger_rest, self.tier1.bank_rest)

    @cached_property
    def tier1(self) -> exact.MatchSplit:
        split = exact.exact_match(self.ledger_txns, self.bank_txns, keep=cut)
        return exact.MatchSplit(
            split.matches, *side_by_side(cut, split.ledger_rest, split.bank_rest)
        )

    @cached_property
    def tier2(self) -> exact.MatchSplit:
        split = fuzzy.fuzzy_match(
            self.tier1.ledger_rest, self.tier1.bank_rest, self.hot_keys, keep=cut
        )
        return exact.MatchSplit(
            split.matches, *side_by_side(cut, split.ledger_rest, split.bank_rest)
        )

    @cached_property
    def blank_split(self) -> exact.MatchSplit:
        """What the exact tier left, as exports without any order id: one key holds all rows."""
        blank = lambda rows: rows.withColumn("order_id", F.lit(None).cast("string"))
        split = fuzzy.fuzzy_match(blank(self.tier1.ledger_rest), blank(self.tier1.bank_rest), keep=cut)
        return exact.MatchSplit(
            split.matches, *side_by_side(cut, split.ledger_rest, split.bank_rest)
        )

    @cached_property
    def items(self) -> DataFrame:
        return cut(adjudicate.open_items(
            self.tier2.ledger_rest, self.tier2.bank_rest, self.hot_keys
        ))

    @cached_property
    def resolutions(self) -> DataFrame:
        """Answers to some open items: an agreement, a refusal, a wrong candidate."""
        answers = self.items.selectExpr(
            "row_id", f"{KEY_NUMBER} % 4 as kind", "candidate_id"
        ).filter("kind < 3").selectExpr(
            "row_id",
            "case kind when 0 then 'matched' when 1 then 'likely_duplicate' else 'matched' end"
            " as resolution",
            "case kind when 0 then candidate_id when 2 then 'BANK_other' end as matched_row_id",
            "concat('answer ', row_id) as explanation",
        )
        return answers.select(*RESOLUTIONS.names)

    @property
    def matches(self) -> DataFrame:
        return self.tier1.matches.unionByName(self.tier2.matches).unionByName(self.tier3.matches)

    @cached_property
    def exceptions(self) -> DataFrame:
        return self.tier3.exceptions

    @cached_property
    def tier3(self) -> adjudicate.Adjudication:
        return adjudicate.resolve(self.items, self.resolutions, keep=cut)

    @cached_property
    def truth(self) -> DataFrame:
        return cut(truth.build_ground_truth(self.base, *self.kinds))

    @property
    def owner(self) -> DataFrame:
        return truth.row_owner(self.truth_rows)

    @property
    def truth_rows(self) -> DataFrame:
        return truth.truth_rows(*self.kinds)

    @cached_property
    def tax_answers(self) -> DataFrame:
        """Answers for two thirds of the declined transactions, half of them unusable."""
        items = tax.fallback_items(self.base)
        return items.selectExpr("txn_id", "cast(substring(txn_id, 4) as bigint) % 3 as kind") \
            .filter("kind < 2").selectExpr(
                "txn_id", "if(kind = 0, 'taxable_sale', 'other') as category",
                "concat('answer ', txn_id) as reasoning",
            )

    @cached_property
    def classified(self) -> DataFrame:
        return cut(tax.classify(self.base, self.tax_answers).classifications)

    @cached_property
    def records(self) -> DataFrame:
        return cut(records.settlement_records(
            self.base, self.matches, self.exceptions, self.classified
        ))

    @cached_property
    def review_log(self) -> DataFrame:
        """Decisions on half of the exceptions, some decided twice, some reopened."""
        e = self.exceptions.selectExpr("row_id", "side", "order_id", f"{KEY_NUMBER} as k")
        at = "timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, 0, k % 86400)"
        first = e.filter("k % 2 = 0").selectExpr(
            "row_id", "side", "order_id",
            "case k % 3 when 0 then 'approved_match' when 1 then 'written_off'"
            " else 'manually_paired' end as decision",
            "if(k % 3 = 2 and k % 5 > 0, concat('P', k), null) as paired_row_id",
            "concat('note ', k) as note", "concat('reviewer_', k % 7) as reviewer",
            f"{at} as decided_at", "1L as seq",
        )
        again = e.filter("k % 6 = 0").selectExpr(
            "row_id", "side", "order_id", "'written_off' as decision",
            "cast(null as string) as paired_row_id", "'second' as note",
            "'reviewer_9' as reviewer", f"{at} as decided_at", "2L as seq",
        )
        opened = e.filter("k % 12 = 0").selectExpr(
            "row_id", "side", "order_id", f"'{reviews.REOPENED}' as decision",
            "cast(null as string) as paired_row_id", "cast(null as string) as note",
            "cast(null as string) as reviewer",
            f"{at} + make_dt_interval(1) as decided_at", "3L as seq",
        )
        accepted, _ = reviews.validate_decisions(first)
        return accepted.unionByName(again).unionByName(opened)

    @property
    def raw_decisions(self) -> DataFrame:
        return self.exceptions.selectExpr(
            "row_id", "side", f"{KEY_NUMBER} as k"
        ).selectExpr(
            "row_id", "side",
            "case k % 4 when 0 then 'approved_match' when 1 then 'written_off'"
            " when 2 then 'manually_paired' else 'ignored' end as decision",
            "if(k % 8 = 2, concat('P', k), null) as paired_row_id",
        )

    @cached_property
    def csv_ledger(self) -> DataFrame:
        """The ledger as raw text in mixed formats, with blanks and faults."""
        k = KEY_NUMBER
        at = "cast(timestamp as string)"
        day_first = (
            f"concat(substring({at}, 9, 2), '/', substring({at}, 6, 2), '/', left({at}, 4))"
        )
        raw = self.ledger.withColumn("day_first", F.expr(day_first)).selectExpr(
            "row_id as line", f"if({k} % 7 = 0, '  ', row_id) as row_id",
            f"if({k} % 11 = 0, ' ', order_id) as order_id",
            f"case when {k} % 97 = 0 then '' when {k} % 89 = 0 then 'nan'"
            f" when {k} % 83 = 0 then 'n/a' else cast(cast(amount as decimal(18,2)) as string)"
            " end as amount",
            f"case when {k} % 101 = 0 then null when {k} % 103 = 0 then 'soon'"
            f" else case {k} % 4 when 0 then replace(cast(timestamp as string), ' ', 'T')"
            " when 1 then cast(timestamp as string)"
            " when 2 then concat(day_first, substring(cast(timestamp as string), 11))"
            " else day_first end end as timestamp",
            f"if({k} % 5 = 0, '', payment_method) as payment_method",
            "cast(cast(fee_amount as decimal(18,2)) as string) as fee_amount",
            f"if({k} % 13 = 0, '-', cast(cast(tax_on_fee as decimal(18,2)) as string))"
            " as tax_on_fee",
            "cast(cast(refund_amount as decimal(18,2)) as string) as refund_amount",
            f"if({k} % 17 = 0, null, status) as status",
        )
        numbered = rank_in_groups(raw, [], ["line"], "position")
        return cut(numbered.withColumn("row_num", F.col("position") + 1).drop("line", "position"))

    def csv_file(self, rows: DataFrame) -> str:
        """Numbered text rows as CSV part files in row order, with a text that needs quotes."""
        path = f"{ensure_checkpoint_dir(self.spark)}/files/{uuid.uuid4().hex}"
        names = [f"  {c.title().replace('_', ' ')} " for c in rows.columns if c != "row_num"]
        rows.repartitionByRange("row_num").sortWithinPartitions("row_num").drop("row_num").toDF(
            *names
        ).withColumn("Note", F.lit('said "wait, no", then \\')).write.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
        return path

    def json_file(self) -> str:
        """The bank export as one object per line, every fiftieth cut short."""
        path = f"{ensure_checkpoint_dir(self.spark)}/files/{uuid.uuid4().hex}"
        line = F.to_json(F.struct(*[c for c in self.bank.columns if c in BANK_ROWS.names]))
        self.bank.select(
            F.when(F.expr(f"{KEY_NUMBER} % 50 = 0"), F.left(line, F.lit(30))).otherwise(line).alias("value")
        ).write.text(path)
        return path

    @cached_property
    def csv_bank(self) -> DataFrame:
        k = KEY_NUMBER
        raw = self.bank.selectExpr(
            "row_id as line", f"if({k} % 7 = 0, '', row_id) as row_id", "order_id",
            f"if({k} % 97 = 0, '', cast(cast(amount as decimal(18,2)) as string)) as amount",
            f"if({k} % 101 = 0, '', cast(timestamp as string)) as timestamp",
            f"if({k} % 19 = 0, ' ', utr_reference) as utr_reference",
        )
        numbered = rank_in_groups(raw, [], ["line"], "position")
        return cut(numbered.withColumn("row_num", F.col("position") + 1).drop("line", "position"))

    @cached_property
    def gateway_txns(self) -> DataFrame:
        keyed = self.base.selectExpr(
            "*", "cast(substring(txn_id, 4) as bigint) as k"
        )
        epoch = (
            "cast(cast(cast(created_at - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
            " as decimal(24,6)) as bigint)"
        )
        orders = keyed.filter("k % 9 > 0").selectExpr("order_id as id", f"{epoch} as created_at")
        payments = keyed.selectExpr("*", "explode(if(k % 10 = 0, array(1, 2), array(1))) as n") \
            .selectExpr(
                "concat('pay_', k, '_', n) as id", "order_id",
                "cast(round(txn_amount * 100) as bigint) as amount",
                "if(k % 4 = 0, null, 'INR') as currency", "payment_method as method", "status",
                "if(fee_amount_pending, null, cast(round(fee_amount * 100) as bigint)) as fee",
                "if(fee_amount_pending, null, cast(round(tax_on_fee * 100) as bigint)) as tax",
                "cast(round(refund_amount * 100) as bigint) as amount_refunded",
                "if(k % 5 = 0, null, concat('setl_', k % 100000)) as settlement_id",
                f"{epoch} + n as created_at", "concat('payment ', k) as description",
            )
        settlements = self.table("customer").filter("c_custkey % 10 < 7").selectExpr(
            "concat('setl_', c_custkey) as id",
            "800000000L + cast(c_custkey as bigint) * 3601 as created_at",
        )
        return gateway.gateway_txns(orders, payments, settlements)

    @property
    def questions(self) -> DataFrame:
        return self.base.selectExpr(
            "txn_id", "cast(substring(txn_id, 4) as bigint) as k", "order_id"
        ).selectExpr(
            "txn_id",
            "case k % 5 when 0 then concat('What happened to ', order_id, ' and ', txn_id, '?')"
            " when 1 then 'Show me the Forecast for next week'"
            " when 2 then concat('Is my CASH position fine after ', txn_id, '?')"
            " when 3 then 'How many disputed payments are there?'"
            " else concat('Will I be paid for (', order_id, ')? cashflow') end as question",
        )

    @property
    def raw_answers(self) -> DataFrame:
        return self.base.selectExpr(
            "txn_id", "cast(substring(txn_id, 4) as bigint) as k"
        ).selectExpr(
            "txn_id",
            r"""case k % 6
            when 0 then concat('```json\n{"', txn_id, '": {"category": "exempt", "reasoning": "a"}}\n```')
            when 1 then concat('Here you go: {"', txn_id, '": {"category": "exempt", "reasoning": "b",},} ok')
            when 2 then concat('{“', txn_id, '”: {“category”: “gst_on_fee”, “reasoning”: “c”}}')
            when 3 then concat('{\'', txn_id, '\': {\'category\' : "taxable_sale", "reasoning": "d"}}')
            when 4 then concat('{"', txn_id, '": {"category": "taxable_sale", "reasoning": "e"}}')
            else 'no answer for this one' end as answer""",
        )


# --- queries -----------------------------------------------------------------

Query = Callable[[Workspace], DataFrame]


def _match_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "ledger_row_id", "bank_row_id", "order_id", "tier", "amount_diff",
        "timestamp_diff_hours", "explanation",
    )


def _rest(df: DataFrame) -> DataFrame:
    return df.select("source_id", "order_id", "amount", "created_at")


def _expected_net(w: Workspace) -> DataFrame:
    return w.ledger_txns.select("source_id", money.expected_net().alias("expected_net"))


def _adjudicated(w: Workspace) -> adjudicate.Adjudication:
    return w.tier3


def _both_sides(w: Workspace) -> DataFrame:
    third = _adjudicated(w)
    return third.exceptions.unionByName(
        adjudicate.refused_candidates(w.items, third.exceptions)
    )


def _score(w: Workspace) -> DataFrame:
    return scoring.score(w.matches, w.exceptions, w.truth, w.owner)


def _drift(w: Workspace) -> DataFrame:
    _, rows = stats.list_matches(w.matches, w.ledger, w.bank, by_drift=True)
    return rows.select(
        "ledger_row_id", "bank_row_id", "tier", "amount_diff",
        F.col("ledger.amount").alias("ledger_amount"), F.col("bank.amount").alias("bank_amount"),
        F.col("tolerance.amount_abs").alias("amount_abs"),
        F.col("tolerance.timestamp_hours").alias("tolerance_hours"),
    )


def _tier_rows(w: Workspace) -> DataFrame:
    total, _ = stats.list_matches(w.matches, w.ledger, w.bank, tier="fuzzy")
    return total


def _flat_records(w: Workspace) -> DataFrame:
    return w.records.select(
        "txn_id", "order_id", "txn_amount", "payment_method", "status", "reconciliation_status",
        "reconciliation_tier",
        F.coalesce(F.aggregate(
            "reconciliation_reasons", F.lit(0).cast("bigint"), lambda a, r: a + r["rows"]
        ), F.lit(0)).alias("exception_rows"),
        "tax_category", "tax_reasoning",
    )


def _relation(w: Workspace) -> DataFrame:
    return records.find_relation(w.records, order_id="order_7").select(
        "transaction.txn_id", "transaction.order_id", "transaction.txn_amount",
        F.col("reconciliation.status").alias("reconciliation_status"),
        F.col("reconciliation.tier").alias("tier"),
        F.col("tax_classification.category").alias("category"),
        F.col("refund.amount").alias("refund_amount"), "dispute",
    )


def _reasons(w: Workspace) -> DataFrame:
    exploded = w.records.select("txn_id", F.explode("reconciliation_reasons").alias("r"))
    return exploded.select("txn_id", "r.*")


def _settlement_search(w: Workspace) -> records.SearchResult:
    return records.search_settlements(
        w.records, settled_after="1995-01-01", settled_before="1995-12-31", limit=20
    )


def _payment_search(w: Workspace) -> records.SearchResult:
    return records.search_payments(w.records, payment_method="wallet", had_refund=True)


def _invoice_search(w: Workspace) -> records.SearchResult:
    return records.search_invoices(w.records, category="exempt", limit=0)


def _queue(w: Workspace) -> DataFrame:
    return reviews.review_queue(w.exceptions, w.ledger, w.bank, w.review_log).select(
        "row_id", "side", "order_id", "reason", F.col("source_row.amount").alias("source_amount"),
        "candidates", "decision", "paired_row_id", "reviewer", "decided_at",
    )


def _pending(w: Workspace) -> DataFrame:
    return reviews.review_queue(
        w.exceptions, w.ledger, w.bank, w.review_log, status="pending"
    ).select("row_id", "side")


def _gmv_split(w: Workspace) -> DataFrame:
    features = daily.gmv_features(w.base)
    return daily.chronological_split(features, [*forecast.GMV.numeric, forecast.GMV.target])


def _naive(features: DataFrame, form: forecast.FeatureSet, today: str) -> DataFrame:
    return daily.naive_error(
        daily.chronological_split(features, [*form.numeric, form.target]), today, form.target
    )


def _observed_as_prediction(w: Workspace) -> DataFrame:
    return w.base.select(
        "created_at", "txn_amount", F.col("days_to_settle").alias("predicted_days_to_settle"),
        F.col("deduction_pct").alias("predicted_deduction_pct"),
    )


def _cashflow(w: Workspace) -> DataFrame:
    return cash.cashflow_forecast(_observed_as_prediction(w), 0.0037, REFERENCE_DAY)


def _status(w: Workspace) -> DataFrame:
    return status.stage_status(
        w.base, w.ledger, w.bank, w.matches, w.exceptions, w.classified
    )


def _null_profile(w: Workspace) -> DataFrame:
    return stats.null_profile(w.base)


def _describe(w: Workspace) -> DataFrame:
    d = stats.describe(w.base, "days_to_settle")
    return d.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _amounts_described(w: Workspace) -> DataFrame:
    d = stats.describe(w.base, "txn_amount")
    return d.select("n", "low", "high", *[F.round(x, 6).alias(x) for x in ("q25", "q50", "q75")], *[
        F.round(x, 4).alias(x) for x in ("mean", "std")
    ])


def _amount_quartiles(w: Workspace) -> DataFrame:
    d = stats.quartiles_by(w.base, "txn_amount", "payment_method")
    return d.withColumns({x: F.round(x, 6) for x in ("q25", "q50", "q75")})


def _blank_fuzzy(w: Workspace) -> DataFrame:
    return w.blank_split.matches.select(
        F.col("ledger_row_id").alias("l_id"), F.col("bank_row_id").alias("b_id"),
        F.col("amount_diff").alias("diff"), F.col("timestamp_diff_hours").alias("hours"),
    )


def _deduction_features(w: Workspace) -> DataFrame:
    return forecast.to_features(w.base).select(
        "txn_id", "is_weekend_or_holiday", "had_dispute_flag", "had_refund", "gst_on_fee_flag",
        "fee_deduction_pct", "refund_deduction_pct", money.deduction_pct().alias("deduction_pct"),
        money.net_settlement().alias("net_settlement"),
    )


def _calendar_flags(w: Workspace) -> DataFrame:
    return w.base.select(
        "txn_id", F.weekday("created_at").alias("day_of_week"),
        times.is_weekend_or_holiday(F.col("created_at"), shapes.HOLIDAYS).alias("is_weekend_or_holiday"),
        F.to_date("created_at").alias("created_date"),
        F.dayofmonth("created_at").alias("day_of_month"), F.month("created_at").alias("month"),
    )


def _money_text(w: Workspace) -> DataFrame:
    a = F.col("txn_amount")
    return w.base.select(
        "txn_id", money.inr_full(a).alias("full_text"),
        money.inr_full(a * 100 - 3_000_000).alias("large_text"),
        money.drift_text(F.round(F.col("fee_amount") - F.lit(10.0), 2)).alias("drift_text"),
        money.count_text(F.floor(a)).alias("count_text"),
    )


def _question_ids(w: Workspace) -> DataFrame:
    return w.questions.select(
        "txn_id", F.array_join(text.ids_in(F.col("question")), "|").alias("ids")
    )


def _question_intent(w: Workspace) -> DataFrame:
    q = F.col("question")
    return w.questions.select(
        "txn_id", text.is_forward_looking(q).alias("forward_looking"),
        text.is_cash_question(q).alias("cash_question"),
    )


def _query_vector(w: Workspace, vec_id: int) -> list[float]:
    return list(
        w.table("embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]
    )


def _cosine(w: Workspace) -> DataFrame:
    found = similarity.top_k(w.table("embeddings"), _query_vector(w, 7), 15, "vec_id")
    return found.select("vec_id", F.round("score", 6).alias("score"))


def _cosine_many(w: Workspace) -> DataFrame:
    queries = [(f"q{i}", _query_vector(w, i)) for i in (1, 2, 3)]
    found = similarity.top_k_many(w.table("embeddings"), queries, 10, "vec_id")
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _unit_vectors(w: Workspace) -> DataFrame:
    e = w.table("embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding")
    )
    unit = similarity.normalize_vectors(e)
    return unit.select(
        "vec_id",
        F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared_length"),
        F.round(F.element_at("embedding", 1), 6).alias("first_component"),
    )


def _parsed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("source_id", "order_id", "amount", "status", "created_at", *columns)


def _rejects(w: Workspace) -> DataFrame:
    tagged = lambda p, side: p.rejects.withColumn("side", F.lit(side))
    return tagged(csv_rows.parse_ledger(w.csv_ledger), "ledger").unionByName(
        tagged(csv_rows.parse_bank(w.csv_bank), "bank")
    )


def _gateway(w: Workspace) -> DataFrame:
    return w.gateway_txns.select(
        "source_id", "order_id", "amount", "currency", "method", "fee", "tax_on_fee",
        "settled_at", "created_at",
    )


def _gateway_transactions(w: Workspace) -> DataFrame:
    return normalize.gateway_txn_to_transaction(w.gateway_txns, "S_").select(
        "txn_id", "txn_amount", "day_of_week", "is_weekend_or_holiday", "had_refund",
        "refund_amount", "gst_on_fee_flag", "fee_amount", "fee_amount_pending", "tax_on_fee",
    )


def _narration(w: Workspace) -> DataFrame:
    given = w.ledger.filter(f"{KEY_NUMBER} % 3 = 0").selectExpr(
        "row_id", "concat('text for ', row_id) as narration"
    )
    return narration.with_narration(w.ledger, given).select("row_id", "narration")


def _json_repair(w: Workspace) -> DataFrame:
    answers = text.with_clean_json(w.raw_answers, "answer").select(
        "txn_id",
        F.explode_outer(text.answers_by_id(
            F.col("json"), "struct<category: string, reasoning: string>"
        )).alias("answered_id", "value"),
    )
    return answers.select("txn_id", "answered_id", "value.category", "value.reasoning")


def _upload_txns(w: Workspace) -> tuple[DataFrame, DataFrame]:
    return csv_rows.parse_ledger(w.csv_ledger).rows, csv_rows.parse_bank(w.csv_bank).rows


def _upload_summary(w: Workspace) -> DataFrame:
    outcome = reconcile.Reconciliation(
        w.tier1.matches, w.tier2.matches, w.tier3.matches, w.exceptions, w.items,
    )
    return upload.upload_summary(w.ledger_txns, w.bank_txns, outcome)


def _upload_records(w: Workspace) -> DataFrame:
    made = normalize.ledger_txn_to_transaction(w.ledger_txns, "S_")
    flagged = upload.flag_matched(made, w.ledger_txns, w.matches, "S_")
    return flagged.select(
        "txn_id", "order_id", "txn_amount", "had_refund", "gst_on_fee_flag",
        "fee_amount_pending", "day_of_week", "reconciliation_status",
    )


def _date_range(w: Workspace) -> DataFrame:
    return normalize.date_range(w.ledger_txns, w.bank_txns)


# --- fitted models: rows only, a fit has no SQL equivalent --------------------


def _rounded_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"mae": F.round("mae", 6), "mape_pct": F.round("mape_pct", 4)})


def _features(w: Workspace) -> DataFrame:
    return forecast.to_features(w.base)


def _model_days(w: Workspace) -> DataFrame:
    trained = forecast.train_transaction_model(_features(w), forecast.DAYS_TO_SETTLE)
    return _rounded_metrics(forecast.metrics_frame(w.spark, [trained.report]))


def _model_deduction(w: Workspace) -> DataFrame:
    made = forecast.train_deduction_model(_features(w))
    return _rounded_metrics(forecast.metrics_frame(w.spark, [made.fee.report, made.refund.report, made.combined]))


def _daily_models(w: Workspace) -> DataFrame:
    gmv = cut(daily.gmv_features(w.base))
    refunds = cut(daily.refund_features(w.base))
    settled = cut(daily.settlement_features(w.base))
    plans = (
        (gmv, forecast.GMV, "total_gmv"), (gmv, forecast.GMV_EXPERIMENT, "total_gmv"),
        (refunds, forecast.REFUND_EXPERIMENT, "total_refunds"),
        (settled, forecast.SETTLEMENT_EXPERIMENT, "total_settlement"),
    )
    reports = [forecast.train_daily_model(f, s, today).report for f, s, today in plans]
    names = ("label", "n_train", "n_test", "mae", "rmse", "naive_mae", "improvement_pct")
    return w.spark.createDataFrame(
        [tuple(r[n] for n in names) for r in reports],
        "label string, n_train long, n_test long, mae double, rmse double, naive_mae double,"
        " improvement_pct double",
    ).withColumns({
        **{n: F.round(n, 2) for n in ("mae", "rmse", "naive_mae")}, "improvement_pct": F.round("improvement_pct", 4),
    })


def _next_day_gmv(w: Workspace) -> DataFrame:
    frame = cut(daily.gmv_features(w.base))
    trained = forecast.train_daily_model(frame, forecast.GMV, "total_gmv")
    return forecast.predict_next_day_gmv(frame, trained.model)


def _learning_curve(w: Workspace) -> DataFrame:
    rows = _features(w).filter(~forecast.is_test_row())
    return learning_curve.learning_curve(rows, forecast.DAYS_TO_SETTLE)


def _model_cashflow(w: Workspace) -> DataFrame:
    rows = _features(w)
    days = forecast.train_transaction_model(rows, forecast.DAYS_TO_SETTLE)
    cuts = forecast.train_deduction_model(rows)
    predicted = forecast.predict_transactions(
        rows, days.model, cuts.fee.model, cuts.refund.model
    )
    return cash.cashflow_forecast(predicted, cuts.combined["mae"], REFERENCE_DAY)


def _curvature(w: Workspace) -> DataFrame:
    """The curvature test with the table's own fee rate as the prediction."""
    rows = forecast.to_features(w.base).withColumn("prediction", F.col("fee_pct"))
    found = forecast.curvature(rows, "fee_deduction_pct")
    return found.select(
        F.round("corr_with_amount_sq", 6).alias("corr_with_amount_sq"), "curved", "n"
    )


def _errors(w: Workspace) -> DataFrame:
    rows = w.base.withColumn("prediction", F.col("fee_pct"))
    e = forecast.errors(rows, "deduction_pct")
    return e.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "mape_pct", "rmse")])


def _residuals(w: Workspace) -> DataFrame:
    """Held-out residuals of the settlement-time model in 20 bins."""
    rows = _features(w)
    trained = forecast.train_transaction_model(rows, forecast.DAYS_TO_SETTLE)
    held_out = trained.model.transform(rows.filter(forecast.is_test_row()))
    found = forecast.residuals(held_out, "days_to_settle")
    return stats.equal_width_histogram(found, F.col("residual"))


def _semantic(w: Workspace) -> DataFrame:
    texts = similarity.index_texts(w.records)
    model = similarity.tfidf_model(texts)
    embed = similarity.tfidf_embedder(model)
    index = cut(similarity.extend_index(w.records, None, embed))
    asked = w.spark.createDataFrame([("disputed wallet transaction with a refund",)], "text string")
    vector = list(embed(asked).select("embedding").first()[0])
    return similarity.semantic_search(vector, w.records, index).select(
        "txn_id", "reconciliation_status", "payment_method", F.round("score", 6).alias("score")
    )


QUERIES: dict[str, Query] = {
    # sources and normalisation
    "ledger_normalize": lambda w: w.ledger_txns.select(
        "source", "source_id", "order_id", "amount", "currency", "method", "status", "fee",
        "tax_on_fee", "settled_at", "created_at", "raw_tax_on_fee", "refund_amount",
    ),
    "bank_normalize": lambda w: w.bank_txns.select(
        "source", "source_id", "order_id", "amount", "currency", "method", "status",
        "settled_at", "created_at", "utr_reference",
    ),
    "expected_net": _expected_net,
    "csv_file_ledger": lambda w: _parsed(
        csv_rows.read_ledger_csv(w.spark, w.csv_file(w.csv_ledger)).rows, "method", "fee", "tax_on_fee",
        "refund_amount",
    ),
    "csv_file_bank": lambda w: _parsed(
        csv_rows.read_bank_csv(w.spark, w.csv_file(w.csv_bank)).rows, "settled_at", "utr_reference"
    ),
    "json_file_rows": lambda w: tables.read_json_rows(
        w.spark, w.json_file(), "bank_rows", array_file=False
    ).rows.select("row_id", "order_id", "amount", "utr_reference"),
    "json_file_rejects": lambda w: tables.read_json_rows(
        w.spark, w.json_file(), "bank_rows", array_file=False
    ).rejects.select("raw"),
    "csv_ledger_parse": lambda w: _parsed(
        csv_rows.parse_ledger(w.csv_ledger).rows, "method", "fee", "tax_on_fee", "refund_amount"
    ),
    "csv_bank_parse": lambda w: _parsed(
        csv_rows.parse_bank(w.csv_bank).rows, "settled_at", "utr_reference"
    ),
    "csv_rejects": _rejects,
    "gateway_normalize": _gateway,
    "gateway_transactions": _gateway_transactions,
    "calibration_rows": lambda w: gateway.calibration_rows(w.gateway_txns),
    "narration": _narration,
    "json_repair": _json_repair,
    "transactions_in_time_order": lambda w: w.base.orderBy("created_at", "txn_id").select(
        "txn_id", "created_at", "txn_amount"
    ),
    "point_lookup": lambda w: w.base.filter(F.col("order_id") == "order_7").orderBy("txn_id").limit(1).select(
        "txn_id", "order_id", "txn_amount", "status"
    ),
    # reconciliation
    "exact_matches": lambda w: _match_rows(w.tier1.matches),
    "exact_residue_ledger": lambda w: _rest(w.tier1.ledger_rest),
    "exact_residue_bank": lambda w: _rest(w.tier1.bank_rest),
    "fuzzy_candidates": lambda w: fuzzy.fuzzy_candidates(
        w.tier1.ledger_rest, w.tier1.bank_rest
    ),
    "blank_key_fuzzy": _blank_fuzzy,
    "blank_key_pairs": lambda w: nearest.nearest_pairs(
        w.blank_split.ledger_rest, w.blank_split.bank_rest
    ).select("l_id", "b_id", "diff", "hours"),
    "fuzzy_matches": lambda w: _match_rows(w.tier2.matches),
    "fuzzy_residue_ledger": lambda w: _rest(w.tier2.ledger_rest),
    "fuzzy_residue_bank": lambda w: _rest(w.tier2.bank_rest),
    "exception_pairs": lambda w: nearest.nearest_pairs(
        w.tier2.ledger_rest, w.tier2.bank_rest, w.hot_keys
    ),
    "open_items": lambda w: w.items,
    "exceptions": lambda w: w.exceptions,
    "exceptions_by_reason_side": lambda w: stats.by_reason_and_side(w.exceptions),
    "exceptions_of_reason": lambda w: stats.filter_by_reason(
        _adjudicated(w).exceptions, "likely_duplicate"
    ),
    "adjudicated_matches": lambda w: _match_rows(_adjudicated(w).matches),
    "adjudicated_exceptions": lambda w: _adjudicated(w).exceptions,
    "exceptions_both_sides": _both_sides,
    "all_matches": lambda w: _match_rows(w.matches),
    "tier_counts": lambda w: stats.count_by(w.matches, "tier", name="matches"),
    "tier_waterfall": lambda w: stats.tier_waterfall(w.matches),
    "tier_shares": lambda w: stats.with_share(
        stats.count_by(w.matches, "tier", name="matches"), "matches"
    ),
    "matches_by_drift": _drift,
    "matches_of_tier_total": _tier_rows,
    # truth and scoring
    "ground_truth": lambda w: w.truth,
    "ground_truth_row_ids": lambda w: truth.nest_row_ids(w.truth, w.truth_rows).select(
        "txn_id", F.array_join("ledger_row_ids", "|").alias("ledger_row_ids"),
        F.array_join("bank_row_ids", "|").alias("bank_row_ids"),
    ),
    "mismatch_combos": lambda w: truth.mismatch_combinations(w.truth),
    "verdict_breakdown": lambda w: truth.verdict_breakdown(w.truth),
    "ingest_summary": lambda w: truth.ingest_summary(w.truth),
    "reconciliation_score": _score,
    "official_report": lambda w: scoring.official_report(_score(w)),
    "unmatchable_txns": lambda w: scoring.unmatchable_count(_score(w)),
    "false_negative_txns": lambda w: scoring.false_negatives(w.matches, w.truth, w.owner),
    "first_unresolved_txns": lambda w: scoring.first_unresolved(
        scoring.false_negatives(w.matches, w.truth, w.owner)
    ),
    # tax
    "tax_rules": lambda w: tax.classify_by_rules(w.base),
    "tax_fallback": lambda w: tax.classify_by_answers(
        tax.fallback_items(w.base), w.tax_answers
    ),
    "tax_fallback_items": lambda w: tax.fallback_items(w.base).select(
        "txn_id", "fee_amount", "tax_on_fee", "had_refund"
    ),
    "tax_summary": lambda w: tax.tax_summary(w.classified),
    "tax_totals": lambda w: tax.tax_totals(w.classified),
    "tax_accuracy": lambda w: tax.tax_accuracy(w.classified, w.base),
    "tax_shares": lambda w: stats.with_share(
        stats.count_by(w.classified, "category", name="txns"), "txns"
    ),
    "tax_list": lambda w: tax.list_classifications(w.classified, "exempt")[1],
    # records, searches, reviews
    "settlement_records": _flat_records,
    "record_reasons": _reasons,
    "record_text": lambda w: similarity.index_texts(w.records),
    "aggregate_stats": lambda w: records.aggregate_stats(w.records),
    "stat_breakdowns": lambda w: records.breakdowns(w.records),
    "audit_report": lambda w: records.audit_report(
        w.records, tax_summary=tax.tax_totals(w.classified)
    ),
    "relation_lookup": _relation,
    "search_payments": lambda w: _payment_search(w).rows,
    "search_payments_total": lambda w: _payment_search(w).totals,
    "search_settlements": lambda w: _settlement_search(w).rows,
    "search_settlements_total": lambda w: _settlement_search(w).totals,
    "search_invoices": lambda w: _invoice_search(w).rows,
    "search_invoices_total": lambda w: _invoice_search(w).totals,
    "review_queue": _queue,
    "review_queue_pending": _pending,
    "review_candidates": lambda w: reviews.review_candidates(w.exceptions, w.ledger, w.bank)
    .select("order_id", "side", "candidate_row_id", "amount"),
    "review_latest": lambda w: reviews.latest_decisions(w.review_log).select(
        "row_id", "side", "decision", "paired_row_id", "note", "reviewer", "decided_at"
    ),
    "review_counts": lambda w: reviews.review_counts(w.exceptions, w.review_log),
    "review_rejected": lambda w: reviews.validate_decisions(w.raw_decisions)[1].select(
        "row_id", "side", "decision", "error"
    ),
    "question_ids": _question_ids,
    "question_intent": _question_intent,
    "cosine_topk": _cosine,
    "cosine_topk_many": _cosine_many,
    "unit_vectors": _unit_vectors,
    "semantic_search": _semantic,
    # daily series, baselines, cash
    "daily_gmv": lambda w: daily.daily_gmv(w.base),
    "daily_refunds": lambda w: daily.daily_refunds(w.base),
    "daily_settlement_gross": lambda w: daily.daily_settlement_gross(w.base),
    "daily_settlement_net": lambda w: daily.daily_settlement_net(w.base),
    "gmv_features": lambda w: daily.gmv_features(w.base),
    "refund_features": lambda w: daily.refund_features(w.base),
    "settlement_features": lambda w: daily.settlement_features(w.base),
    "calendar_columns": lambda w: daily.with_calendar(daily.daily_gmv(w.base)).drop("total_gmv"),
    "chrono_split": lambda w: _gmv_split(w).select("date", "position", "is_train"),
    "latest_complete_day": lambda w: daily.latest_complete(
        daily.gmv_features(w.base), list(forecast.GMV.numeric)
    ).select("date", "total_gmv", "gmv_rolling_30"),
    "naive_gmv_mae": lambda w: _naive(
        daily.gmv_features(w.base), forecast.GMV, "total_gmv"
    ),
    "naive_refund_mae": lambda w: _naive(
        daily.refund_features(w.base), forecast.REFUND_EXPERIMENT, "total_refunds"
    ),
    "naive_settlement_mae": lambda w: _naive(
        daily.settlement_features(w.base), forecast.SETTLEMENT_EXPERIMENT, "total_settlement"
    ),
    "refund_baseline": lambda w: cash.next_day_refunds(w.base),
    "settlement_baseline": lambda w: cash.next_day_settlement(w.base),
    "cash_position": lambda w: cash.cash_position(w.base),
    "date_spine_cashflow": _cashflow,
    "cashflow_window_total": lambda w: cash.window_total(_cashflow(w)),
    # profiles
    "stage_status": _status,
    "source_counts": lambda w: stats.count_by(w.base, "source"),
    "null_profile": _null_profile,
    "flag_sums": lambda w: stats.flag_sums(
        w.base, "is_weekend_or_holiday", "had_dispute_flag", "had_refund", "gst_on_fee_flag"
    ),
    "target_describe": _describe,
    "amount_describe": _amounts_described,
    "amount_quartiles_by_method": _amount_quartiles,
    "status_counts": lambda w: stats.count_by(w.base, "status"),
    "days_histogram": lambda w: stats.integer_histogram(w.base, "days_to_settle"),
    "days_quartiles_by_method": lambda w: stats.quartiles_by(
        w.base, "days_to_settle", "payment_method"
    ),
    "residual_histogram": lambda w: stats.equal_width_histogram(
        w.base, F.col("deduction_pct") - F.col("fee_pct")
    ),
    "deduction_features": _deduction_features,
    "calendar_flags": _calendar_flags,
    "money_text": _money_text,
    "upload_summary": _upload_summary,
    "upload_records": _upload_records,
    "upload_date_range": _date_range,
    # models
    "model_errors": _errors,
    "curvature": _curvature,
    "model_days_to_settle": _model_days,
    "model_deduction": _model_deduction,
    "model_daily": _daily_models,
    "next_day_gmv": _next_day_gmv,
    "learning_curve": _learning_curve,
    "model_cashflow": _model_cashflow,
    "model_residuals": _residuals,
}

_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of this session and folder, made on first use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir)
    return _open[key]
