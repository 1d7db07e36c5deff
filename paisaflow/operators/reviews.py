"""Human decisions on exceptions: an append-only log and its latest view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.schemas import REVIEW_DECISIONS, REVIEW_LOG

REOPENED = "reopened"
KEY = ["row_id", "side"]


def validate_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with an ``error``)."""
    unpaired = (F.col("decision") == "manually_paired") & (
        F.coalesce("paired_row_id", F.lit("")) == ""
    )
    # Both texts are part of the expected answers.
    known = F.coalesce(F.col("decision").isin(*REVIEW_DECISIONS), F.lit(False))
    error = F.when(
        ~known, F.lit(f"decision must be one of {sorted(REVIEW_DECISIONS)}")
    ).when(unpaired, "paired_row_id is required when decision is 'manually_paired'")
    judged = decisions.withColumn("error", error)
    return (
        judged.filter(F.col("error").isNull()).drop("error"),
        judged.filter(F.col("error").isNotNull()),
    )


def _stamped(rows: DataFrame) -> DataFrame:
    """The log columns, decided now in UTC; later rows of a batch come after earlier ones."""
    now = F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    given = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)
             .alias(f.name) for f in REVIEW_LOG.fields if f.name not in ("decided_at", "seq")]
    return rows.select(
        *given, now.alias("decided_at"), F.monotonically_increasing_id().alias("seq")
    )


def decide(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log rows to append, rejected decisions). A later decision on a key replaces the
    earlier ones in ``latest_decisions``; nothing is rewritten."""
    accepted, rejected = validate_decisions(decisions)
    return _stamped(accepted), rejected


def reopen(keys: DataFrame) -> DataFrame:
    """Log rows that take the decisions on ``row_id, side`` back."""
    return _stamped(keys.select(*KEY, F.lit(REOPENED).alias("decision")))


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision per key, without the keys last reopened.

    An aggregation, not a window: a key with very many decisions combines in every task.
    """
    others = [c for c in log.columns if c not in (*KEY, "decided_at", "seq")]
    last = log.groupBy(*KEY).agg(
        F.max(F.struct("decided_at", "seq", *others)).alias("d")
    ).select(*KEY, "d.*")
    return last.filter(F.col("decision") != REOPENED).select(*log.columns)


def review_queue(
    exceptions: DataFrame,
    ledger: DataFrame,
    bank: DataFrame,
    log: DataFrame,
    status: str | None = None,
) -> DataFrame:
    """Exceptions with their source row, their decision and the number of candidate rows.

    Candidates are every opposite row of the same order. They are listed once per order and
    side by ``review_candidates`` instead of once per exception.
    """
    reviews = latest_decisions(log).select(
        *KEY, "decision", "paired_row_id", "note", "reviewer", "decided_at"
    )
    queue = exceptions.join(reviews, KEY, "left")
    if status == "pending":
        queue = queue.filter(F.col("decision").isNull())
    elif status == "resolved":
        queue = queue.filter(F.col("decision").isNotNull())
    source = lambda df, name: df.select(
        "row_id", F.struct("amount", "timestamp", "narration").alias(name)
    )
    queue = queue.join(source(ledger, "l"), "row_id", "left").join(
        source(bank, "b"), "row_id", "left"
    )
    counts = _opposite_rows(ledger, bank).groupBy("order_id", "side").agg(
        F.count("*").alias("candidates")
    )
    # rows without an order have no candidates and stay out of the join
    named = queue.filter(F.col("order_id").isNotNull()).join(counts, ["order_id", "side"], "left")
    blank = queue.filter(F.col("order_id").isNull())
    return named.unionByName(blank, allowMissingColumns=True).select(
        *exceptions.columns, F.coalesce("l", "b").alias("source_row"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), "decision", "paired_row_id",
        "note", "reviewer", "decided_at",
    )


def _opposite_rows(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows under the side of the exceptions they are candidates for."""
    def rows(df: DataFrame, side: str) -> DataFrame:
        return df.filter(F.coalesce("order_id", F.lit("")) != "").select(
            "order_id", F.lit(side).alias("side"), F.col("row_id").alias("candidate_row_id"),
            "amount", "timestamp",
        )

    return rows(bank, "ledger").unionByName(rows(ledger, "bank"))


def review_candidates(exceptions: DataFrame, ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Candidate rows per order and exception side, matched ones too."""
    return _opposite_rows(ledger, bank).join(
        exceptions.select("order_id", "side"), ["order_id", "side"], "left_semi"
    )


def review_counts(exceptions: DataFrame, log: DataFrame) -> DataFrame:
    decided = latest_decisions(log).select(*KEY, F.lit(True).alias("decided"))
    return exceptions.join(decided, KEY, "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("decided").isNull()).alias("pending"),
        F.count_if("decided").alias("resolved"),
    )
