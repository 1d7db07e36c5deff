"""Text expressions: ids and intents in questions, JSON clean-up, record sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.schemas import CASH_POSITION_KEYWORDS, FORWARD_LOOKING_KEYWORDS, ID_PATTERN


def ids_in(text: Column) -> Column:
    """Order and transaction ids named in a text, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(0))


def _has_any(text: Column, keywords: tuple[str, ...]) -> Column:
    return F.lower(text).rlike("|".join(keywords))


def is_forward_looking(text: Column) -> Column:
    return _has_any(text, FORWARD_LOOKING_KEYWORDS)


def is_cash_question(text: Column) -> Column:
    return _has_any(text, CASH_POSITION_KEYWORDS)


def float_text(c: Column) -> Column:
    """A number as plain decimal text with at least one decimal, as in ``20.0``."""
    plain = F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(F.abs(c).between(1e-3, 9_999_999.0), c.cast("string")).otherwise(plain)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# A JSON text value, escapes included: what is inside one is never touched.
_TEXT = r'"(?:[^"\\]|\\.)*"'


def json_block(text: Column) -> Column:
    """The JSON part of an answer: what stands between code fences, else everything from the first
    opening brace to the last closing one, else the same for brackets, else all of it."""
    inner = F.regexp_extract(text, r"```(?:json)?([^`]*(?:`{1,2}[^`]+)*)```", 1)
    span = lambda left, right: F.regexp_substr(text, F.lit(rf"(?s)\{left}.*\{right}"))
    return strip(F.coalesce(F.nullif(inner, F.lit("")), span("{", "}"), span("[", "]"), text))


def repair_json(block: Column) -> Column:
    """Quotes of print made plain, keys in single quotes given double ones, a comma before a closing
    bracket taken out; the last two outside of text values only."""
    plain = F.translate(block, "\u201c\u201d\u2018\u2019", "\"\"''")
    # a text value matches first and is put back as it is, so the other branch sees what is outside
    keyed = F.regexp_replace(plain, rf"({_TEXT})|'(\w+)'\s*(?=:)", '$1\u0001$2\u0001')
    keyed = F.regexp_replace(keyed, "\u0001\u0001", "")
    keyed = F.translate(keyed, "\u0001", '"')
    return F.regexp_replace(keyed, rf"({_TEXT})|,(?=\s*[\]}}])", "$1")


def with_clean_json(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """Adds the JSON text of raw answers: the block as it is when it parses, else repaired,
    else null. One step per column, so that no step is worked out twice."""
    blocks = df.withColumn("_block", json_block(F.col(column)))
    blocks = blocks.withColumn("_ok", F.try_parse_json("_block").isNotNull())
    repaired = F.when(~F.col("_ok"), repair_json(F.col("_block")))
    tried = blocks.withColumn("_fixed", repaired)
    good = F.when(F.col("_ok"), F.col("_block")).when(
        F.try_parse_json("_fixed").isNotNull(), F.col("_fixed")
    )
    return tried.withColumn(name, good).drop("_block", "_ok", "_fixed")


def answers_by_id(json: Column, value_schema: str) -> Column:
    """A cleaned object keyed by id as a map of typed values."""
    return F.from_json(json, f"map<string, {value_schema}>")


def record_text() -> Column:
    """The searchable sentence of a settlement record."""
    c = F.col
    reasons = F.flatten(F.transform(
        "reconciliation_reasons",
        lambda r: F.array_repeat(
            F.concat(
                F.lit("Exception: "), r["reason"], F.lit(" — "), r["explanation"], F.lit(".")
            ), r["rows"].cast("int"),
        ),
    ))
    return F.concat_ws(
        " ",
        F.concat(F.lit("Transaction "), c("txn_id"), F.lit(" for order "), c("order_id"), F.lit(".")),
        F.concat(
            F.lit("Amount ₹"), float_text(c("txn_amount")), F.lit(" via "), c("payment_method"),
            F.lit("."),
        ),
        F.concat(
            F.lit("Reconciliation status: "),
            F.coalesce("reconciliation_status", F.lit("unknown")), F.lit("."),
        ),
        F.concat(F.lit("Matched via "), c("reconciliation_tier"), F.lit(" tier.")),
        F.array_join(reasons, " "),
        F.concat(F.lit("Tax category: "), c("tax_category"), F.lit(".")),
        F.when(
            c("had_refund"),
            F.concat(F.lit("Refunded amount: ₹"), float_text(c("refund_amount")), F.lit(".")),
        ),
        F.when(c("had_dispute_flag"), F.lit("This transaction had a dispute.")),
        F.concat(
            F.lit("Settled in "), F.coalesce(c("days_to_settle").cast("string"), F.lit("None")),
            F.lit(" day(s), status "), c("status"), F.lit("."),
        ),
    )
