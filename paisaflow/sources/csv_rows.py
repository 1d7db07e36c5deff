"""Uploaded ledger and bank CSV files to in-flight rows, bad rows to a quarantine."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paisaflow.functions.times import parse_export_timestamp
from paisaflow.operators.numbering import file_row_number
from paisaflow.schemas import TXN

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
NOT_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"


class ParsedRows(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


class CsvFormatError(ValueError):
    pass


def clean_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


# holds the raw line of a row that does not have the header's fields
BROKEN = "_broken"


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text under cleaned names, with ``row_num`` in file order and ``BROKEN``.

    A quote in a quoted field is doubled; a backslash is a character like any other. Files with
    line breaks in quoted fields cannot be split: they need ``multi_line``, which reads a file in one
    task, and are refused without it instead of being cut at the break.
    """
    reader = spark.read.options(quote='"', escape='"', multiLine=multi_line)
    first = reader.csv(path).limit(1).first()
    if first is None:
        raise CsvFormatError("CSV appears to be empty (no header row found).")
    if not multi_line:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).filter(quotes % 2 == 1).isEmpty():
            raise CsvFormatError("a quoted field goes on in the next line; read with multi_line=True")
    names = [clean_header(c or "") for c in first]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
    # all fields are parsed whatever columns are used, or a surplus field would go unseen
    scan = reader.options(
        header=True, columnNameOfCorruptRecord=BROKEN, columnPruning=False
    ).schema(schema).csv(path)
    return file_row_number(scan)


def _text(df: DataFrame, name: str) -> Column:
    """Trimmed text of a column, null when blank or when the file has no such column."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    trimmed = F.trim(F.col(name))
    return F.when(trimmed != "", trimmed)


def _number(df: DataFrame, name: str) -> Column:
    """The number, or 0 when blank or no number."""
    t = _text(df, name)
    return F.coalesce(F.when(t.rlike(NUMBER), t.try_cast("double")), F.lit(0.0))


def _row_id(df: DataFrame, prefix: str) -> Column:
    made = F.format_string(f"{prefix}%05d", F.col("row_num"))
    return F.coalesce(_text(df, "row_id"), made)


def _error(*checks: tuple[Column, Column]) -> Column:
    """The message of the first check that fires, after the row number."""
    out = F.lit(None).cast("string")
    for failed, message in reversed(checks):
        out = F.when(failed, message).otherwise(out)
    return F.when(
        out.isNotNull(),
        F.concat(F.lit("Row "), F.col("row_num").cast("string"), F.lit(": "), out),
    )


def _checks(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    amount, ts = _text(df, "amount"), _text(df, "timestamp")
    broken = F.col(BROKEN).isNotNull() if BROKEN in df.columns else F.lit(False)
    # The texts about amount and timestamp are part of the expected rejects.
    return {
        "fields": (broken, F.lit("not as many fields as the header has.")),
        "amount": (amount.isNull(), F.lit("missing required column 'amount'.")),
        "finite": (
            F.coalesce(amount.rlike(NOT_FINITE), F.lit(False)),
            F.concat(F.lit("amount is not a finite number '"), amount, F.lit("'.")),
        ),
        "timestamp": (ts.isNull(), F.lit("missing required column 'timestamp'.")),
        "format": (
            parse_export_timestamp(ts).isNull(),
            F.concat(F.lit("unrecognized timestamp format '"), ts, F.lit("'.")),
        ),
    }


def _split(df: DataFrame, error: Column, columns: dict[str, Column]) -> ParsedRows:
    judged = df.withColumn("error", error)
    good = judged.filter(F.col("error").isNull()).select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TXN.fields
    ])
    return ParsedRows(good, judged.filter(F.col("error").isNotNull()).select("row_num", "error"))


def parse_ledger(df: DataFrame) -> ParsedRows:
    """Text columns with ``row_num`` to ledger rows. A blank amount is an error."""
    c = _checks(df)
    error = _error(c["fields"], c["amount"], c["finite"], c["timestamp"], c["format"])
    tax = _number(df, "tax_on_fee")
    return _split(df, error, {
        "source": F.lit("internal_ledger"), "source_id": _row_id(df, "LEDG"),
        "order_id": _text(df, "order_id"), "amount": _number(df, "amount"),
        "currency": F.lit("INR"), "method": _text(df, "payment_method"),
        "status": F.coalesce(_text(df, "status"), F.lit("unknown")),
        "fee": _number(df, "fee_amount"), "tax_on_fee": tax,
        "created_at": parse_export_timestamp(_text(df, "timestamp")),
        "raw_tax_on_fee": tax, "refund_amount": _number(df, "refund_amount"),
    })


def parse_bank(df: DataFrame) -> ParsedRows:
    """Text columns with ``row_num`` to bank rows. A blank amount is 0."""
    c = _checks(df)
    at = parse_export_timestamp(_text(df, "timestamp"))
    return _split(df, _error(c["fields"], c["timestamp"], c["format"], c["finite"]), {
        "source": F.lit("bank_statement"), "source_id": _row_id(df, "BANK"),
        "order_id": _text(df, "order_id"), "amount": _number(df, "amount"),
        "currency": F.lit("INR"), "status": F.lit("credited"), "settled_at": at,
        "created_at": at, "utr_reference": _text(df, "utr_reference"),
    })


def strict(parsed: ParsedRows) -> DataFrame:
    """The rows, or an error with the first bad row's message."""
    first = parsed.rejects.orderBy("row_num").limit(1).first()
    if first is not None:
        raise CsvFormatError(first["error"])
    return parsed.rows


def read_ledger_csv(spark: SparkSession, path: str, multi_line: bool = False) -> ParsedRows:
    return parse_ledger(read_csv_text(spark, path, multi_line))


def read_bank_csv(spark: SparkSession, path: str, multi_line: bool = False) -> ParsedRows:
    return parse_bank(read_csv_text(spark, path, multi_line))
