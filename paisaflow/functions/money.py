"""Money expressions. Sums run on decimals so that the order of addition cannot matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def net_of(amount: Column, *deductions: Column) -> Column:
    """``amount`` less every deduction, left to right, null counted as zero."""
    net = zero_if_null(amount)
    for d in deductions:
        net = net - zero_if_null(d)
    return net


def expected_net(prefix: str = "") -> Column:
    """What the bank should show for a ledger row."""
    c = lambda name: F.col(f"{prefix}{name}")
    return (
        c("amount") - zero_if_null(c("fee")) - zero_if_null(c("raw_tax_on_fee"))
        - zero_if_null(c("refund_amount"))
    )


def net_settlement() -> Column:
    return net_of(
        F.col("txn_amount"), F.col("refund_amount"), F.col("fee_amount"), F.col("tax_on_fee")
    )


def exact(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def money_sum(c: Column) -> Column:
    """Sum to the paisa, as a double."""
    return F.sum(exact(c)).cast("double")


def band(amount: Column, absolute: float, share: float) -> Column:
    return F.greatest(F.lit(float(absolute)), F.lit(float(share)) * amount)


def deduction_pct() -> Column:
    parts = exact(F.col("fee_amount")) + exact(F.col("tax_on_fee")) + exact(F.col("refund_amount"))
    ratio = parts.cast("double") / F.col("txn_amount")
    return F.when(F.col("txn_amount") == 0, F.lit(0.0)).otherwise(F.round(ratio, 4))


def _fixed(c: Column, places: int) -> Column:
    """Fixed-point text of a value already rounded to ``places``."""
    return c.cast(f"decimal(30,{places})").cast("string")


def inr_full(c: Column) -> Column:
    """Rupee text with lakh grouping, e.g. ₹13,37,548.00."""
    text = _fixed(F.abs(c), 2)
    whole, paise = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    head = F.regexp_replace(whole, r"\d{3}$", "")
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(
        F.concat(
            F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), F.right(whole, F.lit(3))
        )
    )
    return F.concat(F.lit("₹"), F.when(c < 0, "-").otherwise(""), grouped, F.lit("."), paise)


def inr_short(c: Column) -> Column:
    """Rupee text in crore, lakh or thousand units."""
    a = F.abs(c)
    body = (
        F.when(a >= 10_000_000, F.concat(_fixed(a / 10_000_000, 2), F.lit("Cr")))
        .when(a >= 100_000, F.concat(_fixed(a / 100_000, 2), F.lit("L")))
        .when(a >= 1000, F.concat(_fixed(a / 1000, 1), F.lit("k")))
        .otherwise(_fixed(a, 0))
    )
    return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("₹"), body)


def percent_text(c: Column, places: int = 1) -> Column:
    return F.concat(_fixed(c * 100, places), F.lit("%"))


def signed_percent_text(c: Column, places: int = 1) -> Column:
    return F.concat(F.when(c > 0, "+").otherwise(""), percent_text(c, places))


def hours_text(c: Column) -> Column:
    return F.concat(_fixed(c, 1), F.lit("h"))


def drift_text(c: Column) -> Column:
    """Signed amount text; noise below half a paisa shows as zero."""
    v = F.when(F.abs(c) < 0.005, 0.0).otherwise(c)
    sign = F.when(v > 0, "+").when(v < 0, "-").otherwise("")
    return F.concat(sign, F.lit("₹"), _fixed(F.abs(v), 2))


def count_text(c: Column) -> Column:
    """Whole number with lakh grouping."""
    return F.regexp_replace(F.substring_index(inr_full(c), ".", 1), "₹", "")
