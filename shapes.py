"""What the derived settlement tables look like, for both engines.

One table of payment methods and one of row kinds. Sizes sit on the matcher's bands: a hair
inside, on and a hair outside of each, so that every comparison in the tiers is met from
both sides. Money is whole paise and time whole minutes; ``{div}`` is integer division.
"""

from __future__ import annotations

#: (name, parts of a hundred, fee in basis points, days to settle)
METHODS = (("card", 28, 165, 3), ("upi", 31, 12, 1), ("netbanking", 22, 95, 2), ("wallet", 19, 240, 4))

#: days off besides weekends, in the years of the orders
HOLIDAYS = tuple(f"{year}-{day}" for year in range(1992, 1999) for day in ("01-26", "05-01", "08-15", "12-25"))

_INSIDE_EXACT, _ON_EXACT, _OUTSIDE_EXACT = "v * 15 {div} 1000 - 100", "v * 15 {div} 1000", "v * 15 {div} 1000 + 100"
_FUZZY = "v * 8 {div} 100"

#: (kind, parts of a hundred, money of the row, minutes it is late); x picks among the sizes
KINDS = (
    ("exact", 47, "v", "0"),
    ("rounding", 13, "v + case x % 4 when 0 then -500 when 1 then {inside} when 2 then {on} else -({outside}) end", "0"),
    ("timestamp_drift", 12, "v", "case x % 4 when 0 then 359 when 1 then 360 when 2 then -361 else -45 end"),
    ("missing", 7, "v", "0"),
    ("duplicate", 9, "case when copy = 1 then v + {fuzzy} + x % 3 - 1 else v end", "case when copy = 1 then 5759 + x % 3 else 0 end"),
    ("partial_settlement", 5, "v - {fuzzy} * (1 + x % 2) {div} 2 - x % 2", "0"),
    ("late_settlement_window", 4, "v", "case x % 3 when 0 then 5700 when 1 then 5760 else 5761 end"),
    ("refund_not_debited", 3, "v + refund", "0"),
)


def by_share(number: str, rows, value) -> str:
    """A case over ``number`` in 0 to 99 by the rows' parts of a hundred."""
    upto, out = 0, []
    for row in rows:
        upto += row[1]
        out.append(f"when {number} < {upto} then {value(row)}")
    assert upto == 100
    return f"case {' '.join(out)} end"


def by_kind(column: int, div: str) -> str:
    """A case over ``kind`` with the money (2) or minutes (3) of each kind."""
    sizes = dict(inside=_INSIDE_EXACT, on=_ON_EXACT, outside=_OUTSIDE_EXACT, fuzzy=f"({_FUZZY})", div=div)
    text = lambda row: row[column].format(**sizes).format(div=div)
    return "case kind " + " ".join(f"when '{row[0]}' then {text(row)}" for row in KINDS) + " end"


METHOD = by_share("m", METHODS, lambda row: f"'{row[0]}'")
FEE_POINTS = f"greatest(0, {by_share('m', METHODS, lambda row: row[2])} + (k * 173) % 9901 % 31 - 15)"
DAYS = by_share("m", METHODS, lambda row: row[3])
KIND = by_share("h", KINDS, lambda row: f"'{row[0]}'")
DISPUTED, REFUNDED = "(k * 131) % 9941 % 100 < 6", "(k * 137) % 9931 % 100 < 11"
TAXED, PENDING = "(k * 139) % 9929 % 100 >= 5", "(k * 149) % 9923 % 100 < 3"


def tax(div: str) -> str:
    return f"(fee * 18 + 50) {div} 100"


def refund(div: str) -> str:
    """Between an eighth and the whole of the amount."""
    return f"amt * (1 + (k * 163) % 9887 % 8) {div} 8"


LATER_DAYS = "case when is_weekend_or_holiday then 1 + k % 3 else 0 end"
DISPUTE_DAYS = "case when had_dispute_flag then 2 + k % 5 else 0 end"
