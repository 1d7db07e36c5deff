"""Hand-made rows and an independent sequential model of the greedy choices."""

from __future__ import annotations

import datetime as dt

from paisaflow.schemas import TXN


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def ledger(**change):
    row = dict(
        source="internal_ledger", source_id="LEDG00001", order_id="order_1", amount=1000.0,
        currency="INR", method="card", status="settled", fee=20.0,
        created_at=at("2025-06-01T10:00:00"), raw_tax_on_fee=3.6, refund_amount=0.0,
    )
    return {**row, **change}


def bank(**change):
    row = dict(
        source="bank_statement", source_id="BANK00001", order_id="order_1", amount=976.4,
        currency="INR", status="credited", created_at=at("2025-06-01T12:00:00"),
    )
    return {**row, **change}


def txns(spark, *rows):
    return spark.createDataFrame(
        [tuple(r.get(name) for name in TXN.names) for r in rows], TXN
    )


def net(l):
    return l["amount"] - (l["fee"] or 0.0) - (l["raw_tax_on_fee"] or 0.0) - (
        l["refund_amount"] or 0.0
    )


def gap(l, b):
    return abs(b["amount"] - net(l))


def hours(l, b):
    return abs((b["created_at"] - l["created_at"]).total_seconds()) / 3600


def greedy(ledger_rows, bank_rows, cost):
    """Pairs by ascending (cost, ledger id, bank id); ``cost`` may return None for no pair."""
    by_key = {}
    for b in bank_rows:
        by_key.setdefault(b["order_id"] or "", []).append(b)
    edges = []
    for l in ledger_rows:
        for b in by_key.get(l["order_id"] or "", []):
            c = cost(l, b)
            if c is not None:
                edges.append((c, l["source_id"], b["source_id"]))
    used, pairs = set(), set()
    for _, l, b in sorted(edges):
        if l not in used and b not in used:
            used |= {l, b}
            pairs.add((l, b))
    return pairs


def fuzzy_cost(l, b):
    d, h = gap(l, b), hours(l, b)
    if d <= max(30.0, 0.08 * l["amount"]) and h <= 96:
        return d / max(l["amount"], 1.0) + h / 96.0
    return None
