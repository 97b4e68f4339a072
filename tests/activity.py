"""Hand-made raw tables around one cutoff."""

from datetime import datetime

from holdfast.operators.features import FeatureSpec
from holdfast.schemas import RAW_SCHEMAS, ActivityTables

CUTOFF = datetime(2026, 3, 2)
SPEC = FeatureSpec(cutoff=CUTOFF)


def at(text):
    return datetime.fromisoformat(text)


def tables(spark, users=(), sessions=(), events=(), orders=(), tickets=()):
    from decimal import Decimal

    rows = {
        "users": [(u, at("2025-11-01"), tier, Decimal(fee)) for u, tier, fee in users],
        "sessions": [(f"s{i}", u, at(a), at(b), "Desktop") for i, (u, a, b) in enumerate(sessions)],
        "events": [(f"e{i}", "s0", u, at(t), name) for i, (u, t, name) in enumerate(events)],
        "orders": [(f"o{i}", u, at(t), Decimal(a)) for i, (u, t, a) in enumerate(orders)],
        "support_tickets": [(f"t{i}", u, at(t), "bug", status) for i, (u, t, status) in enumerate(tickets)],
    }
    return ActivityTables(**{n: spark.createDataFrame(rows[n], s) for n, s in RAW_SCHEMAS.items()})


def sample(spark):
    """Users 1-7: none, one, two, recent only, previous only, both windows, order after the cutoff."""
    return tables(
        spark,
        users=[(1, "Basic", "29.00"), (2, "Pro", "99.00"), (3, "Enterprise", "299.00"), (4, "Basic", "29.00"),
               (5, "Basic", "29.00"), (6, "Pro", "99.00"), (7, "Pro", "99.00")],
        sessions=[
            (2, "2026-01-10 10:00:00", "2026-01-10 10:30:00"),
            (3, "2026-01-10 10:00:00", "2026-01-10 10:10:00"), (3, "2026-01-12 22:00:00", "2026-01-12 22:20:00"),
            (4, "2026-03-01 23:59:59", "2026-03-02 00:10:00"),
            (5, "2026-02-02 00:00:00", "2026-02-02 01:00:00"), (5, "2026-02-15 23:59:59", "2026-02-16 00:59:59"),
            (6, "2026-02-10 08:00:00", "2026-02-10 08:05:00"), (6, "2026-02-10 08:00:00", "2026-02-10 08:15:00"),
            (6, "2026-02-16 00:00:00", "2026-02-16 00:01:00"), (6, "2026-03-02 00:00:00", "2026-03-02 01:00:00"),
        ],
        events=[(2, "2026-01-10 10:01:00", "page_view"), (2, "2026-01-10 10:02:00", "feature_used"),
                (6, "2026-03-02 00:00:01", "feature_used")],
        orders=[(3, "2026-01-05 09:00:00", "19.00"), (3, "2026-02-05 09:00:00", "49.50"),
                (3, "2026-03-05 09:00:00", "99.00"), (7, "2026-03-10 09:00:00", "49.00")],
        tickets=[(2, "2026-02-01 09:00:00", "open"), (2, "2026-02-02 09:00:00", "resolved"),
                 (2, "2026-02-03 09:00:00", "escalated"), (2, "2026-03-03 09:00:00", "open")],
    )
