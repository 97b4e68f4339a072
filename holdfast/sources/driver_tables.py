"""The five raw tables derived from the driver's `customer` and `events` files."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.functions.numbers import ntz
from holdfast.operators.features import FeatureSpec, assemble, session_aggregate
from holdfast.operators.sessions import attach_session_id, session_slots, sessionize
from holdfast.schemas import PLAN_FEES, ActivityTables

# --- fixed values of the mapping -------------------------------------------------------
SEGMENT_TIER = {
    "BUILDING": "Basic",
    "FURNITURE": "Basic",
    "AUTOMOBILE": "Pro",
    "MACHINERY": "Pro",
    "HOUSEHOLD": "Enterprise",
}
SIGNUP = datetime(2023, 12, 1)
CUTOFF = datetime(2024, 1, 30)
OBSERVED_DAYS = 29
SESSION_GAP_HOURS = 6
CORE_EVENT = "click"
DEVICES = ("Desktop", "Mobile", "Tablet")
TICKET_CATEGORIES = ("billing", "bug", "feature_request", "onboarding")
OPEN_BELOW, ESCALATED_BELOW, STATUS_CYCLE = 9, 17, 20
# ---------------------------------------------------------------------------------------


def driver_spec(window_days: int = 1) -> FeatureSpec:
    return FeatureSpec(
        cutoff=CUTOFF, window_days=window_days, obs_days=OBSERVED_DAYS, core_event=CORE_EVENT, as_of=CUTOFF
    )


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


def load_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    tier = fee = None
    for segment, plan in SEGMENT_TIER.items():
        match = F.col("c_mktsegment") == segment
        tier = F.when(match, plan) if tier is None else tier.when(match, plan)
        fee = F.when(match, PLAN_FEES[plan]) if fee is None else fee.when(match, PLAN_FEES[plan])
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        ntz(SIGNUP).alias("signup_date"),
        tier.alias("plan_tier"),
        fee.cast("decimal(8,2)").alias("monthly_fee"),
    )


def _read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _ticket_status() -> F.Column:
    turn = F.col("event_id") % STATUS_CYCLE
    return F.when(turn < OPEN_BELOW, "open").when(turn < ESCALATED_BELOW, "escalated").otherwise("resolved")


def features_from_log(spark: SparkSession, sf_dir: str, spec: FeatureSpec) -> DataFrame:
    """The feature table in one scan of the event log.

    All four activity tables are views of one file here, so everything they contribute is summed per
    user and time slot together with the slot's first and last instant, then per session, then per user.
    """
    seen = F.col("ts") < ntz(spec.cutoff)
    purchase, ticket = F.col("event_type") == "purchase", F.col("event_type") == "error"
    cents = (F.col("value").cast("decimal(8,2)") * 100).cast("bigint")
    measures = {
        "total_events_60d": F.count_if(seen),
        "core_feature_usage_count": F.count_if(seen & (F.col("event_type") == spec.core_event)),
        "spend_cents": F.sum(F.when(seen & purchase, cents)),
        "later_orders": F.count_if(~seen & purchase),
        "support_ticket_count": F.count_if(seen & ticket),
        "unresolved_tickets": F.count_if(seen & ticket & _ticket_status().isin(*spec.unresolved)),
    }
    totals = [F.sum(m).alias(m) for m in measures]
    slots = session_slots(
        _read_log(spark, sf_dir), "ts", SESSION_GAP_HOURS, *(c.alias(m) for m, c in measures.items())
    )
    sessions = slots.groupBy("user_id", "session_no").agg(
        F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"), *totals
    )
    per_user = session_aggregate(sessions, spec, *totals).withColumn(
        "add_on_spend_60d", (F.col("spend_cents").cast("decimal(18,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")
    )
    return assemble(load_users(spark, sf_dir).join(per_user, "user_id", "left"), spec)


def load_driver_tables(spark: SparkSession, sf_dir: str, with_session_ids: bool = False) -> ActivityTables:
    """Lazy views; event rows carry their session id only on request, as that costs a join."""
    raw = _read_log(spark, sf_dir)
    events = raw.select(
        F.col("event_id"), F.col("user_id"), F.col("ts").alias("event_timestamp"),
        F.col("event_type").alias("event_name"),
    )
    sessions = sessionize(events, gap_hours=SESSION_GAP_HOURS).withColumn(
        "device_type", _pick(DEVICES, F.col("user_id") % len(DEVICES))
    )
    if with_session_ids:
        events = attach_session_id(events, gap_hours=SESSION_GAP_HOURS)
    orders = raw.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("order_id"), "user_id", F.col("ts").alias("order_timestamp"),
        F.col("value").cast("decimal(8,2)").alias("amount"),
    )
    tickets = raw.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("ticket_id"), "user_id", F.col("ts").alias("created_at"),
        _pick(TICKET_CATEGORIES, F.col("event_id") % len(TICKET_CATEGORIES)).alias("category"),
        _ticket_status().alias("status"),
    )
    return ActivityTables(load_users(spark, sf_dir), sessions, events, orders, tickets)
