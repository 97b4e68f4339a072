"""Schemas of the raw and derived tables, and the fixed vocabularies they use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

# --- fixed values -----------------------------------------------------------------
PLAN_TIERS = ("Basic", "Pro", "Enterprise")
PLAN_FEES = {"Basic": 29, "Pro": 99, "Enterprise": 299}

NUMERIC_FEATURES = (
    "monthly_fee",
    "total_spend_60d",
    "days_since_last_session",
    "sessions_recent_14d",
    "sessions_previous_14d",
    "session_drop_pct",
    "total_events_60d",
    "core_feature_usage_count",
    "avg_session_duration_minutes",
    "avg_session_gap_days",
    "support_ticket_count",
    "unresolved_tickets",
)
ONE_HOT_FEATURES = tuple(f"plan_tier_{tier}" for tier in PLAN_TIERS)
FEATURES = NUMERIC_FEATURES + ONE_HOT_FEATURES
LABEL = "churn_label"
# ----------------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)

RAW_SCHEMAS = {
    "users": T.StructType([
        T.StructField("user_id", T.LongType()),
        T.StructField("signup_date", T.TimestampNTZType()),
        T.StructField("plan_tier", T.StringType()),
        T.StructField("monthly_fee", T.DecimalType(8, 2)),
    ]),
    "sessions": T.StructType([
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("session_start", T.TimestampNTZType()),
        T.StructField("session_end", T.TimestampNTZType()),
        T.StructField("device_type", T.StringType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_timestamp", T.TimestampNTZType()),
        T.StructField("event_name", T.StringType()),
    ]),
    "orders": T.StructType([
        T.StructField("order_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("order_timestamp", T.TimestampNTZType()),
        T.StructField("amount", T.DecimalType(8, 2)),
    ]),
    "support_tickets": T.StructType([
        T.StructField("ticket_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("category", T.StringType()),
        T.StructField("status", T.StringType()),
    ]),
}

PRIMARY_KEYS = {
    "users": "user_id",
    "sessions": "session_id",
    "events": "event_id",
    "orders": "order_id",
    "support_tickets": "ticket_id",
}

FEATURE_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("plan_tier", T.StringType()),
    T.StructField("monthly_fee", T.DecimalType(8, 2)),
    T.StructField("total_spend_60d", MONEY),
    T.StructField("days_since_last_session", T.IntegerType()),
    T.StructField("sessions_recent_14d", T.LongType()),
    T.StructField("sessions_previous_14d", T.LongType()),
    T.StructField("session_drop_pct", MONEY),
    T.StructField("total_events_60d", T.LongType()),
    T.StructField("core_feature_usage_count", T.LongType()),
    T.StructField("avg_session_duration_minutes", MONEY),
    T.StructField("avg_session_gap_days", MONEY),
    T.StructField("support_ticket_count", T.LongType()),
    T.StructField("unresolved_tickets", T.LongType()),
    T.StructField("churn_label", T.IntegerType()),
])

DRIVER_STRUCT = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("feature_value", T.DoubleType()),
    T.StructField("shap_value", T.DoubleType()),
    T.StructField("direction", T.StringType()),
    T.StructField("explanation", T.StringType()),
])

EXPLANATION_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("actual_churn_label", T.IntegerType()),
    T.StructField("predicted_churn_probability", T.DoubleType()),
    T.StructField("predicted_class_0_50", T.IntegerType()),
    T.StructField("base_value_log_odds", T.DoubleType()),
    T.StructField("top_driver_1", DRIVER_STRUCT),
    T.StructField("top_driver_2", DRIVER_STRUCT),
    T.StructField("top_driver_3", DRIVER_STRUCT),
])

ACTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("churn_probability", T.DecimalType(6, 4)),
    T.StructField("action_name", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("discount_pct", T.DecimalType(5, 1)),
    T.StructField("ltv", MONEY),
    T.StructField("net_roi", MONEY),
    T.StructField("execution_status", T.StringType()),
])


@dataclass(frozen=True)
class ActivityTables:
    """The five raw tables."""

    users: DataFrame
    sessions: DataFrame
    events: DataFrame
    orders: DataFrame
    support_tickets: DataFrame

    def items(self):
        return [(name, getattr(self, name)) for name in RAW_SCHEMAS]
