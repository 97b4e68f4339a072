"""The one-row-per-user feature table and its label."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.numbers import ntz, seconds, whole_days
from holdfast.operators.sessions import mean_gap_days
from holdfast.schemas import FEATURE_SCHEMA, ActivityTables


@dataclass(frozen=True)
class FeatureSpec:
    """Observation ends just before `cutoff`; the label window starts at `cutoff` and is open-ended.

    There is no lower bound on the observation, so "60d" columns cover all earlier history.
    Recency is measured from `as_of` (one second before the cutoff unless given).
    """

    cutoff: datetime
    window_days: int = 14
    obs_days: int = 60
    core_event: str = "feature_used"
    unresolved: tuple[str, ...] = ("open", "escalated")
    fee_periods: int = 2
    as_of: datetime | None = None

    @property
    def recent_from(self) -> datetime:
        return self.cutoff - timedelta(days=self.window_days)

    @property
    def previous_from(self) -> datetime:
        return self.cutoff - timedelta(days=2 * self.window_days)

    @property
    def measured_from(self) -> datetime:
        return self.as_of or self.cutoff - timedelta(seconds=1)


def before(column: str, spec: FeatureSpec) -> Column:
    return F.col(column) < ntz(spec.cutoff)


def session_aggregate(sessions: DataFrame, spec: FeatureSpec, *extra: Column) -> DataFrame:
    """Everything the feature table needs of `sessions`, label half included, in one scan and one shuffle.

    `extra` aggregates ride along.
    """
    start = F.col("session_start")
    seen = before("session_start", spec)
    return sessions.groupBy("user_id").agg(
        F.count_if(seen).alias("sessions_seen"),
        F.min(F.when(seen, start)).alias("first_start"),
        F.max(F.when(seen, start)).alias("last_start"),
        F.count_if(seen & (start >= ntz(spec.recent_from))).alias("recent"),
        F.count_if((start >= ntz(spec.previous_from)) & (start < ntz(spec.recent_from))).alias("previous"),
        F.sum(F.when(seen, F.col("session_end") - start)).alias("time_in_session"),
        F.count_if(~seen).alias("later_sessions"),
        *extra,
    )


def session_columns(spec: FeatureSpec) -> dict[str, Column]:
    """Per-user session features from the columns of `session_aggregate`."""
    seen = F.col("sessions_seen")
    minutes = seconds(F.col("time_in_session")).cast("double") / seen / 60
    return {
        "days_since_last_session": whole_days(ntz(spec.measured_from) - F.col("last_start")),
        "sessions_recent_14d": F.col("recent"),
        "sessions_previous_14d": F.col("previous"),
        "avg_session_duration_minutes": F.when(seen > 0, F.round(minutes, 2).cast("decimal(18,2)")),
        "avg_session_gap_days": mean_gap_days(F.col("first_start"), F.col("last_start"), seen),
    }


def session_features(sessions: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Session features of users with at least one session before the cutoff."""
    per_user = session_aggregate(sessions.filter(before("session_start", spec)), spec)
    return per_user.select("user_id", *(c.alias(name) for name, c in session_columns(spec).items()))


def event_features(events: DataFrame, spec: FeatureSpec) -> DataFrame:
    return events.filter(before("event_timestamp", spec)).groupBy("user_id").agg(
        F.count("event_id").alias("total_events_60d"),
        F.count_if(F.col("event_name") == spec.core_event).alias("core_feature_usage_count"),
    )


def order_aggregate(orders: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Spend before the cutoff and orders after it, in one pass."""
    seen = before("order_timestamp", spec)
    return orders.groupBy("user_id").agg(
        F.sum(F.when(seen, F.col("amount"))).cast("decimal(18,2)").alias("add_on_spend_60d"),
        F.count_if(~seen).alias("later_orders"),
    )


def order_features(orders: DataFrame, spec: FeatureSpec) -> DataFrame:
    return order_aggregate(orders.filter(before("order_timestamp", spec)), spec).select("user_id", "add_on_spend_60d")


def support_features(tickets: DataFrame, spec: FeatureSpec) -> DataFrame:
    return tickets.filter(before("created_at", spec)).groupBy("user_id").agg(
        F.count("ticket_id").alias("support_ticket_count"),
        F.count_if(F.col("status").isin(*spec.unresolved)).alias("unresolved_tickets"),
    )


def session_drop_pct(recent: Column, previous: Column) -> Column:
    """Decline from the previous window to the recent one; positive means fewer sessions.

    Activity that only exists in the recent window counts as -100.
    """
    change = (previous - recent).cast("double") * 100 / previous
    return (
        F.when((previous == 0) & (recent == 0), F.lit(0.0))
        .when(previous == 0, F.lit(-100.0))
        .otherwise(F.round(change, 2))
        .cast("decimal(18,2)")
    )


def build_features(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """Feature table: every user once, with behaviour before the cutoff and the churn label after it.

    Each activity table is reduced to one row per user before it meets `users`, so the left
    joins cannot fan out, and each is read once.
    """
    joined = tables.users
    for side in (
        session_aggregate(tables.sessions, spec),
        event_features(tables.events, spec),
        order_aggregate(tables.orders, spec),
        support_features(tables.support_tickets, spec),
    ):
        joined = joined.join(side, "user_id", "left")
    return assemble(joined, spec)


def assemble(joined: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Feature table from users carrying the per-user aggregates; absent activity becomes defaults."""
    session = session_columns(spec)

    def zero(column: Column | str) -> Column:
        return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))

    recent, previous = zero(session["sessions_recent_14d"]), zero(session["sessions_previous_14d"])
    active_later = (zero("later_sessions") > 0) | (zero("later_orders") > 0)
    features = {
        "user_id": F.col("user_id"),
        "plan_tier": F.col("plan_tier"),
        "monthly_fee": F.col("monthly_fee"),
        "total_spend_60d": F.col("monthly_fee") * spec.fee_periods + zero("add_on_spend_60d"),
        "days_since_last_session": F.coalesce(session["days_since_last_session"], F.lit(spec.obs_days)),
        "sessions_recent_14d": recent,
        "sessions_previous_14d": previous,
        "session_drop_pct": session_drop_pct(recent, previous),
        "total_events_60d": zero("total_events_60d"),
        "core_feature_usage_count": zero("core_feature_usage_count"),
        "avg_session_duration_minutes": zero(session["avg_session_duration_minutes"]),
        "avg_session_gap_days": session["avg_session_gap_days"],
        "support_ticket_count": zero("support_ticket_count"),
        "unresolved_tickets": zero("unresolved_tickets"),
        "churn_label": F.when(active_later, 0).otherwise(1),
    }
    return joined.select(*(features[f.name].cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA))


def later_active(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """Distinct users with a session or an order on or after the cutoff."""
    sessions = tables.sessions.filter(~before("session_start", spec)).select("user_id")
    orders = tables.orders.filter(~before("order_timestamp", spec)).select("user_id")
    return sessions.unionByName(orders).distinct()


def churn_labels(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """The label as a left join with a NULL test."""
    active = later_active(tables, spec).withColumn("active", F.lit(True))
    return tables.users.select("user_id").join(active, "user_id", "left").select(
        "user_id", F.when(F.col("active").isNull(), 1).otherwise(0).alias("churn_label")
    )


def churned_users(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """All users minus the later active ones."""
    return tables.users.select("user_id").join(later_active(tables, spec), "user_id", "left_anti")


def churn_summary(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """One row: users, churned, not churned, churn rate in percent."""
    n, churned = F.count("*"), F.count_if(F.col("churn_label") == 1)
    return churn_labels(tables, spec).agg(
        n.alias("total_users"),
        churned.alias("churned_users"),
        (n - churned).alias("non_churned_users"),
        F.round(F.when(n > 0, churned * F.lit(100.0) / n), 2).alias("churn_rate_pct"),
    )


def filter_profile(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """Rows of each activity table before the cutoff, after it, and in the two comparison windows."""
    parts = []
    for name, ts in (
        ("sessions", "session_start"), ("events", "event_timestamp"),
        ("orders", "order_timestamp"), ("support_tickets", "created_at"),
    ):
        seen = before(ts, spec)
        at = F.col(ts)
        parts.append(getattr(tables, name).agg(
            F.lit(name).alias("table_name"),
            F.count_if(seen).alias("observed_rows"),
            F.count_if(~seen).alias("future_rows"),
            F.count_if(seen & (at >= ntz(spec.recent_from))).alias("recent_rows"),
            F.count_if((at >= ntz(spec.previous_from)) & (at < ntz(spec.recent_from))).alias("previous_rows"),
        ))
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined
