"""The feature table for many cutoffs, from what each day added.

A day's partial has one row per active user: counts, sums, first and last session start of that day. Partials of days merge by
sum, minimum and maximum, so a user's state at a cutoff is the merge of all days before it, and the state at a later cutoff
is the earlier state merged with the days in between: raw rows and older days are not read again. Session counts of the last two
comparison windows ride along by day, at most 2 * window_days entries per user, as the windows move with the cutoff.

Partials are stored in one folder per day; storing a day again replaces it. Cutoffs are midnights. Late rows of a day that a
state already contains need that day stored again and the state rebuilt from the partials. Rows without a user or a time take no part, as
in `features.build_features`, whose result this equals.
"""

from __future__ import annotations

from datetime import date, datetime, time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.functions.numbers import ntz
from holdfast.operators.features import FeatureSpec, assemble
from holdfast.schemas import ActivityTables

SUMS = ("sessions_seen", "time_in_session", "total_events_60d", "core_feature_usage_count", "add_on_spend_60d", "orders_seen",
        "support_ticket_count", "unresolved_tickets")
SOURCES = {"sessions": "session_start", "events": "event_timestamp", "orders": "order_timestamp", "support_tickets": "created_at"}
DAYS = "recent_days"
WIDTHS = {name: "bigint" for name in SUMS} | {"time_in_session": "interval day to second", "add_on_spend_60d": "decimal(18,2)"}


def midnight(at: datetime) -> datetime:
    if at.time() != time():
        raise ValueError(f"days are the unit, so a cutoff is a midnight: {at}")
    return at


def day_partials(tables: ActivityTables, spec: FeatureSpec, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """(day, user_id, ...) of the rows from start on and before end; every table is read once, with the range pushed down."""
    measures: dict[str, dict[str, Column]] = {
        "sessions": {"sessions_seen": F.lit(1), "time_in_session": F.col("session_end") - F.col("session_start"),
                     "first_start": F.col("session_start"), "last_start": F.col("session_start")},
        "events": {"total_events_60d": F.col("event_id").isNotNull().cast("int"),
                   "core_feature_usage_count": F.coalesce(F.col("event_name") == spec.core_event, F.lit(False)).cast("int")},
        "orders": {"add_on_spend_60d": F.col("amount"), "orders_seen": F.lit(1)},
        "support_tickets": {"support_ticket_count": F.col("ticket_id").isNotNull().cast("int"),
                            "unresolved_tickets": F.coalesce(F.col("status").isin(*spec.unresolved), F.lit(False)).cast("int")},
    }
    kinds = WIDTHS | {"first_start": "timestamp_ntz", "last_start": "timestamp_ntz"}
    parts = []
    for name, ts in SOURCES.items():
        at = F.col(ts)
        rows = getattr(tables, name).filter(at.isNotNull() & F.col("user_id").isNotNull())
        rows = rows if start is None else rows.filter(at >= ntz(start))
        rows = rows if end is None else rows.filter(at < ntz(end))
        parts.append(rows.select(F.to_date(at).alias("day"), "user_id", *(
            measures[name].get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()
        )))
    return reduce(DataFrame.unionByName, parts).groupBy("day", "user_id").agg(*_merged())


def _merged() -> list[Column]:
    return [*(F.sum(c).cast(WIDTHS[c]).alias(c) for c in SUMS), F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start")]


def store_days(partials: DataFrame, path: str) -> None:
    """Adds days to a store, or replaces those that it has."""
    partials.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Stored partials of the days from start on and before end; other days' folders are not opened."""
    days = spark.read.schema(", ".join([*(f"{c} {k}" for c, k in WIDTHS.items()), "user_id bigint", "first_start timestamp_ntz", "last_start timestamp_ntz", "day date"])).parquet(path)
    days = days if start is None else days.filter(F.col("day") >= F.lit(midnight(start).date()))
    return days if end is None else days.filter(F.col("day") < F.lit(midnight(end).date()))


def _day_entry() -> Column:
    return F.when(F.col("sessions_seen") > 0, F.array(F.struct(F.col("day"), F.col("sessions_seen").alias("n"))))


def advanced(state: DataFrame | None, days: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The state at `spec.cutoff`: an earlier state merged with the days from its cutoff on (all days, if there is none)."""
    oldest = date.fromordinal(midnight(spec.cutoff).toordinal() - 2 * spec.window_days)
    fresh = days.withColumn(DAYS, _day_entry()).drop("day")
    rows = fresh if state is None else state.unionByName(fresh)
    kept = F.filter(F.flatten(F.collect_list(DAYS)), lambda x: x["day"] >= F.lit(oldest))
    return rows.groupBy("user_id").agg(*_merged(), kept.alias(DAYS))


def features_at(users: DataFrame, state: DataFrame, later: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The feature table at `spec.cutoff` from the state there; `later` are partials of days from the cutoff on, for the label."""
    recent, previous = F.lit(spec.recent_from.date()), F.lit(spec.previous_from.date())

    def counted(inside) -> Column:
        return F.aggregate(F.filter(DAYS, inside), F.lit(0).cast("bigint"), lambda total, x: total + x["n"])

    seen = state.withColumns({
        "recent": counted(lambda x: x["day"] >= recent),
        "previous": counted(lambda x: (x["day"] >= previous) & (x["day"] < recent)),
    }).drop("orders_seen", DAYS)
    after = later.groupBy("user_id").agg(F.sum("sessions_seen").alias("later_sessions"), F.sum("orders_seen").alias("later_orders"))
    return assemble(users.join(seen, "user_id", "left").join(after, "user_id", "left"), spec)
