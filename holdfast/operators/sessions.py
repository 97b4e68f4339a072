"""Sessions from raw activity, and the gap between consecutive sessions.

Both work without ever meeting one user's raw rows in one task, so a single very
active user does not become a straggler.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.numbers import ntz, seconds
from holdfast.session import ship_package
from holdfast.sources.writers import materialize


def session_slots(activity: DataFrame, ts: str, gap_hours: int, *extra: Column) -> DataFrame:
    """One row per user and occupied time slot, numbered by the session it belongs to.

    A slot is exactly one gap wide, so all rows of a user inside it are closer than the
    gap and share a session: the first and last instant of each slot are all that
    sessionization needs. Hash aggregation combines them before the shuffle, and a
    user then holds at most (history / gap) rows, however many events they produced.
    """
    slots = activity.groupBy("user_id", F.window(ts, f"{gap_hours} hours").start.alias("slot")).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), *extra
    )
    in_order = Window.partitionBy("user_id").orderBy("slot")
    previous = F.lag("last_ts").over(in_order)
    opens = F.when(F.col("first_ts") < previous + F.expr(f"interval {gap_hours} hours"), 0).otherwise(1)
    return slots.withColumn("opens", opens).withColumn("session_no", F.sum("opens").over(in_order)).drop("opens")


def session_key(user: Column, start: Column) -> Column:
    return F.concat_ws("-", user.cast("string"), start.cast("string"))


def sessionize(activity: DataFrame, ts: str = "event_timestamp", gap_hours: int = 6) -> DataFrame:
    """Sessions (session_id, user_id, session_start, session_end); a pause >= the gap starts a new one."""
    spans = (
        session_slots(activity, ts, gap_hours)
        .groupBy("user_id", "session_no")
        .agg(F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"))
    )
    return spans.select(
        session_key(F.col("user_id"), F.col("session_start")).alias("session_id"),
        "user_id", "session_start", "session_end",
    )


def attach_session_id(activity: DataFrame, ts: str = "event_timestamp", gap_hours: int = 6) -> DataFrame:
    """Activity rows with the id of their session; joined per user and slot, so one user spreads out.

    Every row stays; one without a time or a user has no session.
    """
    whole = Window.partitionBy("user_id", "session_no")
    placed = F.col(ts).isNotNull() & F.col("user_id").isNotNull()
    timed = activity.filter(placed)
    slot_ids = session_slots(timed, ts, gap_hours).select(
        "user_id", "slot",
        session_key(F.col("user_id"), F.min("first_ts").over(whole)).alias("session_id"),
    )
    keyed = timed.withColumn("slot", F.window(ts, f"{gap_hours} hours").start)
    known = keyed.join(slot_ids, ["user_id", "slot"], "left").select(*activity.columns, "session_id")
    # rows that can't match pass by, else all of them would meet under one NULL key
    return known.unionByName(activity.filter(~placed).withColumn("session_id", F.lit(None).cast("string")))


def _lag_inside(batches):
    """Rows of one range in order, each with the start before it; `edge` marks the first row, which may have one elsewhere."""
    number, user, start = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        users, starts = batch.column("user_id").to_numpy(), batch.column("session_start")
        ticks = starts.cast(pa.int64()).to_numpy()
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = user is None
        same = np.r_[users[:1] == user if user is not None else np.zeros(1, bool), users[1:] == users[:-1]]
        before = np.r_[[start if user is not None else 0], ticks[:-1]]
        user, start = users[-1], ticks[-1]
        yield pa.RecordBatch.from_arrays([
            *(batch.column(c) for c in ("session_id", "user_id", "session_start")),
            pa.array(before, pa.int64(), mask=~same).cast(starts.type), pa.array(edge), pa.array([number] * batch.num_rows, pa.int32()),
        ], ["session_id", "user_id", "session_start", "prev_session_start", "edge", "range_no"])


def lag_ranges(sessions: DataFrame, ranges: int | None = None) -> DataFrame:
    """Sessions dealt by (user, start, id) into ranges of even size, with the lag inside each range; written once."""
    order = ["user_id", "session_start", "session_id"]
    rows = sessions.select("session_id", "user_id", "session_start")
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    start = rows.schema["session_start"].dataType.simpleString()
    ship_package(sessions.sparkSession)
    return materialize(dealt.mapInArrow(_lag_inside, f"{kinds}, prev_session_start {start}, edge boolean, range_no int"), "lag-ranges")


def lag_starts(sessions: DataFrame, cutoff=None, ranges: int | None = None) -> DataFrame:
    """Sessions with `prev_session_start`, i.e. LAG(session_start) per user in start order.

    Rows are sorted into ranges of (user, start, id) of even size, so neither a user nor an hour of a user that holds very
    many of them meets in one task. The lag is taken inside the ranges; only the first row of a range looks back, to the last
    row of the range before it, so one row per range is exchanged. Rows without a user or a start have no predecessor.
    """
    rows = sessions if cutoff is None else sessions.filter(F.col("session_start") < ntz(cutoff))
    placed = F.col("user_id").isNotNull() & F.col("session_start").isNotNull()
    lagged = lag_ranges(rows.filter(placed), ranges)
    names = ("session_id", "user_id", "session_start", "prev_session_start")
    here = F.struct("user_id", "session_start", "session_id")
    ends = lagged.groupBy("range_no").agg(F.max(here).alias("last"))  # one row per range
    borders = ends.select("range_no", F.lag("last").over(Window.orderBy("range_no")).alias("before"))
    first = lagged.filter("edge").drop("prev_session_start").join(borders, "range_no").withColumn(
        "prev_session_start", F.when(F.col("before.user_id") == F.col("user_id"), F.col("before.session_start"))
    )
    apart = rows.filter(~placed).select("session_id", "user_id", "session_start").withColumn("prev_session_start", F.lit(None).cast(rows.schema["session_start"].dataType))
    return lagged.filter("NOT edge").select(*names).unionByName(first.select(*names)).unionByName(apart)


DAY_SECONDS = 86400


def lag_gap(sessions: DataFrame, cutoff) -> DataFrame:
    """Mean days between consecutive starts from the LAG plan; users with one session drop out."""
    lagged = lag_starts(sessions, cutoff).filter(F.col("prev_session_start").isNotNull())
    sums = lagged.groupBy("user_id").agg(
        F.sum(F.col("session_start") - F.col("prev_session_start")).alias("span"), F.count("*").alias("gaps")
    )
    days = seconds(F.col("span")).cast("double") / F.col("gaps") / DAY_SECONDS
    return sums.select("user_id", F.round(days, 2).cast("decimal(18,2)").alias("avg_session_gap_days"))


def mean_gap_days(first: Column, last: Column, n: Column) -> Column:
    """The same mean without the lag: consecutive gaps telescope to (last - first) / (n - 1)."""
    days = seconds(last - first).cast("double") / (n - 1) / DAY_SECONDS
    return F.when(n > 1, F.round(days, 2).cast("decimal(18,2)"))


def telescoped_gap(sessions: DataFrame, cutoff) -> DataFrame:
    """Mean gap per user from min, max and count only: no window, no sort. NULL for one session."""
    spans = (
        sessions.filter(F.col("session_start") < ntz(cutoff))
        .groupBy("user_id")
        .agg(F.min("session_start").alias("a"), F.max("session_start").alias("b"), F.count("*").alias("n"))
    )
    return spans.select(
        "user_id", mean_gap_days(F.col("a"), F.col("b"), F.col("n")).alias("avg_session_gap_days")
    )


def session_features_by_join(sessions: DataFrame, cutoff) -> DataFrame:
    """Sessions LEFT JOIN the per-user gap, per user: sessions are counted first, then joined 1:1."""
    seen = sessions.filter(F.col("session_start") < ntz(cutoff))
    return (
        seen.groupBy("user_id").agg(F.count("session_id").alias("session_count"))
        .join(lag_gap(sessions, cutoff), "user_id", "left")
        .select("user_id", "session_count", "avg_session_gap_days")
    )
