import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from holdfast.operators import sessions as ses

START = datetime(2024, 1, 1)
GAP = timedelta(hours=6)
EVENTS = "event_id bigint, user_id bigint, event_timestamp timestamp_ntz"


def make_events(seed, users=12, n=600):
    """Random activity: one user holds a third of it, with ties and pauses of exactly the gap."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.34 else rng.randrange(users)
        rows.append((i, user, START + timedelta(hours=rng.randrange(0, 400), minutes=rng.choice([0, 0, 1, 59]))))
    rows += [(n, 99, START), (n + 1, 99, START + GAP), (n + 2, 99, START + 2 * GAP - timedelta(microseconds=1))]
    return rows


def brute_sessions(rows):
    result = []
    for user in {r[1] for r in rows}:
        current = None
        for ts in sorted(r[2] for r in rows if r[1] == user):
            if current and ts - current[1] < GAP:
                current[1] = ts
            else:
                current = [ts, ts]
                result.append((user, current))
    return sorted((u, a, b) for u, (a, b) in result)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessionize_equals_brute_force(spark, seed):
    rows = make_events(seed)
    found = ses.sessionize(spark.createDataFrame(rows, EVENTS))
    assert sorted((r["user_id"], r["session_start"], r["session_end"]) for r in found.collect()) == brute_sessions(rows)
    assert found.select("session_id").distinct().count() == found.count()


def test_a_heavy_user_collapses_before_any_window(spark):
    events = spark.range(200_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("user_id"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 7919 % 864_000).cast("decimal(18,6)")))
        .alias("event_timestamp"),
    )
    slots = ses.session_slots(events, "event_timestamp", 6)
    per_user = slots.groupBy("user_id").count()
    assert per_user.agg(F.max("count")).first()[0] <= 10 * 24 / 6  # ten days of six-hour slots
    assert events.filter("user_id = 0").count() > 60_000


def test_pause_of_exactly_the_gap_splits(spark):
    rows = [r for r in make_events(1) if r[1] == 99]
    assert ses.sessionize(spark.createDataFrame(rows, EVENTS)).count() == 2


def test_attached_session_ids_point_to_their_session(spark):
    events = spark.createDataFrame(make_events(4), EVENTS)
    tagged = ses.attach_session_id(events)
    assert tagged.count() == events.count()
    joined = tagged.join(ses.sessionize(events), ["session_id", "user_id"])
    inside = joined.filter(F.col("event_timestamp").between(F.col("session_start"), F.col("session_end")))
    assert inside.count() == events.count()


def test_rows_without_a_time_or_user_keep_their_place(spark):
    rows = make_events(5, n=50) + [(900, 0, None), (901, None, START), (902, None, None), (903, 7, datetime(1970, 1, 1))]
    tagged = {r["event_id"]: r["session_id"] for r in ses.attach_session_id(spark.createDataFrame(rows, EVENTS)).collect()}
    assert len(tagged) == len(rows)
    assert tagged[900] is tagged[901] is tagged[902] is None and tagged[903].startswith("7-1970")


def test_one_hour_of_one_user_holds_a_third(spark):
    rows = make_events(6, n=300) + [(1000 + i, 3, START + timedelta(seconds=i)) for i in range(150)]
    tagged = ses.attach_session_id(spark.createDataFrame(rows, EVENTS)).filter("event_id >= 1000")
    assert tagged.select("session_id").distinct().count() == 1 and tagged.count() == 150


def random_sessions(seed, n=400):
    rng = random.Random(seed)
    return [
        (f"s{i}", 0 if rng.random() < 0.34 else rng.randrange(1, 9),
         START + timedelta(days=rng.choice([0, 0, 1, 5, 6, 20]), minutes=rng.randrange(0, 1440, 7)))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [5, 6])
def test_lag_equals_brute_force(spark, seed):
    rows = random_sessions(seed)
    frame = spark.createDataFrame(rows, "session_id string, user_id bigint, session_start timestamp_ntz")
    got = {r["session_id"]: r["prev_session_start"] for r in ses.lag_starts(frame).collect()}
    want = {}
    for user in {r[1] for r in rows}:
        previous = None
        for sid, _, ts in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            want[sid], previous = previous, ts
    assert got == want


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_lag_over_any_number_of_ranges(spark, ranges):
    """Ties in start, ranges with one user, users over many ranges, and rows without a user or a start."""
    rows = random_sessions(8, 200) + [(f"t{i}", 5, START) for i in range(60)]
    lost = [("x1", None, START), ("x2", None, START), ("x3", 5, None), ("x4", None, None)]
    frame = spark.createDataFrame(rows + lost, "session_id string, user_id bigint, session_start timestamp_ntz").repartition(3)
    got = {r["session_id"]: r["prev_session_start"] for r in ses.lag_starts(frame, ranges=ranges).collect()}
    want = {sid: None for sid, _, _ in lost}
    for user in {r[1] for r in rows}:
        previous = None
        for sid, _, ts in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            want[sid], previous = previous, ts
    assert got == want
    assert ses.lag_starts(frame.limit(0), ranges=ranges).count() == 0


def test_an_hour_with_a_third_of_the_rows_spreads_over_ranges(spark):
    """30,000 sessions, a third of them of one user in one hour: no task gets more than twice the median."""
    ids = spark.range(30_000)
    hot = F.col("id") % 3 == 0
    offset = F.when(hot, F.col("id") % 3600).otherwise(F.col("id") * 7919 % 2_592_000)
    frame = ids.select(
        F.concat(F.lit("s"), "id").alias("session_id"), F.when(hot, 1).otherwise(F.col("id") % 997).cast("bigint").alias("user_id"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))).alias("session_start"),
    )
    sizes = sorted(r["count"] for r in ses.lag_ranges(frame, ranges=16).groupBy("range_no").count().collect())
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


def test_both_gap_plans_agree(spark):
    frame = spark.createDataFrame(random_sessions(7), "session_id string, user_id bigint, session_start timestamp_ntz")
    cutoff = START + timedelta(days=10)
    lagged = {r[0]: r[1] for r in ses.lag_gap(frame, cutoff).collect()}
    short = {r[0]: r[1] for r in ses.telescoped_gap(frame, cutoff).collect() if r[1] is not None}
    assert lagged == short
