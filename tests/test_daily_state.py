"""Features of several cutoffs from stored days, against full builds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from holdfast.operators import daily_state as daily
from holdfast.operators.audits import differences
from holdfast.operators.features import FeatureSpec, build_features
from tests.activity import sample, tables

FIRST, DAYS = datetime(2026, 1, 1), 40


def activity(spark, seed=3):
    """Forty days of random rows: users without any, ties, rows at midnight and in the last second, sessions across midnight."""
    rng = random.Random(seed)
    at = lambda: FIRST + timedelta(days=rng.randrange(DAYS), seconds=rng.choice([0, 86399, rng.randrange(86400)]))
    users = [(u, rng.choice(["Basic", "Pro", "Enterprise"]), rng.choice(["29.00", "99.00"])) for u in range(30)]
    who = lambda: 0 if rng.random() < 0.3 else rng.randrange(25)
    sessions = [(who(), s := at(), s + timedelta(minutes=rng.randrange(600))) for _ in range(300)]
    return tables(spark, users, [(u, str(a), str(b)) for u, a, b in sessions],
                  [(who(), str(at()), rng.choice(["page_view", "feature_used"])) for _ in range(500)],
                  [(who(), str(at()), rng.choice(["5.00", "19.50"])) for _ in range(60)],
                  [(who(), str(at()), rng.choice(["open", "resolved", "escalated"])) for _ in range(60)])


def spec_at(day, window=5):
    return FeatureSpec(cutoff=FIRST + timedelta(days=day), window_days=window)


def same(a, b):
    return tuple(differences(a, b).first()) == (0, 0)


@pytest.fixture(scope="module")
def raw(spark):
    return activity(spark)


@pytest.fixture(scope="module")
def store(spark, raw, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "store")
    daily.store_days(daily.day_partials(raw, spec_at(0)), path)
    return path


@pytest.mark.parametrize("window", [1, 5, 14])
def test_a_chain_of_cutoffs_equals_full_builds(spark, raw, store, window):
    state, before = None, None
    for day in (12, 13, 20, 39):
        spec = spec_at(day, window)
        state = daily.advanced(state, daily.stored_days(spark, store, before, spec.cutoff), spec)
        found = daily.features_at(raw.users, state, daily.stored_days(spark, store, spec.cutoff), spec)
        assert same(found, build_features(raw, spec)), day
        before = spec.cutoff
    most = state.agg(F.max(F.size(daily.DAYS))).first()[0]
    assert most <= 2 * window * 4  # entries of days, those of several merges side by side


def test_only_new_days_are_opened(spark, store):
    one = daily.stored_days(spark, store, FIRST + timedelta(days=20), FIRST + timedelta(days=21))
    assert {r["day"] for r in one.select("day").distinct().collect()} == {(FIRST + timedelta(days=20)).date()}
    execution = one._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.executeCollect()
    while not plan.children().isEmpty():
        plan = plan.children().head()
    assert "PartitionFilters: [isnotnull(day" in plan.toString() and plan.metrics().apply("numPartitions").value() == 1


def test_a_day_can_be_stored_again(spark, raw, tmp_path):
    path, spec = f"{tmp_path}/days", spec_at(39)
    half = daily.day_partials(raw, spec, FIRST, FIRST + timedelta(days=20))
    rest = daily.day_partials(raw, spec, FIRST + timedelta(days=19))  # day 19 comes twice
    daily.store_days(half, path)
    daily.store_days(rest, path)
    state = daily.advanced(None, daily.stored_days(spark, path, None, spec.cutoff), spec)
    assert same(daily.features_at(raw.users, state, daily.stored_days(spark, path, spec.cutoff), spec), build_features(raw, spec))


def test_hand_made_rows_and_missing_keys(spark, tmp_path):
    from dataclasses import replace
    from tests.activity import SPEC

    raw = sample(spark)
    lost = raw.events.limit(2).withColumn("user_id", F.lit(None).cast("bigint")).unionByName(raw.events.limit(1).withColumn("event_timestamp", F.lit(None).cast("timestamp_ntz")))
    raw = replace(raw, events=raw.events.unionByName(lost))
    daily.store_days(daily.day_partials(raw, SPEC), f"{tmp_path}/days")
    state = daily.advanced(None, daily.stored_days(spark, f"{tmp_path}/days", None, SPEC.cutoff), SPEC)
    assert same(daily.features_at(raw.users, state, daily.stored_days(spark, f"{tmp_path}/days", SPEC.cutoff), SPEC), build_features(raw, SPEC))
    with pytest.raises(ValueError, match="midnight"):
        daily.advanced(None, daily.stored_days(spark, f"{tmp_path}/days"), replace(SPEC, cutoff=SPEC.cutoff + timedelta(hours=1)))


def test_nothing_yet(spark, raw, tmp_path):
    """No activity before the cutoff: every user has the defaults."""
    spec = spec_at(0)
    daily.store_days(daily.day_partials(raw, spec), f"{tmp_path}/days")
    state = daily.advanced(None, daily.stored_days(spark, f"{tmp_path}/days", None, spec.cutoff), spec)
    assert state.count() == 0
    assert same(daily.features_at(raw.users, state, daily.stored_days(spark, f"{tmp_path}/days", spec.cutoff), spec), build_features(raw, spec))
