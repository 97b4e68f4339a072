from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from holdfast.operators import features as feat
from holdfast.operators.audits import differences, future_perturbed, leakage_audit
from tests.activity import CUTOFF, SPEC, sample, tables


@pytest.fixture(scope="module")
def built(spark):
    return {r["user_id"]: r for r in feat.build_features(sample(spark), SPEC).collect()}


def test_one_row_per_user(built):
    assert sorted(built) == [1, 2, 3, 4, 5, 6, 7]


def test_user_without_activity(built):
    row = built[1]
    assert row["days_since_last_session"] == 60
    assert row["avg_session_gap_days"] is None
    assert (row["sessions_recent_14d"], row["sessions_previous_14d"], row["session_drop_pct"]) == (0, 0, 0)
    assert row["total_spend_60d"] == Decimal("58.00")
    assert row["churn_label"] == 1


def test_single_session_has_no_gap(built):
    row = built[2]
    assert row["avg_session_gap_days"] is None
    assert row["avg_session_duration_minutes"] == Decimal("30.00")
    assert row["days_since_last_session"] == 50
    assert (row["total_events_60d"], row["core_feature_usage_count"]) == (2, 1)
    assert (row["support_ticket_count"], row["unresolved_tickets"]) == (3, 2)


def test_two_sessions_and_spend(built):
    row = built[3]
    assert row["avg_session_gap_days"] == Decimal("2.50")
    assert row["avg_session_duration_minutes"] == Decimal("15.00")
    assert row["total_spend_60d"] == Decimal("666.50")
    assert row["churn_label"] == 0  # by the order after the cutoff


def test_recent_only_is_minus_hundred_and_last_second_counts(built):
    row = built[4]
    assert (row["sessions_recent_14d"], row["session_drop_pct"]) == (1, Decimal("-100.00"))
    assert row["days_since_last_session"] == 0
    assert row["churn_label"] == 1


def test_previous_window_edges(built):
    assert (built[5]["sessions_previous_14d"], built[5]["session_drop_pct"]) == (2, Decimal("100.00"))
    row = built[6]
    assert (row["sessions_recent_14d"], row["sessions_previous_14d"]) == (1, 2)
    assert row["session_drop_pct"] == Decimal("50.00")
    assert row["total_events_60d"] == 0
    assert row["churn_label"] == 0  # by the session at the cutoff


def test_order_only_after_the_cutoff(built):
    assert built[7]["churn_label"] == 0
    assert built[7]["total_spend_60d"] == Decimal("198.00")


def test_whole_days_are_elapsed_not_calendar(spark):
    raw = tables(spark, users=[(1, "Basic", "29.00")],
                 sessions=[(1, "2026-02-27 23:59:59.500000", "2026-02-28 00:10:00")])
    assert feat.build_features(raw, SPEC).first()["days_since_last_session"] == 1


def test_label_routes_agree(spark):
    raw = sample(spark)
    labels = feat.churn_labels(raw, SPEC)
    assert differences(labels, feat.build_features(raw, SPEC).select("user_id", "churn_label")).first() == (0, 0)
    assert sorted(r[0] for r in feat.churned_users(raw, SPEC).collect()) == [1, 2, 4, 5]
    assert sorted(r[0] for r in feat.later_active(raw, SPEC).collect()) == [3, 6, 7]
    assert feat.churn_summary(raw, SPEC).first().asDict() == {
        "total_users": 7, "churned_users": 4, "non_churned_users": 3, "churn_rate_pct": 57.14,
    }


def test_future_does_not_leak(spark):
    raw = sample(spark)
    built = feat.build_features(raw, SPEC).drop("churn_label")
    moved = feat.build_features(future_perturbed(raw, SPEC), SPEC).drop("churn_label")
    assert leakage_audit(built, moved).first()["passed"]


def test_leakage_audit_notices_a_leak(spark):
    raw = sample(spark)
    leaky = feat.FeatureSpec(cutoff=CUTOFF + timedelta(days=2), as_of=CUTOFF)
    built = feat.build_features(raw, leaky).drop("churn_label")
    moved = feat.build_features(future_perturbed(raw, SPEC), leaky).drop("churn_label")
    assert not leakage_audit(built, moved).first()["passed"]


def test_filter_profile(spark):
    rows = {r["table_name"]: r for r in feat.filter_profile(sample(spark), SPEC).collect()}
    assert (rows["sessions"]["observed_rows"], rows["sessions"]["future_rows"]) == (9, 1)
    assert (rows["sessions"]["recent_rows"], rows["sessions"]["previous_rows"]) == (2, 4)


def test_spec_windows():
    assert SPEC.recent_from == datetime(2026, 2, 16)
    assert SPEC.previous_from == datetime(2026, 2, 2)
    assert SPEC.measured_from == datetime(2026, 3, 1, 23, 59, 59)


def test_result_does_not_depend_on_the_session_time_zone(spark):
    raw = sample(spark)
    rows = sorted(feat.build_features(raw, SPEC).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted(feat.build_features(raw, SPEC).collect()) == rows
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
