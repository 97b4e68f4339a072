from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holdfast.functions.policy import RetentionPolicy
from holdfast.operators import audits, features as feat, retention
from tests.activity import SPEC, sample
from tests.test_policy import PROFILES, SCHEMA


@pytest.fixture(scope="module")
def raw(spark):
    return sample(spark)


@pytest.fixture(scope="module")
def built(raw):
    return feat.build_features(raw, SPEC)


def test_fanout(raw, built):
    assert tuple(audits.fanout_audit(raw.users, built).first()) == (7, 7, 7, True)
    doubled = audits.fanout_audit(raw.users, built.union(built.filter("user_id = 1"))).first()
    assert tuple(doubled) == (7, 8, 7, False)
    assert not audits.fanout_audit(raw.users, built.filter("user_id > 1")).first()["passed"]


def test_recount(raw, built):
    assert audits.recount_mismatches(built, raw, SPEC).count() == 0
    assert {r["mismatches"] for r in audits.recount_audit(built, raw, SPEC).collect()} == {0}
    wrong = built.withColumn("total_events_60d", F.when(F.col("user_id") == 2, 9).otherwise(F.col("total_events_60d")))
    found = audits.recount_mismatches(wrong, raw, SPEC).collect()
    assert [tuple(r) for r in found] == [(2, "total_events_60d", Decimal("9.00"), Decimal("2.00"))]
    counts = {r["measure"]: r["mismatches"] for r in audits.recount_audit(wrong, raw, SPEC).collect()}
    assert counts["total_events_60d"] == 1 and sum(counts.values()) == 1


def test_row_counts(raw):
    assert {r["table_name"]: r["row_count"] for r in audits.row_counts(raw).collect()} == {
        "users": 7, "sessions": 10, "events": 3, "orders": 4, "support_tickets": 4}


def test_constraints_hold_and_break(raw):
    assert {r["violations"] for r in audits.constraint_audit(raw).collect()} == {0}
    broken = replace(
        raw,
        orders=raw.orders.union(raw.orders.limit(1)).withColumn("user_id", F.when(F.col("order_id") == "o3", 77).otherwise(F.col("user_id"))),
        events=raw.events.withColumn("session_id", F.when(F.col("event_id") == "e1", "gone").otherwise(F.col("session_id"))),
        support_tickets=raw.support_tickets.withColumn("status", F.nullif("status", F.lit("open"))),
    )
    found = {(r["table_name"], r["rule"]): r["violations"] for r in audits.constraint_audit(broken).collect() if r["violations"]}
    assert found == {
        ("orders", "unique order_id"): 1, ("orders", "user_id in users"): 1,
        ("events", "session_id in sessions"): 1, ("support_tickets", "not null status"): 2}


def test_constraints_on_null_keys_and_repeated_orphans(raw, spark):
    """A NULL key is one key, an orphan counts once however many rows refer to it, NULL references refer to nothing."""
    nobody = raw.sessions.limit(1).withColumns({"user_id": F.lit(None).cast("bigint"), "session_id": F.lit(None).cast("string")})
    lost = raw.sessions.limit(2).withColumns({"user_id": F.lit(500).cast("bigint"), "session_id": F.concat(F.lit("x"), "session_id")})
    found = audits.constraint_audit(replace(raw, sessions=raw.sessions.union(nobody).union(nobody).union(lost), users=raw.users.union(raw.users)))
    assert {(r["table_name"], r["rule"]): r["violations"] for r in found.collect() if r["violations"]} == {
        ("users", "unique user_id"): 7, ("sessions", "unique session_id"): 1, ("sessions", "not null session_id"): 2,
        ("sessions", "not null user_id"): 2, ("sessions", "user_id in users"): 1}
    nothing = audits.constraint_audit(replace(raw, **{n: df.limit(0) for n, df in raw.items()}))
    assert {r["violations"] for r in nothing.collect()} == {0} and nothing.count() == len(audits.constraint_audit(raw).collect())


def test_profiles(built):
    row = audits.dataset_profile(built).first()
    assert (row["total_rows"], row["total_columns"], row["active_users"], row["churned_users"]) == (7, 15, 3, 4)
    assert row["active_per_churned"] == 1
    assert [tuple(r) for r in audits.null_profile(built).collect()] == [("avg_session_gap_days", 4, 57.14)]
    assert {r["label"]: (r["users"], r["share_pct"]) for r in audits.label_distribution(built).collect()} == {
        0: (3, 42.86), 1: (4, 57.14)}


def test_feature_means_ignore_nulls(built):
    rows = {r["feature"]: r for r in audits.feature_means(built).collect()}
    assert len(rows) == 9
    assert rows["avg_session_gap_days"]["churned_mean"] == 14.0
    assert rows["total_spend_60d"]["non_churned_mean"] == round((666.5 + 198 + 198) / 3, 2)


def test_policy_audit(spark):
    decisions = retention.decide(spark.createDataFrame(PROFILES, SCHEMA))
    assert {r["passed"] for r in audits.policy_audit(decisions).collect()} == {True}
    forged = decisions.withColumn("applied_discount_pct", F.lit(Decimal("99.0"))).withColumn("rule_checks", F.lit(3))
    failed = {r["check"]: r["violations"] for r in audits.policy_audit(forged).collect() if not r["passed"]}
    assert failed == {"applied discount within cap": 5, "at most two checks": 6, "over-cap proposals were retried": 2}


def test_policy_audit_follows_the_policy(spark):
    strict = RetentionPolicy(risk_threshold=0.86, discount_caps=((0, 5),), max_retries=0)
    decisions = retention.decide(spark.createDataFrame(PROFILES, SCHEMA), strict)
    assert {r["passed"] for r in audits.policy_audit(decisions, strict).collect()} == {True}
    assert not all(r["passed"] for r in audits.policy_audit(decisions).collect())


def test_split_size_audit_sees_a_missing_row(spark):
    rows = [(i, i % 2, i % 10 < 2) for i in range(40)]
    good = spark.createDataFrame(rows, "user_id bigint, churn_label int, is_test boolean")
    assert [tuple(r) for r in audits.split_size_audit(good).orderBy("label").collect()] == [(0, 4, 4, True), (1, 4, 4, True)]
    moved = good.withColumn("is_test", F.col("is_test") & (F.col("user_id") != 1))
    assert {r["label"]: r["passed"] for r in audits.split_size_audit(moved).collect()} == {0: True, 1: False}


def test_train_only_audit_sees_statistics_of_other_rows(spark):
    train = spark.createDataFrame([(1.0, 2.0), (3.0, None), (8.0, 4.0)], "a double, b double")
    good = dict(medians={"b": 3.0}, means={"a": 4.0, "b": 3.0}, deviations={"a": (26 / 3) ** 0.5, "b": (2 / 3) ** 0.5})
    assert all(r["passed"] for r in audits.train_only_audit(train, ("a", "b"), **good).collect())
    for part, value in (("medians", {"b": 4.5}), ("means", {"a": 4.1, "b": 3.0}), ("deviations", {"a": 3.0, "b": 1.0})):
        assert not all(r["passed"] for r in audits.train_only_audit(train, ("a", "b"), **{**good, part: value}).collect())


def test_crossing_sessions(raw, spark):
    before = audits.crossing_sessions(raw.sessions, SPEC).first()["sessions"]
    longer = raw.sessions.withColumn("session_end", F.col("session_end") + F.expr("interval 400 days"))
    assert audits.crossing_sessions(longer, SPEC).first()["sessions"] > before


def test_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert tuple(audits.differences(a, b).first()) == (2, 1)
