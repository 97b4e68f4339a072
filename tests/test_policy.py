from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from holdfast.functions import policy as P
from holdfast.operators import retention
from holdfast.schemas import ACTION_LOG_SCHEMA

D = Decimal


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


# tier, fee, ltv, cap, saved, cost, net, roi
TIERS = [
    ("Basic", "29", "348.00", "10.0", "104.40", "35.80", "68.60", "191.62"),
    ("Pro", "99", "1188.00", "15.0", "356.40", "179.20", "177.20", "98.88"),
    ("Enterprise", "299", "3588.00", "20.0", "1076.40", "718.60", "357.80", "49.79"),
]


@pytest.mark.parametrize("tier,fee,ltv,cap,saved,cost,net,roi", TIERS)
def test_value_cap_and_return_per_tier(spark, tier, fee, ltv, cap, saved, cost, net, roi):
    value = P.ltv(F.lit(fee))
    row = one(spark, ltv=value, cap=P.discount_cap(value), roi=P.intervention_roi(value, P.discount_cap(value)))
    assert (row["ltv"], row["cap"]) == (D(ltv), D(cap))
    got = row["roi"]
    assert (got["expected_value_saved"], got["intervention_cost"]) == (D(saved), D(cost))
    assert (got["net_impact"], got["roi_percentage"]) == (D(net), D(roi))


@pytest.mark.parametrize("value,cap", [("799.99", 10), ("800", 15), ("2499.99", 15), ("2500", 20)])
def test_cap_borders(spark, value, cap):
    assert one(spark, cap=P.discount_cap(F.lit(D(value))))["cap"] == cap


@pytest.mark.parametrize("p,tier", [(0.70, "High Risk"), (0.6999, "Medium Risk"), (0.35, "Medium Risk"), (0.3499, "Low Risk")])
def test_risk_tiers(spark, p, tier):
    assert one(spark, tier=P.risk_tier(F.lit(p)))["tier"] == tier


@pytest.mark.parametrize("p,ltv,discount,approved,cap", [
    (0.8351, "1188", 15, True, 15), (0.88, "3588", 20, True, 20), (0.12, "348", 10, False, 0),
    (0.75, "348", 30, False, 10), (0.35, "348", 10, True, 10), (0.35, "348", 10.004, False, 10),
])
def test_rule_check(spark, p, ltv, discount, approved, cap):
    row = one(spark, r=P.rule_check(F.lit(p), F.lit(D(ltv)), F.lit("Call"), F.lit(discount)))["r"]
    assert (row["approved"], row["max_allowed_discount_pct"]) == (approved, cap)


def test_reasons_carry_the_numbers(spark):
    def reason(p, ltv, discount):
        return one(spark, r=P.rule_check(F.lit(p), F.lit(D(ltv)), F.lit("Call"), F.lit(D(discount))))["r"]["reason"]

    assert "12.0%" in reason(0.12, "348", "10") and "35.0%" in reason(0.12, "348", "10")
    assert all(x in reason(0.75, "348", "30") for x in ("30.0%", "10.0%", "348.00"))
    assert all(x in reason(0.75, "348", "5") for x in ("Call", "5.0%", "10.0%"))


def test_cost_free_intervention_returns_zero(spark):
    free = P.RetentionPolicy(message_cost=D("0.00"))
    roi = one(spark, r=P.intervention_roi(F.lit(D("348.00")), F.lit(0), free))["r"]
    assert (roi["intervention_cost"], roi["roi_percentage"]) == (0, 0)


@pytest.mark.parametrize("driver,tier,action,pct", [
    ("session_drop_pct", "Pro", P.ACTION_INACTIVITY, 15), ("unresolved_tickets", "Enterprise", P.ACTION_FRICTION, 20),
    ("support_ticket_count", "Basic", P.ACTION_FRICTION, 15), ("monthly_fee", "Enterprise", P.ACTION_OTHER, 10),
])
def test_strategy(spark, driver, tier, action, pct):
    row = one(spark, s=P.strategy(F.lit(driver), F.lit(tier)))["s"]
    assert (row["action"], row["discount_pct"]) == (action, pct)


@pytest.mark.parametrize("driver,category", [
    ("days_since_last_session", "Re-engagement"), ("unresolved_tickets", "Friction Resolution"),
    ("total_events_60d", "Feature Adoption"), ("monthly_fee", "General Appreciation"),
])
def test_message_category_and_offer(spark, driver, category):
    row = one(spark, a=P.retention_message(F.lit(driver), F.lit("Ada"), F.lit("15% discount")),
              b=P.retention_message(F.lit(driver), offer=F.lit(None).cast("string")))
    assert row["a"]["template_category"] == category
    assert "Ada" in row["a"]["message_body"] and "15% discount" in row["a"]["message_body"]
    assert "Valued Customer" in row["b"]["message_body"] and "offer" not in row["b"]["message_body"]


PROFILES = [
    (3510, 0.8351, "Pro", D("99"), "sessions_recent_14d", D("15"), "Strategy call"),
    (1005, 0.88, "Enterprise", D("299"), "support_ticket_count", D("20"), "Escalation"),
    (1099, 0.12, "Basic", D("29"), "total_events_60d", D("10"), "Renewal"),
    (2040, 0.75, "Basic", D("29"), "days_since_last_session", D("30"), "Promotion"),
    (9999, 0.80, "Basic", D("29"), "days_since_last_session", D("40"), "Excess"),
    (7, 0.35, "Basic", D("29"), "monthly_fee", None, None),
]
SCHEMA = ("user_id bigint, churn_probability double, plan_tier string, monthly_fee decimal(8,2), "
          "driver_1_feature string, override_proposed_discount_pct decimal(9,2), override_action_name string")


@pytest.fixture(scope="module")
def decided(spark):
    return retention.decide(spark.createDataFrame(PROFILES, SCHEMA))


def test_decisions(decided):
    rows = {r["user_id"]: r for r in decided.collect()}
    got = {u: (r["execution_status"], r["rule_checks"], r["applied_discount_pct"], r["net_impact"]) for u, r in rows.items()}
    assert got == {
        3510: (P.EXECUTED, 1, D("15.0"), D("177.20")), 1005: (P.EXECUTED, 1, D("20.0"), D("357.80")),
        1099: (P.HALTED_SAFE, 1, None, None), 2040: (P.EXECUTED, 2, D("10.0"), D("68.60")),
        9999: (P.EXECUTED, 2, D("10.0"), D("68.60")), 7: (P.EXECUTED, 1, D("10.0"), D("68.60")),
    }
    assert rows[7]["action_name"] == P.ACTION_OTHER
    assert [c["approved"] for c in rows[2040]["trace"]] == [False, True]
    assert rows[1099]["message_body"] is None


def test_without_retry_an_excess_is_halted(spark):
    rows = retention.decide(spark.createDataFrame(PROFILES, SCHEMA), P.RetentionPolicy(max_retries=0)).collect()
    assert {r["user_id"] for r in rows if r["execution_status"] == P.HALTED_REJECTED} == {2040, 9999}
    assert all(r["rule_checks"] == 1 for r in rows)


def test_latest_check_per_user(decided):
    latest = {r["user_id"]: r for r in retention.latest_checks(retention.trace_rows(decided)).collect()}
    assert (latest[2040]["rule_checks"], latest[2040]["proposed_discount_pct"], latest[2040]["approved"]) == (2, 10, True)
    assert (latest[1099]["rule_checks"], latest[1099]["approved"]) == (1, False)


def test_log_holds_approved_decisions_only(decided):
    log = retention.action_log(decided)
    assert log.schema == ACTION_LOG_SCHEMA or [f.dataType for f in log.schema] == [f.dataType for f in ACTION_LOG_SCHEMA]
    assert {r["user_id"] for r in log.collect()} == {3510, 1005, 2040, 9999, 7}
    row = log.filter("user_id = 3510").first()
    assert (row["churn_probability"], row["discount_pct"], row["ltv"], row["net_roi"]) == (
        D("0.8351"), D("15.0"), D("1188.00"), D("177.20"))
