from decimal import Decimal

import pytest

from holdfast.operators import dashboard, impact

D = Decimal
SCHEMA = "user_id bigint, churn_probability double, plan_tier string, monthly_fee decimal(8,2), driver_1_feature string"
CASES = [
    (3510, 0.8351, "Pro", D("99"), "sessions_recent_14d"), (1005, 0.88, "Enterprise", D("299"), "support_ticket_count"),
    (1099, 0.12, "Basic", D("29"), "total_events_60d"), (2040, 0.75, "Basic", D("29"), "days_since_last_session"),
    (9999, 0.10, "Basic", D("0"), "sessions_recent_14d"),
]


def test_impact_cases(spark):
    rows = {r["user_id"]: r for r in impact.impact_rows(spark.createDataFrame(CASES, SCHEMA)).collect()}
    got = {u: (r["is_eligible"], r["approved_discount_pct"]) for u, r in rows.items()}
    assert got == {3510: (True, 15), 1005: (True, 20), 1099: (False, 0), 2040: (True, 10), 9999: (False, 0)}
    assert rows[1099]["approved_action"] == "No Action (User Safe)"
    assert rows[1099]["net_impact"] == rows[1099]["roi_percentage"] == 0
    # the cap is granted although the proposal of 15 % was refused
    assert "15.0%" in rows[2040]["status_note"] and rows[2040]["net_impact"] == D("68.60")
    assert len(rows[3510]) == 15


def portfolio(spark):
    mix = [("Basic", "29", 44), ("Pro", "99", 30), ("Enterprise", "299", 10)]
    rows = [(tier, D(fee)) for tier, fee, n in mix for _ in range(n)]
    scored = [(i, 0.35 + i / 1000, t, f, "sessions_recent_14d") for i, (t, f) in enumerate(rows)]
    scored += [(1000 + i, 0.3499, "Pro", D("99"), "monthly_fee") for i in range(516)]
    return impact.portfolio_summary(impact.impact_rows(spark.createDataFrame(scored, SCHEMA)))


def test_portfolio_golden(spark):
    assert portfolio(spark).first().asDict() == {
        "total_users_analyzed": 600, "eligible_high_risk_users_targeted": 84, "users_not_targeted_safe": 516,
        "total_ltv_of_targeted_users": D("86832.00"), "total_expected_value_saved": D("26049.60"),
        "total_intervention_cost": D("14137.20"), "total_net_impact": D("11912.40"),
        "overall_program_roi_percentage": 84.26, "positive_roi_users_count": 84, "negative_roi_users_count": 0,
    }


def test_scenarios_and_document(spark):
    summary = portfolio(spark)
    idle, active = impact.scenario_comparison(summary).collect()
    assert (idle["users_targeted"], idle["net_impact"]) == (0, 0)
    assert (active["users_targeted"], active["net_uplift_over_baseline"]) == (84, D("11912.40"))
    document = impact.summary_document(summary).first()
    assert document["simulation_assumptions"]["risk_threshold"] == 0.35
    assert document["portfolio_metrics"]["total_net_impact"] == D("11912.40")
    assert document["scenario_comparison"]["scenario_b_retention_program"]["users_targeted"] == 84


def test_nobody_targeted(spark):
    rows = spark.createDataFrame([(1, 0.1, "Pro", D("99"), "x")], SCHEMA)
    row = impact.portfolio_summary(impact.impact_rows(rows)).first()
    assert (row["total_intervention_cost"], row["overall_program_roi_percentage"]) == (0, 0)


@pytest.fixture
def features(spark):
    return spark.createDataFrame(
        [(1, "Basic", D("29"), 1), (2, "Pro", D("99"), 0)],
        "user_id bigint, plan_tier string, monthly_fee decimal(8,2), churn_label int")


def test_input_with_and_without_explanations(spark, features):
    fallback = impact.impact_input(features).orderBy("user_id").collect()
    assert [(r["churn_probability"], r["driver_1_feature"]) for r in fallback] == [
        (1.0, "sessions_recent_14d"), (0.0, "sessions_recent_14d")]
    explained = spark.createDataFrame([(2, 0.5, "monthly_fee")], "user_id bigint, churn_probability double, driver_1_feature string")
    joined = impact.impact_input(features, explained).collect()
    assert [(r["user_id"], r["churn_probability"]) for r in joined] == [(2, 0.5)]


def test_kpi_fallback(spark, features):
    row = dashboard.kpi_fallback(features.withColumn("churn_probability", features.churn_label.cast("double"))).first()
    assert row.asDict() == {
        "targeted_users": 1, "ltv_targeted": D("348.00"), "value_saved": D("104.40"), "program_cost": D("53.20"),
        "net_impact": D("51.20"), "program_roi_pct": 96.24}
