"""Expected financial impact of the retention program, per user and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.functions.policy import (
    ACTION_NONE, DEFAULT_DRIVER, MONEY, PCT, POLICY, RetentionPolicy,
    eligible, intervention_roi, ltv, rule_check, strategy,
)

NOT_ELIGIBLE = "Not eligible: risk under the threshold."


def impact_input(features: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """Scored users joined to their plan; without explanations the label stands in for the score."""
    plan = features.select("user_id", "plan_tier", "monthly_fee", "churn_label")
    if explanations is None:
        return plan.select(
            "*", F.col("churn_label").cast("double").alias("churn_probability"),
            F.lit(DEFAULT_DRIVER).alias("driver_1_feature"),
        )
    return explanations.select("user_id", "churn_probability", "driver_1_feature").join(plan, "user_id")


def impact_rows(scored: DataFrame, policy: RetentionPolicy = POLICY) -> DataFrame:
    """Per-user impact.

    An eligible user gets the policy cap, whatever was proposed; the note keeps the verdict
    on the proposal. Return on cost uses the rounded amounts.
    """
    probability = F.col("churn_probability").cast("double")
    driver = (
        F.coalesce("driver_1_feature", F.lit(DEFAULT_DRIVER))
        if "driver_1_feature" in scored.columns else F.lit(DEFAULT_DRIVER)
    )
    planned = scored.select(
        "user_id", probability.alias("probability"), "plan_tier",
        F.col("monthly_fee").cast(MONEY).alias("monthly_fee"),
        ltv(F.col("monthly_fee"), policy.lifespan_months).alias("ltv"),
        driver.alias("primary_driver"),
        strategy(driver, F.col("plan_tier")).alias("plan"),
        eligible(probability, policy).alias("is_eligible"),
    )
    ruled = planned.withColumn(
        "rule",
        rule_check(F.col("probability"), F.col("ltv"), F.col("plan.action"), F.col("plan.discount_pct"), policy),
    )
    cap = F.col("rule.max_allowed_discount_pct")
    priced = ruled.withColumn("roi", intervention_roi(F.col("ltv"), cap, policy))
    targeted = F.col("is_eligible")

    def amount(column) -> F.Column:
        return F.when(targeted, column).otherwise(F.lit(0)).cast(MONEY)

    cost, net = F.col("roi.intervention_cost"), F.col("roi.net_impact")
    pct = F.when(cost > 0, F.round(net.cast("double") / cost.cast("double") * 100, 2)).otherwise(0.0)
    return priced.select(
        "user_id", F.round("probability", 4).alias("churn_probability"), "plan_tier", "monthly_fee", "ltv",
        "primary_driver", "is_eligible",
        F.when(targeted, F.col("plan.action")).otherwise(ACTION_NONE).alias("approved_action"),
        F.when(targeted, cap).otherwise(F.lit(0)).cast(PCT).alias("approved_discount_pct"),
        amount(F.col("roi.expected_value_saved")).alias("expected_value_saved"),
        amount(F.col("roi.discount_cost")).alias("discount_cost"),
        amount(cost).alias("total_intervention_cost"),
        amount(net).alias("net_impact"),
        amount(pct).alias("roi_percentage"),
        F.when(targeted, F.col("rule.reason")).otherwise(NOT_ELIGIBLE).alias("status_note"),
    )


def portfolio_summary(impact: DataFrame) -> DataFrame:
    """Ten program metrics in one aggregation."""
    hit = F.col("is_eligible")

    def total(name: str):
        return F.coalesce(F.sum(F.when(hit, F.col(name))), F.lit(0)).cast("decimal(28,2)")

    cost, net = total("total_intervention_cost"), total("net_impact")
    return impact.agg(
        F.count("*").alias("total_users_analyzed"),
        F.count_if(hit).alias("eligible_high_risk_users_targeted"),
        F.count_if(~hit).alias("users_not_targeted_safe"),
        total("ltv").alias("total_ltv_of_targeted_users"),
        total("expected_value_saved").alias("total_expected_value_saved"),
        cost.alias("total_intervention_cost"),
        net.alias("total_net_impact"),
        F.round(F.when(cost > 0, net.cast("double") / cost.cast("double") * 100).otherwise(0.0), 2)
        .alias("overall_program_roi_percentage"),
        F.count_if(hit & (F.col("net_impact") > 0)).alias("positive_roi_users_count"),
        F.count_if(hit & (F.col("net_impact") <= 0)).alias("negative_roi_users_count"),
    )


def scenario_comparison(summary: DataFrame) -> DataFrame:
    """No program against the program, two rows out of one summary row."""
    zero_money, zero = F.lit(0).cast("decimal(28,2)"), F.lit(0).cast("bigint")
    net = F.col("total_net_impact")

    def scenario(name, users, saved, cost, gain, uplift, pct):
        return F.struct(
            F.lit(name).alias("scenario"), users.alias("users_targeted"), saved.alias("expected_value_saved"),
            cost.alias("intervention_cost"), gain.alias("net_impact"),
            uplift.alias("net_uplift_over_baseline"), pct.alias("roi_percentage"),
        )

    idle = scenario("A: no intervention", zero, zero_money, zero_money, zero_money, zero_money, F.lit(0.0))
    active = scenario(
        "B: retention program", F.col("eligible_high_risk_users_targeted"), F.col("total_expected_value_saved"),
        F.col("total_intervention_cost"), net, net, F.col("overall_program_roi_percentage"),
    )
    return summary.select(F.inline(F.array(idle, active)))


def summary_document(summary: DataFrame, policy: RetentionPolicy = POLICY) -> DataFrame:
    """Summary row as one nested record: assumptions, metrics, scenarios."""
    net = F.col("total_net_impact")
    program = {
        "users_targeted": F.col("eligible_high_risk_users_targeted"),
        "expected_value_saved": F.col("total_expected_value_saved"),
        "intervention_cost": F.col("total_intervention_cost"),
        "net_impact": net,
    }
    return summary.select(
        F.struct(
            F.lit(float(policy.success_rate)).alias("expected_retention_probability"),
            F.lit(float(policy.message_cost)).alias("messaging_cost"),
            F.lit(policy.lifespan_months).alias("lifespan_months"),
            F.lit(policy.risk_threshold).alias("risk_threshold"),
        ).alias("simulation_assumptions"),
        F.struct(*summary.columns).alias("portfolio_metrics"),
        F.struct(
            F.struct(*(F.lit(0).cast("double").alias(k) for k in program)).alias("scenario_a_no_intervention"),
            F.struct(*(c.alias(k) for k, c in program.items()), net.alias("net_uplift_over_baseline"))
            .alias("scenario_b_retention_program"),
        ).alias("scenario_comparison"),
    )
