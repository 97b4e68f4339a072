"""Retention decisions: propose, check, retry once at the cap, cost, word, log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.numbers import ntz
from holdfast.functions.policy import (
    EXECUTED, HALTED_REJECTED, HALTED_SAFE, PCT, POLICY, RetentionPolicy,
    discount_cap, eligible, intervention_roi, ltv, retention_message, risk_tier, rule_check, strategy,
)
from holdfast.schemas import ACTION_LOG_SCHEMA


def _override(df: DataFrame, name: str, proposed: Column) -> Column:
    return F.coalesce(F.col(name), proposed) if name in df.columns else proposed


def decide(df: DataFrame, policy: RetentionPolicy = POLICY) -> DataFrame:
    """One decision per user.

    Input: user_id, churn_probability, plan_tier, monthly_fee, driver_1_feature and, optionally,
    override_proposed_discount_pct / override_action_name. An over-cap proposal of an eligible user
    is repeated once at the cap; `trace` keeps every check, in order.
    """
    probability = F.col("churn_probability")
    plan = strategy(F.col("driver_1_feature"), F.col("plan_tier"))
    value = ltv(F.col("monthly_fee"), policy.lifespan_months)
    proposed = df.select(
        "user_id", "churn_probability", "plan_tier", "driver_1_feature",
        risk_tier(probability, policy).alias("risk_tier"), value.alias("ltv"),
        discount_cap(value, policy).alias("cap"),
        _override(df, "override_action_name", plan["action"]).alias("action_name"),
        _override(df, "override_proposed_discount_pct", plan["discount_pct"]).cast("decimal(9,2)")
        .alias("proposed_discount_pct"),
    )
    # the outcome of both checks follows from these few columns; the trace only spells it out
    risky = eligible(probability, policy)
    asked, cap = F.col("proposed_discount_pct"), F.col("cap").cast("decimal(9,2)")
    retried = risky & (asked > cap) & F.lit(policy.max_retries > 0)
    final = F.when(retried, cap).otherwise(asked)
    approved = risky & (final <= cap)

    def check(discount: Column) -> Column:
        return rule_check(probability, F.col("ltv"), F.col("action_name"), discount, policy)

    judged = proposed.select(
        "*", F.when(retried, 2).otherwise(1).alias("rule_checks"), approved.alias("guardrail_approved"),
        check(final)["reason"].alias("guardrail_reason"),
        F.when(approved, final).cast(PCT).alias("applied_discount_pct"),
        F.array_compact(F.array(
            _entry(1, check(asked)), F.when(retried, _entry(2, check(cap)))
        )).alias("trace"),
    )
    done, applied = F.col("guardrail_approved"), F.col("applied_discount_pct")
    roi = intervention_roi(F.col("ltv"), applied, policy)
    message = retention_message(F.col("driver_1_feature"), offer=F.concat(applied.cast("string"), F.lit("% discount")))
    status = F.when(done, EXECUTED).when(~risky, HALTED_SAFE).otherwise(HALTED_REJECTED)
    return judged.select(
        "user_id", "churn_probability", "risk_tier", "plan_tier", "ltv", "action_name",
        "proposed_discount_pct", "rule_checks", "guardrail_approved", "guardrail_reason", "applied_discount_pct",
        *(F.when(done, roi[f]).alias(f)
          for f in ("expected_value_saved", "intervention_cost", "net_impact", "roi_percentage")),
        *(F.when(done, message[f]).alias(f) for f in ("template_category", "subject_line", "message_body")),
        status.alias("execution_status"), "trace",
    )


def _entry(iteration: int, outcome: Column) -> Column:
    fields = ("proposed_discount_pct", "approved", "max_allowed_discount_pct", "reason")
    return F.struct(F.lit(iteration).alias("iteration"), *(outcome[f].alias(f) for f in fields))


def trace_rows(decisions: DataFrame) -> DataFrame:
    """Decision traces as one row per user and rule check."""
    return decisions.select("user_id", F.inline("trace"))


def latest_checks(checks: DataFrame) -> DataFrame:
    """Last rule check per user and how many there were, from trace rows in any order."""
    outcome = F.struct("approved", "reason", "proposed_discount_pct")
    return checks.groupBy("user_id").agg(
        F.max_by(outcome, "iteration").alias("last"), F.count("*").alias("rule_checks")
    ).select("user_id", "rule_checks", "last.approved", "last.reason", "last.proposed_discount_pct")


def full_trace(decisions: DataFrame) -> DataFrame:
    """One row per step of a decision, in order: value, rule checks, and for approved ones return, message and log."""
    done = F.col("guardrail_approved")

    def step(number: int, tool: str, outcome: Column) -> Column:
        return F.struct(F.lit(number).alias("step"), F.lit(tool).alias("tool"), outcome.cast("string").alias("outcome"))

    checks = F.transform("trace", lambda c: F.struct((c["iteration"] + 1).alias("step"), F.lit("rule_check").alias("tool"), c["reason"].alias("outcome")))
    after = F.when(done, F.array(
        step(11, "intervention_roi", F.col("net_impact")), step(12, "retention_message", F.col("template_category")),
        step(13, "action_log", F.col("execution_status")),
    )).otherwise(F.array().cast("array<struct<step:int,tool:string,outcome:string>>"))
    return decisions.select("user_id", F.inline(F.concat(F.array(step(1, "ltv", F.col("ltv"))), checks, after)))


def latest_trace(trace: DataFrame) -> DataFrame:
    """Last outcome of every tool per user and how often it ran, from trace rows in any order."""
    return trace.groupBy("user_id", "tool").agg(F.max_by("outcome", "step").alias("outcome"), F.count("*").alias("entries"))


def action_log(decisions: DataFrame, logged_at=None) -> DataFrame:
    """Log rows of the approved decisions."""
    stamp = F.current_timestamp().cast("timestamp_ntz") if logged_at is None else ntz(logged_at)
    rows = decisions.filter("guardrail_approved").select(
        stamp.alias("timestamp"), "user_id",
        F.round(F.col("churn_probability").cast("double"), 4).alias("churn_probability"),
        "action_name", F.col("guardrail_reason").alias("reason"),
        F.col("applied_discount_pct").alias("discount_pct"), "ltv",
        F.col("net_impact").alias("net_roi"), "execution_status",
    )
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in ACTION_LOG_SCHEMA))
