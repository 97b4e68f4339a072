"""Retention policy as column expressions: value, eligibility, caps, return, wording."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F

from holdfast.functions.numbers import money_text, pct_text

# --- fixed values -----------------------------------------------------------------
INACTIVITY_DRIVERS = ("sessions_recent_14d", "days_since_last_session", "session_drop_pct")
FRICTION_DRIVERS = ("support_ticket_count", "unresolved_tickets")
ADOPTION_DRIVERS = ("core_feature_usage_count", "total_events_60d")
DEFAULT_DRIVER = "sessions_recent_14d"

HIGH_RISK, MEDIUM_RISK, LOW_RISK = "High Risk", "Medium Risk", "Low Risk"

ACTION_INACTIVITY = "Re-engagement Strategy Call"
ACTION_FRICTION = "VIP Support Escalation"
ACTION_OTHER = "Renewal Value Review"
ACTION_NONE = "No Action (User Safe)"

CATEGORY_INACTIVITY = "Re-engagement"
CATEGORY_FRICTION = "Friction Resolution"
CATEGORY_ADOPTION = "Feature Adoption"
CATEGORY_OTHER = "General Appreciation"

EXECUTED = "EXECUTED_SUCCESS"
HALTED_SAFE = "HALTED_SAFE_USER"
HALTED_REJECTED = "HALTED_GUARDRAIL_REJECTED"
# ----------------------------------------------------------------------------------

PCT = "decimal(5,1)"
MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class RetentionPolicy:
    risk_threshold: float = 0.35
    high_risk_threshold: float = 0.70
    # (lifetime value from, highest discount in percent), best tier first; the last applies to the rest
    discount_caps: tuple[tuple[int, int], ...] = ((2500, 20), (800, 15), (0, 10))
    success_rate: Decimal = Decimal("0.30")
    message_cost: Decimal = Decimal("1.00")
    lifespan_months: int = 12
    max_retries: int = 1


POLICY = RetentionPolicy()


def ltv(monthly_fee: Column, months: int = POLICY.lifespan_months) -> Column:
    """Lifetime value: fee times expected months."""
    return F.round(monthly_fee.cast(MONEY) * months, 2).cast(MONEY)


def risk_tier(probability: Column, policy: RetentionPolicy = POLICY) -> Column:
    return (
        F.when(probability >= policy.high_risk_threshold, HIGH_RISK)
        .when(probability >= policy.risk_threshold, MEDIUM_RISK)
        .otherwise(LOW_RISK)
    )


def eligible(probability: Column, policy: RetentionPolicy = POLICY) -> Column:
    return probability >= policy.risk_threshold


def discount_cap(value: Column, policy: RetentionPolicy = POLICY) -> Column:
    """Highest discount for a lifetime value, regardless of risk."""
    (_, lowest), tiers = policy.discount_caps[-1], policy.discount_caps[:-1]
    cap = None
    for floor, pct in tiers:
        cap = F.when(value >= floor, pct) if cap is None else cap.when(value >= floor, pct)
    return (F.lit(lowest) if cap is None else cap.otherwise(lowest)).cast(PCT)


def share_text(probability: Column) -> Column:
    return pct_text(probability.cast("decimal(12,6)") * 100)


def rule_check(
    probability: Column, value: Column, action: Column, discount: Column, policy: RetentionPolicy = POLICY
) -> Column:
    """Struct (approved, reason, max_allowed_discount_pct, proposed_discount_pct).

    Low risk is refused with a cap of 0; a discount over the cap is refused with the cap;
    everything else passes.
    """
    cap = discount_cap(value, policy)
    risky = eligible(probability, policy)
    over = discount > cap
    # over (risk, discount, cap, lifetime value, action); our own wording
    pattern = (
        F.when(~risky, f"Risk %1$s%% is under the {policy.risk_threshold * 100:.1f}%% threshold, so no discount is offered.")
        .when(over, "Asked for %2$s%% but lifetime value %4$s allows at most %3$s%%.")
        .otherwise("%5$s: %2$s%% is inside the limit of %3$s%%.")
    )
    reason = F.printf(
        pattern, share_text(probability), pct_text(discount), cap.cast("string"), money_text(value), action
    )
    return F.struct(
        (risky & ~over).alias("approved"),
        reason.alias("reason"),
        F.when(risky, cap).otherwise(F.lit(0).cast(PCT)).alias("max_allowed_discount_pct"),
        discount.alias("proposed_discount_pct"),
    )


def intervention_roi(value: Column, discount: Column, policy: RetentionPolicy = POLICY) -> Column:
    """Struct (expected_value_saved, discount_cost, intervention_cost, net_impact, roi_percentage).

    The percentage is taken before the amounts are rounded.
    """
    saved = value * F.lit(policy.success_rate)
    given = value * discount.cast("decimal(9,2)") * F.lit(Decimal("0.01"))
    cost = given + F.lit(policy.message_cost)
    net = saved - cost
    pct = F.when(cost > 0, net.cast("double") / cost.cast("double") * 100).otherwise(0.0)
    return F.struct(
        F.round(saved, 2).cast(MONEY).alias("expected_value_saved"),
        F.round(given, 2).cast(MONEY).alias("discount_cost"),
        F.round(cost, 2).cast(MONEY).alias("intervention_cost"),
        F.round(net, 2).cast(MONEY).alias("net_impact"),
        F.round(pct, 2).cast(MONEY).alias("roi_percentage"),
    )


def strategy(driver: Column, plan_tier: Column) -> Column:
    """Struct (action, discount_pct) proposed for the strongest driver."""
    generous = F.when(plan_tier == "Enterprise", 20).otherwise(15)
    inactive, friction = driver.isin(*INACTIVITY_DRIVERS), driver.isin(*FRICTION_DRIVERS)
    return F.struct(
        F.when(inactive, ACTION_INACTIVITY).when(friction, ACTION_FRICTION).otherwise(ACTION_OTHER)
        .alias("action"),
        F.when(inactive | friction, generous).otherwise(10).cast(PCT).alias("discount_pct"),
    )


# our own wording; the category per driver is what matters
MESSAGES = (
    (INACTIVITY_DRIVERS, CATEGORY_INACTIVITY, "Let's get you going again",
     "your team has been quiet lately, so a specialist is ready to walk you through the next steps"),
    (FRICTION_DRIVERS, CATEGORY_FRICTION, "News on your support requests",
     "not everything has run smoothly for you so far, and putting that right comes first"),
    (ADOPTION_DRIVERS, CATEGORY_ADOPTION, "More to gain from your plan",
     "there are workflows in your plan that could save your team time"),
    ((), CATEGORY_OTHER, "Thanks for staying with us",
     "we value working with you and would like to hear what you need next"),
)


def retention_message(driver: Column, name: Column | None = None, offer: Column | None = None) -> Column:
    """Struct (template_category, subject_line, message_body); a NULL offer adds no offer sentence."""
    category = None
    for drivers, name_of, _, _ in MESSAGES[:-1]:
        hit = driver.isin(*drivers)
        category = F.when(hit, name_of) if category is None else category.when(hit, name_of)
    category = category.otherwise(MESSAGES[-1][1])

    def of_category(position: int) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for m in MESSAGES for x in (m[1], m[position]))), category)

    offer_text = F.lit("") if offer is None else F.coalesce(
        F.concat(F.lit(" Our offer to you: "), offer, F.lit(".")), F.lit("")
    )
    who = F.lit("Valued Customer") if name is None else name
    body = F.concat(F.lit("Hello "), who, F.lit(", "), of_category(3), F.lit("."), offer_text)
    return F.struct(
        category.alias("template_category"), of_category(2).alias("subject_line"), body.alias("message_body")
    )
