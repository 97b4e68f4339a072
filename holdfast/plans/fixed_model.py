"""Two fixed linear models, so that scores and attributions can be checked without training.

Weights apply to scaled features.
"""

from holdfast.operators.models import LinearModel

CHALLENGER = LinearModel(-0.62, {
    "monthly_fee": 0.11,
    "total_spend_60d": -0.23,
    "days_since_last_session": 0.47,
    "sessions_recent_14d": -0.94,
    "sessions_previous_14d": 0.13,
    "session_drop_pct": 0.29,
    "total_events_60d": -0.37,
    "core_feature_usage_count": -0.19,
    "avg_session_duration_minutes": -0.17,
    "avg_session_gap_days": 0.31,
    "support_ticket_count": 0.59,
    "unresolved_tickets": 0.43,
    "plan_tier_Basic": 0.71,
    "plan_tier_Pro": -0.07,
    "plan_tier_Enterprise": -0.53,
})

BASELINE = LinearModel(0.35, {
    "monthly_fee": -0.05,
    "total_spend_60d": 0.09,
    "days_since_last_session": 0.83,
    "sessions_recent_14d": -0.21,
    "sessions_previous_14d": -0.15,
    "session_drop_pct": 0.03,
    "total_events_60d": 0.27,
    "core_feature_usage_count": 0.06,
    "avg_session_duration_minutes": 0.02,
    "avg_session_gap_days": -0.08,
    "support_ticket_count": -0.33,
    "unresolved_tickets": 0.12,
    "plan_tier_Basic": 0.01,
    "plan_tier_Pro": 0.04,
    "plan_tier_Enterprise": -0.02,
})

# Three small trees, so that tree attributions can be checked without training. A split is
# (feature, cut, rows at or below the cut, rows above it); a leaf is (value, training rows).
TREES = (
    ("sessions_recent_14d", 0.5,
     ("days_since_last_session", 3.5,
      ("plan_tier_Basic", 0.5, (0.31, 140.0), (0.52, 60.0)),
      (1.24, 820.0)),
     ("support_ticket_count", 11.5, (-1.15, 310.0), (-0.42, 170.0))),
    ("total_events_60d", 60.5,
     ("total_events_60d", 0.5, (0.83, 900.0), ("session_drop_pct", 0.0, (-0.64, 45.0), (-0.21, 155.0))),
     ("unresolved_tickets", 9.5, (-0.93, 260.0), (-0.35, 140.0))),
    ("gap_missing", 0.5,
     ("avg_session_gap_days", 0.75,
      ("monthly_fee", 64.0, (-0.27, 120.0), (-0.48, 180.0)),
      (0.12, 200.0)),
     (0.36, 1000.0)),
)
