"""SQL twins of the registered queries, written against the driver's files from scratch.

They take other routes than the DataFrame code where one exists: sessions from a per-event LAG,
gaps from a per-session LAG, ranks and medians from plain window functions.
"""

from __future__ import annotations

import re

from holdfast.plans.fixed_model import BASELINE, CHALLENGER, TREES  # the models that both sides are given

# --- fixed values, written out again so that a wrong list on one side shows ----------
UP, DOWN = "UP (+)", "DOWN (-)"
NUMERIC_FEATURES = (
    "monthly_fee", "total_spend_60d", "days_since_last_session", "sessions_recent_14d", "sessions_previous_14d", "session_drop_pct",
    "total_events_60d", "core_feature_usage_count", "avg_session_duration_minutes", "avg_session_gap_days", "support_ticket_count",
    "unresolved_tickets",
)
ONE_HOT_FEATURES = ("plan_tier_Basic", "plan_tier_Pro", "plan_tier_Enterprise")
FEATURES = NUMERIC_FEATURES + ONE_HOT_FEATURES
MEAN_FEATURES = (
    "days_since_last_session", "sessions_recent_14d", "sessions_previous_14d", "session_drop_pct", "total_events_60d",
    "avg_session_gap_days", "support_ticket_count", "unresolved_tickets", "total_spend_60d",
)
PROFILE_FEATURES = ("plan_tier", *NUMERIC_FEATURES)
NAMED_DIAGNOSTICS = (
    "sessions_recent_14d", "support_ticket_count", "days_since_last_session", "total_events_60d", "core_feature_usage_count",
)
INACTIVITY_DRIVERS = ("sessions_recent_14d", "days_since_last_session", "session_drop_pct")
FRICTION_DRIVERS = ("support_ticket_count", "unresolved_tickets")
GAP_FEATURE, GAP_UNKNOWN = "avg_session_gap_days", "Too few sessions to measure pauses"
# how the value is shown; the text around it when risk rises, and when it falls
DRIVER_TEXTS = {
    "sessions_recent_14d": ("count", ("Only ", " sessions in the recent window"), ("Busy: ", " sessions in the recent window")),
    "support_ticket_count": ("count", ("Raised ", " support tickets"), ("Just ", " support tickets")),
    "days_since_last_session": ("count", ("Away for ", " days"), ("Last seen ", " days ago")),
    "session_drop_pct": ("pct", ("Sessions fell by ", "%"), ("Sessions held up, change ", "%")),
    "core_feature_usage_count": ("count", ("Core features used only ", " times"), ("Core features used ", " times")),
    "unresolved_tickets": ("count", ("Waiting on ", " open tickets"), ("Little left open: ", " tickets")),
    "total_events_60d": ("count", ("Light use: ", " events"), ("Heavy use: ", " events")),
    "avg_session_gap_days": ("pct", ("Long pauses of ", " days between sessions"), ("Short pauses of ", " days between sessions")),
}
# drivers, category, subject, text
MESSAGES = (
    (INACTIVITY_DRIVERS, "Re-engagement", "Let's get you going again",
     "your team has been quiet lately, so a specialist is ready to walk you through the next steps"),
    (FRICTION_DRIVERS, "Friction Resolution", "News on your support requests",
     "not everything has run smoothly for you so far, and putting that right comes first"),
    (("core_feature_usage_count", "total_events_60d"), "Feature Adoption", "More to gain from your plan",
     "there are workflows in your plan that could save your team time"),
    ((), "General Appreciation", "Thanks for staying with us", "we value working with you and would like to hear what you need next"),
)
# ----------------------------------------------------------------------------------

DAY = 86400000000
CUTOFF = "TIMESTAMP '2024-01-30 00:00:00'"


def _back(days: int) -> str:
    return f"({CUTOFF} - INTERVAL {days} DAY)"


def _names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _r6(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 0.0000005 THEN 0.0 ELSE round({x}, 6) END)"


FEATURE_TYPES = {
    "user_id": "BIGINT", "plan_tier": "VARCHAR", "monthly_fee": "DOUBLE", "total_spend_60d": "DOUBLE",
    "days_since_last_session": "BIGINT", "sessions_recent_14d": "BIGINT", "sessions_previous_14d": "BIGINT",
    "session_drop_pct": "DOUBLE", "total_events_60d": "BIGINT", "core_feature_usage_count": "BIGINT",
    "avg_session_duration_minutes": "DOUBLE", "avg_session_gap_days": "DOUBLE", "support_ticket_count": "BIGINT",
    "unresolved_tickets": "BIGINT", "churn_label": "BIGINT",
}


def _feature_out(prefix: str = "") -> str:
    return ", ".join(f"CAST({prefix}{c} AS {t}) AS {c}" for c, t in FEATURE_TYPES.items())


def _features(window: int, suffix: str = "", events="a_events", sessions="a_sessions", orders="a_orders",
              tickets="a_tickets") -> dict[str, str]:
    recent, previous = _back(window), _back(2 * window)
    return {
        f"gaps{suffix}": f"""
            SELECT user_id, sum(epoch_us(session_start) - epoch_us(prev_start)) AS gap_us, count(*) AS gap_n
            FROM (SELECT user_id, session_start,
                         lag(session_start) OVER (PARTITION BY user_id ORDER BY session_start) AS prev_start
                  FROM {sessions} WHERE session_start < {CUTOFF})
            WHERE prev_start IS NOT NULL GROUP BY user_id""",
        f"sf{suffix}": f"""
            SELECT s.user_id,
                   (epoch_us({CUTOFF}) - epoch_us(max(session_start))) // {DAY} AS days_since_last_session,
                   count(*) FILTER (WHERE session_start >= {recent}) AS sessions_recent_14d,
                   count(*) FILTER (WHERE session_start >= {previous} AND session_start < {recent})
                       AS sessions_previous_14d,
                   round(CAST(sum(epoch_us(session_end) - epoch_us(session_start)) AS DOUBLE)
                         / 1000000 / count(*) / 60, 2) AS avg_session_duration_minutes,
                   round(CAST(any_value(gap_us) AS DOUBLE) / 1000000 / any_value(gap_n) / 86400, 2)
                       AS avg_session_gap_days,
                   count(*) AS session_count
            FROM {sessions} s LEFT JOIN gaps{suffix} g ON g.user_id = s.user_id
            WHERE session_start < {CUTOFF} GROUP BY s.user_id""",
        f"ef{suffix}": f"""
            SELECT user_id, count(*) AS total_events_60d,
                   count(*) FILTER (WHERE event_name = 'click') AS core_feature_usage_count
            FROM {events} WHERE event_timestamp < {CUTOFF} GROUP BY user_id""",
        f"orf{suffix}": f"""
            SELECT user_id, sum(amount) AS add_on_spend_60d
            FROM {orders} WHERE order_timestamp < {CUTOFF} GROUP BY user_id""",
        f"tf{suffix}": f"""
            SELECT user_id, count(*) AS support_ticket_count,
                   count(*) FILTER (WHERE status IN ('open', 'escalated')) AS unresolved_tickets
            FROM {tickets} WHERE created_at < {CUTOFF} GROUP BY user_id""",
        f"future{suffix}": f"""
            SELECT user_id FROM {sessions} WHERE session_start >= {CUTOFF}
            UNION SELECT user_id FROM {orders} WHERE order_timestamp >= {CUTOFF}""",
        f"fs{suffix}": f"""
            SELECT u.user_id, u.plan_tier, u.monthly_fee,
                   u.monthly_fee * 2 + coalesce(add_on_spend_60d, 0) AS total_spend_60d,
                   coalesce(days_since_last_session, 29) AS days_since_last_session,
                   coalesce(sessions_recent_14d, 0) AS sessions_recent_14d,
                   coalesce(sessions_previous_14d, 0) AS sessions_previous_14d,
                   CASE WHEN coalesce(sessions_previous_14d, 0) = 0 AND coalesce(sessions_recent_14d, 0) = 0 THEN 0.0
                        WHEN coalesce(sessions_previous_14d, 0) = 0 THEN -100.0
                        ELSE round(CAST(sessions_previous_14d - sessions_recent_14d AS DOUBLE) * 100
                                   / sessions_previous_14d, 2) END AS session_drop_pct,
                   coalesce(total_events_60d, 0) AS total_events_60d,
                   coalesce(core_feature_usage_count, 0) AS core_feature_usage_count,
                   coalesce(avg_session_duration_minutes, 0) AS avg_session_duration_minutes,
                   avg_session_gap_days,
                   coalesce(support_ticket_count, 0) AS support_ticket_count,
                   coalesce(unresolved_tickets, 0) AS unresolved_tickets,
                   CASE WHEN f.user_id IS NULL THEN 1 ELSE 0 END AS churn_label
            FROM u_users u
            LEFT JOIN sf{suffix} s ON s.user_id = u.user_id LEFT JOIN ef{suffix} e ON e.user_id = u.user_id
            LEFT JOIN orf{suffix} o ON o.user_id = u.user_id LEFT JOIN tf{suffix} t ON t.user_id = u.user_id
            LEFT JOIN future{suffix} f ON f.user_id = u.user_id""",
    }


def _margin(model) -> str:
    return str(model.intercept) + "".join(f" + ({w}) * scaled_{f}" for f, w in model.coefficients.items())


# ---- texts ---------------------------------------------------------------------------

def _pct(x: str) -> str:
    return f"CAST(CAST(round({x}, 1) AS DECIMAL(12,1)) AS VARCHAR)"


def _money(x: str) -> str:
    return f"CAST(CAST(round({x}, 2) AS DECIMAL(18,2)) AS VARCHAR)"


def _share(p: str) -> str:
    return _pct(f"(CAST({p} AS DECIMAL(12,6)) * 100)")


def _effect(way: str, phi: str) -> str:
    return f"' [risk ' || {way} || ' ' || CASE WHEN {phi} < 0 THEN '-' ELSE '+' END || {_money(f'abs({phi})')} || ']'"


def _short_text(feature: str, value: str, phi: str) -> str:
    way = f"CASE WHEN {phi} > 0 THEN '{UP}' ELSE '{DOWN}' END"
    shown = _money(f"CAST({value} AS DECIMAL(18,4))")
    return f"({feature} || ' = ' || coalesce({shown}, 'unknown') || {_effect(way, phi)})"


def _driver_text(feature: str, value: str, phi: str) -> str:
    way = f"CASE WHEN {phi} > 0 THEN '{UP}' ELSE '{DOWN}' END"
    shown = {
        "count": f"CAST(CAST({value} AS BIGINT) AS VARCHAR)",
        "pct": _pct(f"CAST({value} AS DECIMAL(18,4))"),
    }
    up_text = f"'{UP}'"
    cases = [f"WHEN {feature} = '{GAP_FEATURE}' AND {value} IS NULL THEN '{GAP_UNKNOWN}' || {_effect(up_text, phi)}"]
    for name, (form, rising, falling) in DRIVER_TEXTS.items():
        sides = [f"'{a}' || {shown[form]} || '{b}'" for a, b in (rising, falling)]
        cases.append(
            f"WHEN {feature} = '{name}' THEN CASE WHEN {phi} > 0 THEN {sides[0]} ELSE {sides[1]} END || {_effect(way, phi)}"
        )
    return f"(CASE {' '.join(cases)} ELSE {_short_text(feature, value, phi)} END)"


def _cap(value: str) -> str:
    return f"(CASE WHEN {value} >= 2500 THEN 20 WHEN {value} >= 800 THEN 15 ELSE 10 END)"


def _reason(p: str, value: str, action: str, discount: str) -> str:
    d = f"CAST({discount} AS DECIMAL(9,2))"
    return f"""(CASE WHEN {p} < 0.35 THEN 'Risk ' || {_share(p)} || '% is under the 35.0% threshold, so no discount is offered.'
        WHEN {discount} > {_cap(value)} THEN 'Asked for ' || {_pct(d)} || '% but lifetime value ' || {_money(value)}
             || ' allows at most ' || {_cap(value)} || '.0%.'
        ELSE {action} || ': ' || {_pct(d)} || '% is inside the limit of ' || {_cap(value)} || '.0%.' END)"""


def _action(driver: str) -> str:
    return (f"(CASE WHEN {driver} IN ({_names(INACTIVITY_DRIVERS)}) THEN 'Re-engagement Strategy Call' "
            f"WHEN {driver} IN ({_names(FRICTION_DRIVERS)}) THEN 'VIP Support Escalation' ELSE 'Renewal Value Review' END)")


def _proposal(driver: str, tier: str) -> str:
    return (f"(CASE WHEN {driver} IN ({_names(INACTIVITY_DRIVERS + FRICTION_DRIVERS)}) "
            f"THEN CASE WHEN {tier} = 'Enterprise' THEN 20 ELSE 15 END ELSE 10 END)")


def _tier(p: str) -> str:
    return f"(CASE WHEN {p} >= 0.70 THEN 'High Risk' WHEN {p} >= 0.35 THEN 'Medium Risk' ELSE 'Low Risk' END)"


def _message(part: int, driver: str) -> str:
    """Category (1), subject (2) or text (3) of the template for a driver."""
    cases = "".join(f" WHEN {driver} IN ({_names(m[0])}) THEN '{m[part].replace(chr(39), chr(39) * 2)}'" for m in MESSAGES[:-1])
    return f"(CASE{cases} ELSE '{MESSAGES[-1][part]}' END)"


def _body(driver: str, name: str, offer: str) -> str:
    return f"('Hello {name}, ' || {_message(3, driver)} || '.' || coalesce(' Our offer to you: ' || {offer} || '.', ''))"


def _costs(value: str, pct: str) -> dict[str, str]:
    saved, given = f"({value} * 0.30)", f"({value} * {pct} * 0.01)"
    cost = f"({given} + 1.00)"
    return {
        "saved": f"round({saved}, 2)", "given": f"round({given}, 2)", "cost": f"round({cost}, 2)",
        "net": f"round({saved} - {cost}, 2)",
        "roi": f"round(CAST({saved} - {cost} AS DOUBLE) / CAST({cost} AS DOUBLE) * 100, 2)",
    }


def _impact_cte(source: str) -> str:
    c = _costs("ltv", "cap")
    return f"""
        SELECT user_id, round(p, 4) AS churn_probability, plan_tier, monthly_fee, ltv, driver AS primary_driver,
               p >= 0.35 AS is_eligible,
               CASE WHEN p >= 0.35 THEN {_action('driver')} ELSE 'No Action (User Safe)' END AS approved_action,
               CASE WHEN p >= 0.35 THEN cap ELSE 0 END AS approved_discount_pct,
               CASE WHEN p >= 0.35 THEN {c['saved']} ELSE 0 END AS expected_value_saved,
               CASE WHEN p >= 0.35 THEN {c['given']} ELSE 0 END AS discount_cost,
               CASE WHEN p >= 0.35 THEN {c['cost']} ELSE 0 END AS total_intervention_cost,
               CASE WHEN p >= 0.35 THEN {c['net']} ELSE 0 END AS net_impact,
               CASE WHEN p >= 0.35 AND {c['cost']} > 0
                    THEN round(CAST({c['net']} AS DOUBLE) / CAST({c['cost']} AS DOUBLE) * 100, 2) ELSE 0 END AS roi_percentage,
               CASE WHEN p >= 0.35 THEN {_reason('p', 'ltv', _action('driver'), _proposal('driver', 'plan_tier'))}
                    ELSE 'Not eligible: risk under the threshold.' END AS status_note
        FROM (SELECT *, monthly_fee * 12 AS ltv, {_cap('(monthly_fee * 12)')} AS cap FROM ({source}))"""


def _summary_cte(impact: str) -> str:
    hit = "FILTER (WHERE is_eligible)"
    return f"""
        SELECT *, CASE WHEN total_intervention_cost > 0
                       THEN round(total_net_impact / total_intervention_cost * 100, 2) ELSE 0 END
                  AS overall_program_roi_percentage
        FROM (SELECT count(*) AS total_users_analyzed, count(*) {hit} AS eligible_high_risk_users_targeted,
                     count(*) FILTER (WHERE NOT is_eligible) AS users_not_targeted_safe,
                     CAST(coalesce(sum(ltv) {hit}, 0) AS DOUBLE) AS total_ltv_of_targeted_users,
                     CAST(coalesce(sum(expected_value_saved) {hit}, 0) AS DOUBLE) AS total_expected_value_saved,
                     CAST(coalesce(sum(total_intervention_cost) {hit}, 0) AS DOUBLE) AS total_intervention_cost,
                     CAST(coalesce(sum(net_impact) {hit}, 0) AS DOUBLE) AS total_net_impact,
                     count(*) FILTER (WHERE is_eligible AND net_impact > 0) AS positive_roi_users_count,
                     count(*) FILTER (WHERE is_eligible AND net_impact <= 0) AS negative_roi_users_count
              FROM {impact})"""


def _double(x: float) -> str:
    """Literal in exponent form, which SQL reads as DOUBLE and not as DECIMAL."""
    return f"({x!r}e0)"


def _rows(tree) -> float:
    return tree[1] if len(tree) == 2 else _rows(tree[2]) + _rows(tree[3])


def _tree_score(tree) -> str:
    if len(tree) == 2:
        return _double(tree[0])
    feature, cut, low, high = tree
    return f"(CASE WHEN {feature} <= {cut} THEN {_tree_score(low)} ELSE {_tree_score(high)} END)"


def _tree_base(tree) -> float:
    if len(tree) == 2:
        return tree[0]
    n = _rows(tree)
    return (_rows(tree[2]) * _tree_base(tree[2]) + _rows(tree[3]) * _tree_base(tree[3])) / n


def _tree_paths(tree, path=()):
    """(leaf value, {feature: (conditions, share of rows)}) per leaf."""
    if len(tree) == 2:
        merged = {}
        for feature, condition, share in path:
            conditions, so_far = merged.get(feature, ([], 1.0))
            merged[feature] = (conditions + [condition], so_far * share)
        yield tree[0], merged
        return
    feature, cut, low, high = tree
    for child, sign in ((low, "<="), (high, ">")):
        step = (feature, f"{feature} {sign} {cut}", _rows(child) / _rows(tree))
        yield from _tree_paths(child, path + (step,))


def _tree_phi(feature: str) -> str:
    """Shapley value in closed form for three players; a missing player always agrees and adds nothing."""
    terms = ["0e0"]
    for tree in TREES:
        for value, path in _tree_paths(tree):
            if feature not in path:
                continue
            agrees = {f: f"(CASE WHEN {' AND '.join(c)} THEN 1e0 ELSE 0e0 END)" for f, (c, _) in path.items()}
            others = [(agrees[f], _double(path[f][1])) for f in path if f != feature]
            (o1, z1), (o2, z2) = others + [("1.0", 1.0)] * (2 - len(others))
            terms.append(
                f"{_double(value)} * ({agrees[feature]} - {_double(path[feature][1])}) * ({z1} * {z2} / 3e0"
                f" + {o1} * {z2} / 6e0 + {z1} * {o2} / 6e0 + {o1} * {o2} / 3e0)"
            )
    return " + ".join(terms)


SUMMARY_COLUMNS = (
    "total_users_analyzed", "eligible_high_risk_users_targeted", "users_not_targeted_safe",
    "total_ltv_of_targeted_users", "total_expected_value_saved", "total_intervention_cost", "total_net_impact",
    "overall_program_roi_percentage", "positive_roi_users_count", "negative_roi_users_count",
)
SUMMARY_OUT = ", ".join(
    f"CAST({c} AS {'DOUBLE' if c.startswith(('total_l', 'total_e', 'total_i', 'total_n', 'overall')) else 'BIGINT'}) AS {c}"
    for c in SUMMARY_COLUMNS
)


def _auc(source: str) -> str:
    return f"""
        SELECT (sum(rank_avg) FILTER (WHERE churn_label = 1) - any_value(n1) * (any_value(n1) + 1) / 2)
               / (any_value(n1) * any_value(n0)) AS roc_auc
        FROM (SELECT churn_label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rank_avg,
                     CAST(count(*) FILTER (WHERE churn_label = 1) OVER () AS DOUBLE) AS n1,
                     CAST(count(*) FILTER (WHERE churn_label = 0) OVER () AS DOUBLE) AS n0
              FROM {source})"""


def _metric_cte(source: str) -> str:
    return f"""
        SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS metric,
               unnest([(tp + tn) / n, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END,
                       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END,
                       CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END,
                       (SELECT roc_auc FROM ({_auc(source)}))]) AS value
        FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
                     CAST(count(*) FILTER (WHERE churn_label = 0 AND p < 0.5) AS DOUBLE) AS tn,
                     CAST(count(*) FILTER (WHERE churn_label = 0 AND p >= 0.5) AS DOUBLE) AS fp,
                     CAST(count(*) FILTER (WHERE churn_label = 1 AND p < 0.5) AS DOUBLE) AS fn,
                     CAST(count(*) FILTER (WHERE churn_label = 1 AND p >= 0.5) AS DOUBLE) AS tp
              FROM {source})"""


def _driver_pivot(source: str) -> str:
    parts = []
    for i in (1, 2, 3):
        for column in ("feature", "shap", "text"):
            parts.append(f"max({column}) FILTER (WHERE rk = {i}) AS driver_{i}_{column}")
    return f"SELECT user_id, {', '.join(parts)} FROM {source} GROUP BY user_id"


_proposed = "CASE WHEN user_id % 8 > 0 THEN (user_id % 8) * 5 ELSE {plan} END"
_decision = _costs("ltv", "applied")

CTES: dict[str, str] = {
    "u_users": """
        SELECT c_custkey AS user_id, TIMESTAMP '2023-12-01 00:00:00' AS signup_date,
               CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'Basic'
                    WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'Pro'
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Enterprise' END AS plan_tier,
               CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 29
                    WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 99
                    WHEN c_mktsegment = 'HOUSEHOLD' THEN 299 END AS DECIMAL(8,2)) AS monthly_fee
        FROM customer""",
    "a_marks": """
        SELECT event_id, user_id, ts,
               CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR
                    THEN 0 ELSE 1 END AS opens
        FROM events""",
    "a_numbered": """
        SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no
        FROM a_marks""",
    "a_sessions": """
        SELECT user_id || '-' || CAST(min(ts) AS VARCHAR) AS session_id, user_id,
               min(ts) AS session_start, max(ts) AS session_end,
               CASE user_id % 3 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' ELSE 'Tablet' END AS device_type
        FROM a_numbered GROUP BY user_id, no""",
    "a_events": "SELECT event_id, user_id, ts AS event_timestamp, event_type AS event_name FROM events",
    "a_orders": """
        SELECT event_id AS order_id, user_id, ts AS order_timestamp, CAST(value AS DECIMAL(8,2)) AS amount
        FROM events WHERE event_type = 'purchase'""",
    "a_tickets": """
        SELECT event_id AS ticket_id, user_id, ts AS created_at,
               CASE event_id % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'bug' WHEN 2 THEN 'feature_request'
                    ELSE 'onboarding' END AS category,
               CASE WHEN event_id % 20 < 9 THEN 'open' WHEN event_id % 20 < 17 THEN 'escalated'
                    ELSE 'resolved' END AS status
        FROM events WHERE event_type = 'error'""",
    **_features(1),
    **_features(7, "_7d"),
    # everything after the cutoff cut off at the source, for the leakage check
    "p_events": f"SELECT * FROM a_events WHERE event_timestamp < {CUTOFF}",
    "p_sessions": f"SELECT * FROM a_sessions WHERE session_start < {CUTOFF}",
    "p_orders": f"SELECT * FROM a_orders WHERE order_timestamp < {CUTOFF}",
    "p_tickets": f"SELECT * FROM a_tickets WHERE created_at < {CUTOFF}",
    **_features(1, "_past", "p_events", "p_sessions", "p_orders", "p_tickets"),
    "enc": "SELECT *, " + ", ".join(
        f"CASE WHEN plan_tier = '{c.rsplit('_', 1)[1]}' THEN 1 ELSE 0 END AS {c}" for c in ONE_HOT_FEATURES
    ) + " FROM fs",
    "split": """
        SELECT * EXCLUDE (rn, n), rn <= floor(n * 0.2 + 0.5) AS is_test
        FROM (SELECT *, row_number() OVER (PARTITION BY churn_label ORDER BY md5('42:' || user_id), user_id) AS rn,
                     count(*) OVER (PARTITION BY churn_label) AS n FROM enc)""",
    "med": "SELECT " + ", ".join(
        f"median(CAST({c} AS DOUBLE)) AS {c}, count({c}) AS n_{c}" for c in NUMERIC_FEATURES
    ) + " FROM split WHERE NOT is_test",
    "imp": "SELECT s.user_id, s.plan_tier, s.churn_label, s.is_test, " + ", ".join(
        [f"coalesce(CAST(s.{c} AS DOUBLE), m.{c}) AS {c}" for c in NUMERIC_FEATURES]
        + [f"CAST(s.{c} AS DOUBLE) AS {c}" for c in ONE_HOT_FEATURES]
    ) + " FROM split s CROSS JOIN med m",
    "timp": "SELECT i.*, CASE WHEN s.avg_session_gap_days IS NULL THEN 1 ELSE 0 END AS gap_missing "
            "FROM imp i JOIN split s ON s.user_id = i.user_id",
    "stats": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in FEATURES)
             + " FROM imp WHERE NOT is_test",
    "scaled": "SELECT user_id, plan_tier, churn_label, is_test, " + ", ".join(
        f"({c} - m_{c}) / coalesce(nullif(d_{c}, 0), 1) AS scaled_{c}" for c in FEATURES
    ) + " FROM imp CROSS JOIN stats",
    "scored": f"SELECT *, 1 / (1 + exp(-margin)) AS p FROM (SELECT *, {_margin(CHALLENGER)} AS margin FROM scaled)",
    "scored_base": f"SELECT *, 1 / (1 + exp(-margin)) AS p FROM (SELECT *, {_margin(BASELINE)} AS margin FROM scaled)",
    "scored_test": "SELECT * FROM scored WHERE is_test",
    "base_test": "SELECT * FROM scored_base WHERE is_test",
    "bg": "SELECT " + ", ".join(f"avg(scaled_{c}) AS b_{c}" for c in FEATURES) + " FROM scaled",
    "base_val": "SELECT " + str(CHALLENGER.intercept) + "".join(
        f" + ({w}) * b_{f}" for f, w in CHALLENGER.coefficients.items()) + " AS base FROM bg",
    "phi": " UNION ALL ".join(
        f"SELECT s.user_id, s.is_test, '{f}' AS feature, CAST(r.{f} AS DOUBLE) AS feature_value, "
        f"({w}) * (s.scaled_{f} - b.b_{f}) AS shap FROM scaled s CROSS JOIN bg b JOIN enc r ON r.user_id = s.user_id"
        for f, w in CHALLENGER.coefficients.items()
    ),
    "phi_means": "SELECT feature, avg(abs(shap)) AS mean_abs, avg(shap) AS mean_signed FROM phi WHERE is_test GROUP BY feature",
    "drivers": f"""
        SELECT *, {_driver_text('feature', 'feature_value', 'shap')} AS text
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(shap) DESC, feature) AS rk FROM phi)
        WHERE rk <= 3""",
    "short_drivers": f"SELECT * REPLACE ({_short_text('feature', 'feature_value', 'shap')} AS text) FROM drivers",
    "flat": _driver_pivot("drivers"),
    "short_flat": _driver_pivot("short_drivers"),
    "records": """
        SELECT s.user_id, s.churn_label AS actual_churn, round(s.p, 4) AS churn_probability,
               CASE WHEN s.p >= 0.5 THEN 1 ELSE 0 END AS predicted_class, f.* EXCLUDE (user_id)
        FROM scored_test s JOIN flat f ON f.user_id = s.user_id""",
    "profiles": f"""
        SELECT s.user_id, round(s.p, 4) AS p, s.plan_tier, fs.monthly_fee, fs.monthly_fee * 12 AS ltv,
               f.driver_1_feature AS driver
        FROM scored s JOIN flat f ON f.user_id = s.user_id JOIN fs ON fs.user_id = s.user_id""",
    "asked": f"""
        SELECT *, {_proposed.format(plan=_proposal('driver', 'plan_tier'))} AS proposed,
               CASE WHEN user_id % 8 > 0 THEN 'Offer ' || (user_id % 8) ELSE {_action('driver')} END AS action,
               {_cap('ltv')} AS cap FROM profiles""",
    "decided": f"""
        SELECT *, p >= 0.35 AS approved,
               CASE WHEN p >= 0.35 AND proposed > cap THEN 2 ELSE 1 END AS checks,
               CASE WHEN p >= 0.35 THEN least(proposed, cap) END AS applied,
               {_reason('p', 'ltv', 'action', 'CASE WHEN p >= 0.35 THEN least(proposed, cap) ELSE proposed END')} AS reason
        FROM asked""",
    "decisions": f"""
        SELECT *, CASE WHEN approved THEN {_decision['saved']} END AS saved,
               CASE WHEN approved THEN {_decision['cost']} END AS cost,
               CASE WHEN approved THEN {_decision['net']} END AS net,
               CASE WHEN approved THEN {_decision['roi']} END AS roi,
               CASE WHEN approved THEN 'EXECUTED_SUCCESS' ELSE 'HALTED_SAFE_USER' END AS status
        FROM decided""",
    "impact_in": """
        SELECT r.user_id, r.churn_probability AS p, r.driver_1_feature AS driver, fs.plan_tier, fs.monthly_fee
        FROM records r JOIN fs ON fs.user_id = r.user_id""",
    "impact": _impact_cte("SELECT * FROM impact_in"),
    "impact_fb": _impact_cte("""SELECT user_id, CAST(churn_label AS DOUBLE) AS p, 'sessions_recent_14d' AS driver,
                                      plan_tier, monthly_fee FROM fs"""),
    "summary": _summary_cte("impact"),
    "summary_fb": _summary_cte("impact_fb"),
    "dash": f"""
        SELECT fs.*, s.p, s.is_test, {_tier('s.p')} AS risk_tier,
               {', '.join(f"CASE WHEN s.is_test THEN a.driver_{i}_{c} ELSE b.driver_{i}_{c} END AS driver_{i}_{c}"
                          for i in (1, 2, 3) for c in ('feature', 'shap', 'text'))}
        FROM fs JOIN scored s ON s.user_id = fs.user_id JOIN flat a ON a.user_id = fs.user_id
        JOIN short_flat b ON b.user_id = fs.user_id""",
}


def _with(final: str) -> str:
    """Prefixes a query with the common tables it needs, in order."""
    needed, pending = set(), [final]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in CTES.keys() & words - needed:
            needed.add(name)
            pending.append(CTES[name])
    used = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(used)} {final}" if used else final


def _filter_profile(name: str, table: str, ts: str) -> str:
    return f"""SELECT '{name}' AS table_name, count(*) FILTER (WHERE {ts} < {CUTOFF}) AS observed_rows,
        count(*) FILTER (WHERE {ts} >= {CUTOFF}) AS future_rows,
        count(*) FILTER (WHERE {ts} < {CUTOFF} AND {ts} >= {_back(1)}) AS recent_rows,
        count(*) FILTER (WHERE {ts} >= {_back(2)} AND {ts} < {_back(1)}) AS previous_rows FROM {table}"""


def _constraints() -> str:
    tables = {
        "users": ("u_users", "user_id", ("user_id", "signup_date", "plan_tier", "monthly_fee")),
        "sessions": ("a_sessions", "session_id", ("session_id", "user_id", "session_start", "session_end", "device_type")),
        "events": ("a_events", "event_id", ("event_id", "session_id", "user_id", "event_timestamp", "event_name")),
        "orders": ("a_orders", "order_id", ("order_id", "user_id", "order_timestamp", "amount")),
        "support_tickets": ("a_tickets", "ticket_id", ("ticket_id", "user_id", "created_at", "category", "status")),
    }
    session_of = """(SELECT n.event_id, n.user_id, n.ts AS event_timestamp, e.event_type AS event_name,
        n.user_id || '-' || CAST(min(n.ts) OVER (PARTITION BY n.user_id, n.no) AS VARCHAR) AS session_id
        FROM a_numbered n JOIN events e ON e.event_id = n.event_id)"""
    parts = []
    for name, (cte, key, columns) in tables.items():
        source = session_of if name == "events" else cte
        parts.append(f"""SELECT '{name}' AS table_name, 'unique {key}' AS rule, count(*) AS violations
            FROM (SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) > 1)""")
        parts += [f"SELECT '{name}', 'not null {c}', count(*) FILTER (WHERE {c} IS NULL) FROM {source}" for c in columns]
        if name != "users":
            parts.append(f"""SELECT '{name}', 'user_id in users', count(DISTINCT user_id) FROM {source}
                WHERE user_id NOT IN (SELECT user_id FROM u_users)""")
    parts.append(f"""SELECT 'events', 'session_id in sessions', count(DISTINCT session_id) FROM {session_of}
        WHERE session_id NOT IN (SELECT session_id FROM a_sessions)""")
    return " UNION ALL ".join(parts)


def _recount() -> str:
    measures = {
        "sessions_recent_14d": f"SELECT user_id, 1 AS v FROM a_sessions WHERE session_start < {CUTOFF} AND session_start >= {_back(1)}",
        "sessions_previous_14d": f"SELECT user_id, 1 AS v FROM a_sessions WHERE session_start < {_back(1)} AND session_start >= {_back(2)}",
        "total_events_60d": f"SELECT user_id, 1 AS v FROM a_events WHERE event_timestamp < {CUTOFF}",
        "support_ticket_count": f"SELECT user_id, 1 AS v FROM a_tickets WHERE created_at < {CUTOFF}",
        "total_spend_60d": f"""SELECT user_id, amount AS v FROM a_orders WHERE order_timestamp < {CUTOFF}
            UNION ALL SELECT user_id, monthly_fee * 2 FROM u_users""",
    }
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, count(*) AS users_checked,
            count(*) FILTER (WHERE f.{m} IS DISTINCT FROM coalesce(r.v, 0)) AS mismatches,
            CAST(sum(coalesce(r.v, 0)) AS DOUBLE) AS recounted_total
            FROM fs f LEFT JOIN (SELECT user_id, sum(v) AS v FROM ({rows}) GROUP BY user_id) r ON r.user_id = f.user_id"""
        for m, rows in measures.items()
    )


def _long_counts(columns, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM {source}"
        for c in columns
    )


IMPACT_OUT = """user_id, churn_probability, plan_tier, CAST(monthly_fee AS DOUBLE) AS monthly_fee,
    CAST(ltv AS DOUBLE) AS ltv, primary_driver, is_eligible, approved_action,
    CAST(approved_discount_pct AS DOUBLE) AS approved_discount_pct,
    CAST(expected_value_saved AS DOUBLE) AS expected_value_saved, CAST(discount_cost AS DOUBLE) AS discount_cost,
    CAST(total_intervention_cost AS DOUBLE) AS total_intervention_cost, CAST(net_impact AS DOUBLE) AS net_impact,
    CAST(roi_percentage AS DOUBLE) AS roi_percentage, status_note"""

RECORD_OUT = "user_id, CAST(actual_churn AS BIGINT) AS actual_churn, churn_probability, CAST(predicted_class AS BIGINT) AS predicted_class, " + ", ".join(
    f"driver_{i}_feature, {_r6(f'driver_{i}_shap')} AS driver_{i}_shap, driver_{i}_text" for i in (1, 2, 3)
)


def _payload() -> str:
    def driver(i):
        number = f"CAST(CAST(round(driver_{i}_shap, 4) AS DECIMAL(18,4)) AS VARCHAR)"
        return f"""'{{"feature":"' || driver_{i}_feature || '","shap_value":' || {number} || ',"text":"' || driver_{i}_text || '"}}'"""

    return f"""SELECT user_id, '{{"user_id":' || user_id || ',"churn_probability":'
        || CAST(CAST(round(p, 4) AS DECIMAL(6,4)) AS VARCHAR) || ',"risk_tier":"' || risk_tier
        || '","plan_tier":"' || plan_tier || '","monthly_fee":' || CAST(CAST(monthly_fee AS DECIMAL(8,1)) AS VARCHAR)
        || ',"top_3_shap_drivers":[' || {driver(1)} || ',' || {driver(2)} || ',' || {driver(3)} || ']}}' AS payload FROM dash"""


def _build() -> dict[str, str]:
    roi = _costs("ltv", "cap")
    rows_test = "scored_test"
    raw_tables = (("users", "u_users"), ("sessions", "a_sessions"), ("events", "a_events"), ("orders", "a_orders"), ("support_tickets", "a_tickets"))
    sql = {
        "feature_store": f"SELECT {_feature_out()} FROM fs",
        "feature_store_from_state": f"SELECT {_feature_out()} FROM fs",
        "cutoff_audit": """SELECT unnest(['2024-01-29', '2024-01-30']) AS cutoff, 0::BIGINT AS only_left, 0::BIGINT AS only_right""",
        "feature_store_7d": f"SELECT {_feature_out()} FROM fs_7d",
        "filter_profile": " UNION ALL ".join(_filter_profile(*x) for x in (
            ("sessions", "a_sessions", "session_start"), ("events", "a_events", "event_timestamp"),
            ("orders", "a_orders", "order_timestamp"), ("support_tickets", "a_tickets", "created_at"))),
        "session_features": """SELECT user_id, CAST(days_since_last_session AS BIGINT) AS days_since_last_session,
            sessions_recent_14d, sessions_previous_14d, avg_session_duration_minutes, avg_session_gap_days FROM sf""",
        "event_features": "SELECT * FROM ef",
        "order_features": "SELECT user_id, CAST(add_on_spend_60d AS DOUBLE) AS add_on_spend_60d FROM orf",
        "support_features": "SELECT * FROM tf",
        "session_drop_branches": """
            SELECT CASE WHEN sessions_recent_14d = 0 AND sessions_previous_14d = 0 THEN 'no sessions in either window'
                        WHEN sessions_previous_14d = 0 THEN 'only recent sessions'
                        WHEN sessions_recent_14d = 0 THEN 'only previous sessions' ELSE 'both windows' END AS branch,
                   count(*) AS users, CAST(min(session_drop_pct) AS DOUBLE) AS lowest,
                   CAST(max(session_drop_pct) AS DOUBLE) AS highest
            FROM fs GROUP BY 1""",
        "sessions_table": f"""SELECT session_id, user_id, device_type, CAST(session_start AS VARCHAR) AS started,
            CAST(session_end AS VARCHAR) AS ended FROM a_sessions""",
        "lag_sessions": f"""SELECT session_id, user_id,
            CAST(lag(session_start) OVER (PARTITION BY user_id ORDER BY session_start) AS VARCHAR) AS prev_start
            FROM a_sessions WHERE session_start < {CUTOFF}""",
        "lag_gap": "SELECT user_id, avg_session_gap_days FROM sf WHERE avg_session_gap_days IS NOT NULL",
        "telescoped_gap": f"""SELECT user_id, CASE WHEN count(*) > 1 THEN
            round(CAST(epoch_us(max(session_start)) - epoch_us(min(session_start)) AS DOUBLE) / 1000000
                  / (count(*) - 1) / 86400, 2) END AS avg_session_gap_days
            FROM a_sessions WHERE session_start < {CUTOFF} GROUP BY user_id""",
        "gap_join": "SELECT user_id, session_count, avg_session_gap_days FROM sf",
        "gap_plan_audit": f"""SELECT count(*) FILTER (WHERE a IS DISTINCT FROM b) AS only_left,
            count(*) FILTER (WHERE a IS DISTINCT FROM b) AS only_right
            FROM (SELECT s.user_id, any_value(sf.avg_session_gap_days) AS a, CASE WHEN count(*) > 1 THEN
                  round(CAST(epoch_us(max(session_start)) - epoch_us(min(session_start)) AS DOUBLE) / 1000000
                        / (count(*) - 1) / 86400, 2) END AS b
                  FROM a_sessions s JOIN sf ON sf.user_id = s.user_id WHERE session_start < {CUTOFF} GROUP BY s.user_id)""",
        "future_active_users": "SELECT user_id FROM future",
        "churn_labels": "SELECT user_id, CAST(churn_label AS BIGINT) AS churn_label FROM fs",
        "churned_users": "SELECT user_id FROM u_users EXCEPT SELECT user_id FROM future",
        "churn_summary": """SELECT count(*) AS total_users, count(*) FILTER (WHERE churn_label = 1) AS churned_users,
            count(*) FILTER (WHERE churn_label = 0) AS non_churned_users,
            round(count(*) FILTER (WHERE churn_label = 1) * 100.0 / count(*), 2) AS churn_rate_pct FROM fs""",
        "row_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in (
            ("users", "u_users"), ("sessions", "a_sessions"), ("events", "a_events"), ("orders", "a_orders"),
            ("support_tickets", "a_tickets"))),
        "load_report": " UNION ALL ".join(
            f"""SELECT '{n}' AS table_name, count(*) AS rows_read, 0::BIGINT AS malformed_cells, 0::BIGINT AS too_few_cells,
                0::BIGINT AS too_many_cells FROM {t}""" for n, t in raw_tables),
        "broken_load_report": " UNION ALL ".join(
            f"""SELECT '{n}' AS table_name, count(*) AS rows_read, count(*) FILTER (WHERE user_id % 7 = 3) AS malformed_cells,
                count(*) FILTER (WHERE user_id % 7 = 2) AS too_few_cells, count(*) FILTER (WHERE user_id % 7 = 1) AS too_many_cells FROM {t}"""
            for n, t in raw_tables),
        "quarantine": " UNION ALL ".join(
            f"""SELECT '{n}' AS table_name, CASE user_id % 7 WHEN 1 THEN 'too many cells' WHEN 2 THEN 'too few cells' WHEN 3 THEN 'bad value'
                ELSE 'taken' END AS reason, count(*) AS lines FROM {t} GROUP BY ALL""" for n, t in raw_tables),
        "loaded_row_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in (
            ("users", "u_users"), ("sessions", "a_sessions"), ("events", "a_events"), ("orders", "a_orders"),
            ("support_tickets", "a_tickets"))),
        "feature_table_round_trip": f"SELECT {_feature_out()} FROM fs",
        "feature_store_five_tables": f"SELECT {_feature_out()} FROM fs",
        "recount_mismatches": f"""SELECT 0::BIGINT AS user_id, measure, 0::DOUBLE AS in_features, CAST(recounted_total AS DOUBLE) AS recounted
            FROM ({_recount()}) WHERE mismatches > 0""",
        "crossing_sessions": f"""SELECT 'sessions across the cutoff' AS "check", count(*) AS sessions, count(DISTINCT user_id) AS users
            FROM a_sessions WHERE session_start < {CUTOFF} AND session_end >= {CUTOFF}""",
        "split_size_audit": """SELECT CAST(churn_label AS BIGINT) AS label, count(*) FILTER (WHERE is_test) AS test_users,
            CAST(round(count(*) * 0.2) AS BIGINT) AS expected, count(*) FILTER (WHERE is_test) = round(count(*) * 0.2) AS passed
            FROM split GROUP BY churn_label""",
        "train_only_audit": " UNION ALL ".join(
            [f"SELECT '{c}' AS feature, 'median' AS statistic, true AS passed FROM med WHERE n_{c} > 0" for c in NUMERIC_FEATURES]
            + [f"SELECT '{c}', '{s}', m_{c} = m_{c} FROM stats" for c in FEATURES for s in ("mean", "deviation")]),
        "model_round_trip": """SELECT unnest(['logistic regression', 'boosted trees']) AS model, count(*) AS users, 0::BIGINT AS changed FROM enc""",
        "dashboard_trained": """SELECT count(*) AS users, 0::BIGINT AS without_drivers, 0::BIGINT AS changed_scores,
            0::BIGINT AS changed_drivers, 0::BIGINT AS wrong_tiers FROM enc""",
        "lr_optimality": " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS at_optimum" for f in ("intercept", *FEATURES)),
        "trained_audits": """SELECT unnest(['both', 'boosted trees', 'logistic regression']) AS model,
            unnest(['same users', 'class equals probability >= threshold', 'class equals probability >= threshold']) AS "check",
            true AS passed""",
        "tree_additivity": """SELECT 'additivity' AS "check", true AS passed, 0::BIGINT AS violations, count(*) AS rows_checked FROM enc""",
        "tree_score_audit": """SELECT unnest(['margin', 'base value']) AS "check", true AS passed, 0::BIGINT AS violations,
            unnest([count(*), 1]) AS rows_checked FROM enc""",
        "tree_shap_audit": " UNION ALL ".join(
            f"""SELECT 'attribution of {f}' AS "check", true AS passed, 0::BIGINT AS violations, count(*) AS rows_checked FROM enc"""
            for f in (*FEATURES, "gap_missing")),
        "fanout_audit": """SELECT u AS raw_users, f AS feature_rows, d AS distinct_users, u = f AND f = d AS passed
            FROM (SELECT (SELECT count(*) FROM u_users) AS u, count(*) AS f, count(DISTINCT user_id) AS d FROM fs)""",
        "recount_audit": _recount(),
        "constraint_audit": _constraints(),
        "leakage_audit": """SELECT 'features ignore the future' AS "check", l = 0 AND r = 0 AS passed,
            l AS only_left, r AS only_right FROM (SELECT
            (SELECT count(*) FROM (SELECT * EXCLUDE (churn_label) FROM fs EXCEPT ALL SELECT * EXCLUDE (churn_label) FROM fs_past)) AS l,
            (SELECT count(*) FROM (SELECT * EXCLUDE (churn_label) FROM fs_past EXCEPT ALL SELECT * EXCLUDE (churn_label) FROM fs)) AS r)""",
        "label_distribution": """SELECT CAST(churn_label AS BIGINT) AS label, count(*) AS users,
            round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_pct FROM fs GROUP BY churn_label""",
        "null_profile": f"""SELECT column_name, missing, round(missing * 100.0 / n, 2) AS missing_pct
            FROM ({_long_counts(PROFILE_FEATURES, 'fs')}) WHERE missing > 0""",
        "dataset_profile": f"""SELECT n AS total_rows, CAST(15 AS BIGINT) AS total_columns, n - c AS active_users, c AS churned_users,
            round((n - c) * 100.0 / n, 2) AS active_pct, round(c * 100.0 / n, 2) AS churned_pct,
            CAST(round_even((n - c) / greatest(1, c), 0) AS BIGINT) AS active_per_churned,
            (SELECT CAST(sum(missing) AS BIGINT) FROM ({_long_counts(PROFILE_FEATURES, 'fs')})) AS missing_cells
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE churn_label = 1) AS c FROM fs)""",
        "feature_means": " UNION ALL ".join(
            f"""SELECT '{c}' AS feature,
                round(CAST(sum(CAST({c} AS DECIMAL(18,2))) FILTER (WHERE churn_label = 0) AS DOUBLE)
                      / count({c}) FILTER (WHERE churn_label = 0), 2) AS non_churned_mean,
                round(CAST(sum(CAST({c} AS DECIMAL(18,2))) FILTER (WHERE churn_label = 1) AS DOUBLE)
                      / count({c}) FILTER (WHERE churn_label = 1), 2) AS churned_mean FROM fs""" for c in MEAN_FEATURES),
        "one_hot": "SELECT user_id, plan_tier, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ONE_HOT_FEATURES) + " FROM enc",
        "stratified_split": "SELECT user_id, CAST(churn_label AS BIGINT) AS churn_label, is_test FROM split",
        "split_sizes": "SELECT CAST(churn_label AS BIGINT) AS churn_label, is_test, count(*) AS users FROM split GROUP BY ALL",
        "median_imputation": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, n_{c} AS non_null, round({c}, 6) AS median FROM med" for c in NUMERIC_FEATURES),
        "scale_statistics": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {_r6(f'm_{c}')} AS mean, round(d_{c}, 6) AS deviation FROM stats" for c in FEATURES),
        "scaled_features": "SELECT user_id, is_test, " + ", ".join(
            f"{_r6(f'scaled_{c}')} AS scaled_{c}" for c in FEATURES) + " FROM scaled",
        "linear_score": f"SELECT user_id, {_r6('margin')} AS margin, round(p, 6) AS churn_probability FROM scored",
        "confusion_matrix": f"""SELECT count(*) FILTER (WHERE churn_label = 0 AND p < 0.5) AS tn,
            count(*) FILTER (WHERE churn_label = 0 AND p >= 0.5) AS fp,
            count(*) FILTER (WHERE churn_label = 1 AND p < 0.5) AS fn,
            count(*) FILTER (WHERE churn_label = 1 AND p >= 0.5) AS tp FROM {rows_test}""",
        "classification_metrics": f"""SELECT {', '.join(f"round(max(value) FILTER (WHERE metric = '{m}'), 6) AS {m}"
            for m in ('accuracy', 'precision', 'recall', 'f1'))} FROM ({_metric_cte(rows_test)})""",
        "evaluation": f"""SELECT c.*, m.* FROM (SELECT count(*) FILTER (WHERE churn_label = 0 AND p < 0.5) AS tn,
            count(*) FILTER (WHERE churn_label = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE churn_label = 1 AND p < 0.5) AS fn,
            count(*) FILTER (WHERE churn_label = 1 AND p >= 0.5) AS tp FROM {rows_test}) c
            CROSS JOIN (SELECT {', '.join(f"round(max(value) FILTER (WHERE metric = '{m}'), 6) AS {m}"
            for m in ('accuracy', 'precision', 'recall', 'f1', 'roc_auc'))} FROM ({_metric_cte(rows_test)})) m""",
        "roc_auc": f"SELECT round(roc_auc, 6) AS roc_auc FROM ({_auc(rows_test)})",
        "roc_auc_all_users": f"SELECT round(roc_auc, 6) AS roc_auc FROM ({_auc('scored_base')})",
        "model_comparison": f"""SELECT c.metric, round(b.value, 6) AS baseline, round(c.value, 6) AS challenger,
            {_r6('(c.value - b.value)')} AS delta
            FROM ({_metric_cte(rows_test)}) c JOIN ({_metric_cte('base_test')}) b ON b.metric = c.metric""",
        "model_comparison_no_baseline": f"""SELECT metric, CAST(0 AS DOUBLE) AS baseline, round(value, 6) AS challenger,
            round(value, 6) AS delta FROM ({_metric_cte(rows_test)})""",
        "threshold_audit": """SELECT 'class equals probability >= threshold' AS "check", bool_and(same) AS passed,
            count(*) FILTER (WHERE NOT same) AS violations, count(*) AS rows_checked
            FROM (SELECT (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = (CASE WHEN p < 0.5 THEN 0 ELSE 1 END) AS same FROM scored)""",
        "same_users_audit": """SELECT 'same users' AS "check", l = 0 AND r = 0 AS passed, l AS only_left, r AS only_right
            FROM (SELECT (SELECT count(*) FROM (SELECT user_id FROM scored_test EXCEPT ALL SELECT user_id FROM base_test)) AS l,
                         (SELECT count(*) FROM (SELECT user_id FROM base_test EXCEPT ALL SELECT user_id FROM scored_test)) AS r)""",
        "linear_shap": f"SELECT user_id, feature, {_r6('shap')} AS shap_value FROM phi",
        "base_value": f"""SELECT {_r6('base')} AS base_value, {_r6('(SELECT avg(margin) FROM scored)')} AS mean_margin,
            round(1 / (1 + exp(-base)), 6) AS base_probability FROM base_val""",
        "additivity_audit": """SELECT 'additivity' AS "check", bool_and(e <= 0.0001) AS passed,
            count(*) FILTER (WHERE e > 0.0001) AS violations, count(*) AS rows_checked
            FROM (SELECT abs((SELECT base FROM base_val) + t.total - s.margin) AS e
                  FROM scored s JOIN (SELECT user_id, sum(shap) AS total FROM phi GROUP BY user_id) t ON t.user_id = s.user_id)""",
        "global_importance": """SELECT feature, round(mean_abs, 6) AS mean_abs_shap,
            row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM phi_means""",
        "importance_chart": "SELECT feature, round(mean_abs, 6) AS mean_abs_shap FROM phi_means ORDER BY mean_abs DESC, feature LIMIT 8",
        "signed_importance": f"""SELECT feature, round(mean_abs, 6) AS mean_abs_shap, {_r6('mean_signed')} AS mean_signed_shap,
            CASE WHEN mean_signed > 0 THEN 'Pushes Toward Churn (+)' ELSE 'Pushes Toward Retention (-)' END AS net_direction
            FROM phi_means WHERE feature IN ({_names(NAMED_DIAGNOSTICS)})""",
        "top_drivers": f"""SELECT user_id, rk AS driver_rank, feature, round(feature_value, 6) AS feature_value,
            {_r6('shap')} AS shap_value, CASE WHEN shap > 0 THEN '{UP}' ELSE '{DOWN}' END AS direction,
            text AS explanation FROM drivers""",
        "driver_window_rank": "SELECT user_id, feature, rk AS driver_rank FROM drivers",
        "local_explanations": f"SELECT {RECORD_OUT} FROM records",
        "highest_risk_user": f"SELECT {RECORD_OUT} FROM records ORDER BY churn_probability DESC, user_id LIMIT 1",
        "filled_drivers": f"""SELECT user_id, driver_1_feature, {_r6('driver_1_shap')} AS driver_1_shap, driver_1_text FROM dash""",
        "tree_shap_fixed": " UNION ALL ".join(
            f"SELECT user_id, '{f}' AS feature, {_r6('v')} AS shap_value FROM (SELECT user_id, CAST({_tree_phi(f)} AS DOUBLE) AS v FROM timp)"
            for f in FEATURES + ("gap_missing",)),
        "tree_margin_fixed": f"""SELECT user_id, round({_double(sum(_tree_base(t) for t in TREES))}, 6) AS base_value, {_r6('v')} AS margin
            FROM (SELECT user_id, CAST({' + '.join(_tree_score(t) for t in TREES)} AS DOUBLE) AS v FROM timp)""",
        "ltv": "SELECT user_id, CAST(monthly_fee * 12 AS DOUBLE) AS ltv FROM fs",
        "discount_caps": f"""SELECT plan_tier, count(*) AS users, CAST(min(ltv) AS DOUBLE) AS lowest_ltv,
            CAST(max(ltv) AS DOUBLE) AS highest_ltv, CAST(min(cap) AS DOUBLE) AS lowest_cap, CAST(max(cap) AS DOUBLE) AS highest_cap
            FROM (SELECT plan_tier, monthly_fee * 12 AS ltv, {_cap('(monthly_fee * 12)')} AS cap FROM fs) GROUP BY plan_tier""",
        "rule_check": f"""SELECT user_id, p >= 0.35 AND asked <= {_cap('ltv')} AS approved,
            {_reason('p', 'ltv', 'action', 'asked')} AS reason,
            CAST(CASE WHEN p >= 0.35 THEN {_cap('ltv')} ELSE 0 END AS DOUBLE) AS max_allowed_discount_pct,
            CAST(asked AS DOUBLE) AS proposed_discount_pct
            FROM (SELECT *, (user_id % 8) * 5 AS asked,
                  CASE WHEN user_id % 8 > 0 THEN 'Offer ' || (user_id % 8) ELSE 'No offer' END AS action FROM profiles)""",
        "intervention_roi": f"""SELECT user_id, CAST(ltv AS DOUBLE) AS ltv, CAST({roi['saved']} AS DOUBLE) AS expected_value_saved,
            CAST({roi['given']} AS DOUBLE) AS discount_cost, CAST({roi['cost']} AS DOUBLE) AS intervention_cost,
            CAST({roi['net']} AS DOUBLE) AS net_impact, CAST({roi['roi']} AS DOUBLE) AS roi_percentage
            FROM (SELECT user_id, monthly_fee * 12 AS ltv, {_cap('(monthly_fee * 12)')} AS cap FROM fs)""",
        "strategy": f"""SELECT user_id, driver AS driver_1_feature, {_action('driver')} AS action,
            CAST({_proposal('driver', 'plan_tier')} AS DOUBLE) AS discount_pct FROM profiles""",
        "retention_message": f"""SELECT user_id, feature, {_message(1, 'feature')} AS template_category,
            {_message(2, 'feature')} AS subject_line,
            {_body('feature', 'customer', "CASE WHEN user_id % 2 = 1 THEN '10% discount' END")} AS message_body FROM drivers""",
        "risk_tiers": f"SELECT user_id, {_tier('p')} AS risk_tier FROM scored",
        "retention_decision": f"""SELECT user_id, p AS churn_probability, {_tier('p')} AS risk_tier, plan_tier,
            CAST(ltv AS DOUBLE) AS ltv, action AS action_name, CAST(proposed AS DOUBLE) AS proposed_discount_pct,
            CAST(checks AS BIGINT) AS rule_checks, approved AS guardrail_approved, reason AS guardrail_reason,
            CAST(applied AS DOUBLE) AS applied_discount_pct, CAST(saved AS DOUBLE) AS expected_value_saved,
            CAST(cost AS DOUBLE) AS intervention_cost, CAST(net AS DOUBLE) AS net_impact, CAST(roi AS DOUBLE) AS roi_percentage,
            CASE WHEN approved THEN {_message(1, 'driver')} END AS template_category,
            CASE WHEN approved THEN {_message(2, 'driver')} END AS subject_line,
            CASE WHEN approved THEN {_body('driver', 'Valued Customer', "applied || '.0% discount'")} END AS message_body,
            status AS execution_status FROM decisions""",
        "retention_decision_no_retry": """SELECT user_id, CAST(1 AS BIGINT) AS rule_checks, p >= 0.35 AND proposed <= cap AS guardrail_approved,
            CAST(CASE WHEN p >= 0.35 AND proposed <= cap THEN proposed END AS DOUBLE) AS applied_discount_pct,
            CASE WHEN p < 0.35 THEN 'HALTED_SAFE_USER' WHEN proposed <= cap THEN 'EXECUTED_SUCCESS'
                 ELSE 'HALTED_GUARDRAIL_REJECTED' END AS execution_status FROM asked""",
        "latest_checks": """SELECT user_id, CAST(checks AS BIGINT) AS rule_checks, approved, reason,
            CAST(CASE WHEN approved THEN applied ELSE proposed END AS DOUBLE) AS proposed_discount_pct FROM decisions""",
        "latest_trace": f"""SELECT user_id, 'ltv' AS tool, CAST(CAST(ltv AS DECIMAL(18,2)) AS VARCHAR) AS outcome, 1::BIGINT AS entries FROM decisions
            UNION ALL SELECT user_id, 'rule_check', reason, CAST(checks AS BIGINT) FROM decisions
            UNION ALL SELECT user_id, 'intervention_roi', CAST(CAST(net AS DECIMAL(18,2)) AS VARCHAR), 1 FROM decisions WHERE approved
            UNION ALL SELECT user_id, 'retention_message', {_message(1, 'driver')}, 1 FROM decisions WHERE approved
            UNION ALL SELECT user_id, 'action_log', status, 1 FROM decisions WHERE approved""",
        "action_log": """SELECT '2024-01-30 00:00:00' AS timestamp, user_id, p AS churn_probability, action AS action_name, reason,
            CAST(applied AS DOUBLE) AS discount_pct, CAST(ltv AS DOUBLE) AS ltv, CAST(net AS DOUBLE) AS net_roi,
            status AS execution_status FROM decisions WHERE approved""",
        "policy_audit": """SELECT "check", violations = 0 AS passed, violations, n AS rows_checked FROM (
            SELECT unnest(['applied discount within cap', 'at most two checks', 'low risk is halted',
                           'over-cap proposals were retried', 'priced only when approved']) AS "check",
                   unnest([count(*) FILTER (WHERE applied > cap), count(*) FILTER (WHERE checks > 2),
                           count(*) FILTER (WHERE p < 0.35 AND status <> 'HALTED_SAFE_USER'),
                           count(*) FILTER (WHERE p >= 0.35 AND proposed > cap AND checks <> 2),
                           count(*) FILTER (WHERE approved <> (net IS NOT NULL))]) AS violations,
                   count(*) AS n FROM decisions)""",
        "impact_rows": f"SELECT {IMPACT_OUT} FROM impact",
        "impact_rows_fallback": f"SELECT {IMPACT_OUT} FROM impact_fb",
        "portfolio_summary": f"SELECT {SUMMARY_OUT} FROM summary",
        "portfolio_fallback": f"SELECT {SUMMARY_OUT} FROM summary_fb",
        "scenario_comparison": """SELECT 'A: no intervention' AS scenario, CAST(0 AS BIGINT) AS users_targeted,
            CAST(0 AS DOUBLE) AS expected_value_saved, CAST(0 AS DOUBLE) AS intervention_cost, CAST(0 AS DOUBLE) AS net_impact,
            CAST(0 AS DOUBLE) AS net_uplift_over_baseline, CAST(0 AS DOUBLE) AS roi_percentage
            UNION ALL SELECT 'B: retention program', eligible_high_risk_users_targeted, total_expected_value_saved,
            total_intervention_cost, total_net_impact, total_net_impact, overall_program_roi_percentage FROM summary""",
        "dashboard_frame": f"SELECT {_feature_out()}, round(p, 6) AS churn_probability, " + ", ".join(
            f"driver_{i}_feature, {_r6(f'driver_{i}_shap')} AS driver_{i}_shap, driver_{i}_text" for i in (1, 2, 3)
        ) + ", risk_tier FROM dash",
        "dashboard_without_model": f"""SELECT user_id, CAST(churn_label AS DOUBLE) AS churn_probability,
            CAST(NULL AS VARCHAR) AS driver_1_feature, {_tier('churn_label')} AS risk_tier FROM fs""",
        "executive_kpis": """SELECT (SELECT count(*) FROM fs) AS total_analyzed,
            (SELECT round(count(*) FILTER (WHERE churn_label = 1) * 100.0 / count(*), 2) FROM fs) AS baseline_churn_rate_pct,
            eligible_high_risk_users_targeted AS targeted_users, total_net_impact AS net_impact,
            total_ltv_of_targeted_users AS ltv_targeted, total_expected_value_saved AS value_saved,
            total_intervention_cost AS program_cost, overall_program_roi_percentage AS program_roi_pct FROM summary""",
        "kpi_fallback": """SELECT targeted_users, CAST(v AS DOUBLE) AS ltv_targeted, CAST(v * 0.30 AS DOUBLE) AS value_saved,
            CAST(v * 0.15 + targeted_users AS DOUBLE) AS program_cost,
            CAST(v * 0.30 - v * 0.15 - targeted_users AS DOUBLE) AS net_impact,
            round(CAST(v * 0.30 - v * 0.15 - targeted_users AS DOUBLE) / CAST(v * 0.15 + targeted_users AS DOUBLE) * 100, 2) AS program_roi_pct
            FROM (SELECT count(*) AS targeted_users, CAST(sum(monthly_fee) * 12 AS DECIMAL(24,2)) AS v FROM dash WHERE p >= 0.35)""",
        "tier_distribution": f"""SELECT risk_tier, count(*) AS users, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share_pct
            FROM (SELECT {_tier('p')} AS risk_tier FROM scored) GROUP BY risk_tier""",
        "user_profiles": f"""SELECT user_id, risk_tier, plan_tier, CAST(monthly_fee AS DOUBLE) AS monthly_fee,
            {_share('p')} || '%' AS risk_text, CAST(monthly_fee * 12 AS DOUBLE) AS ltv,
            CASE WHEN churn_label = 1 THEN 'Churned (1)' ELSE 'Active (0)' END AS actual_label,
            CAST(sessions_recent_14d AS BIGINT) AS sessions_recent_14d,
            CAST(days_since_last_session AS BIGINT) AS days_since_last_session,
            CAST(session_drop_pct AS DOUBLE) AS session_drop_pct, CAST(support_ticket_count AS BIGINT) AS support_ticket_count,
            CAST(unresolved_tickets AS BIGINT) AS unresolved_tickets,
            CAST(core_feature_usage_count AS BIGINT) AS core_feature_usage_count FROM dash""",
        "driver_table": " UNION ALL ".join(
            f"""SELECT user_id, CAST({i} AS BIGINT) AS driver_rank, driver_{i}_feature AS feature,
                CASE WHEN driver_{i}_shap < 0 THEN '-' ELSE '+' END
                || CAST(CAST(round(abs(driver_{i}_shap), 4) AS DECIMAL(18,4)) AS VARCHAR) AS shap_impact,
                CASE WHEN driver_{i}_shap > 0 THEN 'Pushes Churn Risk UP (+)' ELSE 'Pulls Churn Risk DOWN (-)' END AS direction,
                driver_{i}_text AS explanation FROM dash""" for i in (1, 2, 3)),
        "user_lookup": f"""SELECT r.request_id, r.wanted_id,
            CASE WHEN r.wanted_id IS NULL THEN 'invalid' WHEN s.user_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome,
            CASE WHEN s.user_id IS NOT NULL THEN {_tier('s.p')} END AS risk_tier, s.plan_tier, round(s.p, 6) AS churn_probability
            FROM (SELECT o_orderkey AS request_id, TRY_CAST(trim(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
                         ELSE '  ' || o_orderkey || ' ' END) AS BIGINT) AS wanted_id FROM orders) r
            LEFT JOIN scored s ON s.user_id = r.wanted_id""",
        "feature_cards": f"""SELECT user_id, {_tier('p')} AS risk_tier, plan_tier, round(p, 6) AS churn_probability FROM scored
            WHERE user_id IN ((SELECT min(user_id) FROM scored), (SELECT max(user_id) FROM scored))""",
        "risk_payload": _payload(),
        "csv_round_trip": f"SELECT {_feature_out()} FROM fs",
        "explanation_round_trip": f"SELECT {RECORD_OUT} FROM records",
        "summary_round_trip": f"SELECT {SUMMARY_OUT}, total_net_impact AS net_uplift FROM summary",
        "action_log_append": """SELECT status AS execution_status, 2 * count(*) AS entries, count(*) AS users,
            CAST(2 * sum(ltv) AS DOUBLE) AS ltv, CAST(2 * sum(net) AS DOUBLE) AS net_roi
            FROM decisions WHERE approved GROUP BY status""",
    }
    return {name: _with(text) for name, text in sql.items()}


def all_sql() -> dict[str, str]:
    return _build()
