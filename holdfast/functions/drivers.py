"""One sentence per driver: what the feature value was and which way it moved the risk."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from holdfast.functions.numbers import count_text, money_text, pct_text, signed_text

# --- fixed values -----------------------------------------------------------------
UP, DOWN = "UP (+)", "DOWN (-)"
TABLE_UP, TABLE_DOWN = "Pushes Churn Risk UP (+)", "Pulls Churn Risk DOWN (-)"
OVERALL_UP, OVERALL_DOWN = "Pushes Toward Churn (+)", "Pushes Toward Retention (-)"
# ----------------------------------------------------------------------------------

# our own wording: (value format, text around the value when risk rises, the same when it falls)
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
GAP_FEATURE = "avg_session_gap_days"
GAP_UNKNOWN = "Too few sessions to measure pauses"


def direction(phi: Column) -> Column:
    """Zero counts as downward."""
    return F.when(phi > 0, UP).otherwise(DOWN)


# patterns over (shown value, signed attribution, feature name)
_EFFECT = {UP: f" [risk {UP} %2$s]", DOWN: f" [risk {DOWN} %2$s]"}
_GENERIC = {way: "%3$s = %1$s" + effect for way, effect in _EFFECT.items()}


def _patterns() -> dict[str, str]:
    found = {}
    for name, (_, rising, falling) in DRIVER_TEXTS.items():
        for way, (lead, tail) in ((UP, rising), (DOWN, falling)):
            found[name + way] = lead.replace("%", "%%") + "%1$s" + tail.replace("%", "%%") + _EFFECT[way]
    return found


def _of_form(form: str) -> list[str]:
    return [name for name, (f, _, _) in DRIVER_TEXTS.items() if f == form]


def _generic(phi: Column) -> Column:
    return F.when(phi > 0, _GENERIC[UP]).otherwise(_GENERIC[DOWN])


def _plain_value(value: Column) -> Column:
    return F.coalesce(money_text(value), F.lit("unknown"))


def driver_text(feature: Column, value: Column, phi: Column) -> Column:
    """Sentence for (feature, value, attribution). A NULL gap is always worded as raising risk.

    One constant lookup and one format call: the expression stays small enough to be compiled.
    """
    lookup = F.create_map(*(F.lit(x) for pair in _patterns().items() for x in pair))
    pattern = (
        F.when((feature == GAP_FEATURE) & value.isNull(), GAP_UNKNOWN + _EFFECT[UP])
        .otherwise(F.coalesce(F.try_element_at(lookup, F.concat(feature, direction(phi))), _generic(phi)))
    )
    shown = (
        F.when(feature.isin(_of_form("count")), count_text(value))
        .when(feature.isin(_of_form("pct")), pct_text(value))
        .otherwise(_plain_value(value))
    )
    return F.printf(pattern, shown, signed_text(phi), feature)


def short_text(feature: Column, value: Column, phi: Column) -> Column:
    """Generic sentence, used for features without their own wording and for late-filled drivers."""
    return F.printf(_generic(phi), _plain_value(value), signed_text(phi), feature)
