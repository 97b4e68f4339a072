"""Checks over the tables and results, each as rows of a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from holdfast.functions.numbers import ntz
from holdfast.functions.policy import HALTED_SAFE, POLICY, RetentionPolicy, discount_cap, eligible
from holdfast.operators.features import FeatureSpec, before
from holdfast.schemas import LABEL, PRIMARY_KEYS, RAW_SCHEMAS, ActivityTables

# --- fixed values -----------------------------------------------------------------
MEAN_FEATURES = (
    "days_since_last_session", "sessions_recent_14d", "sessions_previous_14d", "session_drop_pct",
    "total_events_60d", "avg_session_gap_days", "support_ticket_count", "unresolved_tickets", "total_spend_60d",
)
PROFILE_FEATURES = (
    "plan_tier", "monthly_fee", "total_spend_60d", "days_since_last_session", "sessions_recent_14d",
    "sessions_previous_14d", "session_drop_pct", "total_events_60d", "core_feature_usage_count",
    "avg_session_duration_minutes", "avg_session_gap_days", "support_ticket_count", "unresolved_tickets",
)
RECOUNTED = ("sessions_recent_14d", "sessions_previous_14d", "total_events_60d", "support_ticket_count", "total_spend_60d")
# ----------------------------------------------------------------------------------


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: ActivityTables) -> DataFrame:
    """Rows per raw table."""
    return _union(
        df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count")) for name, df in tables.items()
    )


def fanout_audit(users: DataFrame, features: DataFrame) -> DataFrame:
    """Users, feature rows and distinct feature ids must agree."""
    sides = users.select("user_id", F.lit(1).alias("u"), F.lit(0).alias("f")).unionByName(
        features.select("user_id", F.lit(0).alias("u"), F.lit(1).alias("f"))
    )
    per_user = sides.groupBy("user_id").agg(F.sum("u").alias("u"), F.sum("f").alias("f"))
    counts = per_user.agg(
        F.sum("u").alias("raw_users"), F.sum("f").alias("feature_rows"),
        F.count_if(F.col("f") > 0).alias("distinct_users"),
    )
    same = (F.col("raw_users") == F.col("feature_rows")) & (F.col("feature_rows") == F.col("distinct_users"))
    return counts.select("*", same.alias("passed"))


def recount(tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """Five measures per user, recounted from raw rows by another route than the feature table.

    Every raw row becomes one contribution (user, five increments) and a single grouped sum adds them up.
    """
    start = F.col("session_start")
    zero = F.lit(0).cast("bigint")
    none = F.lit(0).cast("decimal(18,2)")

    def contribution(df, **values):
        return df.select("user_id", *(
            values.get(m, none if m == "total_spend_60d" else zero).alias(m) for m in RECOUNTED
        ))

    one = F.lit(1).cast("bigint")
    parts = [
        contribution(tables.users, total_spend_60d=(F.col("monthly_fee") * spec.fee_periods).cast("decimal(18,2)")),
        contribution(
            tables.sessions.filter(before("session_start", spec) & (start >= ntz(spec.previous_from))),
            sessions_recent_14d=F.when(start >= ntz(spec.recent_from), one).otherwise(zero),
            sessions_previous_14d=F.when(start < ntz(spec.recent_from), one).otherwise(zero),
        ),
        contribution(tables.events.filter(before("event_timestamp", spec)), total_events_60d=one),
        contribution(tables.support_tickets.filter(before("created_at", spec)), support_ticket_count=one),
        contribution(
            tables.orders.filter(before("order_timestamp", spec)),
            total_spend_60d=F.col("amount").cast("decimal(18,2)"),
        ),
    ]
    return _union(parts).groupBy("user_id").agg(*(F.sum(m).alias(m) for m in RECOUNTED))


def recount_mismatches(features: DataFrame, tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """(user_id, measure, in_features, recounted) wherever the two disagree, over all users."""
    again = recount(tables, spec).select("user_id", F.struct(*RECOUNTED).alias("again"))
    both = features.join(again, "user_id", "full").select("user_id", F.inline(F.array(*(
        F.struct(
            F.lit(m).alias("measure"), F.col(m).cast("decimal(28,2)").alias("in_features"),
            F.col(f"again.{m}").cast("decimal(28,2)").alias("recounted"),
        ) for m in RECOUNTED
    ))))
    return both.filter(~F.col("in_features").eqNullSafe(F.col("recounted")))


def recount_audit(features: DataFrame, tables: ActivityTables, spec: FeatureSpec) -> DataFrame:
    """Per measure: users compared, disagreements, and the recounted total."""
    again = recount(tables, spec).select("user_id", F.struct(*RECOUNTED).alias("again"))
    both = features.join(again, "user_id", "left")
    wide = both.agg(*(
        F.struct(
            F.lit(m).alias("measure"), F.count("*").alias("users_checked"),
            F.count_if(~F.col(m).eqNullSafe(F.col(f"again.{m}"))).alias("mismatches"),
            F.sum(f"again.{m}").cast("decimal(28,2)").alias("recounted_total"),
        ).alias(m) for m in RECOUNTED
    ))
    return wide.select(F.inline(F.array(*(F.col(m) for m in RECOUNTED))))


REFERENCES = {"sessions": {"user_id": "users"}, "events": {"user_id": "users", "session_id": "sessions"},
              "orders": {"user_id": "users"}, "support_tickets": {"user_id": "users"}}


def _key_entries(name: str, df: DataFrame, roles: dict[tuple[str, str], int]) -> DataFrame:
    """Every row of a table as tagged keys, in one read: its own key, the keys it refers to, and its NULL columns.

    `space` names the table whose key it is ('null' for a column without a value), `owned` is 1 for the table's own
    key, `refs` has the bit of the referring column.
    """
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def entry(space, key, owned, refs):
        return F.struct(F.lit(space).alias("space"), key.cast("string").alias("key"), owned.alias("owned"), refs.alias("refs"))

    entries = [entry(name, F.col(PRIMARY_KEYS[name]), one, none)]
    for column, parent in REFERENCES.get(name, {}).items():
        if column in df.columns:
            bit = F.lit(1 << roles[name, column]).cast("bigint")
            entries.append(F.when(F.col(column).isNotNull(), entry(parent, F.col(column), none, bit)))
    for column in (c for c in RAW_SCHEMAS[name].names if c in df.columns):
        entries.append(F.when(F.col(column).isNull(), entry("null", F.lit(f"{name}.{column}"), one, none)))
    return df.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def constraint_audit(tables: ActivityTables) -> DataFrame:
    """(table_name, rule, violations) for keys, references and NOT NULL columns.

    Each table is read once. Its rows become tagged keys, which are grouped once: how often a key is owned tells duplicates,
    a reference to a key that nobody owns is an orphan, and NULLs are counted under their column's name. Tasks group
    their own keys before the shuffle, so a user or a column with very many rows arrives as one row per task. Duplicate and missing
    keys count once each; NULL keys of a table are one key, NULL references refer to nothing. Rules of columns that a table
    lacks are left out.
    """
    frames = dict(tables.items())
    roles = {pair: bit for bit, pair in enumerate((n, c) for n, own in REFERENCES.items() for c in own)}
    entries = _union(_key_entries(name, df, roles) for name, df in frames.items())
    keys = entries.groupBy("space", "key").agg(F.sum("owned").alias("owned"), F.bit_or("refs").alias("refs"))
    rules = []
    for name, df in frames.items():
        here, key = F.col("space") == name, PRIMARY_KEYS[name]
        rules.append((name, f"unique {key}", F.count_if(here & (F.col("owned") > 1))))
        for c in (c for c in RAW_SCHEMAS[name].names if c in df.columns):
            empty = (F.col("space") == "null") & (F.col("key") == f"{name}.{c}")
            rules.append((name, f"not null {c}", F.coalesce(F.sum(F.when(empty, F.col("owned"))), F.lit(0))))
        for column, parent in REFERENCES.get(name, {}).items():
            if column in df.columns:
                asked = F.col("refs").bitwiseAND(F.lit(1 << roles[name, column])) != 0
                rules.append((name, f"{column} in {parent}", F.count_if((F.col("space") == parent) & asked & (F.col("owned") == 0))))
    wide = keys.agg(*(v.cast("bigint").alias(f"r{k}") for k, (_, _, v) in enumerate(rules)))
    return wide.select(F.inline(F.array(*(
        F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.col(f"r{k}").alias("violations"))
        for k, (name, rule, _) in enumerate(rules)
    ))))


def label_distribution(features: DataFrame, label: str = LABEL) -> DataFrame:
    """Users per label with shares in percent."""
    counts = features.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("users"))
    return _shares(counts, "label")


def _shares(counts: DataFrame, key: str) -> DataFrame:
    total = F.sum("users").over(Window.partitionBy())  # a few groups
    return counts.select(key, "users", F.round(F.col("users") * F.lit(100.0) / total, 2).alias("share_pct"))


def tier_distribution(frame: DataFrame) -> DataFrame:
    """Users per risk tier with shares in percent."""
    return _shares(frame.groupBy("risk_tier").agg(F.count("*").alias("users")), "risk_tier")


def null_profile(df: DataFrame, columns=PROFILE_FEATURES) -> DataFrame:
    """Columns with missing values: how many and what percentage."""
    wide = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = wide.select("n", F.inline(F.array(*(
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns
    ))))
    return rows.filter("missing > 0").select(
        "column_name", "missing", F.round(F.col("missing") * F.lit(100.0) / F.col("n"), 2).alias("missing_pct")
    )


def dataset_profile(features: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: size, label counts and shares, imbalance 1:n, cells missing."""
    n, churned = F.count("*"), F.count_if(F.col(label) == 1)
    active = n - churned
    missing = sum((F.count_if(F.col(c).isNull()) for c in PROFILE_FEATURES), F.lit(0))
    return features.agg(
        n.alias("total_rows"), F.lit(len(features.columns)).alias("total_columns"),
        active.alias("active_users"), churned.alias("churned_users"),
        F.round(active * F.lit(100.0) / n, 2).alias("active_pct"),
        F.round(churned * F.lit(100.0) / n, 2).alias("churned_pct"),
        F.rint(active / F.greatest(F.lit(1), churned)).cast("bigint").alias("active_per_churned"),
        missing.alias("missing_cells"),
    )


def feature_means(features: DataFrame, label: str = LABEL, columns=MEAN_FEATURES) -> DataFrame:
    """(feature, non_churned_mean, churned_mean): aggregated per label first, transposed afterwards."""
    def mean(c, value):
        x = F.when(F.col(label) == value, F.col(c))
        return F.round(F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0)), 2)

    wide = features.agg(*(
        F.struct(
            F.lit(c).alias("feature"), mean(c, 0).alias("non_churned_mean"), mean(c, 1).alias("churned_mean")
        ).alias(c) for c in columns
    ))
    return wide.select(F.inline(F.array(*(F.col(c) for c in columns))))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either frame the other one lacks, counted: (only_left, only_right)."""
    names = left.columns
    sides = left.select(*names, F.lit(1).alias("side")).unionByName(right.select(*names, F.lit(-1).alias("side")))
    net = sides.groupBy(*names).agg(F.sum("side").alias("net"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("net") < 0, -F.col("net"))), F.lit(0)).alias("only_right"),
    )


def same_users_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two scored frames must cover the same users."""
    return differences(left.select("user_id"), right.select("user_id")).select(
        F.lit("same users").alias("check"), ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("passed"),
        "only_left", "only_right",
    )


def split_size_audit(split: DataFrame, share: float = 0.2, label: str = LABEL) -> DataFrame:
    """Per label: test users against the share asked for, rounded half up."""
    expected = F.floor(F.count("*") * share + 0.5)
    return split.groupBy(F.col(label).alias("label")).agg(
        F.count_if("is_test").alias("test_users"), expected.cast("bigint").alias("expected"),
        (F.count_if("is_test") == expected).alias("passed"),
    )


def train_only_audit(train: DataFrame, columns, medians: dict, means: dict, deviations: dict, tolerance: float = 1e-9) -> DataFrame:
    """(feature, statistic, passed): what was applied against a recount from the training users alone.

    Statistics that were fitted with test users in them differ from the recount. The median of n values is
    recounted as a claim about ranks: at most half of the values lie below it, at most half above.
    """
    known = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians.get(c, 0.0)))) for c in columns}

    def close(value, applied):
        return F.abs(value - float(applied)) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.lit(float(applied))))

    checks = []
    for c in columns:
        if c in medians:
            x, half = F.col(c).cast("double"), F.count(c) / 2
            ranked = (F.count_if(x < float(medians[c])) <= half) & (F.count_if(x > float(medians[c])) <= half)
            checks.append((c, "median", ranked))
        checks.append((c, "mean", close(F.avg(known[c]), means[c])))
        checks.append((c, "deviation", close(F.stddev_pop(known[c]), deviations[c])))
    wide = train.agg(*(F.struct(F.lit(c).alias("feature"), F.lit(s).alias("statistic"), v.alias("passed")).alias(f"c{k}")
                       for k, (c, s, v) in enumerate(checks)))
    return wide.select(F.inline(F.array(*(F.col(f"c{k}") for k in range(len(checks))))))


def crossing_sessions(sessions: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Sessions that start before the cutoff and end after it: their length tells of the time after it."""
    crossing = before("session_start", spec) & (F.col("session_end") >= ntz(spec.cutoff))
    return sessions.agg(
        F.lit("sessions across the cutoff").alias("check"), F.count_if(crossing).alias("sessions"),
        F.count_distinct(F.when(crossing, F.col("user_id"))).alias("users"),
    )


def threshold_audit(classified: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The class that a model names by itself must follow from the probability on every row."""
    expected = (F.col("churn_probability") >= threshold).cast("int")
    wrong = ~F.col("predicted_class").eqNullSafe(expected)
    return classified.agg(
        F.lit("class equals probability >= threshold").alias("check"), F.bool_and(~wrong).alias("passed"),
        F.count_if(wrong).alias("violations"), F.count("*").alias("rows_checked"),
    )


def future_perturbed(tables: ActivityTables, spec: FeatureSpec, days: int = 7) -> ActivityTables:
    """The same tables with everything after the cutoff moved further into the future and renamed."""
    later = F.expr(f"interval {days} days")

    def shift(df, *columns, **replaced):
        seen = before(columns[0], spec)
        moved = {c: F.when(seen, F.col(c)).otherwise(F.col(c) + later) for c in columns}
        changed = {c: F.when(seen, F.col(c)).otherwise(v) for c, v in replaced.items()}
        return df.withColumns({**moved, **changed})

    return ActivityTables(
        tables.users,
        shift(tables.sessions, "session_start", "session_end"),
        shift(tables.events, "event_timestamp", event_name=F.lit(spec.core_event)),
        shift(tables.orders, "order_timestamp", amount=(F.col("amount") * 2).cast("decimal(8,2)")),
        shift(tables.support_tickets, "created_at", status=F.lit(spec.unresolved[0])),
    )


def leakage_audit(features: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Features must not react to changes after the cutoff."""
    found = differences(features, perturbed)
    return found.select(
        F.lit("features ignore the future").alias("check"),
        ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("passed"), "only_left", "only_right",
    )


def policy_audit(decisions: DataFrame, policy: RetentionPolicy = POLICY) -> DataFrame:
    """Violations of the policy's rules over all decisions; every count must be 0."""
    approved, policy_cap = F.col("guardrail_approved"), discount_cap(F.col("ltv"), policy)
    safe, allowed = ~eligible(F.col("churn_probability"), policy), 1 + policy.max_retries
    rules = {
        "applied discount within cap": approved & (F.col("applied_discount_pct") > policy_cap),
        "at most two checks": F.col("rule_checks") > allowed,
        "low risk is halted": safe & (approved | (F.col("execution_status") != HALTED_SAFE)),
        "over-cap proposals were retried": ~safe & (F.col("proposed_discount_pct") > policy_cap)
        & (F.col("rule_checks") != F.least(F.lit(2), F.lit(allowed))),
        "priced only when approved": approved != F.col("net_impact").isNotNull(),
    }
    wide = decisions.agg(F.count("*").alias("n"), *(F.count_if(v).alias(k) for k, v in rules.items()))
    return wide.select("n", F.inline(F.array(*(
        F.struct(F.lit(k).alias("check"), F.col(f"`{k}`").alias("violations")) for k in rules
    )))).select("check", (F.col("violations") == 0).alias("passed"), "violations", F.col("n").alias("rows_checked"))
