"""Data behind the screens: combined frame, KPIs, profiles, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from holdfast.functions.drivers import TABLE_DOWN, TABLE_UP
from holdfast.functions.policy import POLICY, RetentionPolicy, eligible, ltv, risk_tier, share_text
from holdfast.schemas import LABEL

DRIVER_COLUMNS = tuple(f"driver_{i}_{part}" for i in (1, 2, 3) for part in ("feature", "shap", "text"))


def with_missing_columns(df: DataFrame, columns: dict[str, str], value=None) -> DataFrame:
    """Adds absent columns (name to type) filled with one value."""
    return df.withColumns({
        name: F.lit(value).cast(kind) for name, kind in columns.items() if name not in df.columns
    })


def flatten_drivers(df: DataFrame) -> DataFrame:
    """`drivers` array to the nine flat driver columns."""
    flat = []
    for i in (1, 2, 3):
        d = F.get("drivers", F.lit(i - 1))
        flat += [
            d["feature"].alias(f"driver_{i}_feature"), d["shap_value"].alias(f"driver_{i}_shap"),
            d["explanation"].alias(f"driver_{i}_text"),
        ]
    return df.select("*", *flat)


def dashboard_frame(frame: DataFrame, precomputed: DataFrame | None = None, policy: RetentionPolicy = POLICY,
                    missing: Column | None = None) -> DataFrame:
    """Every user with features, probability, three drivers and risk tier.

    `frame` is the feature table, scored or not, with `drivers` or without; the label stands in for
    a missing probability. Where `precomputed` has a user, its drivers win over those in the frame.
    `missing` is the expression of a `drivers` array (see `explain.top_drivers`) for users without stored drivers; it
    stands in the branch of the misses, so nothing is ranked or worded for the others.
    """
    if "churn_probability" not in frame.columns:
        frame = frame.withColumn("churn_probability", F.col(LABEL).cast("double"))
    if precomputed is not None:
        stored = precomputed.select("user_id", F.struct(*DRIVER_COLUMNS).alias("stored"))
        frame = frame.join(stored, "user_id", "left")
        known = F.col("stored.driver_1_feature").isNotNull()
        if missing is not None:
            frame = frame.withColumn("drivers", F.when(~known, missing))
    elif missing is not None:
        frame = frame.withColumn("drivers", missing)
    if "drivers" in frame.columns:
        frame = flatten_drivers(frame).drop("drivers")
    frame = with_missing_columns(frame, {c: "double" if c.endswith("shap") else "string" for c in DRIVER_COLUMNS})
    if precomputed is not None:
        frame = frame.withColumns({
            c: F.when(known, F.col(f"stored.{c}")).otherwise(F.col(c)) for c in DRIVER_COLUMNS
        }).drop("stored")
    return frame.withColumn("risk_tier", risk_tier(F.col("churn_probability"), policy))


def executive_kpis(features: DataFrame, summary: DataFrame) -> DataFrame:
    """Eight headline numbers, from the program summary."""
    base = features.agg(
        F.count("*").alias("total_analyzed"),
        F.round(F.count_if(F.col(LABEL) == 1) * F.lit(100.0) / F.count("*"), 2).alias("baseline_churn_rate_pct"),
    )
    program = summary.select(F.struct(
        F.col("eligible_high_risk_users_targeted").alias("targeted_users"),
        F.col("total_net_impact").alias("net_impact"), F.col("total_ltv_of_targeted_users").alias("ltv_targeted"),
        F.col("total_expected_value_saved").alias("value_saved"),
        F.col("total_intervention_cost").alias("program_cost"),
        F.col("overall_program_roi_percentage").alias("program_roi_pct"),
    ).alias("program"))
    return base.withColumn("program", program.scalar()).select("total_analyzed", "baseline_churn_rate_pct", "program.*")


def kpi_fallback(frame: DataFrame, policy: RetentionPolicy = POLICY) -> DataFrame:
    """Program numbers without a summary: every risky user at a flat 15 % discount plus a message."""
    hit = eligible(F.col("churn_probability"), policy)
    users = F.count_if(hit)
    value = F.coalesce(F.sum(F.when(hit, F.col("monthly_fee"))), F.lit(0)).cast("decimal(24,2)") * policy.lifespan_months
    totals = frame.agg(users.alias("targeted_users"), value.cast("decimal(28,2)").alias("ltv_targeted"))
    saved = (F.col("ltv_targeted") * F.lit(policy.success_rate)).cast("decimal(28,2)")
    cost = (F.col("ltv_targeted") * F.lit("0.15").cast("decimal(3,2)")
            + F.col("targeted_users") * F.lit(policy.message_cost)).cast("decimal(28,2)")
    priced = totals.select("*", saved.alias("value_saved"), cost.alias("program_cost"))
    net = (F.col("value_saved") - F.col("program_cost")).cast("decimal(28,2)")
    return priced.select("*", net.alias("net_impact")).select("*", F.round(
        F.when(F.col("program_cost") > 0,
               F.col("net_impact").cast("double") / F.col("program_cost").cast("double") * 100).otherwise(0.0), 2
    ).alias("program_roi_pct"))


# --- fixed values -----------------------------------------------------------------
PROFILE_COLUMNS = (
    "sessions_recent_14d", "days_since_last_session", "session_drop_pct", "support_ticket_count",
    "unresolved_tickets", "core_feature_usage_count",
)
# ----------------------------------------------------------------------------------


def user_profiles(frame: DataFrame) -> DataFrame:
    """Account card per user: plan, risk, value, label and six behaviours."""
    return frame.select(
        "user_id", "risk_tier", "plan_tier", "monthly_fee",
        F.concat(share_text(F.col("churn_probability")), F.lit("%")).alias("risk_text"),
        ltv(F.col("monthly_fee")).alias("ltv"),
        F.when(F.col(LABEL) == 1, "Churned (1)").otherwise("Active (0)").alias("actual_label"),
        *PROFILE_COLUMNS,
    )


def driver_table(frame: DataFrame) -> DataFrame:
    """Driver rows per user: rank, feature, signed impact with four digits, direction, text."""
    entries = F.array_compact(F.array(*(
        F.when(F.col(f"driver_{i}_feature").isNotNull(), F.struct(
            F.lit(i).alias("driver_rank"), F.col(f"driver_{i}_feature").alias("feature"),
            F.col(f"driver_{i}_shap").alias("shap"), F.col(f"driver_{i}_text").alias("explanation"),
        )) for i in (1, 2, 3)
    )))
    size = F.round(F.abs("shap"), 4).cast("decimal(18,4)").cast("string")
    return frame.select("user_id", F.inline(entries)).select(
        "user_id", "driver_rank", "feature",
        F.concat(F.when(F.col("shap") < 0, "-").otherwise("+"), size).alias("shap_impact"),
        F.when(F.col("shap") > 0, TABLE_UP).otherwise(TABLE_DOWN).alias("direction"),
        "explanation",
    )


CARD_COLUMNS = ("user_id", "risk_tier", "plan_tier", "churn_probability")


def write_cards(frame: DataFrame, path: str, files: int | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """Stores what a lookup shows, laid out for it: sorted by id, with a Bloom filter of the ids in every row group.

    An id that is asked for then opens only the row groups whose range and filter admit it.
    """
    users = frame.select(*CARD_COLUMNS)
    sorted_cards = users.repartitionByRange(*([files] if files else []), "user_id").sortWithinPartitions("user_id")
    writer = sorted_cards.write.option("parquet.bloom.filter.enabled#user_id", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return frame.sparkSession.read.schema(users.schema).parquet(path)


def find_users(cards: DataFrame, ids: list[int]) -> DataFrame:
    """The stored cards of a few ids, by a filter that reaches the files."""
    return cards.filter(F.col("user_id").isin([int(i) for i in ids]))


SPREAD = 64


def lookup(cards: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers typed-in user ids: outcome `found`, `not_found` or `invalid`, with the match if any.

    `requests` has request_id and user_text and is read once; blanks around the number are ignored. Unreadable ids
    match nothing; a second key deals them over many partitions, where NULLs alone would pile up in one.
    """
    wanted = F.expr("try_cast(trim(user_text) as bigint)")
    parsed = requests.select("request_id", wanted.alias("wanted_id")).withColumn(
        "spread", F.when(F.col("wanted_id").isNull(), F.pmod(F.xxhash64("request_id"), F.lit(SPREAD))).otherwise(F.lit(0).cast("bigint"))
    )
    known = cards.select(
        F.col("user_id").cast("bigint").alias("wanted_id"), F.col("user_id").cast("bigint").bitwiseAND(F.lit(0).cast("bigint")).alias("spread"),
        *CARD_COLUMNS[1:], F.lit(True).alias("hit"),
    )
    outcome = F.when(F.col("wanted_id").isNull(), "invalid").when(F.col("hit"), "found").otherwise("not_found")
    return parsed.join(known, ["wanted_id", "spread"], "left").select("request_id", "wanted_id", outcome.alias("outcome"), *CARD_COLUMNS[1:])


def risk_payload(frame: DataFrame) -> DataFrame:
    """Risk profile per user as one JSON document; needs `top_3_shap_drivers`."""
    profile = F.struct(
        "user_id", F.round("churn_probability", 4).alias("churn_probability"), "risk_tier", "plan_tier",
        F.col("monthly_fee").cast("double").alias("monthly_fee"), "top_3_shap_drivers",
    )
    return frame.select("user_id", F.to_json(profile).alias("payload"))
