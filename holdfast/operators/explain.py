"""Additive attributions: per feature, per user, and as sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from holdfast.functions.drivers import OVERALL_DOWN, OVERALL_UP, direction, driver_text, short_text
from holdfast.operators.models import LinearModel
from holdfast.schemas import DRIVER_STRUCT, FEATURES, LABEL

PHI = "phi_"

# --- fixed values -----------------------------------------------------------------
NAMED_DIAGNOSTICS = (
    "sessions_recent_14d", "support_ticket_count", "days_since_last_session", "total_events_60d",
    "core_feature_usage_count",
)
# ----------------------------------------------------------------------------------


def background_means(scaled: DataFrame, prefix: str = "scaled_", features=FEATURES) -> dict[str, float]:
    """Mean of every scaled feature; one aggregation, one row."""
    row = scaled.agg(*(F.avg(prefix + f).alias(f) for f in features)).first()
    return row.asDict()


def linear_attributions(scaled: DataFrame, model: LinearModel, background: dict[str, float]) -> DataFrame:
    """Adds phi_<feature> = coefficient * (x - background mean) in log-odds."""
    return scaled.select("*", *(
        (F.lit(w) * (F.col(model.prefix + f) - F.lit(background[f]))).alias(PHI + f)
        for f, w in model.coefficients.items()
    ))


def linear_base_value(model: LinearModel, background: dict[str, float]) -> float:
    """Expected margin over the background."""
    return model.intercept + sum(w * background[f] for f, w in model.coefficients.items())


def attribution_means(attributed: DataFrame, features=FEATURES) -> DataFrame:
    """(feature, mean_abs_shap, mean_signed_shap): one wide aggregation, then one row per feature."""
    wide = attributed.agg(*(
        F.struct(
            F.lit(f).alias("feature"), F.avg(F.abs(PHI + f)).alias("mean_abs_shap"),
            F.avg(PHI + f).alias("mean_signed_shap"),
        ).alias(f) for f in features
    ))
    return wide.select(F.inline(F.array(*(F.col(f) for f in features))))


def global_importance(attributed: DataFrame, features=FEATURES) -> DataFrame:
    """Features by mean |attribution|, rank 1 first. The rank window covers one row per feature."""
    ranking = Window.orderBy(F.desc("mean_abs_shap"), "feature")
    return attribution_means(attributed, features).select(
        "feature", "mean_abs_shap", F.row_number().over(ranking).alias("rank")
    ).orderBy("rank")


def chart_rows(importance: DataFrame, n: int = 8) -> DataFrame:
    """The n strongest features, weakest of them first (bar chart order)."""
    return importance.orderBy("rank").limit(n).orderBy(F.asc("mean_abs_shap"), F.desc("feature")).select(
        "feature", "mean_abs_shap"
    )


def signed_importance(attributed: DataFrame, named=NAMED_DIAGNOSTICS) -> DataFrame:
    """Mean signed attribution of the named features and which way they push overall."""
    means = attribution_means(attributed).filter(F.col("feature").isin(*named))
    push = F.when(F.col("mean_signed_shap") > 0, OVERALL_UP).otherwise(OVERALL_DOWN)
    return means.withColumn("net_direction", push).orderBy(F.desc("mean_abs_shap"), "feature")


def _strongest(k: int, features) -> Column:
    candidates = F.array(*(
        F.struct(
            (-F.abs(PHI + f)).alias("order"), F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("feature_value"), F.col(PHI + f).alias("shap_value"),
        ) for f in features
    ))
    return F.slice(F.sort_array(candidates), 1, k)


def driver_rows(attributed: DataFrame, k: int = 3, features=FEATURES, text=driver_text) -> DataFrame:
    """The k strongest features of every user as rows with their rank."""
    rows = attributed.select("user_id", F.posexplode(_strongest(k, features)).alias("position", "driver"))
    rows = rows.select("user_id", (F.col("position") + 1).alias("driver_rank"), "driver.*").drop("order")
    feature, value, phi = F.col("feature"), F.col("feature_value"), F.col("shap_value")
    return rows.select(
        "*", direction(phi).alias("direction"), text(feature, value, phi).alias("explanation")
    )


def top_drivers(k: int = 3, features=FEATURES, text=driver_text) -> Column:
    """The k strongest features of an attributed row, strongest first, ties by name.

    The candidates are sorted as an array inside the row, so nothing is shuffled. Without a `text`
    function the entries carry no sentence.
    """
    def describe(d: Column) -> Column:
        feature, value, phi = d["feature"], d["feature_value"], d["shap_value"]
        sentence = [text(feature, value, phi).alias("explanation")] if text else []
        return F.struct(
            feature.alias("feature"), value.alias("feature_value"), phi.alias("shap_value"),
            direction(phi).alias("direction"), *sentence,
        )

    return F.transform(_strongest(k, features), describe)


def short_drivers(k: int = 3, features=FEATURES) -> Column:
    """`top_drivers` with the generic sentence, as used where no stored record has a user."""
    return top_drivers(k, features, short_text)


def with_top_drivers(attributed: DataFrame, k: int = 3, features=FEATURES, text=driver_text) -> DataFrame:
    """Adds `drivers`, see `top_drivers`."""
    return attributed.withColumn("drivers", top_drivers(k, features, text))


def ranked_drivers(attributed: DataFrame, k: int = 3, features=FEATURES) -> DataFrame:
    """`with_top_drivers` without sentences, for consumers that only need the ranking."""
    return with_top_drivers(attributed, k, features, text=None)


def with_short_drivers(attributed: DataFrame, k: int = 3, features=FEATURES) -> DataFrame:
    return with_top_drivers(attributed, k, features, short_text)


def local_records(explained: DataFrame, base_value: float | Column, label: str = LABEL) -> DataFrame:
    """Nested explanation record per user. Needs drivers, churn_probability and the label."""
    base = F.lit(base_value) if isinstance(base_value, float) else base_value
    return explained.select(
        "user_id", F.col(label).cast("int").alias("actual_churn_label"),
        F.round("churn_probability", 4).alias("predicted_churn_probability"),
        (F.col("churn_probability") >= 0.5).cast("int").alias("predicted_class_0_50"),
        F.round(base, 4).alias("base_value_log_odds"),
        *(F.get("drivers", F.lit(i)).cast(DRIVER_STRUCT).alias(f"top_driver_{i + 1}") for i in range(3)),
    )


def flat_records(records: DataFrame) -> DataFrame:
    """The same record as 13 flat columns."""
    drivers = []
    for i in (1, 2, 3):
        d = F.col(f"top_driver_{i}")
        drivers += [
            d["feature"].alias(f"driver_{i}_feature"), d["shap_value"].alias(f"driver_{i}_shap"),
            d["explanation"].alias(f"driver_{i}_text"),
        ]
    return records.select(
        "user_id", F.col("actual_churn_label").alias("actual_churn"),
        F.col("predicted_churn_probability").alias("churn_probability"),
        F.col("predicted_class_0_50").alias("predicted_class"), *drivers,
    )


def nested_drivers(flat: DataFrame) -> DataFrame:
    """Adds `top_3_shap_drivers` built from the flat driver columns; absent drivers are left out."""
    entries = [
        F.when(F.col(f"driver_{i}_feature").isNotNull(), F.struct(
            F.col(f"driver_{i}_feature").alias("feature"), F.col(f"driver_{i}_shap").alias("shap_value"),
            F.col(f"driver_{i}_text").alias("text"),
        )) for i in (1, 2, 3)
    ]
    return flat.withColumn("top_3_shap_drivers", F.array_compact(F.array(*entries)))


def highest_risk_user(records: DataFrame, probability: str = "churn_probability") -> DataFrame:
    """The record with the highest probability; among equals the lowest user id."""
    best = F.max_by(F.struct(*records.columns), F.struct(F.col(probability), -F.col("user_id")))
    return records.agg(best.alias("best")).select("best.*")


def additivity(attributed: DataFrame, base_value: float, features=FEATURES, tolerance: float = 1e-4) -> DataFrame:
    """Base value plus all attributions against the margin, over every row."""
    total = F.lit(base_value)
    for f in features:
        total = total + F.col(PHI + f)
    error = F.abs(total - F.col("margin"))
    return attributed.agg(
        F.lit("additivity").alias("check"), F.bool_and(error <= tolerance).alias("passed"),
        F.count_if(error > tolerance).alias("violations"), F.count("*").alias("rows_checked"),
    )
