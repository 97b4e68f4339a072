"""Registered queries: name -> (spark, sf_dir) -> DataFrame, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from holdfast.functions import policy as P
from holdfast.operators import (
    audits, daily_state, dashboard, explain, features as feat, impact, metrics, models, prep, retention, sessions, tree_nodes, tree_shap,
)
from holdfast.operators.features import build_features
from holdfast.plans.fixed_model import TREES
from holdfast.plans.workspace import Workspace, workspace
from holdfast.schemas import FEATURE_SCHEMA, FEATURES, NUMERIC_FEATURES, RAW_SCHEMAS
from holdfast.session import scratch_path
from holdfast.sources import readers, writers
from holdfast.sources.driver_tables import CUTOFF, driver_spec, features_from_log, load_driver_tables
from holdfast.sources.writers import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
RISK_DIGITS = 6


def _plain(df: DataFrame) -> DataFrame:
    """Result types every engine shares: whole numbers as bigint, other numbers as double."""
    casts = {}
    for field in df.schema:
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            casts[field.name] = F.col(field.name).cast("bigint")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            casts[field.name] = F.col(field.name).cast("double")
    return df.withColumns(casts)


def query(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """Registers a function of the workspace under its own name."""
    _QUERIES[build.__name__] = lambda spark, sf_dir: _plain(build(workspace(spark, sf_dir)))
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r6(c):
    return F.round(c, RISK_DIGITS)


def _round(df: DataFrame, *columns: str, digits: int = RISK_DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- features ------------------------------------------------------------------------

@query
def feature_store(w):
    """From a single scan of the event log, of which all activity tables are views."""
    return features_from_log(w.spark, w.sf_dir, w.spec)


@query
def feature_store_five_tables(w):
    """The same table from five separate raw tables."""
    return build_features(w.tables, w.spec)


def _next_day(w):
    """Specs of the day before the cutoff and of the cutoff, with the features of both from one store of days."""
    today, path = w.spec, scratch_path(w.spark, "days")
    yesterday = replace(today, cutoff=today.cutoff - timedelta(days=1), as_of=today.as_of - timedelta(days=1))
    daily_state.store_days(daily_state.day_partials(w.stored_tables, today), path)
    before = materialize(daily_state.advanced(None, daily_state.stored_days(w.spark, path, None, yesterday.cutoff), yesterday), "state")
    now = daily_state.advanced(before, daily_state.stored_days(w.spark, path, yesterday.cutoff, today.cutoff), today)
    return [
        (spec, daily_state.features_at(w.tables.users, state, daily_state.stored_days(w.spark, path, spec.cutoff), spec))
        for spec, state in ((yesterday, before), (today, now))
    ]


@query
def feature_store_from_state(w):
    """The same table from the stored state of the day before and one more day."""
    return _next_day(w)[1][1]


@query
def cutoff_audit(w):
    """Features of two cutoffs from one store of days against full builds: rows that either side lacks, which must be none."""
    parts = []
    for spec, found in _next_day(w):
        apart = audits.differences(found, build_features(w.stored_tables, spec))
        parts.append(apart.select(F.lit(str(spec.cutoff.date())).alias("cutoff"), "only_left", "only_right"))
    return parts[0].unionByName(parts[1])


@query
def feature_store_7d(w):
    return features_from_log(w.spark, w.sf_dir, driver_spec(window_days=7))


@query
def filter_profile(w):
    return feat.filter_profile(w.tables, w.spec)


@query
def session_features(w):
    return feat.session_features(w.tables.sessions, w.spec)


@query
def event_features(w):
    return feat.event_features(w.tables.events, w.spec)


@query
def order_features(w):
    return feat.order_features(w.tables.orders, w.spec)


@query
def support_features(w):
    return feat.support_features(w.tables.support_tickets, w.spec)


@query
def session_drop_branches(w):
    """Users per branch of the session-drop rule, with the range of the result."""
    recent, previous = F.col("sessions_recent_14d"), F.col("sessions_previous_14d")
    branch = (
        F.when((recent == 0) & (previous == 0), "no sessions in either window")
        .when(previous == 0, "only recent sessions").when(recent == 0, "only previous sessions")
        .otherwise("both windows")
    )
    return w.features.groupBy(branch.alias("branch")).agg(
        F.count("*").alias("users"), F.min("session_drop_pct").alias("lowest"), F.max("session_drop_pct").alias("highest")
    )


@query
def sessions_table(w):
    return w.tables.sessions.select(
        "session_id", "user_id", "device_type", F.col("session_start").cast("string").alias("started"),
        F.col("session_end").cast("string").alias("ended"),
    )


@query
def lag_sessions(w):
    lagged = sessions.lag_starts(w.stored_tables.sessions, w.spec.cutoff)
    return lagged.select("session_id", "user_id", F.col("prev_session_start").cast("string").alias("prev_start"))


@query
def lag_gap(w):
    return sessions.lag_gap(w.stored_tables.sessions, w.spec.cutoff)


@query
def telescoped_gap(w):
    return sessions.telescoped_gap(w.stored_tables.sessions, w.spec.cutoff)


@query
def gap_join(w):
    return sessions.session_features_by_join(w.stored_tables.sessions, w.spec.cutoff)


@query
def gap_plan_audit(w):
    """Users on whom the lag plan and the telescoped plan disagree; must be none."""
    a = sessions.lag_gap(w.stored_tables.sessions, w.spec.cutoff)
    b = sessions.telescoped_gap(w.stored_tables.sessions, w.spec.cutoff).filter("avg_session_gap_days is not null")
    return audits.differences(a, b)


@query
def future_active_users(w):
    return feat.later_active(w.tables, w.spec)


@query
def churn_labels(w):
    return feat.churn_labels(w.tables, w.spec)


@query
def churned_users(w):
    return feat.churned_users(w.tables, w.spec)


@query
def churn_summary(w):
    return feat.churn_summary(w.tables, w.spec)


# ---- audits --------------------------------------------------------------------------

@query
def row_counts(w):
    return audits.row_counts(w.tables)


@query
def fanout_audit(w):
    return audits.fanout_audit(w.tables.users, w.features)


@query
def recount_audit(w):
    return audits.recount_audit(w.features, w.tables, w.spec)


@query
def recount_mismatches(w):
    return audits.recount_mismatches(w.features, w.tables, w.spec)


@query
def crossing_sessions(w):
    return audits.crossing_sessions(w.tables.sessions, w.spec)


@query
def split_size_audit(w):
    return audits.split_size_audit(w.encoded)


@query
def train_only_audit(w):
    """Medians, means and deviations that were applied, against the training users alone."""
    p = w.preprocessor
    middle = {c: v for c, v in p.medians.items() if v is not None}
    return audits.train_only_audit(w.train, FEATURES, middle, p.means, p.deviations)


@query
def constraint_audit(w):
    return audits.constraint_audit(w.stored_tables)


@query
def leakage_audit(w):
    changed = audits.future_perturbed(w.tables, w.spec)
    return audits.leakage_audit(w.features.drop("churn_label"), build_features(changed, w.spec).drop("churn_label"))


@query
def label_distribution(w):
    return audits.label_distribution(w.features)


@query
def null_profile(w):
    return audits.null_profile(w.features)


@query
def dataset_profile(w):
    return audits.dataset_profile(w.features)


@query
def feature_means(w):
    return audits.feature_means(w.features)


# ---- preparation and models ----------------------------------------------------------

@query
def one_hot(w):
    return prep.one_hot(w.features).select("user_id", "plan_tier", *(f for f in FEATURES if f.startswith("plan_tier_")))


@query
def stratified_split(w):
    return prep.stratified_split(w.features).select("user_id", "churn_label", "is_test")


@query
def split_sizes(w):
    return w.encoded.groupBy("churn_label", "is_test").agg(F.count("*").alias("users"))


@query
def median_imputation(w):
    return prep.medians(w.train, NUMERIC_FEATURES).select("feature", "non_null", _r6(F.col("median")).alias("median"))


@query
def scale_statistics(w):
    stats = prep.scale_statistics(w.preprocessor.impute(w.train))
    return _round(stats, "mean", "deviation")


@query
def scaled_features(w):
    return w.scaled.select("user_id", "is_test", *(_r6(F.col(f"scaled_{f}")).alias(f"scaled_{f}") for f in FEATURES))


@query
def linear_score(w):
    return _round(w.scored.select("user_id", "margin", "churn_probability"), "margin", "churn_probability")


def _test(df):
    return df.filter("is_test")


@query
def confusion_matrix(w):
    return metrics.confusion_matrix(metrics.classify(_test(w.scored)))


@query
def classification_metrics(w):
    row = metrics.classification_metrics(metrics.confusion_matrix(metrics.classify(_test(w.scored))))
    return _round(row, *row.columns)


@query
def evaluation(w):
    return _round(metrics.evaluate(_test(w.scored)), *metrics.METRICS)


@query
def roc_auc(w):
    return _round(metrics.roc_auc(_test(w.scored)), "roc_auc")


@query
def roc_auc_all_users(w):
    return _round(metrics.roc_auc(w.baseline_scored), "roc_auc")


@query
def model_comparison(w):
    rows = metrics.compare_models(_test(w.scored), _test(w.baseline_scored))
    return _round(rows, "baseline", "challenger", "delta")


@query
def model_comparison_no_baseline(w):
    return _round(metrics.compare_models(_test(w.scored), None), "baseline", "challenger", "delta")


@query
def threshold_audit(w):
    """The linear model names a class by the side of its hyperplane."""
    return audits.threshold_audit(w.scored.withColumn("predicted_class", (F.col("margin") >= 0).cast("int")))


def _class_check(predicted):
    return audits.threshold_audit(predicted.withColumnRenamed(models.MODEL_CLASS, "predicted_class"))


@query
def same_users_audit(w):
    return audits.same_users_audit(_test(w.scored), _test(w.baseline_scored))


# ---- explanations --------------------------------------------------------------------

def _long(attributed):
    return attributed.select("user_id", F.inline(F.array(*(
        F.struct(F.lit(f).alias("feature"), F.col(explain.PHI + f).alias("shap_value")) for f in FEATURES
    ))))


@query
def linear_shap(w):
    return _long(w.attributed).select("user_id", "feature", _r6(F.col("shap_value")).alias("shap_value"))


@query
def base_value(w):
    """Expected margin over all users, twice: from the model and as the mean margin, and as a probability."""
    base = F.lit(w.base_value)
    return w.scored.agg(F.avg("margin").alias("mean_margin")).select(
        _r6(base).alias("base_value"), _r6(F.col("mean_margin")).alias("mean_margin"),
        _r6(models.sigmoid(base)).alias("base_probability"),
    )


@query
def additivity_audit(w):
    return explain.additivity(w.attributed, w.base_value)


@query
def global_importance(w):
    return _round(explain.global_importance(_test(w.attributed)), "mean_abs_shap")


@query
def importance_chart(w):
    return _round(explain.chart_rows(explain.global_importance(_test(w.attributed))), "mean_abs_shap")


@query
def signed_importance(w):
    return _round(explain.signed_importance(_test(w.attributed)), "mean_abs_shap", "mean_signed_shap")


@query
def top_drivers(w):
    """Three drivers of every user as rows."""
    return _round(explain.driver_rows(w.attributed), "feature_value", "shap_value")


@query
def driver_window_rank(w):
    """The same ranking in long form, by a window per user."""
    by_size = Window.partitionBy("user_id").orderBy(F.desc(F.abs("shap_value")), "feature")
    ranked = _long(w.attributed).withColumn("driver_rank", F.row_number().over(by_size))
    return ranked.filter("driver_rank <= 3").select("user_id", "feature", "driver_rank")


@query
def local_explanations(w):
    flat = explain.flat_records(w.records)
    return _round(flat, "driver_1_shap", "driver_2_shap", "driver_3_shap")


@query
def highest_risk_user(w):
    flat = explain.flat_records(w.records)
    return _round(explain.highest_risk_user(flat), "driver_1_shap", "driver_2_shap", "driver_3_shap")


def _dashboard(w):
    return dashboard.dashboard_frame(w.attributed, w.stored_records, missing=explain.short_drivers())


@query
def filled_drivers(w):
    """First driver of every user: precomputed for the test users, computed for the others."""
    return _round(_dashboard(w).select("user_id", "driver_1_feature", "driver_1_shap", "driver_1_text"), "driver_1_shap")


def _fixed_trees(w):
    table = tree_shap.leaves_of(TREES)
    return table, tree_shap.tree_attributions(w.tree_input, table)


@query
def tree_shap_fixed(w):
    """Attributions of the fixed trees, one row per user and input."""
    _, attributed = _fixed_trees(w)
    return attributed.select("user_id", F.inline(F.array(*(
        F.struct(F.lit(f).alias("feature"), _r6(F.col(explain.PHI + f)).alias("shap_value"))
        for f in models.TREE_FEATURES
    ))))


@query
def tree_margin_fixed(w):
    """Base value plus attributions of the fixed trees, which must be their score."""
    table, attributed = _fixed_trees(w)
    total = sum((F.col(explain.PHI + f) for f in models.TREE_FEATURES), F.lit(table.base_value))
    return attributed.select("user_id", _r6(F.lit(table.base_value)).alias("base_value"), _r6(total).alias("margin"))


# ---- retention and impact ------------------------------------------------------------

def _profiles(w):
    """All users with score, strongest driver and, for most, an explicit discount request."""
    turn = F.col("user_id") % 8
    return w.ranked.select(
        "user_id", F.round("churn_probability", 4).alias("churn_probability"), "plan_tier",
        F.col("monthly_fee").cast("decimal(8,2)").alias("monthly_fee"),
        F.col("drivers")[0]["feature"].alias("driver_1_feature"),
        F.when(turn > 0, turn * 5).cast("decimal(9,2)").alias("override_proposed_discount_pct"),
        F.when(turn > 0, F.concat(F.lit("Offer "), turn.cast("string"))).alias("override_action_name"),
    )


@query
def ltv(w):
    return w.features.select("user_id", P.ltv(F.col("monthly_fee")).alias("ltv"))


@query
def discount_caps(w):
    value = P.ltv(F.col("monthly_fee"))
    return w.features.groupBy("plan_tier").agg(
        F.count("*").alias("users"), F.min(value).alias("lowest_ltv"), F.max(value).alias("highest_ltv"),
        F.min(P.discount_cap(value)).alias("lowest_cap"), F.max(P.discount_cap(value)).alias("highest_cap"),
    )


@query
def rule_check(w):
    value = P.ltv(F.col("monthly_fee"))
    asked = F.coalesce("override_proposed_discount_pct", F.lit(0).cast("decimal(9,2)"))
    action = F.coalesce("override_action_name", F.lit("No offer"))
    verdict = P.rule_check(F.col("churn_probability"), value, action, asked)
    return _profiles(w).select("user_id", verdict.alias("verdict")).select("user_id", "verdict.*")


@query
def intervention_roi(w):
    value = P.ltv(F.col("monthly_fee"))
    roi = P.intervention_roi(value, P.discount_cap(value))
    return w.features.select("user_id", value.alias("ltv"), roi.alias("roi")).select("user_id", "ltv", "roi.*")


@query
def strategy(w):
    plan = P.strategy(F.col("driver_1_feature"), F.col("plan_tier"))
    return _profiles(w).select("user_id", "driver_1_feature", plan.alias("plan")).select("user_id", "driver_1_feature", "plan.*")


@query
def retention_message(w):
    """A message per user and top-three driver, so that every template occurs; odd users get an offer."""
    offer = F.when(F.col("user_id") % 2 == 1, F.lit("10% discount"))
    message = P.retention_message(F.col("feature"), F.lit("customer"), offer)
    return explain.driver_rows(w.attributed).select("user_id", "feature", message.alias("message")).select(
        "user_id", "feature", "message.*"
    )


@query
def risk_tiers(w):
    return w.scored.select("user_id", P.risk_tier(F.col("churn_probability")).alias("risk_tier"))


def _decisions(w):
    return retention.decide(_profiles(w))


@query
def retention_decision(w):
    return _decisions(w).drop("trace")


@query
def retention_decision_no_retry(w):
    decided = retention.decide(_profiles(w), P.RetentionPolicy(max_retries=0))
    return decided.select("user_id", "rule_checks", "guardrail_approved", "applied_discount_pct", "execution_status")


@query
def latest_checks(w):
    return retention.latest_checks(retention.trace_rows(_decisions(w)))


@query
def latest_trace(w):
    return retention.latest_trace(retention.full_trace(_decisions(w)))


@query
def action_log(w):
    return retention.action_log(_decisions(w), CUTOFF).withColumn("timestamp", F.col("timestamp").cast("string"))


@query
def policy_audit(w):
    return audits.policy_audit(_decisions(w))


def _impact(w):
    return impact.impact_rows(impact.impact_input(w.features, explain.flat_records(w.records)))


def _impact_fallback(w):
    return impact.impact_rows(impact.impact_input(w.features))


@query
def impact_rows(w):
    return _impact(w)


@query
def impact_rows_fallback(w):
    return _impact_fallback(w)


@query
def portfolio_summary(w):
    return impact.portfolio_summary(_impact(w))


@query
def portfolio_fallback(w):
    return impact.portfolio_summary(_impact_fallback(w))


@query
def scenario_comparison(w):
    return impact.scenario_comparison(impact.portfolio_summary(_impact(w)))


# ---- dashboard -----------------------------------------------------------------------

@query
def dashboard_frame(w):
    frame = _round(_dashboard(w), "churn_probability", "driver_1_shap", "driver_2_shap", "driver_3_shap")
    return frame.select(*w.features.columns, "churn_probability", *dashboard.DRIVER_COLUMNS, "risk_tier")


@query
def dashboard_trained(w):
    """Dashboard of a stored model: saved, loaded, all users scored, drivers computed for those without a stored record.

    One row of counts that are fixed beforehand: users, users without drivers, scores that differ from the model in
    memory, drivers that differ from the stored record where there is one, tiers that don't follow from the score.
    """
    path = scratch_path(w.spark, "served-model")
    models.save_model(w.gbt_model, path)
    served = models.load_model(path)
    stored = explain.flat_records(explain.local_records(explain.with_top_drivers(_test(w.tree_attributed)), w.leaves.base_value))
    scored = tree_shap.explain(w.tree_input, served, tree_shap.read_saved_leaves(w.spark, path))
    fresh = dashboard.dashboard_frame(explain.with_top_drivers(scored.join(stored.select("user_id"), "user_id", "left_anti")))
    known = dashboard.dashboard_frame(scored.join(stored.select("user_id"), "user_id", "left_semi"), stored)
    frame = fresh.select("user_id", "churn_probability", "risk_tier", *dashboard.DRIVER_COLUMNS).unionByName(
        known.select("user_id", "churn_probability", "risk_tier", *dashboard.DRIVER_COLUMNS))
    before = w.gbt_scored.select("user_id", F.col("churn_probability").alias("before"))
    record = stored.select("user_id", F.col("driver_1_feature").alias("stored_driver"))
    tier = P.risk_tier(F.col("churn_probability"))
    return frame.join(before, "user_id", "full").join(record, "user_id", "left").agg(
        F.count("*").alias("users"), F.count_if(F.col("driver_1_feature").isNull()).alias("without_drivers"),
        F.count_if(~F.col("churn_probability").eqNullSafe(F.col("before"))).alias("changed_scores"),
        F.count_if(F.col("stored_driver").isNotNull() & ~F.col("stored_driver").eqNullSafe(F.col("driver_1_feature"))).alias("changed_drivers"),
        F.count_if(~F.col("risk_tier").eqNullSafe(tier)).alias("wrong_tiers"),
    )


@query
def lr_optimality(w):
    """Gradient of the penalized loss at the trained coefficients, which the optimum makes 0, feature by feature."""
    linear = models.as_linear(w.lr_model)
    train = linear.score(w.preprocessor.transform(w.train))
    error = F.col("churn_probability") - F.col("churn_label")
    wide = train.agg(F.avg(error).alias("intercept"), F.count("*").alias("n"), *(F.avg(error * F.col(f"scaled_{f}")).alias(f) for f in FEATURES))
    return wide.select(F.inline(F.array(
        F.struct(F.lit("intercept").alias("feature"), (F.abs("intercept") < 1e-3).alias("at_optimum")),
        *(F.struct(F.lit(f).alias("feature"), (F.abs(F.col(f) + linear.coefficients[f] / F.col("n")) < 1e-3).alias("at_optimum")) for f in FEATURES),
    )))


@query
def dashboard_without_model(w):
    frame = dashboard.dashboard_frame(w.features)
    return frame.select("user_id", "churn_probability", "driver_1_feature", "risk_tier")


@query
def executive_kpis(w):
    return dashboard.executive_kpis(w.features, impact.portfolio_summary(_impact(w)))


@query
def kpi_fallback(w):
    return dashboard.kpi_fallback(dashboard.dashboard_frame(w.scored))


@query
def tier_distribution(w):
    return audits.tier_distribution(w.scored.select(P.risk_tier(F.col("churn_probability")).alias("risk_tier")))


@query
def user_profiles(w):
    return dashboard.user_profiles(_dashboard(w))


@query
def driver_table(w):
    return dashboard.driver_table(_dashboard(w))


@query
def user_lookup(w):
    """Typed-in ids taken from the orders file: padded numbers, many of them unknown, and words."""
    requests = w.spark.read.parquet(f"{w.sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit(" "))).alias("user_text"),
    )
    return _round(dashboard.lookup(w.cards, requests), "churn_probability")


@query
def feature_cards(w):
    """Cards of the lowest and highest user and of an id that nobody has, found in the stored layout by pushed filters."""
    ends = w.cards.agg(F.min("user_id").alias("low"), F.max("user_id").alias("high")).first()  # two numbers
    return _round(dashboard.find_users(w.cards, [ends["low"], ends["high"], ends["high"] + 1]), "churn_probability")


@query
def risk_payload(w):
    flat = _dashboard(w).withColumns({
        **{f"driver_{i}_shap": F.round(f"driver_{i}_shap", 4).cast("decimal(18,4)") for i in (1, 2, 3)},
        "churn_probability": F.round("churn_probability", 4).cast("decimal(6,4)"),
    })
    return dashboard.risk_payload(explain.nested_drivers(flat))


# ---- sources and sinks ---------------------------------------------------------------

@query
def csv_round_trip(w):
    """Raw tables written as CSV with their columns in another order, read back by name, then built into features."""
    tables = readers.activity_tables(readers.load_tables(w.spark, _raw_csv(w)))
    return build_features(tables, w.spec)


def _raw_csv(w):
    folder = scratch_path(w.spark, "raw-csv")
    for name, df in load_driver_tables(w.spark, w.sf_dir, with_session_ids=True).items():
        writers.write_csv(df.select(*reversed(RAW_SCHEMAS[name].names)), f"{folder}/{name}.csv")
    return folder


def _broken_csv(w):
    """The raw tables as CSV lines of which some, by user, run over, break off or hold a word where a number belongs."""
    folder = scratch_path(w.spark, "broken-csv")
    for name, df in load_driver_tables(w.spark, w.sf_dir, with_session_ids=True).items():
        names = RAW_SCHEMAS[name].names
        kind = F.col("user_id") % 7
        cells = [F.col(c).cast("string") for c in names]
        worded = [F.when(kind == 3, F.concat(F.lit("no"), c)).otherwise(c) if n == "user_id" else c for n, c in zip(names, cells)]
        line = F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in worded))
        line = F.when(kind == 1, F.concat(line, F.lit(",more"))).when(kind == 2, F.regexp_replace(line, ",[^,]*$", "")).otherwise(line)
        writers.write_lines(df.select(line.alias("line")), ",".join(names), f"{folder}/{name}.csv")
    return folder


@query
def load_report(w):
    return readers.load_report(w.spark, _raw_csv(w))


@query
def broken_load_report(w):
    return readers.load_report(w.spark, _broken_csv(w))


@query
def quarantine(w):
    """Lines set aside while loading, through the quarantine sink and back: how many per table and reason, beside those taken."""
    tables, rejected = readers.load_checked(w.spark, _broken_csv(w))
    path = scratch_path(w.spark, "quarantine")
    writers.write_json(rejected, path)
    counts = readers.read_quarantine(w.spark, path).groupBy("table_name", "reason").agg(F.count("*").alias("lines"))
    for name, df in tables.items():
        counts = counts.unionByName(df.agg(F.lit(name).alias("table_name"), F.lit("taken").alias("reason"), F.count("*").alias("lines")))
    return counts


@query
def loaded_row_counts(w):
    """Raw tables stored as tables of a database, counted where they are stored."""
    tables = load_driver_tables(w.spark, w.sf_dir, with_session_ids=True)
    w.spark.sql("CREATE DATABASE IF NOT EXISTS holdfast_raw")
    return writers.save_tables(dict(tables.items()), "holdfast_raw", scratch_path(w.spark, "raw-tables"))


@query
def feature_table_round_trip(w):
    """The feature table published under a path in place of an empty version, and read back with its declared schema."""
    path = scratch_path(w.spark, "feature-table")
    w.spark.sql("CREATE DATABASE IF NOT EXISTS holdfast_raw")
    writers.save_table(w.features.limit(0), "holdfast_raw.features", path)
    writers.save_table(w.features, "holdfast_raw.features", path)
    return readers.read_published(w.spark, path, FEATURE_SCHEMA)


@query
def explanation_round_trip(w):
    """Nested explanation records through JSON and back, flattened."""
    path = scratch_path(w.spark, "explanations")
    writers.write_json(w.records, path)
    flat = explain.flat_records(readers.read_explanations(w.spark, path))
    return _round(flat, "driver_1_shap", "driver_2_shap", "driver_3_shap")


@query
def summary_round_trip(w):
    path = scratch_path(w.spark, "summary")
    writers.write_json(impact.summary_document(impact.portfolio_summary(_impact(w))), path)
    return readers.read_summary(w.spark, path).select(
        "portfolio_metrics.*", F.col("scenario_comparison.scenario_b_retention_program.net_uplift_over_baseline").alias("net_uplift")
    )


@query
def action_log_append(w):
    """Two batches appended to one log, one of them twice, read back: entries per status, with totals."""
    path = scratch_path(w.spark, "actions")
    log = retention.action_log(_decisions(w))
    for batch in ("day-1", "day-1", "day-2"):  # the second call repeats the first
        writers.append_action_log(log, path, batch)
    return readers.read_action_log(w.spark, path).groupBy("execution_status").agg(
        F.count("*").alias("entries"), F.count_distinct("user_id").alias("users"),
        F.sum("ltv").alias("ltv"), F.sum("net_roi").alias("net_roi"),
    )


# ---- trained models ----------------------------------------------------

@query
def lr_scores(w):
    return w.lr_scored.select("user_id", "churn_label", "is_test", "margin", "churn_probability")


@query
def gbt_scores(w):
    return w.gbt_scored.select("user_id", "churn_label", "is_test", "margin", "churn_probability")


@query
def trained_comparison(w):
    return metrics.compare_models(_test(w.gbt_scored), _test(w.lr_scored))


@query
def trained_audits(w):
    """Same test users under both models, and classes that follow from probabilities."""
    same = audits.same_users_audit(_test(w.gbt_scored), _test(w.lr_scored)).select(
        F.lit("both").alias("model"), "check", "passed"
    )
    for name, scored in (("boosted trees", w.gbt_scored), ("logistic regression", w.lr_scored)):
        same = same.unionByName(_class_check(scored).select(F.lit(name).alias("model"), "check", "passed"))
    return same


@query
def model_round_trip(w):
    """Both models saved and loaded; rows whose score changed, which must be none."""
    parts = []
    for name, model, data in (
        ("logistic regression", w.lr_model, w.scaled),
        ("boosted trees", w.gbt_model, w.tree_input),
    ):
        path = scratch_path(w.spark, "model")
        models.save_model(model, path)
        before = models.predict(model, data).select("user_id", "churn_probability")
        after = models.predict(models.load_model(path), data).select("user_id", F.col("churn_probability").alias("again"))
        parts.append(before.join(after, "user_id").agg(
            F.lit(name).alias("model"), F.count("*").alias("users"),
            F.count_if(F.col("churn_probability") != F.col("again")).alias("changed"),
        ))
    return parts[0].unionByName(parts[1])


@query
def tree_shap_values(w):
    return _long(w.tree_attributed)


@query
def tree_importance(w):
    return explain.global_importance(_test(w.tree_attributed))


@query
def tree_signed_importance(w):
    return explain.signed_importance(_test(w.tree_attributed))


@query
def tree_additivity(w):
    return explain.additivity(w.tree_attributed, w.leaves.base_value)


@query
def tree_base_value(w):
    """Base value of the trees as log-odds and as a probability, next to the mean margin."""
    base = F.lit(w.leaves.base_value)
    return w.gbt_scored.agg(F.avg("margin").alias("mean_margin")).select(
        base.alias("base_value"), models.sigmoid(base).alias("base_probability"), "mean_margin"
    )


@query
def tree_explanations(w):
    explained = explain.with_top_drivers(_test(w.tree_attributed))
    return explain.flat_records(explain.local_records(explained, w.leaves.base_value))


@query
def trained_portfolio(w):
    """Program summary under the trained boosted trees, test users only, as in the stored explanations."""
    explained = explain.with_top_drivers(_test(w.tree_attributed))
    flat = explain.flat_records(explain.local_records(explained, w.leaves.base_value))
    return impact.portfolio_summary(impact.impact_rows(impact.impact_input(w.features, flat)))


@query
def tree_score_audit(w):
    """Margins and base value of the boosted trees against walks through their exported nodes, all users."""
    return tree_nodes.margin_audit(w.gbt_scored, w.nodes).unionByName(
        tree_nodes.base_value_audit(w.leaves.base_value, w.nodes, w.node_paths)
    )


@query
def tree_shap_audit(w):
    """Attributions of the boosted trees against conditional expectations over the subsets of each path, all users."""
    stated = tree_shap.tree_attributions(w.tree_input, w.leaves)
    return tree_nodes.attribution_audit(stated, w.tree_input, w.nodes, w.node_paths)
