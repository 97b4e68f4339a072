import pytest
from pyspark.sql import functions as F

from holdfast.functions.drivers import driver_text, short_text
from holdfast.operators import dashboard, explain, models
from holdfast.operators.models import LinearModel

WEIGHTS = {"a": 0.5, "b": -1.0, "c": 2.0, "d": 0.25}
NAMES = tuple(WEIGHTS)


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, i % 2, float(i), float(i % 3), float(-i % 4), 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "user_id bigint, churn_label int, a double, b double, c double, d double")
    scaled = df.select("*", *(F.col(c).alias(f"scaled_{c}") for c in NAMES))
    return LinearModel(-1.5, WEIGHTS).score(scaled)


@pytest.fixture(scope="module")
def attributed(scored):
    background = explain.background_means(scored, features=NAMES)
    return explain.linear_attributions(scored, LinearModel(-1.5, WEIGHTS), background)


def test_linear_additivity(scored, attributed):
    base = explain.linear_base_value(LinearModel(-1.5, WEIGHTS), explain.background_means(scored, features=NAMES))
    row = explain.additivity(attributed, base, NAMES).first()
    assert (row["passed"], row["violations"], row["rows_checked"]) == (True, 0, 12)
    assert not explain.additivity(attributed, base + 1, NAMES).first()["passed"]
    assert scored.agg(F.avg("margin")).first()[0] == pytest.approx(base)


def test_importance_and_chart(attributed):
    ranked = explain.global_importance(attributed, NAMES).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4]
    assert ranked[-1]["feature"] == "d" and ranked[-1]["mean_abs_shap"] == 0
    sizes = [r["mean_abs_shap"] for r in ranked]
    assert sizes == sorted(sizes, reverse=True)
    chart = explain.chart_rows(explain.global_importance(attributed, NAMES), 2).collect()
    assert [r["feature"] for r in chart] == [ranked[1]["feature"], ranked[0]["feature"]]


def test_signed_importance_direction(spark):
    df = spark.createDataFrame([(1.0, -1.0), (0.5, -2.0)], "phi_a double, phi_b double")
    means = explain.attribution_means(df, ("a", "b"))
    rows = {r["feature"]: r for r in means.collect()}
    assert (rows["a"]["mean_signed_shap"], rows["b"]["mean_signed_shap"], rows["b"]["mean_abs_shap"]) == (0.75, -1.5, 1.5)


def test_top_drivers_break_ties_by_name(spark):
    row = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0, -0.5, 0.5, 0.5, 0.1)],
                                "user_id bigint, a double, b double, c double, d double, "
                                "phi_a double, phi_b double, phi_c double, phi_d double")
    drivers = explain.with_top_drivers(row, 3, NAMES).first()["drivers"]
    assert [(d["feature"], d["shap_value"], d["direction"]) for d in drivers] == [
        ("a", -0.5, "DOWN (-)"), ("b", 0.5, "UP (+)"), ("c", 0.5, "UP (+)")]


def text(spark, feature, value, phi, make=driver_text):
    return spark.range(1).select(make(F.lit(feature), F.lit(value).cast("double"), F.lit(phi)).alias("t")).first()["t"]


@pytest.mark.parametrize("feature", [
    "sessions_recent_14d", "support_ticket_count", "days_since_last_session", "session_drop_pct",
    "core_feature_usage_count", "unresolved_tickets", "total_events_60d", "avg_session_gap_days",
])
def test_each_named_feature_has_two_sentences(spark, feature):
    up, down = text(spark, feature, 12.0, 0.456), text(spark, feature, 12.0, -0.456)
    assert "12" in up and "UP (+) +0.46" in up
    assert "12" in down and "DOWN (-) -0.46" in down
    assert up.split("[")[0] != down.split("[")[0]


def test_special_sentences(spark):
    assert "UP (+)" in text(spark, "avg_session_gap_days", None, -0.2)
    assert text(spark, "monthly_fee", 29.0, 0.0) == "monthly_fee = 29.00 [risk DOWN (-) +0.00]"
    assert text(spark, "avg_session_gap_days", None, 0.1, short_text).startswith("avg_session_gap_days = unknown")


@pytest.fixture(scope="module")
def records(attributed):
    return explain.local_records(explain.with_top_drivers(attributed, 3, NAMES), 0.123456)


def test_records_flat_and_nested(records):
    first = records.orderBy("user_id").first()
    assert first["base_value_log_odds"] == 0.1235
    flat = explain.flat_records(records)
    assert len(flat.columns) == 13
    assert flat.orderBy("user_id").first()["driver_2_feature"] == first["top_driver_2"]["feature"]
    nested = explain.nested_drivers(flat.withColumn("driver_3_feature", F.lit(None).cast("string")))
    assert len(nested.first()["top_3_shap_drivers"]) == 2


def test_highest_risk_user_prefers_the_lowest_id(spark):
    df = spark.createDataFrame([(3, 0.9), (1, 0.9), (2, 0.1)], "user_id bigint, churn_probability double")
    assert explain.highest_risk_user(df).collect() == [(1, 0.9)]


def test_dashboard_fills_missing_drivers(attributed, records, scored):
    short = explain.with_short_drivers(attributed, 3, NAMES)
    stored = explain.flat_records(records).filter("user_id < 3").withColumn("driver_1_text", F.lit("stored"))
    rows = {r["user_id"]: r for r in dashboard.dashboard_frame(short, stored).collect()}
    assert len(rows) == 12
    assert {u for u, r in rows.items() if r["driver_1_text"] == "stored"} == {0, 1, 2}
    assert all(r["driver_1_feature"] is not None for r in rows.values())
    late = dashboard.dashboard_frame(attributed, stored, missing=explain.short_drivers(3, NAMES))
    assert {r["user_id"]: r["driver_1_text"] for r in late.collect()} == {u: r["driver_1_text"] for u, r in rows.items()}
    everyone = dashboard.dashboard_frame(attributed, missing=explain.short_drivers(3, NAMES))
    assert everyone.filter("driver_1_text IS NULL OR driver_1_text = 'stored'").isEmpty() and everyone.count() == 12
    plain = dashboard.dashboard_frame(scored.select("user_id", "churn_label"))
    assert {(r["churn_probability"], r["driver_1_feature"], r["risk_tier"]) for r in plain.collect()} == {
        (0.0, None, "Low Risk"), (1.0, None, "High Risk")}


def test_lookup_outcomes(spark):
    frame = spark.createDataFrame([(7, "High Risk", "Pro", 0.9)], "user_id bigint, risk_tier string, plan_tier string, churn_probability double")
    asked = spark.createDataFrame([(1, " 7 "), (2, "8"), (3, "seven"), (4, "")], "request_id bigint, user_text string")
    got = {r["request_id"]: (r["outcome"], r["risk_tier"]) for r in dashboard.lookup(frame, asked).collect()}
    assert got == {1: ("found", "High Risk"), 2: ("not_found", None), 3: ("invalid", None), 4: ("invalid", None)}


def test_drivers_are_made_for_missing_users_only(spark, attributed, records):
    """Rows with a stored record never evaluate the fallback: one that fails on them does no harm."""
    stored = explain.flat_records(records).filter("user_id < 3")
    kind = "array<struct<feature: string, shap_value: double, explanation: string>>"
    failing = F.when(F.col("user_id") < 3, F.raise_error(F.lit("made for a stored user")).cast(kind)).otherwise(explain.short_drivers(3, NAMES).cast(kind))
    with pytest.raises(Exception, match="made for a stored user"):
        dashboard.dashboard_frame(attributed, missing=failing).collect()
    frame = dashboard.dashboard_frame(attributed, stored, missing=explain.short_drivers(3, NAMES))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    branch = plan.index("array_sort") if "array_sort" in plan else plan.index("sort_array")
    assert plan.rindex("CASE WHEN", 0, branch) >= 0 and plan.index("LeftOuter") > branch  # above the join, inside a branch


def scanned_rows(df) -> int:
    """Rows that the scan of a finished query handed on: those of the row groups it opened."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.executeCollect()
    while not plan.children().isEmpty():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_lookup_of_an_id_opens_few_row_groups(spark, tmp_path):
    frame = spark.range(0, 200_000, 2).select(
        F.col("id").alias("user_id"), F.concat(F.lit("tier"), F.xxhash64("id").cast("string")).alias("risk_tier"),
        F.lit("Pro").alias("plan_tier"), F.rand(1).alias("churn_probability"))
    cards = dashboard.write_cards(frame, str(tmp_path / "cards"), files=4, row_group_bytes=1 << 18)
    hit, miss = dashboard.find_users(cards, [100_000]), dashboard.find_users(cards, [100_001])
    assert [r["user_id"] for r in hit.collect()] == [100_000] and miss.count() == 0
    assert 0 < scanned_rows(hit) <= 100_000 / 8
    assert scanned_rows(miss) == 0  # inside a row group's range, but not in its Bloom filter


def test_lookup_reads_requests_once_and_spreads_unreadable_ids(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.range(1000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 3 > 0, "word").otherwise(" 7 ").alias("user_text")).write.parquet(path)
    cards = spark.createDataFrame([(7, "High Risk", "Pro", 0.9)], "user_id bigint, risk_tier string, plan_tier string, churn_probability double")
    found = dashboard.lookup(cards, spark.read.schema("request_id bigint, user_text string").parquet(path))
    assert {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()} == {"found": 334, "invalid": 666}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = dashboard.lookup(cards, spark.read.schema("request_id bigint, user_text string").parquet(path))
        keys = again._jdf.queryExecution().executedPlan().toString()
        assert "spread" in keys.split("Exchange hashpartitioning(")[1].split(")")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_risk_payload(spark, records, scored):
    import json

    frame = explain.nested_drivers(explain.flat_records(records)).withColumns(
        {"risk_tier": F.lit("High Risk"), "plan_tier": F.lit("Pro"), "monthly_fee": F.lit(99)})
    payload = json.loads(dashboard.risk_payload(frame).orderBy("user_id").first()["payload"])
    assert list(payload) == ["user_id", "churn_probability", "risk_tier", "plan_tier", "monthly_fee", "top_3_shap_drivers"]
    assert list(payload["top_3_shap_drivers"][0]) == ["feature", "shap_value", "text"]


def test_sigmoid(spark):
    assert spark.range(1).select(models.sigmoid(F.lit(-2.0542))).first()[0] == pytest.approx(0.1136, abs=1e-4)
