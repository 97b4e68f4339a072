import json
import warnings

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from holdfast.operators import explain, features as feat, impact
from holdfast.schemas import ACTION_LOG_SCHEMA, EXPLANATION_SCHEMA, FEATURE_SCHEMA, RAW_SCHEMAS
from holdfast.session import scratch_path, shared_dir
from holdfast.sources import readers, writers
from tests.activity import SPEC, sample

USERS = "user_id,signup_date,plan_tier,monthly_fee\n1,2025-11-01 10:00:00,Basic,29.00\n"


def test_csv_is_typed(spark, tmp_path):
    (tmp_path / "users.csv").write_text(USERS)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        found = readers.load_tables(spark, str(tmp_path))
    assert list(found) == ["users"] and len(seen) == 4
    assert [f.dataType for f in found["users"].schema] == [f.dataType for f in RAW_SCHEMAS["users"]]
    assert found["users"].first()["monthly_fee"] == 29
    with pytest.raises(ValueError, match="sessions, events, orders, support_tickets"):
        readers.activity_tables(found)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "users.csv").write_text("monthly_fee,extra,plan_tier,user_id,signup_date\n29.00,x,Basic,1,2025-11-01 10:00:00\n")
    row = readers.read_table(spark, "users", f"{tmp_path}/users.csv").first()
    assert (row["user_id"], row["plan_tier"], str(row["monthly_fee"]), row["signup_date"].year) == (1, "Basic", "29.00", 2025)
    (tmp_path / "short.csv").write_text("user_id,plan_tier\n1,Basic\n")
    with pytest.raises(ValueError, match="signup_date, monthly_fee"):
        readers.read_table(spark, "users", f"{tmp_path}/short.csv")


def test_malformed_cells_are_counted(spark, tmp_path):
    for name, df in sample(spark).items():
        writers.write_csv(df, f"{tmp_path}/{name}.csv")
    clean = {r["table_name"]: r for r in readers.load_report(spark, str(tmp_path)).collect()}
    assert len(clean) == 5 and all(r["malformed_cells"] == 0 for r in clean.values())
    bad = sample(spark).users.select("user_id", F.lit("soon").alias("signup_date"), "plan_tier", F.lit("a lot").alias("monthly_fee"))
    writers.write_csv(bad, f"{tmp_path}/users.csv")
    users = [r for r in readers.load_report(spark, str(tmp_path)).collect() if r["table_name"] == "users"][0]
    assert users["malformed_cells"] == 2 * users["rows_read"] == 2 * clean["users"]["rows_read"]


def test_tables_round_trip_through_csv(spark, tmp_path):
    raw = sample(spark)
    for name, df in raw.items():
        writers.write_csv(df, f"{tmp_path}/{name}.csv")
    again = readers.activity_tables(readers.load_tables(spark, str(tmp_path)))
    a, b = feat.build_features(raw, SPEC), feat.build_features(again, SPEC)
    assert sorted(a.collect()) == sorted(b.collect())


def test_tables_can_be_recreated(spark):
    raw = dict(sample(spark).items())
    spark.sql("CREATE DATABASE IF NOT EXISTS churn_test")
    for _ in range(2):
        counts = {r["table_name"]: r["row_count"] for r in writers.save_tables(raw, "churn_test").collect()}
    assert counts == {name: df.count() for name, df in raw.items()}
    assert spark.table("churn_test.sessions").count() == raw["sessions"].count()
    writers.save_table(feat.build_features(sample(spark), SPEC), "churn_test.features")
    assert spark.table("churn_test.features").columns == FEATURE_SCHEMA.names


def test_feature_table_and_missing_file(spark, tmp_path):
    built = feat.build_features(sample(spark), SPEC)
    built.write.parquet(f"{tmp_path}/features")
    assert readers.read_features(spark, f"{tmp_path}/features").exceptAll(built).count() == 0
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_features(spark, f"{tmp_path}/nowhere")
    assert readers.read_optional(spark, readers.read_features, f"{tmp_path}/nowhere") is None


def record(user):
    driver = {"feature": "monthly_fee", "feature_value": 29.0, "shap_value": 0.5, "direction": "UP (+)", "explanation": "x"}
    gap = {**driver, "feature": "avg_session_gap_days", "feature_value": None}
    return {"user_id": user, "actual_churn_label": 1, "predicted_churn_probability": 0.8351, "predicted_class_0_50": 1,
            "base_value_log_odds": -2.05, "top_driver_1": driver, "top_driver_2": gap, "top_driver_3": driver}


def test_explanations_from_one_json_array(spark, tmp_path):
    (tmp_path / "local.json").write_text(json.dumps([record(1), record(3510)], indent=2))
    found = readers.read_explanations(spark, str(tmp_path / "local.json"), multi_line=True).filter("user_id = 3510")
    assert found.schema == EXPLANATION_SCHEMA
    row = explain.flat_records(found).first()
    assert (row["churn_probability"], row["driver_2_feature"]) == (0.8351, "avg_session_gap_days")


def test_explanations_round_trip_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([record(1)], EXPLANATION_SCHEMA)
    writers.write_json(df, f"{tmp_path}/out")
    assert readers.read_explanations(spark, f"{tmp_path}/out").collect() == df.collect()
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '"feature_value":null' in text


def test_summary_document_round_trip(spark, tmp_path):
    scored = spark.createDataFrame(
        [(1, 0.9, "Pro", 99.0, "monthly_fee")],
        "user_id bigint, churn_probability double, plan_tier string, monthly_fee double, driver_1_feature string")
    summary = impact.portfolio_summary(impact.impact_rows(scored))
    writers.write_json(impact.summary_document(summary), f"{tmp_path}/s")
    row = readers.read_summary(spark, f"{tmp_path}/s").first()
    assert row["portfolio_metrics"]["total_net_impact"] == 177.2
    assert row["scenario_comparison"]["scenario_b_retention_program"]["net_uplift_over_baseline"] == 177.2


def test_action_log_grows(spark, tmp_path):
    row = spark.range(2).select(
        F.current_timestamp().alias("timestamp"), F.col("id").alias("user_id"), F.lit(0.83512).alias("churn_probability"),
        F.lit('Call, "urgent"').alias("action_name"), F.lit("ok").alias("reason"), F.lit(15).alias("discount_pct"),
        F.lit(1188).alias("ltv"), F.lit(177.2).alias("net_roi"), F.lit("EXECUTED_SUCCESS").alias("execution_status"))
    log = row.select(*(F.col(f.name).cast(f.dataType) for f in ACTION_LOG_SCHEMA))
    for _ in range(2):
        writers.append_action_log(log, f"{tmp_path}/log")
    back = readers.read_action_log(spark, f"{tmp_path}/log")
    assert back.count() == 4
    assert {str(r["churn_probability"]) for r in back.collect()} == {"0.8351"}
    assert {r["action_name"] for r in back.collect()} == {'Call, "urgent"'}


def broken_users(tmp_path):
    """Nine lines: whole ones, also with a quoted comma and quote and an empty cell, and one of each way to be wrong."""
    lines = ["user_id,signup_date,plan_tier,monthly_fee", "1,2025-11-01 10:00:00,Basic,29.00", '2,2025-11-01 10:00:00,"Pro, or ""so""",99.00',
             "3,2025-11-01 10:00:00,Basic", "4,2025-11-01 10:00:00,Basic,29.00,more", '5,2025-11-01 10:00:00,"a,b,c",1.00,more,"x,y"',
             "six,soon,Basic,29.00", "7,,,", "8", '9,2025-11-01 10:00:00,"a,b",']
    (tmp_path / "users.csv").write_text("\n".join(lines) + "\n")
    return lines[1:]


def test_broken_lines_are_told_apart(spark, tmp_path):
    lines = broken_users(tmp_path)
    rows = readers.checked_csv(spark, f"{tmp_path}/users.csv", RAW_SCHEMAS["users"]).collect()
    reasons = {r["line"]: (r["reason"], r["bad_cells"]) for r in rows if r["reason"]}
    assert reasons == {
        lines[2]: ("too few cells", 0), lines[3]: ("too many cells", 0), lines[4]: ("too many cells", 0),
        lines[5]: ("bad value", 2), lines[7]: ("too few cells", 0)}
    assert sorted(r["user_id"] for r in rows if r["reason"] is None) == ["1", "2", "7", "9"]


def test_quarantine_keeps_every_line(spark, tmp_path):
    for name, df in sample(spark).items():
        writers.write_csv(df, f"{tmp_path}/{name}.csv")
    before = {r["table_name"]: tuple(r)[1:] for r in readers.load_report(spark, str(tmp_path)).collect()}
    assert before["users"] == (7, 0, 0, 0)
    (tmp_path / "other").mkdir()
    for name, df in sample(spark).items():
        if name != "users":
            writers.write_csv(df, f"{tmp_path}/other/{name}.csv")
    lines = broken_users(tmp_path / "other")
    report = {r["table_name"]: tuple(r)[1:] for r in readers.load_report(spark, f"{tmp_path}/other").collect()}
    assert report["users"] == (9, 2, 2, 2) and report["orders"] == before["orders"]
    tables, rejected = readers.load_checked(spark, f"{tmp_path}/other")
    writers.write_json(rejected, f"{tmp_path}/quarantine")
    back = readers.read_quarantine(spark, f"{tmp_path}/quarantine")
    assert {r["line"] for r in back.collect()} == {lines[k] for k in (2, 3, 4, 5, 7)} and {r["table_name"] for r in back.collect()} == {"users"}
    assert tables["users"].schema == RAW_SCHEMAS["users"] and sorted(r["user_id"] for r in tables["users"].collect()) == [1, 2, 7, 9]
    assert readers.activity_tables(tables).orders.count() == 4


FEATURES_OF = "user_id bigint, x double"


def failing(spark, n=50):
    return spark.range(n, numPartitions=5).select(
        F.col("id").alias("user_id"), F.when(F.col("id") == n - 1, F.raise_error(F.lit("write fails")).cast("double")).otherwise(9.0).alias("x"))


def test_readers_keep_the_old_rows_while_an_overwrite_fails(spark, tmp_path):
    folder, schema = f"{tmp_path}/features", spark.createDataFrame([], FEATURES_OF).schema
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], FEATURES_OF)
    writers.publish(old, folder)
    with pytest.raises(Exception, match="write fails"):
        writers.publish(failing(spark), folder)
    assert sorted(readers.read_published(spark, folder, schema).collect()) == [(1, 1.0), (2, 2.0)]
    opened = readers.read_published(spark, folder, schema)
    writers.publish(spark.createDataFrame([(3, 3.0)], FEATURES_OF), folder)
    assert sorted(opened.collect()) == [(1, 1.0), (2, 2.0)]  # opened before, read after
    assert readers.read_published(spark, folder, schema).collect() == [(3, 3.0)]
    writers.publish(old, folder)
    versions = [p.name for p in (tmp_path / "features").glob("version-*")]
    assert len([v for v in versions if (tmp_path / "features" / v / "_SUCCESS").exists()]) == 2  # now and before


def test_a_table_keeps_its_rows_while_an_overwrite_fails(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS churn_test")
    name, path = "churn_test.published", f"{tmp_path}/published"
    writers.save_table(spark.createDataFrame([(1, 1.0)], FEATURES_OF), name, path)
    with pytest.raises(Exception, match="write fails"):
        writers.save_table(failing(spark), name, path)
    assert spark.table(name).collect() == [(1, 1.0)]
    planned = spark.table(name)
    writers.save_table(spark.createDataFrame([(2, 2.0)], FEATURES_OF), name, path)
    assert spark.table(name).collect() == [(2, 2.0)] and planned.count() == 1
    writers.save_table(spark.createDataFrame([(2, "other")], "user_id bigint, y string"), name, path)
    assert spark.table(name).columns == ["user_id", "y"]
    spark.sql(f"DROP TABLE {name}")


def log_rows(spark, n):
    row = spark.range(n).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "user_id" else F.col("id").alias("user_id") for f in ACTION_LOG_SCHEMA))
    return row.withColumn("reason", F.lit("ok"))


def test_a_batch_is_appended_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert readers.read_action_log(spark, path).count() == 0
    assert writers.append_action_log(log_rows(spark, 3), path, "monday")
    assert not writers.append_action_log(log_rows(spark, 3), path, "monday")
    assert writers.append_action_log(log_rows(spark, 2), path, "tuesday")
    assert readers.read_action_log(spark, path).count() == 5
    with pytest.raises(ValueError, match="names a file"):
        writers.append_action_log(log_rows(spark, 1), path, "../up")


def test_an_append_that_failed_is_unseen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    writers.append_action_log(log_rows(spark, 3), path, "monday")
    wrong = log_rows(spark, 4).withColumn("reason", F.when(F.col("user_id") == 3, F.raise_error(F.lit("write fails")).cast("string")).otherwise("ok"))
    with pytest.raises(Exception, match="write fails"):
        writers.append_action_log(wrong, path, "tuesday")
    assert readers.read_action_log(spark, path).count() == 3
    # two writers of one batch: both have written their rows, the first to sign the ledger wins
    known = writers.folders.exists
    monkeypatch.setattr(writers.folders, "exists", lambda spark, p: False if p.endswith("wednesday") else known(spark, p))
    assert writers.append_action_log(log_rows(spark, 4), path, "wednesday")
    assert not writers.append_action_log(log_rows(spark, 4), path, "wednesday")
    monkeypatch.undo()
    assert writers.append_action_log(log_rows(spark, 4), path, "tuesday")
    assert readers.read_action_log(spark, path).count() == 11


def test_materialize_cuts_the_lineage(spark):
    df = writers.materialize(spark.range(10).withColumn("x", F.rand(1)), "numbers")
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "a").startswith(shared_dir(spark) + "/holdfast/")
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
