import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from holdfast.operators import audits, metrics

SCORED = "user_id bigint, churn_label int, churn_probability double"


def frame(spark, rows):
    return spark.createDataFrame([(i, l, p) for i, (l, p) in enumerate(rows)], SCORED)


def brute_auc(rows):
    pos, neg = [p for l, p in rows if l], [p for l, p in rows if not l]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def random_rows(seed, n=400):
    """A third of the rows share one score, a third sit close to zero, the rest are spread."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.randrange(3)
        p = (0.5, rng.random() * 1e-9, rng.choice([0.0, 1.0, rng.random()]))[kind]
        rows.append((int(rng.random() < 0.3 + 0.4 * p), p))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_auc_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    assert metrics.roc_auc(frame(spark, rows)).first()[0] == pytest.approx(brute_auc(rows), abs=1e-12)


def test_auc_equals_mllib(spark):
    df = frame(spark, random_rows(4))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", labelCol="churn_label", numBins=0)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(evaluator.evaluate(df), abs=1e-9)


def test_auc_of_a_single_class_is_null(spark):
    assert metrics.roc_auc(frame(spark, [(1, 0.2), (1, 0.9)])).first()[0] is None


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, float("nan")), (0, None)]])
def test_auc_without_scores_is_null(spark, rows):
    assert metrics.roc_auc(frame(spark, rows)).first()["roc_auc"] is None


def test_auc_leaves_out_rows_without_a_score(spark):
    rows = [(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.6)]
    assert metrics.roc_auc(frame(spark, rows + [(1, None), (0, float("nan"))])).first()["roc_auc"] == brute_auc(rows)


def test_confusion_and_metrics(spark):
    rows = [(1, 0.9), (1, 0.5), (1, 0.1), (0, 0.7), (0, 0.2), (0, 0.4999)]
    confusion = metrics.confusion_matrix(metrics.classify(frame(spark, rows)))
    assert confusion.first() == (2, 1, 1, 2)
    got = metrics.classification_metrics(confusion).first()
    assert tuple(got) == pytest.approx((4 / 6, 2 / 3, 2 / 3, 2 / 3))


def test_undefined_ratios_are_zero(spark):
    confusion = metrics.confusion_matrix(metrics.classify(frame(spark, [(0, 0.1), (0, 0.2)])))
    assert tuple(metrics.classification_metrics(confusion).first()) == (1.0, 0.0, 0.0, 0.0)


def test_comparison(spark):
    good, poor = [(1, 0.9), (0, 0.1)], [(1, 0.1), (0, 0.9)]
    both = {r["metric"]: r for r in metrics.compare_models(frame(spark, good), frame(spark, poor)).collect()}
    assert set(both) == set(metrics.METRICS)
    assert (both["roc_auc"]["baseline"], both["roc_auc"]["challenger"], both["roc_auc"]["delta"]) == (0, 1, 1)
    alone = {r["metric"]: r for r in metrics.compare_models(frame(spark, good), None).collect()}
    assert alone["accuracy"]["baseline"] == 0 and alone["accuracy"]["delta"] == 1


def test_all_models_from_one_table(spark):
    """Several models at once give what each gives alone, an empty one included, whatever the number of ranges."""
    frames = {"a": frame(spark, random_rows(5)), "b": frame(spark, random_rows(6, 77)), "none": frame(spark, []), "odd": frame(spark, [(1, None), (0, float("nan")), (1, 0.5), (0, 0.5), (None, 0.9)])}
    for ranges in (2, 64):
        rows = {r["model"]: r for r in metrics.measured(frames, 0.5, ranges=ranges).collect()}
        assert set(rows) == set(frames)
        for name, seed, n in (("a", 5, 400), ("b", 6, 77)):
            data, r = random_rows(seed, n), rows[name]
            assert r["roc_auc"] == pytest.approx(brute_auc(data), abs=1e-12)
            assert (r["tn"], r["fp"], r["fn"], r["tp"]) == tuple(
                sum(l == actual and (p >= 0.5) == risky for l, p in data) for actual, risky in ((0, False), (0, True), (1, False), (1, True)))
        assert (rows["none"]["tn"], rows["none"]["tp"], rows["none"]["roc_auc"]) == (0, 0, None)
        assert (rows["odd"]["fp"], rows["odd"]["tp"], rows["odd"]["roc_auc"]) == (2, 1, 0.5)


def test_nothing_runs_while_building_and_frames_are_read_once(spark, tmp_path):
    paths = [str(tmp_path / n) for n in "ab"]
    for k, path in enumerate(paths):
        frame(spark, random_rows(k)).write.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("metrics-build", "building")
    built = metrics.compare_models(*(spark.read.schema(SCORED).parquet(p) for p in paths))
    assert len(tracker.getJobIdsForGroup("metrics-build")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert built.count() == 5
    execution = built._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    final = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2 and "ReusedExchange" in final


def test_threshold_audit(spark):
    good = metrics.classify(frame(spark, [(1, 0.5), (0, 0.49)]))
    assert audits.threshold_audit(good).first()["passed"]
    wrong = audits.threshold_audit(metrics.classify(frame(spark, [(1, 0.5), (0, 0.45)]), 0.4)).first()
    assert (wrong["passed"], wrong["violations"]) == (False, 1)


def test_same_users_audit(spark):
    a, b = frame(spark, [(1, 0.5), (0, 0.4)]), frame(spark, [(1, 0.1)])
    assert audits.same_users_audit(a, a).first()["passed"]
    row = audits.same_users_audit(a, b).first()
    assert (row["passed"], row["only_left"], row["only_right"]) == (False, 1, 0)
