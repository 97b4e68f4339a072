from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast.operators import models, tree_shap
from holdfast.operators.explain import PHI, additivity

NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(300, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] * x[:, 2] > 6) | (rng.random(300) < 0.1)).astype(int)
    rows = [(i, int(label), *map(float, r)) for i, (r, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "user_id bigint, churn_label int, a double, b double, c double")


@pytest.fixture(scope="module")
def model(data):
    stages = [VectorAssembler(inputCols=list(NAMES), outputCol="features"),
              GBTClassifier(labelCol="churn_label", maxIter=6, maxDepth=4, seed=1)]
    return Pipeline(stages=stages).fit(data)


@pytest.fixture(scope="module")
def table(spark, model):
    return tree_shap.read_leaves(spark, model)


@pytest.fixture(scope="module")
def attributed(data, model, table):
    return tree_shap.tree_attributions(models.predict(model, data), table, NAMES)


def test_additivity(attributed, table):
    row = additivity(attributed, table.base_value, NAMES, tolerance=1e-9).first()
    assert (row["passed"], row["rows_checked"]) == (True, 300)


def test_margin_matches_the_probability(attributed):
    off = attributed.filter(F.abs(1 / (1 + F.exp(-F.col("margin"))) - F.col("churn_probability")) > 1e-12)
    assert off.count() == 0


def conditional_margin(table, x, known):
    """Expected margin with only some features known, straight from the leaves."""
    total = 0.0
    for leaf, _ in table.leaves:
        weight = leaf.value
        for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.shares):
            weight *= float(low < x[f] <= high) if f in known else share
        total += weight
    return total


def test_equals_brute_force_shapley(attributed, table):
    d = len(NAMES)
    for row in attributed.orderBy("user_id").collect()[::17]:
        x = [row[c] for c in NAMES]
        for i, name in enumerate(NAMES):
            others = [j for j in range(d) if j != i]
            want = sum(
                factorial(k) * factorial(d - k - 1) / factorial(d)
                * (conditional_margin(table, x, {*s, i}) - conditional_margin(table, x, set(s)))
                for k in range(d) for s in combinations(others, k)
            )
            assert row[PHI + name] == pytest.approx(want, abs=1e-10)


def test_deep_paths_are_tabulated_and_bounded():
    rng = np.random.default_rng(4)
    shares = tuple(rng.random(8))
    leaf = tree_shap.Leaf(2.0, tuple(range(8)), (0.0,) * 8, (1.0,) * 8, shares)
    table = tree_shap._pattern_table(leaf)
    for pattern in (0, 5, 170, 255):
        agrees = [float(pattern >> j & 1) for j in range(8)]
        for i in (0, 7):
            others, total = [j for j in range(8) if j != i], 0.0
            for size in range(8):
                for known in combinations(others, size):
                    part = np.prod([agrees[j] if j in known else shares[j] for j in others])
                    total += factorial(size) * factorial(7 - size) / factorial(8) * part
            assert table[pattern, i] == pytest.approx(2.0 * (agrees[i] - shares[i]) * total)
    deep = tree_shap.Leaf(1.0, tuple(range(15)), (0.0,) * 15, (1.0,) * 15, (0.5,) * 15)
    with pytest.raises(ValueError, match="15 features"):
        tree_shap._pattern_table(deep)


def test_expected_margin_is_the_base_value(table):
    constants = sum(leaf.value for leaf, _ in table.leaves if not leaf.features)
    assert conditional_margin(table, None, set()) + constants == pytest.approx(table.base_value)


def test_attributions_do_not_move_rows(attributed):
    plan = attributed._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def test_gap_flag_is_folded(spark):
    df = spark.createDataFrame([(0.5, 0.25)], "phi_avg_session_gap_days double, phi_gap_missing double")
    assert tree_shap.fold_gap_flag(df).collect() == [(0.75,)]


def test_saved_model_scores_alike(spark, data, model, tmp_path):
    models.save_model(model, str(tmp_path / "m"))
    again = models.predict(models.load_model(str(tmp_path / "m")), data).select("user_id", "churn_probability")
    first = models.predict(model, data).select("user_id", "churn_probability")
    assert first.exceptAll(again).count() == 0


def test_logistic_regression_as_columns(spark):
    from holdfast.schemas import FEATURES

    rng = np.random.default_rng(5)
    rows = [(int(v[0] + 0.3 * v[1] + rng.normal() > 0), *map(float, v)) for v in rng.normal(size=(200, len(FEATURES)))]
    df = spark.createDataFrame(rows, "churn_label int, " + ", ".join(f"scaled_{f} double" for f in FEATURES))
    fitted = models.train_lr(df)
    both = models.as_linear(fitted).score(models.predict(fitted, df).withColumnRenamed("churn_probability", "p").drop("margin"))
    assert both.filter(F.abs(F.col("p") - F.col("churn_probability")) > 1e-12).count() == 0
