import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from holdfast.operators import prep
from holdfast.schemas import FEATURES, NUMERIC_FEATURES


@pytest.mark.parametrize("n,churned", [(3000, 341), (97, 13), (10, 2)])
def test_split_sizes_and_members(spark, n, churned):
    rows = [(i, int(i < churned)) for i in range(n)]
    split = prep.stratified_split(spark.createDataFrame(rows, "user_id bigint, churn_label int"))
    got = {r["user_id"] for r in split.filter("is_test").collect()}
    want = set()
    for label in (0, 1):
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, l in rows if l == label)
        want |= {i for _, i in ids[:math.floor(0.2 * len(ids) + 0.5)]}
    assert got == want
    assert split.count() == n


def test_split_sizes_of_the_published_run(spark):
    rows = [(i, int(i < 341)) for i in range(3000)]
    split = prep.stratified_split(spark.createDataFrame(rows, "user_id bigint, churn_label int"))
    assert {r["is_test"]: r["count"] for r in split.groupBy("is_test").count().collect()} == {True: 600, False: 2400}


def test_split_depends_on_the_seed_only(spark):
    df = spark.range(500).select(F.col("id").alias("user_id"), (F.col("id") % 3 == 0).cast("int").alias("churn_label"))
    a, b, c = (
        {r[0] for r in prep.stratified_split(x, seed=s).filter("is_test").select("user_id").collect()}
        for x, s in ((df, 1), (df.repartition(7), 1), (df, 2))
    )
    assert a == b != c


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 0), (7, 1), (500, 2), (501, 3), (6000, 4)])
def test_medians_equal_brute_force(spark, n, seed):
    rng = random.Random(seed)
    # one value holds a third of the rows; the other column has outliers and NULLs
    rows = [(
        float(rng.choice([0, rng.randrange(50)]) if rng.random() < 0.5 else 5),
        None if rng.random() < 0.3 else rng.lognormvariate(0, 6),
    ) for _ in range(n)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["feature"]: (r["non_null"], r["median"]) for r in prep.medians(df, ("a", "b")).collect()}
    for name, values in (("a", [r[0] for r in rows]), ("b", [r[1] for r in rows if r[1] is not None])):
        if values:
            assert got[name] == (len(values), statistics.median(values))
        else:
            assert got[name] == (0, None)


def test_median_survives_a_poor_sketch(spark):
    rng = random.Random(9)
    values = [rng.random() for _ in range(4001)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    for accuracy, brackets in ((2, prep.BRACKETS), (5, (0.0, 0.5)), (50, (0.0, 0.001, 0.5))):
        assert prep.medians(df, ("a",), accuracy, brackets).first()["median"] == statistics.median(values)


def feature_frame(spark):
    rows = []
    for i in range(40):
        values = {c: float(i % 7 + k) for k, c in enumerate(NUMERIC_FEATURES)}
        values["monthly_fee"] = 29.0
        values["avg_session_gap_days"] = None if i % 4 == 0 else float(i)
        rows.append((i, ("Basic", "Pro")[i % 2], *values.values()))
    names = "user_id bigint, plan_tier string, " + ", ".join(f"{c} double" for c in NUMERIC_FEATURES)
    return prep.one_hot(spark.createDataFrame(rows, names))


def test_preprocessor_learns_from_training_rows(spark):
    df = feature_frame(spark)
    train = df.filter("user_id < 20")
    fitted = prep.fit_preprocessor(train)
    gaps = [float(i) for i in range(20) if i % 4]
    assert fitted.medians["avg_session_gap_days"] == statistics.median(gaps)
    filled = [float(i) if i % 4 else statistics.median(gaps) for i in range(20)]
    assert fitted.means["avg_session_gap_days"] == pytest.approx(statistics.mean(filled))
    assert fitted.deviations["avg_session_gap_days"] == pytest.approx(statistics.pstdev(filled))


def test_scaling(spark):
    df = feature_frame(spark)
    fitted = prep.fit_preprocessor(df)
    scaled = fitted.transform(df)
    stats = {r["feature"]: r for r in prep.scale_statistics(scaled, [f"scaled_{f}" for f in FEATURES]).collect()}
    for f in FEATURES:
        row = stats[f"scaled_{f}"]
        assert row["mean"] == pytest.approx(0, abs=1e-12)
        constant = f in ("monthly_fee", "plan_tier_Enterprise")
        assert row["deviation"] == pytest.approx(0 if constant else 1, abs=1e-12)


def test_one_hot_keeps_all_levels(spark):
    df = spark.createDataFrame([("Basic",), ("Pro",), ("Enterprise",)], "plan_tier string")
    got = [tuple(r)[1:] for r in prep.one_hot(df).collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
