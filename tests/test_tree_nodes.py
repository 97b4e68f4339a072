"""Trained trees checked from outside: over their exported nodes, by joins here and by recursive SQL in another engine."""

from itertools import combinations, takewhile
from math import factorial

import duckdb
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from holdfast.operators import models, tree_nodes, tree_shap
from holdfast.operators.explain import PHI

NAMES = ("a", "b", "c", "d")

WALK = """
WITH RECURSIVE reached AS (
  SELECT user_id, x, n.* FROM rows_in, nodes n WHERE n.node = 0
  UNION ALL
  SELECT user_id, x, n.* FROM reached JOIN nodes n ON n.tree = reached.tree
    AND n.node = CASE WHEN x[reached.feature + 1] <= reached.cut THEN reached."left" ELSE reached."right" END
  WHERE reached."left" >= 0
)
SELECT user_id, sum(value) AS margin FROM reached WHERE "left" < 0 GROUP BY user_id
"""

# Expectation of every leaf for every set of known features, by descending all splits: known ones by value, others by cover.
SHAP = """
WITH RECURSIVE sets AS (
  SELECT range AS known FROM range({subsets})
), reached AS (
  SELECT user_id, x, known, 1.0::DOUBLE AS share, n.* FROM rows_in, sets, nodes n WHERE n.node = 0
  UNION ALL
  SELECT user_id, x, known, share * CASE WHEN (known >> reached.feature) & 1 = 1 THEN 1.0 ELSE n.cover / reached.cover END, n.*
  FROM reached JOIN nodes n ON n.tree = reached.tree AND n.node IN (reached."left", reached."right")
    AND ((known >> reached.feature) & 1 = 0 OR (n.node = reached."left") = (x[reached.feature + 1] <= reached.cut))
  WHERE reached."left" >= 0
), v AS (
  SELECT user_id, known, sum(value * share) AS v FROM reached WHERE "left" < 0 GROUP BY ALL
)
SELECT lo.user_id, f.range AS feature, sum((hi.v - lo.v) * factorial(bit_count(lo.known)) * factorial({d} - bit_count(lo.known) - 1) / factorial({d})) AS phi
FROM v lo, range({d}) f JOIN v hi ON hi.user_id = lo.user_id AND hi.known = lo.known | (1 << f.range)
WHERE (lo.known >> f.range) & 1 = 0 GROUP BY ALL
"""


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, size=(300, 4)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] * x[:, 2] > 6) | (rng.random(300) < 0.1)).astype(int)
    rows = [(i, int(label), *map(float, r)) for i, (r, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "user_id bigint, churn_label int, a double, b double, c double, d double")


@pytest.fixture(scope="module")
def model(data):
    stages = [VectorAssembler(inputCols=list(NAMES), outputCol="features"), GBTClassifier(labelCol="churn_label", maxIter=6, maxDepth=4, seed=1)]
    return Pipeline(stages=stages).fit(data)


@pytest.fixture(scope="module")
def nodes(spark, model):
    return tree_nodes.exported_nodes(spark, model)


@pytest.fixture(scope="module")
def paths(nodes):
    return tree_nodes.paths(nodes)


@pytest.fixture(scope="module")
def predicted(data, model):
    return models.predict(model, data)


@pytest.fixture(scope="module")
def attributed(spark, predicted, model):
    return tree_shap.tree_attributions(predicted, tree_shap.read_leaves(spark, model), NAMES)


def elsewhere(nodes, df, features=NAMES):
    """The exported nodes and the inputs in another engine."""
    con = duckdb.connect()
    node_rows, inputs = nodes.toPandas(), df.select("user_id", F.array(*(F.col(f).cast("double") for f in features)).alias("x")).toPandas()
    con.register("node_frame", node_rows)
    con.register("row_frame", inputs)
    con.execute("CREATE TABLE nodes AS SELECT * FROM node_frame")
    con.execute("CREATE TABLE rows_in AS SELECT user_id, x FROM row_frame")
    return con


def test_margins_equal_recursive_sql(predicted, nodes):
    expected = dict(elsewhere(nodes, predicted).execute(WALK).fetchall())
    walked = {r.user_id: r.margin for r in tree_nodes.margins(predicted, nodes, NAMES).collect()}
    stated = {r.user_id: r.margin for r in predicted.select("user_id", "margin").collect()}
    assert len(walked) == 300 and all(abs(walked[u] - expected[u]) < 1e-9 and abs(stated[u] - expected[u]) < 1e-9 for u in expected)


def test_attributions_equal_recursive_sql(attributed, nodes, paths):
    few = attributed.filter("user_id % 7 = 0")
    expected = {(u, f): v for u, f, v in elsewhere(nodes, few).execute(SHAP.format(subsets=1 << len(NAMES), d=len(NAMES))).fetchall()}
    derived = {(r.user_id, NAMES.index(r.feature)): r.shap_value for r in tree_nodes.attributions(few, nodes, paths, NAMES).collect()}
    stated = {(r.user_id, k): r[PHI + f] for r in few.collect() for k, f in enumerate(NAMES)}
    assert set(expected) == set(derived) == set(stated)
    assert all(abs(derived[k] - v) < 1e-9 and abs(stated[k] - v) < 1e-9 for k, v in expected.items())


def test_registered_model_in_another_engine(spark, sf_dir):
    """Scores of the registered query for all users, and attributions of some, against SQL over the exported nodes."""
    from holdfast.plans.registry import all_queries
    from holdfast.plans.workspace import workspace

    w = workspace(spark, sf_dir)
    con = elsewhere(w.nodes, w.tree_input, models.TREE_FEATURES)
    expected = dict(con.execute(WALK).fetchall())
    scores = {r.user_id: r.margin for r in all_queries()["gbt_scores"](spark, sf_dir).collect()}
    assert set(scores) == set(expected) and all(abs(scores[u] - m) < 1e-6 for u, m in expected.items())
    used = sorted({r["feature"] for r in w.node_paths.select("feature").distinct().collect()})
    con.execute("DELETE FROM rows_in WHERE user_id NOT IN (SELECT user_id FROM rows_in ORDER BY user_id LIMIT 4)")  # 2^features subsets each
    place = {f: k for k, f in enumerate(used)}
    con.execute("UPDATE nodes SET feature = CASE feature " + " ".join(f"WHEN {f} THEN {k}" for f, k in place.items()) + " ELSE feature END")
    con.execute("UPDATE rows_in SET x = [" + ", ".join(f"x[{f + 1}]" for f in used) + "]")
    phi = {(u, models.TREE_FEATURES[used[f]]): v for u, f, v in con.execute(SHAP.format(subsets=1 << len(used), d=len(used))).fetchall()}
    folded = {}
    for (u, f), v in phi.items():
        name = models.GAP if f == models.GAP_MISSING else f
        folded[u, name] = folded.get((u, name), 0.0) + v
    some = {u for u, _ in folded}
    stated = {(r.user_id, r.feature): r.shap_value for r in all_queries()["tree_shap_values"](spark, sf_dir).collect() if r.user_id in some}
    assert len(some) == 4 and all(abs(v - folded.get(k, 0.0)) < 1e-6 for k, v in stated.items()) and set(folded) <= set(stated)


def verdicts(df):
    return {r["check"]: (r.passed, r.violations, r.rows_checked) for r in df.collect()}


def test_audits_pass_and_see_planted_errors(spark, predicted, attributed, data, model, nodes, paths):
    leaves = tree_shap.read_leaves(spark, model)
    assert verdicts(tree_nodes.margin_audit(predicted, nodes, NAMES)) == {"margin": (True, 0, 300)}
    assert verdicts(tree_nodes.base_value_audit(leaves.base_value, nodes, paths)) == {"base value": (True, 0, 1)}
    assert set(verdicts(tree_nodes.attribution_audit(attributed, data, nodes, paths, NAMES)).values()) == {(True, 0, 300)}
    root = (F.col("tree") == 0) & (F.col("node") == 0)
    leaf = nodes.filter("tree = 0 AND left < 0").agg(F.min("node")).first()[0]
    cover = nodes.withColumn("cover", F.when((F.col("tree") == 0) & (F.col("node") == leaf), F.col("cover") * 0.7).otherwise(F.col("cover")))
    wrong = tree_nodes.paths(cover)
    assert not verdicts(tree_nodes.base_value_audit(leaves.base_value, cover, wrong))["base value"][0]
    found = verdicts(tree_nodes.attribution_audit(attributed, data, cover, wrong, NAMES))
    assert any(not passed for passed, _, _ in found.values())
    assert verdicts(tree_nodes.margin_audit(predicted, cover, NAMES))["margin"][0]  # covers don't touch scores
    cut = nodes.withColumn("cut", F.when(root, F.col("cut") + 2).otherwise(F.col("cut")))
    assert verdicts(tree_nodes.margin_audit(predicted, cut, NAMES))["margin"][1] > 0
    lost = predicted.filter("user_id > 4")
    assert verdicts(tree_nodes.margin_audit(lost, nodes, NAMES))["margin"] == (True, 0, 295)


def test_walk_moves_no_rows_and_survives_nothing(spark, predicted, nodes, paths):
    text = tree_nodes.margins(predicted, nodes, NAMES, depth=4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert tree_nodes.margins(predicted.limit(0), nodes, NAMES).count() == 0
    assert tree_nodes.attributions(predicted.limit(0), nodes, paths, NAMES).count() == 0


def broadcast_plans(df):
    """What is broadcast, as the plan lines below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            yield "\n".join(x for _, x in takewhile(lambda y: y[0] > depth[i], zip(depth[i + 1:], lines[i + 1:])))


def test_only_the_model_is_broadcast(spark, data, attributed, nodes, paths, tmp_path):
    """Few rows in files are estimated as small however many rows of trees or features are made of them."""
    few = "user_id % 50 = 0"
    for name, df in (("rows", data.filter(few)), ("stated", attributed.filter(few)), ("paths", paths)):
        df.write.parquet(f"{tmp_path}/{name}")
    rows, stated, stored = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("rows", "stated", "paths"))
    audit = tree_nodes.attribution_audit(stated, rows, nodes, stored, NAMES)
    found = list(broadcast_plans(audit))
    assert found and not any("user_id" in plan for plan in found)
    assert set(verdicts(audit).values()) == {(True, 0, 6)}
    assert not any("user_id" in plan for plan in broadcast_plans(audit))  # nor by the sizes met while running


def test_null_inputs_go_right(spark, nodes, paths):
    """A NULL input takes the right branch both in scores and in attributions, so they still add up."""
    row = spark.createDataFrame([(1, None, 2.0, 5.0, None)], "user_id bigint, a double, b double, c double, d double")
    total = tree_nodes.attributions(row, nodes, paths, NAMES).agg(F.sum("shap_value")).first()[0]
    base = tree_nodes.base_value(nodes, paths).first()[0]
    assert base + total == pytest.approx(tree_nodes.margins(row, nodes, NAMES).first().margin)


def test_shapley_weights_by_hand(spark):
    """One path with two features, x agreeing with one of them."""
    paths = spark.createDataFrame([(0, 1, 2.0, 0, 0.0, 1.0, 0.25), (0, 1, 2.0, 3, 0.0, 1.0, 0.5)],
                                  "tree int, leaf int, value double, feature int, low double, high double, share double")
    rows = {r.pattern: {x.feature: x.phi for x in r.phi} for r in tree_nodes.pattern_attributions(paths).collect()}
    for pattern in range(4):
        agrees, shares = [pattern & 1, pattern >> 1], [0.25, 0.5]
        v = lambda known: 2.0 * np.prod([agrees[j] if j in known else shares[j] for j in range(2)])
        for i, f in enumerate((0, 3)):
            others = [j for j in range(2) if j != i]
            want = sum(factorial(k) * factorial(1 - k) / 2 * (v({*s, i}) - v(set(s))) for k in range(2) for s in combinations(others, k))
            assert rows[pattern][f] == pytest.approx(want)
