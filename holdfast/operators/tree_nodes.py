"""A stored tree model as a table of nodes, and what follows from the nodes by joins alone.

Scores walk every row from the roots to its leaves, one join of (tree, node) per level. Paths climb from each leaf to its root.
Attributions take the definition literally: for every subset of the features on a path, the expectation of the leaf given
those features, where a split on an unknown feature sends a row down either side by its share of the training rows; a
feature's attribution is the weighted mean of what it adds to the subsets without it. Nothing here uses the model's own
prediction or the tables of `tree_shap`, so both can be audited against it.

The node table has as many rows as the model has nodes, so adaptive execution broadcasts it as long as it is small and the walk moves no
rows. An audit costs rows times trees (scores) or rows times leaves (attributions) and 4^features per path: it is
meant for shallow trees, such as depth 4. An empty frame gives an empty result. NULL inputs go right, as comparisons with NULL aren't true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from holdfast.operators.explain import PHI
from holdfast.operators.models import TREE_FEATURES, TREE_LOG_ODDS, load_model, save_model
from holdfast.session import scratch_path

TOLERANCE = 1e-6


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """tree, node, left, right (-1 at leaves), feature, cut, cover and value (log-odds, 0 at splits) of a saved model."""
    stages = load_model(path).stages
    stage = f"{path}/stages/{len(stages) - 1}_{stages[-1].uid}"
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{stage}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
        node["rawCount"].cast("double").alias("cover"), node["prediction"].alias("prediction"),
    )
    value = F.when(F.col("left") < 0, F.col("prediction") * F.col("weight") * TREE_LOG_ODDS).otherwise(0.0)
    return nodes.join(weights, "tree").withColumn("value", value).drop("prediction", "weight")


def exported_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Node table of a trained model, written as Parquet below the shared folder."""
    saved, table = scratch_path(spark, "gbt"), scratch_path(spark, "tree-nodes")
    save_model(model, saved)
    stored_nodes(spark, saved).coalesce(1).write.parquet(table)  # a model's nodes, some thousands
    return spark.read.parquet(table)


def tree_depth(nodes: DataFrame) -> int:
    """Most splits on a path; a job per level over the node table."""
    children = nodes.filter("left >= 0").select("tree", "node", F.explode(F.array("left", "right")).alias("child"))
    level, depth = children.filter("node = 0"), 0
    while not level.isEmpty():
        depth += 1
        level = level.select("tree", F.col("child").alias("node")).join(children, ["tree", "node"])
    return depth


def _tree_ids(nodes: DataFrame) -> Column:
    return F.array(*(F.lit(r["tree"]) for r in nodes.select("tree").distinct().collect()))  # one per tree of the model


def _inputs(df: DataFrame, nodes: DataFrame, features) -> DataFrame:
    """A row per user and tree with all inputs as one array."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    return df.select("user_id", x.alias("x")).withColumn("tree", F.explode(_tree_ids(nodes)))


def margins(df: DataFrame, nodes: DataFrame, features=TREE_FEATURES, depth: int | None = None) -> DataFrame:
    """user_id and margin: the values of the leaves a row arrives at, added up."""
    splits = nodes.filter("left >= 0").select("tree", "node", "left", "right", "feature", "cut")
    at = _inputs(df, nodes, features).withColumn("node", F.lit(0))
    for _ in range(tree_depth(nodes) if depth is None else depth):
        goes_left = F.get("x", F.col("feature")) <= F.col("cut")
        following = F.when(F.col("left").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = at.join(splits, ["tree", "node"], "left").select("user_id", "x", "tree", following.alias("node"))
    leaves = nodes.filter("left < 0").select("tree", "node", "value")
    return at.join(leaves, ["tree", "node"]).groupBy("user_id").agg(F.sum("value").alias("margin"))


def paths(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """tree, leaf, value, feature, low, high, share: per leaf and feature on its path, the interval (low, high] and cover share."""
    end = F.lit(float("inf"))
    splits = nodes.filter("left >= 0").select("tree", F.col("node").alias("parent"), "feature", F.col("cover").alias("above"), F.inline(F.array(
        F.struct(F.col("left").alias("child"), (-end).alias("low"), F.col("cut").alias("high")),
        F.struct(F.col("right").alias("child"), F.col("cut").alias("low"), end.alias("high")),
    )))
    covers = nodes.select("tree", F.col("node").alias("child"), "cover")
    edges = splits.join(covers, ["tree", "child"]).withColumn("share", F.col("cover") / F.col("above")).drop("cover", "above")
    at = nodes.filter("left < 0").select("tree", F.col("node").alias("leaf"), "value", F.col("node").alias("child"))
    steps = []
    for _ in range(tree_depth(nodes) if depth is None else depth):
        step = at.join(edges, ["tree", "child"])
        steps.append(step.select("tree", "leaf", "value", "feature", "low", "high", "share"))
        at = step.select("tree", "leaf", "value", F.col("parent").alias("child"))
    if not steps:
        return at.select("tree", "leaf", "value", F.lit(0).alias("feature"), end.alias("low"), end.alias("high"), end.alias("share")).limit(0)
    return reduce(DataFrame.unionByName, steps).groupBy("tree", "leaf", "value", "feature").agg(
        F.max("low").alias("low"), F.min("high").alias("high"), F.product("share").alias("share")
    )


def base_value(nodes: DataFrame, leaf_paths: DataFrame) -> DataFrame:
    """One row: the margin that is expected with no feature known."""
    reached = leaf_paths.groupBy("tree", "leaf").agg(F.product("share").alias("share"))
    leaves = nodes.filter("left < 0").select("tree", F.col("node").alias("leaf"), "value")
    return leaves.join(reached, ["tree", "leaf"], "left").agg(
        F.coalesce(F.sum(F.col("value") * F.coalesce("share", F.lit(1.0))), F.lit(0.0)).alias("base_value")
    )


def _bit(mask: Column, j: Column) -> Column:
    return F.call_function("shiftright", mask, j).bitwiseAND(F.lit(1))


def _leaf_rows(leaf_paths: DataFrame) -> DataFrame:
    """One row per leaf: value and its path as an array ordered by feature."""
    step = F.struct("feature", "low", "high", "share")
    return leaf_paths.groupBy("tree", "leaf", "value").agg(F.sort_array(F.collect_list(step)).alias("path"))


def pattern_attributions(leaf_paths: DataFrame) -> DataFrame:
    """tree, leaf, pattern, phi: attributions (feature, value) for every way a row can agree with a leaf's path.

    Bit j of a pattern says that the row lies in the interval of the path's j-th feature.
    """
    size = F.size("path")
    power = F.call_function("shiftleft", F.lit(1), size)
    rows = _leaf_rows(leaf_paths).withColumn("pattern", F.explode(F.sequence(F.lit(0), power - 1)))
    rows = rows.withColumn("known", F.explode(F.sequence(F.lit(0), power - 1)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), size - 1))).filter(_bit(F.col("known"), F.col("i")) == 0)

    def expected(known: Column) -> Column:
        def times(product, j):
            share = F.get(F.col("path"), j)["share"]
            return product * F.when(_bit(known, j) == 1, _bit(F.col("pattern"), j).cast("double")).otherwise(share)

        return F.aggregate(F.sequence(F.lit(0), size - 1), F.col("value"), times)

    others = F.bit_count("known")
    weight = F.factorial(others) * F.factorial(size - others - 1) / F.factorial(size)
    added = expected(F.col("known").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("i")))) - expected(F.col("known"))
    by_feature = rows.groupBy("tree", "leaf", "pattern", F.get("path", F.col("i"))["feature"].alias("feature")).agg(F.sum(weight * added).alias("phi"))
    return by_feature.groupBy("tree", "leaf", "pattern").agg(F.collect_list(F.struct("feature", "phi")).alias("phi"))


def _longest_path(leaf_paths: DataFrame) -> int:
    """Most features on a path; one number, 0 without paths."""
    return leaf_paths.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] or 0


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly: a few files of users become very many rows of leaves, which a task per file would make alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def attributions(df: DataFrame, nodes: DataFrame, leaf_paths: DataFrame, features=TREE_FEATURES) -> DataFrame:
    """user_id, feature, shap_value for every row and input feature.

    The model's leaves and patterns are broadcast, rows times trees or features never, whatever is estimated of their sizes.
    """
    arrays = F.struct("leaf", *(F.col(f"path.{c}").alias(c) for c in ("feature", "low", "high")))
    leaves = _leaf_rows(leaf_paths).groupBy("tree").agg(F.collect_list(arrays).alias("leaves"))  # a tree's leaves
    at = _inputs(_spread(df), nodes, features).join(F.broadcast(leaves), "tree").select("user_id", "x", "tree", F.inline("leaves"))

    def agrees(j):  # no bit beyond the end of a path, where all is NULL
        feature, low, high = (F.get(c, F.lit(j)) for c in ("feature", "low", "high"))
        value = F.get("x", feature)
        inside = F.coalesce((value > low) & (value <= high), high == float("inf"))
        return F.when(inside, F.lit(1 << j)).otherwise(F.lit(0))

    pattern = reduce(Column.bitwiseOR, map(agrees, range(_longest_path(leaf_paths))), F.lit(0))
    by_pattern = F.broadcast(pattern_attributions(leaf_paths))
    met = at.select("user_id", "tree", "leaf", pattern.alias("pattern")).join(by_pattern, ["tree", "leaf", "pattern"])
    sums = met.select("user_id", F.inline("phi")).groupBy("user_id", "feature").agg(F.sum("phi").alias("shap_value"))
    every = df.select("user_id", F.inline(F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(f).alias("name")) for k, f in enumerate(features)))))
    return every.join(sums.hint("merge"), ["user_id", "feature"], "left").select(
        "user_id", F.col("name").alias("feature"), F.coalesce("shap_value", F.lit(0.0)).alias("shap_value")
    )


def _far(a: Column, b: Column) -> Column:
    return ~F.coalesce(F.abs(a - b) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))


def _verdict(check: str, rows: DataFrame, wrong: Column) -> DataFrame:
    return rows.agg(
        F.lit(check).alias("check"), (F.count_if(wrong) == 0).alias("passed"), F.count_if(wrong).alias("violations"), F.count("*").alias("rows_checked")
    )


def margin_audit(predicted: DataFrame, nodes: DataFrame, features=TREE_FEATURES) -> DataFrame:
    """The model's own margins against the walk through its nodes; `predicted` holds user_id, margin and the inputs."""
    walked = margins(predicted, nodes, features).withColumnRenamed("margin", "walked")
    both = predicted.select("user_id", "margin").join(walked, "user_id", "full")
    return _verdict("margin", both, _far(F.col("margin"), F.col("walked")))


def base_value_audit(stated: float, nodes: DataFrame, leaf_paths: DataFrame) -> DataFrame:
    return _verdict("base value", base_value(nodes, leaf_paths), _far(F.lit(stated), F.col("base_value")))


def attribution_audit(attributed: DataFrame, df: DataFrame, nodes: DataFrame, leaf_paths: DataFrame, features=TREE_FEATURES) -> DataFrame:
    """Per feature: attributions as stated (phi columns, from `tree_shap`) against those derived from the nodes."""
    stated = attributed.select("user_id", F.inline(F.array(*(
        F.struct(F.lit(f).alias("feature"), F.col(PHI + f).alias("stated")) for f in features
    ))))
    both = stated.join(attributions(df, nodes, leaf_paths, features), ["user_id", "feature"], "full")
    wrong = _far(F.col("stated"), F.col("shap_value"))
    return both.groupBy("feature").agg(F.count_if(wrong).alias("violations"), F.count("*").alias("rows_checked")).select(
        F.concat(F.lit("attribution of "), "feature").alias("check"), (F.col("violations") == 0).alias("passed"), "violations", "rows_checked"
    )
