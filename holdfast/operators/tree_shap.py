"""Exact attributions of a boosted-tree model over the tree paths.

A tree is a sum over leaves. On a leaf's path only a few distinct features occur (at most the
depth), and a row agrees or disagrees with each of them, so the leaf's contribution to every
attribution depends on nothing but that agreement pattern. All patterns are tabulated once per
model; scoring a batch is then interval tests and table lookups.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from holdfast.operators.explain import PHI
from holdfast.operators.models import (
    GAP, GAP_MISSING, TREE_FEATURES, TREE_LOG_ODDS, load_model, predict, restore_gap, save_model,
)
from holdfast.session import scratch_path, ship_package


MOST_PATH_FEATURES = 14


@dataclass(frozen=True)
class Leaf:
    """Path of one leaf: per distinct feature the admitted interval (low, high] and cover share."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    shares: tuple[float, ...]


@dataclass(frozen=True)
class LeafTable:
    """Leaves with, per agreement pattern, the attribution of each path feature."""

    leaves: tuple[tuple[Leaf, np.ndarray], ...]
    base_value: float


def _pattern_table(leaf: Leaf) -> np.ndarray:
    """Attribution per (agreement pattern, path feature): the Shapley value of the product game."""
    d = len(leaf.features)
    if d > MOST_PATH_FEATURES:
        raise ValueError(f"a path with {d} features needs 2^{d} patterns; at most {MOST_PATH_FEATURES} features are tabulated")
    agrees = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    # by_size[p, i, s]: sum over the sets of s known features among the others of their product with the shares of the rest
    by_size = np.zeros((1 << d, d, d))
    by_size[:, :, 0] = 1
    for j in range(d):
        known = np.zeros_like(by_size)
        known[:, :, 1:] = by_size[:, :, :-1] * agrees[:, j, None, None]
        grown = by_size * leaf.shares[j] + known
        grown[:, j] = by_size[:, j]
        by_size = grown
    weights = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
    return leaf.value * (agrees - np.array(leaf.shares)) * (by_size @ weights)


def leaf_table(leaves: list[Leaf]) -> LeafTable:
    base = sum(leaf.value * float(np.prod(leaf.shares)) for leaf in leaves)
    return LeafTable(tuple((leaf, _pattern_table(leaf)) for leaf in leaves if leaf.features), base)


def _tree_leaves(nodes: dict, weight: float) -> list[Leaf]:
    """Leaves of one tree; repeated splits on a feature narrow one interval."""
    found, pending = [], [(0, {})]
    while pending:
        node_id, path = pending.pop()
        node = nodes[node_id]
        if node["left"] < 0:
            order = sorted(path)
            found.append(Leaf(
                TREE_LOG_ODDS * weight * node["prediction"], tuple(order),
                *(tuple(path[f][k] for f in order) for k in range(3)),
            ))
            continue
        feature, cut = node["feature"], node["cut"]
        low, high, share = path.get(feature, (float("-inf"), float("inf"), 1.0))
        for child, interval in ((node["left"], (low, min(high, cut))), (node["right"], (max(low, cut), high))):
            part = nodes[child]["cover"] / node["cover"]
            pending.append((child, {**path, feature: (*interval, share * part)}))
    return found


def leaves_of(trees, features=TREE_FEATURES) -> LeafTable:
    """Leaf table of hand-written trees: splits (feature, cut, left, right) over leaves (value, rows)."""
    found = []
    for tree in trees:
        nodes: dict[int, dict] = {}

        def add(node) -> int:
            number = len(nodes)
            nodes[number] = entry = {"prediction": 0.0, "left": -1, "right": -1, "feature": -1, "cut": None}
            if len(node) == 2:
                entry["prediction"], entry["cover"] = node[0] / TREE_LOG_ODDS, node[1]
            else:
                entry["feature"], entry["cut"] = features.index(node[0]), node[1]
                entry["left"], entry["right"] = add(node[2]), add(node[3])
                entry["cover"] = nodes[entry["left"]]["cover"] + nodes[entry["right"]]["cover"]
            return number

        add(tree)
        found += _tree_leaves(nodes, 1.0)
    return leaf_table(found)


def read_leaves(spark: SparkSession, model: PipelineModel) -> LeafTable:
    """Leaf table of a trained tree model, from its saved form; bounded by trees times leaves."""
    path = scratch_path(spark, "gbt")
    save_model(model, path)
    return read_saved_leaves(spark, path)


def read_saved_leaves(spark: SparkSession, path: str) -> LeafTable:
    stages = load_model(path).stages
    stage = f"{path}/stages/{len(stages) - 1}_{stages[-1].uid}"
    weights = {r["_1"]: r["_3"] for r in spark.read.parquet(f"{stage}/treesMetadata").collect()}
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{stage}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("prediction"),
        node["rawCount"].alias("cover"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("cut"),
    ).collect()
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves = [leaf for t, nodes in trees.items() for leaf in _tree_leaves(nodes, weights[t])]
    return leaf_table(leaves)


def attribute(x: np.ndarray, table: LeafTable) -> np.ndarray:
    """Attributions (rows, features) of a batch."""
    phi = np.zeros_like(x)
    for leaf, by_pattern in table.leaves:
        pattern = np.zeros(len(x), dtype=np.intp)
        for j, f in enumerate(leaf.features):
            inside = (x[:, f] > leaf.low[j]) & (x[:, f] <= leaf.high[j])
            pattern |= inside.astype(np.intp) << j
        phi[:, list(leaf.features)] += by_pattern[pattern]
    return phi


def tree_attributions(df: DataFrame, table: LeafTable, features=TREE_FEATURES) -> DataFrame:
    """Adds phi_<feature> (log-odds) to every row; narrow, and only the features visit Python."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(table)
    names = [PHI + f for f in features]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def explain(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(attribute(batch.to_numpy(dtype=float), shared.value), columns=names)

    inputs = F.struct(*(F.col(f).cast("double").alias(f) for f in features))
    return df.withColumn("attributions", explain(inputs)).select(*df.columns, "attributions.*")


def fold_gap_flag(attributed: DataFrame) -> DataFrame:
    """Counts the missing-gap flag towards the gap feature itself; the sum stays the same."""
    return attributed.withColumn(PHI + GAP, F.col(PHI + GAP) + F.col(PHI + GAP_MISSING)).drop(PHI + GAP_MISSING)


def explain(df: DataFrame, model: PipelineModel, table: LeafTable | None = None) -> DataFrame:
    """Scores and attributes users (from `models.tree_input`), one phi column per feature, gap flag folded in."""
    table = table or read_leaves(df.sparkSession, model)
    return restore_gap(fold_gap_flag(tree_attributions(predict(model, df), table)))
