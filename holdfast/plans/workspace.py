"""Intermediate results the registered queries share, each built once per session and data folder.

The feature table and the split are written to the shared folder, as a scheduled job would do;
the learnt state is a few dozen numbers or a small model.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.operators import dashboard, explain, models, prep, tree_nodes, tree_shap
from holdfast.operators.features import FeatureSpec
from holdfast.plans.fixed_model import BASELINE, CHALLENGER
from holdfast.schemas import ActivityTables
from holdfast.session import scratch_path
from holdfast.sources.driver_tables import driver_spec, features_from_log, load_driver_tables
from holdfast.sources.writers import materialize

_OPEN: dict[tuple, "Workspace"] = {}


def workspace(spark: SparkSession, sf_dir: str, refresh: bool = False) -> "Workspace":
    """The stored results of this session for a folder; refresh starts anew, as is due when its files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if refresh or key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.spec: FeatureSpec = driver_spec()

    @cached_property
    def tables(self) -> ActivityTables:
        return load_driver_tables(self.spark, self.sf_dir)

    @cached_property
    def stored_tables(self) -> ActivityTables:
        """The raw tables with what had to be derived stored: sessions, and events with their session ids."""
        tagged = load_driver_tables(self.spark, self.sf_dir, with_session_ids=True).events
        return replace(self.tables, sessions=materialize(self.tables.sessions, "sessions"), events=materialize(tagged, "events"))

    @cached_property
    def features(self) -> DataFrame:
        """All activity tables are views of one log here, so one scan of it gives the feature table."""
        return materialize(features_from_log(self.spark, self.sf_dir, self.spec), "features")

    @cached_property
    def encoded(self) -> DataFrame:
        """One-hot features with `is_test`."""
        return materialize(prep.prepare(self.features), "encoded")

    @cached_property
    def train(self) -> DataFrame:
        return self.encoded.filter(~F.col("is_test"))

    @cached_property
    def preprocessor(self) -> prep.Preprocessor:
        return prep.fit_preprocessor(self.train)

    @cached_property
    def scaled(self) -> DataFrame:
        return self.preprocessor.transform(self.encoded)

    @cached_property
    def scored(self) -> DataFrame:
        """All users under the fixed linear model."""
        return CHALLENGER.score(self.scaled)

    @cached_property
    def baseline_scored(self) -> DataFrame:
        return BASELINE.score(self.scaled)

    @cached_property
    def background(self) -> dict[str, float]:
        return explain.background_means(self.scaled)

    @cached_property
    def base_value(self) -> float:
        return explain.linear_base_value(CHALLENGER, self.background)

    @cached_property
    def attributed(self) -> DataFrame:
        return explain.linear_attributions(self.scored, CHALLENGER, self.background)

    @cached_property
    def explained(self) -> DataFrame:
        return explain.with_top_drivers(self.attributed)

    @cached_property
    def ranked(self) -> DataFrame:
        """All users with their drivers, without sentences."""
        return explain.ranked_drivers(self.attributed)

    @cached_property
    def records(self) -> DataFrame:
        """Explanation records of the test users."""
        return explain.local_records(self.explained.filter("is_test"), self.base_value)

    @cached_property
    def stored_records(self) -> DataFrame:
        """The same records flat and stored, as a nightly job leaves them."""
        return materialize(explain.flat_records(self.records), "records")

    @cached_property
    def cards(self) -> DataFrame:
        """What a lookup shows of every user, stored in its layout."""
        return dashboard.write_cards(dashboard.dashboard_frame(self.scored), scratch_path(self.spark, "cards"))

    @cached_property
    def lr_model(self):
        return models.train_lr(self.preprocessor.transform(self.train))

    @cached_property
    def gbt_model(self):
        return models.train_gbt(models.tree_input(self.train, self.preprocessor))

    @cached_property
    def gbt_scored(self) -> DataFrame:
        return models.predict(self.gbt_model, self.tree_input)

    @cached_property
    def tree_input(self) -> DataFrame:
        return models.tree_input(self.encoded, self.preprocessor)

    @cached_property
    def lr_scored(self) -> DataFrame:
        return models.predict(self.lr_model, self.scaled)

    @cached_property
    def leaves(self):
        return tree_shap.read_leaves(self.spark, self.gbt_model)

    @cached_property
    def tree_attributed(self) -> DataFrame:
        return tree_shap.explain(self.tree_input, self.gbt_model, self.leaves)

    @cached_property
    def nodes(self) -> DataFrame:
        """The boosted trees as a table of nodes."""
        return tree_nodes.exported_nodes(self.spark, self.gbt_model)

    @cached_property
    def node_paths(self) -> DataFrame:
        return materialize(tree_nodes.paths(self.nodes), "tree-paths")
