"""holdfast: customer-churn features, scoring, explanation and retention policy on Spark.

Every public function takes and returns DataFrames or Columns; nothing is pulled to
the driver except model-sized state (a handful of medians, coefficients or tree nodes).
"""
