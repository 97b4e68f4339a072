"""From feature table to model input: encode, split, impute, scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from holdfast.schemas import FEATURES, LABEL, NUMERIC_FEATURES, PLAN_TIERS


def one_hot(df: DataFrame) -> DataFrame:
    """Adds a 0/1 column per plan tier; no level is dropped."""
    return df.select("*", *(
        (F.col("plan_tier") == tier).cast("int").alias(f"plan_tier_{tier}") for tier in PLAN_TIERS
    ))


def stratified_split(df: DataFrame, test_frac: float = 0.20, seed: int = 42, label: str = LABEL,
                     key: str = "user_id") -> DataFrame:
    """Adds `is_test`: per label, the round(test_frac * n) users that come first in hash order.

    Only counts per hash prefix and the one prefix that contains the border are shuffled;
    the rows themselves are compared with a border value per label and never move.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.select(label, key, digest.alias("digest")).withColumn("prefix", F.substring("digest", 1, 3))

    upto = Window.partitionBy(label).orderBy("prefix")
    counts = hashed.groupBy(label, "prefix").agg(F.count("*").alias("n")).select(
        label, "prefix", "n",
        F.sum("n").over(upto).alias("through"),
        F.floor(F.sum("n").over(Window.partitionBy(label)) * F.lit(float(test_frac)) + 0.5).alias("wanted"),
    )
    # at most one row per label
    border = counts.filter(
        (F.col("through") >= F.col("wanted")) & (F.col("through") - F.col("n") < F.col("wanted"))
    ).select(label, "prefix", (F.col("wanted") - F.col("through") + F.col("n")).alias("position"))
    ranked = hashed.join(F.broadcast(border), [label, "prefix"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy(label).orderBy("digest", key))
    )
    last_test = ranked.filter(F.col("rank") == F.col("position")).select(
        label, F.col("digest").alias("last_digest"), F.col(key).alias("last_key")
    )
    in_test = (digest < F.col("last_digest")) | ((digest == F.col("last_digest")) & (F.col(key) <= F.col("last_key")))
    return df.join(F.broadcast(last_test), label, "left").select(
        *df.columns, F.coalesce(in_test, F.lit(False)).alias("is_test")
    )


def prepare(features: DataFrame, test_frac: float = 0.20, seed: int = 42) -> DataFrame:
    """Feature table with one-hot columns and `is_test`; `fit_preprocessor` takes its training rows."""
    return stratified_split(one_hot(features), test_frac, seed)


# shares of the rows a median bracket may reach to either side, narrowest first; the last spans all values
BRACKETS = (0.0004, 0.02, 0.2, 0.5)


def medians(df: DataFrame, columns=NUMERIC_FEATURES, accuracy: int = 10000, brackets=BRACKETS) -> DataFrame:
    """Exact medians (feature, non_null, median), NULLs ignored.

    One pass sketches quantiles, a second counts the rows below and inside nested brackets around
    each median. Only distinct values inside the narrowest bracket that provably holds the median
    are then counted and ranked: for many rows a sliver of them, for few rows perhaps all.
    """
    as_double = {c: F.col(c).cast("double") for c in columns}
    shares = [0.5 - b for b in brackets] + [0.5 + b for b in brackets]
    sketch = df.agg(*(
        F.struct(
            F.count(x).alias("n"), F.percentile_approx(x, F.array(*map(F.lit, shares)), accuracy).alias("edges")
        ).alias(c) for c, x in as_double.items()
    )).first()
    edges = {
        c: list(zip(sketch[c]["edges"][:len(brackets)], sketch[c]["edges"][len(brackets):]))
        for c in columns if sketch[c]["n"]
    }
    nothing = df.sparkSession.createDataFrame(
        [(c, 0, None) for c in columns if c not in edges], "feature string, non_null bigint, median double"
    )
    if not edges:
        return nothing

    counted = df.agg(*(
        F.array(*(
            F.struct(F.count_if(as_double[c] < lo).alias("below"), F.count_if(as_double[c] <= hi).alias("through"))
            for lo, hi in pairs
        )).alias(c) for c, pairs in edges.items()
    )).first()
    candidates = []
    for c, pairs in edges.items():
        n = sketch[c]["n"]
        first, second = (n + 1) // 2, n // 2 + 1  # the middle ranks, equal when n is odd
        (lo, hi), below = next(
            (pair, found["below"]) for pair, found in zip(pairs, counted[c])
            if found["below"] < first and second <= found["through"]
        )
        candidates.append(F.struct(
            F.lit(c).alias("feature"), F.lit(n).cast("bigint").alias("non_null"),
            F.lit(below).cast("bigint").alias("below"), F.lit(first).cast("bigint").alias("first"),
            F.lit(second).cast("bigint").alias("second"),
            F.when(as_double[c].between(lo, hi), as_double[c]).alias("value"),
        ))
    grouped = df.select(F.inline(F.array(*candidates))).filter(F.col("value").isNotNull()).groupBy(
        "feature", "non_null", "below", "first", "second", "value"
    ).agg(F.count("*").alias("n"))
    through = F.col("below") + F.sum("n").over(Window.partitionBy("feature").orderBy("value"))
    ranked = grouped.withColumn("through", through)

    def at_rank(rank: str):
        holds = (F.col("through") >= F.col(rank)) & (F.col("through") - F.col("n") < F.col(rank))
        return F.max(F.when(holds, F.col("value")))

    middle = ranked.groupBy("feature", "non_null").agg(((at_rank("first") + at_rank("second")) / 2).alias("median"))
    return middle.unionByName(nothing) if len(edges) < len(columns) else middle


def fill_with(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """NULLs of the named columns replaced; every named column becomes double."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def scale_statistics(df: DataFrame, columns=FEATURES) -> DataFrame:
    """Mean and population deviation (feature, mean, deviation) from one wide aggregation."""
    stats = df.agg(*(
        F.struct(
            F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_pop(F.col(c).cast("double")).alias("deviation"),
        ).alias(c) for c in columns
    ))
    return stats.select(F.inline(F.array(*(F.col(c) for c in columns))))


@dataclass(frozen=True)
class Preprocessor:
    """Imputation and scaling learnt from training rows; a few dozen numbers."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]

    def impute(self, encoded: DataFrame) -> DataFrame:
        return fill_with(encoded, {c: v for c, v in self.medians.items() if v is not None})

    def transform(self, encoded: DataFrame, prefix: str = "scaled_") -> DataFrame:
        """Adds (x - mean) / deviation per feature, NULLs imputed; the features themselves stay as they are.

        A constant feature is only centred.
        """
        def filled(c):
            x, middle = F.col(c).cast("double"), self.medians.get(c)
            return x if middle is None else F.coalesce(x, F.lit(middle))

        return encoded.select("*", *(
            ((filled(c) - self.means[c]) / (self.deviations[c] or 1.0)).alias(prefix + c) for c in self.means
        ))


def fit_preprocessor(train: DataFrame) -> Preprocessor:
    """Fits on the given (training) rows only."""
    middle = {r["feature"]: r["median"] for r in medians(train).collect()}
    partial = Preprocessor(middle, {}, {})
    rows = scale_statistics(partial.impute(train)).collect()
    return Preprocessor(
        middle, {r["feature"]: r["mean"] for r in rows}, {r["feature"]: r["deviation"] for r in rows}
    )
