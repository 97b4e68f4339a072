"""Classification quality from scored rows (label, prediction, probability)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from holdfast.functions.numbers import ratio
from holdfast.schemas import LABEL

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def classify(scored: DataFrame, threshold: float = 0.5, probability: str = "churn_probability") -> DataFrame:
    return scored.withColumn("predicted_class", (F.col(probability) >= threshold).cast("int"))


def confusion_matrix(classified: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    actual, predicted = F.col(label) == 1, F.col("predicted_class") == 1
    return classified.agg(
        F.count_if(~actual & ~predicted).alias("tn"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"), F.count_if(actual & predicted).alias("tp"),
    )


def classification_metrics(confusion: DataFrame, *keep: str) -> DataFrame:
    """One row: accuracy, precision, recall, f1 and the columns to keep; an undefined ratio is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    return confusion.select(
        *keep,
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


RANGES = 64


def score_table(frames: dict[str, DataFrame], probability: str = "churn_probability", label: str = LABEL) -> DataFrame:
    """model, score, pos, neg and rest (any label but 1): all scored frames collapsed to their distinct scores.

    A score that many rows share weighs as one row from here on. Every model has a row, also one without rows.
    """
    parts = [df.select(F.lit(m).alias("model"), F.col(probability).cast("double").alias("score"), F.col(label).alias("label")) for m, df in frames.items()]
    spark = parts[0].sparkSession
    parts += [spark.range(1).select(F.lit(m).alias("model"), F.lit(None).cast("double").alias("score"), F.lit(None).alias("label")) for m in frames]
    return reduce(DataFrame.unionByName, parts).groupBy("model", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") != 1).alias("rest")
    )


def measured(frames: dict[str, DataFrame], threshold: float = 0.5, probability: str = "churn_probability", label: str = LABEL,
             ranges: int = RANGES) -> DataFrame:
    """One row per model: tn, fp, fn, tp at the threshold and the exact roc_auc, all from one table of scores.

    Negatives below a score are a prefix sum in two levels: inside a range of scores, and over the ranges. The ranges'
    borders are quantiles of the collapsed scores, so no range holds much more than its share of them; where they lie does not
    change the result. Nothing runs until the result is asked for, and each frame is read once: borders and sums
    share the exchange of the collapsed table.

    Rows whose score is NULL or NaN say nothing about the order and are left out of the area, which is NULL if a class is absent.
    """
    scores = score_table(frames, probability, label)
    ordered = F.col("score").isNotNull() & ~F.isnan("score")
    counted = F.col("pos") + F.col("neg") + F.col("rest")  # named, so that both uses of the table are the same subplan
    cuts = [k / ranges for k in range(1, ranges)]
    borders = scores.groupBy("model").agg(F.percentile_approx(F.when(ordered & (counted >= 0), F.col("score")), cuts, 50 * ranges).alias("borders"))
    place = F.coalesce(F.size(F.filter("borders", lambda b: b < F.col("score"))), F.lit(0))
    ranged = scores.join(borders, "model").withColumn("range", F.when(ordered, place).otherwise(-1))
    inside = Window.partitionBy("model", "range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    # wins of positives against negatives of the same range, with ties as a half
    won = F.when(ordered, F.col("pos").cast("double") * (F.col("below") + F.col("neg") / 2)).otherwise(0.0)
    risky = F.col("score") >= threshold

    def total(amount, condition):
        return F.sum(F.when(condition, F.col(amount)).otherwise(F.lit(0)))

    per_range = ranged.withColumn("below", below).groupBy("model", "range").agg(
        F.sum(won).alias("won"), total("pos", ordered).alias("pos"), total("neg", ordered).alias("neg"),
        total("rest", ~risky).alias("tn"), total("rest", risky).alias("fp"), total("pos", ~risky).alias("fn"), total("pos", risky).alias("tp"),
    )
    lower = Window.partitionBy("model").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    summed = per_range.withColumn("lower_neg", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    area = F.sum(F.col("won") + F.col("pos").cast("double") * F.col("lower_neg")) / (pos * neg)
    return summed.groupBy("model").agg(
        *(F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")), F.when((pos > 0) & (neg > 0), area).alias("roc_auc")
    )


def roc_auc(scored: DataFrame, probability: str = "churn_probability", label: str = LABEL) -> DataFrame:
    """Exact area under the ROC curve, tied scores counted half; see `measured`."""
    return measured({"it": scored}, probability=probability, label=label).select("roc_auc")


def evaluate(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: confusion matrix and all five metrics."""
    found = measured({"it": scored}, threshold).withColumn("keep", F.struct("tn", "fp", "fn", "tp", "roc_auc"))
    return classification_metrics(found, "keep").select("keep.tn", "keep.fp", "keep.fn", "keep.tp", *METRICS[:-1], "keep.roc_auc")


def metric_rows(frames: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """All five metrics of every model as (model, metric, value) rows."""
    wide = classification_metrics(measured(frames, threshold), "model", "roc_auc")
    return wide.select("model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))))


def compare_models(challenger: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(metric, baseline, challenger, delta) of two scored frames; a missing baseline counts as 0."""
    frames = {"challenger": challenger} | ({} if baseline is None else {"baseline": baseline})
    side = metric_rows(frames).groupBy("metric").pivot("model", ["baseline", "challenger"]).agg(F.max("value"))
    old = F.coalesce("baseline", F.lit(0.0))
    return side.select("metric", old.alias("baseline"), "challenger", (F.col("challenger") - old).alias("delta"))
