"""Regression metrics: one aggregation over (keys, y_true, y_pred)."""

from pyspark.sql import DataFrame, functions as F

from ..functions.encode import destandardise


def _error():
    return F.col("y_pred") - F.col("y_true")


def regression_scores(preds: DataFrame, keys) -> DataFrame:
    """mae, mse, rmse, r2 and pearson per group.

    r2 is 1 - SSE/SST; for constant labels 1 if the fit is perfect, else 0.
    pearson is null with fewer than two rows or a constant side.
    """
    n = F.count("*")
    sse = F.sum(_error() * _error())
    sst = F.var_pop("y_true") * n
    r2 = F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(
        F.when(sse == 0, 1.0).otherwise(0.0)
    )
    return preds.groupBy(*keys).agg(
        F.avg(F.abs(_error())).alias("mae"), (sse / n).alias("mse"),
        F.sqrt(sse / n).alias("rmse"), r2.alias("r2"),
        F.try_divide(F.covar_pop("y_true", "y_pred"),
                     F.stddev_pop("y_true") * F.stddev_pop("y_pred")).alias("pearson"),
    )


def model_summary(preds, model="model", split="split", splits=("val", "test")) -> DataFrame:
    """One row per model with r2, mae and mse of each split."""
    scores = regression_scores(preds, [model, split])
    return scores.groupBy(model).agg(*[
        F.max(F.when(F.col(split) == s, F.col(m))).alias(f"{s}_{m}")
        for s in splits for m in ("r2", "mae", "mse")
    ])


def label_stats(labels: DataFrame, keys, label) -> DataFrame:
    """Mean and population standard deviation of the label."""
    return labels.groupBy(*keys).agg(
        F.avg(label).alias("mean"), F.stddev_pop(label).alias("std")
    )


def rescale_predictions(preds, stats, centre=True) -> DataFrame:
    """Undo label standardisation of ``y_pred`` with the stats of the training labels."""
    one = stats.select(F.struct("mean", "std").alias("s")).scalar()
    scaled = preds.withColumn("_s", one)
    mean = F.col("_s.mean") if centre else F.lit(0.0)
    return scaled.withColumn(
        "y_pred", destandardise(F.col("y_pred"), mean, F.col("_s.std"))
    ).drop("_s")


def residuals(preds) -> DataFrame:
    return preds.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def identity_line(preds, keys) -> DataFrame:
    """End points of the identity line of a true-vs-predicted plot."""
    return preds.groupBy(*keys).agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("line_from"),
        F.greatest(F.max("y_true"), F.max("y_pred")).alias("line_to"),
    )
