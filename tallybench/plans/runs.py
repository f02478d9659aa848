"""A benchmark run written down: split rows in; models, predictions and metric files out.

    <root>/<run id>/models/<name>                 every fitted model
    <root>/<run id>/predictions/model=<name>      its rows of the validation and test split
    <root>/<run id>/metrics/split=<split>         one JSON text {model: {metric: value}} per split
    <root>/<run id>/manifest                      what the run holds, written last

The rows are written once as one table that all fits read; models are fitted side by side,
each fit being distributed itself. Metrics of all models come from the written predictions in
one plan. A run without a manifest did not finish and is never read; a run id is used once.
"""

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.classification import binary_bundle, model_split_summary
from ..operators.regression import regression_scores
from ..session import cut_lineage
from ..sources import metric_files
from . import supervised
from .boosting import Boosted

AT_ONCE = 4  # models fitted side by side

# The names of the metrics in such files.
NAMES = {"accuracy": "Accuracy", "roc_auc": "ROC AUC", "precision": "Precision", "recall": "Recall", "f1": "F1 Score",
         "mcc": "MCC", "pr_auc": "PR AUC", "roc_auc_ovr_weighted": "ROC AUC", "mae": "MAE", "rmse": "RMSE", "r2": "R2"}
KINDS = ("binary", "classes", "values")


def scores(predictions, kind) -> DataFrame:
    """(split, model, metric, value) of written predictions."""
    keys = ["model", "split"]
    wide = (binary_bundle if kind == "binary" else model_split_summary if kind == "classes" else regression_scores)(predictions, keys)
    pairs = [F.struct(F.lit(NAMES[c]).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns if c in NAMES]
    return wide.select("split", "model", F.inline(F.array(*pairs)))


def _fitted(estimator, train, val):
    """The model of an MLlib estimator, or of a function of train and validation rows."""
    return estimator(train, val) if callable(estimator) else supervised.fit(estimator, train, val)


def _predicted(model, rows, kind, row_id):
    if isinstance(model, Boosted):
        return model.predict(rows, row_id, ["split"])
    make = supervised.predict_values if kind == "values" else supervised.predict
    return make(model, rows, row_id, ["split"])


def run(data, estimators, root, run_id, kind="binary", row_id="row_id", at_once=AT_ONCE) -> str:
    """Fit, predict, score and write; returns the folder of the run.

    ``data`` is (row_id, split, features, label); ``estimators`` maps names to MLlib estimators
    or to functions (train, val) -> ``Boosted``.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    spark = data.sparkSession
    folder = f"{root.rstrip('/')}/{run_id}"
    table = cut_lineage(data.select(row_id, "split", "features", "label"))
    parts = {s: table.filter(F.col("split") == s) for s in ("train", "val")}
    held = table.filter(F.col("split").isin("val", "test"))

    def one(name):
        model = _fitted(estimators[name], parts["train"].drop("split"), parts["val"].drop("split"))
        place = f"{folder}/models/{name}"
        model.save(spark, place) if isinstance(model, Boosted) else model.write().save(place)
        _predicted(model, held, kind, row_id).write.parquet(f"{folder}/predictions/model={name}")

    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(one), name) for name in estimators]:
            done.result()
    metrics = scores(spark.read.parquet(f"{folder}/predictions"), kind)
    metric_files.write(metrics, f"{folder}/metrics", key="split")
    text = json.dumps({"run": run_id, "kind": kind, "models": sorted(estimators)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/manifest")
    return folder


def finished(spark: SparkSession, folder) -> dict:
    """The manifest of a run; raises if the run did not finish."""
    from pyspark.errors import AnalysisException

    try:
        return json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    except (AnalysisException, TypeError) as error:
        raise FileNotFoundError(f"no finished run in {folder}") from error


def read_metrics(spark: SparkSession, folder) -> DataFrame:
    """(split, model, metric, value) from the JSON texts of a finished run."""
    finished(spark, folder)
    return metric_files.read(spark, f"{folder}/metrics")


def read_predictions(spark: SparkSession, folder) -> DataFrame:
    finished(spark, folder)
    return spark.read.parquet(f"{folder}/predictions")
