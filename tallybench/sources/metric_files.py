"""Metric files: {model: {metric: value}} per dataset, and their long form."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Canonical (split, metric) of the metric names found in such files.
CANONICAL = {
    "Test Accuracy": ("test", "accuracy"), "Accuracy": ("test", "accuracy"),
    "Test Precision": ("test", "precision"), "Precision": ("test", "precision"),
    "Test Recall": ("test", "recall"), "Recall": ("test", "recall"),
    "Test F1": ("test", "f1"), "F1": ("test", "f1"),
    "Test AUC": ("test", "roc_auc"), "Test ROC AUC": ("test", "roc_auc"),
    "ROC AUC": ("test", "roc_auc"),
    "Test MCC": ("test", "mcc"), "MCC": ("test", "mcc"),
    "Test R²": ("test", "r2"), "R2": ("test", "r2"),
    "Test MAE": ("test", "mae"), "MAE": ("test", "mae"),
    "Test RMSE": ("test", "rmse"), "RMSE": ("test", "rmse"),
    "Validation Accuracy": ("val", "accuracy"), "Validation MCC": ("val", "mcc"),
    "Validation AUC": ("val", "roc_auc"), "Validation ROC AUC": ("val", "roc_auc"),
    "Silhouette": ("all", "silhouette"), "DCSI": ("all", "dcsi"),
}


def nested(metrics: DataFrame, keys=("dataset",)) -> DataFrame:
    """(keys, json): one {model: {metric: value}} text per key.

    A text holds one entry per model and metric, not per row of data.
    """
    keys = list(keys)
    one = metrics.groupBy(*keys, "model").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    text = F.concat(F.to_json(F.array("model")), F.lit(":"), F.to_json("m"))
    # to_json of a one-element array is ["name"]; the quoted name is its inside.
    entry = F.regexp_replace(text, r'^\[("(?:[^"\\]|\\.)*")\]', "$1")
    return one.groupBy(*keys).agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}"))
        .alias("json"))


def write(metrics: DataFrame, path, key="dataset"):
    """One folder per key, each with one JSON text."""
    nested(metrics, [key]).write.mode("overwrite").partitionBy(key).text(path)


def parse(texts: DataFrame, keys=("dataset",)) -> DataFrame:
    """(keys, model, metric, value) of JSON texts; values that are no number are left out."""
    values = F.from_json("json", "map<string, map<string, string>>")
    models = texts.select(*keys, F.explode(values).alias("model", "metrics"))
    rows = models.select(*keys, "model", F.explode("metrics").alias("metric", "text"))
    number = F.expr("try_cast(text AS double)")
    return rows.select(*keys, "model", "metric", number.alias("value")).filter("value IS NOT NULL")


def read(spark: SparkSession, path) -> DataFrame:
    """All metric files below a path; folders named key=value become columns."""
    texts = spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")
    return parse(texts, [c for c in texts.columns if c != "json"])


def canonical(metrics: DataFrame) -> DataFrame:
    """Replace the name by (split, metric); unknown names keep theirs, split 'unknown'."""
    names = F.create_map(*[
        part for name, (split, metric) in CANONICAL.items()
        for part in (F.lit(name), F.struct(F.lit(split).alias("split"), F.lit(metric).alias("metric")))
    ])
    found = F.try_element_at(names, F.col("metric"))
    return metrics.withColumn("_c", found).select(
        *[c for c in metrics.columns if c not in ("metric", "value")],
        F.coalesce("_c.split", F.lit("unknown")).alias("split"),
        F.coalesce("_c.metric", F.col("metric")).alias("metric"), "value")
