"""Fit, predict and score: MLlib estimators over (row_id, features, label) tables."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, OneVsRest,
                                       OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..functions.logits import shares, sigmoid
from ..operators.classification import binary_bundle, model_split_summary
from ..operators.regression import regression_scores

# Boosting parameters of the benchmark.
BOOSTING = {"maxIter": 5000, "stepSize": 0.01, "maxDepth": 6, "seed": 4221}
VALIDATION = "is_validation"
AT_ONCE = 4  # models of one class against the rest that are fitted at a time


def vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector("features")).withColumn(
        "label", F.col("label").cast("double"))


def _named(estimator):
    return estimator.setFeaturesCol("vector").setLabelCol("label")


def boosted_classifier(**params):
    """Binary gradient-boosted trees."""
    return _named(GBTClassifier(**{**BOOSTING, **params}))


def boosted_regressor(**params):
    return _named(GBTRegressor(**{**BOOSTING, **params}))


def boosted_multiclass(**params):
    """One boosted model per class against the rest."""
    return _named(OneVsRest(classifier=boosted_classifier(**params)))


def forest_classifier(**params):
    return _named(RandomForestClassifier(**params))


def forest_regressor(**params):
    return _named(RandomForestRegressor(**params))


def perceptron(width, n_classes, hidden=(64,), **params):
    return _named(MultilayerPerceptronClassifier(layers=[width, *hidden, n_classes], **params))


def logistic(**params):
    return _named(LogisticRegression(**params))


def fit(estimator, train, val=None):
    """Fit on vectors; boosting watches the validation rows and stops early."""
    data = vectors(train)
    if val is None:
        return estimator.fit(data)
    watched = data.withColumn(VALIDATION, F.lit(False)).unionByName(
        vectors(val).withColumn(VALIDATION, F.lit(True)))
    if isinstance(estimator, OneVsRest):
        return _one_against_rest(estimator, watched)
    if not estimator.hasParam("validationIndicatorCol"):
        return estimator.fit(data)
    return estimator.copy().setParams(validationIndicatorCol=VALIDATION).fit(watched)


def _one_against_rest(estimator, watched):
    """One model per class, each with the validation rows (which the estimator would drop)."""
    inner = estimator.getClassifier()
    if not inner.hasParam("validationIndicatorCol"):
        return estimator.fit(watched.filter(~F.col(VALIDATION)))
    inner = inner.copy().setParams(validationIndicatorCol=VALIDATION)
    classes = int(watched.agg(F.max("label")).first()[0]) + 1
    watched = watched.persist()
    try:
        one = inheritable_thread_target(watched.sparkSession)(
            lambda c: inner.copy().fit(watched.withColumn("label", (F.col("label") == c).cast("double"))))
        with ThreadPool(max(1, min(classes, AT_ONCE))) as pool:
            models = pool.map(one, range(classes), chunksize=1)
    finally:
        watched.unpersist()
    return OneVsRestModel(models=models).setFeaturesCol("vector")


def _probability(scored):
    if "probability" in scored.columns:
        return vector_to_array("probability")
    # One-vs-rest models give margins only: a logistic of twice the margin per
    # class, normalised to sum to one.
    return shares(F.transform(vector_to_array("rawPrediction"), lambda m: sigmoid(m * 2)))


def predict(model, df, row_id="row_id", keep=()) -> DataFrame:
    """(row_id, *keep, y_true, y_pred, prob, score) of a classifier."""
    scored = model.transform(vectors(df))
    prob = scored.withColumn("prob", _probability(scored))
    return prob.select(
        row_id, *keep, F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"), "prob",
        F.get("prob", F.lit(1)).alias("score"))


def predict_values(model, df, row_id="row_id", keep=()) -> DataFrame:
    """(row_id, *keep, y_true, y_pred) of a regressor."""
    return model.transform(vectors(df)).select(
        row_id, *keep, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def run_benchmark(estimators, data, row_id="row_id", regression=False) -> DataFrame:
    """Predictions of every estimator on the val and test rows.

    ``data`` has a ``split`` column. Models are fitted one after another (each fit
    is a distributed job); all predictions form one table, scored in one plan.
    """
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    held = data.filter(F.col("split").isin("val", "test"))
    out = None
    for name, estimator in estimators.items():
        model = fit(estimator, train, val)
        make = predict_values if regression else predict
        rows = make(model, held, row_id, ["split"]).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def classification_summary(estimators, data, row_id="row_id") -> DataFrame:
    return model_split_summary(run_benchmark(estimators, data, row_id), ["model", "split"])


def regression_summary(estimators, data, row_id="row_id") -> DataFrame:
    preds = run_benchmark(estimators, data, row_id, regression=True)
    return regression_scores(preds, ["model", "split"])


def compare_augmentation(estimator, data, synthetic, row_id="row_id") -> DataFrame:
    """Binary score bundle on val and test, trained with and without synthetic rows."""
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    held = data.filter(F.col("split").isin("val", "test"))
    cols = [row_id, "features", "label"]
    tables = {"original": train.select(*cols),
              "augmented": train.select(*cols).unionByName(synthetic.select(*cols))}
    out = None
    for tag, table in tables.items():
        model = fit(estimator, table, val.select(*cols))
        rows = predict(model, held, row_id, ["split"]).withColumn("training", F.lit(tag))
        out = rows if out is None else out.unionByName(rows)
    return binary_bundle(out, ["training", "split"])
