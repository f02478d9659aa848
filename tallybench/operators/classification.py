"""Classification metrics.

Every metric that needs only labels starts from the confusion table
``(keys, y_true, y_pred, n)``: one partial aggregation over the predictions, then
arithmetic on at most classes x classes rows per group.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .curves import class_score_counts, roc_auc


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(preds: DataFrame, keys, y_true="y_true", y_pred="y_pred"):
    return preds.groupBy(
        *keys, F.col(y_true).cast("int").alias("y_true"),
        F.col(y_pred).cast("int").alias("y_pred"),
    ).agg(F.count("*").alias("n"))


def confusion_matrix(preds, keys, classes) -> DataFrame:
    """Confusion counts of all class pairs, absent pairs as 0."""
    counts = confusion_counts(preds, keys)
    # At most classes x classes entries per group.
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("y_true", "y_pred"), "n")))
    labels = F.array(*[F.lit(int(c)) for c in classes])
    grid = counts.groupBy(*keys).agg(cells.alias("_cells")).withColumn(
        "y_true", F.explode(labels)).withColumn("y_pred", F.explode(labels))
    n = F.try_element_at("_cells", F.struct("y_true", "y_pred"))
    return grid.select(*keys, "y_true", "y_pred", F.coalesce(n, F.lit(0)).alias("n"))


def confusion_pivot(preds, keys, class_names) -> DataFrame:
    """Confusion matrix with one named column per predicted class."""
    matrix = confusion_matrix(preds, keys, range(len(class_names)))
    names = F.array(*[F.lit(n) for n in class_names])
    named = matrix.withColumn("true_class", F.get(names, F.col("y_true")))
    return named.groupBy(*keys, "true_class").agg(*[
        F.sum(F.when(F.col("y_pred") == i, F.col("n")).otherwise(0)).alias(name)
        for i, name in enumerate(class_names)
    ])


def class_counts(counts: DataFrame, keys) -> DataFrame:
    """Per class: tp, predicted, support and the group's total."""
    roles = F.array(
        F.struct(
            F.col("y_true").alias("class"), F.col("n").alias("support"),
            F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))
            .otherwise(F.lit(0).cast("long")).alias("tp"),
        ),
        F.struct(
            F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("support"),
            F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp"),
        ),
    )
    per_class = (
        counts.select(*keys, F.inline(roles))
        .groupBy(*keys, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"),
             F.sum("support").alias("support"))
    )
    # One row per class and group.
    return per_class.withColumn("total", F.sum("support").over(Window.partitionBy(*keys)))


def mcc(tp, fp, fn, tn) -> Column:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    return ratio(tp * tn - fp * fn,
                 F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))


def per_class_scores(preds, keys) -> DataFrame:
    """Precision, recall, F1, one-vs-rest MCC and support of every class."""
    return _scores_of(class_counts(confusion_counts(preds, keys), keys), keys)


def _scores_of(per_class, keys):
    tp, pred, sup = F.col("tp"), F.col("predicted"), F.col("support")
    return per_class.select(
        *keys, "class",
        ratio(tp, pred).alias("precision"),
        ratio(tp, sup).alias("recall"),
        ratio(2 * tp, pred + sup).alias("f1"),
        mcc(tp, pred - tp, sup - tp, F.col("total") - pred - sup + tp).alias("mcc"),
        "support", "tp", "predicted", "total",
    )


def summary_scores(preds, keys) -> DataFrame:
    """One row per group: accuracy, chance agreement, macro and weighted P/R/F1, MCC."""
    scores = per_class_scores(preds, keys)
    return _summary_of(scores, keys)


def _summary_of(scores, keys):
    s = F.max("total").cast("double")
    c = F.sum("tp").cast("double")
    pt = F.sum(F.col("predicted").cast("double") * F.col("support"))
    pp = F.sum(F.col("predicted").cast("double") * F.col("predicted"))
    tt = F.sum(F.col("support").cast("double") * F.col("support"))

    def weighted(name):
        return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))

    return scores.groupBy(*keys).agg(
        ratio(c, s).alias("accuracy"),
        ratio(pt, s * s).alias("chance_agreement"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
        ratio(c * s - pt, F.sqrt(s * s - pp) * F.sqrt(s * s - tt)).alias("mcc"),
        F.max("total").alias("n"),
    )


def accuracy(preds, keys) -> DataFrame:
    hit = (F.col("y_true") == F.col("y_pred")).cast("int")
    return preds.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def chance_agreement(preds, keys) -> DataFrame:
    """Sum over classes of share(true = c) * share(predicted = c)."""
    return summary_scores(preds, keys).select(*keys, "chance_agreement")


def binary_scores(preds, keys) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 and MCC, in one aggregation."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1

    def count(test):
        return F.sum(F.when(test, 1).otherwise(0))

    cells = preds.groupBy(*keys).agg(
        count(t & p).alias("tp"), count(~t & p).alias("fp"),
        count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        *keys, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), mcc(tp, fp, fn, tn).alias("mcc"),
    )


def binary_bundle(preds, keys) -> DataFrame:
    """Accuracy, ROC AUC, precision, recall, F1, MCC and PR AUC per group."""
    from .curves import curve_areas

    areas = curve_areas(preds, keys)
    labels = binary_scores(preds, keys)
    if keys:
        return labels.join(areas, on=list(keys))
    area = areas.select(F.struct("roc_auc", "pr_auc").alias("area")).scalar()
    return labels.withColumn("area", area).select(
        "*", F.col("area.roc_auc").alias("roc_auc"), F.col("area.pr_auc").alias("pr_auc")
    ).drop("area")


def classification_report(preds, keys, labels=None) -> DataFrame:
    """Rows per class plus 'accuracy', 'macro avg' and 'weighted avg'."""
    scores = per_class_scores(preds, keys)
    summary = _summary_of(scores, keys)
    name = F.col("class").cast("string")
    if labels:
        name = F.get(F.array(*[F.lit(x) for x in labels]), F.col("class"))
    classes = scores.select(
        *keys, name.alias("label"), "precision", "recall", "f1", "support"
    )

    def row(label, precision, recall, f1):
        return F.struct(F.lit(label).alias("label"), F.col(precision).alias("precision"),
                        F.col(recall).alias("recall"), F.col(f1).alias("f1"),
                        F.col("n").alias("support"))

    rows = F.array(
        row("accuracy", "accuracy", "accuracy", "accuracy"),
        row("macro avg", "precision_macro", "recall_macro", "f1_macro"),
        row("weighted avg", "precision_weighted", "recall_weighted", "f1_weighted"),
    )
    return classes.unionByName(summary.select(*keys, F.inline(rows)))


def _class_scores(preds, keys, prob="prob"):
    """Counts by (keys, class, score, y_true): what all one-vs-* AUCs need."""
    exploded = preds.select(
        *keys, F.col("y_true").cast("int").alias("y_true"),
        F.posexplode(prob).alias("class", "score"),
    )
    return exploded.groupBy(*keys, "class", "score", "y_true").agg(
        F.count("*").alias("n")
    )


def ovr_auc_per_class(preds, keys, prob="prob") -> DataFrame:
    """(keys, class, support, roc_auc): each class against the rest."""
    counts = class_score_counts(preds, keys, prob)
    return roc_auc(counts, [*keys, "class"]).select(
        *keys, "class", F.col("positives").alias("support"), "roc_auc", "negatives")


def ovr_auc(preds, keys, prob="prob") -> DataFrame:
    """Macro and prevalence-weighted one-vs-rest ROC AUC."""
    per_class = ovr_auc_per_class(preds, keys, prob)
    return per_class.groupBy(*keys).agg(
        F.avg("roc_auc").alias("roc_auc_ovr_macro"),
        F.try_divide(F.sum(F.col("roc_auc") * F.col("support")), F.sum("support"))
        .alias("roc_auc_ovr_weighted"),
    )


def ovo_auc_weighted(preds, keys, n_classes, prob="prob") -> DataFrame:
    """One-vs-one ROC AUC: pair means weighted by the prevalence of the pair."""
    counts = _class_scores(preds, keys, prob)
    others = F.filter(
        F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda o: o != F.col("class")
    )
    own = F.col("y_true") == F.col("class")
    # A row of the scored class takes part against every other class; a row of
    # another class only in the pair with the scored one.
    versus = F.when(own, others).otherwise(F.array("y_true"))
    binary = (
        counts.withColumn("other", F.explode(versus))
        .groupBy(*keys, "class", "other", "score")
        .agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("pos"),
             F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("neg"))
    )
    sided = roc_auc(binary, list(keys) + ["class", "other"])
    pairs = (
        sided.withColumn("a", F.least("class", "other"))
        .withColumn("b", F.greatest("class", "other"))
        .groupBy(*keys, "a", "b")
        .agg(F.avg("roc_auc").alias("auc"),
             F.max(F.col("positives") + F.col("negatives")).alias("weight"))
    )
    return pairs.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("auc") * F.col("weight")), F.sum("weight"))
        .alias("roc_auc_ovo_weighted")
    )


def model_split_summary(preds, keys, prob="prob") -> DataFrame:
    """Accuracy, weighted one-vs-rest AUC and MCC of every model and split."""
    labels = summary_scores(preds, keys).select(*keys, "accuracy", "mcc")
    areas = ovr_auc(preds, keys, prob).select(*keys, "roc_auc_ovr_weighted")
    return labels.join(areas, on=list(keys))


def mean_losses(rows, keys, **losses) -> DataFrame:
    """Mean of each given loss expression per group."""
    return rows.groupBy(*keys).agg(*[F.avg(e).alias(n) for n, e in losses.items()])


def label_violations(labels: DataFrame, label, n_classes) -> DataFrame:
    """Labels outside 0..C-1 ('unexpected') and labels never seen ('missing')."""
    seen = labels.select(F.col(label).cast("int").alias("label")).distinct()
    wanted = labels.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    extra = seen.join(wanted, "label", "left_anti").withColumn("problem", F.lit("unexpected"))
    absent = wanted.join(seen, "label", "left_anti").withColumn("problem", F.lit("missing"))
    return extra.unionByName(absent)
