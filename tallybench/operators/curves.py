"""ROC and precision-recall curves, and the areas under them.

Ties are collapsed first: one row per (keys, score) with its positives and
negatives. The cumulative counts then come from ``running_sums``, so no group is
sorted in a single task, and each row knows its predecessor's counts without a
``lag`` (cumulative minus own).
"""

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import running_sums


def score_counts(preds: DataFrame, keys, score="score", positive: Column = None):
    positive = (F.col("y_true") == 1) if positive is None else positive
    return preds.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(positive, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, 0).otherwise(1)).alias("neg"),
    )


def _descending(counts, keys, totals=True):
    summed = running_sums(counts, keys, "score", ["pos", "neg"], descending=True, totals=totals)
    ends = [F.col("all_pos").alias("positives"), F.col("all_neg").alias("negatives")] if totals else []
    return summed.select(
        *keys, "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), *ends)


def _share(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def _areas(counts, keys):
    """ROC AUC, PR AUC and class sizes per group, from one ordered pass.

    The class sizes are the largest cumulative counts, so they scale the sums at the end.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    # Positives ranked above each negative, ties counted half.
    wins = neg.cast("double") * (tp - pos) + neg.cast("double") * pos / 2
    before = (tp - pos) + (fp - neg)
    precision = _share(tp, tp + fp)
    precision0 = F.when(before > 0, _share(tp - pos, before)).otherwise(1.0)
    steps = pos.cast("double") * (precision + precision0) / 2
    # Without positives recall is 1 from the first point on.
    jump = F.sum(F.when(before == 0, (precision + 1.0) / 2))
    positives, negatives = F.max("tp"), F.max("fp")
    return _descending(counts, keys, totals=False).groupBy(*keys).agg(
        _share(F.sum(wins), positives.cast("double") * negatives).alias("roc_auc"),
        F.when(positives > 0, F.try_divide(F.sum(steps), positives.cast("double"))).otherwise(jump).alias("pr_auc"),
        positives.alias("positives"), negatives.alias("negatives"),
    )


def roc_auc(counts: DataFrame, keys) -> DataFrame:
    """Exact ROC AUC of collapsed counts; null when a group has one class only."""
    return _areas(counts, keys).drop("pr_auc")


def curve_areas(preds, keys, score="score") -> DataFrame:
    """ROC AUC and PR AUC (trapezoid over curve points) from one ordered pass."""
    return _areas(score_counts(preds, keys, score), keys).drop("positives", "negatives")


def binary_roc_auc(preds, keys, score="score") -> DataFrame:
    return curve_areas(preds, keys, score).select(*keys, "roc_auc")


def pr_auc(preds, keys, score="score") -> DataFrame:
    return curve_areas(preds, keys, score).select(*keys, "pr_auc")


def _with_end_point(points, keys, curve, **end):
    """Append one fixed point per group of the (already aggregated) curve."""
    groups = curve.select(*keys).distinct() if keys else curve.limit(1).select()
    fixed = groups.select(*keys, *[F.lit(v).cast("double").alias(c) for c, v in end.items()])
    return points.unionByName(fixed)


def roc_curve(counts, keys) -> DataFrame:
    """(keys, threshold, fpr, tpr), starting at threshold infinity and (0, 0)."""
    curve = _descending(counts, keys)
    points = curve.select(
        *keys, F.col("score").alias("threshold"),
        _share(F.col("fp"), F.col("negatives")).alias("fpr"),
        _share(F.col("tp"), F.col("positives")).alias("tpr"),
    )
    return _with_end_point(points, keys, counts, threshold=float("inf"), fpr=0.0, tpr=0.0)


def pr_curve(counts, keys) -> DataFrame:
    """(keys, threshold, recall, precision) with the closing point (0, 1)."""
    tp = F.col("tp")
    points = _descending(counts, keys).select(
        *keys, F.col("score").alias("threshold"),
        F.coalesce(_share(tp, F.col("positives")), F.lit(1.0)).alias("recall"),
        _share(tp, tp + F.col("fp")).alias("precision"),
    )
    return _with_end_point(
        points, keys, counts, threshold=float("inf"), recall=0.0, precision=1.0
    )


def class_score_counts(preds, keys, prob="prob") -> DataFrame:
    """Collapsed counts per class, each class against the rest."""
    exploded = preds.select(*keys, "y_true", F.posexplode(prob).alias("class", "score"))
    return score_counts(
        exploded, list(keys) + ["class"], positive=F.col("y_true") == F.col("class")
    )


def average_rank(df, keys, value) -> DataFrame:
    """Per distinct value: first rank, tie size and average rank (ascending)."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    cum = running_sums(counts, keys, value, ["ties"], totals=False)
    return cum.select(
        *keys, value, "ties", (F.col("cum_ties") - F.col("ties") + 1).alias("first_rank"),
        (F.col("cum_ties") - (F.col("ties") - 1) / 2).alias("average_rank"),
    )
