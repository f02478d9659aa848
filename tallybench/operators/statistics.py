"""Statistics over runs, attributions, assignments and metric tables."""

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .ordered import running_max


def metrics_named(metrics, part) -> DataFrame:
    """Metric rows whose name contains ``part``."""
    return metrics.filter(F.col("metric").contains(part))


def mean_of_named(metrics, part, keys=()) -> DataFrame:
    """Mean value of the metrics whose name contains ``part``."""
    return metrics_named(metrics, part).groupBy(*keys).agg(F.avg("value").alias("score"))


def mean_attribution(attributions, feature="feature", label="class", value="value"):
    """(feature, class, mean attribution)."""
    return attributions.groupBy(feature, label).agg(F.avg(value).alias("mean"))


def feature_importance(attributions, feature="feature", label="class", value="value"):
    """Sum over classes of the absolute mean attribution."""
    means = mean_attribution(attributions, feature, label, value)
    return means.groupBy(feature).agg(F.sum(F.abs("mean")).alias("importance"))


def top_features(importance, n=10, feature="feature") -> DataFrame:
    return importance.orderBy(F.desc("importance"), feature).limit(n)


def without_noise(assignments, cluster="cluster") -> DataFrame:
    return assignments.filter(F.col(cluster) != -1)


def cluster_count(assignments, keys=(), cluster="cluster") -> DataFrame:
    """Number of clusters, noise (-1) not counted."""
    real = F.when(F.col(cluster) != -1, F.col(cluster))
    return assignments.groupBy(*keys).agg(F.countDistinct(real).alias("clusters"))


def relabel(assignments, keys=(), cluster="cluster") -> DataFrame:
    """Clusters renumbered 0..m-1 in label order; noise stays -1.

    The numbering is made on the distinct labels, then joined back.
    """
    keys = list(keys)
    names = assignments.select(*keys, cluster).distinct()
    order = Window.partitionBy(*keys).orderBy(cluster)
    numbered = without_noise(names, cluster).select(
        *keys, cluster, (F.dense_rank().over(order) - 1).alias("_new")
    )
    joined = assignments.join(numbered, on=keys + [cluster], how="left")
    return joined.withColumn(cluster, F.coalesce("_new", F.lit(-1))).select(
        *assignments.columns
    )


def drop_small_clusters(assignments, min_points, cluster="cluster") -> DataFrame:
    """Clusters with fewer than ``min_points`` rows become noise (-1)."""
    sizes = assignments.groupBy(cluster).agg(F.count("*").alias("_size"))
    small = F.col("_size") < min_points
    return assignments.join(sizes, cluster).withColumn(
        cluster, F.when(small, -1).otherwise(F.col(cluster))
    ).select(*assignments.columns)


def early_stopping(history, patience, run="run", stop_first=False) -> DataFrame:
    """Best epoch of each run under early stopping on ``val`` (higher is better).

    An epoch improves when its val exceeds every earlier one. Training ends at the
    first epoch after which more than ``patience`` epochs in a row did not improve.
    With ``stop_first`` it ends one epoch earlier, when exactly ``patience`` did
    not. Epochs are numbered from 0.
    """
    known = F.col("val").isNotNull() & ~F.isnan("val")
    clean = history.withColumn("_val", F.when(known, F.col("val")))
    reached = running_max(clean, [run], "epoch", "_val", "_before", inclusive=False)
    improves = F.coalesce(F.col("_val") > F.col("_before"), F.col("_val").isNotNull())
    # From here on one row per improvement, and one before the first epoch.
    ups = reached.filter(improves).select(run, "epoch", "val", "test")
    ends = history.groupBy(run).agg(F.max("epoch").alias("_end"))
    start = ends.select(run, F.lit(-1).cast(history.schema["epoch"].dataType).alias("epoch"),
                        F.lit(None).cast("double").alias("val"), F.lit(None).cast("double").alias("test"))
    following = F.lead("epoch").over(Window.partitionBy(run).orderBy("epoch"))
    points = cut_lineage(ups.unionByName(start).withColumn("_next", following).join(ends, run))
    given_up = F.col("epoch") + (patience if stop_first else patience + 1)
    quiet = given_up <= F.coalesce(F.col("_next") - 1, F.col("_end"))
    stops = points.groupBy(run).agg(F.min(F.when(quiet, given_up)).alias("_stop"))
    # A null stop means the run used all its epochs.
    seen = points.join(stops, run).withColumn("_last", F.coalesce("_stop", "_end"))
    kept = F.when((F.col("epoch") >= 0) & (F.col("epoch") <= F.col("_last")), F.col("epoch"))
    best = F.max_by(F.struct("epoch", "val", "test"), kept)
    return (
        seen.groupBy(run)
        .agg(best.alias("b"), F.max("_last").alias("last_epoch"),
             F.max("_stop").isNotNull().alias("stopped_early"))
        .select(run, F.col("b.epoch").alias("best_epoch"), F.col("b.val").alias("best_val"),
                F.col("b.test").alias("best_test"), "last_epoch", "stopped_early")
    )
