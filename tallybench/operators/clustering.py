"""Cluster quality: silhouette, DCSI and the comparison of methods."""

from pyspark.sql import DataFrame, functions as F

from ..functions.distance import euclidean
from ..functions.encode import clip01
from ..session import BROADCAST_ROWS, at_most, cut_lineage
from .neighbours import cluster_distance_sums, collapse, diameter
from .statistics import cluster_count, without_noise


def _labelled(df, row_id, cluster, method=0):
    """(rep, features, method, cluster, copies): a row for each vector and cluster."""
    return collapse(df, row_id, [cluster]).select(
        "rep", "features", F.lit(method).alias("method"), F.col(cluster).cast("int").alias("cluster"), "copies")


def _scores(groups):
    """(method, rep, cluster, copies, silhouette) of the rows of ``groups`` (see ``_labelled``)."""
    sizes = groups.groupBy("method", "cluster").agg(F.sum("copies").alias("size"))
    sums = cluster_distance_sums(groups).join(sizes, ["method", "cluster"])
    own = F.col("cluster") == F.col("own")
    inner = F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1)))
    outer = F.min(F.when(~own, F.col("total") / F.col("size")))
    a, b = F.col("a"), F.col("b")
    # A missing inner mean marks a cluster of one row.
    score = F.when(a.isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return (
        sums.groupBy("method", "rep", "own", "copies").agg(inner.alias("a"), outer.alias("b"))
        .select("method", "rep", F.col("own").alias("cluster"), "copies", score.alias("silhouette"))
    )


def _mean_score():
    mean = F.sum(F.col("silhouette") * F.col("copies")) / F.sum("copies")
    return F.when(F.countDistinct("cluster") > 1, mean).alias("silhouette")


def silhouette_rows(df, row_id, cluster="cluster") -> DataFrame:
    """(rep, cluster, copies, silhouette) of every distinct row, exact Euclidean.

    Noise (-1) counts as an ordinary cluster; a cluster of one row scores 0.
    """
    return _scores(_labelled(df, row_id, cluster)).drop("method")


def silhouette(df, row_id, cluster="cluster") -> DataFrame:
    """Mean silhouette over all rows; null with fewer than two clusters."""
    return silhouette_rows(df, row_id, cluster).agg(_mean_score())


def silhouettes(tables, row_id) -> DataFrame:
    """(method, silhouette) of several (row_id, features, cluster) tables; ``method`` is their number.

    Rows are compared once for all tables.
    """
    groups = None
    for number, table in enumerate(tables):
        each = _labelled(table, row_id, "cluster", number)
        groups = each if groups is None else groups.unionByName(each)
    return _scores(groups).groupBy("method").agg(_mean_score())


def squared_silhouette(df, row_id, cluster="cluster") -> DataFrame:
    """Silhouette with squared distances, one pass over the rows (other numbers)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(array_to_vector("features").alias("features"),
                        F.col(cluster).cast("int").alias("prediction"))
    value = ClusteringEvaluator(metricName="silhouette").evaluate(vectors)
    return df.sparkSession.createDataFrame([(value,)], "squared_silhouette double")


def centroids(df, cluster="cluster") -> DataFrame:
    """(cluster, features, size): mean vector of each cluster, noise left out."""
    means = (
        without_noise(df, cluster)
        .select(F.col(cluster).cast("int").alias("cluster"), F.posexplode("features").alias("pos", "x"))
        .groupBy("cluster", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("size"))
    )
    # One entry per position, so the list is as long as a row is wide.
    entries = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("cluster").agg(
        F.transform(entries, lambda e: e["x"]).alias("features"), F.max("size").alias("size"))


def _small(df):
    return F.broadcast(df) if at_most(df, BROADCAST_ROWS // 100) else df


def _side_by_side(**tables):
    """One row from several one-value tables, without a join."""
    long = None
    for name, table in tables.items():
        row = table.select(F.lit(name).alias("name"),
                           F.col(table.columns[0]).cast("double").alias("value"))
        long = row if long is None else long.unionByName(row)
    return long.agg(*[
        F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in tables])


def dcsi(df, row_id, cluster="cluster", span=None) -> DataFrame:
    """Density-based separation index in [0, 1]; ``span`` is the largest row distance, if known.

    (min centroid distance / largest row distance) * (1 - mean distance to the own
    centroid / largest row distance). The largest distance is over all rows, noise
    included; clusters of one row give no inner distance.
    """
    centres = centroids(df, cluster)
    named = centres.select("cluster", F.col("features").alias("_centre"), "size")
    rows = without_noise(df, cluster).select(F.col(cluster).cast("int").alias("cluster"), "features")
    inner = rows.join(_small(named.filter("size > 1")), "cluster").agg(
        F.coalesce(F.avg(euclidean(F.col("features"), F.col("_centre"))), F.lit(0.0)).alias("intra"))
    # One row with the few centroids; every pair once.
    pairs = F.flatten(F.transform("_all", lambda a, i: F.transform(
        F.slice("_all", i + 2, F.size("_all")), lambda b: euclidean(a, b))))
    near = centres.agg(F.collect_list("features").alias("_all")).select(
        F.array_min(pairs).alias("inter"))
    labels = df.agg(F.countDistinct(
        F.when(F.col(cluster) != -1, F.col(cluster))).cast("double").alias("k"))
    parts = _side_by_side(k=labels, intra=inner, inter=near, span=diameter(df, row_id) if span is None else span)
    intra, inter, span = F.col("intra"), F.col("inter"), F.col("span")
    value = clip01(F.try_divide(inter, span) * (1 - F.try_divide(intra, span)))
    return parts.select(
        F.when(F.col("k") < 2, 0.0).when(intra == 0, 1.0).when(inter == 0, 0.0)
        .when(span == 0, 0.0).otherwise(value).alias("dcsi"))


def compare_methods(points, assignments, row_id) -> DataFrame:
    """(method, silhouette, dcsi, clusters) of each method with more than one label.

    ``assignments`` maps a method name to its (row_id, cluster) table.
    """
    placed = {method: points.select(row_id, "features").join(table, row_id) for method, table in assignments.items()}
    # Without a second label there is no silhouette, and no row.
    placed = {method: joined for method, joined in placed.items() if joined.agg(F.countDistinct(F.col("cluster").cast("int")) > 1).first()[0]}
    if not placed:
        return points.sparkSession.createDataFrame([], "method string, silhouette double, dcsi double, clusters long")
    scores = cut_lineage(silhouettes(placed.values(), row_id))
    out, span = None, None
    for number, (method, joined) in enumerate(placed.items()):
        whole = points.join(assignments[method], row_id, "left_anti").isEmpty()
        if whole and span is None:  # the same for all methods that place every row
            span = diameter(points, row_id)
        row = _side_by_side(
            silhouette=scores.filter(F.col("method") == number).select("silhouette"),
            dcsi=dcsi(joined, row_id, span=span if whole else None), clusters=cluster_count(joined),
        ).select(F.lit(method).alias("method"), "silhouette", "dcsi",
                 F.col("clusters").cast("long").alias("clusters")).filter(F.col("silhouette").isNotNull())
        out = row if out is None else out.unionByName(row)
    return out
