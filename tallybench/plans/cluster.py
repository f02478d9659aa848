"""Clustering methods: table in, (row_id, cluster) out."""

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

AT_ONCE = 4  # starts of k-means that are fitted at a time


def _vectors(df):
    return df.withColumn("vector", array_to_vector("features"))


def _assign(model, df, row_id):
    return model.transform(_vectors(df)).select(
        row_id, F.col("prediction").cast("int").alias("cluster"))


def kmeans(df, row_id, k, seed=42, starts=1) -> DataFrame:
    """K-means; of several starts the one with the lowest cost."""
    data = _vectors(df)
    one = inheritable_thread_target(df.sparkSession)(lambda i: KMeans(k=k, seed=seed + i, featuresCol="vector").fit(data))
    with ThreadPool(max(1, min(starts, AT_ONCE))) as pool:
        models = pool.map(one, range(starts), chunksize=1)
    return _assign(min(models, key=lambda m: m.summary.trainingCost), df, row_id)


def hierarchical(df, row_id, k, seed=42) -> DataFrame:
    """Divisive hierarchical clustering (bisecting k-means).

    It splits top-down where an agglomerative method merges bottom-up, so its
    clusters are not those of Ward linkage.
    """
    # Splits start from a centre moved in proportion to its norm, which is zero on
    # standardised rows; a common shift changes no distance and avoids that.
    moved = df.withColumn("features", F.transform("features", lambda x: x + 1.0))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="vector").fit(_vectors(moved))
    return _assign(model, moved, row_id)


def principal_components(df, row_id, k=2) -> DataFrame:
    """(row_id, components): projection on the first k axes; their sign is free."""
    model = PCA(k=k, inputCol="vector", outputCol="pc").fit(_vectors(df))
    return model.transform(_vectors(df)).select(row_id, vector_to_array("pc").alias("components"))


def comparison_methods(df, row_id, k, attributes=(), seed=42):
    """{name: assignments} of all four methods on scaled features. Those that need neighbours share one search."""
    from ..operators.neighbours import knn_graph_with_distance
    from .spectral import density_fair_clusters, fair_spectral_clusters

    graph, dist = knn_graph_with_distance(df.select(row_id, "features"), row_id, min(15, df.count() - 1), 5)
    return {
        "hierarchical": hierarchical(df, row_id, k, seed),
        "k_means": kmeans(df, row_id, k, seed, starts=10),
        "fair_spectral": fair_spectral_clusters(df, row_id, k, attributes, graph=graph),
        "density_fair": density_fair_clusters(df, row_id, k, attributes, dist=dist),
    }
