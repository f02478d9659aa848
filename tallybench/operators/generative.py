"""Quality of synthetic rows against real ones.

Tables are (row_id, features). Centres: fidelity uses the mean of the real rows,
coverage the mean of the synthetic rows.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions.distance import euclidean
from ..session import cut_lineage
from .neighbours import knn_graph, nearest_in
from .ordered import exact_quantiles

LEVELS = 30


def diversity(df) -> DataFrame:
    """Mean Hamming distance over all ordered pairs of different rows.

    Per position, pairs of unequal rows number n^2 - sum of squared value counts,
    so no pair is ever formed.
    """
    counts = df.select(F.posexplode("features").alias("pos", "x")).groupBy("pos", "x").agg(
        F.count("*").cast("double").alias("c"))
    per_position = counts.groupBy("pos").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"))
    n = F.col("n")
    return per_position.agg(
        F.avg(F.try_divide(n * n - F.col("same"), n * (n - 1))).alias("diversity"))


def novelty(synthetic, real, row_id, metric="hamming") -> DataFrame:
    """Mean distance of synthetic rows to their nearest real row."""
    near = nearest_in(synthetic, real, row_id, metric)
    return near.agg(F.avg("distance").alias("novelty"))


def _centre(df):
    means = df.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(
        F.avg("x").alias("x"))
    entries = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return means.agg(F.transform(entries, lambda e: e["x"])).scalar()


def _depth(df, centre, *keep):
    """Distance of every row to the centre, as ``d``."""
    return df.withColumn("_centre", centre).select(
        *keep, euclidean(F.col("features"), F.col("_centre")).alias("d"))


def _radii(distances, column):
    """The quantiles of a distance at LEVELS even levels, as one array."""
    q = exact_quantiles(distances, [], column, LEVELS)
    entries = F.sort_array(F.collect_list(F.struct("level_index", "quantile")))
    return q.agg(F.transform(entries, lambda e: e["quantile"])).scalar()


def _curve_score(rows, inside, name):
    """1 - sum |level - share of rows inside| / sum of levels."""
    levels = [i / (LEVELS - 1) for i in range(LEVELS)]
    shares = rows.agg(*[
        F.avg(F.when(inside(i), 1.0).otherwise(0.0)).alias(f"p{i}") for i in range(LEVELS)])
    gap = sum((F.abs(F.col(f"p{i}") - a) for i, a in enumerate(levels)), F.lit(0.0))
    return shares.select((1 - gap / F.lit(sum(levels))).alias(name))


def alpha_precision(real, synthetic) -> DataFrame:
    """Naive alpha-precision: synthetic rows inside the real rows' quantile balls."""
    centre = _centre(real)
    radii = _radii(_depth(real, centre), "d")
    rows = _depth(synthetic, centre).withColumn("r", radii)
    return _curve_score(rows, lambda i: F.col("d") <= F.get("r", i), "alpha_precision")


def beta_recall(real, synthetic, row_id) -> DataFrame:
    """Naive beta-recall: real rows covered by their nearest synthetic row.

    A real row is covered at a level when its nearest synthetic row is no farther
    than its nearest other real row, and lies inside the level's quantile ball
    around the synthetic centre. Quantiles are over the nearest synthetic rows.
    """
    centre = _centre(synthetic)
    near = nearest_in(real, synthetic, row_id).withColumnRenamed("distance", "to_synthetic")
    other = knn_graph(real, row_id, 1).select(
        F.col("i").alias(row_id), F.col("distance").alias("to_real"))
    depth = _depth(synthetic, centre, F.col(row_id).alias("nearest"))
    # Read twice, by the radii and by the shares: written once, as it holds two searches.
    rows = cut_lineage(near.join(other, row_id).join(depth, "nearest").select("to_synthetic", "to_real", "d"))
    radii = _radii(rows, "d")
    covered = F.col("to_synthetic") <= F.col("to_real")
    return _curve_score(rows.withColumn("r", radii),
                        lambda i: covered & (F.col("d") <= F.get("r", i)), "beta_recall")


def quality_report(real, synthetic, row_id, binary=None) -> DataFrame:
    """(metric, value): alpha-precision, beta-recall, their mean, diversity, novelty.

    ``binary`` maps a table to the one on which Hamming metrics are taken.
    """
    as_bits = binary or (lambda t: t)
    named = [
        ("alpha_precision_naive", alpha_precision(real, synthetic)),
        ("beta_recall_naive", beta_recall(real, synthetic, row_id)),
        ("diversity", diversity(as_bits(synthetic))),
        ("novelty", novelty(as_bits(synthetic), as_bits(real), row_id)),
    ]
    out = None
    for name, table in named:
        row = table.select(F.lit(name).alias("metric"), F.col(table.columns[0]).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
