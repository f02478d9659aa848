"""Feature attribution by sampled permutations, and permutation importance."""

from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import hashed_order
from ..operators.scaling import _as_array, positions
from ..operators.statistics import feature_importance
from .supervised import predict


def shapley_table(model, rows, background, row_id, permutations=4, seed=0) -> DataFrame:
    """(row_id, feature, class, value): sampled-permutation Shapley values.

    For each row and permutation the features switch from the background mean to
    the row's value one by one; a feature is credited with the change it causes.
    All mixed rows are scored by one ``transform``.
    """
    means = positions(background).groupBy("pos").agg(F.avg("x").alias("mean"))
    centre = F.transform("_mean", lambda s: s["mean"])
    start = rows.select(row_id, "features").withColumn("_mean", _as_array(means, "mean")).withColumn(
        "_mean", centre)
    drawn = start.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    width = F.size("features")
    order = F.transform(
        F.sort_array(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(
            F.xxhash64(F.lit(seed), F.col(row_id), F.col("perm"), i).alias("h"), i.alias("i")))),
        lambda s: s["i"])
    ordered = drawn.withColumn("order", order)
    # The place of each feature in the permutation, by feature.
    place = F.transform(
        F.sort_array(F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda p: F.struct(F.get("order", p).alias("i"), p.alias("p")))),
        lambda s: s["p"])
    stepped = ordered.withColumn("place", place).withColumn(
        "step", F.explode(F.sequence(F.lit(0), width)))
    mixed = stepped.withColumn("features", F.transform(
        F.sequence(F.lit(0), width - 1),
        lambda i: F.when(F.get("place", i) < F.col("step"), F.get("features", i))
        .otherwise(F.get("_mean", i)))).withColumn("label", F.lit(0.0))
    scored = predict(model, mixed, row_id, ["perm", "step", "order"])
    per_class = scored.select(row_id, "step", "order", F.posexplode("prob").alias("class", "p"))
    # Step t credits the feature switched on at t and debits the one switched next.
    credit = F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("feature"), F.col("p").alias("v")),
        F.struct(F.get("order", F.col("step")).alias("feature"), (-F.col("p")).alias("v")))
    parts = per_class.select(row_id, "class", F.inline(credit)).filter(F.col("feature").isNotNull())
    return parts.groupBy(row_id, "feature", "class").agg(
        (F.sum("v") / permutations).alias("value"))


def importance_of(attributions) -> DataFrame:
    return feature_importance(attributions)


def permutation_importance(model, rows, metric, row_id, repeats=1, seed=0) -> DataFrame:
    """(feature, importance): drop of a metric when a feature is shuffled.

    ``metric(predictions, keys)`` gives one value column per group. A row receives
    the feature of the row next to it in a hashed order, so every shuffle is one
    equi-join on the rank; all features are scored in one ``transform``.
    """
    data = rows.select(row_id, "features", "label")
    shuffled = None
    for repeat in range(repeats):
        ranked = hashed_order(data, [], f"{seed}:{repeat}", row_id)
        donor = ranked.select((F.col("rank") % F.col("group_size") + 1).alias("rank"),
                              F.col("features").alias("donor"))
        pairs = ranked.join(donor, "rank").select(
            row_id, "label", "features", "donor", F.lit(repeat).alias("repeat"))
        shuffled = pairs if shuffled is None else shuffled.unionByName(pairs)
    width = F.size("features")
    each = shuffled.withColumn("feature", F.explode(F.sequence(F.lit(0), width - 1)))
    swapped = each.withColumn("features", F.transform(
        "features", lambda x, i: F.when(i == F.col("feature"), F.get("donor", i)).otherwise(x)))
    after = metric(predict(model, swapped, row_id, ["feature", "repeat"]), ["feature", "repeat"])
    name = after.columns[-1]
    before = metric(predict(model, data, row_id), []).select(F.col(name).alias("v"))
    return after.withColumn("_base", before.scalar()).groupBy("feature").agg(
        F.avg(F.col("_base") - F.col(name)).alias("importance"))
