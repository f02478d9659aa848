"""From growth rates of pairs to a split, labelled environment table."""

from pyspark.sql import DataFrame, functions as F

from ..operators.pairs import (always_essential, label_interactions, sample_environments,
                               special_pairs, with_failures)
from ..operators.tables import train_val_test_split

# Class of the categories that enter the supervised tables.
CATEGORY_LABEL = {4: 0, 1: 1, 13: 2, 10: 3, 16: 4}


def interaction_table(solo, pair_rates, special) -> DataFrame:
    """Category of every special pair and environment; failed runs are 17.

    ``pair_rates`` is (env, m1, m2, best1, kept1, kept2, best2) of solved runs.
    """
    grid = special_pairs(solo, special)
    keys = ["env", "m1", "m2"]
    solved = label_interactions(grid.join(pair_rates, keys))
    return with_failures(grid, solved, keys)


def labelled_environments(interactions, environments, n_compounds, seed=4421) -> DataFrame:
    """(row_id, env, m1, m2, label, split, features): presence vectors with a class."""
    # An environment holds at most n_compounds compounds.
    sets = environments.groupBy("env").agg(F.collect_set(F.col("compound").cast("int")).alias("_in"))
    vectors = sets.select("env", F.transform(
        F.sequence(F.lit(0), F.lit(n_compounds - 1)),
        lambda c: F.when(F.array_contains("_in", c), 1.0).otherwise(0.0)).alias("features"))
    mapping = F.create_map(*[F.lit(x) for kv in CATEGORY_LABEL.items() for x in kv])
    classes = interactions.withColumn("label", F.try_element_at(mapping, F.col("category")))
    rows = classes.filter(F.col("label").isNotNull()).join(vectors, "env").withColumn(
        "row_id", F.concat_ws("-", "m1", "m2", "env"))
    return train_val_test_split(rows, "row_id", seed=seed)


def random_environments(needs, candidates, size, seed) -> DataFrame:
    """(env, compound): the always-essential compounds plus a random rest."""
    return sample_environments(candidates, always_essential(needs), size, seed).drop("essential")
