"""Tables of paired microbes: environments, constraint matrices, rates, fluxes.

Sparse matrices are long tables ``(microbe, compartment, row, col, value)`` with
zero-based rows and columns and compartment 'ext' or 'int'.
"""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.growth import (FLUX_TOL, GROWTH_TOL, PRESENT_BOUND, any_growth, category_of,
                                category_or_default, change, gated_flux,
                                is_strong_competition, number_or_null)
from ..session import BROADCAST_ROWS, at_most

RATE_COLUMNS = ["solo1", "best1", "kept1", "solo2", "kept2", "best2"]


def always_essential(needs: DataFrame, microbe="microbe", compound="compound"):
    """Compounds that every microbe needs (relational division)."""
    pairs = needs.select(microbe, compound).distinct()
    total = pairs.agg(F.countDistinct(microbe)).scalar()
    return pairs.groupBy(compound).agg(F.count("*").alias("_n")).filter(
        F.col("_n") == total
    ).select(compound)


def other_compounds(compounds, essential, compound="compound") -> DataFrame:
    """Compounds that are not always essential."""
    return compounds.select(compound).distinct().join(essential, compound, "left_anti")


def sample_environments(candidates, essential, size, seed, env="env", compound="compound"):
    """Environments of ``size`` compounds: the essential set plus a random rest.

    ``candidates`` are the (env, compound) rows to draw from. The draw takes the
    first rows by md5(seed:env:compound), the same on every run. An environment
    has at most as many candidates as there are compounds.
    """
    n_essential = essential.agg(F.count("*")).scalar()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(env).cast("string"),
                               F.col(compound).cast("string")))
    drawn = candidates.join(essential, compound, "left_anti").select(env, compound)
    order = Window.partitionBy(env).orderBy(digest, compound)
    sampled = drawn.withColumn("_k", F.row_number().over(order)).filter(
        F.col("_k") <= F.lit(size) - n_essential
    ).select(env, compound, F.lit(False).alias("essential"))
    # Every environment also holds every essential compound: attach the compact
    # list to each environment and unfold it.
    names = essential.agg(F.collect_set(compound)).scalar()
    fixed = candidates.select(env).distinct().withColumn(compound, F.explode(names))
    return sampled.unionByName(fixed.select(env, compound, F.lit(True).alias("essential")))


def special_pairs(solo: DataFrame, special, env="env", microbe="microbe", rate="rate"):
    """Every special microbe with every microbe in every environment they share.

    Returns (env, m1, m2, solo1, solo2) with the growth of each alone. The special
    side is the growth table restricted to a short list of microbes; it joins on
    the environment, broadcast when its size was checked to be small.
    """
    first = solo.filter(F.col(microbe).isin([int(m) for m in special])).select(
        env, F.col(microbe).alias("m1"), F.col(rate).alias("solo1")
    )
    second = solo.select(env, F.col(microbe).alias("m2"), F.col(rate).alias("solo2"))
    if at_most(first, BROADCAST_ROWS):
        first = F.broadcast(first)
    return second.join(first, env).select(env, "m1", "m2", "solo1", "solo2")


def solo_lookup(pairs, solo, env="env", microbe="microbe", rate="rate") -> DataFrame:
    """Add solo1 and solo2 to (env, m1, m2) rows."""
    one = solo.select(env, F.col(microbe).alias("m1"), F.col(rate).alias("solo1"))
    two = solo.select(env, F.col(microbe).alias("m2"), F.col(rate).alias("solo2"))
    return pairs.join(one, [env, "m1"]).join(two, [env, "m2"])


def pair_upper_bounds(pairs, bounds, compound="compound") -> DataFrame:
    """Upper bound of each compound for a pair: the sum of both microbes' bounds."""
    one = bounds.select(F.col("microbe").alias("m1"), compound, F.col("ub").alias("_ub1"))
    two = bounds.select(F.col("microbe").alias("m2"), compound, F.col("ub").alias("_ub2"))
    return pairs.join(one, "m1").join(two, ["m2", compound]).select(
        "m1", "m2", compound, (F.col("_ub1") + F.col("_ub2")).alias("ub")
    )


def environment_lower_bounds(present, n_compounds, env="env", compound="compound", environments=None):
    """Lower bound of every compound in every environment: -1000 if present, else 0.

    ``environments`` may list them all; one without a present compound has only zeros.

    Compounds are numbered 0..n-1. The present set of an environment is at most
    that long, so it travels as one array and is unfolded into the full row.
    """
    sets = present.groupBy(env).agg(F.collect_set(F.col(compound).cast("int")).alias("_in"))
    if environments is not None:
        none = F.array().cast("array<int>")
        sets = environments.select(env).distinct().join(sets, env, "left").select(
            env, F.coalesce("_in", none).alias("_in"))
    numbers = F.sequence(F.lit(0), F.lit(n_compounds - 1))
    return sets.select(env, "_in", F.explode(numbers).alias(compound)).select(
        env, compound,
        F.when(F.array_contains("_in", F.col(compound)), PRESENT_BOUND)
        .otherwise(0.0).alias("lb"),
    )


def pick_microbe(coo, microbe) -> DataFrame:
    """The matrix of one microbe; prunes to its folder in a partitioned table."""
    return coo.filter(F.col("microbe") == microbe)


def single_matrix(coo, n_ext) -> DataFrame:
    """[S_ext; S_ext; S_int] of each microbe: external rows twice, for >= and <=."""
    row = F.col("row")
    rows = F.when(F.col("compartment") == "ext", F.array(row, row + n_ext)).otherwise(
        F.array(row + 2 * n_ext)
    )
    return coo.select("microbe", F.explode(rows).alias("row"), "col", "value")


def single_constraints(spark, n_ext, n_int) -> DataFrame:
    """(row, sense, kind) of the single-microbe problem."""
    return spark.range(2 * n_ext + n_int).select(
        F.col("id").cast("int").alias("row"),
        F.when(F.col("id") < n_ext, ">").when(F.col("id") < 2 * n_ext, "<")
        .otherwise("=").alias("sense"),
        F.when(F.col("id") < n_ext, "env_lower").when(F.col("id") < 2 * n_ext, "env_upper")
        .otherwise("internal").alias("kind"),
    )


def pair_matrix(pairs, coo, sizes, n_ext, n_int) -> DataFrame:
    """Combined matrix of each pair.

    Columns of the second microbe follow those of the first; external rows are
    shared and doubled; internal rows are block-diagonal. One last row is left
    empty for the no-worse constraint. ``sizes`` is (microbe, n_reactions).
    """
    first_size = sizes.select(F.col("microbe").alias("m1"), F.col("n_reactions").alias("_shift"))
    sides = pairs.select("m1", "m2").join(first_size, "m1").select(
        "m1", "m2",
        F.inline(F.array(
            F.struct(F.col("m1").alias("microbe"), F.lit(0).alias("_second"),
                     F.lit(0).cast("long").alias("_offset")),
            F.struct(F.col("m2").alias("microbe"), F.lit(1).alias("_second"),
                     F.col("_shift").cast("long").alias("_offset")),
        )),
    )
    row = F.col("row")
    rows = F.when(F.col("compartment") == "ext", F.array(row, row + n_ext)).otherwise(
        F.array(row + 2 * n_ext + F.col("_second") * n_int)
    )
    return sides.join(coo, "microbe").select(
        "m1", "m2", F.explode(rows).alias("row"),
        (F.col("col") + F.col("_offset")).alias("col"), "value",
    )


def pair_constraints(spark, n_ext, n_int) -> DataFrame:
    """(row, sense, kind) of the pair problem, the no-worse row last."""
    last = 2 * (n_ext + n_int)
    i = F.col("id")
    return spark.range(last + 1).select(
        i.cast("int").alias("row"),
        F.when((i < n_ext) | (i == last), ">").when(i < 2 * n_ext, "<").otherwise("=")
        .alias("sense"),
        F.when(i < n_ext, "env_lower").when(i < 2 * n_ext, "env_upper")
        .when(i < 2 * n_ext + n_int, "internal_1").when(i < last, "internal_2")
        .otherwise("no_worse").alias("kind"),
    )


def no_worse_rows(pairs_with_solo, biomass, sizes, n_ext, n_int, tol=GROWTH_TOL) -> DataFrame:
    """The extra row of both optimisation directions of each pair and environment.

    Direction 'max1' keeps the second microbe at its solo growth minus ``tol`` and
    optimises the first; 'max2' the other way round. ``biomass`` is (microbe, col).
    """
    b1 = biomass.select(F.col("microbe").alias("m1"), F.col("col").cast("long").alias("_b1"))
    b2 = biomass.select(F.col("microbe").alias("m2"), F.col("col").cast("long").alias("_b2"))
    n1 = sizes.select(F.col("microbe").alias("m1"), F.col("n_reactions").alias("_shift"))
    full = pairs_with_solo.join(b1, "m1").join(b2, "m2").join(n1, "m1")
    second = F.col("_b2") + F.col("_shift")

    def direction(name, col, rhs, objective):
        return F.struct(
            F.lit(name).alias("direction"), F.lit(2 * (n_ext + n_int)).alias("row"),
            col.alias("col"), F.lit(1.0).alias("value"),
            (F.col(rhs) - tol).alias("rhs"), objective.alias("objective_col"),
        )

    return full.select(
        "env", "m1", "m2",
        F.inline(F.array(direction("max1", second, "solo2", F.col("_b1")),
                         direction("max2", F.col("_b1"), "solo1", second))),
    )


def matrix_times_vector(matrix, vector, keys=(), out="product") -> DataFrame:
    """Sparse product: sum of value * x over the columns of each row."""
    keys = list(keys)
    return matrix.join(vector, on=keys + ["col"]).groupBy(*keys, "row").agg(
        F.sum(F.col("value") * F.col("x")).alias(out)
    )


def external_flux(matrix, vector, n_ext, keys=()) -> DataFrame:
    """Net flux of each external compound (the first n_ext rows of the product)."""
    return matrix_times_vector(matrix.filter(F.col("row") < n_ext), vector, keys, "flux")


def split_flux(fluxes, sizes) -> DataFrame:
    """Pair flux vector back into the reactions of each microbe."""
    first = sizes.select(F.col("microbe").alias("m1"), F.col("n_reactions").alias("_shift"))
    own = F.col("col") < F.col("_shift")
    return fluxes.join(first, "m1").withColumn(
        "microbe", F.when(own, F.col("m1")).otherwise(F.col("m2"))
    ).withColumn("side", F.when(own, 1).otherwise(2)).withColumn(
        "reaction", F.when(own, F.col("col")).otherwise(F.col("col") - F.col("_shift"))
    ).drop("_shift", "col")


def mean_flux(one, two, keys) -> DataFrame:
    """Mean flux of two runs; a compound absent from one counts as 0 there."""
    both = one.select(*keys, "flux").unionByName(two.select(*keys, "flux"))
    return both.groupBy(*keys).agg((F.sum("flux") / 2).alias("mean_flux"))


def used_compounds(runs, keys, tol=FLUX_TOL) -> DataFrame:
    """True where any of the stacked runs imports the compound."""
    return runs.groupBy(*keys).agg(F.max(F.col("flux") < -tol).alias("used"))


def assemble_rates(runs, keys) -> DataFrame:
    """Six rates per key from rows (run, rate_opt, rate_kept).

    Runs are 'solo1', 'solo2', 'max1' and 'max2'; each key has at most one of each.
    """
    def of(run, column):
        return F.max(F.when(F.col("run") == run, F.col(column)))

    return runs.groupBy(*keys).agg(
        of("solo1", "rate_opt").alias("solo1"), of("max1", "rate_opt").alias("best1"),
        of("max2", "rate_kept").alias("kept1"), of("solo2", "rate_opt").alias("solo2"),
        of("max1", "rate_kept").alias("kept2"), of("max2", "rate_opt").alias("best2"),
    )


def label_interactions(rates, tol=GROWTH_TOL) -> DataFrame:
    """Add ``category`` and ``strong_competition`` to rows with the six rates.

    Same as ``categorise``, in steps, so each cleaned rate and change is computed once.
    """
    clean = {c: F.col(f"_{c}") for c in RATE_COLUMNS}
    steps = rates.withColumns({f"_{c}": number_or_null(F.col(c)) for c in RATE_COLUMNS})
    steps = steps.withColumns({"_change1": change(clean["best1"], clean["solo1"], tol),
                               "_change2": change(clean["best2"], clean["solo2"], tol)})
    category = category_of(*clean.values(), F.col("_change1"), F.col("_change2"), tol)
    labelled = steps.withColumn("category", category)
    strong = is_strong_competition(F.col("category"), clean["best1"], clean["best2"], tol)
    return labelled.withColumn("strong_competition", strong).select(
        *rates.columns, "category", "strong_competition")


def with_failures(grid, labelled, keys) -> DataFrame:
    """Category of every planned row; one that failed gets category 17."""
    got = labelled.select(*keys, "category")
    return grid.select(*keys).join(got, on=list(keys), how="left").withColumn(
        "category", category_or_default(F.col("category"))
    )


def gate_pair_fluxes(fluxes, tol=GROWTH_TOL) -> DataFrame:
    """Pair fluxes, zeroed unless any of the six rates exceeds ``tol``."""
    grows = any_growth(*[F.col(c) for c in RATE_COLUMNS], tol=tol)
    return fluxes.withColumn("flux", F.when(grows, F.col("flux")).otherwise(0.0))


def gate_solo_fluxes(fluxes, tol=GROWTH_TOL) -> DataFrame:
    return fluxes.withColumn("flux", gated_flux(F.col("rate"), F.col("flux"), tol))


def interaction_counts(labelled, keys=("m1",)) -> DataFrame:
    """Count of each category, one column c1..c17 per category."""
    return labelled.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("category") == c, 1).otherwise(0)).alias(f"c{c}")
        for c in range(1, 18)
    ])
