"""Expressions on growth rates and fluxes of paired microbes."""

from pyspark.sql import Column, functions as F

# Tolerance of a growth rate, tolerance of a flux, lower bound of a
# present compound, category of a failed or absent pair.
GROWTH_TOL = 0.001
FLUX_TOL = 1e-6
PRESENT_BOUND = -1000.0
NO_GROWTH = 17


# Category by the change of the first and second microbe, each
# -1 (worse), 0 (same within tolerance) or 1 (better).
CATEGORY_OF_CHANGES = {
    (1, 1): 1, (1, 0): 2, (0, 1): 3, (-1, -1): 4, (-1, 0): 5,
    (0, -1): 6, (0, 0): 7, (1, -1): 8, (-1, 1): 9,
}


def number_or_null(x) -> Column:
    """NaN as null: a comparison with it then never selects a branch."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def change(x, base, tol=GROWTH_TOL) -> Column:
    """1, 0 or -1 for better, same (bounds inclusive) or worse; null if undecidable."""
    return F.when(x > base + tol, 1).when(x >= base - tol, 0).when(x < base - tol, -1)


def category_of(solo1, best1, kept1, solo2, kept2, best2, change1, change2,
                tol=GROWTH_TOL) -> Column:
    """Interaction category from cleaned rates and the two changes."""
    def absent(x):
        return (x < tol) & (x > -tol)

    both = F.array(*[
        F.lit(CATEGORY_OF_CHANGES[(i, j)]) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = (
        F.when(solo1 + best1 + kept1 + solo2 + kept2 + best2 < tol, NO_GROWTH)
        .when(absent(kept1) & absent(best1), NO_GROWTH)
        .when(absent(best2) & absent(kept2), NO_GROWTH)
        .when((solo1 < tol) & (solo2 < tol) & (change1 == 1) & (change2 == 1), 16)
        .when(solo1 < tol, F.when(change2 == 1, 10).when(change2 == 0, 11).otherwise(12))
        .when(solo2 < tol, F.when(change1 == 1, 13).when(change1 == 0, 14).otherwise(15))
        .otherwise(F.get(both, (change1 + 1) * 3 + change2 + 1))
    )
    return F.coalesce(out, F.lit(NO_GROWTH)).cast("int")


def categorise(solo1, best1, kept1, solo2, kept2, best2, tol=GROWTH_TOL) -> Column:
    """Interaction category 1..17 of a pair.

    ``solo`` is growth alone, ``best`` growth while the partner does no worse than
    alone, ``kept`` growth while the partner is the one optimised. The first
    matching rule decides. Comparisons with NaN are false, so an undecidable
    pair ends in 17.
    """
    clean = [number_or_null(x) for x in (solo1, best1, kept1, solo2, kept2, best2)]
    s1, b1, _, s2, _, b2 = clean
    return category_of(*clean, change(b1, s1, tol), change(b2, s2, tol), tol)


def is_strong_competition(category, best1, best2, tol=GROWTH_TOL) -> Column:
    """Both lose (category 4) and at least one no longer grows."""
    return (category == 4) & F.coalesce((best1 < tol) | (best2 < tol), F.lit(False))


def flux_role(flux, tol=FLUX_TOL) -> Column:
    """'imported', 'exported' or 'unused' by the sign of a net flux."""
    return (
        F.when(flux < -tol, "imported").when(flux > tol, "exported").otherwise("unused")
    )


def gated_flux(rate, flux, tol=GROWTH_TOL) -> Column:
    """Flux, or zero where the microbe does not grow or the run was infeasible."""
    return F.when(rate > tol, flux).otherwise(F.lit(0.0))


def any_growth(*rates, tol=GROWTH_TOL) -> Column:
    return F.greatest(*rates) > tol


def category_or_default(category) -> Column:
    return F.coalesce(category, F.lit(NO_GROWTH))
