"""Queries of the pair pipeline."""

from pyspark.sql import functions as F

from ..functions import growth
from ..operators import pairs as P
from . import fixtures as fx
from .fixtures import r
from .registry import query

SPECIAL = [3, 7, 11, 19, 42]
SPECIAL_SQL = ", ".join(map(str, SPECIAL))
N_EXT, N_INT = 64, 64


@query("f1_interaction_category", f"""WITH {fx.RATES} SELECT m1, {fx.CATEGORY} AS category, count(*) AS n FROM rates GROUP BY ALL""")
def f1(spark, d):
    labelled = P.label_interactions(fx.rates(spark, d))
    return labelled.groupBy("m1", "category").agg(F.count("*").alias("n"))


@query("f2_strong_competition", f"""WITH {fx.RATES}, c AS (SELECT *, {fx.CATEGORY} AS category FROM rates)
SELECT m2, category, category = 4 AND (best1 < 0.001 OR best2 < 0.001) AS strong_competition, count(*) AS n FROM c GROUP BY ALL""")
def f2(spark, d):
    labelled = P.label_interactions(fx.rates(spark, d))
    return labelled.groupBy("m2", "category", "strong_competition").agg(F.count("*").alias("n"))


@query("f3_flux_role", f"""WITH {fx.FLUX} SELECT CASE WHEN flux < -0.000001 THEN 'imported' WHEN flux > 0.000001 THEN 'exported' ELSE 'unused' END AS role,
  count(*) AS n, {r('sum(flux)', 3)} AS total FROM flux GROUP BY ALL""")
def f3(spark, d):
    roles = fx.flux(spark, d).groupBy(growth.flux_role(F.col("flux")).alias("role"))
    return fx.rounded(roles.agg(F.count("*").alias("n"), F.sum("flux").alias("total")), 3)


@query("p15_gate_solo_fluxes", f"""WITH {fx.FLUX} SELECT m1, compound, {r('sum(CASE WHEN rate > 0.001 THEN flux ELSE 0 END)', 3)} AS flux FROM flux GROUP BY ALL""")
def p15(spark, d):
    gated = P.gate_solo_fluxes(fx.flux(spark, d))
    return fx.rounded(gated.groupBy("m1", "compound").agg(F.sum("flux").alias("flux")), 3)


@query("p15_gate_pair_fluxes", f"""WITH {fx.RATES} SELECT m1, m2, {r('sum(CASE WHEN greatest(solo1, best1, kept1, solo2, kept2, best2) > 0.001 THEN env ELSE 0 END)::DOUBLE', 3)} AS flux
FROM rates GROUP BY ALL""")
def p15_pair(spark, d):
    rows = fx.rates(spark, d).withColumn("flux", F.col("env").cast("double"))
    gated = P.gate_pair_fluxes(rows)
    return fx.rounded(gated.groupBy("m1", "m2").agg(F.sum("flux").alias("flux")), 3)


@query("p16_failure_default", f"""WITH {fx.RATES}, g AS (SELECT DISTINCT m1, m2 FROM rates),
k AS (SELECT m1, m2, min({fx.CATEGORY}) AS category FROM rates WHERE env % 4 = 0 GROUP BY m1, m2)
SELECT m1, m2, coalesce(category, 17) AS category FROM g LEFT JOIN k USING (m1, m2)""")
def p16(spark, d):
    rates = fx.rates(spark, d)
    grid = rates.select("m1", "m2").distinct()
    solved = P.label_interactions(rates.filter("env % 4 = 0")).groupBy("m1", "m2").agg(
        F.min("category").alias("category"))
    return P.with_failures(grid, solved, ["m1", "m2"])


PAIRS = f"""WITH {fx.SOLO}, pairs AS (SELECT s.env, f.microbe AS m1, s.microbe AS m2, f.rate AS solo1, s.rate AS solo2
FROM solo s JOIN solo f ON s.env = f.env AND f.microbe IN ({SPECIAL_SQL}))"""


@query("j1_special_pairs", f"{PAIRS} SELECT env, m1, m2, solo1 AS solo1, solo2 AS solo2 FROM pairs")
def j1(spark, d):
    return P.special_pairs(fx.solo(spark, d), SPECIAL)


@query("j2_solo_lookup", f"""WITH {fx.SOLO}, p AS (SELECT DISTINCT l_orderkey % 20 AS env, l_suppkey % 50 AS m1, l_partkey % 50 AS m2 FROM lineitem)
SELECT p.env, m1, m2, a.rate AS solo1, b.rate AS solo2 FROM p JOIN solo a ON a.env = p.env AND a.microbe = m1
JOIN solo b ON b.env = p.env AND b.microbe = m2""")
def j2(spark, d):
    pairs = fx.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 20).alias("env"), (F.col("l_suppkey") % 50).alias("m1"),
        (F.col("l_partkey") % 50).alias("m2")).distinct()
    return P.solo_lookup(pairs, fx.solo(spark, d))


@query("j3_pair_upper_bounds", """WITH b AS (SELECT l_suppkey AS microbe, l_partkey % 20 AS compound, max(l_quantity) AS ub FROM lineitem GROUP BY ALL),
p AS (SELECT DISTINCT l_suppkey AS m1, l_partkey % 50 AS m2 FROM lineitem)
SELECT m1, m2, a.compound, a.ub + b.ub AS ub FROM p JOIN b a ON a.microbe = m1 JOIN b ON b.microbe = m2 AND b.compound = a.compound""")
def j3(spark, d):
    line = fx.table(spark, d, "lineitem")
    bounds = line.groupBy(F.col("l_suppkey").alias("microbe"), (F.col("l_partkey") % 20).alias("compound")).agg(
        F.max("l_quantity").alias("ub"))
    pairs = line.select(F.col("l_suppkey").alias("m1"), (F.col("l_partkey") % 50).alias("m2")).distinct()
    return P.pair_upper_bounds(pairs, bounds)


@query("j4_environment_lower_bounds", f"""WITH {fx.ENVS}, e AS (SELECT DISTINCT env FROM envs), c AS (SELECT unnest(range(150))::INT AS compound)
SELECT e.env, c.compound, CASE WHEN x.env IS NULL THEN 0.0 ELSE -1000.0 END::DOUBLE AS lb
FROM e CROSS JOIN c LEFT JOIN envs x ON x.env = e.env AND x.compound = c.compound""")
def j4(spark, d):
    return P.environment_lower_bounds(fx.envs(spark, d), 150)


def _sizes(spark, d):
    return fx.coo(spark, d).groupBy("microbe").agg((F.max("col") + 1).alias("n_reactions"))


SIZES = "sizes AS (SELECT microbe, max(col) + 1 AS n_reactions FROM coo GROUP BY microbe)"


@query("j5_pair_matrix", f"""WITH {fx.COO}, {SIZES}, p AS (SELECT a.microbe AS m1, b.microbe AS m2 FROM sizes a, sizes b WHERE a.microbe = 1),
x AS (SELECT m1, m2, "row", col, value, compartment, 0 AS second FROM p JOIN coo ON microbe = m1
  UNION ALL SELECT m1, m2, "row", col + n_reactions, value, compartment, 1 FROM p JOIN sizes s ON s.microbe = m1 JOIN coo ON coo.microbe = m2)
SELECT m1, m2, CASE WHEN compartment = 'ext' THEN "row" ELSE "row" + 128 + second * 64 END AS "row", col, value FROM x
UNION ALL SELECT m1, m2, "row" + 64, col, value FROM x WHERE compartment = 'ext'""")
def j5(spark, d):
    # Microbe 1 is the special one, paired with every microbe including itself.
    pairs = _sizes(spark, d).select(F.least("microbe", F.lit(1)).alias("m1"), F.col("microbe").alias("m2"))
    return P.pair_matrix(pairs, fx.coo(spark, d), _sizes(spark, d), N_EXT, N_INT)


@query("j6_single_matrix", f"""WITH {fx.COO} SELECT microbe, CASE WHEN compartment = 'ext' THEN "row" ELSE "row" + 128 END AS "row", col, value FROM coo
UNION ALL SELECT microbe, "row" + 64, col, value FROM coo WHERE compartment = 'ext'""")
def j6(spark, d):
    return P.single_matrix(fx.coo(spark, d), N_EXT)


@query("j6_rows_by_sense", f"""WITH {fx.COO}, m AS (SELECT microbe, CASE WHEN compartment = 'ext' THEN "row" ELSE "row" + 128 END AS "row", value FROM coo
  UNION ALL SELECT microbe, "row" + 64, value FROM coo WHERE compartment = 'ext')
SELECT microbe, CASE WHEN "row" < 64 THEN '>' WHEN "row" < 128 THEN '<' ELSE '=' END AS sense, count(*) AS entries, sum(value) AS total FROM m GROUP BY ALL""")
def j6_sense(spark, d):
    rows = P.single_matrix(fx.coo(spark, d), N_EXT)
    return rows.join(P.single_constraints(spark, N_EXT, N_INT), "row").groupBy("microbe", "sense").agg(
        F.count("*").alias("entries"), F.sum("value").alias("total"))


@query("j7_no_worse_rows", f"""{PAIRS}, bio AS (SELECT l_partkey % 50 AS microbe, max(l_suppkey) AS col, max(l_suppkey) + 1 AS n FROM lineitem GROUP BY 1),
f AS (SELECT p.*, a.col AS b1, b.col + a.n AS b2 FROM pairs p JOIN bio a ON a.microbe = m1 JOIN bio b ON b.microbe = m2)
SELECT env, m1, m2, 'max1' AS direction, 256 AS "row", b2 AS col, 1.0::DOUBLE AS value, solo2 - 0.001 AS rhs, b1 AS objective_col FROM f
UNION ALL SELECT env, m1, m2, 'max2', 256, b1, 1.0, solo1 - 0.001, b2 FROM f""")
def j7(spark, d):
    reactions = fx.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("microbe")).agg(
        F.max("l_suppkey").alias("col"))
    sizes = reactions.select("microbe", (F.col("col") + 1).alias("n_reactions"))
    pairs = P.special_pairs(fx.solo(spark, d), SPECIAL)
    return P.no_worse_rows(pairs, reactions, sizes, N_EXT, N_INT)


def _vector(spark, d):
    return fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("col"), (F.col("s_acctbal") / 1000).alias("x"))


@query("j8_matrix_times_vector", f"""WITH {fx.COO} SELECT microbe, "row", {r('sum(value * s_acctbal / 1000)', 5)} AS product
FROM coo JOIN supplier ON col = s_suppkey GROUP BY ALL""")
def j8(spark, d):
    matrix = fx.coo(spark, d)
    vector = _vector(spark, d)
    both = matrix.select("microbe").distinct()
    per_microbe = vector.withColumn("microbe", F.explode(F.array(F.lit(1), F.lit(2)))).join(both, "microbe")
    return fx.rounded(P.matrix_times_vector(matrix, per_microbe, ["microbe"]), 5)


@query("j8_external_flux", f"""WITH {fx.COO} SELECT microbe, "row", {r('sum(value * s_acctbal / 1000)', 5)} AS flux
FROM coo JOIN supplier ON col = s_suppkey WHERE compartment = 'ext' GROUP BY ALL""")
def j8_external(spark, d):
    matrix = P.single_matrix(fx.coo(spark, d), N_EXT)
    vector = _vector(spark, d).withColumn("microbe", F.explode(F.array(F.lit(1), F.lit(2))))
    return fx.rounded(P.external_flux(matrix, vector, N_EXT, ["microbe"]), 5)


@query("j14_other_compounds", f"""WITH {fx.ESSENTIAL} SELECT compound FROM essential GROUP BY compound
HAVING count(*) < (SELECT count(DISTINCT microbe) FROM essential)""")
def j14(spark, d):
    needs = fx.essential(spark, d)
    return P.other_compounds(needs, P.always_essential(needs))


@query("r9_always_essential", f"""WITH {fx.ESSENTIAL} SELECT compound FROM essential GROUP BY compound
HAVING count(*) = (SELECT count(DISTINCT microbe) FROM essential)""")
def r9(spark, d):
    return P.always_essential(fx.essential(spark, d))


@query("w6_sample_environments", f"""WITH {fx.ESSENTIAL}, {fx.ENVS}, e AS (SELECT compound FROM essential GROUP BY compound
  HAVING count(*) = (SELECT count(DISTINCT microbe) FROM essential)),
k AS (SELECT env, compound, row_number() OVER (PARTITION BY env ORDER BY md5('7:' || env || ':' || compound), compound) AS k
  FROM envs WHERE compound NOT IN (SELECT compound FROM e))
SELECT env, compound, false AS essential FROM k WHERE k <= 60 - (SELECT count(*) FROM e)
UNION ALL SELECT env, compound, true FROM (SELECT DISTINCT env FROM envs), e""")
def w6(spark, d):
    essential = P.always_essential(fx.essential(spark, d))
    return P.sample_environments(fx.envs(spark, d), essential, 60, 7)


@query("r10_mean_flux", f"""WITH {fx.FLUX} SELECT m1, m2, env, compound, {r('sum(flux) / 2', 3)} AS mean_flux FROM flux WHERE run IN (2, 3) GROUP BY ALL""")
def r10(spark, d):
    flux = fx.flux(spark, d)
    keys = ["m1", "m2", "env", "compound"]
    return fx.rounded(P.mean_flux(flux.filter("run = 2"), flux.filter("run = 3"), keys), 3)


@query("r11_used_compounds", f"""WITH {fx.FLUX} SELECT m1, compound, bool_or(flux < -0.000001) AS used FROM flux GROUP BY ALL""")
def r11(spark, d):
    return P.used_compounds(fx.flux(spark, d), ["m1", "compound"])


@query("r12_assemble_rates", f"""WITH {fx.FLUX} SELECT m1, m2, max(rate) FILTER (WHERE run = 0) AS solo1, max(rate) FILTER (WHERE run = 2) AS best1,
  max(flux) FILTER (WHERE run = 3) AS kept1, max(rate) FILTER (WHERE run = 1) AS solo2,
  max(flux) FILTER (WHERE run = 2) AS kept2, max(rate) FILTER (WHERE run = 3) AS best2 FROM flux GROUP BY ALL""")
def r12(spark, d):
    names = F.array(*[F.lit(n) for n in ("solo1", "solo2", "max1", "max2")])
    runs = fx.flux(spark, d).select(
        "m1", "m2", F.get(names, F.col("run")).alias("run"),
        F.col("rate").alias("rate_opt"), F.col("flux").alias("rate_kept"))
    return P.assemble_rates(runs, ["m1", "m2"])


@query("r13_interaction_counts", f"""WITH {fx.RATES}, c AS (SELECT m1, {fx.CATEGORY} AS category FROM rates)
SELECT m1, {', '.join(f'count(*) FILTER (WHERE category = {c}) AS c{c}' for c in range(1, 18))} FROM c GROUP BY m1""")
def r13(spark, d):
    return P.interaction_counts(P.label_interactions(fx.rates(spark, d)))


@query("r15_split_flux", """WITH s AS (SELECT l_suppkey AS microbe, max(l_partkey) // 2 AS n FROM lineitem GROUP BY ALL),
f AS (SELECT l_suppkey AS m1, l_suppkey % 5 AS m2, l_partkey AS col, l_quantity AS flux FROM lineitem)
SELECT m1, m2, CASE WHEN col < n THEN m1 ELSE m2 END AS microbe, CASE WHEN col < n THEN 1 ELSE 2 END AS side,
  CASE WHEN col < n THEN col ELSE col - n END AS reaction, flux FROM f JOIN s ON s.microbe = m1""")
def r15(spark, d):
    line = fx.table(spark, d, "lineitem")
    sizes = line.groupBy(F.col("l_suppkey").alias("microbe")).agg(
        F.floor(F.max("l_partkey") / 2).alias("n_reactions"))
    fluxes = line.select(F.col("l_suppkey").alias("m1"), (F.col("l_suppkey") % 5).alias("m2"),
                         F.col("l_partkey").alias("col"), F.col("l_quantity").alias("flux"))
    return P.split_flux(fluxes, sizes)
