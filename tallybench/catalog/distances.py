"""Queries on distances, neighbours, clusters and synthetic rows."""

from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import clustering as C, descent, generative as G, neighbours as N, scaling
from . import fixtures as fx
from .fixtures import r
from .registry import ORACLES, query

# All ordered pairs of different rows with their distance (oracle only).
EUC = "sqrt(list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
HAM = "list_sum(list_transform(list_zip(a.features, b.features), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) / len(a.features)::DOUBLE"
PAIRS = f"WITH {fx.EMB}, pr AS (SELECT a.row_id AS i, b.row_id AS j, a.cluster AS ci, b.cluster AS cj, {EUC} AS d FROM emb a JOIN emb b ON a.row_id <> b.row_id)"
KNN = f"{PAIRS}, knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM pr) WHERE rank <= 15)"


def _points(spark, d):
    return fx.emb(spark, d).select("row_id", "features")


@query("f7_euclidean_distance", f"""WITH {fx.EMB} SELECT a.row_id, {r(EUC)} AS distance FROM emb a JOIN emb b ON b.row_id = a.row_id + 1""")
def f7(spark, d):
    a, b = _points(spark, d), _points(spark, d).select((F.col("row_id") - 1).alias("row_id"), F.col("features").alias("other"))
    return fx.rounded(a.join(b, "row_id").select("row_id", D.euclidean(F.col("features"), F.col("other")).alias("distance")))


@query("f8_hamming_distance", f"""WITH {fx.BITS} SELECT a.row_id, {r(HAM)} AS distance FROM bits a JOIN bits b ON b.row_id = a.row_id + 1""")
def f8(spark, d):
    a = fx.bits(spark, d)
    b = a.select((F.col("row_id") - 1).alias("row_id"), F.col("features").alias("other"))
    return fx.rounded(a.join(b, "row_id").select("row_id", D.hamming(F.col("features"), F.col("other")).alias("distance")))


@query("j9_knn_graph", f"{KNN} SELECT i, j, rank, {r('d')} AS distance FROM knn")
def j9(spark, d):
    return fx.rounded(N.knn_graph(_points(spark, d), "row_id", 15))


@query("j9_approximate_knn", f"""{KNN} SELECT count(DISTINCT i) AS n_rows, count(*) AS links, {r('avg(d)', 3)} AS mean_distance,
  {r('max(d)', 2)} AS farthest FROM knn""")
def j9_approximate(spark, d):
    """A list that misses a row holds a farther one, so the mean shows misses."""
    lists = descent.knn_graph_approximate(_points(spark, d), "row_id", 15)
    return lists.agg(F.countDistinct("i").alias("n_rows"), F.count("*").alias("links"),
                     (F.round(F.avg("distance"), 3) + 0).alias("mean_distance"), (F.round(F.max("distance"), 2) + 0).alias("farthest"))


@query("j10_kth_distance", f"{KNN} SELECT i AS row_id, {r('d')} AS distance FROM knn WHERE rank = 4")
def j10(spark, d):
    return fx.rounded(N.kth_distance(_points(spark, d), "row_id", 5))


@query("j11_symmetric_graph", f"{KNN}, e AS (SELECT i, j FROM knn UNION ALL SELECT j, i FROM knn) SELECT i, j, count(*) * 0.5::DOUBLE AS weight FROM e GROUP BY ALL")
def j11(spark, d):
    return N.symmetric_graph(N.knn_graph(_points(spark, d), "row_id", 15))


@query("j12_distance_summary", f"{PAIRS} SELECT i AS row_id, {r('sum(d)', 5)} AS total, {r('avg(d)', 6)} AS mean FROM pr GROUP BY i")
def j12(spark, d):
    out = N.distance_summary(_points(spark, d), "row_id")
    return out.select("row_id", F.round("total", 5).alias("total"), F.round("mean", 6).alias("mean"))


@query("j12_hamming_summary", f"""WITH {fx.BITS}, pr AS (SELECT a.row_id AS i, {HAM} AS d FROM bits a JOIN bits b ON a.row_id <> b.row_id)
SELECT i AS row_id, {r('sum(d)', 5)} AS total, {r('avg(d)', 6)} AS mean FROM pr GROUP BY i""")
def j12_hamming(spark, d):
    out = N.distance_summary(fx.bits(spark, d), "row_id", "hamming")
    return out.select("row_id", F.round("total", 5).alias("total"), F.round("mean", 6).alias("mean"))


@query("j12_diameter", f"{PAIRS} SELECT {r('max(d)')} AS diameter FROM pr")
def j12_diameter(spark, d):
    return fx.rounded(N.diameter(_points(spark, d), "row_id"))


#: Prices far from the origin.
FAR = """far AS (SELECT o_orderkey AS row_id, o_totalprice AS x FROM orders)"""


def _far(spark, d, table="lineitem"):
    rows = fx.table(spark, d, table)
    if table == "lineitem":
        # Line numbers repeat within an order, so rows get a number of their own.
        return rows.select(F.monotonically_increasing_id().alias("row_id"),
                           F.array(F.col("l_extendedprice") + 1e7).alias("features"))
    return rows.select(F.col("o_orderkey").alias("row_id"), F.array(F.col("o_totalprice") + 1e7).alias("features"))


@query("j10_far_from_origin", f"""WITH {FAR}, n AS (SELECT row_id, x, lag(x) OVER (ORDER BY x, row_id) AS a, lead(x) OVER (ORDER BY x, row_id) AS b FROM far)
SELECT row_id, {r('least(coalesce(x - a, 1e300), coalesce(b - x, 1e300))', 4)} AS distance FROM n""")
def j10_far(spark, d):
    return fx.rounded(N.kth_distance(_far(spark, d, "orders"), "row_id", 2), 4)


@query("j12_far_from_origin", f"""WITH o AS (SELECT o_orderkey AS row_id, o_totalprice AS x, row_number() OVER w AS k, sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS below,
  count(*) OVER () AS n, sum(o_totalprice) OVER () AS s FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey))
SELECT row_id, {r('(s - below - (n - k) * x) + (k * x - below)', 2)} AS total FROM o""")
def j12_far(spark, d):
    return fx.rounded(N.distance_summary(_far(spark, d, "orders"), "row_id").select("row_id", "total"), 2)


@query("j12_far_diameter", f"SELECT {r('max(l_extendedprice) - min(l_extendedprice)', 2)} AS diameter FROM lineitem")
def j12_far_diameter(spark, d):
    return fx.rounded(N.diameter(_far(spark, d), "row_id"), 2)


@query("j13_nearest_in_other_table", f"""WITH {fx.BITS}, pr AS (SELECT a.row_id, b.row_id AS nearest, {HAM} AS d FROM bits a JOIN bits b ON a.row_id % 2 = 1 AND b.row_id % 2 = 0)
SELECT row_id, nearest, {r('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, nearest) AS k FROM pr) WHERE k = 1""")
def j13(spark, d):
    bits = fx.bits(spark, d).select("row_id", "features")
    return fx.rounded(N.nearest_in(bits.filter("row_id % 2 = 1"), bits.filter("row_id % 2 = 0"), "row_id", "hamming"))


@query("j16_similarity_degrees", """WITH s AS (SELECT c_custkey AS row_id, (c_acctbal + 1000) / 11000 AS s FROM customer)
SELECT a.row_id, round(sum((a.s + b.s) / 2), 5) + 0 AS degree, round(sum((a.s + b.s) / 2 * b.s), 5) + 0 AS product
FROM s a JOIN s b ON a.row_id <> b.row_id GROUP BY a.row_id""")
def j16(spark, d):
    from ..plans.spectral import similarity_degrees, similarity_times
    rows = fx.table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_id"), ((F.col("c_acctbal") + 1000) / 11000).alias("s"))
    both = similarity_times(similarity_degrees(rows, "s"), "s", "s")
    return fx.rounded(both.drop("s"), 5)


SIL = f"""{PAIRS}, sz AS (SELECT cluster, count(*) AS n FROM emb GROUP BY cluster),
m AS (SELECT i, ci, cj, sum(d) AS t FROM pr GROUP BY ALL),
ab AS (SELECT i, max(CASE WHEN ci = cj THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN ci <> cj THEN t / n END) AS b
  FROM m JOIN sz ON sz.cluster = cj GROUP BY i)"""


@query("c1_silhouette", f"{SIL} SELECT {r('avg(coalesce((b - a) / greatest(a, b), 0))')} AS silhouette FROM ab")
def c1(spark, d):
    return fx.rounded(C.silhouette(fx.emb(spark, d), "row_id"))


@query("c1_silhouette_rows", f"{SIL} SELECT i AS rep, cluster, 1::BIGINT AS copies, {r('coalesce((b - a) / greatest(a, b), 0)')} AS silhouette FROM ab JOIN emb ON row_id = i")
def c1_rows(spark, d):
    return fx.rounded(C.silhouette_rows(fx.emb(spark, d), "row_id"))


@query("c1_squared_silhouette", f"""WITH {fx.EMB}, pr AS (SELECT a.row_id AS i, a.cluster AS ci, b.cluster AS cj,
    list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM emb a JOIN emb b ON a.row_id <> b.row_id),
sz AS (SELECT cluster, count(*) AS n FROM emb GROUP BY cluster), m AS (SELECT i, ci, cj, sum(d) AS t FROM pr GROUP BY ALL),
ab AS (SELECT i, max(CASE WHEN ci = cj THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN ci <> cj THEN t / n END) AS b
  FROM m JOIN sz ON sz.cluster = cj GROUP BY i)
SELECT {r('avg(coalesce((b - a) / greatest(a, b), 0))')} AS squared_silhouette FROM ab""")
def c1_squared(spark, d):
    return fx.rounded(C.squared_silhouette(fx.emb(spark, d), "row_id"))


CENTRES = """ce AS (SELECT cluster, list(m ORDER BY pos) AS features FROM (
  SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, generate_subscripts(features, 1) AS pos, unnest(features) AS x FROM emb WHERE cluster <> -1)
  GROUP BY ALL) GROUP BY cluster)"""
DCSI = f"""{PAIRS}, {CENTRES}, intra AS (SELECT avg({EUC}) AS v FROM emb a JOIN ce b USING (cluster)),
inter AS (SELECT min({EUC}) AS v FROM ce a JOIN ce b ON a.cluster < b.cluster), mx AS (SELECT max(d) AS v FROM pr)"""


@query("c2_dcsi", f"{DCSI} SELECT {r('least(greatest(inter.v / mx.v * (1 - intra.v / mx.v), 0), 1)')} AS dcsi FROM intra, inter, mx")
def c2(spark, d):
    return fx.rounded(C.dcsi(fx.emb(spark, d), "row_id"))


@query("c2_centroids", f"WITH {fx.EMB}, {CENTRES} SELECT ce.cluster, list_transform(ce.features, lambda v: round(v, 6) + 0) AS features, n AS size FROM ce JOIN (SELECT cluster, count(*) AS n FROM emb GROUP BY 1) s ON s.cluster = ce.cluster")
def c2_centroids(spark, d):
    out = C.centroids(fx.emb(spark, d))
    return out.withColumn("features", F.transform("features", lambda v: F.round(v, 6)))


@query("c3_method_comparison", f"""{DCSI.replace('WITH emb AS (', 'WITH emb AS (', 1)}, sz AS (SELECT cluster, count(*) AS n FROM emb GROUP BY cluster),
m AS (SELECT i, ci, cj, sum(d) AS t FROM pr GROUP BY ALL),
ab AS (SELECT i, max(CASE WHEN ci = cj THEN t / nullif(n - 1, 0) END) AS a, min(CASE WHEN ci <> cj THEN t / n END) AS b
  FROM m JOIN sz ON sz.cluster = cj GROUP BY i)
SELECT 'by_three' AS method, {r('(SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM ab)')} AS silhouette,
  {r('least(greatest(inter.v / mx.v * (1 - intra.v / mx.v), 0), 1)')} AS dcsi,
  (SELECT count(DISTINCT cluster) FROM emb WHERE cluster <> -1) AS clusters FROM intra, inter, mx""")
def c3(spark, d):
    rows = fx.emb(spark, d)
    same = rows.select("row_id", F.lit(0).alias("cluster"))
    return fx.rounded(C.compare_methods(
        rows, {"by_three": rows.select("row_id", "cluster"), "one_cluster": same}, "row_id"))


@query("c4_diversity", f"""WITH {fx.BITS} SELECT {r('avg(' + HAM + ')')} AS diversity FROM bits a JOIN bits b ON a.row_id <> b.row_id""")
def c4(spark, d):
    return fx.rounded(G.diversity(fx.bits(spark, d)))


@query("c5_novelty", f"""WITH {fx.BITS}, pr AS (SELECT a.row_id, min({HAM}) AS d FROM bits a JOIN bits b ON a.row_id % 2 = 1 AND b.row_id % 2 = 0 GROUP BY 1)
SELECT {r('avg(d)')} AS novelty FROM pr""")
def c5(spark, d):
    bits = fx.bits(spark, d).select("row_id", "features")
    return fx.rounded(G.novelty(bits.filter("row_id % 2 = 1"), bits.filter("row_id % 2 = 0"), "row_id"))


LEVELS = "[" + ", ".join(repr(i / 29) for i in range(30)) + "]"


def _centre_sql(name, part):
    return f"""{name} AS (SELECT list(m ORDER BY pos) AS features FROM (SELECT pos, avg(x) AS m FROM
  (SELECT generate_subscripts(features, 1) AS pos, unnest(features) AS x FROM emb WHERE row_id % 2 = {part}) GROUP BY pos))"""


@query("c6_alpha_precision", f"""WITH {fx.EMB}, {_centre_sql('b', 0)}, dd AS (SELECT row_id % 2 AS side, {EUC} AS d FROM emb a, b),
q AS (SELECT unnest({LEVELS}) AS a, unnest(quantile_cont(d, {LEVELS})) AS rad FROM dd WHERE side = 0),
p AS (SELECT a, avg(CASE WHEN d <= rad THEN 1.0 ELSE 0.0 END) AS p FROM q, dd WHERE side = 1 GROUP BY a)
SELECT {r('1 - sum(abs(a - p)) / sum(a)', 4)} AS alpha_precision FROM p""")
def c6(spark, d):
    rows = _points(spark, d)
    return fx.rounded(G.alpha_precision(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1")), 4)


@query("c7_beta_recall", f"""WITH {fx.EMB}, {_centre_sql('ce', 1)},
n AS (SELECT a.row_id AS i, b.row_id AS j, {EUC} AS d FROM emb a JOIN emb b ON a.row_id % 2 = 0 AND b.row_id % 2 = 1),
n1 AS (SELECT i, min(d) AS delta, arg_min(j, d) AS j FROM n GROUP BY i),
o AS (SELECT a.row_id AS i, min({EUC}) AS rho FROM emb a JOIN emb b ON a.row_id % 2 = 0 AND b.row_id % 2 = 0 AND a.row_id <> b.row_id GROUP BY 1),
dep AS (SELECT a.row_id AS j, {EUC} AS d FROM emb a, ce b WHERE a.row_id % 2 = 1),
x AS (SELECT delta <= rho AS ok, dep.d FROM n1 JOIN o USING (i) JOIN dep USING (j)),
q AS (SELECT unnest({LEVELS}) AS a, unnest(quantile_cont(d, {LEVELS})) AS rad FROM x),
p AS (SELECT a, avg(CASE WHEN ok AND d <= rad THEN 1.0 ELSE 0.0 END) AS p FROM q, x GROUP BY a)
SELECT {r('1 - sum(abs(a - p)) / sum(a)', 4)} AS beta_recall FROM p""")
def c7(spark, d):
    rows = _points(spark, d)
    return fx.rounded(G.beta_recall(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1"), "row_id"), 4)


def _report_row(metric, column, sql):
    return f"SELECT '{metric}' AS metric, (round({column}, 4) + 0) AS value FROM ({sql})"


SYNTHETIC_DIVERSITY = ORACLES["c4_diversity"] + " WHERE a.row_id % 2 = 1 AND b.row_id % 2 = 1"


@query("m19_quality_report", " UNION ALL ".join([
    _report_row("alpha_precision_naive", "alpha_precision", ORACLES["c6_alpha_precision"]),
    _report_row("beta_recall_naive", "beta_recall", ORACLES["c7_beta_recall"]),
    _report_row("diversity", "diversity", SYNTHETIC_DIVERSITY),
    _report_row("novelty", "novelty", ORACLES["c5_novelty"])]))
def m19(spark, d):
    rows = _points(spark, d)

    def bits(t):
        return t.withColumn("features", F.transform("features", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))

    return fx.rounded(G.quality_report(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1"), "row_id", bits), 4)
