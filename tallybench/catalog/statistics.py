"""Queries over histories, attributions, assignments and metric tables."""

from pyspark.sql import functions as F

from ..operators import statistics as S
from . import fixtures as fx
from .fixtures import r
from .registry import query


def stop_sql(limit):
    """Early stopping by recursion-free windows; ``limit`` bad epochs end a run."""
    return f"""WITH {fx.HISTORY},
i AS (SELECT *, coalesce(val > max(val) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS up FROM history),
b AS (SELECT *, epoch - max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS bad FROM i),
e AS (SELECT run, min(epoch) FILTER (WHERE bad >= {limit}) AS stop FROM b GROUP BY run),
k AS (SELECT b.* , e.stop FROM b JOIN e USING (run) WHERE stop IS NULL OR epoch <= stop)
SELECT run, arg_max(epoch, val) AS best_epoch, max(val) AS best_val, arg_max(test, val) AS best_test,
  max(epoch) AS last_epoch, max(stop) IS NOT NULL AS stopped_early FROM k WHERE up OR NOT up GROUP BY run"""


@query("w3_early_stopping", stop_sql(17))
def w3(spark, d):
    return S.early_stopping(fx.history(spark, d), patience=16)


@query("w4_early_stopping_first", stop_sql(16))
def w4(spark, d):
    return S.early_stopping(fx.history(spark, d), patience=16, stop_first=True)


ATTR = f"""WITH {fx.EMB}, a AS (SELECT generate_subscripts(features, 1) - 1 AS feature, label AS class, unnest(features) AS value FROM emb),
m AS (SELECT feature, class, avg(value) AS mean FROM a GROUP BY ALL), i AS (SELECT feature, sum(abs(mean)) AS importance FROM m GROUP BY ALL)"""


def _attributions(spark, d):
    return fx.emb(spark, d).select(
        F.col("label").alias("class"), F.posexplode("features").alias("feature", "value"))


@query("c9_mean_attribution", f"{ATTR} SELECT feature::INT AS feature, class, {r('mean')} AS mean FROM m")
def c9(spark, d):
    return fx.rounded(S.mean_attribution(_attributions(spark, d)))


@query("c9_feature_importance", f"{ATTR} SELECT feature::INT AS feature, {r('importance')} AS importance FROM i")
def c9_importance(spark, d):
    return fx.rounded(S.feature_importance(_attributions(spark, d)))


@query("t1_top_features", f"{ATTR} SELECT feature::INT AS feature, {r('importance')} AS importance FROM i ORDER BY i.importance DESC, feature LIMIT 10")
def t1(spark, d):
    return fx.rounded(S.top_features(S.feature_importance(_attributions(spark, d))))


@query("p13_without_noise", f"WITH {fx.EMB} SELECT row_id, cluster FROM emb WHERE cluster <> -1")
def p13(spark, d):
    return S.without_noise(fx.emb(spark, d).select("row_id", "cluster"))


@query("r14_cluster_count", f"WITH {fx.EMB} SELECT label, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS clusters FROM emb GROUP BY label")
def r14(spark, d):
    return S.cluster_count(fx.emb(spark, d), ["label"])


@query("w9_relabel", f"""WITH {fx.EMB}, c AS (SELECT row_id, CASE WHEN cluster = -1 THEN -1 ELSE cluster * 10 + bin END AS cluster FROM emb),
n AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS k FROM (SELECT DISTINCT cluster FROM c WHERE cluster <> -1))
SELECT row_id, coalesce(k, -1)::INT AS cluster FROM c LEFT JOIN n USING (cluster)""")
def w9(spark, d):
    wide = F.when(F.col("cluster") == -1, -1).otherwise(F.col("cluster") * 10 + F.col("bin"))
    return S.relabel(fx.emb(spark, d).select("row_id", wide.alias("cluster")))


@query("m11_drop_small_clusters", f"""WITH {fx.EMB}, c AS (SELECT row_id, label * 3 + cluster AS cluster FROM emb),
s AS (SELECT cluster, count(*) AS n FROM c GROUP BY ALL)
SELECT row_id, CASE WHEN n < 45 THEN -1 ELSE cluster END AS cluster FROM c JOIN s USING (cluster)""")
def m11(spark, d):
    rows = fx.emb(spark, d).select("row_id", (F.col("label") * 3 + F.col("cluster")).alias("cluster"))
    return S.drop_small_clusters(rows, 45)


@query("c8_mean_of_named", f"""WITH m AS (SELECT user_id, event_type || CASE WHEN event_id % 2 = 0 THEN '_naive' ELSE '_oc' END AS metric, value FROM events)
SELECT user_id, {r('avg(value)')} AS score FROM m WHERE contains(metric, 'naive') GROUP BY user_id""")
def c8(spark, d):
    suffix = F.when(F.col("event_id") % 2 == 0, "_naive").otherwise("_oc")
    m = fx.table(spark, d, "events").select(
        "user_id", F.concat("event_type", suffix).alias("metric"), "value")
    return fx.rounded(S.mean_of_named(m, "naive", ["user_id"]))
