"""Queries that fit models, cluster, explain, generate and label."""

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from ..operators import classification as C, generative as G, scaling, statistics as S, tables as T
from ..operators.clustering import compare_methods
from ..plans import attribution as A, boosting as B, cluster as K, explain as X, labelling as L, runs as R, spectral, supervised as M, synth as Y, ward as W
from ..sources import split_files
from ..session import cut_lineage, scratch_folder
from . import fixtures as fx
from .fixtures import r
from .registry import query

#: Sizes of the boosted models of the queries: at most so many trees, fewer once the
#: validation rows stop improving. The benchmark's own sizes are ``supervised.BOOSTING``.
SIZES = {"maxIter": 60, "maxDepth": 4, "stepSize": 0.1}


def _data(spark, d, label="bin"):
    rows = fx.emb(spark, d).select("row_id", "features", F.col(label).alias("label"))
    return T.train_val_test_split(rows, "row_id")


def _parts(spark, d, label="bin"):
    data = _data(spark, d, label)
    return [data.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


def _regression(spark, d):
    data = _data(spark, d)
    return data.withColumn("label", F.get("features", 0) * 3 + F.get("features", 1))


def _binary(spark, d, estimator):
    train, val, test = _parts(spark, d)
    return fx.rounded(C.binary_bundle(M.predict(M.fit(estimator, train, val), test), []))


@query("m1_boosted_binary")
def m1(spark, d):
    return _binary(spark, d, M.boosted_classifier(**SIZES))


#: Rows of the test split of the embeddings, by the rule of ``train_val_test_split``.
TEST = f"""WITH {fx.EMB}, k AS (SELECT *, row_number() OVER (ORDER BY md5('4421:' || row_id), row_id) AS rk, count(*) OVER () AS n FROM emb),
split AS (SELECT *, CASE WHEN rk <= ceil(round(ceil(round(n * 0.4, 9)) * 0.5, 9)) THEN 'test' WHEN rk <= ceil(round(n * 0.4, 9)) THEN 'val' ELSE 'train' END AS split FROM k)"""


@query("m1_auc_stopping", TEST + """ SELECT count(*) AS n, sum(bin)::BIGINT AS positives, count(*) AS scores_in_range, 0.0::DOUBLE AS gap_to_best_stage
FROM split WHERE split = 'test'""")
def m1_auc(spark, d):
    """Trees grown until the validation loss has not fallen for ten rounds, then cut at the best AUC."""
    train, val, test = _parts(spark, d)
    model = B.boost(train, val, rounds=200, rate=0.1, depth=4, patience=10)
    reached = C.binary_bundle(model.predict(val), []).first()["roc_auc"]
    best = B.stage_areas(model, val).agg(F.max("roc_auc")).first()[0]
    rows = model.predict(test).agg(F.count("*").alias("n"), F.sum("y_true").cast("long").alias("positives"),
                                   F.count_if(F.col("score").between(0, 1)).alias("scores_in_range"))
    return rows.withColumn("gap_to_best_stage", F.lit(round(best - reached, 9)))


@query("m2_boosted_regressor")
def m2(spark, d):
    return fx.rounded(M.regression_summary({"boosted": M.boosted_regressor(**SIZES)}, _regression(spark, d)))


@query("m3_boosted_multiclass")
def m3(spark, d):
    models = {"boosted": M.boosted_multiclass(**SIZES)}
    return fx.rounded(M.classification_summary(models, _data(spark, d, "label")))


@query("m3_joint_multiclass", TEST + """ SELECT label AS y_true, count(*) AS n, count(*) AS sums_to_one FROM split WHERE split = 'test' GROUP BY label""")
def m3_joint(spark, d):
    """One softmax over all classes; probabilities need no rescaling."""
    train, val, test = _parts(spark, d, "label")
    model = B.boost(train, val, "classes", rounds=100, rate=0.1, depth=4, patience=10)
    near_one = F.abs(F.aggregate("prob", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-12
    return model.predict(test).groupBy("y_true").agg(F.count("*").alias("n"), F.count_if(near_one).alias("sums_to_one"))


@query("m4_forest")
def m4(spark, d):
    return _binary(spark, d, M.forest_classifier(numTrees=10, maxDepth=4, seed=1))


@query("m5_perceptron")
def m5(spark, d):
    return _binary(spark, d, M.perceptron(64, 2, (16,), maxIter=30, seed=1))


@query("m6_predictions", f"WITH {fx.EMB} SELECT row_id, bin AS y_true, true AS sums_to_one, true AS in_range FROM emb")
def m6(spark, d):
    train, val, _ = _parts(spark, d)
    rows = M.predict(M.fit(M.logistic(maxIter=10), train), _data(spark, d))
    return rows.select(
        "row_id", "y_true",
        (F.abs(F.aggregate("prob", F.lit(0.0), lambda a, p: a + p) - 1) < 1e-9).alias("sums_to_one"),
        F.col("score").between(0, 1).alias("in_range"))


@query("s9_model_round_trip", "SELECT count(*) AS n, 0::BIGINT AS differing FROM embeddings")
def s9(spark, d):
    data = _data(spark, d)
    model = M.fit(M.logistic(maxIter=10), data.filter("split = 'train'"))
    path = scratch_folder(spark, "model")
    model.write().overwrite().save(path)
    again = LogisticRegressionModel.load(path)
    a = M.predict(model, data).select("row_id", "y_pred", "score")
    b = M.predict(again, data).select("row_id", F.col("y_pred").alias("p2"), F.col("score").alias("s2"))
    different = (F.col("y_pred") != F.col("p2")) | (F.col("score") != F.col("s2"))
    return a.join(b, "row_id").agg(F.count("*").alias("n"), F.count_if(different).alias("differing"))


@query("m7_kmeans")
def m7(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features"))
    return K.kmeans(rows, "row_id", 3, starts=10)


@query("m8_hierarchical")
def m8(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features"))
    return K.hierarchical(rows, "row_id", 3)


@query("m8_ward", "SELECT vec_id AS row_id, true AS assigned FROM embeddings")
def m8_ward(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features"))
    return W.ward(rows, "row_id", 3).select("row_id", F.col("cluster").between(0, 2).alias("assigned"))


@query("m9_fair_spectral")
def m9(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features", "bin"))
    return spectral.fair_spectral_clusters(rows, "row_id", 3, ["bin"])


@query("m10_density_fair")
def m10(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features", "bin"))
    return spectral.density_fair_clusters(rows, "row_id", 3, ["bin"])


@query("m12_principal_components")
def m12(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features"))
    return K.principal_components(rows, "row_id", 2)


@query("c3_baseline_methods")
def c3_baselines(spark, d):
    rows = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features"))
    methods = {"hierarchical": K.hierarchical(rows, "row_id", 3), "k_means": K.kmeans(rows, "row_id", 3, starts=10)}
    return fx.rounded(compare_methods(rows, methods, "row_id"))


@query("c3_four_methods", """SELECT method, count(*) AS n, true AS in_range
FROM embeddings, (SELECT unnest(['density_fair', 'fair_spectral', 'hierarchical', 'k_means']) AS method) GROUP BY method""")
def c3_four(spark, d):
    """All four methods with a sensitive attribute: every row has a cluster, both indices lie in their range.

    A method that finds one cluster only has no indices.
    """
    rows = cut_lineage(scaling.standard_scale(fx.emb(spark, d).select("row_id", "features", "bin")))
    methods = {name: cut_lineage(t) for name, t in K.comparison_methods(rows, "row_id", 3, ["bin"]).items()}
    scored = compare_methods(rows, methods, "row_id").select(
        "method", (F.col("silhouette").between(-1, 1) & F.col("dcsi").between(0, 1)).alias("in_range"))
    found = None
    for name, table in methods.items():
        each = table.select(F.lit(name).alias("method"), "row_id").distinct()
        found = each if found is None else found.unionByName(each)
    counts = found.groupBy("method").agg(F.count("*").alias("n"))
    return counts.join(scored, "method", "left").select("method", "n", F.coalesce("in_range", F.lit(True)).alias("in_range"))


@query("m13_shapley_importance")
def m13(spark, d):
    data = _data(spark, d)
    model = M.fit(M.logistic(maxIter=10), data.filter("split = 'train'"))
    table = X.shapley_table(model, data.filter("split = 'test'"), data.filter("split = 'train'"), "row_id", 2)
    return fx.rounded(S.top_features(S.feature_importance(table)))


@query("m13_tree_shapley", TEST + """ SELECT row_id, 64 AS features, 0.0::DOUBLE AS gap FROM split WHERE split = 'test'""")
def m13_trees(spark, d):
    """Exact values of boosted trees; ``gap``: their sum against the row's margin."""
    train, val, test = _parts(spark, d)
    model = B.boost(train, val, rounds=60, rate=0.1, depth=4, patience=10)
    values, base = A.tree_shapley(model, test, train)
    margins = model.staged(test, rounds=model.best).select("row_id", F.element_at("stages", -1).alias("margin"))
    sums = values.groupBy("row_id").agg(F.count("*").cast("int").alias("features"), F.sum("value").alias("value"))
    return sums.join(margins, "row_id").select("row_id", "features", F.round(F.abs(F.col("margin") - F.col("value") - float(base[0])), 9).alias("gap"))


@query("m14_permutation_importance")
def m14(spark, d):
    data = _data(spark, d)
    model = M.fit(M.logistic(maxIter=10), data.filter("split = 'train'"))
    return fx.rounded(X.permutation_importance(model, data.filter("split = 'test'"), C.accuracy, "row_id"))


@query("m15_benchmark_classification")
def m15(spark, d):
    models = {"logistic": M.logistic(maxIter=10), "forest": M.forest_classifier(numTrees=10, maxDepth=4, seed=1)}
    return fx.rounded(M.classification_summary(models, _data(spark, d, "label")))


@query("m15_run_written", TEST + """, m AS (SELECT unnest(['boosted', 'forest', 'logistic']) AS model)
SELECT model, split, count(*) AS n, sum(bin)::BIGINT AS positives, 0.0::DOUBLE AS accuracy_gap FROM split, m WHERE split <> 'train' GROUP BY ALL""")
def m15_run(spark, d):
    """Six split files to a written run; its JSON against its predictions."""
    root = scratch_folder(spark, "run")
    base = split_files.folder(root, "Classification", "COLLECTION_A", "100", "BC-I")
    rows = _data(spark, d)
    split_files.write_split(rows.select("row_id", "split", "label", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(64)]),
                            base, "BC-I", "row_id", [f"x{i}" for i in range(64)], "label")
    models = {"boosted": lambda train, val: B.boost(train, val, rounds=60, rate=0.1, depth=4, patience=10),
              "forest": M.forest_classifier(numTrees=20, maxDepth=5, seed=1), "logistic": M.logistic()}
    data = split_files.read_split(spark, root).withColumn("row_id", F.concat_ws("-", "split", F.col("row_id").cast("string")))
    folder = R.run(data, models, f"{root}/runs", "first")
    told = R.read_metrics(spark, folder).filter("metric = 'Accuracy'").select("model", "split", F.col("value").alias("told"))
    made = R.read_predictions(spark, folder).groupBy("model", "split").agg(
        F.count("*").alias("n"), F.sum("y_true").cast("long").alias("positives"),
        F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("made"))
    return made.join(told, ["model", "split"]).select("model", "split", "n", "positives", F.round(F.abs(F.col("made") - F.col("told")), 9).alias("accuracy_gap"))


@query("m15_benchmark_regression")
def m15_regression(spark, d):
    models = {"boosted": M.boosted_regressor(**SIZES), "forest": M.forest_regressor(numTrees=10, seed=1)}
    return fx.rounded(M.regression_summary(models, _regression(spark, d)))


@query("m16_augmentation")
def m16(spark, d):
    data = _data(spark, d)
    train = data.filter("split = 'train'")
    extra = Y.sample_rows(train, train.count(), "row_id", seed=3)
    return fx.rounded(M.compare_augmentation(M.boosted_classifier(**SIZES), data, extra))


@query("m17_synthetic_rows")
def m17(spark, d):
    real = fx.emb(spark, d).select("row_id", "features", "label")
    return Y.sample_rows(real, real.count(), "row_id", seed=5)


@query("m17_copula_rows", f"""WITH {fx.EMB}, s AS (SELECT label, count(*) AS c, sum(count(*)) OVER (ORDER BY label) AS upto, sum(count(*)) OVER () AS n FROM emb GROUP BY label)
SELECT label, c AS n, true AS inside, true AS ranks_agree FROM s""")
def m17_copula(spark, d):
    """As many drawn rows as real ones: label counts, ranges, and rank correlations within 5 standard errors."""
    real = fx.emb(spark, d).select("row_id", "features", "label")
    fake = cut_lineage(Y.copula_rows(real, real.count(), "row_id", seed=5))
    width = 8  # pairs of neighbouring features

    def summary(rows, side):
        x = lambda i: F.get("features", F.lit(i))
        return rows.groupBy("label").agg(
            F.count("*").alias(f"n_{side}"), F.array(*[F.min(x(i)) for i in range(width)]).alias(f"low_{side}"),
            F.array(*[F.max(x(i)) for i in range(width)]).alias(f"high_{side}"),
            F.array(*[F.corr(x(i), x(i + 1)) for i in range(width - 1)]).alias(f"r_{side}"))

    both = summary(real, "real").join(summary(fake, "fake"), "label")
    each = lambda a, b, test: F.forall(F.zip_with(a, b, test), lambda t: t)
    inside = each("low_fake", "low_real", lambda f, r: f >= r - 1e-9) & each("high_fake", "high_real", lambda f, r: f <= r + 1e-9)
    error = 5 * F.sqrt(F.lit(2.0) / F.col("n_real"))
    return both.select("label", F.col("n_fake").alias("n"), inside.alias("inside"),
                       each("r_fake", "r_real", lambda f, r: F.abs(f - r) < error).alias("ranks_agree"))


@query("m17_values_come_from_real_rows", "SELECT count(*) AS n, 64::BIGINT AS width, 0::BIGINT AS foreign_cells FROM embeddings")
def m17_check(spark, d):
    real = fx.emb(spark, d).select("row_id", "features", "label")
    fake = Y.sample_rows(real, real.count(), "row_id", seed=5)
    seen = scaling.positions(real, ["label"]).distinct()
    unknown = scaling.positions(fake, ["label"]).join(seen, ["label", "pos", "x"], "left_anti")
    shape = fake.agg(F.count("*").alias("n"), F.max(F.size("features")).cast("long").alias("width"))
    return shape.withColumn("foreign_cells", unknown.agg(F.count("*")).scalar())


@query("m19_generated_quality")
def m19_generated(spark, d):
    """Quality of as many generated rows as there are real ones."""
    real = fx.emb(spark, d).select("row_id", "features", "label")
    fake = cut_lineage(Y.sample_rows(real, real.count(), "row_id", seed=5).select("row_id", "features"))

    def bits(t):
        return t.withColumn("features", F.transform("features", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))

    return fx.rounded(G.quality_report(real.select("row_id", "features"), fake, "row_id", bits))


@query("m18_detection_score")
def m18(spark, d):
    rows = fx.emb(spark, d).select("row_id", "features", "label")
    fake = Y.sample_rows(rows, rows.count(), "row_id", seed=5)
    return fx.rounded(Y.detection_score(rows, fake, "row_id", width=64, max_iter=20))


E3 = f"""WITH {fx.SOLO}, g AS (SELECT s.env, f.microbe AS m1, s.microbe AS m2, f.rate / 100 AS solo1, s.rate / 100 AS solo2
  FROM solo s JOIN solo f ON s.env = f.env AND f.microbe IN (3, 7, 11)),
pr AS (SELECT l_orderkey % 20 AS env, l_suppkey % 50 AS m1, l_partkey % 50 AS m2, max(l_discount) / 2 AS best1, max(l_tax) AS kept1,
  min(l_discount) AS kept2, max(l_tax) / 2 AS best2 FROM lineitem GROUP BY ALL),
c AS (SELECT env, m1, m2, {fx.CATEGORY} AS category FROM g JOIN pr USING (env, m1, m2)),
a AS (SELECT g.env, g.m1, g.m2, coalesce(category, 17) AS category FROM g LEFT JOIN c USING (env, m1, m2))"""


def _interactions(spark, d):
    line = fx.table(spark, d, "lineitem")
    rates = line.groupBy(
        (F.col("l_orderkey") % 20).alias("env"), (F.col("l_suppkey") % 50).alias("m1"),
        (F.col("l_partkey") % 50).alias("m2"),
    ).agg((F.max("l_discount") / 2).alias("best1"), F.max("l_tax").alias("kept1"),
          F.min("l_discount").alias("kept2"), (F.max("l_tax") / 2).alias("best2"))
    solo = fx.solo(spark, d).withColumn("rate", F.col("rate") / 100)
    return L.interaction_table(solo, rates, [3, 7, 11])


@query("e3_interaction_table", f"{E3} SELECT * FROM a")
def e3(spark, d):
    return _interactions(spark, d)


@query("e3_labelled_environments", f"""{E3}, {fx.ENVS}, x AS (SELECT env, list(compound) AS inside FROM envs GROUP BY env),
v AS (SELECT env, m1, m2, CASE category WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 13 THEN 2 WHEN 10 THEN 3 WHEN 16 THEN 4 END AS label FROM a),
k AS (SELECT m1 || '-' || m2 || '-' || env AS row_id, label, len(inside) AS present FROM v JOIN x USING (env) WHERE label IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY md5('4421:' || row_id), row_id) AS rk, count(*) OVER () AS n FROM k)
SELECT row_id, label, present::DOUBLE AS present, CASE WHEN rk <= ceil(round(ceil(round(n * 0.4, 9)) * 0.5, 9)) THEN 'test'
  WHEN rk <= ceil(round(n * 0.4, 9)) THEN 'val' ELSE 'train' END AS split FROM o""")
def e3_labelled(spark, d):
    rows = L.labelled_environments(_interactions(spark, d), fx.envs(spark, d), 150)
    present = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rows.select("row_id", "label", present.alias("present"), "split")
