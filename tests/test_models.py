import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybench.operators import classification as C
from tallybench.operators.neighbours import kth_distance, knn_graph, symmetric_graph
from tallybench.operators.scaling import standard_scale
from tallybench.plans import cluster as K, explain as X, spectral, supervised as M, synth as Y


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        y = i % 3
        x = rng.normal(scale=0.4, size=3) + [4 * (y == 0), 4 * (y == 1), 0]
        rows.append((i, [float(v) for v in x], y, int(rng.integers(0, 2)), ("train", "val", "test")[i // 3 % 3]))
    return spark.createDataFrame(rows, "row_id long, features array<double>, label int, sex int, split string")


def agreement(table, blobs):
    rows = table.join(blobs.select("row_id", "label"), "row_id").groupBy("cluster", "label").count().collect()
    best = {}
    for r in rows:
        best[r["cluster"]] = max(best.get(r["cluster"], 0), r["count"])
    return sum(best.values()) / 90


def test_estimators_beat_chance(blobs):
    fast = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3}
    models = {"boosted": M.boosted_multiclass(**fast), "forest": M.forest_classifier(numTrees=5, seed=1)}
    rows = M.classification_summary(models, blobs).collect()
    assert len(rows) == 4 and all(r["accuracy"] > 0.8 and r["roc_auc_ovr_weighted"] > 0.8 for r in rows)


def test_models_against_the_rest_are_fitted_at_a_time(spark, monkeypatch):
    from threading import Barrier

    from pyspark.ml.classification import GBTClassifier
    from tallybench.plans import supervised

    both, fit = Barrier(2), GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data: (both.wait(60), fit(self, data))[1])
    rows = spark.createDataFrame([(i, [float(i % 2), float(i)], i % 2) for i in range(40)], "row_id long, features array<double>, label int")
    model = supervised.fit(supervised.boosted_multiclass(maxIter=1, maxDepth=1), rows, rows)
    got = supervised.predict(model, rows).select("y_true", "y_pred").collect()
    assert len(got) == 40 and all(r.y_true == r.y_pred for r in got)  # models are in the order of the classes


def test_kmeans_and_hierarchical_find_blobs(blobs):
    centred = standard_scale(blobs)  # zero mean, where divisive splits could stall
    for method in (K.kmeans, K.hierarchical):
        assert agreement(method(centred, "row_id", 3), blobs) > 0.9


def test_fair_spectral_equals_dense_eigenvalues(spark, blobs):
    edges = symmetric_graph(knn_graph(blobs.select("row_id", "features"), "row_id", 6))
    w = np.zeros((90, 90))
    for e in edges.collect():
        w[e["i"], e["j"]] = e["weight"]
    lap = np.diag(w.sum(1)) - w
    sex = np.array([r["sex"] for r in blobs.orderBy("row_id").collect()], float)
    f = (sex - sex.mean()) / np.linalg.norm(sex - sex.mean())
    p = np.eye(90) - np.outer(f, f)
    want = np.sort(np.linalg.eigvalsh(p @ lap @ p + 1e6 * np.outer(f, f)))[:4]
    rows, n_f = spectral._constraints(blobs, "row_id", ["sex"])
    found, theta = spectral.smallest_laplacian_vectors(
        spectral.cut_lineage(edges), rows, "row_id", 4, n_f, degree=5)
    assert np.allclose(theta, want, atol=0.05)
    v = np.array([list(r)[1:] for r in found.orderBy("row_id").collect()])
    assert np.abs(f @ v).max() < 1e-6


def test_fair_spectral_query_has_its_constraint(spark, tmp_path, monkeypatch):
    from tallybench.catalog.registry import QUERIES

    rng = np.random.default_rng(4)
    labels = np.repeat([0, 0, 1, 1, 1], 12)  # what bin follows from is what parts the rows
    x = rng.normal(scale=0.3, size=(60, 2)) + np.repeat([[0, 0], [0, 3], [3, 0], [3, 3], [6, 0]], 12, axis=0)
    spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, labels))],
                          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, fit = [], spectral.kmeans
    monkeypatch.setattr(spectral, "kmeans", lambda df, *a, **b: seen.append(df) or fit(df, *a, **b))
    assert QUERIES["m9_fair_spectral"](spark, str(tmp_path)).count() == 60
    v = np.array([r["features"] for r in seen[0].orderBy("row_id").collect()])
    assert np.abs((labels - labels.mean()) @ v).max() < 1e-6
    assert np.allclose((v * v).sum(0), 60)  # not smaller with more rows


def test_steps_stay_orthogonal_without_a_pass_each(spark, blobs, monkeypatch):
    rng = np.random.default_rng(5)
    w = rng.random((40, 40)) * (rng.random((40, 40)) < 0.2)
    w = np.triu(w, 1) + np.triu(w, 1).T
    lap, f, y = np.diag(w.sum(1)) - w, rng.normal(size=(40, 2)), rng.normal(size=(40, 3))
    f -= f.mean(0)
    part = f @ np.linalg.pinv(f)
    y -= part @ y
    top = 2 * w.sum(1).max()
    for low in (top / 8, top * 1e-3, top / 2):
        centre, half = (top + low) / 2, (top - low) / 2
        steps = [(c / half, -c / half * centre, g) for c, g in [(1, 0.0), *[(2, -1.0)] * 7]]
        powers = [np.linalg.matrix_power(lap / top, j) @ f for j in range(9)]
        off = spectral._corrections(steps, [h.T @ y for h in powers], [f.T @ h for h in powers], top)
        a, z, b, zb = y, 0 * y, y, 0 * y
        for (alpha, beta, gamma), c in zip(steps, off):
            a, z = alpha * lap @ a + beta * a + gamma * z, a
            a = a - part @ a
            b, zb = alpha * lap @ b + beta * b + gamma * zb - f @ c, b
            assert np.allclose(a, b, rtol=1e-7, atol=1e-7 * np.abs(a).max())
    cuts, cut = [], spectral.cut_lineage
    monkeypatch.setattr(spectral, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(spectral, "MOST_ROUNDS", 1)
    edges = symmetric_graph(knn_graph(blobs.select("row_id", "features"), "row_id", 6))
    rows, n_f = spectral._constraints(blobs, "row_id", ["sex"])
    with pytest.raises(RuntimeError):
        spectral.smallest_laplacian_vectors(cut(edges), rows, "row_id", 4, n_f)
    assert len(cuts) == 5


def test_density_embedding_equals_dense_eigenvalues(blobs):
    d = np.array([r["distance"] for r in kth_distance(blobs, "row_id", 5).orderBy("row_id").collect()])
    s = 1 - d / np.linalg.norm(d)
    s = (s - s.min()) / (s.max() - s.min())
    sim = (s[:, None] + s[None]) / 2
    np.fill_diagonal(sim, 0)
    deg = sim.sum(1)
    half = 1 / np.sqrt(deg)
    want = np.linalg.eigvalsh(half[:, None] * (np.diag(deg) - sim) * half[None])[1:6]
    _, theta = spectral.density_embedding(blobs.select("row_id", "features"), "row_id", width=6)
    assert np.allclose(theta, want, atol=2e-4)


def test_shapley_values_add_up(blobs):
    binary = blobs.withColumn("label", (F.col("label") == 0).cast("int"))
    model = M.fit(M.logistic(maxIter=20), binary)
    table = X.shapley_table(model, binary.limit(6), binary, "row_id", permutations=3)
    total = {r[0]: r[1] for r in table.filter("class = 1").groupBy("row_id").agg(F.sum("value")).collect()}
    centre = binary.select(*[F.avg(F.get("features", i)) for i in range(3)]).first()
    base = M.predict(model, binary.limit(1).withColumn(
        "features", F.array(*[F.lit(float(c)) for c in centre]))).first()["score"]
    for r in M.predict(model, binary).filter(F.col("row_id").isin(list(total))).collect():
        assert total[r["row_id"]] == pytest.approx(r["score"] - base, abs=1e-9)


def test_permutation_importance_finds_the_used_feature(blobs):
    binary = blobs.withColumn("label", (F.get("features", F.lit(0)) > 2).cast("int"))
    model = M.fit(M.forest_classifier(numTrees=5, seed=1), binary)
    out = X.permutation_importance(model, binary, C.accuracy, "row_id", repeats=2)
    top = out.orderBy(F.desc("importance")).first()
    assert top["feature"] == 0 and top["importance"] > 0.1


def test_synthetic_rows_follow_labels(blobs):
    fake = Y.sample_rows(blobs, 300, "row_id", seed=1)
    rows = {r["label"]: r["count"] for r in fake.groupBy("label").count().collect()}
    assert sum(rows.values()) == 300 and all(70 < n < 130 for n in rows.values())
    assert fake.filter(F.size("features") != 3).count() == 0
    means = {r["label"]: r[1] for r in fake.groupBy("label").agg(F.avg(F.get("features", F.lit(0)))).collect()}
    assert means[0] > 3 and abs(means[2]) < 1


def test_copula_rows_keep_marginals_and_rank_correlations(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        label, z = i % 2, rng.normal(size=2)
        a, b = z[0], (0.8 if label else -0.6) * z[0] + 0.6 * z[1]
        rows.append((i, [float(np.exp(a)), float(b ** 3), 2.0, float(rng.integers(3))], label))
    real = spark.createDataFrame(rows, "row_id long, features array<double>, label int")
    fake = Y.copula_rows(real, 1000, "row_id", seed=2)
    assert [r.row_id for r in fake.orderBy("row_id").collect()] == list(range(1000))
    again = {r.row_id: r.features for r in Y.copula_rows(real.repartition(7), 1000, "row_id", seed=2).collect()}
    assert all(r.features == pytest.approx(again[r.row_id], abs=1e-6) for r in fake.collect())
    ranks = {}
    for name, table in (("real", real), ("fake", fake)):
        table.select("label", *[F.get("features", F.lit(i)).alias(f"x{i}") for i in range(4)]).write.parquet(str(tmp_path / name))
        ranks[name] = duckdb.sql(f"""SELECT label, corr(a, b), count(*), avg(x2), median(x0) FROM (SELECT *, rank() OVER (PARTITION BY label ORDER BY x0) AS a,
            rank() OVER (PARTITION BY label ORDER BY x1) AS b FROM '{tmp_path}/{name}/*.parquet') GROUP BY label ORDER BY label""").fetchall()
    for r, f in zip(ranks["real"], ranks["fake"]):
        assert f[2] == 500 and abs(r[1] - f[1]) < 0.08 and f[3] == pytest.approx(2.0) and abs(r[4] - f[4]) < 0.15


def plain_ward(x, w, k):
    """Ward's merging by brute force: sets of rows."""
    parts = [[i] for i in range(len(x))]

    def height(p, q):
        a, b = w[p].sum(), w[q].sum()
        return a * b / (a + b) * ((np.average(x[p], 0, w[p]) - np.average(x[q], 0, w[q])) ** 2).sum()

    while len(parts) > k:
        _, i, j = min((height(parts[i], parts[j]), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        parts[i] += parts.pop(j)
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("finish, k", [(1024, 2), (1024, 5), (6, 3)])
def test_ward_equals_brute_force(spark, finish, k, monkeypatch):
    from tallybench.plans import ward

    monkeypatch.setattr(ward, "FINISH", finish)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(7, 2)), rng.normal(size=(7, 2)) + 4, [[30.0, 30.0], [31.0, 30.0]]])
    w = np.ones(len(x))
    w[0] = 5  # copies
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>").coalesce(2)
    got = {r.row_id: r.cluster for r in ward.ward(df, "row_id", k, neighbours=len(x)).collect()}
    assert len(got) == len(rows) and {got[100 + i] for i in range(4)} == {got[0]}
    found = {}
    for i in range(len(x)):
        found.setdefault(got[i], set()).add(i)
    assert {frozenset(s) for s in found.values()} == plain_ward(x, w, k)


def test_ward_rounds_do_not_build_on_checkpoints(spark, monkeypatch):
    """What the planner infers of a checkpoint is kept, so plans of many rounds would grow without end."""
    from tallybench.plans import ward

    monkeypatch.setattr(ward, "FINISH", 2)
    monkeypatch.setattr(ward, "CROWDED", 3)
    cuts, cut = [], ward.cut_lineage
    monkeypatch.setattr(ward, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    # Gaps grow, so that one pair merges in a round; a graph of all rows is Ward's own.
    x = np.cumsum(3.0 ** np.arange(9))[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>").coalesce(2)
    rounds, last = ward.merges(ward.Distinct(df, "row_id"), len(x))
    assert len(rounds) == len(x) - 2 and len(last) == 1
    assert len(cuts) <= 2 + len(rounds)  # clusters, graph, and crowded clusters of a round
    heights = [f.first()["height"] for f in rounds] + [last[0][2]]
    centre, size, want = x[0, 0], 1, []
    for v in x[1:, 0]:
        want.append(size / (size + 1) * (v - centre) ** 2)
        centre, size = (centre * size + v) / (size + 1), size + 1
    assert heights == pytest.approx(want)


def test_ward_graph_sends_no_centres(spark, monkeypatch):
    """Its distances are known from the search; only sizes are joined to the edges."""
    from tallybench.plans import ward

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(40 + i, x[0].tolist()) for i in range(3)], "row_id long, features array<double>")
    monkeypatch.setattr(ward, "FINISH", 30)
    told, ends = [], ward._ends
    monkeypatch.setattr(ward, "_ends", lambda edges, clusters: told.append((clusters.columns, ends(edges, clusters))) or told[-1][1])
    heights = []
    monkeypatch.setattr(ward, "_merged", lambda edges: heights.append(edges.collect()) or edges.limit(11).select("a", "b", "height"))
    monkeypatch.setattr(ward, "_joined", lambda clusters, found: clusters)
    monkeypatch.setattr(ward, "_finish", lambda clusters: [])
    ward.merges(ward.Distinct(df, "row_id"), 4)
    assert told[0][0] == ["id", "size"]
    w = np.ones(40)
    w[0] = 4
    for r in heights[0]:
        assert r.height == pytest.approx(w[r.a] * w[r.b] / (w[r.a] + w[r.b]) * ((x[r.a] - x[r.b]) ** 2).sum(), rel=1e-12)


def test_ward_of_few_rows(blobs):
    from tallybench.plans import ward

    assert agreement(ward.ward(blobs, "row_id", 3), blobs) > 0.95
    assert ward.ward(blobs.limit(0), "row_id", 3).count() == 0
    assert ward.ward(blobs.limit(1), "row_id", 3).first()["cluster"] == 0
