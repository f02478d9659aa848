import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallybench.operators import blocks, clustering as C, descent, generative as G, neighbours as N


@pytest.fixture(params=[2048, 8])
def block(request, monkeypatch):
    """Once as a single block, once as many pivots, cells and tiles."""
    monkeypatch.setattr(N, "BLOCK_ROWS", request.param)
    return request.param


def dist(x, y=None):
    y = x if y is None else y
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))


def test_knn_graph_is_exact_with_copies(points, block):
    df, x = points
    d = dist(x)
    got = {}
    for r in N.knn_graph(df.select("row_id", "features"), "row_id", 5).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in order]


def test_kth_distance_counts_the_row_itself(points, block):
    df, x = points
    want = np.sort(dist(x), axis=1)[:, 4]
    got = {r[0]: r[1] for r in N.kth_distance(df, "row_id", 5).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


def test_nearest_hamming(points, spark, block):
    _, x = points
    bits = (x > 0).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(bits)],
                               "row_id long, features array<double>")
    a, b = df.filter("row_id % 2 = 0"), df.filter("row_id % 2 = 1")
    h = (bits[:, None] != bits[None]).mean(-1)
    for r in N.nearest_in(a, b, "row_id", "hamming").collect():
        want = min((h[r[0], j], j) for j in range(1, len(x), 2))
        assert (r["distance"], r["nearest"]) == want


def test_nearest_of_other_values(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [5.0, 3.0])],
                               "row_id long, features array<double>")
    out = N.nearest_in(df.filter("row_id = 0"), df.filter("row_id > 0"), "row_id", "hamming").first()
    assert (out["nearest"], out["distance"]) == (1, 0.5)


def test_sums_diameter_and_silhouette(points, block):
    df, x = points
    d = dist(x)
    got = {r[0]: r["total"] for r in N.distance_summary(df, "row_id").collect()}
    assert np.allclose([got[i] for i in range(len(x))], d.sum(1), atol=1e-5)
    assert abs(N.diameter(df, "row_id").first()[0] - d.max()) < 1e-6
    labels = np.array([r["cluster"] for r in df.orderBy("row_id").collect()])
    scores = []
    for i in range(len(x)):
        own = labels == labels[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        scores.append((b - a) / max(a, b) if own.sum() > 1 else 0.0)
    assert abs(C.silhouette(df, "row_id").first()[0] - np.mean(scores)) < 1e-6


def test_singleton_cluster_scores_zero(spark):
    df = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [9.0], 1)],
                               "row_id long, features array<double>, cluster int")
    rows = {r["rep"]: r["silhouette"] for r in C.silhouette_rows(df, "row_id").collect()}
    assert rows[2] == 0.0 and rows[0] == pytest.approx(8 / 9)


@pytest.mark.parametrize("rows, want", [
    ([(0, [0.0], 0), (1, [1.0], 0)], 0.0),                                    # one cluster
    ([(0, [0.0], 0), (1, [0.0], 0), (2, [4.0], 1), (3, [4.0], 1)], 1.0),      # no inner spread
    ([(0, [-1.0], 0), (1, [1.0], 0), (2, [-2.0], 1), (3, [2.0], 1)], 0.0),    # same centroids
    ([(0, [0.0], 0), (1, [2.0], 0), (2, [10.0], 1), (3, [12.0], 1), (4, [22.0], -1)],
     10 / 22 * (1 - 1 / 22)),                                                 # noise sets the span
])
def test_dcsi_branches(spark, rows, want):
    df = spark.createDataFrame(rows, "row_id long, features array<double>, cluster int")
    assert C.dcsi(df, "row_id").first()[0] == pytest.approx(want)


def test_methods_are_compared_with_one_diameter(points, spark, monkeypatch):
    df, x = points
    calls, searched = [], C.diameter
    monkeypatch.setattr(C, "diameter", lambda *a: calls.append(a) or searched(*a))
    label = lambda f: df.select("row_id", f.cast("int").alias("cluster"))
    id3, id2 = F.col("row_id") % 3, F.col("row_id") % 2
    tables = {"three": label(id3), "two": label(id2), "one": label(F.lit(0)), "some": label(id2).filter("row_id < 30")}
    got = {r["method"]: r for r in C.compare_methods(df, tables, "row_id").collect()}
    assert set(got) == {"three", "two", "some"} and len(calls) == 2
    for name in got:
        each = df.select("row_id", "features").join(tables[name], "row_id")
        assert got[name]["dcsi"] == pytest.approx(C.dcsi(each, "row_id").first()[0])
        assert got[name]["silhouette"] == pytest.approx(C.silhouette(each, "row_id").first()[0])
    assert C.compare_methods(df, {"one": tables["one"]}, "row_id").count() == 0


def test_graph_and_distance_come_from_one_search(points, block, monkeypatch):
    df = points[0].select("row_id", "features")
    graph, dist = N.knn_graph(df, "row_id", 15).collect(), N.kth_distance(df, "row_id", 5).collect()
    searches, join = [], N.knn_join
    monkeypatch.setattr(N, "knn_join", lambda *a: searches.append(1) or join(*a))
    one, other = N.knn_graph_with_distance(df, "row_id", 15, 5)
    assert sorted(one.collect()) == sorted(graph) and sorted(other.collect()) == sorted(dist) and len(searches) == 1


def test_a_tile_gives_the_sums_of_both_sides():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)) + 1e3, rng.normal(size=(30, 3)) + 1e3
    y[0] = x[0]

    def side(name, vectors, values, clusters, first):
        return pd.DataFrame({name: np.arange(len(values)) + first, vectors: list(values), "method": [np.array([7])] * len(values),
                             "cluster": [np.array([c]) for c in clusters], "copies": [np.array([2])] * len(values)})

    a, b = np.arange(40) % 2, np.arange(30) % 3
    left, right = side("q", "query_vector", x, a, 0), side("c", "row_vector", y, b, 100)
    out = blocks.distance_sums("euclidean")(left.assign(block=0, other=1), right)
    got = {(r.q, r.cluster): r.total for r in out.itertuples()}
    d = dist(x, y)
    assert len(got) == 40 * 3 + 30 * 2 and set(out["method"]) == {7}
    assert all(got[i, c] == pytest.approx(2 * d[i, b == c].sum(), rel=1e-12) for i in range(40) for c in range(3))
    assert all(got[100 + j, c] == pytest.approx(2 * d[a == c, j].sum(), rel=1e-12) for j in range(30) for c in range(2))


@pytest.mark.parametrize("spread", [1.0, 1e-5, 1e-160, 1e200])
def test_single_precision_only_rules_out(spread):
    """Tight clusters far apart: what single precision cannot tell apart is compared in double precision."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(600, 5)) * spread + np.repeat([[0.0] * 5, [1.0] * 5], 300, axis=0)) * (1.0 if spread < 1e100 else 1e-250)
    d = dist(x)
    left = pd.DataFrame({"q": np.arange(600), "query_vector": list(x)})
    right = pd.DataFrame({"c": np.arange(600), "row_vector": list(x)})
    out = blocks.nearest(7, "euclidean")(left, right).sort_values(["q", "distance", "c"])
    want = [sorted((d[i, j], j) for j in range(600))[:7] for i in range(600)]
    assert np.allclose(out["distance"].to_numpy().reshape(600, 7), [[v for v, _ in row] for row in want], rtol=1e-12, atol=0)
    assert blocks.farthest("euclidean")(left, right)["distance"].iloc[0] == pytest.approx(d.max(), rel=1e-12)


def test_methods_are_compared_in_one_pass(points, spark, monkeypatch):
    rows, x = points
    passes, sums = [], N._sums_to
    monkeypatch.setattr(N, "_sums_to", lambda *a: passes.append(1) or sums(*a))
    other = rows.select("row_id", (F.col("row_id") % 2).cast("int").alias("cluster"))
    part = rows.filter("row_id % 5 > 0").select("row_id", (F.col("row_id") % 4).cast("int").alias("cluster"))
    methods = {"own": rows.select("row_id", "cluster"), "other": other, "part": part, "one": other.withColumn("cluster", F.lit(0))}
    got = {r["method"]: r["silhouette"] for r in C.compare_methods(rows, methods, "row_id").collect()}
    assert len(passes) == 1 and set(got) == {"own", "other", "part"}
    for name, value in got.items():
        labelled = rows.select("row_id", "features").join(methods[name], "row_id")
        assert value == pytest.approx(C.silhouette(labelled, "row_id").first()[0], abs=1e-9)


def test_beta_recall_equals_brute_force(points, spark):
    df, x = points
    rng = np.random.default_rng(3)
    y = x[rng.integers(0, len(x), 40)] + rng.normal(scale=0.3, size=(40, 4))
    fake = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(y)],
                                 "row_id long, features array<double>")
    real = df.select("row_id", "features")
    levels = np.linspace(0, 1, 30)
    cross, own = dist(x, y), dist(x)
    np.fill_diagonal(own, np.inf)
    near = cross.argmin(1)
    depth = np.linalg.norm(y[near] - y.mean(0), axis=1)
    q = np.quantile(depth, levels)
    ok = cross.min(1) <= own.min(1)
    b = np.array([(ok & (depth <= r)).mean() for r in q])
    want = 1 - np.abs(levels - b).sum() / levels.sum()
    assert G.beta_recall(real, fake, "row_id").first()[0] == pytest.approx(want, abs=0.02)
    d_real = np.linalg.norm(x - x.mean(0), axis=1)
    p = np.array([(np.linalg.norm(y - x.mean(0), axis=1) <= r).mean() for r in np.quantile(d_real, levels)])
    want = 1 - np.abs(levels - p).sum() / levels.sum()
    assert G.alpha_precision(real, fake).first()[0] == pytest.approx(want, abs=0.02)


def test_rows_on_a_line_form_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=300).round(2) + 1e7, [5.0], np.full(20, 1e7)])
    df = spark.createDataFrame([(int(i), [float(v)]) for i, v in enumerate(x)], "row_id long, features array<double>")

    def none(*_, **__):
        raise AssertionError("pairs of rows")

    monkeypatch.setattr(N, "_tiled", none)
    monkeypatch.setattr(N, "BLOCK", 16)  # blocks of places overlap
    d = np.abs(x[:, None] - x[None])
    got = {r["row_id"]: r for r in N.distance_summary(df, "row_id").collect()}
    assert np.allclose([got[i]["total"] for i in range(len(x))], d.sum(1), rtol=1e-12, atol=1e-6)
    assert np.allclose([got[i]["mean"] for i in range(len(x))], d.sum(1) / (len(x) - 1), rtol=1e-12, atol=1e-8)
    for k in (1, 2, 5, 30):
        far = {r[0]: r[1] for r in N.kth_distance(df, "row_id", k).collect()}
        assert [far[i] for i in range(len(x))] == pytest.approx(np.sort(d, axis=1)[:, k - 1])


def test_few_rows_on_a_line(spark):
    schema = "row_id long, features array<double>"
    same = spark.createDataFrame([(1, [2.0]), (2, [2.0])], schema)
    assert [tuple(r) for r in N.distance_summary(same, "row_id").orderBy("row_id").collect()] == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert [tuple(r) for r in N.kth_distance(same, "row_id", 2).orderBy("row_id").collect()] == [(1, 0.0), (2, 0.0)]
    one = N.distance_summary(same.limit(1), "row_id").first()
    assert one["total"] == 0.0 and one["mean"] is None
    assert N.distance_summary(same.limit(0), "row_id").count() == 0 and N.kth_distance(same.limit(0), "row_id", 2).count() == 0
    odd = spark.createDataFrame([(1, [2.0]), (2, [None]), (3, [4.0])], schema)
    assert [r["total"] for r in N.distance_summary(odd, "row_id").orderBy("row_id").collect()] == [2.0, None, 2.0]


@pytest.mark.parametrize("metric", ["euclidean", "hamming"])
def test_many_dimensions_send_a_row_to_few_tiles(spark, metric, monkeypatch):
    """Cells rule out nothing here; as many tiles as cells would be sent otherwise."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "FIRST_PAIRS", 4)
    monkeypatch.setattr(N, "GRID", 4)
    monkeypatch.setattr(blocks, "SIDE", 32)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 30))
    x[:40] = x[0]
    if metric == "hamming":
        x = (x > 0).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    sides, tiled = [], N._tiled

    def seen(queries, rows, q_blocks, c_blocks, run, schema):
        sides.append((max(q_blocks), max(c_blocks)))
        return tiled(queries, rows, q_blocks, c_blocks, run, schema)

    monkeypatch.setattr(N, "_tiled", seen)
    d = dist(x) if metric == "euclidean" else (x[:, None] != x[None]).mean(-1)
    lists = {}
    for r in N.knn_graph(df, "row_id", 6, metric).collect():
        lists.setdefault(r["i"], []).append((r["rank"], r["j"], r["distance"]))
    assert sides[-1] == (4, 4)  # the grid, and no larger one
    for i in range(len(x)):
        order = sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:6]
        assert [(round(v, 9), j) for _, j, v in sorted(lists[i])] == order
    totals = {r["row_id"]: r["total"] for r in N.distance_summary(df, "row_id", metric).collect()}
    assert np.allclose([totals[i] for i in range(len(x))], d.sum(1)) and sides[-1] == (4, 4)
    got = N.farthest_search(df, "row_id", metric).first()
    assert got.diameter == pytest.approx(d.max(), rel=1e-12)


@pytest.mark.parametrize("far", [False, True])
def test_a_crowded_cell_sends_a_row_to_few_tiles(spark, far, monkeypatch):
    """Nearly all rows are nearest to one pivot; a cell's blocks would grow with its rows."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N._block_counts, "__defaults__", (16,))
    monkeypatch.setattr(N, "GRID", 4)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 3))
    x[:21] = [[0.0, 0, 0], *[[50.0 + i, 0, 0] for i in range(20)]]
    monkeypatch.setattr(N, "_pick_pivots", lambda rows, count: x[:21])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    sides, tiled = [], N._tiled

    def seen(queries, rows, q_blocks, c_blocks, run, schema):
        sides.append((max(q_blocks), max(c_blocks)))
        return tiled(queries, rows, q_blocks, c_blocks, run, schema)

    monkeypatch.setattr(N, "_tiled", seen)
    d = dist(x)
    if far:
        assert N.diameter(df, "row_id").first()[0] == pytest.approx(d.max(), rel=1e-12)
    else:
        got = {r["row_id"]: r["distance"] for r in N.kth_distance(df, "row_id", 4).collect()}
        assert np.allclose([got[i] for i in range(800)], np.sort(d, axis=1)[:, 3])
    assert sides and max(max(s) for s in sides) <= 4


def test_beta_recall_searches_once(points, monkeypatch):
    """Radii and shares read one written table; each used to run both searches."""
    df, _ = points
    rows = df.select("row_id", "features")
    plan = G.beta_recall(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1"), "row_id")
    assert "CoGroup" not in plan._jdf.queryExecution().toString()


def test_visits_go_out_a_few_rows_at_a_time(monkeypatch):
    monkeypatch.setattr(blocks, "SENT", 8)
    rng = np.random.default_rng(9)

    class Shared:
        def __init__(self, value):
            self.value = value

    rows = pd.DataFrame({"q": range(50), "features": list(rng.normal(size=(50, 3))), "cell": 0, "bound": np.inf})
    run = blocks.visits(Shared(rng.normal(size=(20, 3))), Shared(np.ones(20)), "euclidean")
    sent = [len(f) for f in run([rows])]
    assert max(sent) <= 8 and sum(sent) == 50 * 19


@pytest.mark.parametrize("offset", [0.0, 1e5, 1e8])
def test_distances_do_not_depend_on_the_origin(spark, offset, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    x = np.random.default_rng(3).normal(size=(600, 2)).round(4) + offset
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    d = dist(x)
    totals = {r["row_id"]: r["total"] for r in N.distance_summary(df, "row_id").collect()}
    assert np.allclose([totals[i] for i in range(600)], d.sum(1), rtol=1e-9)
    assert N.diameter(df, "row_id").first()[0] == pytest.approx(d.max(), rel=1e-12)
    lists = {}
    for r in N.knn_graph(df, "row_id", 3).collect():
        lists.setdefault(r["i"], []).append((r["rank"], r["j"]))
    for i in range(600):
        order = sorted((d[i, j], j) for j in range(600) if j != i)[:3]
        assert [j for _, j in sorted(lists[i])] == [j for _, j in order]


def test_fewer_rows_than_asked_for(points):
    df, _ = points
    with pytest.raises(ValueError):
        N.kth_distance(df.limit(3), "row_id", 5)
    assert N.knn_graph(df.limit(0), "row_id", 2).count() == 0


def recall(df, k, metric="euclidean", **more):
    """Share of the exact lists, made by SQL, that the approximate ones hold."""
    got = descent.knn_graph_approximate(df, "row_id", k, metric, **more).toPandas()
    rows = df.select("row_id", "features").toPandas()
    rows["features"] = rows["features"].map(list)
    con = duckdb.connect()
    con.register("rows", rows)
    con.register("got", got)
    apart = ("list_sum(list_transform(list_zip(a.features, b.features), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" if metric == "euclidean"
             else "list_sum(list_transform(list_zip(a.features, b.features), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))")
    hits, links = con.execute(f"""
      WITH exact AS (SELECT i, j, d FROM (SELECT a.row_id AS i, b.row_id AS j, {apart} AS d,
          row_number() OVER (PARTITION BY a.row_id ORDER BY {apart}, b.row_id) AS k FROM rows a JOIN rows b ON a.row_id <> b.row_id) WHERE k <= {k})
      SELECT count(got.j), count(*) FROM exact LEFT JOIN got USING (i, j)""").fetchone()
    assert got.groupby("i")["rank"].agg(list).map(lambda x: sorted(x) == list(range(1, len(x) + 1))).all()
    return hits / links


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "copies", "line"])
def test_approximate_lists_hold_the_exact_ones(spark, kind, monkeypatch):
    monkeypatch.setattr(descent, "START_ROWS", 32)  # rounds have work to do
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    if kind == "clusters":
        x = 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.3 * x
    elif kind == "copies":
        x[300:600] = x[0]  # a third of the rows
        x[600:700] = x[1]
    elif kind == "line":
        x = np.arange(900.0)[:, None] ** 1.1 + 1e6
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    assert recall(df, 8) >= 0.95


def test_rounds_send_codes_where_they_are_fine_enough():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 64)) + 100
    near = np.where(np.arange(50) < 30, 9.0, 0.05)  # of the others bytes cannot tell the neighbours apart
    near[40:] = 1e-9
    x[0, 0] = np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(near)], ["q", "features", "near"])
    centre = np.full(64, 100.0)
    (out,) = descent._codes(centre, "euclidean")([batch])
    sizes = [len(c) for c in out.column(1).to_pylist()]
    assert sizes[0] == 512 and sizes[1:30] == [8 + 64] * 29 and sizes[30:40] == [8 + 128] * 10 and sizes[40:] == [512] * 10
    back, error = descent._decoded(out.column(1), centre), out.column(2).to_numpy()
    gap = np.sqrt(((back - x) ** 2).sum(1))
    assert (gap[1:] <= error[1:]).all() and (error <= descent.COARSE * near).all() and (back[40:] == x[40:]).all()
    assert np.array_equal(descent._decoded(out.column(1).slice(25, 20), centre), back[25:45])
    (bits,) = descent._codes(centre, "hamming")([batch])
    assert set(map(len, bits.column(1).to_pylist())) == {512}


def test_approximate_distances_are_exact_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(descent, "START_ROWS", 32)
    monkeypatch.setattr(descent, "COARSE", 0.2)  # all rows are sent as codes of a byte a number
    x = np.random.default_rng(9).normal(size=(400, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    d = dist(x)
    for r in descent.knn_graph_approximate(df, "row_id", 5).collect():
        assert r.distance == pytest.approx(d[r.i, r.j], rel=1e-12)


def test_approximate_lists_of_bits_and_small_tables(spark):
    rng = np.random.default_rng(6)
    bits = [(i, r.tolist()) for i, r in enumerate(rng.integers(0, 2, (300, 40)).astype(float))]
    schema = "row_id long, features array<double>"
    got = descent.knn_graph_approximate(spark.createDataFrame(bits, schema), "row_id", 5, "hamming").groupBy("i").count().collect()
    assert len(got) == 300 and all(r["count"] == 5 for r in got)
    for n in (0, 1, 2, 4):
        few = spark.createDataFrame(bits[:n], schema)
        assert descent.knn_graph_approximate(few, "row_id", 3).count() == n * max(0, min(3, n - 1))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], schema)
    assert [(r.i, r.j) for r in descent.knn_graph_approximate(same, "row_id", 2).orderBy("i", "rank").collect()][:4] == [(0, 1), (0, 2), (1, 0), (1, 2)]


@pytest.mark.parametrize("kind", ["clusters", "gaussian", "sphere", "bits", "line"])
def test_the_diameter_rules_out_most_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    monkeypatch.setattr(N, "FIRST_PAIRS", 4)
    rng = np.random.default_rng(7)
    x, metric = rng.normal(size=(1600, 3)), "euclidean"
    if kind == "clusters":
        x = 20 * rng.normal(size=(40, 3))[rng.integers(0, 40, 1600)] + x
    elif kind == "sphere":
        x = x / np.linalg.norm(x, axis=1)[:, None] + 1e6
    elif kind == "bits":
        x, metric = (x[:, :1] + rng.normal(size=(1600, 24)) > 0).astype(float), "hamming"
    elif kind == "line":
        x = x[:, :1] * np.array([[1.0, 2.0, -1.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, features array<double>")
    d = dist(x) if metric == "euclidean" else (x[:, None] != x[None]).mean(-1)
    got = N.farthest_search(df, "row_id", metric).first()
    assert got.diameter == pytest.approx(d.max(), rel=1e-12)
    if kind in ("clusters", "gaussian", "line"):
        assert got.compared < got.rows ** 2 / 20


def test_the_diameter_of_few_rows(spark):
    schema = "row_id long, features array<double>"
    assert N.diameter(spark.createDataFrame([], schema), "row_id").first()[0] is None
    assert N.diameter(spark.createDataFrame([(1, [2.0]), (2, [2.0])], schema), "row_id").first()[0] == 0.0
    assert N.diameter(spark.createDataFrame([(1, [2.0]), (2, [5.0])], schema), "row_id").first()[0] == 3.0
