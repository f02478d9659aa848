import numpy as np
import pytest
from pyspark.sql import functions as F

import tallybench.catalog  # noqa: F401  (registers the queries)
from tallybench.catalog.registry import QUERIES
from tallybench.functions import encode
from tallybench.operators import ordered, pairs, scaling, tables as T


def test_split_sizes_disjoint_and_partition_free(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    a = {r[0]: r[1] for r in T.train_val_test_split(df, "row_id").collect()}
    b = {r[0]: r[1] for r in T.train_val_test_split(df.repartition(7), "row_id").collect()}
    assert a == b and len(a) == 101
    counts = {s: list(a.values()).count(s) for s in ("train", "val", "test")}
    assert counts == {"train": 60, "val": 20, "test": 21}


def test_stratified_split_rounds_up_in_every_stratum(spark):
    df = spark.range(33).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    rows = T.stratified_split(df, "row_id", ["y"]).filter("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in rows} == {0: 6, 1: 1}


def test_unknown_kind_adds_no_column_and_concat_checks_types(spark):
    df = spark.range(3)
    assert T.assign_label(df, "else").columns == ["id"]
    with pytest.raises(ValueError):
        T.concat_rows([df, [1, 2]])


def test_exact_quantiles_with_ties_and_single_row(spark):
    rng = np.random.default_rng(2)
    groups = {1: rng.integers(0, 5, 200).astype(float), 2: rng.normal(size=77), 3: np.array([4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    got = ordered.exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 7).collect()
    assert len(got) == 21
    for r in got:
        want = np.quantile(groups[r["k"]], r["level_index"] / 6)
        assert abs(r["quantile"] - want) < 1e-12


def test_running_sums_of_a_skewed_group(spark):
    rows = [(0, float(i)) for i in range(500)] + [(k, 1.0) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "k int, v double").withColumn("one", F.lit(1).cast("long"))
    out = ordered.running_sums(df, ["k"], "v", ["one"]).collect()
    assert all(r["cum_one"] == (r["v"] + 1 if r["k"] == 0 else 1) for r in out)
    assert all(r["all_one"] == (500 if r["k"] == 0 else 1) for r in out)


def test_quantile_normal_and_inverse_normal(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(encode.inverse_normal(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)
    x = np.random.default_rng(5).exponential(size=300)
    rows = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "row_id long, features array<double>")
    out = {r[0]: r[1][0] for r in scaling.quantile_normal(rows, "row_id", 50).collect()}
    values = np.array([out[i] for i in range(300)])
    assert abs(np.median(values)) < 0.05 and (np.argsort(values[np.argsort(x)]) == np.arange(300)).mean() > 0.99


def test_standard_scale_of_a_constant_position(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "row_id long, features array<double>")
    out = {r[0]: list(r["features"]) for r in scaling.standard_scale(df).collect()}
    assert out == {0: [-1.0, 0.0], 1: [1.0, 0.0]}


def test_sample_larger_than_population_takes_all(spark):
    candidates = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "env int, compound int")
    essential = spark.createDataFrame([(9,)], "compound int")
    out = pairs.sample_environments(candidates, essential, 10, 1).select("env", "compound").collect()
    assert sorted((r[0], r[1]) for r in out) == [(0, 1), (0, 2), (0, 9), (1, 1), (1, 9)]


def test_pair_matrix_equals_dense_blocks(spark):
    entries = [(1, "ext", 0, 0, 2.0), (1, "int", 1, 1, 3.0), (2, "ext", 1, 0, 5.0), (2, "int", 0, 2, 7.0)]
    coo = spark.createDataFrame(entries, "microbe int, compartment string, row int, col long, value double")
    sizes = spark.createDataFrame([(1, 2), (2, 3)], "microbe int, n_reactions long")
    one = spark.createDataFrame([(1, 2)], "m1 int, m2 int")
    got = {(r["row"], r["col"]): r["value"] for r in pairs.pair_matrix(one, coo, sizes, 2, 2).collect()}
    assert got == {(0, 0): 2.0, (2, 0): 2.0, (1, 2): 5.0, (3, 2): 5.0, (5, 1): 3.0, (6, 4): 7.0}
    senses = [r["sense"] for r in pairs.pair_constraints(spark, 2, 2).orderBy("row").collect()]
    assert "".join(senses) == ">><<====>"


def test_feature_sums_of_written_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(7, [0.5, 2.0], 6), (8, [-1.0, 1.0], 9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([("A", 1.0, 0.1, 0.2), ("A", 2.0, 0.0, 0.3), ("R", 5.0, 0.25, 0.0)],
                          "l_returnflag string, l_quantity double, l_discount double, l_tax double").write.parquet(f"{d}/lineitem.parquet")
    rows = {r["row_id"]: r for r in QUERIES["p5_features_and_label"](spark, d).collect()}
    assert [(rows[i]["label"], rows[i]["feature_sum"], rows[i]["width"]) for i in (7, 8)] == [(1, 2.5, 2), (4, 0.0, 2)]
    got = {r["l_returnflag"]: (r["n"], r["cells"]) for r in QUERIES["p10_feature_vector"](spark, d).collect()}
    assert got == {"A": (2, 3.6), "R": (1, 5.25)}
