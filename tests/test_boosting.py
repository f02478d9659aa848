"""Boosting against plain loops, stage choice and written runs against SQL."""
import glob
import itertools
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybench.plans import attribution as A, boosting as B, runs as R, supervised as M


def table(spark, x, y, split=None):
    rows = [(i, [None if v != v else float(v) for v in r], float(t), "train" if i % 3 else "val" if i % 2 else "test") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, features array<double>, label double, split string").repartition(4)


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    return x, ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.15)).astype(int), (x[:, 0] > 0).astype(int) + (x[:, 2] > 0.4)


def parts(df):
    return [df.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


def test_the_first_tree_is_the_best_of_all_cuts(spark):
    x, y, _ = data(200)
    x = np.round(x)  # few values, so bins hold one value each
    model = B.boost(table(spark, x, y), rounds=1, rate=1.0, depth=1, l2=1.0)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = max(((g[x[:, f] <= c].sum() ** 2 / (h[x[:, f] <= c].sum() + 1) + g[x[:, f] > c].sum() ** 2 / (h[x[:, f] > c].sum() + 1), -f, -c)
                for f in range(5) for c in np.unique(x[:, f])[:-1]))
    f, c = int(model.feature[0, 0, 0]), float(model.cut[0, 0, 0])
    assert (f, c) == (-best[1], -best[2])
    left = x[:, f] <= c
    assert model.value[0, 0] == pytest.approx([-g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1)])


def test_losses_fall_and_written_margins_change_nothing(spark, monkeypatch):
    x, _, z = data()
    train, val, test = parts(table(spark, x, z))
    model = B.boost(train, train, "classes", rounds=7, rate=0.3, depth=3)
    assert model.best == 7 and all(a > b for a, b in zip(model.losses, model.losses[1:]))
    monkeypatch.setattr(B, "WRITTEN", 2)
    again = B.boost(train, train, "classes", rounds=7, rate=0.3, depth=3)
    assert np.allclose(again.losses, model.losses) and (again.feature == model.feature).all()
    rows = model.predict(test).toPandas()
    p = np.stack(rows["prob"])
    assert np.abs(p.sum(1) - 1).max() < 1e-12 and (p.argmax(1) == rows.y_pred).all() and (rows.y_true == rows.y_pred).mean() > 0.85
    margins = model.margins(np.stack([r.features for r in train.collect()]))[1]
    labels = np.array([r.label for r in train.collect()]).astype(int)
    e = np.exp(margins)
    assert -np.log(e[np.arange(len(e)), labels] / e.sum(1)).mean() == pytest.approx(model.losses[-1])


def test_growth_ends_when_the_loss_does_not_fall(spark):
    x, y, _ = data(300, 5)
    train, val, _ = parts(table(spark, x, np.random.default_rng(2).integers(0, 2, 300)))  # nothing to learn
    model = B.boost(train, val, watch="loss", rounds=200, rate=0.5, depth=3, patience=10)
    assert len(model.losses) < 60 and model.best == int(np.argmin(model.losses)) + 1


def test_the_chosen_stage_is_the_one_of_sql(spark, tmp_path):
    x, y, _ = data()
    train, val, _ = parts(table(spark, x, y))
    model = B.boost(train, val, rounds=12, rate=0.3, depth=2, watch="loss")
    whole = B.Boosted(**{**model.__dict__})
    whole.staged(val).select("row_id", "y_true", F.posexplode("stages").alias("stage", "score")).write.parquet(str(tmp_path / "stages"))
    sql = f"""WITH s AS (SELECT stage + 1 AS stage, y_true, score FROM '{tmp_path}/stages/*.parquet'),
      a AS (SELECT p.stage, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) AS auc
            FROM s p JOIN s n ON p.stage = n.stage AND p.y_true = 1 AND n.y_true = 0 GROUP BY p.stage)
      SELECT stage, auc FROM a ORDER BY auc DESC, stage LIMIT 1"""
    (stage, auc), = duckdb.sql(sql).fetchall()
    areas = B.stage_areas(whole, val)
    assert B.best_stage(areas) == stage
    assert areas.filter(F.col("stage") == stage).first()["roc_auc"] == pytest.approx(auc)


def test_values_and_missing_cells(spark):
    x, _, _ = data()
    v = 3 * x[:, 0] + x[:, 1] ** 2
    x[::7, 4] = np.nan
    train, val, test = parts(table(spark, x, v))
    model = B.boost(train, val, "values", rounds=25, rate=0.3, depth=3)
    rows = model.predict(test).toPandas()
    assert ((rows.y_true - rows.y_pred) ** 2).mean() < 0.2 * v.var()


def test_models_are_read_back(spark, tmp_path):
    x, y, _ = data()
    train, val, test = parts(table(spark, x, y))
    model = B.boost(train, val, rounds=6, rate=0.3, depth=2)
    model.save(spark, str(tmp_path / "m"))
    again = B.Boosted.load(spark, str(tmp_path / "m"))
    a, b = (m.predict(test).orderBy("row_id").collect() for m in (model, again))
    assert a == b and again.best == model.best


def test_a_written_run_equals_sql_over_its_predictions(spark, tmp_path):
    x, y, _ = data()
    models = {"boosted": lambda train, val: B.boost(train, val, rounds=5, rate=0.3, depth=2), "logistic": M.logistic()}
    folder = R.run(table(spark, x, y), models, str(tmp_path), "one")
    assert R.finished(spark, folder)["models"] == ["boosted", "logistic"]
    want = {(s, m): (acc, rec) for s, m, acc, rec in duckdb.sql(f"""SELECT split, model, avg((y_true = y_pred)::INT),
        sum((y_true = 1 AND y_pred = 1)::INT) / sum((y_true = 1)::INT) FROM read_parquet('{folder}/predictions/*/*.parquet', hive_partitioning = true) GROUP BY ALL""").fetchall()}
    for split in ("val", "test"):
        (file,) = glob.glob(f"{folder}/metrics/split={split}/*.txt")
        told = json.load(open(file))
        for model in models:
            assert (told[model]["Accuracy"], told[model]["Recall"]) == pytest.approx(want[split, model])
    read = {(r.split, r.model, r.metric): r.value for r in R.read_metrics(spark, folder).collect()}
    assert read["test", "boosted", "Accuracy"] == pytest.approx(want["test", "boosted"][0]) and len(read) == 2 * 2 * 7
    with pytest.raises(Exception):
        R.run(table(spark, x, y), models, str(tmp_path), "one")  # a run id is used once


def test_an_unfinished_run_is_not_read(spark, tmp_path):
    def broken(train, val):
        raise RuntimeError("lost")

    x, y, _ = data(60)
    with pytest.raises(RuntimeError):
        R.run(table(spark, x, y), {"broken": broken}, str(tmp_path), "two")
    with pytest.raises(FileNotFoundError):
        R.read_metrics(spark, str(tmp_path / "two"))


def expectation(model, counts, r, c, x, known):
    """What a tree expects when only the features in ``known`` are known."""
    def below(node):
        inner = len(model.feature[r, c])
        return counts[r, c][node - inner] if node >= inner else below(2 * node + 1) + below(2 * node + 2)

    def value(node):
        inner = len(model.feature[r, c])
        if node >= inner:
            return model.value[r, c][node - inner]
        f = model.feature[r, c][node]
        left, right = 2 * node + 1, 2 * node + 2
        if f < 0:
            return value(left)
        if f in known:
            return value(left) if x[f] <= model.cut[r, c][node] else value(right)
        share = below(left) / below(node) if below(node) else 0.5
        return share * value(left) + (1 - share) * value(right)

    return value(0)


@pytest.mark.parametrize("objective", ["binary", "classes"])
def test_tree_values_equal_enumeration(spark, objective):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int) + ((x[:, 3] > 0.5) if objective == "classes" else 0)
    df = table(spark, x, y)
    model = B.boost(df, objective=objective, rounds=4, rate=0.4, depth=4)
    few = df.filter("row_id < 6")
    values, base = A.tree_shapley(model, few, df)
    got = {(r.row_id, r["class"], r.feature): r.value for r in values.collect()}
    assert len(got) == 6 * len(model.start) * 8
    counts = A.leaf_counts(model, df)
    assert counts.sum(axis=2).min() == counts.sum(axis=2).max() == 400
    subsets = [frozenset(s) for k in range(9) for s in itertools.combinations(range(8), k)]
    for i in range(6):
        for c in range(len(model.start)):
            game = {s: sum(expectation(model, counts, r, c, x[i], s) for r in range(4)) for s in subsets}
            for f in range(8):
                want = sum(math.factorial(len(s)) * math.factorial(7 - len(s)) / math.factorial(8) * (game[s | {f}] - game[s]) for s in subsets if f not in s)
                assert got[i, c, f] == pytest.approx(want, abs=1e-10)
            total = sum(got[i, c, f] for f in range(8))
            assert total + base[c] == pytest.approx(model.margins(x[i: i + 1])[1][0, c], abs=1e-10)
