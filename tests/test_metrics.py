import math
import random

import pytest
from pyspark.sql import functions as F

from tallybench.operators import classification as C, curves, regression as R, statistics as S


def preds(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int, score double").withColumn("g", F.lit(1))


def test_auc_ties_and_single_class(spark):
    tied = preds(spark, [(1, 1, 0.5), (0, 1, 0.5), (1, 1, 0.5), (0, 1, 0.5)])
    assert curves.binary_roc_auc(tied, ["g"]).first()["roc_auc"] == 0.5
    one = preds(spark, [(1, 1, 0.5), (1, 0, 0.2)])
    assert curves.binary_roc_auc(one, ["g"]).first()["roc_auc"] is None
    assert curves.binary_roc_auc(one, []).first()["roc_auc"] is None


def test_auc_of_negated_score_is_complement_and_partition_free(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), 0, rng.randint(0, 40) / 10) for _ in range(700)]
    df = preds(spark, rows)
    auc = curves.binary_roc_auc(df, []).first()[0]
    negated = curves.binary_roc_auc(df.withColumn("score", -F.col("score")), []).first()[0]
    assert math.isclose(auc + negated, 1.0, abs_tol=1e-12)
    assert math.isclose(curves.binary_roc_auc(df.repartition(13), []).first()[0], auc, abs_tol=1e-12)
    pos = [s for t, _, s in rows if t]
    neg = [s for t, _, s in rows if not t]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(auc, brute, abs_tol=1e-12)


def test_pr_auc_by_hand(spark):
    # Points from the top: (r .5, p 1), (r .5, p .5), (r 1, p 2/3); closing point (0, 1).
    df = preds(spark, [(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.7)])
    want = 0.5 * (1 + 1) / 2 + 0 + 0.5 * (0.5 + 2 / 3) / 2
    assert math.isclose(curves.pr_auc(df, []).first()[0], want, abs_tol=1e-12)


def test_mcc_conventions(spark):
    never = preds(spark, [(1, 0, 0.1), (0, 0, 0.2), (1, 0, 0.3)])
    row = C.binary_scores(never, []).first()
    assert (row["mcc"], row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0, 0.0)
    rows = [(0, 1, 0.0), (1, 1, 0.0), (2, 2, 0.0), (1, 0, 0.0), (2, 2, 0.0), (0, 0, 0.0)]
    a = C.summary_scores(preds(spark, rows), []).first()["mcc"]
    swap = {0: 2, 1: 0, 2: 1}
    b = C.summary_scores(preds(spark, [(swap[t], swap[p], s) for t, p, s in rows]), []).first()["mcc"]
    assert math.isclose(a, b, abs_tol=1e-12)


def test_chance_agreement_equals_accuracy_for_constant_prediction(spark):
    row = C.summary_scores(preds(spark, [(0, 0, 0.0), (1, 0, 0.0), (0, 0, 0.0), (2, 0, 0.0)]), []).first()
    assert math.isclose(row["chance_agreement"], row["accuracy"]) and row["accuracy"] == 0.5


def test_r2_of_constant_labels(spark):
    def r2(rows):
        return R.regression_scores(spark.createDataFrame(rows, "y_true double, y_pred double"), []).first()

    assert r2([(2.0, 2.0), (2.0, 2.0)])["r2"] == 1.0
    assert r2([(2.0, 2.0), (2.0, 3.0)])["r2"] == 0.0
    assert r2([(2.0, 3.0)])["pearson"] is None


def history(spark, vals):
    return spark.createDataFrame([(1, i, float(v), float(v) / 2) for i, v in enumerate(vals)],
                                 "run int, epoch long, val double, test double")


def loop(vals, patience, stop_first):
    best, left, bad = (-math.inf, -1), patience, 0
    for epoch, v in enumerate(vals):
        if v > best[0]:
            best, left, bad = (v, epoch), patience, 0
        else:
            left, bad = left - 1, bad + 1
        if (bad >= patience) if stop_first else (left < 0):
            return best[1], epoch, True
    return best[1], len(vals) - 1, False


def test_early_stopping_equals_the_loop(spark):
    rng = random.Random(3)
    cases = [[1, 1, 1, 1, 1, 1], list(range(9)), [3, 2, 4, 1, 1, 1, 9]]
    cases += [[rng.randint(0, 9) for _ in range(25)] for _ in range(3)]
    for vals in cases:
        for first in (False, True):
            got = S.early_stopping(history(spark, vals), 2, stop_first=first).first()
            assert (got["best_epoch"], got["last_epoch"], got["stopped_early"]) == loop(vals, 2, first)


def test_softmax_computes_its_input_once(spark):
    from tallybench.functions import logits
    rows = spark.createDataFrame([([[1.0, 3.0], [0.5, 0.0]],), ([[710.0, 0.0], [0.0, 0.0]],), (None,)], "m array<array<double>>")
    moved = F.transform("m", lambda v: F.transform(v, lambda x: x + 98765.0))
    out = rows.select(logits.ensemble_probability(moved).alias("p"), logits.cross_entropy(F.get(moved, 1), F.lit(0)).alias("loss"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("98765.0") == 2  # one for each column
    got = out.collect()
    e = [1 / (1 + math.exp(2)), 1 / (1 + math.exp(-0.5))]
    assert got[0]["p"] == pytest.approx([(e[0] + e[1]) / 2, 1 - (e[0] + e[1]) / 2])
    assert got[0]["loss"] == pytest.approx(-math.log(e[1]), abs=1e-9)
    assert got[1]["p"] == pytest.approx([0.75, 0.25]) and got[2]["p"] is None and got[2]["loss"] is None
