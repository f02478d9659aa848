"""Running sums over several partitions, one group over most of them."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybench.operators import curves, ordered, tables


@pytest.mark.parametrize("descending", [False, True])
def test_sums_of_hot_and_small_groups(spark, descending):
    draw = random.Random(1)
    rows = [("hot", i % 2 == 0, float(i), draw.randrange(9), draw.random(), f"t{i}", [i]) for i in range(3000)]
    rows += [(f"g{i % 40}", False, float(i) - 70, draw.randrange(9), draw.random(), "é", None) for i in range(160)]
    rows += [(None, True, 1.0, 1, 1.0, "x", None), ("g1", True, None, 1, 1.0, "x", None)]
    df = spark.createDataFrame(rows, "a string, b boolean, o double, n int, x double, text string, more array<int>").repartition(7)
    got = ordered.running_sums(df, ["a", "b"], "o", ["n", "x"], descending=descending).collect()
    groups = {}
    for r in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: r[2], reverse=descending):
        groups.setdefault(r[:2], []).append(r)
    want = {}
    for key, members in groups.items():
        for at, r in enumerate(members):
            want[key + (r[2],)] = (sum(m[3] for m in members[: at + 1]), sum(m[4] for m in members[: at + 1]), sum(m[3] for m in members), r[5], r[6])
    assert len(got) == len(want)
    for r in got:
        n, x, all_n, text, more = want[r.a, r.b, r.o]
        assert (r.cum_n, r.all_n, r.text, r.more) == (n, all_n, text, more) and r.cum_x == pytest.approx(x)
    assert {r.cum_n.__class__ for r in got} == {int}


def test_groups_of_one_and_no_group(spark):
    df = spark.createDataFrame([(i, 2) for i in range(500)], "k int, n int")
    assert all(r.cum_n == r.all_n == 2 for r in ordered.running_sums(df, ["k"], "n", ["n"]).collect())
    got = {r.k: (r.cum_n, r.all_n) for r in ordered.running_sums(df, [], "k", ["n"]).collect()}
    assert got == {i: (2 * i + 2, 1000) for i in range(500)}
    assert ordered.running_sums(df.limit(0), ["k"], "n", ["n"]).count() == 0


def test_renumbering_keeps_other_columns(spark):
    df = spark.range(4000).select((F.col("id") * 7 % 4001).alias("k"), (F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("text"))
    for r in tables.renumber(df, "k", "at", ["g"]).groupBy("g").agg(F.min("at"), F.max("at"), F.countDistinct("at"), F.count("*")).collect():
        assert r[1] == 0 and r[2] + 1 == r[3] == r[4]
    order = [r.at for r in tables.renumber(df, "k", "at").orderBy("k").collect()]
    assert order == list(range(4000))


def test_areas_equal_the_curve(spark):
    draw = np.random.default_rng(4)
    rows = [("m", int(draw.integers(2)), float(draw.integers(30)) / 30) for _ in range(2000)]
    rows += [("no positives", 0, float(i % 3)) for i in range(9)] + [("no negatives", 1, float(i % 3)) for i in range(9)]
    preds = spark.createDataFrame(rows, "model string, y_true int, score double")
    got = {r.model: (r.roc_auc, r.pr_auc) for r in curves.curve_areas(preds, ["model"]).collect()}
    for model, (roc, pr) in got.items():
        mine = [(y, s) for m, y, s in rows if m == model]
        pos, neg = [s for y, s in mine if y], [s for y, s in mine if not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert roc == (pytest.approx(want) if want is not None else None)
        points, recall0, precision0, area = sorted({s for _, s in mine}, reverse=True), 0.0, 1.0, 0.0
        for t in points:
            tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
            recall, precision = tp / len(pos) if pos else 1.0, tp / (tp + fp)
            area += (recall - recall0) * (precision + precision0) / 2
            recall0, precision0 = recall, precision
        assert pr == pytest.approx(area)
