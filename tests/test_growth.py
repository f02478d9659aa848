import itertools
import math

from pyspark.sql import functions as F

from tallybench.functions.growth import categorise
from tallybench.operators.pairs import RATE_COLUMNS, label_interactions

TOL = 0.001


def expected(a, b, c, d, e, f):
    """The rules written out, every comparison with NaN false."""
    if a + b + c + d + e + f < TOL:
        return 17
    if -TOL < c < TOL and -TOL < b < TOL:
        return 17
    if -TOL < f < TOL and -TOL < e < TOL:
        return 17
    if a < TOL and d < TOL and b > a + TOL and f > d + TOL:
        return 16
    if a < TOL:
        return 10 if f > d + TOL else 11 if d - TOL <= f <= d + TOL else 12
    if d < TOL:
        return 13 if b > a + TOL else 14 if a - TOL <= b <= a + TOL else 15

    def move(x, base):
        return "+" if x > base + TOL else "0" if base - TOL <= x <= base + TOL else (
            "-" if x < base - TOL else "?")

    codes = {"++": 1, "+0": 2, "0+": 3, "--": 4, "-0": 5, "0-": 6, "00": 7, "+-": 8, "-+": 9}
    return codes.get(move(b, a) + move(f, d), 17)


def test_all_branches_and_tolerance_edges(spark):
    solo = [0.0, TOL, 0.5]
    others = [0.0, 0.0005, TOL, 0.5 - TOL, 0.5, 0.5 + TOL, 1.0, math.nan]
    rows = [(a, b, c, d, e, f) for a, b, c, d, e, f in itertools.product(
        solo, others, [0.0, 0.4], solo, [0.0, 0.4], others)]
    rows += [(math.nan, 0.5, 0.5, 0.5, 0.5, 0.5), (0.5, 0.5, 0.5, math.nan, 0.5, 0.7)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in RATE_COLUMNS))
    got = df.withColumn("cat", categorise(*[F.col(c) for c in RATE_COLUMNS])).collect()
    want = [expected(*r) for r in rows]
    assert [r["cat"] for r in got] == want
    assert set(want) == set(range(1, 18))
    staged = label_interactions(df).select("category").collect()
    assert [r[0] for r in staged] == want


def test_strong_competition_needs_category_four(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.4, 0.5, 0.4, 0.2), (0.5, 0.3, 0.4, 0.5, 0.4, 0.2),
                                (0.5, 0.0, 0.4, 0.5, 0.4, 0.5)],
                               ", ".join(f"{c} double" for c in RATE_COLUMNS))
    rows = label_interactions(df).collect()
    assert [(r["category"], r["strong_competition"]) for r in rows] == [(4, True), (4, False), (5, False)]
