"""Whitening against numpy's own eigenvectors and exact whole-number sums."""
import numpy as np
import pytest

from tallybench.llm import whitening


def table(spark, vectors, kind="float", ids=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "x", [1]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component string, n array<int>").repartition(3)


def check(rows, vectors, limit):
    """``vectors``: the usable ones by id, as Spark holds them."""
    x = {i: np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000 for i, v in vectors.items()}
    n, sums = len(x), sum(x.values())
    mean = sums / n
    away = np.array([v - mean for v in x.values()])
    cov = away.T @ away / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:limit] > 1e-12 * np.trace(cov) / len(mean)).sum())
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    place = {i: p for p, i in enumerate(x)}
    for c in range(k):
        column = np.array([got[i, c + 1].whitened for i in x])
        alone = all(abs(values[c] - values[o]) > 1e-6 * values[0] for o in range(len(values)) if o != c)
        if alone:
            want = away @ axes[:, c] / np.sqrt(values[c])
            assert min(np.abs(column - want).max(), np.abs(column + want).max()) < 1e-6
    for (i, c), r in got.items():
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert r.explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-6)
        assert r.identity_error < 1e-6
    assert place


def test_ordinary_vectors_and_bad_ones(spark):
    draw = np.random.default_rng(1)
    good = (draw.standard_normal((300, 40)) * np.linspace(3, 0.2, 40) @ draw.standard_normal((40, 40))).astype(np.float32)
    vectors = [list(map(float, v)) for v in good]
    vectors[7] = vectors[8] = vectors[9]
    bad = [None, [], [1.0] * 39 + [None], [float("nan")] + [0.0] * 39, [float("inf")] + [1.0] * 39, [0.0] * 39]
    rows = whitening.whitened(table(spark, vectors + bad)).collect()
    check(rows, dict(enumerate(vectors)), 32)


def test_few_dimensions_ties_and_flat_ones(spark):
    draw = np.random.default_rng(2)
    square = [[a, b, 5.0, -a] for a in (-1.0, 1.0) for b in (-1.0, 1.0)] * 10  # two equal variances, one flat, one repeated
    rows = whitening.whitened(table(spark, square, "double")).collect()
    check(rows, dict(enumerate(square)), 32)
    assert len({r.component for r in rows}) == 2
    line = [[v] for v in draw.standard_normal(50)]
    check(whitening.whitened(table(spark, line, "double")).collect(), dict(enumerate(line)), 32)


def test_large_entries_stay_exact(spark):
    vectors = [[2e5 * i, -3e3 * i * i, 0.5 * (i % 3)] for i in range(20)]  # beyond 2**62 / (n^2 d) in the fast way
    check(whitening.whitened(table(spark, vectors, "double")).collect(), dict(enumerate(vectors)), 32)
    far = whitening.whitened(table(spark, [[1e30, 0.0], [-1e30, 1.0], [0.0, 2.0]], "double")).collect()
    assert sorted(r.deviation is None for r in far) == [False, True, True] and max(r.identity_error for r in far) < 1e-6


def test_nothing_varies_or_nothing_is_there(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        out = whitening.whitened(table(spark, vectors))
        assert out.count() == 0 and out.columns[0] == "vec_id"


def test_null_and_repeated_ids(spark):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((30, 3)).tolist()
    rows = whitening.whitened(table(spark, vectors, "double", [None, 4, 4, *range(10, 37)])).collect()
    assert len(rows) == 90 and sum(r.vec_id is None for r in rows) == 3 and sum(r.vec_id == 4 for r in rows) == 6


@pytest.mark.parametrize("kind", ["equal", "clusters", "steep", "one"])
def test_eigenvectors(kind):
    draw = np.random.default_rng(4)
    d = 1 if kind == "one" else 90
    q, _ = np.linalg.qr(draw.standard_normal((d, d)))
    e = {"equal": np.ones(d), "clusters": np.repeat(np.arange(30, 0, -1.0), 3)[:d], "steep": 10.0 ** -np.arange(d).clip(0, 12), "one": np.ones(1)}[kind]
    matrix = (q * e) @ q.T
    values, vectors = whitening.leading(matrix, min(32, d))
    assert np.abs(values - e[:32]).max() < 1e-13 * e[0] and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * e[0] * 10
