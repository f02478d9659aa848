"""Spectral clustering under fairness constraints, as iterated DataFrame passes.

Eigenvectors are columns of a row table. Graph products are joins and sums; small
matrices (a dozen columns wide) are solved on the driver from aggregated sums. No
matrix with a row or column per data row is ever formed.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.encode import hash_normal
from ..operators.neighbours import knn_graph, kth_distance, symmetric_graph
from ..operators.scaling import group_membership, min_max_similarity
from ..operators.statistics import drop_small_clusters, relabel
from ..session import cut_lineage
from .cluster import kmeans

MOST_ROUNDS = 100  # of an iteration that has not settled; then it raises


def similarity_degrees(df, score) -> DataFrame:
    """Add ``degree``: row sum of the similarity (s_i + s_j) / 2 with zero diagonal.

    The matrix has rank two off the diagonal, so a row sum needs only n and sum(s).
    """
    totals = df.agg(F.struct(F.count("*").alias("n"), F.sum(score).alias("s"))).scalar()
    t = df.withColumn("_t", totals)
    s = F.col(score)
    return t.withColumn("degree", (F.col("_t.n") * s + F.col("_t.s")) / 2 - s).drop("_t")


def similarity_times(df, score, vector, out="product") -> DataFrame:
    """Add the product of the similarity matrix with a column, from two sums."""
    s, x = F.col(score), F.col(vector)
    totals = df.agg(F.struct(F.sum(x).alias("x"), F.sum(s * x).alias("sx"))).scalar()
    t = df.withColumn("_t", totals)
    return t.withColumn(out, (s * F.col("_t.x") + F.col("_t.sx")) / 2 - s * x).drop("_t")


def _cross(df, left, right):
    """Matrix of sums left_i * right_j, on the driver.

    Every partition multiplies its own block of columns; only the small products
    are shuffled and summed.
    """
    n_left, n_right = len(left), len(right)
    columns = [c.cast("double").alias(f"c{i}") for i, c in enumerate([*left, *right])]

    def products(batches):
        acc = np.zeros((n_left, n_right))
        for frame in batches:
            x = frame.to_numpy()
            acc += x[:, :n_left].T @ x[:, n_left:]
        yield pd.DataFrame({"cell": np.arange(acc.size), "v": acc.ravel()})

    rows = df.select(*columns).mapInPandas(products, "cell int, v double").groupBy("cell").agg(
        F.sum("v").alias("v")).collect()
    out = np.zeros(n_left * n_right)
    for row in rows:
        out[row["cell"]] = row["v"]
    return out.reshape(n_left, n_right)


def _sums(df, expressions):
    return _cross(df, [F.lit(1.0)], expressions)[0]


def _combine(columns, weights):
    """sum_i weights_i * column_i."""
    out = F.lit(0.0)
    for c, w in zip(columns, weights):
        if w != 0.0:
            out = out + c * F.lit(float(w))
    return out


def _cols(prefix, n):
    return [F.col(f"{prefix}{i}") for i in range(n)]


def _generalised(t, s):
    """Eigenvalues (ascending) and combinations of T z = theta S z, S possibly singular."""
    w, u = np.linalg.eigh((s + s.T) / 2)
    keep = w > max(w.max(), 0) * 1e-12
    half = u[:, keep] / np.sqrt(w[keep])
    theta, z = np.linalg.eigh(half.T @ ((t + t.T) / 2) @ half)
    return theta, half @ z


def _constraints(df, row_id, attributes):
    """(row_id, f0..): centred group indicators, and their number."""
    if not attributes:
        return df.select(row_id), 0
    coded = group_membership(df.select(row_id, *attributes), list(attributes))
    width = coded.agg(F.max(F.size("membership"))).collect()[0][0]
    shares = _sums(coded, [F.get("membership", F.lit(i)) for i in range(width)]) / coded.count()
    return coded.select(row_id, *[
        (F.get("membership", F.lit(i)) - F.lit(float(p))).alias(f"f{i}")
        for i, p in enumerate(shares)]), width


def _project(state, names, n_f):
    """Remove from each named column its part along the constraints."""
    if not n_f:
        return state
    f = _cols("f", n_f)
    gram = _cross(state, f, f)
    part = np.linalg.pinv(gram) @ _cross(state, f, [F.col(n) for n in names])
    new = {n: F.col(n) - _combine(f, part[:, j]) for j, n in enumerate(names)}
    return state.withColumns(new)


def _laplacian_step(state, edges, m, n_f, alpha, beta, gamma):
    """One graph product: y <- alpha * L y + beta * y + gamma * z, and z <- y.

    Every row sends its weighted values along its edges and its own values to
    itself, so one join and one sum suffice.
    """
    sent = state.join(edges, "id")
    y, z = _cols("y", m), _cols("z", m)
    own = F.col("to") == F.col("id")
    out = []
    for i in range(m):
        kept = (F.lit(alpha) * F.col("degree") + F.lit(beta)) * y[i] + F.lit(gamma) * z[i]
        out.append(F.sum(F.when(own, kept).otherwise(F.lit(-alpha) * F.col("weight") * y[i]))
                   .alias(f"y{i}"))
        out.append(F.sum(F.when(own, y[i])).alias(f"z{i}"))
    carried = ["degree"] + [f"f{i}" for i in range(n_f)]
    keep = [F.max(F.when(own, F.col(c))).alias(c) for c in carried]
    return sent.groupBy("to").agg(*out, *keep).withColumnRenamed("to", "id")


def _constraint_powers(state, edges, n_f, degree, top):
    """(id, h0..): the constraints times the powers 0 to ``degree`` of the Laplacian over ``top``."""
    held = state.select("id", "degree", *[F.col(f"f{i}").alias(f"h{i}") for i in range(n_f)])
    own = F.col("to") == F.col("id")
    for power in range(degree):
        names = held.columns[1:]
        last = _cols("h", n_f * (power + 1))[-n_f:]
        more = [(F.sum(F.when(own, F.col("degree") * x).otherwise(-F.col("weight") * x)) / F.lit(top)).alias(f"h{n_f * (power + 1) + i}")
                for i, x in enumerate(last)]
        held = held.join(edges, "id").groupBy("to").agg(
            *[F.max(F.when(own, F.col(c))).alias(c) for c in names], *more).withColumnRenamed("to", "id")
    return cut_lineage(held.drop("degree"))


def _corrections(steps, starts, grams, top):
    """Per step, what of each constraint must be taken off the vectors so that they stay orthogonal to all.

    ``steps`` holds alpha, beta, gamma of y <- alpha L y + beta y + gamma z. With A = L / top every y is
    a polynomial of A times the first vectors plus powers of A times the constraints f, so its products
    with f follow from ``starts`` (A^j f times the first vectors) and ``grams`` (f times A^j f). Coefficients
    of powers grow with their number: meant for about ten steps.
    """
    count, (n_f, m) = len(steps) + 1, starts[0].shape
    inverse = np.linalg.pinv(grams[0])
    y, y_f = np.eye(1, count)[0], np.zeros((count, n_f, m))  # of A^j times the first vectors, and times f
    z, z_f = np.zeros(count), np.zeros((count, n_f, m))
    up = lambda x: np.concatenate([np.zeros_like(x[:1]), x[:-1]])
    out = []
    for alpha, beta, gamma in steps:
        new = alpha * top * up(y) + beta * y + gamma * z
        new_f = alpha * top * up(y_f) + beta * y_f + gamma * z_f
        along = sum(new[j] * starts[j] + grams[j] @ new_f[j] for j in range(count))
        out.append(inverse @ along)
        new_f[0] -= out[-1]
        y, y_f, z, z_f = new, new_f, y, y_f
    return out


def smallest_laplacian_vectors(graph, rows, row_id, k, n_f=0, degree=8, tol=1e-3):
    """The k smallest eigenvectors of D - W on rows orthogonal to the constraints.

    Chebyshev-filtered subspace iteration. ``graph`` is (i, j, weight), symmetric;
    ``rows`` is (row_id, f0..). Returns (row_id, v0..v{k-1}) and the eigenvalues. Rounds
    go on until the eigenvalues settle; raises if they have not after ``MOST_ROUNDS``. The
    steps of a round are one plan: what keeps them orthogonal is known before (``_corrections``).
    """
    degrees = graph.groupBy(F.col("i").alias("id")).agg(F.sum("weight").alias("degree"))
    loops = degrees.select("id", F.col("id").alias("to"), F.lit(0.0).alias("weight"))
    links = graph.select(F.col("i").alias("id"), F.col("j").alias("to"), "weight")
    edges = cut_lineage(links.unionByName(loops).repartition("id"))
    top = 2.0 * degrees.agg(F.max("degree")).collect()[0][0]
    m = min(k + 4, rows.count())
    start = rows.withColumnRenamed(row_id, "id").join(degrees, "id")
    state = start.select("id", "degree", *[f"f{i}" for i in range(n_f)], *[
        hash_normal(F.col("id"), F.lit(j)).alias(f"y{j}") for j in range(m)
    ], *[F.lit(0.0).alias(f"z{j}") for j in range(m)])
    names = [f"y{j}" for j in range(m)]
    state = cut_lineage(_project(state, names, n_f))
    low, previous = top / 8, None
    if n_f:
        powers = _constraint_powers(state, edges, n_f, degree, top)
        held = _cols("h", n_f * (degree + 1))
        grams = np.split(_cross(powers, held[:n_f], held), degree + 1, axis=1)
    for rounds in range(MOST_ROUNDS + 1):
        if rounds == MOST_ROUNDS:
            raise RuntimeError(f"eigenvalues have not settled after {rounds} rounds")
        centre, half = (top + low) / 2, (top - low) / 2
        steps = [(scale, -scale * centre, carry) for scale, carry in [(1 / half, 0.0), *[(2 / half, -1.0)] * (degree - 1)]]
        if n_f:
            starts = np.split(_cross(state.join(powers, "id"), held, [F.col(n) for n in names]), degree + 1)
            off = _corrections(steps, starts, grams, top)
        for number, step in enumerate(steps):
            state = _laplacian_step(state, edges, m, n_f, *step)
            if n_f:
                state = state.withColumns({n: F.col(n) - _combine(_cols("f", n_f), off[number][:, j]) for j, n in enumerate(names)})
        if n_f:  # what rounding has left
            state = _project(cut_lineage(state), names, n_f)
        # Rayleigh-Ritz on the filtered vectors: z holds them, y their product.
        state = cut_lineage(_laplacian_step(state, edges, m, n_f, 1.0, 0.0, 0.0))
        y, z = _cols("y", m), _cols("z", m)
        sums = _cross(state, z, [*y, *z])
        theta, mix = _generalised(sums[:, :m], sums[:, m:])
        m = mix.shape[1]
        names = [f"y{j}" for j in range(m)]
        state = state.select(
            "id", "degree", *[f"f{i}" for i in range(n_f)],
            *[_combine(z, mix[:, j]).alias(f"y{j}") for j in range(m)],
            *[F.lit(0.0).alias(f"z{j}") for j in range(m)])
        low = min(max(theta[-1], top * 1e-3), top * 0.5)
        wanted = theta[:k]
        if previous is not None and np.abs(wanted - previous).max() < tol * top:
            break
        previous = wanted
    out = state.select(F.col("id").alias(row_id), *[F.col(f"y{j}").alias(f"v{j}") for j in range(min(k, m))])
    return out, theta[:k]


def fair_spectral_clusters(df, row_id, k, attributes=(), neighbours=15, seed=42, graph=None) -> DataFrame:
    """K-means on the smallest Laplacian vectors of the neighbour graph.

    The vectors are orthogonal to the centred group indicators of ``attributes``;
    without attributes no constraint is active. They are scaled so that their entries
    do not shrink with the rows, as k-means ends once centres move less than a fixed length.
    ``graph`` is the ``knn_graph`` of the rows, if known.
    """
    n = df.count()
    if graph is None:
        graph = knn_graph(df.select(row_id, "features"), row_id, min(neighbours, n - 1))
    edges = symmetric_graph(graph)
    rows, n_f = _constraints(df, row_id, attributes)
    found, _ = smallest_laplacian_vectors(cut_lineage(edges), rows, row_id, k, n_f)
    embedding = found.select(row_id, F.array(*[F.col(v) * F.lit(math.sqrt(n)) for v in found.columns[1:]]).alias("features"))
    return kmeans(embedding, row_id, k, seed, starts=10)


def density_embedding(df, row_id, attributes=(), min_points=5, width=10, dist=None):
    """(row_id, v0..): generalised eigenvectors of the density similarity.

    The similarity of two rows is the mean of their scores, so with the degree d
    and a = d + s the Laplacian is diag(a) minus a rank-two part. A shifted solve
    (L - shift D)^-1 is then a division per row plus a small system over sums, and
    the subspace iteration needs no join at all. The constant vector (eigenvalue 0)
    is known and kept as v0; the others are D-orthogonal to it. ``dist`` is the
    ``kth_distance`` of ``min_points``, if known.
    """
    if dist is None:
        dist = kth_distance(df.select(row_id, "features"), row_id, min_points)
    scored = min_max_similarity(dist, "distance", "s")
    groups, n_f = _constraints(df, row_id, attributes)
    base = similarity_degrees(scored.join(groups, row_id), "s").withColumnRenamed("degree", "d")
    base = cut_lineage(base.select(row_id, "s", "d", *[f"f{i}" for i in range(n_f)]))
    s, d = F.col("s"), F.col("d")
    low, high, total, n = (float(x) for x in base.agg(
        F.min(s / d), F.max(s / d), F.sum(d), F.count("*")).collect()[0])
    m = int(min(width + 3, max(1, n - n_f - 1)))
    gap = 0.05 * (high - low) or 1e-3
    shift = 1 + low - gap
    # a - shift * d, written without cancellation.
    inverse = 1 / (s - (low - gap) * d)
    one = F.lit(1.0)
    ends = [one, s, *_cols("f", n_f), d]
    bases = [s * 0.5, one * 0.5, *_cols("f", n_f), d]
    system = -_cross(base, ends, [b * inverse for b in bases])
    system[0, 0] += 1
    system[1, 1] += 1
    solve = np.linalg.pinv(system)
    state = base.withColumns({
        f"v{j}": hash_normal(F.col(row_id), F.lit(j)) for j in range(m)})
    previous = None
    for rounds in range(MOST_ROUNDS + 1):
        if rounds == MOST_ROUNDS:
            raise RuntimeError(f"eigenvalues have not settled after {rounds} rounds")
        v = _cols("v", m)
        y = solve @ _cross(state, ends, [d * x * inverse for x in v])
        moved = state.withColumns({
            f"w{j}": inverse * (d * v[j] + _combine(bases, y[:, j])) for j in range(m)})
        moved = cut_lineage(moved)
        w = _cols("w", m)
        # One pass for w'Dw, w'diag(s)w and the two sums of the rank-two part.
        sums = _cross(moved, [*w, one], [*[d * x for x in w], *[s * x for x in w], *w])
        gram, product = sums[:m, :m], sums[:m, m:2 * m].copy()
        weighted, plain = sums[m, m:2 * m], sums[m, 2 * m:]
        # w'Lw - w'Dw = w'diag(s)w - rank-two part; the shift by D keeps precision.
        product -= 0.5 * (np.outer(weighted, plain) + np.outer(plain, weighted))
        theta, mix = _generalised(product, gram)
        m = mix.shape[1]
        state = moved.select(row_id, "s", "d", *[f"f{i}" for i in range(n_f)], *[
            _combine(w, mix[:, j]).alias(f"v{j}") for j in range(m)])
        if previous is not None and len(previous) == len(theta) and (
                np.abs(theta - previous).max() < 5e-3 * (high - low)):
            break
        previous = theta
    count = min(width - 1, m)
    return state.select(
        row_id, F.lit(1 / np.sqrt(total)).alias("v0"),
        *[F.col(f"v{j}").alias(f"v{j + 1}") for j in range(count)]), 1 + theta[:count]


def density_fair_clusters(df, row_id, k, attributes=(), min_points=5, seed=42, dist=None) -> DataFrame:
    """K-means on the density embedding, without small clusters.

    Clusters below ``min_points`` rows become noise; while fewer than k remain the
    number of clusters and vectors grows, up to the width of the embedding. When
    that is used up every row gets cluster 0.
    """
    embedding, _ = density_embedding(df, row_id, attributes, min_points, dist=dist)
    embedding = cut_lineage(embedding)
    names = embedding.columns[1:]
    for size in range(k, len(names) + 1):
        rows = embedding.select(row_id, F.array(*names[:size]).alias("features"))
        kept = cut_lineage(drop_small_clusters(kmeans(rows, row_id, size, seed, starts=10), min_points))
        if kept.filter("cluster <> -1").select("cluster").distinct().count() >= k:
            return relabel(kept)
    return df.select(row_id, F.lit(0).alias("cluster"))
