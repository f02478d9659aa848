"""Exact Shapley values of boosted trees, from a table of root-to-leaf paths.

What a tree expects when only some features are known follows its paths: at a cut on a known
feature the row's own side counts, at any other both sides do, by the share of background rows that
went there. A leaf is thus a product of one factor per feature on its path, and the Shapley
value of a product game has a closed form: with subset sizes weighted as usual, the
coefficients of the product of (share + own side * t) over the other features of the path. The
path table is bounded by the model and broadcast; rows are explained where they are. The sum of
a row's values is its margin less the expected margin, to rounding.
"""

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import shipped
from .boosting import ROWS, _Above, _matrix, _walk


def leaf_counts(model, background) -> np.ndarray:
    """(round, class, leaf): how many background rows end there."""
    shared = background.sparkSession.sparkContext.broadcast(model)
    shape = model.value.shape

    def run(batches):
        total = np.zeros(shape)
        model = shared.value
        for batch in batches:
            x = _matrix(batch.column(0))
            for r, c in np.ndindex(*shape[:2]):
                total[r, c] += np.bincount(_walk(model.feature[r, c], _Above(x, model.cut[r, c]), model.depth), minlength=shape[2])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    rows = shipped(background.select(F.col("features").cast("array<double>").alias("features")))
    parts = rows.mapInArrow(run, "counts binary").collect()  # a model's leaves per task
    return sum(np.frombuffer(p.counts).reshape(shape) for p in parts)


def paths(model, counts) -> list:
    """Per class, reachable leaves as (value, {feature: (above, up to, share)}).

    A row is on the side of all cuts on a feature when its value is above the first number and
    not above the second; missing values count as above all.
    """
    out = [[] for _ in model.start]
    for r, c in np.ndindex(*model.value.shape[:2]):
        cover = np.concatenate([np.zeros(len(model.feature[r, c])), counts[r, c]])
        for node in range(len(model.feature[r, c]) - 1, -1, -1):
            cover[node] = cover[2 * node + 1] + cover[2 * node + 2]
        stack = [(0, {})]
        while stack:
            node, seen = stack.pop()
            if node >= len(model.feature[r, c]):
                value = float(model.value[r, c][node - len(model.feature[r, c])])
                if value:
                    out[c].append((value, seen))
                continue
            f, t = int(model.feature[r, c][node]), float(model.cut[r, c][node])
            if f < 0:
                stack.append((2 * node + 1, seen))
                continue
            low, high, share = seen.get(f, (-np.inf, np.inf, 1.0))
            left = cover[2 * node + 1] / cover[node] if cover[node] else 0.5
            stack.append((2 * node + 1, {**seen, f: (low, min(high, t), share * left)}))
            stack.append((2 * node + 2, {**seen, f: (max(low, t), high, share * (1 - left))}))
    return out


def _weights(n):
    """Shapley weight of a subset of each size among n - 1 others."""
    return np.array([factorial(k) * factorial(n - k - 1) / factorial(n) for k in range(n)])


def _explained(x, leaves):
    """(row, feature): summed values of all leaves of a class."""
    out = np.zeros(x.shape)
    for value, seen in leaves:
        features = list(seen)
        n = len(features)
        if not n:
            continue
        own, share = np.empty((n, len(x))), np.empty(n)
        for i, f in enumerate(features):
            low, high, share[i] = seen[f]
            up = ~(x[:, f] <= low) if low > -np.inf else np.ones(len(x), bool)
            own[i] = up & (x[:, f] <= high) if high < np.inf else up
        weights = _weights(n)
        for i, f in enumerate(features):
            sizes = np.zeros((n, len(x)))  # coefficient of each subset size among the others
            sizes[0] = 1.0
            for j in range(n):
                if j != i:
                    sizes[1:] = sizes[1:] * share[j] + sizes[:-1] * own[j]
                    sizes[0] *= share[j]
            out[:, f] += value * (own[i] - share[i]) * (weights @ sizes)
    return out


def expected_margins(model, leaves) -> np.ndarray:
    """The margin of each class when no feature is known."""
    return model.start + np.array([sum(v * np.prod([s for _, _, s in seen.values()]) for v, seen in one) for one in leaves])


def tree_shapley(model, rows, background, row_id="row_id"):
    """((row_id, class, feature, value), expected margins): exact values for every row and feature."""
    leaves = paths(model, leaf_counts(model, background))
    shared = rows.sparkSession.sparkContext.broadcast(leaves)
    kind = rows.schema[row_id].dataType.simpleString()
    names = [row_id, "values"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1))
                values = np.stack([_explained(x, one) for one in shared.value], axis=1)
                inner = pa.ListArray.from_arrays(np.arange(0, values.size + 1, x.shape[1], dtype=np.int32), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(
                    np.arange(0, len(inner) + 1, values.shape[1], dtype=np.int32), inner)], names)

    told = shipped(rows.select(row_id, F.col("features").cast("array<double>").alias("features"))).mapInArrow(
        run, f"`{row_id}` {kind}, values array<array<double>>")
    long = told.select(row_id, F.posexplode("values").alias("class", "_v")).select(
        row_id, "class", F.posexplode("_v").alias("feature", "value"))
    return long, expected_margins(model, leaves)
