"""Synthetic rows and how well they can be told from real ones."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.encode import hash_uniform, inverse_normal
from ..operators.curves import binary_roc_auc
from ..operators.ordered import hashed_order
from ..operators.scaling import quantile_normal, quantile_table
from ..session import cut_lineage
from ..shipping import shipped
from .supervised import fit, logistic, perceptron, predict


def sample_rows(real: DataFrame, n, row_id, seed=0, label="label") -> DataFrame:
    """n rows (row_id, label, features) drawn from the marginals of each label.

    Labels follow their shares. Each feature is taken from an independently drawn
    real row of the same label, which samples its marginal exactly. Rows are drawn
    by a dense number inside their label, so the lookup is an equi-join with
    evenly spread keys.
    """
    numbered = hashed_order(real.select(row_id, "features", label), [label], seed, row_id)
    cells = numbered.select(label, F.col("rank").alias("donor"),
                            F.posexplode("features").alias("pos", "x"))
    width = real.agg(F.max(F.size("features"))).scalar()
    drawn = real.sparkSession.range(n).withColumnRenamed("id", row_id)
    # The label of a drawn row is that of a uniformly drawn real row.
    labels = hashed_order(real.select(row_id, label), [], f"{seed}:label", row_id).select(
        F.col("rank").alias("_pick"), label)
    total = real.agg(F.count("*")).scalar()
    picked = drawn.withColumn("_n", total).withColumn(
        "_pick", F.floor(hash_uniform(F.lit(seed), F.col(row_id)) * F.col("_n")) + 1
    ).join(labels, "_pick").select(row_id, label)
    sizes = real.groupBy(label).agg(F.count("*").alias("_size"))
    wanted = picked.join(sizes, label).withColumn("_w", width).withColumn(
        "pos", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))
    ).withColumn("donor", (F.floor(
        hash_uniform(F.lit(seed), F.col(row_id), F.col("pos")) * F.col("_size")) + 1).cast("long"))
    filled = wanted.join(cells, [label, "donor", "pos"])
    # A row has as many cells as features.
    entries = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return filled.groupBy(row_id, label).agg(
        F.transform(entries, lambda e: e["x"]).alias("features"))


LEVELS = 201  # quantiles of a feature that drawn values come from


def _normal_share(z):
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    x = np.abs(z) / np.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, 1 - tail / 2, tail / 2)


def score_correlation(scores) -> np.ndarray:
    """Correlation of the normal scores of all features: one matrix a task, summed on the driver."""
    def run(batches):
        n, total, gram = 0, None, None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            n += len(x)
            total = x.sum(0) + (0 if total is None else total)
            gram = x.T @ x + (0 if gram is None else gram)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([gram.tobytes()], pa.binary())], ["n", "total", "gram"])

    parts = shipped(scores.select("features")).mapInArrow(run, "n long, total binary, gram binary").collect()
    n = sum(p.n for p in parts)
    total = sum(np.frombuffer(p.total) for p in parts)
    gram = sum(np.frombuffer(p.gram).reshape(len(total), -1) for p in parts)
    cov = gram / n - np.outer(total, total) / n ** 2
    size = np.sqrt(np.maximum(np.diag(cov), 0))
    safe = np.where(size > 1e-9, size, 1.0)
    out = cov / safe[:, None] / safe[None, :]
    out[size <= 1e-9, :], out[:, size <= 1e-9] = 0.0, 0.0  # constant features go with none
    np.fill_diagonal(out, 1.0)
    return out


def copula_rows(real: DataFrame, n, row_id, seed=0, label="label", levels=LEVELS) -> DataFrame:
    """n rows (row_id, label, features) with the marginals and rank correlations of each label.

    Per label, every feature is turned into normal scores through its quantiles, the scores are
    correlated in one pass, drawn normal rows get that correlation by its Cholesky factor, and
    go back through the quantiles, interpolated. Labels follow their shares. What the driver and the
    tasks get has the size of one label's quantiles and matrix; a drawn row depends on the seed and its number only.
    """
    spark = real.sparkSession
    sizes = {r[label]: r["count"] for r in real.groupBy(label).count().collect()}  # a row per label
    whole = sum(sizes.values())
    kind = real.schema[label].dataType
    out, first = None, 0
    for place, value in enumerate(sorted(sizes, key=lambda v: (v is not None, v))):
        last = round(n * sum(sizes[v] for v in sorted(sizes, key=lambda v: (v is not None, v))[: place + 1]) / whole)
        mine = real.filter(F.col(label).eqNullSafe(F.lit(value).cast(kind))).select(row_id, "features")
        table = cut_lineage(quantile_table(mine, levels))
        edges = np.array([r["edges"] for r in sorted(table.collect(), key=lambda r: r["pos"])])  # features x levels
        corr = score_correlation(quantile_normal(mine, row_id, levels, clip=0.5 / sizes[value]))
        e, v = np.linalg.eigh(corr)
        factor = np.linalg.cholesky((v * np.maximum(e, 1e-9)) @ v.T)
        shared = spark.sparkContext.broadcast((edges, factor))
        normal = F.transform(F.sequence(F.lit(0), F.lit(len(edges) - 1)),
                             lambda i: inverse_normal(hash_uniform(F.lit(seed), F.col(row_id), i)))
        drawn = shipped(spark.range(first, last).withColumnRenamed("id", row_id).select(row_id, normal.alias("z")))

        def run(batches, shared=shared):
            edges, factor = shared.value
            at = np.linspace(0, 1, edges.shape[1])
            for batch in batches:
                z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                u = _normal_share(z @ factor.T)
                x = np.stack([np.interp(u[:, i], at, e) for i, e in enumerate(edges)], axis=1)
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [row_id, "features"])

        rows = drawn.mapInArrow(run, f"`{row_id}` long, features array<double>").select(
            row_id, F.lit(value).cast(kind).alias(label), "features")
        out = rows if out is None else out.unionByName(rows)
        first = last
    return out if out is not None else real.select(F.lit(0).cast("long").alias(row_id), label, "features").limit(0)


def detection_score(real, synthetic, row_id, repeats=2, seed=0, width=None, hidden=(32,),
                    max_iter=50) -> DataFrame:
    """(repeat, roc_auc): how well a classifier tells synthetic from real rows.

    Each repeat trains on a different hashed half and scores the other half. A
    perceptron needs the row ``width``; without it a logistic model is used.
    """
    both = real.select(row_id, "features", F.lit(0).alias("label")).unionByName(
        synthetic.select(row_id, "features", F.lit(1).alias("label")))
    out = None
    for repeat in range(repeats):
        half = F.pmod(F.xxhash64(F.lit(seed + repeat), F.col(row_id), F.col("label")), F.lit(2))
        estimator = (perceptron(width, 2, hidden, maxIter=max_iter, seed=seed + repeat) if width
                     else logistic(maxIter=max_iter))
        model = fit(estimator, both.filter(half == 0))
        rows = predict(model, both.filter(half == 1), row_id).withColumn("repeat", F.lit(repeat))
        out = rows if out is None else out.unionByName(rows)
    return binary_roc_auc(out, ["repeat"])
