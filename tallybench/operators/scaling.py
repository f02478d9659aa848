"""Feature scaling and encoding over ``features array<double>`` columns.

Wide rows stay one array column. Per-position statistics come from one
``posexplode`` aggregation; they are applied as one array looked up by position,
because a table of a few hundred positions is bounded by the row width.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.encode import attribute_code, inverse_normal, one_hot
from ..session import cut_lineage
from ..shipping import shipped
from .ordered import exact_quantiles


def positions(df, keys=()) -> DataFrame:
    return df.select(*keys, F.posexplode("features").alias("pos", "x"))


def position_stats(df) -> DataFrame:
    """(pos, mean, std): population statistics of every position."""
    return positions(df).groupBy("pos").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")
    )


def _as_array(stats, *fields):
    """One row: array of structs ordered by position (one entry per feature)."""
    return stats.agg(
        F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("a")
    ).select("a").scalar()


def standard_scale(df, fit_on=None) -> DataFrame:
    """Standardise every position; a constant position is divided by 1."""
    stats = position_stats(df if fit_on is None else fit_on)
    fitted = df.withColumn("_s", _as_array(stats, "mean", "std"))
    scaled = F.zip_with(
        "features", "_s",
        lambda x, s: (x - s["mean"]) / F.when(s["std"] > 0, s["std"]).otherwise(1.0),
    )
    return fitted.withColumn("features", scaled).drop("_s")


def min_max_similarity(df, distance, out="similarity") -> DataFrame:
    """1 - d/||d||, rescaled to [0, 1] over all rows."""
    d = F.col(distance)
    norms = df.agg(
        F.struct(F.sqrt(F.sum(d * d)).alias("norm"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    ).scalar()
    with_norms = df.withColumn("_n", norms)
    s = F.lit(1.0) - d / F.col("_n.norm")
    lowest = F.lit(1.0) - F.col("_n.hi") / F.col("_n.norm")
    highest = F.lit(1.0) - F.col("_n.lo") / F.col("_n.norm")
    return with_norms.withColumn(out, F.try_divide(s - lowest, highest - lowest)).drop("_n")


def quantile_table(df, count) -> DataFrame:
    """(pos, edges): evenly spaced exact quantiles of every position."""
    q = exact_quantiles(positions(df), ["pos"], "x", count)
    return q.groupBy("pos").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("level_index", "quantile"))),
            lambda s: s["quantile"],
        ).alias("edges")
    )


def quantile_levels(n_rows: int) -> int:
    """Number of quantiles for a training table of n rows."""
    return max(min(n_rows // 30, 1000), 10)


#: Edges that are sent to all tasks at a time; wider tables are worked through in blocks of positions.
EDGES = 1 << 22


def _quantile_share(x, edges):
    """Mean of the left and right interpolated position of x among the edges; by binary search."""
    last = len(edges) - 1
    below, upto = np.searchsorted(edges, x, "left"), np.searchsorted(edges, x, "right")
    at = np.clip(below, 1, max(last, 1))
    lo, hi = edges[np.minimum(at - 1, last)], edges[np.minimum(at, last)]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (below - 1 + (x - lo) / (hi - lo)) / last
        tied = (below + upto - 1) / (2.0 * last)
    share = np.where(upto == below, between, tied)
    return np.where(x <= edges[0], 0.0, np.where(~(x < edges[-1]), 1.0, share))  # missing numbers sort last


def _linear_codes(x, edges):
    """(cell, bin): 0 below a bin, 1 above it, the share inside; open to the outside at both ends."""
    edges = np.unique(edges)
    if len(edges) < 2:
        return np.zeros((len(x), 1))
    code = (x[:, None] - edges[:-1]) / np.diff(edges)
    code[:, 1:] = np.maximum(code[:, 1:], 0.0)
    code[:, :-1] = np.minimum(code[:, :-1], 1.0)
    return code


def _edge_blocks(table, count):
    """(first position, edges of each) for blocks of positions that hold ``EDGES`` numbers at most."""
    width = table.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    step = max(1, EDGES // count)
    for first in range(0, width, step):
        rows = table.filter(F.col("pos").between(first, first + step - 1)).collect()
        yield first, [np.array(r["edges"]) for r in sorted(rows, key=lambda r: r["pos"])]


def _through_edges(rows, table, count, each, out, kind):
    """Rows (key, features) with ``out``: what ``each`` makes of every cell, in place.

    Rows stay where they are, whatever the width; only edges travel, block by block.
    """
    key = rows.columns[0]
    key_kind = rows.schema[key].dataType.simpleString()
    empty = F.array().cast(f"array<{kind}>")
    rows = shipped(rows.select(key, "features", empty.alias(out)))
    for first, edges in list(_edge_blocks(table, count)):
        shared = rows.sparkSession.sparkContext.broadcast(edges)

        def run(batches, first=first, shared=shared):
            for batch in batches:
                edges = shared.value
                cells = batch.column(1).flatten()
                x = cells.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                gone = cells.is_null().to_numpy(zero_copy_only=False).reshape(x.shape)
                made = [each(x[:, first + i], e) for i, e in enumerate(edges)]
                before = batch.column(2).to_pylist()
                lists = [[*b, *(None if gone[r, first + i] else m[r].tolist() for i, m in enumerate(made))] for r, b in enumerate(before)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, batch.schema.field(2).type)], [key, "features", out])

        rows = rows.mapInArrow(run, f"`{key}` {key_kind}, features array<double>, {out} array<{kind}>")
    return rows


def quantile_normal(df, row_id, count, fit_on=None, clip=1e-7) -> DataFrame:
    """Map every position to a normal shape through its empirical quantiles.

    Returns (row_id, features). Shares are kept ``clip`` away from 0 and 1.
    """
    table = cut_lineage(quantile_table(df if fit_on is None else fit_on, count))
    shares = _through_edges(df.select(row_id, "features"), table, count, _quantile_share, "shares", "double")
    inside = lambda p: inverse_normal(F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip)))
    return shares.select(row_id, F.transform("shares", inside).alias("features"))


def piecewise_linear_encode(df, row_id, bins, fit_on=None) -> DataFrame:
    """(row_id, pos, encoding): piecewise-linear code of every cell.

    Equal quantiles are merged, so a position with few distinct values has fewer bins.
    """
    table = cut_lineage(quantile_table(df if fit_on is None else fit_on, bins + 1))
    codes = _through_edges(df.select(row_id, "features"), table, bins + 1, _linear_codes, "codes", "array<double>")
    return codes.select(row_id, F.posexplode("codes").alias("pos", "encoding"))


def group_membership(df, attributes) -> DataFrame:
    """Add ``membership``: one-hot codes of all attributes, joined end to end.

    Each attribute has max + 1 categories; codes are made non-negative first.
    """
    codes = df
    for a in attributes:
        codes = codes.withColumn(f"_{a}", attribute_code(F.col(a)))
    for a in attributes:
        codes = codes.withColumn(f"_n_{a}", codes.agg(F.max(f"_{a}") + 1).scalar())
    parts = [one_hot(F.col(f"_{a}"), F.col(f"_n_{a}")) for a in attributes]
    helpers = [f"_{a}" for a in attributes] + [f"_n_{a}" for a in attributes]
    return codes.withColumn("membership", F.concat(*parts)).drop(*helpers)


def centred_membership(df) -> DataFrame:
    """Replace ``membership`` by its deviation from the share of every group."""
    shares = df.select(F.posexplode("membership").alias("pos", "g")).groupBy("pos").agg(
        F.avg("g").alias("share")
    )
    fitted = df.withColumn("_s", _as_array(shares, "share"))
    centred = F.zip_with("membership", "_s", lambda g, s: g - s["share"])
    return fitted.withColumn("membership", centred).drop("_s")
