"""Approximate nearest rows: lists refined over neighbours of neighbours.

Every distinct row starts with the nearest rows of its own blocks (rows of one pivot's cell,
dealt by hash), for several sets of pivots. In each round a row's list and some rows that list it meet in one place, and
any two of them at least one of which is new there are compared; a row that is nearer than
the last of a list enters it. Rounds end when fewer than ``rate`` of the entries changed. A
round sends every row about twice the length of a list, whatever the number of rows; no step
compares all rows. What is sent is a code of the row, a byte or two a number, if its error is small beside the
row's nearest distance, else the row itself (``_codes``); entries carry the error of their distance, and
all that may be among the nearest at the end get exact distances. Rows that many lists hold are joined by broadcast (``join_groups``), and
of those that list a row a fixed number takes part in a round, other ones in the next.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.distance import euclidean
from ..session import cut_lineage, free_rounds
from ..shipping import shipped
from . import blocks
from .groups import join_groups
from .neighbours import Distinct, _block_counts, _in_cells, _per_cell, _without_self

START_ROWS = 4096     # rows of a block of the first lists; fewer rows get exact lists at once
STARTS = 3            # sets of pivots, so that lists reach over the borders of cells
PIVOTS = 1024         # cells at most
ROUNDS = 30           # a bound that is not reached in practice: rounds end on ``rate``
TOGETHER = 1 << 21    # numbers of gathered vectors compared at a time
COARSE = 0.02         # error of a code, as a part of the distance of the row's nearest


def _decoded(codes, centre):
    """Matrix of the rows of an array of codes (see ``_codes``)."""
    width = len(centre)
    out = np.empty((len(codes), width))
    if not len(codes):
        return out
    raw, ends = np.frombuffer(codes.buffers()[2], np.uint8), np.frombuffer(codes.buffers()[1], np.int32)[codes.offset:codes.offset + len(codes) + 1]
    lengths = np.diff(ends)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        part = raw[ends[at][:, None] + np.arange(length)]
        if length == 8 * width:
            out[at] = part.view(np.float64)
            continue
        step = np.ascontiguousarray(part[:, :8]).view(np.float64)
        out[at] = np.ascontiguousarray(part[:, 8:]).view(np.int8 if length == 8 + width else np.int16) * step + centre
    return out


def _codes(centre, metric):
    """Batch function: (q, features, near) to (c, code, error).

    A code is a step and, for each number, its distance from ``centre`` in steps, of one or two bytes. Rows whose
    code is farther from them than ``COARSE`` times ``near`` are sent as they are, as are those compared by equal numbers.
    """
    schema = pa.schema([("c", pa.int64()), ("code", pa.binary()), ("error", pa.float64())])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
            near = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            codes, errors, open_ = [None] * n, np.zeros(n), np.arange(n)
            for kind, most in ((np.int8, 127), (np.int16, 32767)) if metric != "hamming" and x.shape[1] > 2 else ():
                away = x[open_] - centre
                step = np.abs(away).max(axis=1, initial=0.0) / most
                with np.errstate(all="ignore"):
                    number = np.rint(away / step[:, None])
                    error = np.sqrt(((number * step[:, None] + centre - x[open_]) ** 2).sum(1)) * (1 + 1e-9)
                    fine = (step > 1e-300) & (error <= COARSE * near[open_])
                for i, row, width, e in zip(open_[fine], number[fine].astype(kind), step[fine], error[fine]):
                    codes[i], errors[i] = width.tobytes() + row.tobytes(), e
                open_ = open_[~fine]
            for i in open_:
                codes[i] = x[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(errors)], schema=schema)

    return run


def _pairs(metric, centre):
    """Batch function: of rows (q, around) the pairs that may enter a list.

    ``around`` holds structs c, new, bound, code, error.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            c, new, bound, error = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("c", "new", "bound", "error"))
            x = _decoded(flat.field("code"), centre)
            size = np.diff(lists.offsets.to_numpy())
            first = np.concatenate([[0], np.cumsum(size)])
            widest = int(size.max()) if len(size) else 0
            step = max(1, TOGETHER // max(1, widest * max(x.shape[1], widest)))
            for lo in range(0, len(size), step):
                hi = min(len(size), lo + step)
                at = first[lo:hi, None] + np.arange(widest)[None, :]
                there = np.arange(widest)[None, :] < size[lo:hi, None]
                at = np.where(there, at, 0)
                v = x[at]
                if metric == "hamming":
                    d = (v[:, :, None, :] != v[:, None, :, :]).mean(-1)
                    slack = 0.0
                else:
                    v = v - v[:, :1]
                    n2 = (v * v).sum(-1)
                    d2 = n2[:, :, None] + n2[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
                    slack = 1e-14 * (x.shape[1] + 8) * n2.max(initial=0.0)
                    d = np.sqrt(np.maximum(d2 - slack, 0))
                fresh = new[at]
                asked = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
                asked &= (c[at][:, :, None] != c[at][:, None, :]) & (d <= bound[at][:, :, None])
                row, i, j = np.nonzero(asked)
                a, b = at[row, i], at[row, j]
                exact = (x[a] != x[b]).mean(1) if metric == "hamming" else blocks._exact(x, x, a, b)
                near = exact <= bound[a]
                a, b, exact = a[near], b[near], exact[near]
                yield pa.RecordBatch.from_arrays([pa.array(c[a], pa.int64()), pa.array(c[b], pa.int64()), pa.array(exact, pa.float64()),
                                                  pa.array(error[a] + error[b], pa.float64())], ["q", "c", "distance", "error"])

    return run


def _first_lists(points, n, width, metric, number):
    """(q, c, distance): the nearest rows inside a block of each row's cell.

    Each ``number`` gives other pivots and blocks.
    """
    order = F.xxhash64(F.lit(number), "q")
    chosen = points.orderBy(order, "q").limit(max(1, min(PIVOTS, n // START_ROWS))).select("features").collect()
    pivots = points.sparkSession.sparkContext.broadcast(np.array([r[0] for r in chosen], dtype=np.float64))
    cells = _in_cells(points, "q", pivots, metric)
    (sizes,) = _per_cell(cells, len(pivots.value), F.count("*"))
    counts = F.broadcast(points.sparkSession.createDataFrame(  # a row per pivot
        list(enumerate(_block_counts(sizes, START_ROWS))), "cell int, _n int"))
    search = blocks.nearest(width + 1, metric)

    def inside(frame):
        found = search(frame.rename(columns={"features": "query_vector"}),
                       frame.rename(columns={"features": "row_vector", "q": "c"}))
        return found[found["q"] != found["c"]]

    block = F.pmod(order, F.col("_n").cast("long"))
    return shipped(cells.join(counts, "cell").withColumn("block", block).select("q", "features", "cell", "block")).groupBy(
        "cell", "block").applyInPandas(inside, "q long, c long, distance double")


def _shortest(lists, width):
    order = Window.partitionBy("q").orderBy("distance", "c")
    return lists.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= width).drop("_k")


def approximate_lists(points, n, k, metric="euclidean", width=None, rate=0.001):
    """(q, c, distance) for distinct rows (q, features): about the ``k`` nearest others.

    ``width`` entries are kept in a list while it is refined, twice ``k`` if not given.
    """
    width = width or 2 * k
    first = None
    for number in range(STARTS):
        more = _first_lists(points, n, width, metric, number)
        first = more if first is None else first.unionByName(more)
    first = first.groupBy("q", "c").agg(F.min("distance").alias("distance"))
    lists = cut_lineage(_shortest(first, width).select("q", "c", "distance", F.lit(0.0).alias("error"), F.lit(True).alias("new")))
    total = fresh = lists.count()
    if not total:
        return lists.select("q", "c", "distance")
    centre = _centre(points)
    nearest = lists.groupBy("q").agg(F.min("distance").alias("near"))
    rows = points.join(nearest, "q", "left").select("q", "features", F.coalesce("near", F.lit(0.0)).alias("near"))
    codes = cut_lineage(shipped(rows).mapInArrow(_codes(centre, metric), "c long, code binary, error double"))
    for number in range(ROUNDS):
        total = max(total, 1)
        ends = lists.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        bound = F.when(F.col("n") < width, F.lit(float("inf"))).otherwise(F.col("far"))
        listed = lists.groupBy("c").agg(F.count("*").alias("_in"))
        known = codes.join(ends.withColumnRenamed("q", "c"), "c", "left").join(listed, "c", "left").select(
            "c", "code", "error", F.coalesce(bound, F.lit(float("inf"))).alias("bound"),
            (F.coalesce("_in", F.lit(0)) + width + 1).alias("_size"))
        reverse = Window.partitionBy("q").orderBy(F.desc("new"), F.xxhash64(F.lit(number), "q", "c"))
        listing = lists.select(F.col("c").alias("q"), F.col("q").alias("c"), "new").withColumn(
            "_k", F.row_number().over(reverse)).filter(F.col("_k") <= width).drop("_k")
        own = codes.select(F.col("c").alias("q"), "c", F.lit(False).alias("new"))  # its new entries make it meet them
        around = lists.select("q", "c", "new").unionByName(listing).unionByName(own)
        if 4 * fresh < n:  # most places have nothing new to compare
            news = lists.filter("new").select(F.explode(F.array("q", "c")).alias("q")).distinct()
            around = around.join(news, "q", "left_semi")
        around = around.groupBy("q", "c").agg(F.max("new").alias("new"))
        met = join_groups(around, known, ["c"], total * 3)
        gathered = met.groupBy("q").agg(F.collect_list(F.struct("c", "new", "bound", "code", "error")).alias("around"))  # twice the width and one
        found = shipped(gathered.select("around")).mapInArrow(_pairs(metric, centre), "q long, c long, distance double, error double")
        every = lists.select("q", "c", F.struct(F.lit(0).alias("new"), "distance", "error").alias("entry")).unionByName(
            found.select("q", "c", F.struct(F.lit(1).alias("new"), "distance", "error").alias("entry")))
        once = every.groupBy("q", "c").agg(F.min("entry").alias("entry")).select(
            "q", "c", "entry.distance", "entry.error", (F.col("entry.new") == 1).alias("new"))
        lists = cut_lineage(_shortest(once, width))
        total, fresh = lists.agg(F.count("*"), F.count_if("new")).first()
        free_rounds(points.sparkSession)
        if fresh <= rate * total:
            break
    return _shortest(_exact_ends(lists, points, k, metric), k)


def _centre(points):
    """Mean of the finite numbers of every position, on the driver: one number a position."""
    means = points.select(F.posexplode("features").alias("pos", "x")).filter(F.abs("x") < float("inf")).groupBy("pos").agg(F.avg("x").alias("x"))
    width = points.select(F.max(F.size("features"))).first()[0]
    out = np.zeros(width)
    for row in means.collect():
        out[row["pos"]] = row["x"]
    return out


def _exact_ends(lists, points, k, metric):
    """(q, c, distance): the entries that may be among the ``k`` nearest, all with exact distances."""
    by_most = Window.partitionBy("q").orderBy(F.col("distance") + F.col("error"))
    last = F.max(F.when(F.col("_k") == k, F.col("distance") + F.col("error"))).over(Window.partitionBy("q"))
    near = lists.withColumn("_k", F.row_number().over(by_most)).withColumn("_last", last).filter(
        F.col("_last").isNull() | (F.col("distance") - F.col("error") <= F.col("_last")))
    near = cut_lineage(near.select("q", "c", "distance", "error"))
    rough = near.filter("error > 0").select("q", "c")
    count = rough.count()
    if not count:
        return near.select("q", "c", "distance")
    hubs = rough.groupBy("c").agg(F.count("*").alias("_size"))
    known = points.withColumnRenamed("q", "c").join(hubs, "c")
    ends = join_groups(rough, known, ["c"], count).withColumnRenamed("features", "_there")
    gap = euclidean(F.col("features"), F.col("_there"))  # only Euclidean distances have an error
    exact = ends.join(points, "q").select("q", "c", gap.alias("distance"))
    return near.filter("error = 0").select("q", "c", "distance").unionByName(exact)


def knn_graph_approximate(df, row_id, k, metric="euclidean", width=None, rate=0.001) -> DataFrame:
    """(i, j, rank, distance): about the k nearest other rows of every row, ties by id.

    Distances are exact, lists may miss a row. Copies of a row are always found. Rows are
    refined as distinct vectors, so a group of copies costs one row.
    """
    table = Distinct(df, row_id)
    lists = approximate_lists(table.queries(), table.n_points, k, metric, width, rate)
    if table.copied:
        itself = table.queries().select("q", F.col("q").alias("c"), F.lit(0.0).alias("distance"))
        others = table.first_of_each(k + 1).join(table.points.select("features", F.col("rep").alias("_rep")), "features").select(
            "_rep", F.col("c").alias("_c"))
        lists = lists.unionByName(itself).join(others, F.col("c") == F.col("_rep")).select("q", F.col("_c").alias("c"), "distance")
    return _without_self(table, lists, k)
