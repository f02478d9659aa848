"""Exact nearest rows and distance reductions, without a cross join.

Equal vectors are collapsed first, so a group of copies costs one row. Nearest-row
search partitions the rows by their closest pivot (a pivot-based kNN join): each
query searches its own cell, then only those cells that the triangle inequality
cannot rule out. There are about as many pivots as the root of the rows, and cells are
cut into blocks of bounded size, so a crowded cell becomes many small tiles. Reductions
over all distances (silhouette, row sums) compare every distinct row with every other. The
largest distance is searched best first, with bounds that rule out most pairs. Where bounds
rule out little (many dimensions), all blocks meet in a grid of fixed width instead, so that
a row is sent to no more than ``GRID`` tiles. Rows on a line are sorted; no pair is formed.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from ..shipping import shipped
from . import blocks
from .groups import join_groups
from .ordered import BLOCK, running_sums

BLOCK_ROWS = 2048
FARTHEST_CELLS = 2048  # of the search for the largest distance: its pairs of cells fit the driver
FIRST_PAIRS = 64       # pairs of cells in its first round
GRID = 16              # blocks a side where all blocks meet; so many times a row is sent at most
POINT = "q long, features array<double>"


def collapse(df, row_id, extra=()) -> DataFrame:
    """One row per distinct vector: rep (smallest row id) and copies."""
    return df.groupBy("features", *extra).agg(
        F.min(F.col(row_id).cast("long")).alias("rep"), F.count("*").alias("copies")
    )


class Distinct:
    """The distinct vectors of a table, written once, and how its rows map to them."""

    def __init__(self, df, row_id, extra=()):
        self.rows, self.row_id = df, row_id
        self.points = cut_lineage(collapse(df, row_id, extra))
        x = F.get("features", F.lit(0)).cast("double")
        x = F.when(F.abs(x) < float("inf"), x)
        self.n_rows, self.n_points, wide, finite, self.n_finite, self.least, self.most = self.points.agg(
            F.coalesce(F.sum("copies"), F.lit(0)), F.count("*"), F.count_if(F.coalesce(F.size("features"), F.lit(0)) != 1),
            F.count(x), F.sum(F.when(x.isNotNull(), F.col("copies"))), F.min(x), F.max(x)).first()
        #: Vectors of one number, not all of them missing; if none is missing, all rows lie on a line.
        self.narrow = finite > 0 and wide == 0 and math.isfinite(self.most - self.least)
        self.on_a_line = self.narrow and finite == self.n_points

    @property
    def copied(self) -> bool:
        return self.n_points < self.n_rows

    def line(self) -> DataFrame:
        """(features, x, copies) of rows on a line, those with a finite number."""
        return self.points.select("features", F.get("features", F.lit(0)).cast("double").alias("x"), "copies").filter(F.abs("x") < float("inf"))

    def queries(self) -> DataFrame:
        return self.points.select(F.col("rep").alias("q"), "features")

    def members(self) -> DataFrame:
        """(row_id, rep): the representative of every row."""
        if not self.copied:  # every row is its own
            return self.points.select(F.col("rep").alias(self.row_id), "rep")
        reps = self.points.select("features", "rep", F.col("copies").alias("_size"))
        rows = self.rows.select(self.row_id, "features")
        return join_groups(rows, reps, ["features"], self.n_rows).select(self.row_id, "rep")

    def first_of_each(self, k) -> DataFrame:
        """(c, features): at most the k smallest row ids of every distinct vector."""
        if not self.copied:
            return self.points.select(F.col("rep").alias("c"), "features")
        order = Window.partitionBy("features").orderBy(self.row_id)
        return self.rows.select(F.col(self.row_id).cast("long").alias("c"), "features",
                                F.row_number().over(order).alias("_k")).filter(F.col("_k") <= k).drop("_k")


def members(df, row_id) -> DataFrame:
    """(row_id, rep): the representative of every row."""
    return Distinct(df, row_id).members()


def _pick_pivots(rows, count):
    """Pivot vectors in hash order; the driver gets about the root of the rows."""
    picked = rows.orderBy(F.xxhash64("c"), "c").limit(count).select("features").collect()
    return np.unique(np.array([p[0] for p in picked], dtype=np.float64), axis=0)


def _per_cell(df, width, *aggregates):
    """Small per-cell statistics (one row per pivot) as numpy arrays."""
    out = [np.zeros(width) for _ in aggregates]
    for row in df.groupBy("cell").agg(*aggregates).collect():
        for i in range(len(aggregates)):
            out[i][row["cell"]] = row[i + 1]
    return out


def _block_counts(rows_per_cell, size=BLOCK_ROWS):
    return [max(1, int(-(-n // size))) for n in rows_per_cell]


def _tiled(queries, rows, q_blocks, c_blocks, run, schema):
    """Cogroup queries (q, features, cell) with rows (c, features, cell, ...) by tile.

    ``q_blocks``/``c_blocks`` give the number of blocks of each cell. A row goes to
    one block of its own side and meets every block of the other side.
    """
    counts = F.broadcast(queries.sparkSession.createDataFrame(  # a row per pivot
        list(zip(range(len(q_blocks)), q_blocks, c_blocks)), "cell int, _nq int, _nc int"))

    def block(column, count):
        return F.pmod(F.xxhash64(column), F.col(count).cast("long")).cast("int")

    # Both sides may stem from one table; distinct names keep them apart.
    left = queries.join(counts, "cell").withColumn("qb", block("q", "_nq")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1))
    ).withColumnRenamed("features", "query_vector").drop("_nq", "_nc")
    right = rows.join(counts, "cell").withColumn("cb", block("c", "_nc")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1))
    ).withColumnRenamed("features", "row_vector").drop("_nq", "_nc")
    keys = ["cell", "qb", "cb"]
    return shipped(left).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _best(partials, k):
    order = Window.partitionBy("q").orderBy("distance", "c")
    return partials.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_cells(df, name, pivots, metric):
    """(name, features, cell, rho): rows with their nearest pivot."""
    rows = shipped(df.select(name, "features"))
    if len(pivots.value) == 1:  # one block holds all rows
        return rows.select(name, "features", F.lit(0).alias("cell"))
    return cut_lineage(rows.mapInPandas(
        blocks.to_pivots(pivots, metric), f"{name} long, features array<double>, cell int, rho double"))


def knn_join(queries, rows, k, metric="euclidean") -> DataFrame:
    """(q, c, distance, rank): the k nearest rows of every query, ties by id.

    ``queries`` is (q, features), ``rows`` is (c, features). There is a cell for every block
    of rows, up to about the root of the rows.
    """
    partial = "q long, c long, distance double"
    search = blocks.nearest(k, metric)
    n_rows = rows.count()
    if not n_rows:
        none = queries.limit(0).select("q", F.col("q").alias("c"), F.lit(0.0).alias("distance"))
        return _best(none, k)
    spark = rows.sparkSession
    count = min(math.isqrt(n_rows), -(-n_rows // BLOCK_ROWS))
    pivots = _pick_pivots(rows, count) if count > 1 else np.zeros((1, 1))
    width = len(pivots)
    shared = spark.sparkContext.broadcast(pivots)
    c_cells, q_cells = (_in_cells(*side, shared, metric) for side in ((rows, "c"), (queries, "q")))
    if width == 1:
        return _best(_tiled(q_cells, c_cells, _block_counts([queries.count()]),
                            _block_counts([n_rows]), search, partial), k)
    c_size, radius = _per_cell(c_cells, width, F.count("*"), F.max("rho"))
    (q_size,) = _per_cell(q_cells, width, F.count("*"))
    c_rows, q_rows = _block_rows(n_rows), _block_rows(q_size.sum())  # a crowded cell has few blocks too
    c_blocks = _block_counts(c_size, c_rows)
    own = cut_lineage(_best(_tiled(q_cells, c_cells, _block_counts(q_size, q_rows), c_blocks, search, partial), k))
    found = own.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    bounded = q_cells.join(found, "q", "left").withColumn(
        "bound", F.coalesce(bound, F.lit(float("inf")))
    ).select("q", "features", "cell", "bound")
    radii = spark.sparkContext.broadcast(radius)
    visits = bounded.mapInPandas(blocks.visits(shared, radii, metric, only_counts=True), "cell int, n long")
    v_size = np.zeros(width)
    for row in visits.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row per pivot
        v_size[row["cell"]] = row["n"]
    if v_size.sum() > GRID / 2 * max(q_size.sum(), n_rows):  # cells rule out too little
        return _all_blocks(queries, rows, k, metric, int(q_size.sum()), n_rows)
    going = cut_lineage(bounded.mapInPandas(blocks.visits(shared, radii, metric), POINT + ", cell int"))
    other = _tiled(going, c_cells, _block_counts(v_size, q_rows), c_blocks, search, partial)
    return _best(own.select("q", "c", "distance").unionByName(other), k)


def _all_blocks(queries, rows, k, metric, n_queries, n_rows):
    """(q, c, distance, rank): ``knn_join`` where every block of queries meets every block of rows.

    A tile sends one short list a query; a query merges as many lists as there are blocks.
    """
    q_blocks, c_blocks = (_block_counts([n], _block_rows(n)) for n in (n_queries, n_rows))
    lists = _tiled(queries.withColumn("cell", F.lit(0)), rows.withColumn("cell", F.lit(0)), q_blocks, c_blocks,
                   blocks.nearest_lists(k, metric), "q long, c array<long>, distance array<double>")
    near = lists.select("q", F.arrays_zip("distance", "c").alias("near")).groupBy("q").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return near.select("q", F.posexplode("near").alias("place", "n")).select(
        "q", F.col("n.c").alias("c"), F.col("n.distance").alias("distance"), (F.col("place") + 1).alias("rank"))


def knn_graph(df, row_id, k, metric="euclidean") -> DataFrame:
    """(i, j, rank, distance): the k nearest other rows of every row, ties by id."""
    table = Distinct(df, row_id)
    return _without_self(table, _lists_of(table, k, metric), k)


def _lists_of(table, k, metric):
    # A row is itself a candidate, hence one more; of a group of copies no list
    # can hold more than the first k + 1.
    return knn_join(table.queries(), table.first_of_each(k + 1), k + 1, metric)


def knn_graph_with_distance(df, row_id, k, kth, metric="euclidean"):
    """(``knn_graph``, ``kth_distance`` of ``kth``), from one search where lists are long enough."""
    table = Distinct(df, row_id)
    if kth > k + 1 or table.n_rows < kth or (table.on_a_line and metric == "euclidean"):
        return knn_graph(df, row_id, k, metric), kth_distance(df, row_id, kth, metric)
    lists = cut_lineage(_lists_of(table, k, metric))
    return _without_self(table, lists, k), _kth_of(table, lists, kth)


def _without_self(table, lists, k):
    """Lists (q, c, distance) of distinct vectors as the lists of all rows."""
    row_id = table.row_id
    joined = table.members().join(lists.withColumnRenamed("q", "rep"), "rep").filter(
        F.col("c") != F.col(row_id))
    order = Window.partitionBy(row_id).orderBy("distance", "c")
    return joined.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= k
    ).select(F.col(row_id).alias("i"), F.col("c").alias("j"), "rank", "distance")


def symmetric_graph(edges) -> DataFrame:
    """Half the sum of the graph and its reverse: (i, j, weight)."""
    both = edges.select(F.inline(F.array(F.struct("i", "j"),
                                         F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    return both.groupBy("i", "j").agg((F.count("*") * 0.5).alias("weight"))


def kth_distance(df, row_id, k, metric="euclidean") -> DataFrame:
    """Distance to the k-th nearest row, the row itself counted as the first.

    A table with fewer than ``k`` rows has no such distance and raises.
    """
    table = Distinct(df, row_id)
    if 0 < table.n_rows < k:
        raise ValueError(f"{table.n_rows} rows have no {k}-th nearest row")
    if table.on_a_line and metric == "euclidean":
        last = table.points.select("features", "rep").join(_kth_on_line(table, k), "features").select("rep", "distance")
        return table.members().join(last, "rep").select(row_id, "distance")
    return _kth_of(table, knn_join(table.queries(), table.first_of_each(k), k, metric), k)


def _kth_of(table, lists, k):
    last = lists.filter(F.col("rank") == k).select(F.col("q").alias("rep"), "distance")
    return table.members().join(last, "rep").select(table.row_id, "distance")


def _kth_on_line(table, k):
    """(features, distance) of distinct rows on a line: the k-th nearest, copies counted.

    In the order of the line the k nearest of a row are k places in a row, its own among them.
    Places are cut into blocks that overlap by k - 1, so no task sorts more than a block.
    """
    size = max(BLOCK, 4 * k)
    counted = running_sums(table.line().withColumn("n", F.least("copies", F.lit(k))), [], "x", ["n"], totals=False)
    first = F.col("cum_n") - F.col("n")
    placed = counted.select("features", "x", first.alias("first"), F.explode(F.sequence(first, F.col("cum_n") - 1)).alias("place"))
    block = lambda place: F.floor(place / size)
    spread = placed.withColumn("block", F.explode(F.sequence(
        block(F.greatest(F.col("place") - (k - 1), F.lit(0))), block(F.col("place") + (k - 1)))))
    order = Window.partitionBy("block").orderBy("place")
    x, reaches = F.col("x"), []
    for before in range(k):
        below, above = x - F.lag("x", before).over(order), F.lead("x", k - 1 - before).over(order) - x
        reaches.append(F.when(below.isNotNull() & above.isNotNull(), F.greatest(below, above)))
    own = (block(F.col("place")) == F.col("block")) & (F.col("place") == F.col("first"))
    return spread.withColumn("distance", F.array_min(F.array(*reaches))).filter(own).select("features", "distance")


def _sums_on_line(table):
    """(features, total) of distinct rows on a line: summed distance to all rows, copies counted.

    A row is x (rows up to it - rows beyond) less the sum up to it plus the sum beyond. Numbers
    are split into whole multiples of a power of two, whose sums are exact, and small rests.
    """
    span, n = table.most - table.least, int(table.n_finite)
    scale = 2.0 ** min(60 - math.frexp(n * span)[1], 900) if span else 1.0
    x = F.col("x") - F.lit(table.least)
    whole = F.floor(x * F.lit(scale)).cast("long")
    split = table.line().withColumn("whole", whole).withColumn("rest", x - F.col("whole") / F.lit(scale))
    parts = split.select("features", "x", "whole", "rest", F.col("copies").alias("n"),
                         (F.col("whole") * F.col("copies")).alias("w"), (F.col("rest") * F.col("copies")).alias("r"))
    all_w, all_r = parts.agg(F.sum("w"), F.sum("r")).first()
    placed = running_sums(parts, [], "x", ["n", "w", "r"], totals=False)
    more = F.col("cum_n") * 2 - F.lit(n)
    exact = F.col("whole") * more - F.col("cum_w") * 2 + F.lit(all_w)
    return placed.select("features", (exact / F.lit(scale) + (F.col("rest") * more - F.col("cum_r") * 2 + F.lit(all_r))).alias("total"))


def nearest_in(left, right, row_id, metric="euclidean") -> DataFrame:
    """(row_id, nearest, distance): the closest row of another table, ties by id."""
    table = Distinct(left, row_id)
    others = collapse(right, row_id).select(F.col("rep").alias("c"), "features")
    best = knn_join(table.queries(), others, 1, metric).select(
        F.col("q").alias("rep"), F.col("c").alias("nearest"), "distance")
    return table.members().join(best, "rep").select(row_id, "nearest", "distance")


def _block_rows(n_rows):
    """Rows of a block where all blocks meet: a row is sent to ``GRID`` tiles, whatever the rows."""
    return max(BLOCK_ROWS, -(-n_rows // GRID))


def _block_pairs(points, n_rows, run, schema, *more):
    """Tiles of (q, features, *more): every pair of blocks once, a block with itself included.

    A row is sent to one tile more than there are blocks.
    """
    (count,) = _block_counts([n_rows], _block_rows(n_rows))
    block = F.pmod(F.xxhash64("q"), F.lit(count).cast("long")).cast("int")
    numbers = F.sequence(F.lit(0), F.lit(count - 1))
    placed = points.select("q", "features", block.alias("block"), *more)
    left = placed.withColumn("other", F.explode(F.filter(numbers, lambda o: o >= F.col("block"))))
    right = placed.select(F.col("q").alias("c"), F.col("features").alias("row_vector"), F.col("block").alias("other"),
                          F.explode(F.filter(numbers, lambda o: o <= F.col("block"))).alias("block"), *more)
    keys = ["block", "other"]
    return shipped(left.withColumnRenamed("features", "query_vector")).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _sums_to(points, metric):
    """(q, method, cluster, total): of (q, features, groups) every block against every block.

    ``groups`` are structs method, cluster and copies: the rows that a vector stands for.
    """
    known = F.filter("groups", lambda g: g["cluster"].isNotNull())
    sides = points.withColumn("groups", known).select(
        "q", "features", *[F.col(f"groups.{name}").alias(name) for name in ("method", "cluster", "copies")])
    sums = _block_pairs(sides, points.count(), blocks.distance_sums(metric), "q long, method int, cluster int, total double",
                        "method", "cluster", "copies")
    return sums.groupBy("q", "method", "cluster").agg(F.sum("total").alias("total"))


def cluster_distance_sums(groups, metric="euclidean") -> DataFrame:
    """(rep, method, own, copies, cluster, total): summed distance of the rows of ``groups`` to
    all rows of each cluster of the same method.

    ``groups`` is (rep, features, method, cluster, copies), copies of a vector in one cluster being
    one row. Vectors are compared once for all methods.
    """
    points = cut_lineage(groups.groupBy("features").agg(
        F.min("rep").alias("q"), F.collect_list(F.struct("rep", "method", "cluster", "copies")).alias("groups")))  # one for each cluster
    own = points.select("q", F.inline("groups")).withColumnRenamed("cluster", "own")
    return _sums_to(points, metric).join(own, ["q", "method"]).drop("q")


def distance_summary(df, row_id, metric="euclidean") -> DataFrame:
    """(row_id, total, mean): summed and mean distance of each row to all others."""
    table = Distinct(df, row_id)
    if table.narrow and metric == "euclidean":  # a row without a number is at no distance from others: null
        sums = table.points.select("features", "rep").join(_sums_on_line(table), "features", "left").select("rep", "total")
    else:
        one = F.array(F.struct(F.lit(0).alias("method"), F.lit(0).alias("cluster"), "copies"))
        points = table.points.select(F.col("rep").alias("q"), "features", one.alias("groups"))
        sums = _sums_to(points, metric).select(F.col("q").alias("rep"), "total")
    return table.members().join(sums, "rep").select(
        row_id, "total", F.try_divide(F.col("total"), F.lit(float(table.n_rows - 1))).alias("mean"))


def diameter(df, row_id, metric="euclidean") -> DataFrame:
    """One row: the largest distance between any two rows (see ``farthest_search``)."""
    return farthest_search(df, row_id, metric).select("diameter")


def farthest_search(df, row_id, metric="euclidean") -> DataFrame:
    """One row: diameter, compared (pairs whose distance was computed), rows (distinct ones).

    Rows fall into the cells of their nearest pivots. For every pair of cells the distance
    of any two of their rows is bounded from above; pairs are visited in the order of their
    bounds, twice as many in a round as in the one before, and what the largest distance
    found so far rules out is never compared: pairs of cells, and in a visited pair the rows
    too near to the other cell. The search starts from the largest distance of a row
    to a pivot. Bounds hold under rounding.
    """
    spark = df.sparkSession
    table = Distinct(df, row_id)
    points, n = table.queries(), table.n_points
    result = "diameter double, compared long, rows long"
    if n < 2:
        return spark.createDataFrame([(0.0 if n else None, 0, n)], result)
    count = min(FARTHEST_CELLS, -(-n // BLOCK_ROWS))
    pivots = _pick_pivots(points.withColumnRenamed("q", "c"), count) if count > 1 else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(pivots)
    if len(pivots) == 1:  # one block, or equal pivots
        cells = points.withColumn("cell", F.lit(0))
        size, bounds, best, order = np.array([float(n)]), np.array([[math.inf]]), 0.0, [(0, 0)]
        radius = np.array([math.inf])
    else:
        cells = cut_lineage(shipped(points).mapInPandas(
            blocks.reaches(shared, metric), POINT + ", cell int, rho double, away double, far double"))
        size, radius, away = _per_cell(cells, len(pivots), F.count("*"), F.max("rho"), F.max("away"))
        best = cells.agg(F.max("far")).first()[0]
        bounds = blocks.pair_bounds(pivots, radius, away, metric)
        bounds[size == 0], bounds[:, size == 0] = -1.0, -1.0
        i, j = np.triu_indices(len(pivots))
        order = [(int(a), int(b)) for a, b in zip(i, j) if bounds[a, b] > best]
        order.sort(key=lambda p: -bounds[p])
    many = np.array(_block_counts(size, _block_rows(n)))
    sends = size[:, None] * many[None, :] + size[None, :] * many[:, None]  # rows sent for a pair of cells
    compared, sent, together = 0, 0.0, FIRST_PAIRS
    while True:
        order = [p for p in order if bounds[p] > best]
        if not order:
            break
        if sent > GRID / 4 * n and sends[tuple(np.array(order).T)].sum() > GRID * n:
            # Bounds rule out too little: the rows of all pairs left meet in blocks.
            left_over = sorted({c for p in order for c in p})
            best, more = _farthest_of(cells.filter(F.col("cell").isin(left_over)), best, metric)
            compared += more
            break
        within = int(np.searchsorted(np.cumsum(sends[tuple(np.array(order).T)]), GRID * n, "right"))  # a crowded cell is in many pairs
        most = max(1, min(together, within))
        pairs, order = order[:most], order[most:]
        together, sent = together * 2, sent + sends[tuple(np.array(pairs).T)].sum()
        numbered = spark.createDataFrame(  # two rows per pair of this round
            [(n, a, b, 0) for n, (a, b) in enumerate(pairs)] + [(n, b, a, 1) for n, (a, b) in enumerate(pairs)],
            "pair int, cell int, other int, side int")
        sides = cells.select("q", "features", "cell").join(F.broadcast(numbered), "cell")
        if len(pivots) > 1:
            kept = blocks.beyond(shared, spark.sparkContext.broadcast(radius), best, metric)
            sides = sides.select("q", "features", "pair", "other", "side").mapInPandas(
                kept, POINT + ", pair int, side int")
        left = sides.filter("side = 0").select("q", "features", F.col("pair").alias("cell"))
        right = sides.filter("side = 1").select(F.col("q").alias("c"), "features", F.col("pair").alias("cell"))
        tiles = _tiled(left, right, [int(many[a]) for a, _ in pairs], [int(many[b]) for _, b in pairs],
                       blocks.farthest(metric), "distance double, compared long")
        found = tiles.agg(F.max("distance"), F.sum("compared")).first()
        best, compared = max(best, found[0] or 0.0), compared + (found[1] or 0)
    return spark.createDataFrame([(best, compared, n)], result)


def _farthest_of(points, best, metric):
    """(largest distance, pairs compared) of (q, features), every pair of blocks once."""
    found = _block_pairs(points, points.count(), blocks.farthest(metric), "distance double, compared long").agg(
        F.max("distance"), F.sum("compared")).first()
    return max(best, found[0] or 0.0), found[1] or 0
