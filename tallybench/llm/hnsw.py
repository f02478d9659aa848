"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Equal vectors are one entry of the index (with the smallest ids that a result can need, so
copies of one vector cost nothing); entries are dealt to shards by a hash, at most about
``SHARD_ROWS`` each. A task builds a shard's hierarchical graph and stores it as flat arrays:
entries in order of falling level, and for each level the neighbours of its first entries.
Entries get one more coordinate that makes all norms equal, so that the largest inner
product is the nearest neighbour. Queries go through every shard in blocks, many queries in
lock step; the best of each shard are scored exactly in double precision and merged.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part,
nor do rows with a null id; rows repeated with id and vector count once. Vectors of
different length are never compared. Other columns are not read. With fewer candidates than
``k`` all that were found are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..shipping import shipped

SHARDS = 16          # at least; more when entries would not fit SHARD_ROWS a shard
SHARD_ROWS = 16_384
DEGREE = 16          # neighbours above level 0; twice as many at level 0
BUILD_WIDTH = 64     # candidates kept while an entry is placed
SEARCH_WIDTH = 128
QUERY_BLOCK = 8192
LOCK_STEP = 256


# -- one graph ---------------------------------------------------------------------------

def beam(points: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in lock step: ids and scores, best first (-1: none)."""
    n_queries, row = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n_queries, width), -1, np.int32)
    scores = np.full((n_queries, width), -np.inf, np.float32)
    entries = entries[:, :width]
    some = entries >= 0
    ids[:, : entries.shape[1]] = entries
    scores[:, : entries.shape[1]] = np.where(some, np.einsum("qd,qkd->qk", queries, points[entries]), -np.inf)
    seen = np.zeros((n_queries, len(points) + 1), bool)
    seen[row, entries] = True
    seen[:, -1] = True  # the place of -1
    open_ = ids >= 0
    while True:
        rank = np.where(open_, scores, -np.inf)
        pick = np.argpartition(-rank, min(step, width) - 1, axis=1)[:, : min(step, width)]
        live = np.isfinite(np.take_along_axis(rank, pick, 1))
        busy = np.flatnonzero(live.any(axis=1))
        if not len(busy):
            break
        np.put_along_axis(open_, pick, False, 1)
        pick, live, at = pick[busy], live[busy], busy[:, None]
        near = np.where(live[:, :, None], graph[np.where(live, ids[at, pick], 0)], -1).reshape(len(busy), -1)
        near[seen[at, near]] = -1
        # an entry reached twice in this step counts once
        order = np.argsort(near, axis=1, kind="stable")
        ordered = np.take_along_axis(near, order, 1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        near = ordered
        seen[at, near] = True
        found = near >= 0
        new = np.full(near.shape, -np.inf, np.float32)
        q, k = np.nonzero(found)
        new[q, k] = np.einsum("nd,nd->n", queries[busy[q]], points[near[q, k]])
        all_scores = np.concatenate([scores[busy], new], axis=1)
        all_ids = np.concatenate([ids[busy], near], axis=1)
        all_open = np.concatenate([open_[busy], found], axis=1)
        best = np.argpartition(-all_scores, width - 1, axis=1)[:, :width]
        scores[busy] = np.take_along_axis(all_scores, best, 1)
        ids[busy] = np.take_along_axis(all_ids, best, 1)
        open_[busy] = np.take_along_axis(all_open, best, 1) & np.isfinite(scores[busy])
    order = np.argsort(-scores, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    ids[~np.isfinite(scores)] = -1
    return ids, scores


def spread(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of entries ``own`` out of their candidates (-1: none), at most ``degree``.

    From the nearest on, a candidate is taken if it is nearer to the entry than to all taken
    before; the nearest of the others fill what is left.
    """
    near = points[candidates]
    score = np.where(candidates >= 0, np.einsum("bd,bcd->bc", points[own], near), -np.inf)
    order = np.argsort(-score, axis=1, kind="stable")[:, : max(2 * degree, BUILD_WIDTH)]
    candidates, score = np.take_along_axis(candidates, order, 1), np.take_along_axis(score, order, 1)
    near = points[candidates]
    between = np.matmul(near, near.transpose(0, 2, 1))
    taken = np.zeros(candidates.shape, bool)
    for j in range(candidates.shape[1]):
        blocked = (taken[:, :j] & (between[:, :j, j] > score[:, j][:, None])).any(axis=1)
        taken[:, j] = ~blocked & (candidates[:, j] >= 0) & (taken[:, :j].sum(axis=1) < degree)
    rank = np.where(taken, score + 4 * np.abs(score[:, :1]) + 4, score)  # taken ones first
    order = np.argsort(-rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(candidates, order, 1)
    out[~np.isfinite(np.take_along_axis(score, order, 1))] = -1
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


def link_back(points: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    """Add the reverse of the edges of the entries ``new``; full lists are chosen anew."""
    degree = graph.shape[1]
    target, source = graph[new].ravel(), np.repeat(new, degree)
    target, source = target[target >= 0], source[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order].astype(np.int32)
    own, first, count = np.unique(target, return_index=True, return_counts=True)
    for start in range(0, len(own), 512):
        part = slice(start, start + 512)
        most = int(count[part].max(initial=0))
        column = np.arange(most)[None, :]
        at = np.minimum(first[part][:, None] + column, len(source) - 1)
        incoming = np.where(column < count[part][:, None], source[at], -1)
        incoming[(incoming[:, :, None] == graph[own[part]][:, None, :]).any(axis=2)] = -1
        graph[own[part]] = spread(points, own[part], np.concatenate([graph[own[part]], incoming], axis=1), degree)


def exact_layer(points: np.ndarray, n: int, degree: int) -> np.ndarray:
    """The graph of the first ``n`` points, candidates found by comparing them all."""
    graph = np.full((n, degree), -1, np.int32)
    width = min(BUILD_WIDTH, n - 1)
    if width < 1:
        return graph
    for start in range(0, n, 512):
        own = np.arange(start, min(start + 512, n))
        score = points[own] @ points[:n].T
        score[np.arange(len(own)), own] = -np.inf
        graph[own] = spread(points, own, np.argpartition(-score, width - 1, axis=1)[:, :width].astype(np.int32), degree)
    link_back(points, graph, np.arange(n))
    return graph


def build(vectors: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the entries (falling level) and the graph of each level, level 0 first."""
    draw = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0**53
    level = np.floor(-np.log(np.maximum(draw, 1e-18)) / np.log(DEGREE)).astype(int)
    order = np.lexsort((keys, -level))
    level = level[order]
    points = lifted(vectors[order])
    n = len(points)
    sizes = [n] + [s for l in range(1, int(level.max(initial=0)) + 1) if (s := int((level >= l).sum())) > 1]
    layers = [exact_layer(points, s, DEGREE) for s in sizes[1:]]
    ground = np.full((n, 2 * DEGREE), -1, np.int32)
    done = min(n, max(512, sizes[1] if len(sizes) > 1 else 0))
    ground[:done] = exact_layer(points, done, 2 * DEGREE)
    while done < n:
        new = np.arange(done, min(done + min(512, done), n))
        near = np.concatenate([search(points[:done], [ground[:done], *layers], points[new[s: s + LOCK_STEP]], BUILD_WIDTH)[0]
                               for s in range(0, len(new), LOCK_STEP)])
        score = points[new] @ points[new].T
        np.fill_diagonal(score, -np.inf)
        width = min(DEGREE, len(new) - 1)
        peers = new[np.argpartition(-score, width - 1, axis=1)[:, :width]].astype(np.int32) if width else np.zeros((len(new), 0), np.int32)
        ground[new] = spread(points, new, np.concatenate([near, peers], axis=1), 2 * DEGREE)
        link_back(points, ground, new)
        done = new[-1] + 1
    return order, [ground, *layers]


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more coordinate that makes their norms equal."""
    square = (vectors * vectors).sum(axis=1)
    scale = max(float(square.max(initial=0.0)), 1e-300)
    more = np.sqrt(np.maximum(scale - square, 0))
    return (np.concatenate([vectors, more[:, None]], axis=1) / np.sqrt(scale)).astype(np.float32)


def search(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Down the levels from entry 0; ``layers`` has level 0 first."""
    entries = np.zeros((len(queries), 1), np.int32)
    for graph in layers[:0:-1]:
        entries = beam(points[: len(graph)], graph, queries, entries, 8, 1)[0]
    return beam(points, layers[0], queries, entries, width)


# -- over Spark --------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """A vector that takes part: filled, finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(table: DataFrame, key: str, vector: str) -> DataFrame:
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("v")))


def index(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The stored graphs, one row per shard (and vector length), and the number of shards."""
    shards = max(SHARDS, -(-rows.count() // SHARD_ROWS))
    first = W.partitionBy("key", "v").orderBy("id")
    entries = (rows.withColumn("key", F.xxhash64("v")).withColumn("_place", F.dense_rank().over(first))
               .where(F.col("_place") <= k + 1)  # a result needs no more copies of one vector
               .groupBy("key", "v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
               .withColumn("dim", F.size("v")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")))

    def make(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        vectors = np.array(table["v"].combine_chunks().flatten()).reshape(-1, dim)
        order, layers = build(vectors, np.array(table["key"]).view(np.uint64))
        ids = table["ids"].combine_chunks().take(pa.array(order))
        row = {"dim": dim, "shard": table["shard"][0].as_py(), "vectors": vectors[order].tobytes(),
               "layers": [g.tobytes() for g in layers], "sizes": [len(x) for x in ids.to_pylist()],
               "ids": np.array(ids.flatten(), np.int64).tobytes()}
        return pa.Table.from_pylist([row], schema=_STORED)

    stored = shipped(entries).groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, vectors binary, layers array<binary>, sizes array<int>, ids binary")
    return cut_lineage(stored), shards


_STORED = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("layers", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_in_shard(stored: dict, queries: np.ndarray, query_ids: np.ndarray, k: int, width: int) -> Iterator[pa.Table]:
    """The k nearest rows of one shard for each query, scored exactly."""
    dim = stored["dim"]
    vectors = np.frombuffer(stored["vectors"]).reshape(-1, dim)
    layers = [np.frombuffer(g, np.int32).reshape(-1, 2 * DEGREE if not l else DEGREE) for l, g in enumerate(stored["layers"])]
    points, ids, sizes = lifted(vectors), np.frombuffer(stored["ids"], np.int64), np.array(stored["sizes"])
    first = np.cumsum(sizes) - sizes
    for start in range(0, len(queries), LOCK_STEP):
        part = queries[start: start + LOCK_STEP]
        norm = np.sqrt((part * part).sum(axis=1))[:, None]
        unit = np.concatenate([part / norm, np.zeros((len(part), 1))], axis=1).astype(np.float32)
        near = search(points, layers, unit, max(width, k + 1))[0]
        q, c = np.nonzero(near >= 0)
        entry = near[q, c]
        score = np.einsum("nd,nd->n", part[q], vectors[entry])
        size = sizes[entry]
        row = np.repeat(np.arange(len(entry)), size)
        member = ids[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[entry], size)]
        owner, score = q[row], score[row]
        other = member != query_ids[start + owner]
        owner, member, score = owner[other], member[other], score[other]
        order = np.lexsort((member, -score, owner))
        owner, member, score = owner[order], member[order], score[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        top = place < k
        yield pa.Table.from_arrays([pa.array(query_ids[start + owner[top]]), pa.array(member[top]), pa.array(score[top])], schema=_FOUND)


def nearest(table: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_WIDTH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each query row."""
    rows = cut_lineage(vectors_of(table, key, vector))
    stored, shards = index(rows, k)
    asked = vectors_of(queries, key, vector).distinct().withColumn("dim", F.size("v"))
    parts = -(-max(asked.count(), 1) // QUERY_BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def find(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows or not stored.num_rows:
            return _FOUND.empty_table()
        one = stored.to_pylist()[0]
        vectors = np.array(asked["v"].combine_chunks().flatten()).reshape(-1, one["dim"])
        return pa.concat_tables(nearest_in_shard(one, vectors, np.array(asked["id"]), k, width))

    by = ["dim", "shard", "block"]
    found = asked.groupBy(*by).cogroup(stored.groupBy(*by)).applyInArrow(find, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
