"""Near duplicates: fast similarity sketches, banding, exact checks, components.

1. Every text becomes the set of its distinct shingles (64-bit hashes). Texts with equal
   sets (128-bit set hash) are one node; texts without words have no set and no links.
2. A set is sketched by rounds of hashed bin placement: every round throws all items into
   bins, values of later rounds are larger, and after as many rounds as there are bins each
   bin gets a round of its own, so that all coordinates fill and are unbiased. ``BINS``
   coordinates in bands of ``ROWS`` make 64 keys: a pair at similarity 0.8 shares none with
   a chance of 8 in a million.
3. The nodes of a bucket are checked against one of them, on full sets; the links that hold
   make first components.
4. What may still link two components of one bucket is checked without writing out pairs:
   nodes that unresolved buckets connect form families, families are cut into blocks by
   set size and component, and a task compares two blocks at a time by a matrix product.
   Blocks of one component, or of sizes too different to link, are never compared.
5. Connected components of all links give the classes.

Null and empty texts get an empty set, are their own component and are kept. Rows that share
an id and a text are one document; rows that share an id but not the text are judged apart. A null id is less than any other.
Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..shipping import shipped
from .groups import among, components, join_groups, looked_up
from .words import LOWER, Block, blocks, mix
from .workers import tidy

BINS = 512
ROWS = 8
SHINGLE = 5
PERCENT = 80
BLOCK_ITEMS = 1 << 17  # shingles of a block of nodes, about
HUB_ROWS = 500         # nodes checked against one hub in a task
CHUNK = 4096           # shingles in a step of a matrix product


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every distinct shingle, by text and hash. Texts with fewer words
    than ``size`` have their whole sequence as one shingle, texts without words none."""
    hashes = block.hashes()
    at, windows = block.window_hashes(hashes, size)
    doc = block.doc[at]
    n_words, first = block.n_words, block.word_starts[:-1]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    whole = np.array([_sequence(hashes[first[d]: first[d] + n_words[d]]) for d in short], np.uint64)
    doc, windows = np.concatenate([doc, short]), np.concatenate([windows, whole])
    order = np.lexsort((windows, doc))
    doc, windows = doc[order], windows[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (windows[1:] != windows[:-1])
    return doc[new], windows[new]


def _sequence(hashes: np.ndarray) -> np.uint64:
    out = np.array([len(hashes)], np.uint64)
    for h in hashes:
        out = mix(out + h)
    return out[0]


def sketches(doc: np.ndarray, items: np.ndarray, texts: int, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per text: round << 48 | hash, the least of its bin.

    Round i < bins throws every item into a random bin; round bins + i throws all items into
    bin i, so that every bin is filled after 2 * bins rounds; rounds end once no bin is
    empty. A value of a later round is always larger, so rounds may be done several at once.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(texts * bins, empty, np.uint64)
    start, width = 0, 4
    while start < 2 * bins and len(items):
        for i in range(start, min(start + width, 2 * bins)):
            h = mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            bin_ = (h & np.uint64(bins - 1)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
            np.minimum.at(table, doc * bins + bin_, np.uint64(i << 48) | (h >> np.uint64(16)))
        start += width
        width = min(2 * width, 64)
        full = (table.reshape(texts, bins) != empty).all(axis=1)
        left = ~full[doc]
        doc, items = doc[left], items[left]
    return table.reshape(texts, bins)


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; the band is part of the key."""
    bands = table.reshape(len(table), -1, rows)
    out = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return out


def set_hashes(doc: np.ndarray, items: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit hashes of each set."""
    bounds = np.searchsorted(doc, np.arange(texts + 1))
    parts = []
    for salt in (0x1234567, 0xABCDEF1):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(items + np.uint64(salt)))])
        parts.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return np.diff(bounds), *parts


def sketched(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """One row per text: _id, n (shingles), k1, k2 (hashes of the set), keys (of the bands)."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["_id", "n", "k1", "k2", "keys"]

    @tidy("minhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), LOWER):
                doc, items = shingle_sets(block, size)
                n, k1, k2 = set_hashes(doc, items, block.texts)
                keys = band_keys(sketches(doc, items, block.texts)).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(block.texts + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.texts), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), keys], names)

    return shipped(docs.select(key, text)).mapInArrow(run, f"_id {kind}, n long, k1 long, k2 long, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(node, items): the sorted set of each wanted node (node, _id, k1, k2)."""
    wanted = wanted.withColumn("_wanted", F.col("_id"))
    rows = among(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), wanted, ["_id"]).where("_maybe")
    rows = rows.join(wanted.drop("_id"), F.col("_id").eqNullSafe(F.col("_wanted"))).select("_text", "node", "k1", "k2")

    @tidy("minhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), LOWER):
                doc, items = shingle_sets(block, size)
                _, k1, k2 = set_hashes(doc, items, block.texts)
                part = batch.slice(block.first, block.texts)
                own = (k1 == part.column(2).to_numpy()) & (k2 == part.column(3).to_numpy())
                bounds = np.searchsorted(doc, np.arange(block.texts + 1))
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(1), sets], ["node", "items"]).filter(pa.array(own))

    return shipped(rows).mapInArrow(run, "node long, items array<long>").dropDuplicates(["node"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of list rows, joined, and the sizes of the rows."""
    lists = column.combine_chunks()
    return np.array(lists.flatten()).view(np.uint64), np.diff(np.array(lists.offsets))


def linked(shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return (100 * shared >= percent * (n_a + n_b - shared)) & (shared > 0)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def check_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; b is a hub, its pairs are split over tasks."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    members = looked_up(pairs, "b", parts, max(pairs.count(), 1)).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    members = members.join(sets.withColumnRenamed("node", "a"), "a").select("a", "b", "part", "items")
    hubs = parts.join(sets.withColumnRenamed("node", "b"), "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("b").alias("hub"), F.col("part").alias("hub_part"), F.col("items").alias("own"))

    def check(members: pa.Table, hub: pa.Table) -> pa.Table:
        if not members.num_rows or not hub.num_rows:
            return _LINK.empty_table()
        own, _ = _flat(hub["own"])
        items, n = _flat(members["items"])
        at = np.minimum(np.searchsorted(own, items), len(own) - 1)
        total = np.concatenate([[0], np.cumsum(own[at] == items)])
        ends = np.cumsum(n)
        good = linked(total[ends] - total[ends - n], n, len(own), percent)
        return members.select(["a", "b"]).filter(pa.array(good))

    return members.groupBy("b", "part").cogroup(hubs.groupBy("hub", "hub_part")).applyInArrow(check, "a long, b long")


def least_hubs(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components as those of nodes ``a`` with hubs ``b``.

    A node and its other hubs are linked with its least one. It has a hub a band at most.
    """
    hubs = links.where("a <> b").groupBy("a").agg(F.collect_set("b").alias("hubs"))
    stars = hubs.select(F.explode(F.array_append("hubs", F.col("a"))).alias("a"), F.array_min("hubs").alias("b"))
    return stars.where("a <> b").distinct()


def check_blocks(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes (node, family, root, n) of one family and different roots.

    Sizes of linked sets differ by a factor of 100 / percent at most, so size classes with
    that step link within a class or to the next. Components with enough nodes get blocks
    of their own; blocks whose nodes all have one root are not compared.
    """
    step = float(np.log(100 / percent)) + 1e-12
    total = max(nodes.count(), 1)
    nodes = nodes.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    sizes = nodes.groupBy("family", "class", "root").agg(F.sum("n").alias("_n"))
    sizes = sizes.withColumn("lead", F.when(F.col("_n") >= BLOCK_ITEMS, F.col("root")).otherwise(-1))
    parts = sizes.groupBy("family", "class", "lead").agg(F.ceil(F.sum("_n") / BLOCK_ITEMS).cast("int").alias("parts"))
    place = sizes.join(parts, ["family", "class", "lead"]).select("family", "class", "root", "lead", "parts")
    family = nodes.groupBy("family").agg(F.count("*").alias("_size"))
    nodes = join_groups(nodes, place.join(family, "family"), ["family", "class", "root"], total)
    nodes = cut_lineage(nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    block = ["family", "class", "lead", "part"]
    all_blocks = nodes.groupBy(*block).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("_size"))
    one = all_blocks.select("family", F.struct("class", "lead", "part").alias("x"), F.col("low").alias("xl"), F.col("high").alias("xh"))
    two = all_blocks.select("family", F.struct("class", "lead", "part").alias("y"), F.col("low").alias("yl"), F.col("high").alias("yh"))
    tiles = (one.join(two, "family").where((F.col("x") <= F.col("y")) & (F.abs(F.col("x.class") - F.col("y.class")) <= 1))
             .where(F.least("xl", "yl") < F.greatest("xh", "yh"))
             .select("family", "x", "y", F.xxhash64("family", "x", "y").alias("tile")))
    uses = tiles.select("family", "tile", F.col("x").alias("_b"), F.lit(0).alias("side")).union(tiles.select("family", "tile", F.col("y").alias("_b"), F.lit(1).alias("side")))
    uses = uses.select("family", "tile", "side", "_b.*")
    rows = nodes.join(sets, "node").join(uses, block).select("tile", "family", "side", "node", "root", "n", "items")

    def compare(table: pa.Table) -> pa.Table:
        side, root, n = (np.array(table[c]) for c in ("side", "root", "n"))
        node = np.array(table["node"])
        items, size = _flat(table["items"])
        row = np.repeat(np.arange(len(node)), size)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        place = np.empty(len(node), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        # only shingles on both sides count
        mine, theirs = side[row] == 0, side[row] == 1
        common = np.intersect1d(items[mine], items[theirs])
        at = np.searchsorted(common, items)
        known = at < len(common)
        known[known] = common[at[known]] == items[known]
        shared = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, len(common), CHUNK):
            width = min(CHUNK, len(common) - start)
            here = known & (at >= start) & (at < start + width)
            x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            x[place[row[here & mine]], at[here & mine] - start] = 1
            y[place[row[here & theirs]], at[here & theirs] - start] = 1
            shared += x @ y.T
        good = linked(shared.astype(np.int64), n[left][:, None], n[right][None, :], percent) & (root[left][:, None] != root[right][None, :])
        # a link per pair of roots is enough: both sides are components already
        i, j = np.nonzero(good)
        ends = np.sort(np.stack([root[left][i], root[right][j]], axis=1), axis=1)
        _, first = np.unique(ends, axis=0, return_index=True)
        return pa.Table.from_arrays([pa.array(node[left][i[first]]), pa.array(node[right][j[first]])], schema=_LINK)

    return rows.groupBy("tile", "family").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    rows = cut_lineage(sketched(docs, size, key, text).withColumn("_row", F.monotonically_increasing_id()))
    classes = rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("_id", "_row")).alias("head"), F.count("*").alias("_size"))
    classes = cut_lineage(classes.select("k1", "k2", "n", "_size", F.col("head._id").alias("_id"), F.col("head._row").alias("node")))
    nodes = rows.select(F.col("_row").alias("node"), "keys").join(classes.select("node", "n"), "node")
    bands = nodes.select("node", "n", F.explode("keys").alias("key"))
    total = max(classes.count(), 1) * (BINS // ROWS)

    # one node of each bucket against the others
    buckets = bands.groupBy("key").agg(F.count("*").alias("_size"), F.min(F.struct("node", "n")).alias("hub")).where("_size > 1")
    shared = cut_lineage(join_groups(bands, buckets.withColumn("crowd", F.col("_size")), ["key"], total))
    alike = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    pairs = cut_lineage(shared.where((F.col("node") != F.col("hub.node")) & alike).select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct())
    wanted = shared.select("node").distinct().join(classes.select("node", "_id", "k1", "k2"), "node")
    sets = cut_lineage(full_sets(docs, wanted, size, key, text))
    links = cut_lineage(check_hubs(pairs, sets, percent))

    # what may still join components that share a bucket
    first = components(least_hubs(links))
    placed = shared.where("crowd > 2").select("node", "n", "key", F.col("hub.node").alias("hub"), F.col("crowd").alias("_size"))
    placed = placed.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_size")).where("_low < _high").select("key", "_size")
    open_ = cut_lineage(join_groups(placed.drop("_size"), mixed, ["key"], total))
    families = components(least_hubs(open_.select(F.col("node").alias("a"), F.col("hub").alias("b")))).select("node", F.col("root").alias("family"))
    unsure = open_.select("node", "n", "root").distinct().join(families, "node")
    more = check_blocks(cut_lineage(unsure), sets, percent)

    # only the components that the new links name are joined once more
    first = first.withColumnRenamed("root", "_first")
    ends = cut_lineage(more.select("a", F.col("b")))
    for end in ("a", "b"):
        ends = ends.join(first, ends[end] == first["node"], "left").withColumn(end, F.coalesce("_first", end)).select("a", "b")
    merged = components(ends)
    placed = first.join(merged.select(F.col("node").alias("_first"), "root"), "_first", "left").select("node", F.coalesce("root", "_first").alias("root"))
    joined = cut_lineage(placed.unionByName(merged.join(first.select("node"), "node", "left_anti")))
    least = (joined.join(classes.select("node", "_id"), "node").groupBy("root").agg(F.min(F.struct("_id"))["_id"].alias("component_id"), F.count("*").alias("_size")))
    named = join_groups(joined, least, ["root"], total).select("node", "component_id")
    found = classes.join(named.withColumn("_named", F.lit(True)), "node", "left").select("k1", "k2", "n", "_size", F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
    filled = join_groups(rows.where("n > 0").select("_id", "n", "k1", "k2"), found, ["k1", "k2", "n"], max(rows.count(), 1))
    out = filled.select("_id", "n", "component_id").unionByName(rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
