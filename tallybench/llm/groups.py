"""Joins on keys of which one may hold a third of all rows, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import join_groups
from ..session import cut_lineage

#: Links in a partition while components are found.
PARTITION_LINKS = 200_000
#: Bits of the filter of ``among``: one broadcast megabyte, whatever the data.
FILTER_BITS = 1 << 23


def among(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows with ``_maybe``: false only if their key is not in ``wanted``.

    Rows that are surely not wanted need no shuffle for a join. The filter has a fixed
    size; with very many keys it lets more rows pass, which costs time and no result.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(FILTER_BITS)) + 1
    bits = (wanted.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits")))
    marked = rows.withColumn("_place", place).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    byte = "conv(hex(substring(_bits, cast(bitmap_bit_position(_place) div 8 + 1 as int), 1)), 16, 10)"
    bit = F.expr(f"(shiftright(cast({byte} as int), cast(bitmap_bit_position(_place) % 8 as int)) & 1) = 1")
    return (marked.join(F.broadcast(bits), "_bucket", "left")
            .withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_place", "_bucket", "_bits"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, total: int) -> DataFrame:
    """Rows with the columns that ``table`` (one row a key) has for their key; inner."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_size"))
    return join_groups(rows, table.join(sizes, key), [key], total)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root: the least node reachable.

    Labels spread along links; every third round they are also replaced by the label of
    their label, so rounds grow with the logarithm of the longest path. Labels of nodes
    with many links are broadcast (see ``join_groups``). Each round is checkpointed.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = cut_lineage(both)
    total = max(both.count(), 1)
    # A graph of one partition needs no shuffle at all, and every round is many small steps.
    parts = -(-total // PARTITION_LINKS)
    both = both.coalesce(parts)
    cut = lambda df: cut_lineage(df).coalesce(parts)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"), F.count("*").alias("_size"))
                         .select("node", F.least("node", "_least").alias("root"), "_size"))
    step = 0
    while True:
        step += 1
        near = join_groups(both, labels.select(F.col("node").alias("b"), F.col("root").alias("_root"), "_size"), ["b"], total)
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("_root").alias("_near"))
        moved = F.col("_near") < F.col("root")
        labels = cut(labels.drop("_moved").join(near, "node").select("node", F.least("root", "_near").alias("root"), "_size", moved.alias("_moved")))
        if labels.where("_moved").isEmpty():
            return labels.select("node", "root")
        if step % 3 == 0:
            up = labels.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            labels = cut(looked_up(labels, "root", up, total).select("node", F.least("root", "_up").alias("root"), "_size"))
