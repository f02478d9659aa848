"""Balanced label propagation: copies end up in one shard while shards stay even.

Law ``rows``: the row counts of any two shards differ by one at most. Documents are linked
if their texts are equal.

1. ``placement``: groups of linked documents start whole. Groups of one size are
   interchangeable, so they are placed by the number of groups of each size (rows of a table
   have fewer sizes than twice their root), the largest first, once into the tightest and
   once into the emptiest shard that holds them; the start with fewer parts is taken. A
   group is cut only if no shard has room for all of it. Each cut fills a shard, so fewer
   groups are cut than there are shards; one larger than a quota has to be.
2. ``propagate``: the parts of cut groups move to shards that hold more of their group, into
   free room or in exchange for as many rows of another cut group, whichever shard is full,
   until no move is left that raises the number of linked pairs inside shards.
3. Documents without links then fill the quotas exactly.

Rows with one group may be a third of the table, so nothing is dealt by group alone: counts
are pre-aggregated, and what is decided for a group goes to its rows by a broadcast of the
few large groups and by a shuffled join for the others (``groups.join_groups``).

Null texts have size 8, checksum 0 and no links. Repeated rows are rows of their own. An
empty table gives an empty result. Only the key and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .groups import join_groups
from .ranks import ranked

SHARDS = 24


def documents_with_size(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key), (F.octet_length(whole) + 8).cast("long").alias("size"),
                       F.crc32(whole).alias("text_crc32"), F.md5(F.col(text).cast("binary")).alias("_link"))


def placement(sizes: dict[int, int], quotas: list[int], tight: bool) -> tuple[list, list, list[int]]:
    """Whole groups (size, first, end, shard), cut groups (size, number, {shard: rows}), room left.

    ``sizes`` holds the number of groups of each size; groups of a size are numbered from 0.
    """
    room, whole, cut = list(quotas), [], []
    for size in sorted(sizes, reverse=True):
        count, done = sizes[size], 0

        def into(shard: int, groups: int) -> int:
            if groups:
                whole.append((size, done, done + groups, shard))  # noqa: B023
                room[shard] -= groups * size  # noqa: B023
            return groups

        if tight:
            for shard in sorted(range(len(room)), key=lambda s: (room[s], s)):
                done += into(shard, min(count - done, room[shard] // size))
        else:  # the n largest of room, room - size, room - 2 size, ... of all shards
            above = lambda level: [max(0, (r - level) // size + 1) for r in room]  # noqa: B023, E731
            low, high = size, max(room) + 1  # the highest level that all groups reach, or size
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if sum(above(middle)) >= count else (low, middle)
            sure, reached = above(low + 1), above(low)
            for shard, (fewer, most) in enumerate(zip(sure, reached)):
                done += into(shard, min(count - done - sum(sure[shard + 1:]), most))
        for number in range(done, count):
            parts, left = {}, size
            while left:
                holds = [s for s, r in enumerate(room) if r >= left]
                shard = min(holds, key=lambda s: room[s]) if holds else max(range(len(room)), key=lambda s: room[s])
                parts[shard] = min(left, room[shard])
                left -= parts[shard]
                room[shard] -= parts[shard]
            cut.append((size, number, parts))
    return whole, cut, room


def propagate(cut: list[dict[int, int]], room: list[int]) -> None:
    """Move parts of the cut groups ({shard: rows}) towards their neighbours, in place."""
    def gain(group: dict[int, int], a: int, b: int, rows: int) -> int:
        return 2 * rows * (group.get(b, 0) - group.get(a, 0) + rows)  # growth of the sum of squares

    def move(group: dict[int, int], a: int, b: int, rows: int) -> None:
        group[b] = group.get(b, 0) + rows
        group[a] -= rows
        if not group[a]:
            del group[a]

    moved = True
    while moved:
        moved = False
        for group in cut:
            for a, b in [(a, b) for a in group for b in group if a != b]:
                rows = min(group.get(a, 0), room[b])
                if b in group and rows and gain(group, a, b, rows) > 0:
                    move(group, a, b, rows)
                    room[a], room[b], moved = room[a] + rows, room[b] - rows, True
                for other in cut:
                    rows = min(group.get(a, 0), other.get(b, 0))
                    if other is not group and b in group and rows and gain(group, a, b, rows) + gain(other, b, a, rows) > 0:
                        move(group, a, b, rows)
                        move(other, b, a, rows)
                        moved = True


def placed_groups(groups: DataFrame, quotas: list[int], total: int) -> tuple[DataFrame, list[int]]:
    """The groups (``_link``, ``_size``) with the ``_shards`` of their rows and where each ``_ends``; room left."""
    sizes = {r[0]: r[1] for r in groups.groupBy("_size").count().collect()}  # fewer than twice the root of the rows
    starts = [placement(sizes, quotas, tight) for tight in (True, False)]
    whole, cut, room = min(starts, key=lambda found: sum(len(parts) for _, _, parts in found[1]) - len(found[1]))
    propagate([parts for _, _, parts in cut], room)
    plan = [(size, first, end, [shard], [size]) for size, first, end, shard in whole]
    for size, number, parts in cut:
        ends = [sum(list(parts.values())[: i + 1]) for i in range(len(parts))]
        plan.append((size, number, number + 1, list(parts), ends))
    schema = T.StructType.fromDDL("_of long, _first long, _end long, _shards array<int>, _ends array<long>")
    table = F.broadcast(groups.sparkSession.createDataFrame(plan, schema))
    numbered = ranked(groups, "_size", "_link", "_number", total)
    here = (F.col("_size") == F.col("_of")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end"))
    return numbered.join(table, here).select("_link", "_size", "_shards", "_ends"), room


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard (null)."""
    rows = cut_lineage(documents_with_size(docs, key, text).withColumn("_row", F.monotonically_increasing_id()))
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = rows.where(F.col("_link").isNotNull()).groupBy("_link").agg(F.count("*").alias("_size")).where("_size > 1")
    placed, room = placed_groups(cut_lineage(groups), quotas, total)
    placed = cut_lineage(placed)
    whole = placed.where(F.size("_shards") == 1).select("_link", "_size", F.get("_shards", F.lit(0)).alias("shard"))
    whole = join_groups(rows.select("_row", "_link"), whole, ["_link"], total).select("_row", "shard")
    parts = placed.where(F.size("_shards") > 1).drop("_size")  # fewer than shards
    parts = ranked(rows.select("_row", "_link").join(F.broadcast(parts), "_link"), "_link", "_row", "_rank", total)
    part = F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))
    moved = cut_lineage(whole.unionByName(parts.select("_row", F.get("_shards", part).alias("shard"))))
    ends, end = [], 0
    for free in room:
        end += free
        ends.append(end)
    alone = rows.select("_row").join(moved, "_row", "left_anti").withColumn("_all", F.lit(0))
    alone = ranked(alone, "_all", "_row", "_rank", total)
    filled = F.size(F.filter(F.array(*(F.lit(e) for e in ends)), lambda e: e <= F.col("_rank")))
    shard = moved.unionByName(alone.select("_row", filled.cast("int").alias("shard")))
    out = ranked(rows.drop("_link").join(shard, "_row"), "shard", "_row", "slot", total)
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
