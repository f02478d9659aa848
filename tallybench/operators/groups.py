"""Joins on keys of which one may hold a third of all rows."""

from pyspark.sql import DataFrame, functions as F

#: A group is large if it has more than one in HOT rows; there are fewer than HOT of them.
HOT = 4096


def join_groups(rows: DataFrame, groups: DataFrame, on: list, total: int, how="inner") -> DataFrame:
    """Join rows with what is known of their groups, spread evenly whatever the groups.

    ``groups`` has ``_size``, the rows of the group ``on[0]`` (dropped), and ``total`` is the
    number of rows. Large groups are broadcast, at most HOT of them by their definition; all
    others are joined by a shuffle in which no key is large.
    """
    large = F.col("_size") * HOT > total
    hot, cold = groups.where(large).drop("_size"), groups.where(~large).drop("_size")
    names = F.broadcast(hot.select(on[0]).distinct())
    return rows.join(F.broadcast(hot), on).unionByName(
        rows.join(names, on[0], "left_anti").join(cold, on, how))
