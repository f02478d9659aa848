"""Gapless ranks inside groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000


def ranked(df: DataFrame, group: str, row: str, name: str, rows: int) -> DataFrame:
    """Add ``name``: 0, 1, ... within each ``group``, for any number of rows a group.

    ``row`` holds a unique whole number (or other hashable key) a row. Rows of a group are
    spread over buckets by its hash, as many as ``rows`` (their number) asks for, numbered
    inside their bucket, and moved by the sizes of the buckets before it.
    """
    buckets = max(16, -(-rows // ROWS_PER_BUCKET))
    bucket: Column = F.pmod(F.xxhash64(F.lit(name), F.lit(group), row), F.lit(buckets))  # independent of earlier ranks
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(row)) - 1
    out = keyed.withColumn("_inside", inside)
    return (out.join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_b")))
            .withColumn(name, (F.col("_base") + F.col("_inside")).cast("long"))
            .drop("_bucket", "_inside", "_group", "_b", "_base"))
