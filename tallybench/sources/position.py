"""Row positions of text files, kept through a distributed scan."""

from pyspark.sql import DataFrame, Window, functions as F


def with_position(scan: DataFrame, path_keys=None, keys=(), out="row_id") -> DataFrame:
    """Add the 0-based position of each row within its group of files.

    ``scan`` is a fresh file scan. A group is given by ``keys`` (columns of the scan)
    and ``path_keys`` ({name: expression over the file path}); its files follow in
    the order of their folder, the number in a part file's name, and their name. Rows are
    inside each file split (bounded by the split size), then shifted by the row counts of
    the earlier splits.
    """
    path_keys = path_keys or {}
    names = [*keys, *path_keys]
    path = F.col("_metadata.file_path")
    marked = scan.select(
        "*", path.alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
        *[make(path).alias(name) for name, make in path_keys.items()],
    )
    split = names + ["_path", "_block"]
    inside = Window.partitionBy(*split).orderBy("_seen")
    local = marked.withColumn("_in", F.row_number().over(inside) - 1)
    # part-100000 follows part-99999, which the names alone would not give.
    folder = F.regexp_extract("_path", r"^(.*/)[^/]*$", 1)
    number = F.expr("try_cast(regexp_extract(_path, 'part-([0-9]+)[^/]*$', 1) AS long)")
    earlier = Window.partitionBy(*names).orderBy(folder, number, "_path", "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    # One row per file split.
    offsets = marked.groupBy(*split).agg(F.count("*").alias("_n")).select(
        *split, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return local.join(offsets, split).select(
        *[c for c in marked.columns if c not in ("_path", "_block", "_seen")],
        (F.col("_in") + F.col("_before")).alias(out))
