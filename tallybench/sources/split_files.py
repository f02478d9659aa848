"""Feature and label files in six-way splits.

Layout: <root>/<task>/<collection>/<group>/<dataset>/csv/<X|y>_<split>_<dataset>.csv,
each a file or a folder of part files. Features and labels are aligned by position.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .position import with_position

FILE_NAME = r"/csv/([Xy])_(train|val|test)_"
DATASET = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/csv/[Xy]_"
DATASET_PARTS = {"task": 1, "collection": 2, "group": 3, "dataset": 4}


def folder(root, task, collection, group, dataset):
    return f"{root}/{task}/{collection}/{group}/{dataset}/csv"


def _keys():
    keys = {"split": lambda path: F.regexp_extract(path, FILE_NAME, 2)}
    for name, part in DATASET_PARTS.items():
        keys[name] = lambda path, part=part: F.regexp_extract(path, DATASET, part)
    return keys


def _headers(spark, pattern):
    """{header line: its file paths}; one row per file reaches the driver."""
    lines = spark.read.text(pattern).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seen")).where("block = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "seen").alias("header"))
    found = {}
    for row in first.collect():
        found.setdefault(row["header"], []).append(row["path"])
    return found


def _scan(spark, paths):
    """Numeric CSV scan of files with one header; every column is a double.

    A file whose header differs from the schema, or a cell that is no number, raises.
    """
    reader = spark.read.option("header", True)
    header = reader.csv(paths).columns
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in header])
    return reader.option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(paths)


def _features(spark, pattern, keys):
    """Rows of all feature files; each header group is scanned with its own columns."""
    out = None
    for paths in _headers(spark, pattern).values():
        rows = with_position(_scan(spark, paths), keys)
        columns = [c for c in rows.columns if c not in [*keys, "row_id"]]
        rows = rows.select(*keys, "row_id", F.array(*[F.col(f"`{c}`") for c in columns]).alias("features"),
                           F.array(*[F.lit(c) for c in columns]).alias("columns"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _labels(spark, pattern, keys):
    out = None
    for paths in _headers(spark, pattern).values():
        rows = with_position(_scan(spark, paths), keys)
        (label,) = [c for c in rows.columns if c not in [*keys, "row_id"]]
        rows = rows.select(*keys, "row_id", F.col(f"`{label}`").alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_split(spark: SparkSession, root, task="*", collection="*", group="*", dataset="*"):
    """(task, collection, group, dataset, split, row_id, features, columns, label).

    A ``*`` reads several datasets at once; each keeps its own columns, whose names are in
    ``columns``. A row of features without a label, or the reverse, raises.
    """
    base = folder(root, task, collection, group, dataset)
    keys = _keys()
    x = _features(spark, f"{base}/X_*", keys).withColumn("_x", F.lit(True))
    y = _labels(spark, f"{base}/y_*", keys).withColumn("_y", F.lit(True))
    both = x.join(y, [*keys, "row_id"], "full")
    unmatched = F.raise_error(F.concat(
        F.lit("features and labels differ in number: "), F.concat_ws("/", *keys)))
    matched = F.when(F.col("_x") & F.col("_y"), F.col("label")).otherwise(unmatched)
    return both.select(*keys, "row_id", "features", "columns", matched.alias("label"))


def write_split(df: DataFrame, base, dataset, row_id, feature_columns, label):
    """Write (row_id, split, features..., label) as six CSV folders, in row_id order."""
    for split in ("train", "val", "test"):
        part = df.filter(F.col("split") == split)
        # One range layout for both files, so positions agree.
        ordered = part.orderBy(row_id)
        ordered.select(*feature_columns).write.option("header", True).csv(
            f"{base}/X_{split}_{dataset}.csv")
        ordered.select(label).write.option("header", True).csv(
            f"{base}/y_{split}_{dataset}.csv")


def read_combined(spark, path, schema=None) -> DataFrame:
    """Feature and label columns in one CSV or Parquet table."""
    if str(path).rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else _scan(spark, [path])
