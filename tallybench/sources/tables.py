"""Parquet layouts of matrices, pair tables and results."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.groups import join_groups

# A pair or microbe folder is written by one task per so many of its rows.
ROWS_PER_FILE = 1_000_000


def save_matrix(df: DataFrame, path):
    """Store (row_id, features array<double>)."""
    df.write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def save_by_key(df: DataFrame, path, keys, rows_per_file=ROWS_PER_FILE):
    """Store one folder per key value; the rows of a key are spread over as many tasks as
    their number asks for, so a key that holds most of the rows does not end in one task."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_files", F.ceil(F.col("_size") / rows_per_file).cast("int"))
    first = sizes.groupBy(keys[0]).agg(F.sum("_size").alias("_all"))
    sizes = sizes.drop("_size").join(first, keys[0]).withColumnRenamed("_all", "_size")
    others = [c for c in df.columns if c not in keys]
    salted = join_groups(df, sizes, list(keys), df.count()).withColumn(
        "_salt", F.pmod(F.xxhash64(*others), F.col("_files"))).drop("_files")
    spread = salted.repartition(*keys, "_salt").drop("_salt")
    spread.select(*df.columns).write.mode("overwrite").partitionBy(*keys).parquet(path)


def load_by_key(spark, path, **values) -> DataFrame:
    """Read the table; given key values prune to their folders."""
    df = spark.read.parquet(path)
    for name, value in values.items():
        df = df.filter(F.col(name) == value)
    return df


def save_run(path, **tables):
    """Store the tables of one labelling run: those with m1 by folder, others flat."""
    for name, df in tables.items():
        if "m1" in df.columns:
            save_by_key(df, f"{path}/{name}", ["m1"])
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_samples(real, synthetic, path, file_format="parquet"):
    """Write real and synthetic rows next to each other."""
    for name, df in (("real", real), ("synthetic", synthetic)):
        writer = df.write.mode("overwrite")
        if file_format == "csv":
            writer.option("header", True).csv(f"{path}/{name}")
        else:
            writer.parquet(f"{path}/{name}")
