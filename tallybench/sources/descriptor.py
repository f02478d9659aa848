"""Dataset descriptors: a small JSON file that declares columns, types and counts."""

import json
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Declared type names and their Spark types.
TYPES = {"int64": T.LongType(), "float64": T.DoubleType(), "str": T.StringType(),
         "int32": T.IntegerType(), "float32": T.FloatType()}


def parse(text):
    """(descriptor, valid): tolerates trailing commas, which JSON does not allow."""
    try:
        return json.loads(text), True
    except json.JSONDecodeError:
        return json.loads(re.sub(r",(\s*[\]}])", r"\1", text)), False


def read(spark: SparkSession, path):
    return parse("\n".join(row.value for row in spark.read.text(path, wholetext=True).collect()))


def schema(descriptor) -> T.StructType:
    info = descriptor["column_info"]
    return T.StructType([T.StructField(c, TYPES[info[c]]) for c in descriptor["column_names"]])


def checks(descriptor, valid, train: DataFrame, test: DataFrame) -> DataFrame:
    """(check, expected, actual, ok): what the descriptor says against the tables."""
    spark = train.sparkSession
    names = descriptor["column_names"]
    width = len(names)
    numeric = descriptor.get("num_col_idx", [])
    categorical = descriptor.get("cat_col_idx", [])
    target = descriptor.get("target_col_idx", [])
    listed = numeric + categorical + target
    static = [
        ("valid_json", 1, int(valid)),
        ("columns", width, len(train.columns)),
        ("typed_columns", width, len(set(names) & set(descriptor["column_info"]))),
        ("index_in_range", 0, sum(1 for i in listed if not 0 <= i < width)),
        ("index_listed_once", len(listed), len(set(listed))),
    ]
    out = spark.createDataFrame(static, "check string, expected long, actual long")
    for name, df in (("train_num", train), ("test_num", test)):
        out = out.unionByName(df.agg(F.count("*").alias("actual")).select(
            F.lit(name).alias("check"), F.lit(descriptor[name]).cast("long").alias("expected"),
            "actual"))
    return out.withColumn("ok", F.col("expected") == F.col("actual"))
