"""Shaping of feature, label and pair tables."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .ordered import hashed_order, running_sums

# Class of each interaction table.
TABLE_LABELS = {
    "comp": 0, "fcoop": 1, "obligate_plusx": 2, "obligate_xplus": 3, "obligate_xx": 4,
}

# Label remapping presets; each applies to the original label.
REMAP_PRESETS = {
    "merge_obligate": {2: 1},
    "shift_three": {1: 0, 3: 1},
    "three_as_one": {3: 1},
    "two_as_zero": {2: 0},
    "compact_three": {2: 0, 3: 1, 4: 2},
}


def binarise_first_row(df: DataFrame, row_id, columns, threshold=0.5) -> DataFrame:
    """Append row 0 as 0/1 (>= threshold) and name the columns C_1..C_n.

    The new row gets the next free row id.
    """
    next_id = df.agg(F.max(row_id) + 1).scalar()
    # Whole numbers and fractions share a column afterwards, so it is double.
    values = df.select(row_id, *[F.col(c).cast("double").alias(f"C_{i}")
                                 for i, c in enumerate(columns, start=1)])
    names = values.columns[1:]
    flags = values.filter(F.col(row_id) == 0).select(
        next_id.alias(row_id), *[(F.col(c) >= threshold).cast("double").alias(c) for c in names]
    )
    return values.unionByName(flags)


def header_as_first_row(df: DataFrame, row_id, header, names=("M1", "M2")) -> DataFrame:
    """Undo a header that was really the first record: it becomes row 0."""
    spark = df.sparkSession
    body = df.select((F.col(row_id) + 1).cast("long").alias(row_id),
                     *[F.col(c).cast("int").alias(n) for c, n in zip(header, names)])
    first = spark.range(1).select(
        F.lit(0).cast("long").alias(row_id),
        *[F.lit(str(c)).cast("int").alias(n) for c, n in zip(header, names)],
    )
    return first.unionByName(body)


def pair_count(df, m1, m2) -> DataFrame:
    """Number of rows of one pair."""
    return df.filter((F.col("m1") == m1) & (F.col("m2") == m2)).agg(F.count("*").alias("n"))


def pair_counts(df, keys=("m1", "m2")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def assign_label(df, kind) -> DataFrame:
    """Add the class of an interaction table; an unknown kind adds no column."""
    if kind not in TABLE_LABELS:
        return df
    return df.withColumn("label", F.lit(TABLE_LABELS[kind]))


def stack_labelled(tables) -> DataFrame:
    """One supervised table from {kind: table}."""
    return concat_rows([assign_label(df, kind) for kind, df in tables.items()])


def concat_rows(frames) -> DataFrame:
    if not all(isinstance(f, DataFrame) for f in frames):
        raise ValueError("every element must be a Spark DataFrame")
    return reduce(lambda a, b: a.unionByName(b), frames)


def concat_columns(left, right, row_id) -> DataFrame:
    """Columns side by side by row id; a missing row is null."""
    return left.join(right, on=row_id, how="full_outer")


def features_and_label(df, label, row_id):
    """(X, y): the table without its label, and the label by row id."""
    return df.drop(label), df.select(row_id, label)


def remap_labels(df, label, preset) -> DataFrame:
    mapping = REMAP_PRESETS[preset] if isinstance(preset, str) else preset
    case = None
    for old, new in mapping.items():
        hit = F.col(label) == old
        case = F.when(hit, new) if case is None else case.when(hit, new)
    return df.withColumn(label, case.otherwise(F.col(label)).cast("int"))


def take_names(df, other) -> DataFrame:
    """Give ``df`` the column names of ``other``, by position."""
    return df.toDF(*other.columns)


def augment(real, synthetic) -> DataFrame:
    """Real plus synthetic rows with their origin in ``source``."""
    renamed = take_names(synthetic, real)
    return real.withColumn("source", F.lit("real")).unionByName(
        renamed.withColumn("source", F.lit("synthetic"))
    )


def preview(df, row_id, n=10) -> DataFrame:
    return df.orderBy(row_id).limit(n)


def column_list(df) -> DataFrame:
    """(position, name, type) of every column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def to_features(df, columns, out="features") -> DataFrame:
    """Gather columns into one array<double>."""
    rest = [c for c in df.columns if c not in set(columns)]
    return df.select(*rest, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def renumber(df, key, out="index", groups=()) -> DataFrame:
    """0-based index in the order of a unique numeric key, overall or per group.

    No task sorts a whole group: see ``running_sums``.
    """
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sums(ones, groups, key, ["_one"]).select(
        *df.columns, (F.col("cum__one") - 1).alias(out)
    )


def train_val_test_split(df, row_key, val=0.2, test=0.2, seed=4421) -> DataFrame:
    """Add ``split``: exact sizes, disjoint, the same on every run and partitioning.

    Held-out rows are rounded up, the test part of them too.
    """
    # Fractions such as 0.2 + 0.2 leave a last-digit excess that must not round up.
    held = F.ceil(F.round(F.col("group_size") * F.lit(val + test), 9))
    tested = F.ceil(F.round(held * F.lit(test / (val + test)), 9))
    split = F.when(F.col("rank") <= tested, "test").when(F.col("rank") <= held, "val")
    ranked = hashed_order(df, [], seed, row_key)
    return ranked.withColumn("split", split.otherwise("train")).drop("rank", "group_size")


def stratified_split(df, row_key, strata, test=0.2, seed=42) -> DataFrame:
    """Add ``split`` with ceil(test x size) test rows in every stratum."""
    ranked = hashed_order(df, strata, seed, row_key)
    tested = F.ceil(F.round(F.col("group_size") * F.lit(test), 9))
    split = F.when(F.col("rank") <= tested, "test").otherwise("train")
    return ranked.withColumn("split", split).drop("rank", "group_size")


def two_stage_split(df, row_key, test=0.2, val=0.2, seed=0) -> DataFrame:
    """First take the test part of all rows, then the val part of the rest."""
    tested = F.ceil(F.round(F.col("group_size") * F.lit(test), 9))
    rest = F.col("group_size") - tested
    validated = F.ceil(F.round(rest * F.lit(val), 9))
    split = F.when(F.col("rank") <= tested, "test").when(
        F.col("rank") <= tested + validated, "val"
    ).otherwise("train")
    ranked = hashed_order(df, [], seed, row_key)
    return ranked.withColumn("split", split).drop("rank", "group_size")
