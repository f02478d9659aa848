"""Training logs: lines '(val) x (test) y' and 'New best epoch!'."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tables import renumber
from ..session import cut_lineage
from .position import with_position

SCORES = r"^\(val\) (-?[0-9.]+(?:[eE][-+]?[0-9]+)?) \(test\) (-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
NEW_BEST = "New best epoch!"


def read_history(spark: SparkSession, path, run="run") -> DataFrame:
    """(run, epoch, val, test, new_best) of log folders named run=<id>."""
    # The numbered lines are read for scores and for marks: number them once.
    lines = cut_lineage(with_position(spark.read.text(path), keys=[run], out="line"))
    is_score = F.col("value").rlike(SCORES)
    scores = lines.filter(is_score).select(
        run, "line", F.regexp_extract("value", SCORES, 1).cast("double").alias("val"),
        F.regexp_extract("value", SCORES, 2).cast("double").alias("test"))
    best = lines.filter(F.trim("value") == NEW_BEST).select(
        run, (F.col("line") - 1).alias("line"), F.lit(True).alias("new_best"))
    marked = scores.join(best, [run, "line"], "left").withColumn(
        "new_best", F.coalesce("new_best", F.lit(False)))
    return renumber(cut_lineage(marked), "line", "epoch", [run]).select(run, "epoch", "val", "test", "new_best")


def write_history(history: DataFrame, path, run="run"):
    """Write (run, epoch, val, test, new_best) as log lines, in epoch order."""
    score = F.format_string("(val) %.4f (test) %.4f", F.col("val"), F.col("test"))
    lines = F.when(F.col("new_best"), F.array(score, F.lit(NEW_BEST))).otherwise(F.array(score))
    # Range partitions keep the epochs of a run in part-file order; the lines of an epoch
    # are numbered, so that their order is part of the sort and not of the explode.
    spread = history.repartitionByRange(run, "epoch").select(
        run, "epoch", F.posexplode(lines).alias("_line", "value"))
    ordered = spread.sortWithinPartitions(run, "epoch", "_line")
    ordered.select(run, "value").write.mode("overwrite").partitionBy(run).text(path)
