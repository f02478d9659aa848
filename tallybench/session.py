"""Session helpers: reliable lineage cuts and size checks."""

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only when it has at most this many rows.
BROADCAST_ROWS = 100_000


def shuffle_width(spark: SparkSession) -> int:
    """Number of buckets used to spread an ordered pass over the cluster."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder of the session.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="tallybench-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def free_rounds(spark: SparkSession) -> None:
    """Let the files of earlier rounds go: Spark deletes shuffles once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table: shared on a cluster, temporary locally."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="tallybench-tables-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read again.

    A checkpoint keeps what the planner inferred of its columns. Where each round builds on the
    one before, that grows with every round until planning takes minutes; a file starts anew.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
