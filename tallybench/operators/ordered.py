"""Ordered computations without a single-task sort.

A cumulative sum per group is done in one exchange by ranges of (keys, order): every
partition is summed in order on its own, and a group that reaches over several partitions
gets what lies before each as an offset. Only such groups need offsets, and a border between two
partitions lies in one group, so there are at most two offset rows a partition, whatever the
data; they are broadcast. A group that holds most of the rows is spread over many
partitions like any others.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage, shuffle_width
from ..shipping import shipped

PART = "_part"


def _changes(batch, keys, last):
    """Where a row's keys differ from the row before; ``last`` holds the keys before the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last is None or any(batch.column(k)[0] != v for k, v in zip(keys, last))
    for k in keys:
        column = batch.column(k)
        if batch.num_rows > 1:
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


def _cumulated(keys, values, names):
    """Batch function: ``names`` and the sums of ``values`` since the group began in this partition."""

    def run(batches):
        last, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch, keys, last)
            heads = np.flatnonzero(new)
            columns = []
            carried = carried or [0] * len(values)
            for n, v in enumerate(values):
                x = batch.column(v).to_numpy(zero_copy_only=False)
                total = np.cumsum(x)
                before = np.where(heads > 0, total[heads - 1], 0) if len(heads) else heads
                base = np.repeat(np.concatenate([[-carried[n]], before]).astype(total.dtype),
                                 np.diff(np.concatenate([[0], heads, [len(x)]])))
                total = total - base
                carried[n] = total[-1]
                columns.append(pa.array(total))
            last = [batch.column(k)[batch.num_rows - 1] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names)

    return run


def running_sums(df, keys, order, values, descending=False, totals=True) -> DataFrame:
    """Add ``cum_<v>`` (sum up to and including the row) and, with ``totals``, ``all_<v>``.

    ``df`` must hold at most one row per (keys, order): collapse ties first. Rows without
    a key or order have no place and are dropped. Sums of whole numbers are whole numbers.
    """
    keys = list(keys)
    for column in [*keys, order]:
        df = df.filter(F.col(column).isNotNull())
    columns = df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = {v: kinds[v].simpleString() in ("tinyint", "smallint", "int", "bigint") for v in values}
    for v in values:
        df = df.withColumn(v, F.col(v).cast("long" if whole[v] else "double"))
    along = [F.col(k) for k in keys] + [F.col(order).desc() if descending else F.col(order)]
    dealt = shipped(df).repartitionByRange(shuffle_width(df.sparkSession), *along).withColumn(PART, F.spark_partition_id())
    dealt = dealt.sortWithinPartitions(*along)
    names = [*columns, PART, *[f"_in_{v}" for v in values]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + "".join(
        f", `_in_{v}` {'long' if whole[v] else 'double'}" for v in values)
    at = columns.index
    # Written once: ranges are drawn from a sample, so they must not be drawn again.
    local = cut_lineage(dealt.mapInArrow(_cumulated([at(k) for k in keys], [at(v) for v in values], names), schema))
    sums = local.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    group = Window.partitionBy(*keys)
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(
        *keys, PART, F.count("*").over(group).alias("_parts"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(group).alias(f"all_{v}") for v in values])
    on = [*keys, PART]
    offsets = parts.filter("_parts > 1").select(*on, *[f"_off_{v}" for v in values])  # at most two rows a partition
    joined = local.join(F.broadcast(offsets), on, "left")
    out = joined.select(*columns, *([PART] if totals else []),
                        *[(F.col(f"_in_{v}") + F.coalesce(F.col(f"_off_{v}"), F.lit(0))).alias(f"cum_{v}") for v in values])
    if not totals:
        return out
    return out.join(parts.select(*on, *[f"all_{v}" for v in values]), on).drop(PART)


BLOCK = 65_536


def running_max(df, keys, order, value, out, inclusive=True) -> DataFrame:
    """Add ``out``: maximum of ``value`` over the rows up to (or before) each row.

    ``order`` is a whole number. Blocks of 65,536 numbers are cumulated apart and
    then joined with the maximum of the earlier blocks, so a long group is spread.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    local = blocked.select("*", F.max(value).over(inside).alias("_in"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    blocks = blocked.groupBy(*keys, "_block").agg(F.max(value).alias("_max")).select(
        *keys, "_block", F.max("_max").over(before).alias("_earlier")
    )
    return local.join(blocks, on=keys + ["_block"]).select(
        *df.columns, F.greatest("_in", "_earlier").alias(out)
    )


BUCKET_ROWS = 65_536


def hashed_order(df, keys, seed, row_key, out="rank") -> DataFrame:
    """1-based rank of each row in the order of md5(seed:row_key), and ``group_size``.

    The first hex digits of the hash, as many as the number of rows asks for, split every
    group into even buckets, so the rank is exact without sorting a group in one task.
    """
    keys = list(keys)
    digits, n_rows = 3, df.count()
    while n_rows > BUCKET_ROWS * 16**digits:
        digits += 1
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_key).cast("string")))
    hashed = df.withColumn("_digest", digest).withColumn(
        "_prefix", F.substring("_digest", 1, digits)
    )
    counts = hashed.groupBy(*keys, "_prefix").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_prefix",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("group_size"),
    )
    inside = Window.partitionBy(*keys, "_prefix").orderBy("_digest", row_key)
    ranked = hashed.withColumn("_in", F.row_number().over(inside))
    return ranked.join(offsets, on=keys + ["_prefix"]).select(
        *df.columns, (F.col("_in") + F.col("_before")).alias(out), "group_size"
    )


def exact_quantiles(df, keys, value, count) -> DataFrame:
    """``count`` evenly spaced quantiles (0 to 1) per group, linearly interpolated.

    Returns (keys, level_index, level, quantile), equal to ``percentile``. A group
    is never held in one task: distinct values are counted, cumulated with
    :func:`running_sums`, and only rows that straddle a wanted rank are kept.
    """
    keys = list(keys)
    steps = count - 1
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    cum = running_sums(counts, keys, value, ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    span = F.col("all_n") - 1

    def nearest_level(rank):
        return F.when(span > 0, F.floor(rank * steps / F.greatest(span, F.lit(1))))

    # Level numbers whose rank may fall into the value's run of ranks.
    low = F.coalesce(F.greatest(nearest_level(first - 1), F.lit(0)), F.lit(0))
    high = F.coalesce(F.least(nearest_level(last + 1) + 1, F.lit(steps)), F.lit(steps))
    candidates = cum.select(
        *keys, value, first.alias("_first"), last.alias("_last"),
        span.alias("_span"), F.explode(F.sequence(low, high)).alias("level_index"),
    ).withColumn("level", F.col("level_index") / F.lit(float(steps)))
    candidates = candidates.withColumn("_rank", F.col("level") * F.col("_span"))

    def at(rank):
        inside = (rank >= F.col("_first")) & (rank <= F.col("_last"))
        return F.max(F.when(inside, F.col(value)))

    return (
        candidates.groupBy(*keys, "level_index")
        .agg(
            F.max("level").alias("level"),
            at(F.floor("_rank")).alias("_lo"), at(F.ceil("_rank")).alias("_hi"),
            F.max(F.col("_rank") - F.floor("_rank")).alias("_share"),
        )
        .select(
            *keys, F.col("level_index").cast("int").alias("level_index"), "level",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share"))
            .alias("quantile"),
        )
    )
