"""How each input schema is derived from the given tables, in Spark and in SQL.

Every SQL text is the body of a CTE, so that a query and its oracle start from
the same rows.
"""

from pyspark.sql import functions as F

from ..operators.tables import renumber


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df, digits=6, skip=()):
    """Round every double column, so both engines agree on the last digits."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
        for c, t in df.dtypes
    ])


def r(expr, digits=6):
    """SQL counterpart of :func:`rounded`; ``+ 0`` turns -0 into 0."""
    return f"(round({expr}, {digits}) + 0)"


# Binary predictions: many tied scores, two models, three splits.
BINARY = """bin AS (
  SELECT l_linestatus AS model,
         CASE l_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
         l_discount AS score,
         CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS y_pred
  FROM lineitem)"""


def _split():
    bucket = F.col("l_orderkey") % 5
    return F.when(bucket == 0, "test").when(bucket == 1, "val").otherwise("train")


def binary(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("model"), _split().alias("split"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"),
        F.col("l_discount").alias("score"),
        (F.col("l_discount") >= 0.05).cast("int").alias("y_pred"),
    )


# Second binary case: score is a document length, nearly without ties.
DOCS = """docs AS (
  SELECT lang AS model, quality AS y_true, n_chars::DOUBLE AS score,
         CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END AS y_pred
  FROM labels JOIN documents USING (doc_id))"""


def docs(spark, d):
    return table(spark, d, "labels").join(
        table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id"
    ).select(
        F.col("lang").alias("model"), F.col("quality").alias("y_true"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") >= 1000).cast("int").alias("y_pred"),
    )


# Multiclass predictions; raw_* are also used as logits.
MULTI = """multi AS (
  SELECT l_linestatus AS model,
         CASE l_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y_true,
         (l_linenumber - 1) % 3 AS y_pred,
         [(l_quantity + 1) / (l_quantity + 1 + (500 * l_discount + 1) + (500 * l_tax + 1)),
          (500 * l_discount + 1) / (l_quantity + 1 + (500 * l_discount + 1) + (500 * l_tax + 1)),
          (500 * l_tax + 1) / (l_quantity + 1 + (500 * l_discount + 1) + (500 * l_tax + 1))] AS prob
  FROM lineitem)"""


def multi(spark, d):
    q = F.col("l_quantity") + 1
    e = 500 * F.col("l_discount") + 1
    t = 500 * F.col("l_tax") + 1
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("model"), _split().alias("split"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y_true"),
        ((F.col("l_linenumber") - 1) % 3).alias("y_pred"),
        F.array(q / (q + e + t), e / (q + e + t), t / (q + e + t)).alias("prob"),
    )


# Regression predictions, in thousands.
REG = """reg AS (
  SELECT l_linestatus AS model,
         CASE l_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
         l_extendedprice / 1000 AS y_true, l_quantity * p_retailprice / 1000 AS y_pred
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def reg(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return table(spark, d, "lineitem").join(
        part, F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("l_linestatus").alias("model"), _split().alias("split"),
        (F.col("l_extendedprice") / 1000).alias("y_true"),
        (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("y_pred"),
    )


# Feature table.
EMB = """emb AS (
  SELECT vec_id AS row_id, embedding::DOUBLE[] AS features, label % 5 AS label,
         label % 2 AS bin,
         CASE WHEN label = 9 THEN -1 ELSE label % 3 END AS cluster
  FROM embeddings)"""


def emb(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") % 5).alias("label"), (F.col("label") % 2).alias("bin"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label") % 3).alias("cluster"),
    )


# The same rows as 0/1 vectors (sign of each position).
BITS = EMB + """, bits AS (
  SELECT row_id, label, list_transform(features, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS features
  FROM emb)"""


def bits(spark, d):
    sign = F.transform("features", lambda x: F.when(x > 0, 1.0).otherwise(0.0))
    return emb(spark, d).select("row_id", "label", sign.alias("features"))


# Six growth rates per row; rows are the environments of a pair.
RATES = """rates AS (
  SELECT l_suppkey AS m1, l_partkey % 50 AS m2, l_orderkey AS env,
         (l_partkey % 4) / 2.0::DOUBLE AS solo1, (l_suppkey % 5) / 2.0::DOUBLE AS best1,
         (l_linenumber % 3) / 2.0::DOUBLE AS kept1, (l_orderkey % 4) / 2.0::DOUBLE AS solo2,
         (l_quantity::INT % 3) / 2.0::DOUBLE AS kept2,
         ((l_partkey + l_suppkey) % 5) / 2.0::DOUBLE AS best2
  FROM lineitem)"""


def rates(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select(
        c("l_suppkey").alias("m1"), (c("l_partkey") % 50).alias("m2"),
        c("l_orderkey").alias("env"),
        ((c("l_partkey") % 4) / 2).alias("solo1"), ((c("l_suppkey") % 5) / 2).alias("best1"),
        ((c("l_linenumber") % 3) / 2).alias("kept1"), ((c("l_orderkey") % 4) / 2).alias("solo2"),
        ((c("l_quantity").cast("int") % 3) / 2).alias("kept2"),
        (((c("l_partkey") + c("l_suppkey")) % 5) / 2).alias("best2"),
    )


CATEGORY = """CASE
  WHEN solo1 + best1 + kept1 + solo2 + kept2 + best2 < 0.001 THEN 17
  WHEN abs(kept1) < 0.001 AND abs(best1) < 0.001 THEN 17
  WHEN abs(best2) < 0.001 AND abs(kept2) < 0.001 THEN 17
  WHEN solo1 < 0.001 AND solo2 < 0.001 AND best1 > solo1 + 0.001 AND best2 > solo2 + 0.001 THEN 16
  WHEN solo1 < 0.001 AND best2 > solo2 + 0.001 THEN 10
  WHEN solo1 < 0.001 AND best2 >= solo2 - 0.001 THEN 11
  WHEN solo1 < 0.001 THEN 12
  WHEN solo2 < 0.001 AND best1 > solo1 + 0.001 THEN 13
  WHEN solo2 < 0.001 AND best1 >= solo1 - 0.001 THEN 14
  WHEN solo2 < 0.001 THEN 15
  WHEN best1 > solo1 + 0.001 AND best2 > solo2 + 0.001 THEN 1
  WHEN best1 > solo1 + 0.001 AND best2 >= solo2 - 0.001 THEN 2
  WHEN best1 > solo1 + 0.001 THEN 8
  WHEN best1 >= solo1 - 0.001 AND best2 > solo2 + 0.001 THEN 3
  WHEN best1 >= solo1 - 0.001 AND best2 >= solo2 - 0.001 THEN 7
  WHEN best1 >= solo1 - 0.001 THEN 6
  WHEN best2 > solo2 + 0.001 THEN 9
  WHEN best2 >= solo2 - 0.001 THEN 5
  ELSE 4 END"""

# Sparse matrix of each microbe (two microbes), external and internal part.
COO = """coo AS (
  SELECT CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS microbe,
         CASE WHEN l_partkey % 3 = 0 THEN 'int' ELSE 'ext' END AS compartment,
         (l_partkey % 64)::INT AS "row", l_suppkey AS col, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL)"""


def coo(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("microbe"),
        F.when(F.col("l_partkey") % 3 == 0, "int").otherwise("ext").alias("compartment"),
        (F.col("l_partkey") % 64).cast("int").alias("row"), F.col("l_suppkey").alias("col"),
    ).agg(F.sum("l_quantity").alias("value"))


# Compounds that each microbe cannot live without.
ESSENTIAL = """essential AS (
  SELECT DISTINCT l_suppkey AS microbe, l_partkey % 150 AS compound FROM lineitem)"""


def essential(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("microbe"), (F.col("l_partkey") % 150).alias("compound")
    )


# Compounds present in each environment.
ENVS = """envs AS (
  SELECT o_orderkey % 20 AS env, l_partkey % 150 AS compound
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING sum(l_quantity)::BIGINT % 2 = 1)"""


def envs(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return (
        table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy((F.col("o_orderkey") % 20).alias("env"), (F.col("l_partkey") % 150).alias("compound"))
        .agg(F.sum("l_quantity").cast("long").alias("_sum")).filter("_sum % 2 = 1").drop("_sum")
    )


# Growth of each microbe alone in each environment.
SOLO = """solo AS (
  SELECT l_orderkey % 20 AS env, l_partkey % 50 AS microbe, max(l_discount * l_quantity) AS rate
  FROM lineitem GROUP BY ALL)"""


def solo(spark, d):
    return table(spark, d, "lineitem").groupBy(
        (F.col("l_orderkey") % 20).alias("env"), (F.col("l_partkey") % 50).alias("microbe")
    ).agg(F.max(F.col("l_discount") * F.col("l_quantity")).alias("rate"))


# Net fluxes of compounds per pair, environment and run.
FLUX = """flux AS (
  SELECT l_suppkey AS m1, l_partkey % 50 AS m2, l_orderkey % 20 AS env,
         l_partkey % 150 AS compound, (l_linenumber % 4)::INT AS run,
         sum(l_quantity - 25) AS flux, max(l_discount) AS rate
  FROM lineitem GROUP BY ALL)"""


def flux(spark, d):
    c = F.col
    return table(spark, d, "lineitem").groupBy(
        c("l_suppkey").alias("m1"), (c("l_partkey") % 50).alias("m2"),
        (c("l_orderkey") % 20).alias("env"), (c("l_partkey") % 150).alias("compound"),
        (c("l_linenumber") % 4).alias("run"),
    ).agg(F.sum(c("l_quantity") - 25).alias("flux"), F.max("l_discount").alias("rate"))


# Epoch history of training runs.
HISTORY = """history AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS epoch,
         value AS val, value / 2 AS test FROM events)"""


def history(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "value")
    return renumber(events, "event_id", "epoch", ["user_id"]).select(
        F.col("user_id").alias("run"), "epoch", F.col("value").alias("val"),
        (F.col("value") / 2).alias("test"),
    )


# Metric records in the shape of published result files.
METRICS = """metrics AS (
  SELECT 'set' || (user_id % 10) AS dataset, event_type AS model, 'Test MCC' AS metric,
         avg(value) AS value FROM events GROUP BY ALL)"""


def metrics(spark, d):
    return table(spark, d, "events").groupBy(
        F.concat(F.lit("set"), F.col("user_id") % 10).alias("dataset"),
        F.col("event_type").alias("model"), F.lit("Test MCC").alias("metric"),
    ).agg(F.avg("value").alias("value"))
