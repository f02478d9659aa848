"""Queries that write a table in a source format and read it back."""

from pyspark.sql import functions as F

from ..operators import pairs as P, statistics as S
from ..session import scratch_folder
from ..sources import descriptor, history_log, metric_files, split_files, tables
from . import fixtures as fx
from .fixtures import r
from .registry import query

SPLIT = "CASE o_orderkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


def _orders(spark, d):
    bucket = F.col("o_orderkey") % 5
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("12ppd_S"),
        F.col("o_totalprice").alias("ac"), (F.col("o_orderkey") % 7).alias("y"),
        F.when(bucket == 0, "test").when(bucket == 1, "val").otherwise("train").alias("split"))


def _split_root(spark, d):
    root = scratch_folder(spark, "splits")
    base = split_files.folder(root, "Regression", "COLLECTION_B", "50", "GR-I")
    split_files.write_split(_orders(spark, d), base, "GR-I", "row_id", ["12ppd_S", "ac"], "y")
    return root


@query("s1_read_split_files", f"""SELECT 'Regression' AS task, 'COLLECTION_B' AS collection, '50' AS "group", 'GR-I' AS dataset,
  {SPLIT} AS split, count(*) AS n, sum(o_custkey)::DOUBLE AS custkeys, {r('sum(o_totalprice)', 2)} AS price, sum(o_orderkey % 7)::DOUBLE AS labels
FROM orders GROUP BY ALL""")
def s1(spark, d):
    rows = split_files.read_split(spark, _split_root(spark, d))
    return rows.groupBy("task", "collection", "group", "dataset", "split").agg(
        F.count("*").alias("n"), F.sum(F.get("features", 0)).alias("custkeys"),
        F.round(F.sum(F.get("features", 1)), 2).alias("price"), F.sum("label").alias("labels"))


@query("s2_align_by_position", f"""SELECT {SPLIT} AS split, row_number() OVER (PARTITION BY o_orderkey % 5 = 0, o_orderkey % 5 = 1 ORDER BY o_orderkey) - 1 AS row_id,
  [o_custkey::DOUBLE, o_totalprice] AS features, (o_orderkey % 7)::DOUBLE AS label FROM orders""")
def s2(spark, d):
    rows = split_files.read_split(spark, _split_root(spark, d), dataset="GR-I")
    return rows.select("split", "row_id", "features", "label")


@query("s3_combined_table", """SELECT o_custkey::DOUBLE AS a, o_totalprice AS b, (o_orderkey % 2)::DOUBLE AS label FROM orders""")
def s3(spark, d):
    path = scratch_folder(spark, "combined")
    fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("a"), F.col("o_totalprice").alias("b"),
        (F.col("o_orderkey") % 2).alias("label")).write.option("header", True).csv(path)
    return split_files.read_combined(spark, path)


@query("s4_matrix_round_trip", f"WITH {fx.EMB} SELECT row_id, {r('list_sum(features)')} AS total, len(features) AS width FROM emb")
def s4(spark, d):
    path = scratch_folder(spark, "matrix")
    tables.save_matrix(fx.emb(spark, d).select("row_id", "features"), path)
    back = tables.load_matrix(spark, path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return fx.rounded(back.select("row_id", total.alias("total"), F.size("features").cast("long").alias("width")))


PART_DESCRIPTOR = """{"name": "part", "column_names": ["p_partkey", "p_size", "p_retailprice", "label"],
 "num_col_idx": [0, 1, 2], "cat_col_idx": [], "target_col_idx": [4],
 "column_info": {"p_partkey": "int64", "p_size": "int64", "p_retailprice": "float64", "label": "int64"},
 "train_num": 1600, "test_num": 400,}"""


@query("s5_descriptor_checks", """WITH c AS (SELECT * FROM (VALUES ('valid_json', 1, 0), ('columns', 4, 4), ('typed_columns', 4, 4),
  ('index_in_range', 0, 1), ('index_listed_once', 4, 4)) t("check", expected, actual)
UNION ALL SELECT 'train_num', 1600, count(*) FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'test_num', 400, count(*) FROM part WHERE p_partkey % 5 = 0)
SELECT "check", expected::BIGINT AS expected, actual::BIGINT AS actual, expected = actual AS ok FROM c""")
def s5(spark, d):
    spec, valid = descriptor.parse(PART_DESCRIPTOR)
    part = fx.table(spark, d, "part").select(
        "p_partkey", "p_size", "p_retailprice", (F.col("p_size") % 2).alias("label"))
    return descriptor.checks(spec, valid, part.filter("p_partkey % 5 <> 0"), part.filter("p_partkey % 5 = 0"))


@query("s6_pairs_by_folder", """SELECT (l_suppkey % 5)::INT AS m1, (l_partkey % 4)::INT AS m2, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY ALL""")
def s6(spark, d):
    path = scratch_folder(spark, "pairs")
    rows = fx.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("m1"), (F.col("l_partkey") % 4).alias("m2"), "l_orderkey")
    tables.save_by_key(rows, path, ["m1", "m2"])
    return tables.load_by_key(spark, path).groupBy("m1", "m2").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("s7_nested_metric_text", f"""WITH {fx.METRICS} SELECT dataset, count(*) AS models, {r('sum(value)', 4)} AS total FROM metrics GROUP BY dataset""")
def s7(spark, d):
    texts = metric_files.nested(fx.metrics(spark, d))
    parsed = F.from_json("json", "map<string, map<string, double>>")
    values = F.transform(F.map_values(parsed), lambda m: m["Test MCC"])
    return texts.select("dataset", F.size(parsed).cast("long").alias("models"),
                        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s8_read_metric_files", f"""WITH {fx.METRICS} SELECT dataset, model, 'test' AS split, 'mcc' AS metric, {r('value', 9)} AS value FROM metrics
UNION ALL SELECT dataset, model, 'test', 'r2', {r('value / 2', 9)} FROM metrics""")
def s8(spark, d):
    rows = fx.metrics(spark, d)
    drifted = rows.select("dataset", "model", F.lit("Test R²").alias("metric"), (F.col("value") / 2).alias("value"))
    path = scratch_folder(spark, "metrics")
    metric_files.write(rows.unionByName(drifted), path)
    return fx.rounded(metric_files.canonical(metric_files.read(spark, path)), 9)


@query("s10_write_samples", """SELECT 'real' AS kind, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE vec_id % 2 = 0
UNION ALL SELECT 'synthetic', count(*), sum(vec_id)::BIGINT FROM embeddings WHERE vec_id % 2 = 1""")
def s10(spark, d):
    path = scratch_folder(spark, "samples")
    rows = fx.emb(spark, d).select("row_id", "features")
    tables.save_samples(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1"), path)
    parts = [spark.read.parquet(f"{path}/{kind}").agg(
        F.count("*").alias("n"), F.sum("row_id").alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids")
        for kind in ("real", "synthetic")]
    return parts[0].unionByName(parts[1])


@query("s11_save_run", f"""WITH {fx.RATES}, c AS (SELECT m1 % 7 AS m1, {fx.CATEGORY} AS category FROM rates)
SELECT m1::INT AS m1, category, count(*) AS n FROM c GROUP BY ALL""")
def s11(spark, d):
    path = scratch_folder(spark, "run")
    labelled = P.label_interactions(fx.rates(spark, d)).withColumn("m1", F.col("m1") % 7)
    tables.save_run(path, interactions=labelled.select("m1", "m2", "env", "category"),
                    environments=fx.envs(spark, d))
    return tables.load_by_key(spark, f"{path}/interactions").groupBy("m1", "category").agg(
        F.count("*").alias("n"))


@query("s12_load_microbe", f"""WITH {fx.COO} SELECT compartment, "row", col, value, microbe FROM coo WHERE microbe = 2""")
def s12(spark, d):
    path = scratch_folder(spark, "models")
    tables.save_by_key(fx.coo(spark, d), path, ["microbe"])
    return tables.load_by_key(spark, path, microbe=2)


UP = "coalesce(val > max(val) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)"


def _logged(spark, d):
    """History of runs (grouped by user_id % 8) as log files, with the best-epoch lines."""
    from ..operators.ordered import running_max
    from ..operators.tables import renumber

    events = fx.table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 8).cast("int").alias("run"), F.col("value").alias("val"))
    rows = renumber(events, "event_id", "epoch", ["run"])
    seen = running_max(rows, ["run"], "epoch", "val", "before", inclusive=False)
    path = scratch_folder(spark, "logs")
    history_log.write_history(seen.select(
        "run", "epoch", "val", (F.col("val") / 2).alias("test"),
        F.coalesce(F.col("val") > F.col("before"), F.lit(True)).alias("new_best")), path)
    return history_log.read_history(spark, path)


LOGGED = f"""WITH history AS (SELECT (user_id % 8)::INT AS run, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS epoch, value AS val, value / 2 AS test FROM events),
up AS (SELECT *, {UP} AS up FROM history)"""


@query("s13_training_log", f"{LOGGED} SELECT run, epoch, {r('val', 4)} AS val, {r('test', 3)} AS test, up AS new_best FROM up")
def s13(spark, d):
    return _logged(spark, d).withColumn("test", F.round("test", 3))


@query("m20_training_monitor", f"""{LOGGED}, b AS (SELECT *, epoch - max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS bad FROM up),
e AS (SELECT run, min(epoch) FILTER (WHERE bad >= 61) AS stop FROM b GROUP BY run),
k AS (SELECT b.*, e.stop FROM b JOIN e USING (run) WHERE stop IS NULL OR epoch <= stop)
SELECT run, arg_max(epoch, val) AS best_epoch, max(val) AS best_val, {r('arg_max(test, val)', 3)} AS best_test, max(epoch) AS last_epoch,
  max(stop) IS NOT NULL AS stopped_early FROM k GROUP BY run""")
def m20(spark, d):
    best = S.early_stopping(_logged(spark, d).drop("new_best"), patience=60)
    return best.withColumn("best_test", F.round("best_test", 3))
