"""Queries over regression predictions."""

from pyspark.sql import functions as F

from ..functions.encode import destandardise, standardise
from ..operators import regression as R
from . import fixtures as fx
from .fixtures import r
from .registry import query

KEYS = ["model", "split"]
S = f"""WITH {fx.REG}, st AS (SELECT model, split, avg(abs(y_pred - y_true)) AS mae,
  avg((y_pred - y_true)^2) AS mse, sqrt(avg((y_pred - y_true)^2)) AS rmse,
  1 - sum((y_pred - y_true)^2) / (var_pop(y_true) * count(*)) AS r2, corr(y_true, y_pred) AS pearson
  FROM reg GROUP BY ALL)"""


def _scores(spark, d, *columns):
    return fx.rounded(R.regression_scores(fx.reg(spark, d), KEYS).select(*KEYS, *columns), 5)


@query("r1_mae_mse_rmse", f"""{S} SELECT model, split, {r('mae', 5)} AS mae, {r('mse', 5)} AS mse,
  {r('rmse', 5)} AS rmse FROM st""")
def r1(spark, d):
    return _scores(spark, d, "mae", "mse", "rmse")


@query("r2_r_squared", f"{S} SELECT model, split, {r('r2', 5)} AS r2 FROM st")
def r2(spark, d):
    return _scores(spark, d, "r2")


@query("r3_pearson", f"{S} SELECT model, split, {r('pearson', 5)} AS pearson FROM st")
def r3(spark, d):
    return _scores(spark, d, "pearson")


@query("r4_split_metrics", f"""WITH {fx.REG} SELECT split, {r('sqrt(avg((y_pred - y_true)^2))', 5)} AS rmse,
  {r('avg(abs(y_pred - y_true))', 5)} AS mae, {r('avg((y_pred - y_true)^2)', 5)} AS mse,
  {r('1 - sum((y_pred - y_true)^2) / (var_pop(y_true) * count(*))', 5)} AS r2 FROM reg GROUP BY split""")
def r4(spark, d):
    scores = R.regression_scores(fx.reg(spark, d), ["split"])
    return fx.rounded(scores.select("split", "rmse", "mae", "mse", "r2"), 5)


@query("r5_model_summary", f"""{S} SELECT model, {', '.join(
    f"{r(f'max({m}) FILTER (WHERE split = {chr(39)}{s}{chr(39)})', 5)} AS {s}_{m}"
    for s in ('val', 'test') for m in ('r2', 'mae', 'mse'))} FROM st GROUP BY model""")
def r5(spark, d):
    wanted = fx.reg(spark, d).filter(F.col("split").isin("val", "test"))
    return fx.rounded(R.model_summary(wanted), 5)


def _rescaled_sql(centre):
    add = "+ s.mean" if centre else ""
    return f"""WITH {fx.REG},
s AS (SELECT avg(y_true) AS mean, stddev_pop(y_true) AS std FROM reg WHERE split = 'train'),
p AS (SELECT model, split, y_true, (y_pred / 100) * s.std {add} AS y_pred FROM reg, s)
SELECT model, split, {r('sqrt(avg((y_pred - y_true)^2))', 5)} AS rmse, {r('avg(abs(y_pred - y_true))', 5)} AS mae,
  {r('1 - sum((y_pred - y_true)^2) / (var_pop(y_true) * count(*))', 5)} AS r2 FROM p GROUP BY ALL"""


def _rescaled(spark, d, centre):
    rows = fx.reg(spark, d)
    stats = R.label_stats(rows.filter("split = 'train'"), [], "y_true")
    scaled = rows.withColumn("y_pred", F.col("y_pred") / 100)
    scores = R.regression_scores(R.rescale_predictions(scaled, stats, centre), KEYS)
    return fx.rounded(scores.select(*KEYS, "rmse", "mae", "r2"), 5)


@query("r6_rescaled_metrics", _rescaled_sql(True))
def r6(spark, d):
    return _rescaled(spark, d, True)


@query("r6_rescaled_metrics_std_only", _rescaled_sql(False))
def r6_std(spark, d):
    return _rescaled(spark, d, False)


@query("r7_residuals", f"""WITH {fx.REG} SELECT model, split, {r('y_true', 5)} AS y_true, {r('y_pred', 5)} AS y_pred,
  {r('y_true - y_pred', 5)} AS residual FROM reg""")
def r7(spark, d):
    return fx.rounded(R.residuals(fx.reg(spark, d)), 5)


@query("r7_identity_line", f"""WITH {fx.REG} SELECT model, split, {r('least(min(y_true), min(y_pred))', 5)} AS line_from,
  {r('greatest(max(y_true), max(y_pred))', 5)} AS line_to FROM reg GROUP BY ALL""")
def r7_line(spark, d):
    return fx.rounded(R.identity_line(fx.reg(spark, d), KEYS), 5)


@query("r8_label_stats", f"""WITH {fx.REG} SELECT split, {r('avg(y_true)', 5)} AS mean,
  {r('stddev_pop(y_true)', 5)} AS std FROM reg GROUP BY ALL""")
def r8(spark, d):
    return fx.rounded(R.label_stats(fx.reg(spark, d), ["split"], "y_true"), 5)


@query("f12_label_standardisation", f"""WITH {fx.REG},
s AS (SELECT avg(y_true) AS mean, stddev_pop(y_true) AS std FROM reg WHERE split = 'train')
SELECT model, split, {r('avg((y_true - s.mean) / s.std)', 5)} AS mean_z, {r('stddev_pop((y_true - s.mean) / s.std)', 5)} AS std_z,
  {r('max(y_true)', 5)} AS max_back FROM reg, s GROUP BY model, split""")
def f12(spark, d):
    rows = fx.reg(spark, d)
    stats = R.label_stats(rows.filter("split = 'train'"), [], "y_true")
    s = rows.withColumn("s", stats.select(F.struct("mean", "std")).scalar())
    z = s.withColumn("z", standardise(F.col("y_true"), F.col("s.mean"), F.col("s.std")))
    back = destandardise(F.col("z"), F.col("s.mean"), F.col("s.std"))
    return fx.rounded(z.groupBy(*KEYS).agg(
        F.avg("z").alias("mean_z"), F.stddev_pop("z").alias("std_z"), F.max(back).alias("max_back")
    ), 5)
