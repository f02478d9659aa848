"""Queries over classification predictions."""

from pyspark.sql import functions as F

from ..functions import logits
from ..operators import classification as C, curves
from . import fixtures as fx
from .fixtures import r
from .registry import query

KEYS = ["model", "split"]

# Oracle building blocks: per-class counts, per-class scores, summary.
CM = "cm AS (SELECT model, split, y_true, y_pred, count(*) AS n FROM multi GROUP BY ALL)"
PER_CLASS = f"""WITH {fx.MULTI}, {CM},
tot AS (SELECT model, split, sum(n)::DOUBLE AS total FROM cm GROUP BY ALL),
cls AS (SELECT DISTINCT model, split, y_true AS c FROM cm UNION SELECT DISTINCT model, split, y_pred FROM cm),
k AS (SELECT cls.model, cls.split, c, total,
        coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred = c), 0)::DOUBLE AS tp,
        coalesce(sum(n) FILTER (WHERE y_pred = c), 0)::DOUBLE AS pred,
        coalesce(sum(n) FILTER (WHERE y_true = c), 0)::DOUBLE AS sup
      FROM cls JOIN cm USING (model, split) JOIN tot USING (model, split)
      GROUP BY cls.model, cls.split, c, total),
s AS (SELECT *, coalesce(tp / nullif(pred, 0), 0) AS p, coalesce(tp / nullif(sup, 0), 0) AS rc,
        coalesce(2 * tp / nullif(pred + sup, 0), 0) AS f1,
        pred - tp AS fp, sup - tp AS fn, total - pred - sup + tp AS tn FROM k)"""
MCC_ROW = ("coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn)) * "
           "sqrt((tn + fp) * (tn + fn)), 0), 0)")
MCC_MULTI = ("coalesce((sum(tp) * max(total) - sum(pred * sup)) / nullif(sqrt(max(total)^2 - sum(pred^2)) "
             "* sqrt(max(total)^2 - sum(sup^2)), 0), 0)")
BIN = f"""WITH {fx.BINARY},
k AS (SELECT model, split, count(*)::DOUBLE AS n,
        sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
        sum(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
        sum(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn,
        sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn
      FROM bin GROUP BY ALL)"""


def auc_sql(source, keys):
    """Average-rank Mann-Whitney AUC per key, as CTEs ending in ``auc``."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    sel = f"{k}, " if keys else ""
    return f"""ranked AS (SELECT *, rank() OVER ({part} ORDER BY score)
         + (count(*) OVER (PARTITION BY {k + ', ' if keys else ''}score) - 1) / 2.0 AS avg_rank FROM {source}),
auc AS (SELECT {sel}sum(pos) AS np, count(*) - sum(pos) AS nn,
         (sum(CASE WHEN pos = 1 THEN avg_rank ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2.0)
          / nullif(sum(pos)::DOUBLE * (count(*) - sum(pos)), 0) AS auc FROM ranked {group})"""


def pr_sql(source, keys):
    """PR curve CTE ``pr`` (threshold, recall, precision) and its trapezoid ``area``."""
    k = ", ".join(keys)
    return f"""thr AS (SELECT {k}, score, sum(pos) AS p, count(*) AS n FROM {source} GROUP BY {k}, score),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS np, sum(p) OVER (PARTITION BY {k}) AS allp
  FROM thr WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT {k}, score AS threshold, tp::DOUBLE / allp AS recall, tp::DOUBLE / np AS prec FROM cum
  UNION ALL SELECT DISTINCT {k}, 'infinity'::DOUBLE, 0.0, 1.0 FROM cum),
area AS (SELECT {k}, sum((recall - r0) * (prec + p0) / 2) AS pr_auc FROM (
  SELECT *, lag(recall) OVER (PARTITION BY {k} ORDER BY threshold DESC) AS r0,
         lag(prec) OVER (PARTITION BY {k} ORDER BY threshold DESC) AS p0 FROM pr) GROUP BY {k})"""


@query("a1_confusion_binary", f"""WITH {fx.BINARY}, c AS (SELECT unnest([0, 1]) AS v),
g AS (SELECT DISTINCT model, split FROM bin)
SELECT g.model, g.split, t.v AS y_true, p.v AS y_pred, count(b.y_true) AS n
FROM g CROSS JOIN c t CROSS JOIN c p LEFT JOIN bin b
  ON b.model = g.model AND b.split = g.split AND b.y_true = t.v AND b.y_pred = p.v
GROUP BY ALL""")
def a1(spark, d):
    return C.confusion_matrix(fx.binary(spark, d), KEYS, [0, 1])


@query("a2_confusion_multiclass", f"""WITH {fx.MULTI}
SELECT model, CASE y_true WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS true_class,
  count(*) FILTER (WHERE y_pred = 0) AS "A", count(*) FILTER (WHERE y_pred = 1) AS "N",
  count(*) FILTER (WHERE y_pred = 2) AS "R" FROM multi GROUP BY ALL""")
def a2(spark, d):
    return C.confusion_pivot(fx.multi(spark, d), ["model"], ["A", "N", "R"])


@query("a3_accuracy", f"""WITH {fx.MULTI}
SELECT model, split, {r('avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM multi GROUP BY ALL""")
def a3(spark, d):
    return fx.rounded(C.accuracy(fx.multi(spark, d), KEYS))


@query("a4_chance_agreement", f"""{PER_CLASS}
SELECT model, split, {r('sum((sup / total) * (pred / total))')} AS chance_agreement FROM s GROUP BY ALL""")
def a4(spark, d):
    return fx.rounded(C.chance_agreement(fx.multi(spark, d), KEYS))


@query("a5_precision_recall_f1_binary", f"""{BIN}
SELECT model, split, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision,
  {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
  {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM k""")
def a5(spark, d):
    scores = C.binary_scores(fx.binary(spark, d), KEYS)
    return fx.rounded(scores.select(*KEYS, "precision", "recall", "f1"))


@query("a6_precision_recall_f1_weighted", f"""{PER_CLASS}
SELECT model, split, {r('sum(p * sup) / sum(sup)')} AS precision_weighted,
  {r('sum(rc * sup) / sum(sup)')} AS recall_weighted, {r('sum(f1 * sup) / sum(sup)')} AS f1_weighted
FROM s GROUP BY ALL""")
def a6(spark, d):
    scores = C.summary_scores(fx.multi(spark, d), KEYS)
    return fx.rounded(scores.select(*KEYS, "precision_weighted", "recall_weighted", "f1_weighted"))


@query("a7_precision_recall_f1_macro", f"""{PER_CLASS}
SELECT model, split, {r('avg(p)')} AS precision_macro, {r('avg(rc)')} AS recall_macro,
  {r('avg(f1)')} AS f1_macro FROM s GROUP BY ALL""")
def a7(spark, d):
    scores = C.summary_scores(fx.multi(spark, d), KEYS)
    return fx.rounded(scores.select(*KEYS, "precision_macro", "recall_macro", "f1_macro"))


@query("a8_precision_recall_f1_per_class", f"""{PER_CLASS}
SELECT model, split, c AS class, {r('p')} AS precision, {r('rc')} AS recall, {r('f1')} AS f1,
  sup::BIGINT AS support FROM s""")
def a8(spark, d):
    scores = C.per_class_scores(fx.multi(spark, d), KEYS)
    return fx.rounded(scores.select(*KEYS, "class", "precision", "recall", "f1", "support"))


@query("a9_classification_report", f"""{PER_CLASS}
SELECT model, split, c::VARCHAR AS label, {r('p')} AS precision, {r('rc')} AS recall, {r('f1')} AS f1,
  sup::BIGINT AS support FROM s
UNION ALL SELECT model, split, 'accuracy', {r('sum(tp) / max(total)')}, {r('sum(tp) / max(total)')},
  {r('sum(tp) / max(total)')}, max(total)::BIGINT FROM s GROUP BY model, split
UNION ALL SELECT model, split, 'macro avg', {r('avg(p)')}, {r('avg(rc)')}, {r('avg(f1)')},
  max(total)::BIGINT FROM s GROUP BY model, split
UNION ALL SELECT model, split, 'weighted avg', {r('sum(p * sup) / sum(sup)')}, {r('sum(rc * sup) / sum(sup)')},
  {r('sum(f1 * sup) / sum(sup)')}, max(total)::BIGINT FROM s GROUP BY model, split""")
def a9(spark, d):
    return fx.rounded(C.classification_report(fx.multi(spark, d), KEYS))


@query("a10_mcc_binary", f"{BIN} SELECT model, split, {r(MCC_ROW)} AS mcc FROM k")
def a10(spark, d):
    return fx.rounded(C.binary_scores(fx.binary(spark, d), KEYS).select(*KEYS, "mcc"))


@query("a11_mcc_multiclass", f"{PER_CLASS} SELECT model, split, {r(MCC_MULTI)} AS mcc FROM s GROUP BY ALL")
def a11(spark, d):
    return fx.rounded(C.summary_scores(fx.multi(spark, d), KEYS).select(*KEYS, "mcc"))


@query("a12_mcc_per_class", f"{PER_CLASS} SELECT model, split, c AS class, {r(MCC_ROW)} AS mcc FROM s")
def a12(spark, d):
    return fx.rounded(C.per_class_scores(fx.multi(spark, d), KEYS).select(*KEYS, "class", "mcc"))


@query("a13_roc_auc_binary", f"""WITH {fx.BINARY}, b AS (SELECT *, y_true AS pos FROM bin),
{auc_sql('b', KEYS)} SELECT model, split, {r('auc')} AS roc_auc FROM auc""")
def a13(spark, d):
    return fx.rounded(curves.binary_roc_auc(fx.binary(spark, d), KEYS))


@query("a13_roc_auc_documents", f"""WITH {fx.DOCS}, b AS (SELECT *, y_true AS pos FROM docs),
{auc_sql('b', ['model'])} SELECT model, {r('auc')} AS roc_auc FROM auc""")
def a13_docs(spark, d):
    return fx.rounded(curves.binary_roc_auc(fx.docs(spark, d), ["model"]))


OVR = f"""WITH {fx.MULTI}, b AS (SELECT model, split, c AS class, prob[c + 1] AS score,
  CASE WHEN y_true = c THEN 1 ELSE 0 END AS pos FROM multi, unnest([0, 1, 2]) AS u(c)),
{auc_sql('b', ['model', 'split', 'class'])}"""


@query("a14_roc_auc_ovr_weighted", f"""{OVR}
SELECT model, split, {r('sum(auc * np) / sum(np)')} AS roc_auc_ovr_weighted FROM auc GROUP BY ALL""")
def a14(spark, d):
    return fx.rounded(C.ovr_auc(fx.multi(spark, d), KEYS).drop("roc_auc_ovr_macro"))


@query("a15_roc_auc_ovr_macro",
       f"{OVR} SELECT model, split, {r('avg(auc)')} AS roc_auc_ovr_macro FROM auc GROUP BY ALL")
def a15(spark, d):
    return fx.rounded(C.ovr_auc(fx.multi(spark, d), KEYS).drop("roc_auc_ovr_weighted"))


@query("a16_roc_auc_ovo_weighted", f"""WITH {fx.MULTI},
b AS (SELECT model, split, k AS class, o AS other, prob[k + 1] AS score,
        CASE WHEN y_true = k THEN 1 ELSE 0 END AS pos
      FROM multi, unnest([0, 1, 2]) AS u(k), unnest([0, 1, 2]) AS v(o)
      WHERE k <> o AND (y_true = k OR y_true = o)),
{auc_sql('b', ['model', 'split', 'class', 'other'])},
pairs AS (SELECT model, split, least(class, other) AS a, greatest(class, other) AS z,
            avg(auc) AS auc, max(np + nn) AS w FROM auc GROUP BY ALL)
SELECT model, split, {r('sum(auc * w) / sum(w)')} AS roc_auc_ovo_weighted FROM pairs GROUP BY ALL""")
def a16(spark, d):
    return fx.rounded(C.ovo_auc_weighted(fx.multi(spark, d), KEYS, 3))


@query("a17_pr_auc", f"""WITH {fx.BINARY}, b AS (SELECT *, y_true AS pos FROM bin),
{pr_sql('b', KEYS)} SELECT model, split, {r('pr_auc')} AS pr_auc FROM area""")
def a17(spark, d):
    return fx.rounded(curves.pr_auc(fx.binary(spark, d), KEYS))


@query("a18_model_split_summary", f"""{PER_CLASS}, b AS (SELECT model, split, c AS class, prob[c + 1] AS score,
  CASE WHEN y_true = c THEN 1 ELSE 0 END AS pos FROM multi, unnest([0, 1, 2]) AS u(c)),
{auc_sql('b', ['model', 'split', 'class'])},
m AS (SELECT model, split, sum(tp) / max(total) AS accuracy, {MCC_MULTI} AS mcc FROM s GROUP BY model, split),
o AS (SELECT model, split, sum(auc * np) / sum(np) AS auc FROM auc GROUP BY model, split)
SELECT model, split, {r('accuracy')} AS accuracy, {r('mcc')} AS mcc, {r('auc')} AS roc_auc_ovr_weighted
FROM m JOIN o USING (model, split) WHERE split IN ('val', 'test')""")
def a18(spark, d):
    preds = fx.multi(spark, d).filter(F.col("split").isin("val", "test"))
    return fx.rounded(C.model_split_summary(preds, KEYS))


BUNDLE = f"""{BIN}, b AS (SELECT *, y_true AS pos FROM bin), {auc_sql('b', KEYS)}, {pr_sql('b', KEYS)}
SELECT model, split, {r('(tp + tn) / n')} AS accuracy, {r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision,
  {r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
  {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {r(MCC_ROW)} AS mcc,
  {r('auc')} AS roc_auc, {r('pr_auc')} AS pr_auc
FROM k JOIN auc USING (model, split) JOIN area USING (model, split)"""


@query("a19_binary_bundle", BUNDLE)
def a19(spark, d):
    return fx.rounded(C.binary_bundle(fx.binary(spark, d), KEYS))


@query("a20_losses", f"""WITH {fx.MULTI}, {fx.BINARY},
bce AS (SELECT model, split, avg(greatest(x, 0) - x * y_true + ln(1 + exp(-abs(x)))) AS bce
  FROM (SELECT model, split, y_true, score * 20 - 1 AS x FROM bin) GROUP BY ALL),
ce AS (SELECT model, split, avg(ln(exp(prob[1]) + exp(prob[2]) + exp(prob[3])) - prob[y_true + 1]) AS cross_entropy,
  avg((prob[1] - y_true)^2) AS mse FROM multi GROUP BY ALL)
SELECT model, split, {r('bce')} AS bce, {r('cross_entropy')} AS cross_entropy, {r('mse')} AS mse
FROM bce JOIN ce USING (model, split)""")
def a20(spark, d):
    logit = F.col("score") * 20 - 1
    bce = C.mean_losses(fx.binary(spark, d), KEYS, bce=logits.bce_with_logits(logit, F.col("y_true")))
    y = F.col("y_true")
    rest = C.mean_losses(
        fx.multi(spark, d), KEYS, cross_entropy=logits.cross_entropy(F.col("prob"), y),
        mse=logits.squared_error(F.get("prob", 0), y),
    )
    return fx.rounded(bce.join(rest, KEYS))


@query("a20_ensemble_loss", f"""WITH {fx.MULTI}
SELECT model, split, {r('avg((p - y_true)^2)')} AS ensemble_mse
FROM (SELECT model, split, y_true, unnest(prob) AS p FROM multi) GROUP BY ALL""")
def a20_ensemble(spark, d):
    members = fx.multi(spark, d).select(*KEYS, "y_true", F.explode("prob").alias("member"))
    loss = logits.squared_error(F.col("member"), F.col("y_true"))
    return fx.rounded(C.mean_losses(members, KEYS, ensemble_mse=loss))


@query("w1_roc_curve", f"""WITH {fx.BINARY},
thr AS (SELECT model, split, score, sum(y_true) AS p, count(*) - sum(y_true) AS q FROM bin GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY model, split) AS allp,
   sum(q) OVER (PARTITION BY model, split) AS alln FROM thr
   WINDOW w AS (PARTITION BY model, split ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, split, {r('score')} AS threshold, {r('fp::DOUBLE / alln')} AS fpr, {r('tp::DOUBLE / allp')} AS tpr FROM cum
UNION ALL SELECT DISTINCT model, split, 'infinity'::DOUBLE, 0.0, 0.0 FROM bin""")
def w1(spark, d):
    counts = curves.score_counts(fx.binary(spark, d), KEYS)
    points = curves.roc_curve(counts, KEYS)
    return fx.rounded(points, skip=["threshold"])


@query("w1_roc_curve_per_class", f"""WITH {fx.MULTI},
b AS (SELECT model, c AS class, prob[c + 1] AS score, CASE WHEN y_true = c THEN 1 ELSE 0 END AS pos
  FROM multi, unnest([0, 1, 2]) AS u(c)),
thr AS (SELECT model, class, score, sum(pos) AS p, count(*) - sum(pos) AS q FROM b GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY model, class) AS allp,
   sum(q) OVER (PARTITION BY model, class) AS alln FROM thr
   WINDOW w AS (PARTITION BY model, class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT model, class, fp::DOUBLE / alln AS fpr, tp::DOUBLE / allp AS tpr FROM cum
  UNION ALL SELECT DISTINCT model, class, 0.0, 0.0 FROM b)
SELECT model, class, count(*) AS points, {r('sum(fpr) / 1000')} AS fpr_sum, {r('sum(tpr) / 1000')} AS tpr_sum
FROM pts GROUP BY ALL""")
def w1_per_class(spark, d):
    keys = ["model", "class"]
    counts = curves.class_score_counts(fx.multi(spark, d), ["model"])
    points = curves.roc_curve(counts, keys)
    return fx.rounded(points.groupBy(*keys).agg(
        F.count("*").alias("points"), (F.sum("fpr") / 1000).alias("fpr_sum"),
        (F.sum("tpr") / 1000).alias("tpr_sum"),
    ))


@query("w2_pr_curve", f"""WITH {fx.BINARY}, b AS (SELECT *, y_true AS pos FROM bin), {pr_sql('b', KEYS)}
SELECT model, split, threshold, {r('recall')} AS recall, {r('prec')} AS precision FROM pr""")
def w2(spark, d):
    counts = curves.score_counts(fx.binary(spark, d), KEYS)
    return fx.rounded(curves.pr_curve(counts, KEYS), skip=["threshold"])


@query("w7_average_rank", f"""WITH {fx.BINARY}
SELECT DISTINCT model, score, count(*) OVER (PARTITION BY model, score) AS ties,
  rank() OVER (PARTITION BY model ORDER BY score) AS first_rank,
  rank() OVER (PARTITION BY model ORDER BY score)
   + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS average_rank FROM bin""")
def w7(spark, d):
    return curves.average_rank(fx.binary(spark, d), ["model"], "score")


@query("f4_ensemble_softmax", f"""WITH {fx.MULTI},
s AS (SELECT model, split, y_true,
  [exp(prob[1]), exp(prob[2]), exp(prob[3])] AS e1, [exp(2 * prob[1]), exp(2 * prob[2]), exp(2 * prob[3])] AS e2
  FROM multi),
p AS (SELECT model, split, y_true, list_transform([1, 2, 3],
  lambda i: (e1[i] / list_sum(e1) + e2[i] / list_sum(e2)) / 2) AS p FROM s),
a AS (SELECT *, CASE WHEN p[1] >= p[2] AND p[1] >= p[3] THEN 0 WHEN p[2] >= p[3] THEN 1 ELSE 2 END AS y_pred FROM p)
SELECT model, split, y_pred, count(*) AS n, {r('avg(p[1])')} AS p0, {r('avg(p[2])')} AS p1, {r('avg(p[3])')} AS p2
FROM a GROUP BY ALL""")
def f4(spark, d):
    members = F.array("prob", F.transform("prob", lambda x: x * 2))
    rows = fx.multi(spark, d).withColumn("p", logits.ensemble_probability(members))
    out = rows.groupBy(*KEYS, logits.argmax(F.col("p")).alias("y_pred")).agg(
        F.count("*").alias("n"), *[F.avg(F.get("p", i)).alias(f"p{i}") for i in range(3)]
    )
    return fx.rounded(out)


@query("f5_ensemble_mean", f"""WITH {fx.MULTI}
SELECT model, split, {r('avg((prob[1] + prob[2] + prob[3]) / 3)')} AS mean_prediction,
  {r('max(((prob[1] + prob[3]) / 2))')} AS max_pair_mean FROM multi GROUP BY ALL""")
def f5(spark, d):
    pair = F.array(F.get("prob", 0), F.get("prob", 2))
    return fx.rounded(fx.multi(spark, d).groupBy(*KEYS).agg(
        F.avg(logits.mean_of_values(F.col("prob"))).alias("mean_prediction"),
        F.max(logits.mean_of_values(pair)).alias("max_pair_mean"),
    ))


@query("f6_sigmoid", f"""WITH {fx.BINARY}
SELECT score AS logit, {r('1 / (1 + exp(-(score * 20 - 1)))')} AS probability, count(*) AS n FROM bin GROUP BY ALL""")
def f6(spark, d):
    rows = fx.binary(spark, d).groupBy(F.col("score").alias("logit")).agg(F.count("*").alias("n"))
    return fx.rounded(
        rows.withColumn("probability", logits.sigmoid(F.col("logit") * 20 - 1)), skip=["logit"]
    )


@query("p12_binary_decision", f"""WITH {fx.BINARY}
SELECT model, split, round_even(1 / (1 + exp(-(score - 0.05) * 100)), 0)::INT AS y_pred, count(*) AS n
FROM bin GROUP BY ALL""")
def p12(spark, d):
    logit = (F.col("score") - 0.05) * 100
    return fx.binary(spark, d).groupBy(
        *KEYS, logits.binary_decision(logit).alias("y_pred")
    ).agg(F.count("*").alias("n"))


@query("p9_label_range_check", f"""WITH {fx.MULTI}, s AS (SELECT DISTINCT y_true + 1 AS label FROM multi),
w AS (SELECT unnest([0, 1, 2]) AS label)
SELECT label, 'unexpected' AS problem FROM s WHERE label NOT IN (SELECT label FROM w)
UNION ALL SELECT label, 'missing' FROM w WHERE label NOT IN (SELECT label FROM s)""")
def p9(spark, d):
    shifted = fx.multi(spark, d).select((F.col("y_true") + 1).alias("label"))
    return C.label_violations(shifted, "label", 3)
