"""Queries that shape, label, split, scale and encode tables."""

from pyspark.sql import functions as F

from ..functions import encode
from ..functions.distance import total
from ..operators import scaling, tables as T
from . import fixtures as fx
from .fixtures import r
from .registry import query

VALUES = ["l_quantity", "l_discount", "l_tax"]


@query("p1_binarise_first_row", """WITH n AS (SELECT s_suppkey AS row_id, s_acctbal / 10000 AS a, s_nationkey / 25.0::DOUBLE AS b FROM supplier)
SELECT row_id, a AS "C_1", b AS "C_2" FROM n
UNION ALL SELECT (SELECT max(row_id) + 1 FROM n), (a >= 0.5)::INT::DOUBLE, (b >= 0.5)::INT::DOUBLE FROM n WHERE row_id = 0""")
def p1(spark, d):
    rows = fx.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("row_id"), (F.col("s_acctbal") / 10000).alias("a"),
        (F.col("s_nationkey") / 25).alias("b"),
    )
    return T.binarise_first_row(rows, "row_id", ["a", "b"])


@query("p2_header_as_first_row", """SELECT 0::BIGINT AS row_id, 569 AS "M1", 505 AS "M2"
UNION ALL SELECT o_orderkey + 1, (o_custkey % 50)::INT, (o_orderkey % 7)::INT FROM orders""")
def p2(spark, d):
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 50).alias("569"),
        (F.col("o_orderkey") % 7).alias("505"),
    )
    return T.header_as_first_row(rows, "row_id", ["569", "505"])


@query("p3_pair_counts", f"WITH {fx.RATES} SELECT m1, m2, count(*) AS n FROM rates GROUP BY ALL")
def p3(spark, d):
    return T.pair_counts(fx.rates(spark, d))


@query("p3_one_pair_count", f"WITH {fx.RATES} SELECT count(*) AS n FROM rates WHERE m1 = 3 AND m2 = 3")
def p3_one(spark, d):
    return T.pair_count(fx.rates(spark, d), 3, 3)


KINDS = {"A": "comp", "N": "fcoop", "R": "obligate_xx"}


def _by_flag(spark, d, flag):
    cols = ["l_orderkey", "l_returnflag", *VALUES]
    return fx.table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select(*cols)


@query("p4_assign_label", """SELECT l_orderkey, l_returnflag, l_quantity, l_discount, l_tax, 4 AS label
FROM lineitem WHERE l_returnflag = 'R'""")
def p4(spark, d):
    return T.assign_label(_by_flag(spark, d, "R"), "obligate_xx")


@query("p5_features_and_label", f"""WITH {fx.EMB}
SELECT row_id, label, {r('list_sum(features)')} AS feature_sum, len(features) AS width FROM emb""")
def p5(spark, d):
    X, y = T.features_and_label(fx.emb(spark, d).select("row_id", "features", "label"), "label", "row_id")
    sums = X.select("row_id", total(F.col("features")).alias("feature_sum"),
                    F.size("features").cast("long").alias("width"))
    return fx.rounded(y.join(sums, "row_id"))


@query("p6_remap_labels", """WITH s AS (SELECT c_nationkey % 5 AS label FROM customer)
SELECT 'merge_obligate' AS preset, CASE label WHEN 2 THEN 1 ELSE label END AS label, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT 'shift_three', CASE label WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE label END, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'three_as_one', CASE label WHEN 3 THEN 1 ELSE label END, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'two_as_zero', CASE label WHEN 2 THEN 0 ELSE label END, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'compact_three', CASE label WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE label END, count(*) FROM s GROUP BY ALL""")
def p6(spark, d):
    labels = fx.table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("label"))
    return T.concat_rows([
        T.remap_labels(labels, "label", preset).groupBy("label").agg(F.count("*").alias("n"))
        .select(F.lit(preset).alias("preset"), "label", "n")
        for preset in T.REMAP_PRESETS
    ])


@query("p7_take_column_names", "SELECT s_suppkey AS c_custkey, s_acctbal AS c_acctbal FROM supplier")
def p7(spark, d):
    real = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return T.take_names(fx.table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), real)


@query("p8_preview", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def p8(spark, d):
    return T.preview(fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


@query("p8_column_list", """SELECT (ordinal_position - 1)::INT AS position, column_name AS name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int'
    WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type
FROM information_schema.columns WHERE table_name = 'part'""")
def p8_columns(spark, d):
    return T.column_list(fx.table(spark, d, "part"))


@query("p10_feature_vector", f"""SELECT l_returnflag, count(*) AS n, {r('sum(list_sum([l_quantity, l_discount, l_tax]))', 3)} AS cells
FROM lineitem GROUP BY ALL""")
def p10(spark, d):
    rows = T.to_features(fx.table(spark, d, "lineitem").select("l_returnflag", *VALUES), VALUES)
    return fx.rounded(rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum(total(F.col("features"))).alias("cells")), 3)


@query("p11_attribute_code", "SELECT s_suppkey, trunc(abs(s_acctbal))::INT AS code FROM supplier")
def p11(spark, d):
    s = fx.table(spark, d, "supplier")
    return s.select("s_suppkey", encode.attribute_code(F.col("s_acctbal")).alias("code"))


@query("p14_metric_name_filter", """WITH m AS (SELECT event_type || CASE WHEN user_id % 2 = 0 THEN '_naive' ELSE '_oc' END AS metric, value FROM events)
SELECT metric, round(avg(value), 6) + 0 AS value FROM m WHERE contains(metric, 'naive') GROUP BY ALL""")
def p14(spark, d):
    from ..operators.statistics import metrics_named
    suffix = F.when(F.col("user_id") % 2 == 0, "_naive").otherwise("_oc")
    m = fx.table(spark, d, "events").select(F.concat("event_type", suffix).alias("metric"), "value")
    return fx.rounded(metrics_named(m, "naive").groupBy("metric").agg(F.avg("value").alias("value")))


@query("u1_concat_rows", """SELECT l_orderkey, l_returnflag, l_quantity, l_discount, l_tax FROM lineitem""")
def u1(spark, d):
    return T.concat_rows([_by_flag(spark, d, flag) for flag in "ANR"])


@query("u2_augment", f"""WITH {fx.EMB} SELECT source, label, count(*) AS n, {r('sum(features[1])')} AS first_sum FROM (
  SELECT 'real' AS source, label, features FROM emb WHERE row_id % 2 = 0
  UNION ALL SELECT 'synthetic', label, features FROM emb WHERE row_id % 2 = 1) GROUP BY ALL""")
def u2(spark, d):
    rows = fx.emb(spark, d).select("row_id", "label", "features")
    synth = rows.filter("row_id % 2 = 1").toDF("id", "y", "x")
    both = T.augment(rows.filter("row_id % 2 = 0"), synth)
    return fx.rounded(both.groupBy("source", "label").agg(
        F.count("*").alias("n"), F.sum(F.get("features", 0)).alias("first_sum")))


@query("u3_distinct_labels", f"WITH {fx.EMB} SELECT DISTINCT cluster FROM emb")
def u3(spark, d):
    return fx.emb(spark, d).select("cluster").distinct()


@query("u4_label_difference", f"WITH {fx.EMB} SELECT DISTINCT cluster FROM emb WHERE cluster <> -1")
def u4(spark, d):
    labels = fx.emb(spark, d).select("cluster")
    noise = labels.sparkSession.range(1).select(F.lit(-1).alias("cluster"))
    return labels.subtract(noise)


@query("u5_stack_labelled", """SELECT l_orderkey, l_returnflag, l_quantity, l_discount, l_tax,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 4 END AS label FROM lineitem""")
def u5(spark, d):
    return T.stack_labelled({kind: _by_flag(spark, d, flag) for flag, kind in KINDS.items()})


@query("t2_first_rows", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def t2(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("w5_renumber", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders")
def w5(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey")
    return T.renumber(rows, "o_orderkey")


@query("j15_concat_columns", """SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM
  (SELECT c_custkey AS k, c_acctbal AS x FROM customer) a FULL JOIN
  (SELECT s_suppkey * 2 AS k, s_acctbal AS y FROM supplier) b ON a.k = b.k""")
def j15(spark, d):
    a = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    b = fx.table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_acctbal").alias("y"))
    return T.concat_columns(a, b, "k")


@query("x1_train_val_test_split", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('4421:' || o_orderkey), o_orderkey) AS rk,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rk <= ceil(round(ceil(round(n * 0.4, 9)) * 0.5, 9)) THEN 'test'
  WHEN rk <= ceil(round(n * 0.4, 9)) THEN 'val' ELSE 'train' END AS split FROM k""")
def x1(spark, d):
    return T.train_val_test_split(fx.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("x2_stratified_split", """WITH k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rk, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority, CASE WHEN rk <= ceil(round(n * 0.2, 9)) THEN 'test' ELSE 'train' END AS split FROM k""")
def x2(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return T.stratified_split(rows, "o_orderkey", ["o_orderpriority"])


@query("x3_two_stage_split", """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) AS rk,
  count(*) OVER () AS n FROM orders),
c AS (SELECT *, ceil(round(n * 0.2, 9)) AS t FROM k)
SELECT o_orderkey, CASE WHEN rk <= t THEN 'test' WHEN rk <= t + ceil(round((n - t) * 0.2, 9)) THEN 'val' ELSE 'train' END AS split FROM c""")
def x3(spark, d):
    return T.two_stage_split(fx.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


LONG = f"WITH {fx.EMB}, long AS (SELECT row_id, generate_subscripts(features, 1) - 1 AS pos, unnest(features) AS x FROM emb)"


@query("f10_standard_scaling", f"""{LONG}, st AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY pos)
SELECT row_id, pos::INT AS pos, {r('(x - m) / CASE WHEN s > 0 THEN s ELSE 1 END')} AS x FROM long JOIN st USING (pos)""")
def f10(spark, d):
    scaled = scaling.standard_scale(fx.emb(spark, d).select("row_id", "features"))
    return fx.rounded(scaling.positions(scaled, ["row_id"]))


@query("f9_min_max_similarity", f"""WITH k AS (SELECT c_custkey, c_acctbal + 1000 AS d FROM customer),
s AS (SELECT c_custkey, 1 - d / (SELECT sqrt(sum(d * d)) FROM k) AS s FROM k)
SELECT c_custkey, {r('(s - (SELECT min(s) FROM s)) / ((SELECT max(s) FROM s) - (SELECT min(s) FROM s))')} AS similarity FROM s""")
def f9(spark, d):
    rows = fx.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("d"))
    return fx.rounded(scaling.min_max_similarity(rows, "d").drop("d"))


@query("f11_quantile_table", f"""{LONG} SELECT pos::INT AS pos, list_transform(quantile_cont(x, {[i / 15 for i in range(16)]}), lambda v: round(v, 9) + 0) AS edges
FROM long GROUP BY pos""")
def f11_table(spark, d):
    q = scaling.quantile_table(fx.emb(spark, d), 16)
    return q.withColumn("edges", F.transform("edges", lambda v: F.round(v, 9)))


def _horner(coefficients, x):
    out = f"({coefficients[0]!r})::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r})::DOUBLE)"
    return out


def _tail(q):
    t = f"sqrt((-2.0)::DOUBLE * ln({q}))"
    return f"({_horner(encode._TAIL_NUM, t)} / {_horner(encode._TAIL_DEN, t)})"


RANK = "((i / (c - 1)::DOUBLE) * (n - 1))"
NORMAL = f"""CASE WHEN p < {encode._TAIL_FROM} THEN {_tail('p')} WHEN p > 1 - {encode._TAIL_FROM} THEN -{_tail('(1 - p)')}
  ELSE (p - 0.5) * {_horner(encode._CENTRE_NUM, '((p - 0.5) * (p - 0.5))')} / {_horner(encode._CENTRE_DEN, '((p - 0.5) * (p - 0.5))')} END"""


@query("f11_quantile_normal", f"""{LONG}, s AS (SELECT pos, list_sort(list(x)) AS l, count(*) AS n, greatest(least(count(*) // 30, 1000), 10) AS c FROM long GROUP BY pos),
t AS (SELECT pos, c, list_transform(range(c), lambda i: l[floor({RANK})::INT + 1] + (l[ceil({RANK})::INT + 1] - l[floor({RANK})::INT + 1]) * ({RANK} - floor({RANK}))) AS e FROM s),
q AS (SELECT row_id, pos, x, c - 1 AS k, e, len(list_filter(e, lambda v: v < x)) AS b, len(list_filter(e, lambda v: v <= x)) AS u FROM long JOIN t USING (pos)),
h AS (SELECT row_id, pos, least(greatest(CASE WHEN x <= e[1] THEN 0.0::DOUBLE WHEN x >= e[len(e)] THEN 1.0::DOUBLE WHEN u = b THEN (b - 1 + (x - e[b]) / (e[b + 1] - e[b])) / k
  ELSE (b + u - 1) / (2.0::DOUBLE * k) END, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p FROM q)
SELECT row_id, list({r(NORMAL)} ORDER BY pos) AS features FROM h GROUP BY row_id""")
def f11(spark, d):
    rows = fx.emb(spark, d)
    count = scaling.quantile_levels(rows.count())
    wide = scaling.quantile_normal(rows, "row_id", count)
    return wide.select("row_id", F.transform("features", lambda v: F.round(v, 6)).alias("features"))


@query("f13_piecewise_linear", f"""{LONG}, e AS (SELECT pos, quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM long GROUP BY pos)
SELECT row_id, pos::INT AS pos, [{r('least((x - e[1]) / (e[2] - e[1]), 1)')}, {r('greatest(least((x - e[2]) / (e[3] - e[2]), 1), 0)')},
  {r('greatest(least((x - e[3]) / (e[4] - e[3]), 1), 0)')}, {r('greatest((x - e[4]) / (e[5] - e[4]), 0)')}] AS encoding
FROM long JOIN e USING (pos)""")
def f13(spark, d):
    code = scaling.piecewise_linear_encode(fx.emb(spark, d), "row_id", 4)
    return code.withColumn("encoding", F.transform("encoding", lambda v: F.round(v, 6)))


@query("f14_one_hot", """SELECT s_suppkey, list_transform([0, 1, 2, 3, 4], lambda i: CASE WHEN i = s_nationkey % 7 THEN 1 ELSE 0 END) AS code FROM supplier""")
def f14(spark, d):
    s = fx.table(spark, d, "supplier")
    return s.select("s_suppkey", encode.one_hot(F.col("s_nationkey") % 7, 5).alias("code"))


MEMBER = """WITH g AS (SELECT c_custkey, c_nationkey % 3 AS a, -(c_nationkey % 4) AS b FROM customer),
m AS (SELECT c_custkey, [(a = 0)::INT, (a = 1)::INT, (a = 2)::INT, (b = 0)::INT, (b = -1)::INT, (b = -2)::INT, (b = -3)::INT] AS membership FROM g)"""


def _members(spark, d):
    rows = fx.table(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") % 3).alias("a"), (-(F.col("c_nationkey") % 4)).alias("b"))
    return scaling.group_membership(rows, ["a", "b"]).drop("a", "b")


@query("f15_group_membership", f"{MEMBER} SELECT * FROM m")
def f15(spark, d):
    return _members(spark, d)


@query("f16_centred_membership", f"""{MEMBER}, sh AS (SELECT [{', '.join(f'avg(membership[{i}])' for i in range(1, 8))}] AS s FROM m)
SELECT c_custkey, [{', '.join(r(f'membership[{i}] - s[{i}]') for i in range(1, 8))}] AS membership FROM m, sh""")
def f16(spark, d):
    out = scaling.centred_membership(_members(spark, d))
    return out.withColumn("membership", F.transform("membership", lambda v: F.round(v, 6)))


@query("f17_clip", "SELECT s_suppkey, least(greatest(s_acctbal / 5000, 0), 1) + 0 AS clipped FROM supplier")
def f17(spark, d):
    return fx.table(spark, d, "supplier").select("s_suppkey", encode.clip01(F.col("s_acctbal") / 5000).alias("clipped"))
