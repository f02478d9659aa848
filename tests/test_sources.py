import pytest
from pyspark.sql import functions as F

from tallybench.sources import descriptor, history_log, metric_files, split_files, tables
from tallybench.session import scratch_folder


def test_descriptor_tolerates_and_reports_faults(spark):
    text = '{"column_names": ["a", "b"], "num_col_idx": [0, 1], "target_col_idx": [2], ' \
           '"column_info": {"a": "int64", "b": "float64"}, "train_num": 3, "test_num": 1,}'
    spec, valid = descriptor.parse(text)
    train = spark.createDataFrame([(1, 0.5)] * 3, descriptor.schema(spec))
    rows = {r["check"]: r["ok"] for r in descriptor.checks(spec, valid, train, train.limit(1)).collect()}
    assert rows == {"valid_json": False, "columns": True, "typed_columns": True, "index_in_range": False,
                    "index_listed_once": True, "train_num": True, "test_num": True}


def test_metric_names_drift_and_stray_values(spark):
    text = '{"M": {"Test AUC": 0.5, "ft": true}, "N \\"x\\"": {"ROC AUC": 0.25, "Test R²": 0.1, "Odd": 1}}'
    rows = metric_files.canonical(metric_files.parse(
        spark.createDataFrame([("d", text)], "dataset string, json string")))
    got = sorted((r["model"], r["split"], r["metric"], r["value"]) for r in rows.collect())
    assert got == [("M", "test", "roc_auc", 0.5), ('N "x"', "test", "r2", 0.1),
                   ('N "x"', "test", "roc_auc", 0.25), ('N "x"', "unknown", "Odd", 1.0)]


def test_nested_metric_text_round_trip(spark):
    rows = [("d", 'a"b', "MCC", 0.5), ("d", "c", "MCC", 0.25), ("d", "c", "F1", 1.0)]
    df = spark.createDataFrame(rows, "dataset string, model string, metric string, value double")
    back = metric_files.parse(metric_files.nested(df)).collect()
    assert sorted(tuple(r) for r in back) == sorted(rows)


def test_positions_survive_many_part_files(spark):
    root = scratch_folder(spark, "t")
    base = split_files.folder(root, "Classification", "COLLECTION_A", "100", "BC-I")
    rows = spark.range(500).select(
        F.col("id").alias("row_id"), F.col("id").alias("x"), (F.col("id") * 3).alias("y"),
        F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split")).repartition(6)
    split_files.write_split(rows, base, "BC-I", "row_id", ["x"], "y")
    back = split_files.read_split(spark, root, dataset="BC-I").collect()
    assert len(back) == 500 and all(r["label"] == 3 * r["features"][0] for r in back)
    assert sorted(r["row_id"] for r in back if r["split"] == "val") == list(range(167))
    assert {(r["collection"], r["group"]) for r in back} == {("COLLECTION_A", "100")}


def test_training_log(spark, tmp_path):
    folder = tmp_path / "run=4"
    folder.mkdir()
    (folder / "a.log").write_text(
        "noise\n(val) -26.8772 (test) -27.1\nNew best epoch!\n\n(val) -29.0 (test) -29.5\n\n"
        "(val) -2.5e-01 (test) 0.5 [time] 3s\nNew best epoch!\n")
    rows = history_log.read_history(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [(r["epoch"], r["val"], r["test"], r["new_best"]) for r in rows] == [
        (0, -26.8772, -27.1, True), (1, -29.0, -29.5, False), (2, -0.25, 0.5, True)]


def test_hot_key_folder_is_written_by_several_tasks(spark):
    path = scratch_folder(spark, "t")
    # Tiny shuffles are merged by default, which would hide the spreading.
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        tables.save_by_key(spark.range(1000).select(F.lit(1).alias("k"), "id"), path, ["k"], rows_per_file=100)
    finally:
        spark.conf.unset(merge)
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 1
    assert tables.load_by_key(spark, path, k=1).count() == 1000


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_collections_of_different_width(spark, tmp_path):
    a, b = (tmp_path / "T" / c / "50" / "D" / "csv" for c in ("A", "B"))
    _write(a / "X_train_D.csv", "c1,c2\n1,2\n3,4\n")
    _write(a / "y_train_D.csv", "y\n10\n30\n")
    _write(b / "X_train_D.csv", "c2,c1,c3\n5,6,7\n")
    _write(b / "y_train_D.csv", "y\n50\n")
    rows = sorted((r["collection"], r["features"], r["columns"], r["label"]) for r in split_files.read_split(spark, str(tmp_path)).collect())
    assert rows == [("A", [1.0, 2.0], ["c1", "c2"], 10.0), ("A", [3.0, 4.0], ["c1", "c2"], 30.0),
                    ("B", [5.0, 6.0, 7.0], ["c2", "c1", "c3"], 50.0)]


def test_mismatches_raise(spark, tmp_path):
    folder = tmp_path / "T" / "A" / "50" / "D" / "csv"
    _write(folder / "X_train_D.csv", "c1\n1\n2\n")
    _write(folder / "y_train_D.csv", "y\n1\n")
    with pytest.raises(Exception, match="differ in number"):
        split_files.read_split(spark, str(tmp_path)).collect()
    _write(folder / "y_train_D.csv", "y\n1\nx\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        split_files.read_split(spark, str(tmp_path)).collect()


def test_part_files_follow_their_number(spark, tmp_path):
    from tallybench.sources.position import with_position

    for number in (99999, 100000, 7):
        (tmp_path / f"part-{number:05d}-x.csv").write_text(f"{number}\n")
    rows = with_position(spark.read.text(str(tmp_path))).orderBy("row_id").collect()
    assert [r["value"] for r in rows] == ["7", "99999", "100000"]
