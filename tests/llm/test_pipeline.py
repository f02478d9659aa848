"""The stages on odd rows, and the whole run on the smallest tables."""
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tallybench.llm import minhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, docs, nothing):
    for table in (docs, nothing):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns and [t for _, t in rows.dtypes] == [t for _, t in docs.dtypes], name


def test_columns_of_the_stages_own_names_are_kept(spark, docs):
    names = ["_id", "_maybe", "_place", "_bucket", "_bits", "_own", "_kept", "_rows", "_had", "had", "row", "_rest", "_text", "_letters", "_found", "_base", "_secret", "lang_pred"]
    rows = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == [*docs.columns, *names], name
        for r in rows.where("doc_id is not null").collect():
            assert [r[n] for n in names] == [f"{n} {r.doc_id}" for n in names], name


def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, rows = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, SF).write.parquet(str(tmp_path / name))
        rows = found[name] = spark.read.parquet(str(tmp_path / name))
    known = found["language_id"]
    assert known.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    once = found["near_duplicates"]
    kept = {r.doc_id for r in minhash.near_duplicates(known).where("kept").collect()}
    assert {r.doc_id for r in once.collect()} == kept and once.count() == len(kept)
    assert minhash.near_duplicates(once).where("not kept").count() == 0
    before = {r.doc_id: r.text for r in once.collect()}
    seen = set()
    for r in found["substring_dedup"].orderBy("doc_id").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert r.n_chars == len(r.text) and len(words) <= len(before[r.doc_id].split())
        seen.add(r.doc_id)
    assert len(seen) >= 0.95 * len(before)
    assert found["pii"].where(F.col("text").rlike("[A-Za-z0-9]@[A-Za-z0-9]+[.]|AKIA[A-Z0-9]{16}")).count() == 0
    ids = {r.doc_id for r in found["pii"].select("doc_id").collect()}
    packed = found["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    got = corpus_pipeline.run(spark, SF)
    assert got.drop("sequence_id", "offset").exceptAll(packed.drop("sequence_id", "offset")).count() == 0
    assert got.count() == packed.count()
