"""The corpus pipeline: language, near duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybench.llm import groups, language, minhash, packing, pii, substrings
from tallybench.session import cut_lineage, scratch_folder


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go. Learns from three quarters.

    If no language is given at all, only those without a letter go.
    """
    taught = F.coalesce(language.remainder("doc_id", 4) != 2, F.lit(True))
    model = language.train(docs.where(taught))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.identified(docs, model)


def _packed(docs: DataFrame, *more) -> DataFrame:
    """Rows as one struct ``row``, so that no column of theirs meets one of the stage's."""
    return docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), *more)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8).

    Only documents that may go, or are there more than once, are joined with the verdicts.
    Columns of any name are kept.
    """
    rows = _packed(docs, F.col("doc_id").alias("_id"))
    judged = minhash.near_duplicates(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.max("kept").alias("_kept"))
    doubted = cut_lineage(judged.where("_rows > 1 or not _kept").select("_id", "_kept"))
    marked = groups.among(rows, doubted, ["_id"])
    unsure = marked.where("_maybe").withColumnRenamed("_id", "_own")
    unsure = unsure.join(doubted, F.col("_own").eqNullSafe(F.col("_id")), "left").where("coalesce(_kept, true)")
    unsure = unsure.withColumn("_text", F.col("row.text")).dropDuplicates(["_own", "_text"])
    return marked.where("not _maybe").select("row").unionByName(unsure.select("row")).select("row.*")


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents of nothing else go.

    Columns of any name are kept.
    """
    word = r"[^\x20\x09-\x0D]"
    had = F.coalesce(F.col("text").rlike(word), F.lit(False))
    left = substrings.without_repeats(_packed(docs, F.col("doc_id"), F.col("text"), had.alias("had")))
    left = left.where(~F.col("had") | F.col("text").rlike(word))
    return _counted(left.select(*((F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns)))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.redact(docs, pii.train(docs)))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.packed(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each),
    ("substring_dedup", without_passages),
    ("pii", without_personal_data),
    ("packing", into_sequences),
]

#: The stages hold models and components, which SQL can't express; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
