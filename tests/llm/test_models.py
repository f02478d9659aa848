"""Learnt operators on held-out rows, and their defined results for odd input."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybench.llm import language, quality_crf

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = language.remainder("doc_id", 4) == 2
    model = language.train(docs.where(~held))
    assert model.languages == ["de", "en", "es", "fr"]
    rows = language.predict(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_backs_off_to_shorter_grams(spark):
    train = spark.createDataFrame([(1, "katze hund katze hund", "de"), (2, "gatto cane gatto cane", "it"), (3, None, "it"), (4, "zzz", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    known = model.word(b"katze")
    assert known.argmax() == 0 and b"katze" in model.words
    assert model.word("katzen".encode()).argmax() == 0 and model.word(b"gattino").argmax() == 1
    assert not model.word("ж".encode()).any()  # nothing known: no evidence


def test_language_of_unbroken_texts(spark):
    draw = np.random.default_rng(8)
    signs, letters = [chr(0x4E00 + i) for i in range(60)] + ["\U00020000"], list("abcdefgh")
    unbroken = lambda: "".join(draw.choice(signs, 90))
    spaced = lambda: " ".join("".join(draw.choice(letters, draw.integers(2, 6))) for _ in range(40))
    rows = [(i, unbroken() if i % 2 else spaced(), "zh" if i % 2 else "xx") for i in range(200)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["xx", "zh"] and max(map(len, model.words)) <= 40
    assert "\U00020000" in model.grams and not any("\ud800" <= c <= "\udfff" for g in model.grams for c in g)
    held = [(i, unbroken() if i % 2 else spaced()) for i in range(60)]
    for r in language.predict(spark.createDataFrame(held, "doc_id long, text string"), model).collect():
        assert r.lang_pred == ("zh" if r.doc_id % 2 else "xx")


def test_language_odd_texts(docs, texts, nothing):
    model = language.train(docs)
    rows = language.predict(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id in (400, 401, 402, 405):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert all(r.lang_pred in ("aa", "bb", "und") for r in rows)
    blank = language.train(nothing)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, blank).collect()} == {("und", 0.0)}
    assert language.predict(nothing, model).count() == 0
    kept = language.identified(docs, model, least=0.0)
    assert kept.columns == docs.columns and kept.where("doc_id in (400, 401, 402, 405)").count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    held = language.remainder("doc_id", 5) == 0
    model = quality_crf.train(docs, labels.where(~held))
    rows = quality_crf.score(docs.where(held), model).join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97  # area under the curve
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_odd_texts(spark, docs, texts, nothing):
    labels = docs.select("doc_id", (F.length("text") % 2).cast("int").alias("quality"))
    model = quality_crf.train(docs, labels)
    rows = quality_crf.score(docs, model).collect()
    assert len(rows) == len(texts)
    assert {r.score for r in rows if r.doc_id in (400, 401, 402)} == {model.share}
    blank = quality_crf.train(docs, labels.limit(0))
    assert {r.score for r in quality_crf.score(docs, blank).collect()} == {0.5}
    one = quality_crf.train(docs, labels.withColumn("quality", F.lit(1)))
    assert all(r.score > 0.9 for r in quality_crf.score(docs, one).collect())
    assert quality_crf.score(nothing, model).count() == 0


def test_forward_backward_sums_over_all_labellings():
    draw = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 1, 1, 3])
    bins = draw.integers(0, quality_crf.BINS, (6, len(quality_crf._EDGES))).astype(np.uint8)
    weights, ties = draw.normal(size=quality_crf.WEIGHTS), draw.normal(size=(2, 2))
    chains, _ = quality_crf.Chains.of(doc, bins)
    good, pairs, z = chains.marginals(weights, ties)
    evidence = np.append(weights, 0.0)[chains.active].sum(axis=1)
    want, together = np.zeros(6), np.zeros((2, 2))
    for d in (0, 1, 3):
        own = np.flatnonzero(doc == d)
        total, part, both = 0.0, np.zeros(len(own)), np.zeros((2, 2))
        for code in range(2 ** len(own)):
            y = [(code >> i) & 1 for i in range(len(own))]
            mass = np.exp(sum(evidence[i] for i, v in zip(own, y) if v) + sum(ties[a, b] for a, b in zip(y, y[1:])))
            total += mass
            part += mass * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += mass
        want[own] = part / total
        together += both / total
    assert np.allclose(good, want) and np.allclose(pairs, together)


@pytest.mark.parametrize("lines", [0, 1, 40])
def test_quality_of_one_text(lines):
    model = quality_crf.Model(np.zeros(quality_crf.WEIGHTS), np.zeros((2, 2)), 1.0, 0.0, 0.25)
    doc = np.zeros(lines, int)
    got = model.quality(doc, np.ones(lines, int), np.zeros((lines, len(quality_crf._EDGES)), np.uint8), 2)
    assert got[1] == 0.25 and got[0] == pytest.approx(0.5 if lines else 0.25)
