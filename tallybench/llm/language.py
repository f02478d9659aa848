"""Language identification: known words first, shorter and shorter n-grams for the rest.

``train`` counts the words of a bounded sample of labelled texts (about ``per_language`` rows
of each language, those with a small hash of their key) and keeps the log frequency of each word, and of
each character n-gram of 1 to ``longest`` letters inside ``<word>``, by language. ``predict``
scores every word of every whole text: a known word by its frequency in each language, an
unseen word by its longest n-grams that are known, falling back to shorter ones. The text
goes to the language with the largest sum; the score is its share after a softmax over the
mean per word, taken as ``EVIDENCE`` words at least.

Words are runs of letters in lower case. A run of more than ``KNOWN_LENGTH`` letters is not
kept as a word, but its n-grams count like any others: some scripts have no spaces. Null texts and texts without a letter get ``und``
with score 0, and so does every text if nothing was learnt. Ties go to the first language
in alphabetical order. Rows with a null language teach nothing. Repeated rows count as
often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import shipped
from .words import SpanCache, blocks
from .workers import tidy

UNKNOWN = "und"
PER_LANGUAGE = 3000   # labelled texts that teach, a language
KNOWN_WORDS = 20_000  # words kept, a language: the most frequent
KNOWN_LENGTH = 40     # letters of a kept word at most; n-grams come from all words
LONGEST = 4
EVIDENCE = 20


def letters(text: Column) -> Column:
    """The words of a text in lower case, joined by spaces."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " ")


@dataclass
class Model:
    languages: list[str]
    words: dict[bytes, int]    # row in the table of log frequencies by language
    grams: dict[str, int]
    table: np.ndarray

    def word(self, raw: bytes) -> np.ndarray:
        """The log frequency of a word in each language."""
        known = self.words.get(raw)
        if known is not None:
            return self.table[known]
        text = f"<{raw.decode()}>"
        for size in range(LONGEST, 0, -1):
            parts = [g for i in range(len(text) - size + 1) if (g := self.grams.get(text[i: i + size])) is not None]
            if parts:
                return self.table[parts].sum(axis=0, dtype=np.float32) / np.float32(size)
        return np.zeros(len(self.languages), np.float32)


def _log_frequency(rows: pa.Table, languages: list[str]) -> tuple[list, np.ndarray]:
    """Entries and log((count + 1/2) / (all of the language + 1/2 per entry)) from entry, lang, n."""
    entry, lang, n = (c.combine_chunks() for c in rows.columns)
    entry = entry.dictionary_encode()
    found = np.zeros((len(entry.dictionary), len(languages)))
    found[entry.indices.to_numpy(), pc.index_in(lang, pa.array(languages, lang.type)).to_numpy()] = n.to_numpy()
    if not len(found):
        return [], found.astype(np.float32)
    table, none = found + 0.5, found.sum(axis=0) == 0
    whole = table.sum(axis=0)
    whole[none] = whole.max()  # no entry of a language: no evidence for it
    return entry.dictionary.to_pylist(), np.log(table / whole).astype(np.float32)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, known_words: int = KNOWN_WORDS) -> Model:
    """Learn from the rows of ``docs``: all with a language and a text may teach."""
    taught = (docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
              .where(F.col("_lang").isNotNull() & F.col("_text").isNotNull()))
    share = [(r[0], min(1.0, per_language / r[1])) for r in taught.groupBy("_lang").count().collect()]  # a row a language
    if not share:
        return Model([], {}, {}, np.zeros((0, 0), np.float32))
    rate = F.create_map(*(F.lit(x) for pair in share for x in pair))[F.col("_lang")]
    sample = taught.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < rate * (1 << 30))
    words = (sample.select("_lang", F.explode(F.split(letters(F.col("_text")), " ")).alias("_word"))
             .where("_word <> ''").groupBy("_lang", "_word").agg(F.count("*").alias("_n")).persist())
    try:
        most = W.partitionBy("_lang").orderBy(F.desc("_n"), "_word")
        kept = words.where(F.length("_word") <= KNOWN_LENGTH).withColumn("_r", F.row_number().over(most)).where((F.col("_r") <= known_words) & (F.col("_n") > 1))
        marked = F.concat(F.lit("<"), F.col("_word"), F.lit(">"))
        grams = []
        for size in range(1, LONGEST + 1):
            each = F.regexp_extract_all(marked, F.lit(f"(?=(.{{{size}}}))."), F.lit(1))  # in time linear in the word
            grams.append(words.select("_lang", "_n", F.explode(each).alias("_gram")).where(~F.col("_gram").isin("<", ">"))
                         .groupBy("_gram", "_lang").agg(F.sum("_n").alias("_n")).where(F.col("_n") > 1).select("_gram", "_lang", "_n"))
        found = kept.select("_word", "_lang", "_n").toArrow()   # bounded: known_words a language
        languages = sorted({r[1] for r in words.select("_word", "_lang").groupBy("_lang").agg(F.min("_word")).select(F.lit(""), "_lang").collect()})
        entries, table = _log_frequency(found, languages)
        known = {w.encode(): i for i, w in enumerate(entries)}
        pieces: dict[str, int] = {}
        for rows in grams:  # bounded by the sample
            entries, more = _log_frequency(rows.toArrow(), languages)
            pieces |= {g: len(table) + i for i, g in enumerate(entries)}
            table = np.concatenate([table, more])
    finally:
        words.unpersist()
    return Model(languages, known, pieces, table)


class _Labels:
    """Labels of texts of words (``letters``) by a model; values of words are kept in the task."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)
        self.names = np.array([*model.languages, UNKNOWN], object)
        self.cache = SpanCache(self._make, self._empty)
        self._empty()

    def _empty(self) -> None:
        self.table = np.zeros((0, self.n), np.float32)

    def _make(self, spans: list[bytes]) -> np.ndarray:
        at = len(self.table)
        self.table = np.concatenate([self.table, np.array([self.model.word(s) for s in spans], np.float32).reshape(-1, self.n)])
        return np.arange(at, len(self.table))

    def of(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The language and the score of each text."""
        n, names, scores = self.n, [], []
        for block in blocks(texts):
            slot = self.cache.lookup(block.data, block.begin, block.end) if n else np.zeros(0, np.int64)
            total, count = np.zeros((block.texts, max(n, 1))), block.n_words
            filled = np.flatnonzero(count)
            if n and len(filled):
                total[filled] = np.add.reduceat(self.table[slot].astype(np.float64), block.word_starts[:-1][filled], axis=0)
            best = total.argmax(axis=1)
            mean = (total - total[np.arange(len(best)), best][:, None]) / np.maximum(count, 1)[:, None]
            share = 1 / np.exp(mean * np.minimum(count, EVIDENCE)[:, None]).sum(axis=1)
            some = (count > 0) & (n > 0)
            names += self.names[np.where(some, best, n)].tolist()
            scores.append(np.where(some, share, 0.0))
        return pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, lang_pred, score."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @tidy("language")
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *labels.of(batch.column(1))], [key, "lang_pred", "score"])

    rows = shipped(docs.select(key, letters(F.col(text)).alias("_letters")))
    return rows.mapInArrow(label, f"`{key}` {kind}, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the rows of unknown language or a score below ``least``.

    Only the words of a text go to Python; the row stays where it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy("language")
    def of_columns(columns):
        labels = _Labels(shared.value)
        for column in columns:
            yield pa.StructArray.from_arrays(labels.of(column), ["lang_pred", "score"])

    @F.arrow_udf("lang_pred string, score double")
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from of_columns(columns)

    packed = shipped(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_rest"), letters(F.col(text)).alias("_letters")))
    found = packed.select("_rest", label("_letters").alias("_found"))
    return found.where((F.col("_found.lang_pred") != UNKNOWN) & (F.col("_found.score") >= least)).select("_rest.*")


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: a fixed split into folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts
