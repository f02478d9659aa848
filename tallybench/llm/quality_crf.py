"""Quality of texts by a linear-chain conditional random field over their lines.

Every line with a word is good (1) or bad (0). Its evidence is a set of binned features of
the line itself and of the lines before and after it; neighbouring labels are tied by
transition weights. Forward-backward gives the probability that a line is good; the mean of
these, weighted by the words of the lines, becomes the score of the text after a logistic
calibration on the training texts.

``train`` fits on a bounded sample of labelled texts (about ``SAMPLE``, those with a small hash
of their key), the label of a text being that of its lines, by gradient steps on the driver.
``score`` covers every line of every whole text. Null, empty and wordless texts get the
share of label 1 in the sample; 0.5 if the sample is empty. Rows with a null label teach
nothing. Repeated rows get the same score; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .words import Block, blocks, repeated, span_hashes

SAMPLE = 4000
STEPS = 200
THRESHOLD = 0.3

_KINDS = {
    "symbols": np.frombuffer(b"#*$%&<>@^~=_{}[]\\/", np.uint8),
    "bars": np.frombuffer(b"|", np.uint8),
    "upper": np.arange(65, 91, dtype=np.uint8),
    "digits": np.arange(48, 58, dtype=np.uint8),
    "points": np.frombuffer(b".,;:!?", np.uint8),
    "beyond": np.arange(128, 256).astype(np.uint8),
}
#: Upper edges of the bins of each feature; shares are of the bytes or words of the line.
_EDGES = {
    "words": [2, 4, 8, 16, 32, 64, 128],
    "word_length": [2, 3, 4, 5, 6, 8, 12],
    **{k: [0.0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5] for k in _KINDS},
    "stutter": [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9],    # words equal to the word before
    "repeats": [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9],    # words in 3-word windows found again
    "copied": [0.0],                                       # the line occurs again in the text
}
BINS = 8
OWN = len(_EDGES) * BINS
WEIGHTS = 3 * OWN + 3  # own, before, after; bias, first line, last line


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each line with a word, its words, and its bin per feature."""
    data, n = block.data, len(block.data)
    ends = np.union1d(np.flatnonzero(data == 10), block.starts[1:])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if n:
        starts += (starts < n) & (data[np.minimum(starts, n - 1)] == 10)
    starts = np.minimum(starts, ends)
    first, last = np.searchsorted(block.begin, starts), np.searchsorted(block.begin, ends)
    some = last > first
    starts, ends, first, last = starts[some], ends[some], first[some], last[some]
    words, size = last - first, ends - starts
    doc = np.searchsorted(block.starts, starts, "right") - 1
    hashes = block.hashes()
    stutter = np.zeros(len(hashes) + 1, np.int64)
    stutter[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (block.doc[1:] == block.doc[:-1]))
    at, windows = block.window_hashes(hashes, 3)
    again = np.zeros(len(hashes) + 3, bool)
    twice = at[repeated(block.doc[at], windows) > 1]
    for k in range(3):
        again[twice + k] = True
    again = np.concatenate([[0], np.cumsum(again)])
    length = np.concatenate([[0], np.cumsum(block.end - block.begin)])
    values = {"words": words, "word_length": (length[last] - length[first]) / np.maximum(words, 1)}
    for kind, chars in _KINDS.items():
        flag = np.zeros(256, bool)
        flag[chars] = True
        total = np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])
        values[kind] = (total[ends] - total[starts]) / np.maximum(size, 1)
    values["stutter"] = (stutter[last] - stutter[first]) / np.maximum(words, 1)
    values["repeats"] = (again[last] - again[first]) / np.maximum(words, 1)
    values["copied"] = (repeated(doc, span_hashes(data, starts, ends)) > 1).astype(float)
    bins = np.stack([np.searchsorted(_EDGES[k], values[k]) for k in _EDGES], axis=1) if len(starts) else np.zeros((0, len(_EDGES)), int)
    return doc, words, bins.astype(np.uint8)


@dataclass
class Chains:
    """Lines of many texts; the texts are ordered by falling number of lines."""

    active: np.ndarray  # (rows of evidence weights) per line
    place: np.ndarray   # line of text i at step t is place[i] + t
    length: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, bins: np.ndarray) -> tuple[Chains, np.ndarray]:
        texts, place, length = np.unique(doc, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        own = bins.astype(np.int32) + BINS * np.arange(len(_EDGES), dtype=np.int32)
        first, last = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        first[place], last[place + length - 1] = True, True
        none = np.full((1, own.shape[1]), WEIGHTS, np.int32)
        before = np.where(first[:, None], WEIGHTS, np.concatenate([none, own[:-1] + OWN]) if len(own) else own)
        after = np.where(last[:, None], WEIGHTS, np.concatenate([own[1:] + 2 * OWN, none]) if len(own) else own)
        edge = np.stack([np.full(len(doc), 3 * OWN), np.where(first, 3 * OWN + 1, WEIGHTS), np.where(last, 3 * OWN + 2, WEIGHTS)], axis=1)
        return cls(np.concatenate([own, before, after, edge], axis=1).astype(np.int32), place[order], length[order]), texts[order]

    def steps(self) -> Iterator[tuple[int, int]]:
        """(step, texts that still have a line there)."""
        for t in range(int(self.length.max(initial=0))):
            yield t, int(np.searchsorted(-self.length, -t, "left"))

    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the expected label pairs, and log Z of each text."""
        evidence = np.append(weights, 0.0)[self.active].sum(axis=1)
        lines = len(evidence)
        forward, backward = np.zeros((lines, 2)), np.zeros((lines, 2))
        local = np.stack([np.zeros(lines), evidence], axis=1)
        for t, n in self.steps():
            at = self.place[:n] + t
            forward[at] = local[at]
            if t:
                forward[at] += np.logaddexp(forward[at - 1][:, :1] + ties[0], forward[at - 1][:, 1:] + ties[1])
        for t, n in reversed(list(self.steps())):
            m = int(np.searchsorted(-self.length, -(t + 1), "left"))  # those with a next line
            at = self.place[:m] + t
            ahead = local[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(ties[:, 0] + ahead[:, :1], ties[:, 1] + ahead[:, 1:])
        last = self.place + self.length - 1
        z = np.logaddexp(forward[last, 0], forward[last, 1])
        total = forward + backward
        good = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500)))
        inner = np.ones(lines, bool)
        inner[self.place] = False  # first lines have no pair
        at = np.flatnonzero(inner)
        pair = forward[at - 1][:, :, None] + ties + (local[at] + backward[at])[:, None, :]
        pair -= np.logaddexp(total[at, 0], total[at, 1])[:, None, None]
        return good, np.exp(pair).sum(axis=0), z


@dataclass
class Model:
    weights: np.ndarray
    ties: np.ndarray
    slope: float
    shift: float
    share: float

    def quality(self, doc: np.ndarray, words: np.ndarray, bins: np.ndarray, texts: int) -> np.ndarray:
        out = np.full(texts, self.share)
        if len(doc):
            chains, _ = Chains.of(doc, bins)
            good, _, _ = chains.marginals(self.weights, self.ties)
            some = np.flatnonzero(np.bincount(doc, minlength=texts))
            raw = np.bincount(doc, good * words, texts)[some] / np.bincount(doc, words, texts)[some]
            out[some] = 1 / (1 + np.exp(-np.clip(self.slope * logit(raw) + self.shift, -500, 500)))
        return out


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(doc: np.ndarray, words: np.ndarray, bins: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Model:
    """``label`` by text 0 .. ; every text is weighted alike. Adam on the penalised likelihood."""
    share = float(label.mean()) if len(label) else 0.5
    weights, ties = np.zeros(WEIGHTS), np.zeros((2, 2))
    model = Model(weights, ties, 1.0, 0.0, share)
    if not len(doc) or len(np.unique(label[np.unique(doc)])) < 2:
        return Model(weights, ties, 0.0, float(logit(np.array(share))), share)
    chains, texts = Chains.of(doc, bins)
    truth = label[doc].astype(float)
    inner = np.ones(len(doc), bool)
    inner[chains.place] = False
    pairs = np.zeros((2, 2))
    for y in (0, 1):
        pairs[y, y] = (inner & (truth == y)).sum()
    state = np.concatenate([weights, ties.ravel()])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        good, expected, _ = chains.marginals(state[:WEIGHTS], state[WEIGHTS:].reshape(2, 2))
        missed = np.bincount(chains.active.ravel(), np.repeat(truth - good, chains.active.shape[1]), WEIGHTS + 1)[:WEIGHTS]
        slope = np.concatenate([missed, (pairs - expected).ravel()]) / len(texts) - 1e-3 * state
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        state = state + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    weights, ties = state[:WEIGHTS], state[WEIGHTS:].reshape(2, 2)
    good, _, _ = chains.marginals(weights, ties)
    some = np.unique(doc)
    raw = logit(np.bincount(doc, good * words, len(label))[some] / np.bincount(doc, words, len(label))[some])
    a, b, y = 1.0, 0.0, label[some].astype(float)
    for _ in range(50):  # damped Newton steps of the logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -500, 500)))
        w = p * (1 - p)
        g = np.array([((y - p) * raw).sum() - 0.1 * (a - 1), (y - p).sum()])
        h = np.array([[(w * raw * raw).sum() + 0.1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) + 0.7 * np.linalg.solve(h, g)
    return Model(weights, ties, float(max(a, 1e-3)), float(b), share)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled texts, those with a small hash of their key."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label is not null")
    part = min(1.0, sample / max(marked.count(), 1))
    chosen = marked.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < part * (1 << 30)).groupBy("_key").agg(F.max("_label").alias("_label"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").select("_label", "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                doc, words, bins = line_features(block)
                bounds = np.searchsorted(doc, np.arange(block.texts + 1))
                parts = [(words[a:b].astype(np.int64).tobytes(), bins[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.texts), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], ["label", "words", "bins"])

    found = shipped(rows).mapInArrow(extract, "label int, words binary, bins binary").collect()  # bounded: the sample
    found.sort(key=lambda r: (r.label, bytes(r.words), bytes(r.bins)))
    words = [np.frombuffer(r.words, np.int64) for r in found]
    doc = np.repeat(np.arange(len(found)), [len(w) for w in words])
    bins = np.frombuffer(b"".join(bytes(r.bins) for r in found), np.uint8).reshape(-1, len(_EDGES))
    return fit(doc, np.concatenate([np.zeros(0, np.int64), *words]), bins, np.array([r.label for r in found], int))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per text: key, score (0 to 1), predicted (1 from ``threshold`` on)."""
    kind = docs.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = model.quality(*line_features(block), block.texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.texts), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return shipped(docs.select(key, text)).mapInArrow(apply, f"{key} {kind}, score double, predicted int")
