"""SentencePiece models run by the ``tokenizers`` library, checked against the original.

``parse`` reads the model protobuf (pieces with scores and kinds, kind of model, normaliser
flags); ``backend`` rebuilds it: normaliser, white space marker, unigram scores or the merges
that BPE scores imply, byte fallback, decoder. ``encode`` runs whole texts in batches, each
distinct stretch between white space once per worker, and compares every distinct stretch
with the original library (``parity``) and with its decoded form (``round_trip``).

A text is cut before a run of spaces that follows another character; pieces never reach over
such a place (checked when a model is loaded; else texts are not cut). The marker itself in
a text decodes to a space, so ``round_trip`` is false there, as with the original. Null
texts count as empty: no ids. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .words import SpanCache, blocks
from .workers import kept

MARK = "▁"
THREADS = 2    # of the encoder, beside the worker per core that Spark runs
BATCH = 4096   # stretches in a call of the encoder
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the format
UNIGRAM, BPE = 1, 2                                                # kinds of models in the format


@dataclass
class Parsed:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_go: bool = True


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = varint() if size is None else size
        yield tag >> 3, raw[at: at + size]
        at += size


def parse(raw: bytes) -> Parsed:
    out = Parsed()
    for number, value in fields(raw):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
            out.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            out.kind = dict(fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = {2: b"", 3: 1, 4: 1} | dict(fields(value))
            out.charsmap, out.dummy_prefix, out.extra_spaces_go = spec[2], bool(spec[3]), bool(spec[4])
    return out


def backend(model: Parsed, prefix: bool = True):
    """A ``tokenizers.Tokenizer`` with the ids of the model; ``prefix``: for whole texts."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    names = [p for p, _, _ in model.pieces]
    fallback = any(k == BYTE for _, _, k in model.pieces)
    unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
    if model.kind == BPE:
        vocab = {p: i for i, p in enumerate(names)}
        joins = {p: s for p, s, k in model.pieces if k in (NORMAL, USER)}
        merges = []
        for piece, score in joins.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in joins and piece[cut:] in joins:
                    merges.append((-score, vocab[piece], vocab[piece[:cut]], piece[:cut], piece[cut:]))
        merges = [m[3:] for m in sorted(merges)]
        core = models.BPE(vocab, merges, unk_token=names[unknown] if unknown is not None else None, fuse_unk=True, byte_fallback=fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if prefix and model.extra_spaces_go:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    plain = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*plain, decoders.Strip(" ", 1, 0)] if prefix and model.dummy_prefix else plain)
    return out


def can_be_cut(model: Parsed) -> bool:
    """No piece holds the marker after another character, and no text is rewritten first."""
    return not model.charsmap and not model.extra_spaces_go and model.dummy_prefix \
        and all(MARK not in p.lstrip(MARK) for p, _, k in model.pieces if k in (NORMAL, USER))


def stretches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut before each space after a character that is neither a space nor may be the marker."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1: len(data)] = (data[1:] == 32) & (data[:-1] != 32) & (data[:-1] != 0x81)
    cut[starts] = True
    bounds = np.flatnonzero(cut)
    return bounds[:-1], bounds[1:]


class Encoder:
    """Ids of whole texts, with parity and round trip, each distinct stretch made once."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            self.model = parse(file.read())
        self.cut = can_be_cut(self.model)
        self.tokenizer = backend(self.model, prefix=not self.cut)
        self.original = SentencePieceProcessor(model_file=path)
        self.cache = SpanCache(self._make, self._empty)
        self._empty()

    def _empty(self):
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.same, self.back = np.zeros(0, bool), np.zeros(0, bool)

    def _make(self, spans: list[bytes]) -> np.ndarray:
        return np.concatenate([self._batch([s.decode() for s in spans[at: at + BATCH]]) for at in range(0, len(spans), BATCH)])

    def _batch(self, texts: list[str]) -> np.ndarray:
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        # the original adds the first marker itself
        originals = self.original.encode([t[1:] for t in texts] if self.cut else texts)
        decoded = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        size = np.array([len(x) for x in found], np.int64)
        slots = np.arange(len(self.size), len(self.size) + len(size))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        self.same = np.concatenate([self.same, [a == b or t == " " for a, b, t in zip(found, originals, texts)]])
        self.back = np.concatenate([self.back, [a == b for a, b in zip(decoded, texts)]])
        return slots

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text; texts come with the dummy prefix as a space."""
        for block in blocks(column, words=False):
            begin, end = stretches(block.data, block.starts) if self.cut else (block.starts[:-1], block.starts[1:])
            if not self.cut:
                filled = end > begin
                begin, end = begin[filled], end[filled]
            slot = self.cache.lookup(block.data, begin, end)
            size = self.size[slot]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[slot] - total[:-1], size)]
            part = np.searchsorted(begin, block.starts)
            bad_same = np.concatenate([[0], np.cumsum(~self.same[slot])])
            bad_back = np.concatenate([[0], np.cumsum(~self.back[slot])])
            for a, b in zip(part[:-1], part[1:]):
                yield ids[total[a]: total[b]], bad_same[a] == bad_same[b], bad_back[a] == bad_back[b]


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker; what it has encoded serves its later tasks."""
    return kept("pieces", path, lambda: Encoder(path))


def _prefixed(path: str, text: str):
    """The text as ``Encoder.texts`` wants it: a space stands for the dummy prefix."""
    with open(path, "rb") as file:
        cut = can_be_cut(parse(file.read()))
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.when(whole != "", F.concat(F.lit(" "), whole)).otherwise("") if cut else whole


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per text: key, (ids,) n_ids, ids_crc32 (little-endian 32-bit), parity, round_trip."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(["ids"] if with_ids else []), "n_ids", "ids_crc32", "parity", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            found = list(encoder.texts(batch.column(1)))
            ids = [pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *ids, pa.array([len(x[0]) for x in found], pa.int64()),
                pa.array([zlib.crc32(x[0].astype("<u4").tobytes()) for x in found], pa.int64()),
                pa.array([bool(x[1]) for x in found]), pa.array([bool(x[2]) for x in found])], names)

    schema = f"{key} {kind}, " + ("ids array<int>, " if with_ids else "") + "n_ids long, ids_crc32 long, parity boolean, round_trip boolean"
    return shipped(docs.select(key, _prefixed(path, text).alias("_text"))).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Add the text of an array of ids, by the rebuilt decoder; null ids give a null text."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as file:
            tokenizer = backend(parse(file.read()))
        for batch in batches:
            lists = batch.column(columns.index(ids)).to_pylist()
            texts = iter(tokenizer.decode_batch([x for x in lists if x is not None], skip_special_tokens=False))
            out = pa.array([None if x is None else next(texts) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return shipped(rows).mapInArrow(run, f"{schema}, {name} string")
