"""Ids of whole texts by a lower-casing word tokenizer of the ``tokenizers`` library.

Such a tokenizer drops white space and never joins what lies on both sides of certain places,
so a text is cut there, each distinct piece is encoded once (a bounded cache per Python worker
holds recent ones), and the ids of a text are those of its pieces, joined. Places: ASCII white
space; between a Latin letter and a following ASCII mark or digit; between an ASCII mark
other than the apostrophe and a following ASCII letter. Capital ASCII letters are made small
where nothing beyond ASCII follows, which could be combined with them. Pieces of small Latin
letters go to the library's model directly, others through its whole pipeline. Texts that
hold a special token's string, and all texts of other tokenizers, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TEXT_BYTES = 1 << 22   # of text cut at a time; a longer text is cut alone
CACHED = 1 << 18       # pieces remembered
BATCH = 4096

#: What the tokenizer file says if texts may be cut (fixed values of that file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER
_JOINS_NOT = _MARK.copy()
_JOINS_NOT[[39, *range(48, 58)]] = False
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _visible() -> dict[int, str]:
    """The character that stands for each byte: itself if printable, else one beyond 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def pieces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts (``starts`` in ``data``, one more for the end): the bytes of all pieces, where
    each begins in them (one more), and the first piece of each text (one more)."""
    n = len(data)
    capital = np.flatnonzero(_CAPITAL[data])
    after = data[np.minimum(capital + 1, n - 1)] if n else capital
    last = np.zeros(n + 1, bool)
    last[starts] = True
    capital = capital[(after < 128) | last[capital + 1]]
    data = data.copy()
    data[capital] += 32
    kept = ~_SPACE[data]
    cut = last[:n].copy()
    if n > 1:
        latin = np.zeros(n, bool)
        tail = data[1:]
        latin[1:] = (data[:-1] == 0xC3) & (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)
        latin |= _LETTER[data]
        cut[1:] |= ~kept[:-1] | (latin[:-1] & _MARK[tail]) | (_JOINS_NOT[data[:-1]] & _LETTER[tail])
    cut &= kept
    total = np.concatenate([[0], np.cumsum(kept)])
    begin = total[:-1][cut]
    piece = np.concatenate([[0], np.cumsum(cut)])[starts]
    return data[kept], np.append(begin, total[-1]), piece


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_piece = (config.get("normalizer") == NORMALIZER and (steps[0].get("pattern") or {}).get("Regex") == PATTERN
                         and config["model"].get("end_of_word_suffix") == SUFFIX)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.visible = _visible()
        self._empty()

    def _empty(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, new: list[bytes]) -> None:
        small = [_SMALL.fullmatch(p) is not None for p in new]
        others = [p.decode() for p, s in zip(new, small) if not s]
        rest = iter([e.ids for at in range(0, len(others), BATCH) for e in self.tokenizer.encode_batch_fast(others[at: at + BATCH], add_special_tokens=False)])
        tokenize, visible = self.model.tokenize, self.visible
        found = [[t.id for t in tokenize(p.decode("latin-1").translate(visible))] if s else next(rest) for p, s in zip(new, small)]
        size = np.array([len(f) for f in found], np.int64)
        self.slots.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.int32)])

    def _cut(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        raw, begin, piece = pieces(data[offsets[0]: offsets[-1]], offsets - offsets[0])
        found = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        words = found.dictionary.to_pylist()
        if len(self.slots) > CACHED:
            self._empty()
        new = [w for w in words if w not in self.slots]
        if new:
            self._learn(new)
        slots = self.slots
        slot = np.array([slots[w] for w in words], np.int64)[found.indices.to_numpy()] if words else np.zeros(0, np.int64)
        size = self.size[slot]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[slot] - total[:-1], size)]
        bounds = total[piece]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null texts have none."""
        column = column.fill_null("")
        apart = np.full(len(column), not self.by_piece)
        if self.by_piece:
            for special in self.special:
                apart |= pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(column):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            chunk = column.slice(first, last - first)
            if apart[first:last].all():
                yield from (self.whole(t.as_py()) for t in chunk)
            else:
                for row, ids in enumerate(self._cut(chunk)):
                    yield self.whole(chunk[row].as_py()) if apart[first + row] else ids
            first = last
