"""Word boundaries and 64-bit word hashes of whole texts, straight from Arrow buffers.

Everything works on a ``Block``: some rows of one Arrow batch, cut so that a block holds
about ``BLOCK_BYTES`` of text (one longer text makes a block of its own). Words are
maximal runs of bytes other than space and 0x09-0x0D. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
KEPT_POWERS = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed, up to a bound."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if len(table) <= KEPT_POWERS:  # those of a longer text go with it
            _tables[int(base)] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending and do not overlap."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values = _CODES[data[np.repeat(start, size) + place]] * powers(_BASE, int(size.max()) + 1)[place]
    some = size > 0
    out[some] = np.add.reduceat(values, first[some])
    return mix(out ^ size.astype(np.uint64))


@dataclass
class Block:
    """Rows ``first`` to ``last`` of a batch: bytes, text bounds, and their words."""

    first: int
    last: int
    data: np.ndarray      # the bytes of the texts, joined
    starts: np.ndarray    # of texts in data; one more entry for the end
    begin: np.ndarray     # of words in data
    end: np.ndarray
    doc: np.ndarray       # the text (0 ..) of each word

    @property
    def texts(self) -> int:
        return self.last - self.first

    @property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)

    @property
    def word_starts(self) -> np.ndarray:
        """The first word of each text; one more entry for the end."""
        return np.concatenate([[0], np.cumsum(self.n_words)])

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.begin, self.end)

    def window_hashes(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of ``size`` words inside one text, and their hashes."""
        return window_hashes(hashes, self.doc, size)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def window_hashes(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    scaled = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(_BASE, len(hashes)))])
    window = (scaled[size:] - scaled[:-size]) * powers(_BASE_INVERSE, n)
    at = np.flatnonzero(doc[: n] == doc[size - 1:])
    return at, mix(window[at])


def find_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every word."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = np.flatnonzero(starts[1:] > starts[:-1])
        begins[starts[filled]] = inside[starts[filled]]
        ends[starts[filled + 1] - 1] = inside[starts[filled + 1] - 1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(starts, begin, "right") - 1


def blocks(texts: pa.Array, table: np.ndarray = SAME, words: bool = True) -> Iterator[Block]:
    """Cut a text column into blocks; ``table`` maps each byte (LOWER: A-Z in lower case)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        part = table[data[offsets[first]: offsets[last]]]
        starts = offsets[first: last + 1] - offsets[first]
        found = find_words(part, starts) if words else (np.zeros(0, np.int64),) * 3
        yield Block(first, last, part, starts, *found)
        first = last


def repeated(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How often the hash of each item occurs in its own text."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    key = mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1)))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse]


class SpanCache:
    """Values of byte spans by hash, made once per distinct span and Python worker.

    ``make`` gets a list of spans and returns as many slots (whole numbers by which the
    caller finds its values). Beyond ``limit`` distinct spans the cache starts anew, so its
    memory is bounded; ``reset`` is called then.
    """

    def __init__(self, make, reset, limit: int = 1 << 20):
        self.make, self.reset, self.limit = make, reset, limit
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def lookup(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slot of each span."""
        if len(self.keys) > self.limit:
            self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.reset()
        unique, first, inverse = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        hit = np.zeros(len(unique), bool)
        inner = at < len(self.keys)
        hit[inner] = self.keys[at[inner]] == unique[inner]
        slots = np.empty(len(unique), np.int64)
        slots[hit] = self.slots[at[hit]]
        missed = np.flatnonzero(~hit)
        if len(missed):
            raw = data.tobytes()
            spans = [raw[b:e] for b, e in zip(begin[first[missed]].tolist(), end[first[missed]].tolist())]
            slots[missed] = made = self.make(spans)
            self.keys = np.insert(self.keys, at[missed], unique[missed])
            self.slots = np.insert(self.slots, at[missed], made)
        return slots[inverse]
