"""Best-fit packing of token pieces by bin completion.

1. ``token_pieces``: whole texts are tokenised, one closing id is added, and texts longer
   than a sequence are cut into full pieces; only the first piece may be shorter.
2. ``complete_bins``: the number of pieces of each length (at most one count per length,
   however many pieces there are) is packed by branch and bound. Around the largest piece
   left, the undominated fillings of the rest of its sequence are made one by one, least
   waste first; one filling is first used for as many sequences as its lengths allow, later
   for fewer. A branch ends when its waste already rules out beating the incumbent, which
   starts as best-fit decreasing. Nothing else ends the search but ``nodes``, the number of
   fillings it looks at, dominated ones included; the incumbent is always whole.
3. ``packed``: pieces of one length are interchangeable, so the n-th piece of a length
   takes the n-th place that the plan has for it. The plan is broadcast: its size is
   bounded by the lengths there are, not by the data.

Null and empty texts are pieces that hold the closing id alone. Repeated rows are packed
once each. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..shipping import shipped
from .ranks import ranked
from .words import SPACE, SpanCache, blocks
from .workers import kept, tidy

CAPACITY = 1024
END_ID = 2
NODES = 2000
BATCH = 4096  # stretches in a call of the tokenizer

_HARD = SPACE.copy()
_HARD[[0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_POINT = np.isin(np.arange(256), np.frombuffer(b".,;:!?)", np.uint8))


def stretches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of stretches that a byte-level tokenizer treats on their own.

    A stretch ends before a single space or line break between two characters that are
    surely not white space (white space beyond ASCII starts with C2, E1, E2 or E3), and
    between a Latin letter and a point or comma. No pre-token of the tokenizer reaches over
    such a place, so ids of a text are the ids of its stretches, joined.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    if n > 2:
        mark = (data == 32) | (data == 10)
        at = np.flatnonzero(mark[1:-1]) + 1
        after, before = data[at + 1], data[at - 1]
        sure = ~_HARD[after] & ~SPACE[before] & ~((before >= 0x1C) & (before <= 0x1F))
        sure &= ~((after == 0xC2) & np.isin(data[np.minimum(at + 2, n - 1)], (0x85, 0xA0)))
        second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        sure &= ~((second == 0xC2) & np.isin(before, (0x85, 0xA0)))
        sure &= ~((before >= 0x80) & (second >= 0x80) & (third >= 0xE1) & (third <= 0xE3))
        sure &= ~cut[at] & ~cut[at + 1]
        cut[at[sure]] = True
        at = np.flatnonzero(_POINT[data[1:]]) + 1
        before, second = data[at - 1], data[np.maximum(at - 2, 0)]
        latin = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
        cut[at[(_LETTER[before] | latin) & (at > 1)]] = True
    bounds = np.flatnonzero(cut)
    return bounds[:-1], bounds[1:]


class Ids:
    """Ids of whole texts by a ``tokenizers`` file; each distinct stretch is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = SpanCache(self._encode, self._empty)
        self._empty()

    def _empty(self):
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encode(self, spans: list[bytes]) -> np.ndarray:
        found = []
        for at in range(0, len(spans), BATCH):
            texts = [s.decode() for s in spans[at: at + BATCH]]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int64)
        slots = np.arange(len(self.size), len(self.size) + len(size))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        return slots

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        whole = np.zeros(len(column), bool)
        for special in self.special:  # a special token's string may reach over stretches
            whole |= pc.fill_null(pc.match_substring(column, special), False).to_numpy(zero_copy_only=False)
        for block in blocks(column, words=False):
            begin, end = stretches(block.data, block.starts)
            slot = self.cache.lookup(block.data, begin, end)
            size = self.size[slot]
            total = np.concatenate([[0], np.cumsum(size)])
            place = np.arange(total[-1]) + np.repeat(self.first[slot] - total[:-1], size)
            ids = self.ids[place]
            bounds = total[np.searchsorted(begin, block.starts)]
            for i in range(block.texts):
                row = block.first + i
                yield self.whole(column[row].as_py()) if whole[row] else ids[bounds[i]: bounds[i + 1]]


def ids_of(path: str) -> Ids:
    """The tokenizer of this Python worker; what it has encoded serves its later tasks."""
    return kept("packing", path, lambda: Ids(path))


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 (little-endian 32-bit ids)."""
    kind = docs.schema[key].dataType.simpleString()

    @tidy("packing")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = ids_of(path)
        for batch in batches:
            rows, pieces = [], []
            for row, ids in enumerate(source.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start, size = 0, (len(ids) - 1) % capacity + 1
                number = 0
                while start < len(ids):
                    rows.append(row)
                    pieces.append((number, start, size, zlib.crc32(ids[start: start + size].tobytes())))
                    number, start, size = number + 1, start + size, capacity
            if rows:
                columns = np.array(pieces, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(columns[:, 0], pa.int32()), *(pa.array(columns[:, i]) for i in (1, 2, 3))],
                    [key, "piece", "start", "length", "ids_crc32"])

    return shipped(docs.select(key, text)).mapInArrow(cut, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def dominated(filling: tuple[int, ...], waste: int, spare: int) -> bool:
    """Whether pieces of ``filling`` could be grouped into the pieces of another filling.

    That is so if a spare size (a bit of ``spare``) can replace some of the pieces, or none,
    that are no longer than it together, and still fits; equal single pieces do not count.
    """
    single, several = 0, 0  # bits: lengths of one piece, of two and more pieces together
    for size in filling:
        several |= several << size | single << size
        single |= 1 << size
    if several & spare:
        return True
    shorter, reach = (1 | single | several) << 1, 1
    while reach < waste:
        more = min(reach, waste - reach)
        shorter, reach = shorter | shorter << more, reach + more
    return bool(waste and shorter & spare)


def fillings(counts: np.ndarray, room: int) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """All undominated fillings of ``room`` as (waste, lengths), least waste first.

    None stands for a filling that was looked at and is dominated. Longer pieces come
    first, so the first filling of all is never dominated. Nothing is made ahead.
    """
    sizes = [int(s) for s in np.flatnonzero(counts[: room + 1])[::-1]]
    most = [min(int(counts[s]), room // s) for s in sizes]
    reach, full = [1], (1 << room + 1) - 1  # reach[i], reversed here: bits of what sizes[i:] can fill
    for size, uses in zip(sizes[::-1], most[::-1]):
        bits, take = reach[-1], 1
        while uses:
            take = min(take, uses)
            bits |= bits << take * size & full
            uses, take = uses - take, take * 2
        reach.append(bits)
    reach.reverse()
    left_over = sum(1 << s for s in sizes)
    for waste in range(room + 1):
        stack = [(0, room - waste, ())] if reach[0] >> room - waste & 1 else []
        while stack:
            at, left, chosen = stack.pop()
            if left:
                size = sizes[at]
                for uses in range(min(most[at], left // size) + 1):
                    if reach[at + 1] >> left - uses * size & 1:
                        stack.append((at + 1, left - uses * size, chosen + (size,) * uses))
                continue
            spare = left_over
            for size in set(chosen):
                if chosen.count(size) == counts[size]:
                    spare ^= 1 << size
            yield None if dominated(chosen, waste, spare) else (waste, chosen)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts: (times, lengths) runs."""
    left = {capacity: []}  # room -> [times, lengths] of open sequences
    open_: dict[int, list[list]] = {}
    runs: list[list] = []
    for size in range(capacity, 0, -1):
        n = int(counts[size])
        while n:
            room = min((r for r in open_ if r >= size and open_[r]), default=None)
            if room is None:
                runs_new = [n // (capacity // size), (size,) * (capacity // size)]
                if runs_new[0]:
                    open_.setdefault(capacity - size * (capacity // size), []).append(runs_new)
                if rest := n % (capacity // size):
                    open_.setdefault(capacity - size * rest, []).append([1, (size,) * rest])
                n = 0
            else:
                times, lengths = open_[room].pop()
                fit = room // size
                full = min(times, n // fit)
                used = full * fit
                if full:
                    open_.setdefault(room - size * fit, []).append([full, lengths + (size,) * fit])
                if full < times and (rest := min(n - used, fit)) and n - used < fit:
                    open_.setdefault(room - size * rest, []).append([1, lengths + (size,) * rest])
                    used, full = used + rest, full + 1
                if full < times:
                    open_.setdefault(room, []).append([times - full, lengths])
                n -= used
    del left, runs
    return [(times, lengths) for found in open_.values() for times, lengths in found if times]


def complete_bins(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (times, lengths) that hold every counted piece, in few sequences."""
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    if not total:
        return []
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    most = sum(t for t, _ in best)

    def uses(counts: np.ndarray, filling: tuple[int, ...]) -> int:
        sizes, each = np.unique(filling, return_counts=True)
        return int((counts[sizes] // each).min())

    def children(counts: np.ndarray, spare: int) -> Iterator[tuple[int, tuple[int, ...]] | None]:
        """(times, lengths) around the largest piece: as often as can be, then less often."""
        largest = int(np.flatnonzero(counts)[-1])
        rest = counts.copy()
        rest[largest] -= 1
        for fewer in (False, True):
            for found in fillings(rest, capacity - largest):
                if found is None:
                    yield None
                    continue
                waste, lengths = found
                if waste > spare:  # even once is too much, as is all that follows
                    break
                filling = (largest, *lengths)
                often = uses(counts, filling)
                if fewer:
                    yield None  # looked at once more
                yield from ((times, filling) for times in (range(often - 1, 0, -1) if fewer else (often,)))

    # depth first: (counts left, runs so far, sequences so far, waste so far, untried fillings)
    allowed = lambda waste: (most - 1) * capacity - total - waste  # more waste can't be better
    stack = [(counts, [], 0, 0, children(counts, allowed(0)))] if most > least else []
    while stack and nodes > 0 and most > least:
        counts_, runs, used, waste, untried = stack[-1]
        child = next(untried, untried)
        if child is untried:
            stack.pop()
            continue
        nodes -= 1
        if child is None:
            continue
        times, filling = child
        waste_ = waste + times * (capacity - sum(filling))
        if allowed(waste_) < 0:
            continue
        rest, used_, runs_ = counts_.copy(), used + times, [*runs, child]
        sizes, each = np.unique(filling, return_counts=True)
        rest[sizes] -= times * each
        if not rest.any():
            if used_ < most:
                best, most = runs_, used_
            continue
        stack.append((rest, runs_, used_, waste_, children(rest, allowed(waste_))))
    return best


def packed(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to the rows of ``token_pieces``."""
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces.withColumn("_row", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # a row per length
        counts[length] = n
    places, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for times, lengths in complete_bins(counts, capacity, nodes):
        offset, at = 0, {}
        for size in lengths:
            at.setdefault(size, []).append(offset)
            offset += size
        for size, offsets in at.items():
            places.append((size, int(taken[size]), int(taken[size]) + times * len(offsets), sequence, offsets))
            taken[size] += times * len(offsets)
        sequence += times
    plan = spark.createDataFrame(places, T.StructType.fromDDL("size long, lo long, hi long, base long, offsets array<long>"))
    rank = F.col("_rank")
    local, uses = rank - F.col("lo"), F.size("offsets")
    rows = ranked(pieces, "length", "_row", "_rank", int(counts.sum()))
    return (rows.join(F.broadcast(plan), (F.col("length") == F.col("size")) & (rank >= F.col("lo")) & (rank < F.col("hi")))
            .withColumn("sequence_id", F.col("base") + F.floor(local / uses))
            .withColumn("offset", F.get("offsets", (local % uses).cast("int")))
            .drop("_row", "_rank", "size", "lo", "hi", "base", "offsets"))
