"""Token ids of a corpus in files of checksummed, range-coded blocks.

Texts are dealt to files by ranges of their key, sorted inside each file, tokenised whole,
closed with an end id and written as one stream of ids in ascending key order. A file is:

    IDBLOCK1, vocabulary, ids of a full block
    blocks: ids, bytes, crc32 of the bytes, crc32 of the ids as little-endian 32-bit; the bytes
    directory: keys (64-bit), whether they are null (8-bit), ids of each document (64-bit)
    place and crc32 of the directory, documents, ids, IDBLOCK1

Blocks start from a reset model (``idcoder``) and cross documents, so any block can be read
alone. Numbers are little-endian. A file is written under a name of its attempt and then renamed, so
a repeated or doubled task leaves one whole file. Reading checks every checksum and raises
on damage.

Defined cases: null keys come first; rows of equal key follow in the order of their texts;
null texts are empty, that is the end id alone; an empty table has no files. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_folder
from ..shipping import shipped
from . import idcoder
from .wordids import WordIds
from .workers import kept, tidy

END_ID = 1
FILE_BYTES = 64 << 20   # of text in a file, about
LANES = 2048            # blocks coded in step
MAGIC = b"IDBLOCK1"
_HEAD, _BLOCK, _FOOT = struct.Struct("<8sII"), struct.Struct("<IIII"), struct.Struct("<QIQQ8s")


def opened(folder: str):
    """The file system of a folder's URI, and its path there."""
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "file:///", folder)
    folder = re.sub(r"^s3[an]:", "s3:", folder)
    return fs.FileSystem.from_uri(folder) if re.match(r"^\w[\w+.-]*:", folder) else (fs.LocalFileSystem(), folder)


class Writer:
    """Documents in ascending order into one open file."""

    def __init__(self, stream, vocabulary: int, block: int = idcoder.BLOCK_IDS, lanes: int = LANES):
        self.stream, self.vocabulary, self.block, self.lanes = stream, vocabulary, block, lanes
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.at = self.n_ids = 0
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self._put(_HEAD.pack(MAGIC, vocabulary, block))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.waiting.append(np.array(ids, np.int32))  # a copy: the rest of its batch can go
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.lanes * self.block:
            self._code(self.n_waiting // self.block * self.block)

    def _code(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        full = self.lanes * self.block
        for first in range(0, n, full):
            blocks = [ids[a: min(a + self.block, n)] for a in range(first, min(first + full, n), self.block)]
            for part, payload in zip(blocks, idcoder.encode(blocks, self.vocabulary)):
                self._put(_BLOCK.pack(len(part), len(payload), zlib.crc32(payload), zlib.crc32(part.astype("<u4").tobytes())))
                self._put(payload)
        self.waiting, self.n_waiting = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        if self.n_waiting:
            self._code(self.n_waiting)
        directory = b"".join([np.array([k or 0 for k in self.keys], "<i8").tobytes(), bytes(k is None for k in self.keys), np.array(self.lengths, "<i8").tobytes()])
        place = self.at
        self._put(directory)
        self._put(_FOOT.pack(place, zlib.crc32(directory), len(self.keys), self.n_ids, MAGIC))


def _found(fine: bool, what: str) -> None:
    if not fine:
        raise ValueError(f"damaged file of ids: {what}")


def directory(file) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of an open file: vocabulary, keys, whether they are null, lengths, end of the blocks."""
    size = file.size()
    _found(size >= _HEAD.size + _FOOT.size, "length")
    magic, vocabulary, _ = _HEAD.unpack(file.read_at(_HEAD.size, 0))
    place, check, n, n_ids, end = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
    _found(magic == end == MAGIC and place + 17 * n + _FOOT.size == size, "frame")
    raw = file.read_at(17 * n, place)
    _found(zlib.crc32(raw) == check, "directory")
    keys, none, lengths = np.frombuffer(raw[: 8 * n], "<i8"), np.frombuffer(raw[8 * n: 9 * n], np.int8), np.frombuffer(raw[9 * n:], "<i8")
    _found(int(lengths.sum()) == n_ids, "ids")
    return vocabulary, keys, none.astype(bool), lengths, place


def stream(file, vocabulary: int, end: int, lanes: int = LANES) -> Iterator[np.ndarray]:
    """The ids of an open file, some blocks at a time."""
    at = _HEAD.size
    while at < end:
        heads, payloads = [], []
        while at < end and len(heads) < lanes:
            head = _BLOCK.unpack(file.read_at(_BLOCK.size, at))
            _found(0 < head[0] <= 1 << idcoder.PLACE and at + _BLOCK.size + head[1] <= end, "block")
            payload = file.read_at(head[1], at + _BLOCK.size)
            _found(zlib.crc32(payload) == head[2], "bytes of a block")
            heads.append(head)
            payloads.append(payload)
            at += _BLOCK.size + head[1]
        found = idcoder.decode(payloads, [h[0] for h in heads], vocabulary)
        for head, ids in zip(heads, found):
            _found(zlib.crc32(ids.astype("<u4").tobytes()) == head[3], "ids of a block")
        yield np.concatenate(found)


def documents_of(file) -> Iterator[tuple[int | None, int, int, int]]:
    """(key, ids before it in the file, ids, crc32 of its ids) of each document."""
    vocabulary, keys, none, lengths, end = directory(file)
    ends = np.cumsum(lengths)
    row, done, check = 0, 0, 0
    for ids in stream(file, vocabulary, end):
        raw = memoryview(ids.astype("<u4").tobytes())
        first, last = done, done + len(ids)
        while row < len(ends) and ends[row] <= last:
            check = zlib.crc32(raw[4 * (done - first): 4 * (int(ends[row]) - first)], check)
            yield None if none[row] else int(keys[row]), int(ends[row] - lengths[row]), int(lengths[row]), check
            done, check, row = int(ends[row]), 0, row + 1
        check = zlib.crc32(raw[4 * (done - first):], check)
        done = last
    _found(row == len(ends), "documents")


def write(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of ``docs`` by the tokenizer file ``path``; a row per file: part, file, n_docs, n_ids."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
    parts = max(1, -(-((size[0] or 0) + 8 * size[1]) // file_bytes))

    @tidy("idfiles")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, place = opened(folder)
        writer = None
        name, draft = f"{place}/ids-{part:08d}", f"{place}/_ids-{part:08d}-{attempt}"
        for batch in batches:
            source = kept("idfiles", path, lambda: WordIds(path))
            if writer is None:
                system.create_dir(place, recursive=True)
                writer = Writer(system.open_output_stream(draft), source.vocabulary)
            for number, ids in zip(batch.column(0).to_pylist(), source.texts(batch.column(1))):
                writer.add(number, np.append(ids, np.int32(end_id)))
        if writer is not None:
            writer.close()
            writer.stream.close()
            system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"ids-{part:08d}"], "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    dealt = shipped(rows).repartitionByRange(parts, "_key").sortWithinPartitions("_key", "_text")
    return cut_lineage(dealt.mapInArrow(run, "part int, file string, n_docs long, n_ids long"))


def read(files: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: key, start (ids of all before it), n_tokens, ids_crc32."""
    group = F.col("part").cast("long") / 1024
    sums = files.groupBy(F.floor(group).alias("_group")).agg(F.sum("n_ids").alias("_n"))
    before = lambda order, *keys: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_group", F.coalesce(F.sum("_n").over(before("_group")), F.lit(0)).alias("_base"))  # a row per 1024 files
    inside = F.coalesce(F.sum("n_ids").over(before("part", "_group")), F.lit(0))
    placed = files.withColumn("_group", F.floor(group)).withColumn("_inside", inside).join(sums, "_group")
    placed = cut_lineage(placed.select("part", "file", (F.col("_base") + F.col("_inside")).alias("first")))

    @tidy("idfiles reader")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = opened(folder)
        names = [key, "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for file, first in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with system.open_input_file(f"{place}/{file}") as opened_file:
                    rows: list[tuple] = []
                    for number, before_it, n, check in documents_of(opened_file):
                        rows.append((number, first + before_it, n, check))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    each = shipped(placed).repartitionByRange(max(placed.count(), 1), "part")
    return each.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to a folder of their own and read them back."""
    folder = scratch_folder(docs.sparkSession, "ids")
    return read(write(docs, path, folder, key, text), folder, key)
