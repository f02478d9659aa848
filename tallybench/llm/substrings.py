"""Removal of long passages that an earlier document holds, by suffix automata.

A window is ``WINDOW`` consecutive words of one document; its words are removed if the same
sequence also starts in a document with a smaller id.

1. Anchors. The least hash of the word groups inside a window is its anchor. Windows with
   one anchor in a row make a stretch, and equal windows always have equal anchors, so only
   documents that share an anchor can share a window.
2. Stretches that are equal are streamed once, for the smallest id; the others are covered
   by it. Where an anchor has several stretches, their windows are counted by hash, and each
   stretch is trimmed to the runs of windows that occur in more than one document.
3. Automata. The trimmed runs are dealt to reference shards by anchor. A shard builds the
   suffix automaton of its runs in the order of their ids, each state knowing the smallest
   id that reaches it, and every run streams through the automaton of the runs before it:
   where the matching statistic reaches the window and the state's id is smaller, the
   window is covered.
4. Covered windows become maximal spans, which are cut out of the whole texts.

References and the documents that stream through them are brought together by the anchor
instead of sending all automata everywhere, as references grow with the corpus. Words are
compared as 64-bit hashes, stretches as pairs of them.

Null and empty texts have no words; texts with fewer words than a window lose none. Rows that
share an id never cover each other. Rows that share id and text get the same result. Other
columns are not read, or kept as they are by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..shipping import shipped
from .groups import among, join_groups
from .words import _BASE, _BASE_INVERSE, blocks, mix, powers, window_hashes
from .workers import tidy

WINDOW = 50
GRAM = 8              # words of an anchor
SHARD_WORDS = 50_000  # of reference runs in an automaton, about


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done:]) if width > done else values


def stretches(hashes: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first word, windows) of each stretch; windows stay in a text."""
    n = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none
    gram = min(GRAM, window)
    scaled = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(_BASE, len(hashes)))])
    grams = mix((scaled[gram:] - scaled[:-gram]) * powers(_BASE_INVERSE, len(hashes) - gram + 1))
    anchor = _least(grams, window - gram + 1)
    at = np.flatnonzero(doc[:n] == doc[window - 1:])
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    content = (scaled[start + count + window - 1] - scaled[start]) * powers(_BASE_INVERSE, len(hashes))[start]
    return anchor[start], mix(content + mix(count.astype(np.uint64))), start, count


_SEGMENT = "_id {kind}, _print long, h long, s long, start long, n long"


def anchored(rows: DataFrame, window: int) -> DataFrame:
    """A row per stretch of every text (_id, _print, _text)."""
    kind = rows.schema["_id"].dataType.simpleString()

    @tidy("substrings")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                h, s, start, n = stretches(block.hashes(), block.doc, window)
                doc = block.doc[start]
                at = pa.array(block.first + doc)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)),
                                                  pa.array(start - block.word_starts[doc]), pa.array(n)], ["_id", "_print", "h", "s", "start", "n"])

    return shipped(rows).mapInArrow(run, _SEGMENT.format(kind=kind))


def with_words(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The wanted stretches (_id, _print, h, start, n) with the hashes of their words."""
    kind = rows.schema["_id"].dataType.simpleString()
    lists = wanted.groupBy("_id", "_print").agg(F.collect_list(F.struct("h", "start", "n")).alias("_parts"))  # those of one text
    joined = among(rows, lists, ["_id", "_print"]).where("_maybe").join(lists, ["_id", "_print"]).select("_id", "_print", "_text", "_parts")

    @tidy("substrings")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                part = batch.slice(block.first, block.texts)
                lists = part.column(3)
                size = np.diff(np.array(lists.offsets))
                h, start, n = (np.array(lists.flatten().field(i)) for i in range(3))
                row = np.repeat(np.arange(block.texts), size)
                length = n + window - 1
                offsets = np.concatenate([[0], np.cumsum(length)])
                words = block.hashes()[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - block.word_starts[row] - start, length)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(h), pa.array(start), pa.array(n),
                                                  pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words.view(np.int64)))],
                                                 ["_id", "_print", "h", "start", "n", "words"])

    return shipped(joined).mapInArrow(run, f"_id {kind}, _print long, h long, start long, n long, words array<long>")


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.array(column.offsets, np.int64)
    return np.array(column.flatten()).view(np.uint64), offsets - offsets[0]


def windows_of(segments: DataFrame, window: int) -> DataFrame:
    """(w, _seg, _id, off): the hash of every window of the stretches."""
    kind = segments.schema["_id"].dataType.simpleString()

    @tidy("substrings")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = _words(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at, w = window_hashes(words, row, window)
            row = row[at]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at - offsets[row])], ["w", "_seg", "_id", "off"])

    return shipped(segments.select("_seg", "_id", "words")).mapInArrow(run, f"w long, _seg long, _id {kind}, off long")


def trimmed(segments: DataFrame, window: int) -> DataFrame:
    """Runs of windows in a row (``offs`` of the stretch): _id, _print, h, start, n, words, p."""
    kind = segments.schema["_id"].dataType.simpleString()
    names = ["_id", "_print", "h", "start", "n", "words", "p"]

    @tidy("substrings")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = _words(batch.column(4))
            offs, bounds = _words(batch.column(5))
            offs = offs.view(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            new = np.ones(len(offs), bool)
            new[1:] = (row[1:] != row[:-1]) | (offs[1:] != offs[:-1] + 1)
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(offs)))
            row, off = row[head], offs[head]
            length = n + window - 1
            ends = np.concatenate([[0], np.cumsum(length)])
            place = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[row] - off, length)
            mine = words[place]
            scaled = np.concatenate([[np.uint64(0)], np.cumsum(mine * powers(_BASE, len(mine)))])
            p = mix((scaled[ends[1:]] - scaled[ends[:-1]]) * powers(_BASE_INVERSE, len(mine) + 1)[ends[:-1]] + mix(n.astype(np.uint64)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                                              pa.array(np.array(batch.column(3))[row] + off), pa.array(n),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mine.view(np.int64))), pa.array(p.view(np.int64))], names)

    return shipped(segments.select("_id", "_print", "h", "start", "words", "offs")).mapInArrow(run, f"_id {kind}, _print long, h long, start long, n long, words array<long>, p long")


class Automaton:
    """The suffix automaton of word sequences that are added in the order of their ids.

    ``first`` is the id under which a state came to be; a copy of a state keeps it. As ids
    only grow, it is the smallest id that holds the state's sequences.
    """

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def add(self, words: list[int], owner) -> None:
        nexts, link, length, first = self.next, self.link, self.length, self.first

        def copied(p: int, q: int, word: int) -> int:
            new = len(nexts)
            nexts.append(dict(nexts[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            first.append(first[q])
            link[q] = new
            while p >= 0 and nexts[p].get(word) == q:
                nexts[p][word] = new
                p = link[p]
            return new

        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if length[q] == length[last] + 1 else copied(last, q, word)
                continue
            now = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(owner)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = now
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[now] = q if length[q] == length[p] + 1 else copied(p, q, word)
            last = now

    def covered(self, words: list[int], owner, window: int) -> list[int]:
        """First words of the windows that a sequence of a smaller id holds."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        found = []
        state = matched = 0
        for at, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(word)
            if to is not None:
                state, matched = to, matched + 1
            if matched >= window:
                while length[link[state]] >= window:  # the state of the last ``window`` words
                    state = link[state]
                    matched = length[state]
                if first[state] < owner:
                    found.append(at - window + 1)
        return found


def streamed(runs: DataFrame, window: int) -> DataFrame:
    """(h, p, start, n): spans of covered windows inside distinct runs (h, p, first, words)."""
    total = runs.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(16, -(-total // SHARD_WORDS))
    schema = pa.schema([("h", pa.int64()), ("p", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        automaton = Automaton()
        out: list[tuple[int, int, int, int]] = []
        order = sorted(range(table.num_rows), key=list(zip(table["first"].to_pylist(), table["p"].to_pylist())).__getitem__)
        h, p, first = (table[c].to_pylist() for c in ("h", "p", "first"))
        words = table["words"].combine_chunks()
        for i in order:
            sequence = words[i].as_py()
            begin = None
            for at in [*automaton.covered(sequence, first[i], window), None]:
                if begin is not None and at == end:  # noqa: F821
                    end += 1
                    continue
                if begin is not None:
                    out.append((h[i], p[i], begin, end - begin))
                if at is not None:
                    begin, end = at, at + 1
            automaton.add(sequence, first[i])
        columns = np.array(out, np.int64).reshape(-1, 4)
        return pa.Table.from_arrays([pa.array(columns[:, i]) for i in range(4)], schema=schema)

    dealt = shipped(runs).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "h long, p long, start long, n long")


def covered_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _print, start, n): spans of covered windows of the texts (_id, _print, _text)."""
    found = anchored(rows, window)  # made twice: less than writing it down
    anchors = found.groupBy("h").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_size")).where("_low < _high")
    anchors = cut_lineage(anchors.select("h", "_size"))
    total = anchors.agg(F.sum("_size")).first()[0] or 1
    shared = cut_lineage(join_groups(found, anchors, ["h"], total))
    kinds = shared.groupBy("s", "h").agg(F.min("_id").alias("first"), F.count("*").alias("_copies"))
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.count("*").alias("_size"))
    kinds = join_groups(kinds, several, ["h"], total).withColumnRenamed("_copies", "_size")
    placed = cut_lineage(join_groups(shared, kinds, ["s", "h"], total))
    span = ["_id", "_print", "start", "n"]
    direct = placed.where(F.col("_id") > F.col("first")).select(*span)
    wanted = placed.where((F.col("_id") == F.col("first")) & (F.col("kinds") > 1)).select("_id", "_print", "h", "start", "n")

    segments = cut_lineage(with_words(rows, wanted.distinct(), window).withColumn("_seg", F.monotonically_increasing_id()))
    windows = windows_of(segments, window)
    again = windows.groupBy("w").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.count("*").alias("_size")).where("_low < _high")
    again = cut_lineage(again.select("w", "_size"))
    n_windows = again.agg(F.sum("_size")).first()[0] or 1
    offs = join_groups(windows.drop("_id"), again, ["w"], n_windows).groupBy("_seg").agg(F.array_sort(F.collect_set("off")).alias("offs"))  # those of one stretch
    runs = cut_lineage(trimmed(segments.join(offs, "_seg"), window))
    n_runs = max(runs.count(), 1)
    same = runs.groupBy("p", "h").agg(F.min("_id").alias("first"), F.count("*").alias("_size"))
    runs = cut_lineage(join_groups(runs, same, ["p", "h"], n_runs))
    copies = runs.where(F.col("_id") > F.col("first")).select(*span)
    heads = runs.where(F.col("_id") == F.col("first"))
    spans = streamed(heads.select("h", "p", "first", "words").dropDuplicates(["h", "p"]), window)
    spans = spans.select("h", "p", F.col("start").alias("_from"), F.col("n").alias("_count"))
    first = heads.join(spans, ["h", "p"]).select("_id", "_print", (F.col("start") + F.col("_from")).alias("start"), F.col("_count").alias("n"))
    return direct.unionByName(copies).unionByName(first)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_id"), F.xxhash64(whole).alias("_print"), whole.alias("_text"))


def _marked(rows: DataFrame, window: int) -> DataFrame:
    """Rows with ``_spans``: the covered windows of their text."""
    spans = covered_windows(rows.select("_id", "_print", "_text"), window).where(F.col("_id").isNotNull())
    spans = cut_lineage(spans.groupBy("_id", "_print").agg(F.collect_list(F.struct("start", "n")).alias("_spans")))  # those of one text
    marked = among(rows, spans, ["_id", "_print"])
    joined = marked.where("_maybe").join(spans, ["_id", "_print"], "left")
    return joined.unionByName(marked.where("not _maybe").withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType))).drop("_maybe")


def _gone(spans: pa.Array, block, window: int) -> np.ndarray:
    """Flags of the words of a block that covered windows hold."""
    size = np.diff(np.array(spans.offsets))
    start, n = (np.array(spans.flatten().field(i)) for i in range(2))
    begin = block.word_starts[np.repeat(np.arange(block.texts), size)] + start
    change = np.zeros(len(block.begin) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + n + window - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _filled(spans: pa.Array) -> pa.Array:
    empty = pa.array([[]], spans.type)
    return pa.concat_arrays([spans, empty]).fill_null(empty[0])[: len(spans)] if spans.null_count else spans


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: key, n_words, n_removed, kept_sha256 of the kept words."""
    kind = docs.schema[key].dataType.simpleString()
    marked = _marked(_rows(docs, key, text), window)

    @tidy("substrings")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _filled(batch.column(2))
            for block in blocks(batch.column(1)):
                gone = _gone(spans.slice(block.first, block.texts), block, window)
                raw, bounds = block.data.tobytes(), block.word_starts
                digests = []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    kept = a + np.flatnonzero(~gone[a:b])
                    digests.append(hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(block.begin[kept].tolist(), block.end[kept].tolist())])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.texts), pa.array(block.n_words, pa.int64()),
                                                  pa.array(np.bincount(block.doc[gone], minlength=block.texts), pa.int64()), pa.array(digests)],
                                                 [key, "n_words", "n_removed", "kept_sha256"])

    return shipped(marked.select("_id", "_text", "_spans")).mapInArrow(run, f"{key} {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the covered words cut out of their texts, each with the white space
    after it. Texts that lose no word stay as they are; a text that loses all is empty."""
    others = [c for c in docs.columns if c not in (key, text)]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(whole).alias("_print"), F.col(text).alias("_text"), F.struct(F.lit(1).alias("_one"), *(F.col(c) for c in others)).alias("_rest"))
    marked = _marked(rows, window).select("_id", "_rest", "_text", "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields if f.name != "_spans")

    @tidy("substrings")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _filled(batch.column(3))
            texts = []
            for block in blocks(batch.column(2)):
                gone = _gone(spans.slice(block.first, block.texts), block, window)
                raw, bounds = block.data.tobytes(), block.word_starts
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    if not gone[a:b].any():
                        texts.append(batch.column(2)[block.first + i].as_py())
                        continue
                    start, end = int(block.starts[i]), int(block.starts[i + 1])
                    begins = np.append(block.begin[a:b], end)
                    flags = np.concatenate([[False], gone[a:b]])  # the white space before the first word stays
                    begins = np.concatenate([[start], begins])
                    texts.append(b"".join(raw[x:y] for x, y, g in zip(begins[:-1].tolist(), begins[1:].tolist(), flags.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["_id", "_rest", "_text"])

    out = shipped(marked).mapInArrow(run, schema)
    named = {key: F.col("_id"), text: F.col("_text")} | {c: F.col("_rest").getField(c) for c in others}
    return out.select(*(named[c].alias(c) for c in docs.columns))
