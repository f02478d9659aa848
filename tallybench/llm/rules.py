"""Quality rules as a ledger: every rule once per text, its failure kept as one bit.

``ledger`` measures whole texts and stores the measurements beside a bitmask ``failed``
(bit i set: rule i failed). Policies are versioned masks over these bits, so a new policy
or an ablation reads the ledger only, never the texts again.

Null text, empty text and text without words: all counts are 0, every rule with a share
passes (a share of nothing is 0), the base rules fail by ``n_words``. Repeated rows give
repeated ledger rows. Columns of the input other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .words import Block, blocks, repeated, span_hashes

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_PLAIN = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _share(part: str, whole: str, percent: int) -> Column:
    return F.col(part) * 100 > F.col(whole) * percent


#: Name of each rule and when it FAILS; the place in this list is the bit. Append only.
RULES: list[tuple[str, Column | None]] = [
    ("few_words", lambda: F.col("n_words") < 50),
    ("repeated_words", lambda: _share("n_repeat_words", "n_words", 50)),
    ("symbols", lambda: _share("n_symbols", "n_words", 25)),
    ("duplicate_lines", lambda: _share("n_dup_lines", "n_lines", 50)),
    ("long_words", lambda: F.col("word_chars") > 12 * F.col("n_words")),
    ("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Versioned policies: a text is kept if it fails none of the rules in the mask.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"],
    "v2": BASE | BIT["symbols"] | BIT["duplicate_lines"] | BIT["long_words"] | BIT["short_words"],
}


def measure(block: Block) -> dict[str, np.ndarray]:
    """The measurements of each text of a block."""
    n = block.texts
    hashes = block.hashes()
    at, windows = block.window_hashes(hashes, 3)
    twice = at[repeated(block.doc[at], windows) > 1]
    again = np.zeros(len(hashes), bool)
    for k in range(3):
        again[twice + k] = True
    # lines: between breaks, cut at the ends of texts as well; only lines with a word count
    ends = np.union1d(np.flatnonzero(block.data == 10), block.starts[1:])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    starts += (starts < len(block.data)) & (block.data[np.minimum(starts, max(len(block.data) - 1, 0))] == 10) if len(block.data) else 0
    starts = np.minimum(starts, ends)
    words_in = np.searchsorted(block.begin, ends) > np.searchsorted(block.begin, starts)
    starts, ends = starts[words_in], ends[words_in]
    line_doc = np.searchsorted(block.starts, starts, "right") - 1
    line_hash = span_hashes(block.data, starts, ends)
    n_lines = np.bincount(line_doc, minlength=n)
    distinct = np.unique(np.stack([line_doc.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64) if len(starts) else line_doc
    inside = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(inside, block.begin, 1)
    np.add.at(inside, block.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    return {
        "n_words": block.n_words,
        "word_chars": block.per_text(inside & _PLAIN[block.data]),
        "n_symbols": block.per_text(_SYMBOLS[block.data]),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=n),
        "n_repeat_words": np.bincount(block.doc[again], minlength=n),
        "n_lines": n_lines,
    }


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: key, measurements, ``failed`` (bits of the failed rules)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = measure(block)
                keys = batch.column(0).slice(block.first, block.texts)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(found[m], pa.int64()) for m in MEASURES)], [key, *MEASURES])

    rows = shipped(docs.select(key, text))
    rows = rows.mapInArrow(measured, f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(fails(), F.lit(BIT[name])).otherwise(0) for name, fails in RULES), F.lit(0))
    return rows.withColumn("failed", bits.cast("long"))


def passes(mask: int) -> Column:
    """Kept under a policy: no failed rule is in the mask."""
    return F.col("failed").bitwiseAND(mask) == 0


def ablations(rows: DataFrame, mask: int) -> DataFrame:
    """Per rule of the policy: how many texts fail it, fail it alone (would come back
    without it), and are kept by the policy and without the rule. One pass over bits."""
    failed = F.col("failed").bitwiseAND(mask)
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask))
    counts = rows.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return (counts.select("bits", "n", F.explode(each).alias("r")).groupBy("r.rule").agg(
        count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("n_kept_without")))
