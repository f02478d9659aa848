"""Words and the rule ledger against plain Python."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallybench.llm import rules, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    grams = Counter(zip(found, found[1:], found[2:]))
    again = {i + k for i, g in enumerate(zip(found, found[1:], found[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(lines))


def test_words_of_blocks(texts):
    column = pa.array([t for _, t in texts])
    for limit in (1, 1000, 1 << 20):
        words.BLOCK_BYTES, before = limit, words.BLOCK_BYTES
        try:
            found = []
            for block in words.blocks(column.slice(3)):
                raw = block.data.tobytes()
                parts = [[] for _ in range(block.texts)]
                for d, b, e in zip(block.doc, block.begin, block.end):
                    parts[d].append(raw[b:e].decode())
                found += parts
        finally:
            words.BLOCK_BYTES = before
        assert found == [WORD.findall(t or "") for _, t in texts[3:]]


def test_window_hashes_follow_content():
    data = np.frombuffer(b"a b c a b c d", np.uint8)
    block = next(words.blocks(pa.array(["a b c a b c d", "a b c"])))
    at, hashes = block.window_hashes(block.hashes(), 3)
    assert at.tolist() == [0, 1, 2, 3, 4, 7] and len(data) == 13
    assert hashes[0] == hashes[3] == hashes[5] and len(set(hashes.tolist())) == 4


def test_ledger(docs, texts):
    got = sorted((tuple(r) for r in rules.ledger(docs).select("doc_id", *rules.MEASURES).collect()), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in texts), key=str)


def test_policies_and_ablations(docs, nothing):
    rows = rules.ledger(docs).cache()
    everything = [r.failed for r in rows.collect()]
    for mask in rules.POLICIES.values():
        assert rows.where(rules.passes(mask)).count() == sum(f & mask == 0 for f in everything)
    mask = rules.POLICIES["v2"]
    for r in rules.ablations(rows, mask).collect():
        bit = rules.BIT[r.rule]
        assert r.n_failed == sum(f & bit != 0 for f in everything)
        assert r.n_failed_alone == sum(f & mask == bit for f in everything)
        assert r.n_kept_without == sum(f & mask & ~bit == 0 for f in everything)
        assert r.n_kept == sum(f & mask == 0 for f in everything)
    assert rules.ledger(nothing).count() == 0
