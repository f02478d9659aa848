"""Whole-text ids, cuts, and packings that hold every piece once."""
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallybench.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
NASTY = ["", "  a b  ", "\n\n a\n b", "a  b c　 d  e", "it's  we'll\n\n\nx", "x \x1c y\x1f z", "a <|endoftext|> b", " lead", "tail ",
         "a\tb c\t\td", "é è  É\nß", " ", "\r\n a \r b", "– a – b ’s", " 's 'll", ".", "a.", "é,×,÷.a", "a.b.c,d ... e!?x", "漢 字。かな"]


def test_ids_of_stretches_are_ids_of_texts(texts):
    source = packing.Ids(PATH)
    cases = [t or "" for _, t in texts] + NASTY
    draw = random.Random(3)
    cases += ["".join(draw.choice("ab é\n.,' \t  1!?-") for _ in range(60)) for _ in range(300)]
    for text, ids in zip(cases, source.texts(pa.array(cases))):
        assert ids.tolist() == source.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_every_piece(seed):
    draw = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    counts[draw.integers(1, 101, 40)] = draw.integers(1, 200, 40)
    runs = packing.complete_bins(counts, 100, nodes=300)
    held = np.zeros(101, np.int64)
    for times, lengths in runs:
        assert sum(lengths) <= 100
        for size in lengths:
            held[size] += times
    assert (held == counts).all()
    assert sum(t for t, _ in runs) <= sum(t for t, _ in packing.best_fit(counts, 100))


def test_bins_reach_the_best_where_best_fit_does_not():
    counts = np.bincount([6, 5, 5, 4, 4, 3, 3], minlength=11)  # 30 in 3 sequences of 10
    assert sum(t for t, _ in packing.complete_bins(counts, 10)) == 3
    assert packing.complete_bins(np.zeros(11, int), 10) == []


def sequences(lengths, capacity, **kw):
    return sum(t for t, _ in packing.complete_bins(np.bincount(lengths, minlength=capacity + 1), capacity, **kw))


def test_all_fillings_without_waste_are_tried():
    lengths = [60, 55, 52, 38, 30, 21, 19, 15, 10]  # 60 21 19, 55 30 15, 52 38 10
    assert sum(t for t, _ in packing.best_fit(np.bincount(lengths, minlength=101), 100)) == 4
    assert sequences(lengths, 100) == 3


def test_pieces_of_length_one():
    assert packing.complete_bins(np.array([0, 5000] + [0] * 1023), 1024) == packing.best_fit(np.array([0, 5000] + [0] * 1023), 1024)
    assert sequences([1] * 5000, 1024) == 5 and list(packing.fillings(np.array([0, 5000] + [0] * 1023), 1024))[0] == (0, (1,) * 1024)


def test_only_empty_texts(spark):
    rows = packing.packed(packing.token_pieces(spark.createDataFrame([(i, None if i % 2 else "") for i in range(2500)], "doc_id long, text string"), PATH)).collect()
    assert sorted((r.sequence_id, r.offset) for r in rows) == [(i // 1024, i % 1024) for i in range(2500)]


def groups_into(pieces, places):
    """Whether the pieces can be grouped into the places, by trying all."""
    if not pieces:
        return True
    return any(p >= pieces[0] and groups_into(pieces[1:], places[:i] + (p - pieces[0],) + places[i + 1:]) for i, p in enumerate(places))


def test_fillings_are_the_undominated_ones():
    draw = random.Random(11)
    for _ in range(150):
        room = draw.randint(5, 24)
        lengths = [draw.randint(1, room) for _ in range(draw.randint(1, 7))]
        every = {tuple(sorted(c, reverse=True)) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if sum(c) <= room}
        want = {b for b in every if not any(a != b and groups_into(b, a) for a in every)}
        found = [f for f in packing.fillings(np.bincount(lengths, minlength=room + 1), room) if f]
        assert len(found) == len(want) and {c for _, c in found} == want
        assert [w for w, _ in found] == sorted(room - sum(c) for c in want)


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = [len(lengths)]

    def put(at, room):
        if len(room) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(room)
            return
        for i in range(len(room)):
            if room[i] >= lengths[at] and room[i] not in room[:i]:
                put(at + 1, room[:i] + [room[i] - lengths[at]] + room[i + 1:])
        put(at + 1, room + [capacity - lengths[at]])

    put(0, [])
    return best[0]


def test_search_without_budget_finds_the_least():
    draw = random.Random(12)
    for _ in range(60):
        lengths = sorted((draw.choice([3, 5, 7, 8, 9, 11, 13, 14]) for _ in range(draw.randint(4, 11))), reverse=True)
        assert sequences(lengths, 25, nodes=10**6) == fewest(lengths, 25)


def test_packed_rows(docs, texts, nothing):
    rows = packing.packed(packing.token_pieces(docs, PATH)).collect()
    source = packing.Ids(PATH)
    whole = {i: np.append(source.whole(t or ""), 2).astype("<u4") for i, t in texts if i is not None}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 103:  # 103 is there three times
            by_doc.setdefault(r.doc_id, []).append(r)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    for i, pieces in by_doc.items():
        at = 0
        for number, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (number, at) and r.ids_crc32 == zlib.crc32(whole[i][at: at + r.length].tobytes())
            assert r.length == 1024 or number == 0
            at += r.length
        assert at == len(whole[i])
    assert set(by_doc) == set(whole) - {103}
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.03 * -(-total // 1024) + 1
    assert packing.packed(packing.token_pieces(nothing, PATH)).count() == 0
