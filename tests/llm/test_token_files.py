"""Token files: ids against the library, coder round trips, damage, retries."""
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tallybench.llm import idcoder, idfiles, wordids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def source():
    return wordids.WordIds(PATH)


def library_ids(source, text):
    return source.tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(source, rows):
    out, start = [], 0
    for key, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*library_ids(source, text), 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted(rows, key=lambda r: r[1])


def test_files_of_all_kinds_of_texts(docs, texts, source, tmp_path):
    got = [tuple(r) for r in idfiles.stored(docs, PATH).collect()]
    assert order(got) == expected(source, texts)
    files = idfiles.write(docs, PATH, str(tmp_path / "many"), file_bytes=20_000)
    assert files.count() > 5
    assert order(map(tuple, idfiles.read(files, f"file://{tmp_path}/many").collect())) == expected(source, texts)


def test_no_rows(nothing):
    out = idfiles.stored(nothing, PATH)
    assert out.collect() == [] and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


ODD = st.text(st.sampled_from("aAzZéÉßǰJ̌́'sStTrRe7½.,!<=>|̸‍  \x1c\x85 \n\tΣς漢字\U0001d11e"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=20), st.sampled_from(["<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "don't 'TIS we'll", "J̌J̌"])), min_size=1, max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    source = _source()
    found = list(source.texts(pa.array(texts)))
    assert [f.tolist() for f in found] == [library_ids(source, t) for t in texts]


_kept = []


def _source():
    if not _kept:
        _kept.append(wordids.WordIds(PATH))
    return _kept[0]


def test_other_tokenizers_encode_whole_texts():
    source = wordids.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not source.by_piece
    texts = ["A b  c.", "", None, "é\n\n"]
    assert [f.tolist() for f in source.texts(pa.array(texts))] == [library_ids(source, t) for t in texts]


def test_the_cache_is_bounded(monkeypatch, source):
    monkeypatch.setattr(wordids, "CACHED", 50)
    draw = random.Random(1)
    small = wordids.WordIds(PATH)
    for _ in range(5):
        texts = ["".join(draw.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
        assert [f.tolist() for f in small.texts(pa.array(texts))] == [library_ids(source, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 7, 300, 49_408, 1 << 20]), st.integers(1, 30))
def test_coder_round_trips(seed, vocabulary, lanes):
    draw = np.random.default_rng(seed)
    blocks = []
    for _ in range(lanes):
        n = int(draw.integers(1, 500))
        kind = draw.integers(4)
        ids = draw.integers(0, vocabulary, n) if kind == 0 else np.minimum(draw.zipf(1.4, n) - 1, vocabulary - 1) if kind == 1 \
            else np.full(n, draw.integers(vocabulary)) if kind == 2 else np.arange(n) % min(vocabulary, 13)
        blocks.append(ids.astype(np.int32))
    payloads = idcoder.encode(blocks, vocabulary)
    back = idcoder.decode(payloads, [len(b) for b in blocks], vocabulary)
    assert all((a == b).all() for a, b in zip(blocks, back))
    alone = idcoder.decode(payloads[-1:], [len(blocks[-1])], vocabulary)  # blocks stand alone
    assert (alone[0] == blocks[-1]).all() and idcoder.encode(blocks[-1:], vocabulary) == payloads[-1:]


def test_predictions_make_repeats_small():
    phrase = np.random.default_rng(2).integers(0, 49_408, 64)
    repeated, noise = np.tile(phrase, 32), np.random.default_rng(3).integers(0, 49_408, 2048)
    skewed = np.minimum(np.random.default_rng(4).zipf(1.5, 2048) - 1, 49_407)
    a, b, c = (len(p) * 8 / 2048 for p in idcoder.encode([repeated, noise, skewed], 49_408))
    assert a < 2.0 and b < 18.5 and c < 9.0  # bits an id; evenly coded ids take 15.6


def test_carries_reach_back_over_full_words():
    out = idcoder._Output(2, 4)
    for value in (5, 0xFFFFFFFF, 0xFFFFFFFF):
        out.put(np.array([0, 1]), np.array([value, 7]))
    out.put(np.array([0]), np.array([(1 << 32) + 9]))
    assert out.words[0, :4].tolist() == [6, 0, 0, 9] and out.words[1, :3].tolist() == [7, 7, 7]


def written(path, docs, lanes=3, block=16):
    with open(path, "wb") as file:
        writer = idfiles.Writer(file, 1000, block, lanes)
        for key, ids in docs:
            writer.add(key, np.array(ids))
        writer.close()


def test_documents_cross_blocks_and_damage_is_found(tmp_path):
    from pyarrow import fs

    draw = np.random.default_rng(5)
    docs = [(None if i == 0 else i * 3 - 9, draw.integers(0, 1000, int(n))) for i, n in enumerate([1, 0, 700, 5, 16, 16, 1, 90])]
    path = str(tmp_path / "f")
    written(path, docs)
    local = fs.LocalFileSystem()
    with local.open_input_file(path) as file:
        got = list(idfiles.documents_of(file))
        vocabulary, *_, end = idfiles.directory(file)
        assert np.concatenate(list(idfiles.stream(file, vocabulary, end, lanes=2))).tolist() == [int(x) for _, ids in docs for x in ids]
    start = 0
    for (key, ids), found in zip(docs, got):
        assert found == (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    whole = open(path, "rb").read()
    for at in range(0, len(whole), 7):
        broken = bytearray(whole)
        broken[at] ^= 0x10
        with open(path, "wb") as file:
            file.write(broken)
        with local.open_input_file(path) as file:
            try:
                assert list(idfiles.documents_of(file)) == got and 12 <= at < 16  # the block size is only told
            except ValueError:
                pass
    with open(path, "wb") as file:
        file.write(whole[:-5])
    with local.open_input_file(path) as file, pytest.raises(ValueError):
        list(idfiles.documents_of(file))


def test_a_repeated_task_leaves_one_file(docs, tmp_path):
    folder = str(tmp_path / "again")
    idfiles.write(docs, PATH, folder, file_bytes=50_000)
    names = sorted(os.listdir(folder))
    first = {n: open(f"{folder}/{n}", "rb").read() for n in names}
    idfiles.write(docs, PATH, folder, file_bytes=50_000)
    assert sorted(os.listdir(folder)) == names and all(n.startswith("ids-") for n in names)
    assert first == {n: open(f"{folder}/{n}", "rb").read() for n in names}
