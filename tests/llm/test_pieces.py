"""The rebuilt backend against the original library: ids, texts, both kinds of models."""
import struct

import public_tokenizers
import pyarrow as pa
import pytest

from tallybench.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
NASTY = ["", "  a b  ", "\n\n a\n b", "it's\t x", "<s> hi </s> <0x0A>", " ", "   ", "▁ a▁▁b ▁c", "日本語 🎉 \x00 x", "é è ß", "a" * 50, "x ▁", "…", "a  b   c    d"]


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    size = len(value)
    return bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value


def unigram_model(dummy_prefix=1):
    """A small unigram model with byte fallback, written field by field."""
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    vocab += [(p, s, 1) for p, s in (("▁", -2.0), ("▁a", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁ab", -5.5), ("ba", -6.0), ("c", -7.0), ("abc", -9.0))]
    raw = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in vocab)
    raw += field(2, field(3, 1) + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, 1]))
    return raw + field(3, field(1, b"identity") + field(3, dummy_prefix) + field(4, 0))


def test_whole_texts(texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
    with open(PATH, "rb") as file:
        model = pieces.parse(file.read())
    assert (model.kind, len(model.pieces), pieces.can_be_cut(model)) == (pieces.BPE, sp.get_piece_size(), True)
    backend = pieces.backend(model)
    for text in [t or "" for _, t in texts if len(t or "") < 50_000] + NASTY:
        ids = sp.encode(text)
        assert backend.encode(text, add_special_tokens=False).ids == ids, text
        assert backend.decode(ids, skip_special_tokens=False) == sp.decode(ids)


def test_stretches(texts):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
    cases = [t or "" for _, t in texts if len(t or "") < 50_000] + NASTY
    found = pieces.Encoder(PATH).texts(pa.array([" " + t if t else "" for t in cases]))
    for text, (ids, parity, back) in zip(cases, found):
        assert ids.tolist() == sp.encode(text) and parity
        assert back == ("▁" not in text)


def test_unigram_model(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    (tmp_path / "small.model").write_bytes(unigram_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "small.model"))
    encoder = pieces.Encoder(str(tmp_path / "small.model"))
    assert encoder.model.kind == pieces.UNIGRAM
    cases = ["ab", "ab abc ba", "a  b", "abcabc aa b", "c", ""]
    for text, (ids, parity, _) in zip(cases, encoder.texts(pa.array([" " + t if t else "" for t in cases]))):
        assert ids.tolist() == sp.encode(text) and parity


def test_rows(docs, texts, nothing):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PATH)
    rows = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert len(rows) == len(texts) and all(r.parity for r in rows)
    by = {i: t for i, t in texts if i is not None}
    for r in rows:
        if r.doc_id is not None and r.doc_id != 103:
            text = by[r.doc_id] or ""
            assert r.n_ids == len(r.ids) and r.decoded == text and r.round_trip
            if len(text) < 5000:
                assert list(r.ids) == sp.encode(text)
    assert pieces.encode(nothing, PATH).count() == 0
