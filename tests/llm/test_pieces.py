"""SentencePiece coding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("docflow.llm")
import public_tokenizers  # noqa: E402
import sentencepiece  # noqa: E402

from docflow.llm import pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", " \n\t ", "a", "▁", " ▁▁ x", "Ünïcödé 日本語 🙂🙂", "<s> </s> <unk> <0x0A>", "\0\x01\x7f", "a  b   c" + " " * 700, "x" * 5000, "ab" * 9000, "word " * 4000, " ﻿é́", "don't\nstop\r\n\n- 3.14"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.model_data(PATH))


def test_model(library, model):
    assert model.pieces == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert (model.begin, model.end, model.unknown) == (library.bos_id(), library.eos_id(), library.unk_id())
    with pytest.raises(ValueError):
        pieces.Model(pieces.model_data(PATH)[:2000])


def test_encode(library, model):
    rng = random.Random(5)
    signs = ["a", "b", "e", "t", "th", "er", "ing", " ", "  ", "▁", "\n", "é", "日", "本", "🙂", "0", "12", ".", ",", "<s>", "'s", "ё", "́"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 700), rng.randrange(0x2000, 0xD000), rng.randrange(0x1F000, 0x1FAFF)])) for _ in range(30)) for _ in range(300)]
    coder = pieces.Coder(model)
    for t, want in zip(texts, library.encode(texts, num_threads=1), strict=True):
        assert model.encode(t) == want, t
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == want
        assert model.merge(model.normal(t)) == [s for c in model.cut(model.normal(t)) for s in model.merge(c)]
        assert model.decode(want) == library.decode(want) == coder.decode(coder.encode(t)).decode()
        short = model.normal(t)[:300]
        assert model._merge_short(short) == model._merge_long(short)


def test_decode(library, model):
    rng = random.Random(6)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_memo(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 3)
    coder = pieces.Coder(model)
    for k in range(40):
        t = f"one two{k % 7} three{k % 5} four"
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == model.encode(t)


def test_frames(spark, library):
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)] * 2, "doc_id long, text string, decoded int")
    got = pieces.with_pieces(frame, PATH).collect()
    assert len(got) == 2 * len(ODD)
    for r in got:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["piece_ids"] == ids and r["decoded"] == library.decode(ids)
    bare = pieces.with_pieces(frame, PATH, begin=False, end=False)
    assert all(r["piece_ids"] == library.encode(r["text"] or "") for r in bare.collect())
    assert pieces.decode_pieces(bare, PATH).where("decoded is null").count() == 0
    assert pieces.differing(frame, PATH).count() == 0 and pieces.with_pieces(frame.limit(0), PATH).count() == 0
    wrong = pieces.with_pieces(frame, PATH).first()
    assert wrong["piece_ids"] == [1, 2]


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert pieces.differing(docs, PATH).count() == 0
    got = {r["doc_id"]: r for r in pieces.op13_pieces(spark, sf).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
