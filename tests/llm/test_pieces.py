import random

import numpy as np
import pytest
import sentencepiece
from plumbline.llm.pieces import PieceModel, encode_decode
from plumbline.llm.queries import piece_model_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def texts():
    rng = random.Random(3)
    odd = ["", " ", "  a", "\n\n", "a \n b\n", "▁a▁▁ b", "\x00x", "héllo 😀 \n w", "a　b", "﻿x", "x" * 3000, "   " * 50 + "q", "ab" * 2000, "the cat " * 20000]
    return odd + ["".join(rng.choice("abcdefgh  \n▁éñ😀中thing1.,") for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_as_the_library(spark, library):
    rows = [(i, t, [1], "c") for i, t in enumerate(texts())] + [(90001, None, None, None), (None, "two words", None, None), (5, "again", None, None), (5, "again", None, None)]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string"), piece_model_path()).collect()
    want = sorted((-1 if i is None else i, library.encode(t or "", add_eos=True), library.decode(library.encode(t or "", add_eos=True))) for i, t, *_ in rows)
    assert sorted((-1 if r.id is None else r.id, r.ids, r.decoded) for r in got) == want


def test_words_forgotten_give_the_same(monkeypatch):
    import plumbline.llm.pieces as m

    some = texts()[:400]
    whole = PieceModel(piece_model_path()).encode(some)[0].tolist()
    monkeypatch.setattr(m, "WORDS", 10)
    small = PieceModel(piece_model_path())
    assert [x for t in some for x in small.encode([t])[0].tolist()] == whole


def test_decodes_any_ids(library):
    rng = random.Random(4)
    ids = [[rng.randrange(3, 32000) if rng.random() < 0.5 else rng.randrange(0, 259) for _ in range(rng.randint(0, 9))] for _ in range(500)]
    got = PieceModel(piece_model_path()).decode(np.array([x for i in ids for x in i], int), np.array([len(i) for i in ids]))
    assert got == [library.decode(i) for i in ids]


def test_empty(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), piece_model_path()).count() == 0
