"""Pieces against the library where lower case is longer than upper case."""

from __future__ import annotations

import pyarrow as pa
import pytest

from corpusloom.llm import bpe
from corpusloom.llm import queries as q


@pytest.mark.parametrize("text", ["SİTESİ.", "İ!", "(İ)", "İ's İ1 1İ é!İ", "x-İ-y İ İstanbul'da 12İ. Ŀİ?", "naïve! ÇAĞRI. ŉ!"])
def test_dotted_capital_i(text):
    encoder = bpe.Encoder(q.tokenizer_path())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(pa.array([text, "a b", text]))[1].tolist() == want + encoder.encode(pa.array(["a b"]))[1].tolist() + want


def test_words_are_remembered_over_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "LEARN", 7)
    encoder = bpe.Encoder(q.tokenizer_path())
    often = "the größe über naïve ÿ"
    asked = []
    together = encoder._learn_all
    monkeypatch.setattr(encoder, "_learn_all", lambda pieces: asked.extend(pieces) or together(pieces))
    for i in range(30):
        text = f"{often} " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}zq{'x' * (i // 26)}" for j in range(20)) + " , 日本 ŉ 7"
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(pa.array([text]))[1].tolist() == want
    # frequent words stay known
    assert asked.count(b"the") == 1 and asked.count("größe".encode()) == 1
    assert len(encoder.new) + len(encoder.old) < 200


def test_words_of_letters_go_to_the_model_together(monkeypatch):
    encoder, alone = bpe.Encoder(q.tokenizer_path()), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda piece: alone.append(piece) or learn(piece))
    text = "the größe über naïve ÿ , 日本 ŉ 7 " + " ".join(f"{chr(97 + i)}zq" for i in range(26))
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(pa.array([text]))[1].tolist() == want
    assert {*alone} == {b",", "日本".encode(), "ŉ".encode(), b"7"}
