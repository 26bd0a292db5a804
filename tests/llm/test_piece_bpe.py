"""Encoding and decoding against the library whose models are read."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = piece_bpe.PieceModel(open(PATH, "rb").read())
BITS = ["a", "b", "ab", " ", "  ", "    ", "\n", "▁", "é", "门", "ข", "😀", "\x00", "\t", "th", "the", "ing", "。", "日本", "0", "<s>", "<0x41>", "�"]


def library(texts):
    return LIBRARY.encode(texts, add_bos=True, add_eos=True, num_threads=1)


def own(texts, **options):
    return [np.frombuffer(x, "<u4").tolist() for x in piece_bpe.Encoder(MODEL, **options).encode(texts)]


def test_odd_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", *(" " * n for n in range(1, 70)), "a" * 3000, "日本語" * 2000, "▁" * 50, " " * 20000 + "x", "abababab" * 500, "x" * 63 + "y", "x" * 64 + "yz"]
    want = library(texts)
    assert own(texts) == want
    assert own(texts, limit=5, longest=3) == want
    assert [MODEL.decode(x) for x in want] == [LIBRARY.decode(x) for x in want]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    (want,) = library([text])
    assert own([text]) == [want] and MODEL.decode(want) == LIBRARY.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, MODEL.size - 1), max_size=12))
def test_any_ids(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_spans(monkeypatch):
    texts = ["one two  three   four\n" * 40, "", " lead", "nospace" * 30]
    want = library(texts)
    monkeypatch.setattr(piece_bpe, "SPAN", 7)
    assert own(texts) == want
    assert ["".join(w) for w in (sum(MODEL.words(t), []) for t in texts)] == [("▁" + t.replace(" ", "▁")) if t else "" for t in texts]


def test_rounds_are_the_sequential_merges():
    """Merging at once, with the heap for words whose merges may meet, against the heap alone."""
    rng = random.Random(5)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("aeinrst▁") for _ in range(rng.randint(1, 30)))
        symbols = [s for s, _ in MODEL._by_heap([int(MODEL.char[ord(c)]) for c in word])]
        assert np.frombuffer(MODEL.merged([word])[0], "<u4").tolist() == symbols


def test_tables(spark):
    texts = [None, "", "plain words here", "a  b ", "long word " * 30000, "same", "same"]
    schema = "doc_id long, text string, ids long, row string, decoded string, tags map<string,int>"
    docs = spark.createDataFrame([(None if i == 6 else i, t, 1, "r", "d", {"k": i}) for i, t in enumerate(texts)], schema).repartition(3)
    want = {t or "": x for t, x in zip(texts, library([t or "" for t in texts]), strict=True)}
    rows = piece_bpe.encode(docs, PATH).collect()
    assert len(rows) == len(texts) and all(r.ids == want[r.row.text or ""] for r in rows) and {r.row.tags["k"] for r in rows} == set(range(7))
    for r in piece_bpe.round_trip(docs, PATH).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == want[r.row.text or ""] and r.decoded == LIBRARY.decode(want[r.row.text or ""])
    back = piece_bpe.decode(piece_bpe.encode(docs, PATH).select("ids"), PATH).collect()
    assert all(r.decoded == LIBRARY.decode(r.ids) for r in back)
    assert piece_bpe.encode(docs.limit(0), PATH).count() == 0 == piece_bpe.round_trip(docs.limit(0), PATH).count()


def test_other_models(tmp_path):
    with pytest.raises(ValueError):
        piece_bpe.PieceModel(b"")
