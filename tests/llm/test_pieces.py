import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.llm import pieces
from tidebar.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = pieces.Pieces(MODEL)
ODD = ["", " ", "  x", "\n\n a", "a" * 3000, "   " * 50, "x" + " " * 37 + "y", " " * 5001, "東京タワーは高い" * 40, "<s> </s> <unk> <0x0A> ▁x ▁▁",
       "12 345 6,789 0x1F", "Word, WORD!! don't (é)! ñ... a²., x_y-z f(x)=y; o'clock", "\U0001F642 ok", "ﬁ ½ Ⅷ", "\x00\x01é́"]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_library_s(text):
    ids = pieces.Encoder(OWN)(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert pieces.Decoder(OWN)(ids) == LIBRARY.decode(ids)


@given(st.lists(st.sampled_from(["e", "t", "th", "in", " ", "  ", "\n", "é", "1", "☃", "京", "the", "ing", "▁", "on", "er", "un"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_one_stream_without_segments(text):
    """The window alone, its paths meeting where they may, gives the same ids."""
    encode = pieces.Encoder(OWN)
    encode.segments = re.compile(r"(?s).+")
    assert encode(text).tolist() == LIBRARY.encode(text)


@given(st.text(st.sampled_from("etho ▁n☃é1.,日g"), max_size=pieces.SHORT))
@settings(max_examples=300, deadline=None)
def test_short_segments_need_no_moving_window(text):
    encode, search = pieces.Encoder(OWN), pieces.StreamingViterbi(OWN)
    assert np.frombuffer(encode._short(text), "<i4").tolist() == [*search.feed(text), *search.close()]


def test_texts_of_several_parts(monkeypatch):
    """Words never take the moving window, and parts are cut before runs of spaces."""
    monkeypatch.setattr(pieces, "PART", 7)
    monkeypatch.setattr(pieces, "StreamingViterbi", None)
    text = "  some   words, and ▁ more    " * 5 + "end"
    assert pieces.Encoder(OWN)(text).tolist() == LIBRARY.encode(text)


def test_window_stays_bounded():
    search, out = pieces.StreamingViterbi(OWN), []
    for _ in range(300):
        out.extend(search.feed("interoperability" * 4))
        assert len(search.text) < 64 + 2 * pieces.LOOK + OWN.longest and len(search.back) < 64 + 2 * pieces.LOOK + OWN.longest
    out.extend(search.close())
    assert out == OWN_ids("interoperability" * 1200)


def OWN_ids(text):
    return [OWN.ids[p] for p in OWN.merge(text)]


def test_edge_rows(spark):
    texts = [None, "", "two words", "two words", "x" * 100_000, *ODD]
    docs = spark.createDataFrame([(i if i else None, t, "d") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    got = {r.id or 0: (r.ids, r.decoded) for r in pieces.decode_ids(pieces.encode_texts(docs, MODEL), MODEL).collect()}
    assert got == {i: (LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t in enumerate(texts)}
    both = pieces.encode_texts(docs, MODEL, decoded=True)
    assert {r.id or 0: (r.ids, r.decoded) for r in both.collect()} == got
    empty = pieces.decode_ids(pieces.encode_texts(docs.limit(0), MODEL), MODEL)
    assert empty.columns == ["id", "ids", "decoded"] and empty.count() == 0


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op1_sentencepiece"](spark, sf).collect():
        assert r.ids == LIBRARY.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.n_ids == len(r.ids)
