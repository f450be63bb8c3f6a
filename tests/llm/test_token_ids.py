import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebar.llm import token_ids
from tidebar.llm.queries import QUERIES
from tidebar.sources.scratch import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24])))
@settings(max_examples=200, deadline=None)
def test_ranks_round_trip(values):
    control, data = token_ids.pack_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    back = token_ids.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert back.tolist() == values


def want(texts):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("block,files", [(1 << 16, 64), (50, 2)])
def test_edge_rows(spark, monkeypatch, block, files):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", block)
    monkeypatch.setattr(token_ids, "FILE_BLOCKS", files)
    monkeypatch.setattr(token_ids, "MEMO", 20)
    texts = [(None, "no id"), (-5, "don't they'll say İstanbul ŒUVRE é ́x"), (0, None), (1, ""), (2, " \t\r\n"), (3, "a" * 5000), (4, "x y " * 3000),
             (4, "x y " * 3000), (5, "Word, WORD!! word... (word) 'tis don't, it's. a—! H\u0331, 3.5% x_y- <|endoftext|>! --- é. É?! ñ3;"), (7, "Größe <|endoftext|> 東京\x1cタワー <|startoftext|>!"), (8, "tail\x85line　sep")]
    docs = spark.createDataFrame([(t, "s", d) for d, t in texts], "text string, ids string, doc_id long").repartition(3)
    path = token_ids.write_ids(docs, PATH, scratch_path(spark, "ids-test"), 1)
    got = token_ids.read_ids(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got] == want(texts)


@given(st.text(st.sampled_from("aB3é'.,!-_<|>\u0331—½ª")))
@settings(max_examples=400, deadline=None)
def test_chunks_are_encoded_as_the_library_does(text):
    encode = token_ids._encoder(PATH)
    assert encode(text.encode()).tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_new_chunks_go_to_the_library_together():
    """One text for all chunks but those with the parting digit or a special token."""
    encode, given_texts = token_ids._Encoder(PATH), []
    library = encode.library

    class Counting:
        def encode_batch_fast(self, texts, **more):
            given_texts.extend(texts)
            return library.encode_batch_fast(texts, **more)
    encode.library = Counting()
    text = " ".join(f"wörd{chr(97 + k % 26) * (k // 26 + 1)}" for k in range(200)) + " 10, a0b <|endoftext|> 0 x\u0660y ０ é1"
    assert encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(given_texts) < 10


def test_cases_and_ends_of_words_are_learnt_once():
    """A word goes to the model once, whatever its capitals and the punctuation behind it; the library sees none of them."""
    encode, asked = token_ids._Encoder(PATH), []
    model, library = encode.model, encode.library

    class Counting:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)
    encode.model = Counting()
    text = "Échenré, échenré ÉCHENRÉ... Thonore thonore. THONORE, thonore... Thonore?! thonore-- (thonore) " * 3 + "é Thonore; H\u00c9 H\u0331"
    for t in (text, text[:-2], "÷. É×, Thonore \u0130. " + text[:60]):
        assert encode(t.encode()).tolist() == library.encode(t, add_special_tokens=False).ids
    assert asked.count("thonore") == 1 and len(asked) == len(set(asked))


@given(st.lists(st.text(st.sampled_from("aBhHzZ0 9'.,;!-<|>_\t\n\x0b\x1c\x85\u0331\u030a\u00c9\u00e9\u00df\u00d7\u00f7\u0130\u212a\u037e\u03a3—"), max_size=40), max_size=4))
@settings(max_examples=600, deadline=None)
def test_texts_are_encoded_as_the_library_does(texts):
    encode = token_ids._encoder(PATH)
    for text in texts:
        assert encode(text.encode()).tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_frequent_ids_take_one_byte(spark):
    docs = spark.createDataFrame([(i, "the same words again and again") for i in range(100)], "doc_id long, text string")
    path = token_ids.write_ids(docs, PATH, scratch_path(spark, "ids-test"), 1)
    size = sum(r.length for r in spark.read.format("binaryFile").load(f"{path}/ids").collect())
    assert size < 700 * 1.25 + 100 * 17 + 600


def test_empty_table(spark):
    path = token_ids.write_ids(spark.createDataFrame([], "doc_id long, text string"), PATH, scratch_path(spark, "ids-test"), 1)
    assert token_ids.read_ids(spark, path).count() == 0


def test_query_equals_the_library(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_ids"](spark, sf).collect()}
    assert got == {w[0]: w[:4] for w in want(texts)}
