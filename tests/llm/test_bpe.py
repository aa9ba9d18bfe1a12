import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldloom.llm import bpe, bpe_codec, common, queries
from tests.llm.conftest import ODD, SMALL, small_documents

PATH = queries.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def encoded(texts, library=False):
    ids, bounds = bpe.encoder(PATH, library)(pa.array(texts, pa.string()))
    return [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]


def decoded(*rows):
    return bpe.vocabulary(PATH).decode(np.concatenate([np.zeros(0, "<u4"), *rows]), np.cumsum([0, *map(len, rows)])).to_pylist()


def wanted(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("library", [False, True])
def test_small_documents(library):
    texts = [t for _, t in small_documents()] + [t or "" for _, t in ODD]
    assert [x.tolist() for x in encoded(texts, library)] == wanted(texts)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.one_of(st.sampled_from("'strevmld  \n\t 　aA9.!é日😀Ᲊ"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_any_text(texts):
    ids = encoded(texts)
    assert [x.tolist() for x in ids] == wanted(texts)
    assert decoded(*ids) == [LIBRARY.decode(x.tolist(), skip_special_tokens=False) for x in ids] == texts


def test_overlapping_equal_pairs():
    texts = ["a" * n for n in range(1, 40)] + ["ab" * n + "a" for n in range(20)]
    assert [x.tolist() for x in encoded(texts)] == wanted(texts)


def test_special_tokens_inside_text():
    texts = ["<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|>\n", "<|endoftext", " <|endoftext|> x"]
    assert [x.tolist() for x in encoded(texts)] == wanted(texts)


def test_ids_that_are_no_text():
    ids = encoded(["é日"])[0]
    assert decoded(ids[:1], ids, ids[1:]) == [LIBRARY.decode(x.tolist(), skip_special_tokens=False) for x in (ids[:1], ids, ids[1:])]


def test_long_words_and_texts():
    """Pieces over LONG bytes, and texts over several windows, with and without places to cut."""
    rng = random.Random(4)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(300_000))
    texts = ["a" * 1000, "ab" * 700 + "a", word, " ".join(rng.choice(("the", "don't", "x1", "é", "\n\n", "")) for _ in range(900_000)), "日本" * 400_000, "".join(rng.choice("aé ,1'\n") for _ in range(1_200_000))]
    assert all(x.tolist() == y for x, y in zip(encoded(texts), wanted(texts), strict=True))
    assert decoded(*encoded(texts)) == texts


def test_a_long_word_takes_seconds():
    rng, began = random.Random(5), time.time()
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert encoded([word])[0].tolist() == wanted([word])[0] and time.time() - began < 60


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(st.sampled_from("abé"), min_size=bpe.LONG + 1, max_size=300), max_size=4))
def test_long_rounds_equal_rounds(words):
    raw = [w.encode() for w in words]
    vocab = bpe.vocabulary(PATH)
    assert [x.tolist() for x in vocab.long_rounds(raw)] == [x.tolist() for x in vocab.rounds(raw)] if raw else True


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(st.sampled_from("ab é\n<|endoftxt>"), max_size=60), max_size=5), st.integers(1, 40))
def test_windows_cover_all_and_change_nothing(texts, limit):
    texts = [*texts, "so it is <|endoftext|> and on it goes"]
    raw, offsets = common.text_buffer(pa.array(texts))
    cuts = list(bpe.windows(raw, offsets, limit, b"<|endoftext|>"))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(raw)
    whole = bpe.split_pieces(raw, offsets, b"<|endoftext|>").tolist()
    parts = [a + x for a, b in cuts for x in bpe.split_pieces(raw[a:b], np.r_[offsets[(offsets >= a) & (offsets < b)] - a, b - a], b"<|endoftext|>").tolist()]
    assert parts == whole


def test_query(spark):
    rows = {r.doc_id: r for r in queries.op6_bpe(spark, SMALL).collect()}
    docs = small_documents()
    for (doc, text), ids in zip(docs, wanted([t for _, t in docs]), strict=True):
        r = rows[doc]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, odd, empty):
    got = sorted((str(r.doc_id), r.decoded) for r in bpe_codec.encode_decode(odd, PATH).collect())
    assert got == sorted((str(d), t or "") for d, t in ODD)
    assert bpe_codec.encode_decode(empty, PATH).collect() == []


def test_new_pieces_are_encoded_together():
    own = bpe.Encoder(PATH, True)
    library, calls = own.library, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **more)

    own.library = Counted()
    words = [f"w{i}é'll  　<|endoftext|>😀\n x{i * 7919}" for i in range(500)]
    ids, bounds = own(pa.array(words))
    assert 1 < sum(calls) < 20
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
