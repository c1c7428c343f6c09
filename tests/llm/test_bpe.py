import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spanpref.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.codec(PATH, P.PATTERN).ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeth  \n\t'sé中😀-_=129́\x00"), max_size=60))
def test_same_ids_as_tiktoken_and_exact_round_trip(enc, text):
    c = bpe.codec(PATH, P.PATTERN)
    ids = np.frombuffer(c.encode(text), "<i4").tolist()
    assert ids == enc.encode_ordinary(text)
    assert c.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_pieces_of_any_bytes(enc, piece):
    assert bpe.codec(PATH, P.PATTERN).transducer.encode(piece) == enc._core_bpe.encode_single_piece(piece)


def test_state_limit_changes_no_ids(enc):
    small = bpe.Transducer(bpe.codec(PATH, P.PATTERN).ranks, state_limit=20)
    for text in ("thntionable", "antidisestablishmentarianism" * 20, "=" * 500, "ééàü" * 30):
        assert small.encode(text.encode()) == enc._core_bpe.encode_single_piece(text.encode())


def test_decoding_carries_cut_characters():
    c = bpe.codec(PATH, P.PATTERN)
    text = "😀é中" * 40_000
    ids = np.frombuffer(c.encode(text), "<i4").tolist()
    assert len(ids) > bpe.DECODE_CHUNK and c.decode(ids) == text


def test_messy_rows(messy, empty, enc):
    rows = bpe.digests(messy).collect()
    texts = [r.text or "" for r in messy.collect()]
    assert len(rows) == len(texts)
    want = sorted((len(i := enc.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts)
    assert sorted(tuple(r)[1:] for r in rows) == want
    assert bpe.digests(empty).count() == 0
    both = bpe.decode_documents(bpe.encode_documents(messy, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(r.text for r in both) == sorted(texts)
