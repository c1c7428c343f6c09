import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from spanpref.llm import token_files as T
from spanpref.llm.common import scratch_path


def test_coder_round_trip_and_segments():
    rng = np.random.default_rng(0)
    counts = rng.zipf(1.3, 5000).clip(0, 10**6)
    coder = T.Coder(T.scaled(counts))
    assert int(T.scaled(counts).sum()) == 1 << T.SCALE_BITS
    for n in (0, 1, 7, T.LANES, T.LANES * T.CHECKPOINT + 3, 600_000):
        ids = rng.integers(0, 5000, n).astype(np.uint32)
        payload = coder.encode(ids)
        assert (coder.decode(payload) == ids).all()
        for s in coder.segments(payload)[::-1]:  # each alone, in any order
            assert (coder.decode_segment(s) == ids[s[0] * T.LANES :][: s[1]]).all()


def test_damaged_block_is_noticed():
    coder = T.Coder(T.scaled(np.ones(100, np.int64)))
    payload = bytearray(coder.encode(np.arange(100, dtype=np.uint32)))
    payload[-1] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(payload))


def test_words_as_the_library_has_them():
    w = T.Words(T.default_tokenizer())
    plain = Tokenizer.from_file(T.default_tokenizer())
    for text in ("", "a", "A \x01 b\x01c \x01\x01 d", "J̌x é ÀB's he'll 123 4 !?.", "x\x1cy\x85z", "<|endoftext|> now", "hello <|endoftext|> x", "a<|ENDOFTEXT|>b  C", "x<|startoftext|><|endoftext|>Y\n", "<|endoftext|>"):
        assert np.frombuffer(w.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_files_in_order(spark, messy, empty):
    folder = scratch_path(spark, "test-token-files")
    T.write_ids(messy, folder, T.default_tokenizer(), 49_408, shards=3)
    rows = T.read_ids(spark, folder).orderBy("start").collect()
    plain = Tokenizer.from_file(T.default_tokenizer())
    texts = sorted((r.doc_id or 0, plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in messy.collect())
    at = 0
    assert len(rows) == len(texts)
    for r, (doc, ids) in zip(rows, sorted(texts, key=lambda x: (x[0], np.array(x[1], "<u4").astype("<u2").tobytes()))):
        assert (r.doc_id or 0, r.start, r.n_tokens) == (doc, at, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    digest = {r.start: r.ids_crc32 for r in T.digests(messy).collect()}
    assert digest == {r.start: zlib.crc32(r.ids) for r in rows}
    assert T.digests(empty).count() == 0


def test_latin_words_go_to_the_model_directly():
    """Words of Latin-1's letters, with a comma or full stop after them too, need no normaliser and splitter."""
    w, plain = T.Words(T.default_tokenizer()), Tokenizer.from_file(T.default_tokenizer())
    letters = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    some = [*letters, *(f"a{c}{d}b" for c in letters for d in letters), "ñezie.", "ción,", "ß", "ÿÿ.", "Ñandú", "öein.,&&&", "ab_!"]
    want = [plain.encode(x, add_special_tokens=False).ids for x in some]
    others = ["a÷b", "a×b", "é's!", "ab!'s", "A1.", "Ā", "é", "ĳ"]
    assert [np.frombuffer(w.encode(x), "<u4").tolist() for x in others] == [plain.encode(x, add_special_tokens=False).ids for x in others]
    assert all(w.memo[x] for x in (b".", b",", b".,&&&", b"_!"))  # marks go to the library
    w.tokenizer = None
    assert [np.frombuffer(w.encode(x), "<u4").tolist() for x in some] == want


def test_frequencies_of_many_documents(spark):
    rows = [(i, np.arange(i % 5, dtype="<u2").tobytes()) for i in range(1300)]
    ids = spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1)
    assert T.frequencies(ids, 6, "<u2").tolist() == [1040, 780, 520, 260, 0, 0]
