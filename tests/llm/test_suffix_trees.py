import hashlib
import random

import numpy as np
import pytest

from spanpref.llm import suffix_trees as S


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) by comparing every window with those of smaller documents."""
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        if d is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, words in split:
        gone = set()
        if d is not None:
            for i in range(len(words) - window + 1):
                if least[tuple(words[i : i + window])] < d:
                    gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n):
    """Texts of few words with passages shared, nested and overlapping, copies and near copies."""
    draw = random.Random(seed)
    shared = [[draw.choice("abcdefg") + str(draw.randint(0, 3)) for _ in range(draw.randint(5, 30))] for _ in range(4)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += draw.choice([[draw.choice("xyz") for _ in range(draw.randint(0, 9))], draw.choice(shared), ["r"] * draw.randint(1, 12), draw.choice(shared)[3:]])
        if rows and draw.random() < 0.3:
            words = (rows[draw.randrange(len(rows))][1] or "").split()
            if words and draw.random() < 0.5:
                words[draw.randrange(len(words))] = "changed"
        rows.append((draw.choice([d, d, max(0, d - 1)]), draw.choice([" ", "\n", "\t "]).join(words)))
    return rows


def test_runs_hold_every_suffix_and_depend_on_the_window_alone():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 1 << 60, 300).astype(np.uint64)
    codes[200:260] = codes[20:80]
    keys, starts, ends = S.runs_of(codes, 10, 3)
    assert starts[0] == 0 and ends[-1] == 291 and (starts[1:] == ends[:-1]).all()
    key = np.repeat(keys, ends - starts)
    assert (key[20:71] == key[200:251]).all()
    assert len(S.runs_of(codes[:9], 10, 3)[0]) == 0


def test_spans_of_prefix_choice_do_not_matter(monkeypatch):
    codes = np.random.default_rng(4).integers(0, 50, 500).astype(np.uint64)
    whole = S.runs_of(codes, 12, 4)
    monkeypatch.setattr(S, "SPAN", 64)
    assert all((a == b).all() for a, b in zip(whole, S.runs_of(codes, 12, 4)))


def test_words_and_codes():
    draw = random.Random(9)
    text = "".join(draw.choice("ab é\t\n\x0b\x0c\r\x1c\u2003  ") for _ in range(3000)).encode() + b"x" * 500
    want = S.words_of(text)
    for piece in (1, 7, 100, 1 << 20):
        codes, starts, stops = S.words_in(text, piece)
        assert [text[a:b] for a, b in zip(starts, stops)] == want
        assert len(set(zip(codes.tolist(), want))) == len(set(want)) == len(set(codes.tolist()))
    assert [len(x) for x in S.words_in(b"")] == [0, 0, 0]


def test_least_places():
    values = np.random.default_rng(2).integers(0, 9, 400).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 3, 4, 43):
        want = np.lib.stride_tricks.sliding_window_view(values, width).argmin(axis=1) + np.arange(401 - width)
        assert (S._least_places(values, width) == want).all()


@pytest.mark.parametrize("window", [1, 2, 5, 50])
def test_deep_nodes_are_equal_windows(window):
    draw = random.Random(window)
    runs = [[draw.choice([b"a", b"b"]) for _ in range(draw.randint(0, 120))] for _ in range(6)] + [[]]
    run, suffix, node = S.deep_nodes(runs, window)
    seen = {}
    for r, s, n in zip(run.tolist(), suffix.tolist(), node.tolist()):
        seen.setdefault(tuple(runs[r][s : s + window]), set()).add(n)
    assert all(len(x) == 1 for x in seen.values()) and len({next(iter(x)) for x in seen.values()}) == len(seen)
    assert len(run) == sum(max(0, len(r) - window + 1) for r in runs)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("group_runs", [0, 3, 256])
def test_equals_brute_force(spark, seed, group_runs):
    rows = passages(seed, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in S.result(docs, 8, 3, group_runs).collect()]
    assert sorted(found, key=str) == brute(rows, 8)


def test_subtrees_are_built_in_pieces(spark, monkeypatch):
    rows = passages(11, 30)
    monkeypatch.setattr(S, "TREE_RUNS", 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.result(docs, 8, 3).collect()), key=str) == brute(rows, 8)


def test_messy(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted((tuple(r) for r in S.result(messy).collect()), key=str) == brute(rows, 50)
    assert S.result(empty).collect() == []
    assert S.result(messy).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_kept_text_and_spans(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"one {passage} end"), (2, f"other words  {passage}\nlast"), (3, passage[:100])], "doc_id int, text string")
    kept = {r["doc_id"]: r["kept"] for r in S.result(docs, texts=True).collect()}
    assert kept == {1: f"one {passage} end", 2: "other words last", 3: passage[:100]}
    assert {(r["doc_id"], r["start"]) for r in S.repeats(docs).collect()} <= {(2, i) for i in range(2, 13)}
