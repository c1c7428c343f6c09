import hashlib
import itertools
import random

import pytest

from spanpref.llm import conversations as C


def form(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) >= 2 and rest == "ua" * (len(rest) // 2))


def brute(rows, inserts):
    """All edits of (role, fault) rows, with up to so many inserts at any place: (cost, audit)."""
    best = None
    slots = range(len(rows) + 1)
    for n in range(inserts + 1):
        for places in itertools.combinations_with_replacement(slots, n):
            tokens = [x for i in slots for x in ["I"] * places.count(i) + ([i] if i < len(rows) else [])]
            choices = []
            for x in tokens:
                if x == "I":
                    choices.append([("I", 5, "u"), ("I", 5, "a")])
                    continue
                role, wrong = rows[x]
                extra = 5 if wrong == C.TRUNCATED else 0
                named = [("R", 1 + extra, "u"), ("R", 1 + extra, "a")] + [("K", extra, role[:1])] * bool(role)
                kept = [] if wrong in (C.BLANK, C.DUPLICATE) else named
                choices.append([("D", 2, "")] + kept)
            for edits in itertools.product(*choices):
                if form("".join(e[2] for e in edits)):
                    key = (sum(e[1] for e in edits), "".join(e[0] for e in edits))
                    best = key if best is None else min(best, key)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_weights_give_the_cheapest_and_least_audit(seed):
    draw = random.Random(seed)
    rows = [(draw.choice(["system", "user", "assistant", "user", "assistant", " ", "tool", "", "ua"]), draw.choice([None, None, None, C.BLANK, C.DUPLICATE, C.TRUNCATED])) for _ in range(draw.randint(0, 5))]
    ends = C.shortest([(r[:1], w) for r, w in rows])
    found = C.read(min(ends[s] for s in C.ENDS if s in ends), len(rows) + C.MAX_INSERTS)
    assert found == brute(rows, 2)
    assert "I" not in found[1]


def test_end_padding_counts_as_least():
    assert C.read(0, 4) == (0, "")
    assert C.written(3, "KD") < C.written(3, "KI") < C.written(3, "RD")
    for cost, audit in [(0, ""), (7, "DIKR"), (12, "KKKK")]:
        assert C.read(C.written(cost, audit), len(audit)) == (cost, audit)


@pytest.mark.parametrize("seed", range(20))
def test_chunks_chain_to_the_whole(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("suaua"), draw.choice([None, None, C.BLANK, C.TRUNCATED])) for _ in range(30)]
    ends = C.shortest(rows)
    whole = C.read(min(ends[s] for s in C.ENDS if s in ends), len(rows) + C.MAX_INSERTS)
    pieces, at = [], 0
    while at < len(rows):
        part = rows[at : at + draw.randint(1, 7)]
        at += len(part)
        pieces.append([(a, b, *C.read(w, len(part))) for a in C.STATES for b, w in C.shortest(part, a, 0).items()])
    cost, audit, taken = C.choose(pieces)
    assert (cost, audit) == whole
    assert "".join(x for _, x in taken) == audit


def digest(rows):
    """The contract on one conversation's rows after damage, in order."""
    return (*C.repair_rows(rows)[:2], hashlib.sha256(C.lines(C.repair_rows(rows)[2])).hexdigest())


def test_counts_and_texts():
    rows = [(None, "system", "Be good."), (2, "user", "Hi."), (2, "user", "Hi."), (5, "assistant", " \t"), (6, "assistant", "Yes"), (6, "robot", "Well. ")]
    counts, audit, out = C.repair_rows(rows)
    assert counts == (2, 1, 1, 1, 3, 2 + 2 + 1 + 2)
    assert audit == "KKDDDR"
    assert out == [("system", "Be good."), ("user", "Hi."), ("assistant", "Well. ")]


SCHEMA = "conv_id long, turn long, role string, text string, conv string, print string, is_crowd boolean"


@pytest.fixture(scope="module")
def turns(spark):
    draw = random.Random(5)
    rows = []
    for conv in [1, 2, 3, None]:
        for turn in range(40 if conv == 2 else 7):
            role = draw.choice(["user", "assistant", "system", None, "tool"])
            text = draw.choice(["One.", "Two?", "Three", "", None, " \n", "Four! ", f"Row {turn}."])
            rows += [(conv, draw.choice([turn, turn, None]), role, text, "x", "y", True)] * draw.choice([1, 1, 2])
    rows.append((9, 9, "user", "word " * 20000, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_tasks_and_crowds_agree_with_the_rows(turns, monkeypatch):
    usual = C.result(turns)
    assert usual.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    usual = table_of(usual)
    assert len(usual) == 5
    monkeypatch.setattr(C, "CHUNK_ROWS", 3)
    crowds = table_of(C.repair(C.damaged(turns), crowd_rows=2, crowd_chars=10**9))
    assert crowds == usual
    # the damaged rows, grouped and ordered here
    groups = {}
    for r in C.damaged(turns).collect():
        groups.setdefault(r["conv_id"], []).extend([(r["turn"], r["role"], r["text"])] if r["alive"] else [])
    want = []
    for conv, rows in groups.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        counts, audit, sha = digest(rows)
        want.append((conv, *counts, audit, sha))
    assert sorted(want, key=lambda r: (r[0] is None, r[0] or 0)) == usual


def test_repaired_rows(turns, monkeypatch):
    usual = table_of(C.repair(C.damaged(turns), texts=True))
    monkeypatch.setattr(C, "CHUNK_ROWS", 4)
    assert sorted(map(str, table_of(C.repair(C.damaged(turns), texts=True, crowd_rows=3)))) == sorted(map(str, usual))
    prints = {r["conv_id"]: r["repaired_sha256"] for r in C.result(turns).collect()}
    for conv in prints:
        mine = sorted(r[1:] for r in usual if r[0] == conv)
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in mine).encode()).hexdigest() == prints[conv]
        assert form("".join(r[:1] for _, r, _ in mine))


def test_dropped_conversations_stay(spark):
    rows = spark.createDataFrame([(1, None, "user", "x."), (2, 3, "user", "y.")], "conv_id long, turn int, role string, text string")
    from pyspark.sql import functions as F

    out = table_of(C.repair(rows.withColumn("alive", F.col("conv_id") == 2)))
    assert out[0] == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out[1][6:8] == (2, "D")


def test_empty(turns):
    assert C.result(turns.limit(0)).collect() == []
