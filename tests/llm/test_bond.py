import numpy as np
import pytest
from pyspark.sql import functions as F

from spanpref.llm import bond as B


def brute(rows, is_anchor, n_pos=5, n_neg=10):
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        q = [int(np.floor(256.0 * np.float64(x))) for x in vector]
        kept[vec_id] = min(kept.get(vec_id, (label, q)), (label, q))
    out = []
    for a, (label, v) in kept.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m) for b, (m, w) in kept.items() if b != a and len(w) == len(v))
        for ps, p, _ in [s for s in scored if s[2] == label][:n_pos]:
            inside = [(s, b) for s, b, m in scored if m != label and -30 * ps <= -100 * s <= -90 * ps]
            out += [(a, p, r, b, -ps, -s) for r, (s, b) in enumerate(inside[:n_neg], 1)]
    return sorted(out)


def rows_of(seed, n, d):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.4, (5, d))
    rows = [(i, int(draw.integers(0, 4)), (centres[draw.integers(0, 5)] + draw.normal(0, 0.15, d)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 7][1] + i % 2, rows[i % 7][2]) for i in range(40)]  # copies: ties
    return rows


@pytest.mark.parametrize("seed,block,anchor_block", [(0, 8192, 8192), (1, 16, 8192), (2, 50, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block, anchor_block):
    monkeypatch.setattr(B, "BLOCK", block)
    rows = rows_of(seed, 300, 13)
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    found = sorted(tuple(r) for r in B.mine(vectors, F.col("vec_id") % 20 == 0, anchor_block=anchor_block).collect())
    assert found == brute(rows, lambda a: a % 20 == 0)
    assert found


def test_messy(spark):
    rows = rows_of(7, 60, 4)
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, [0.1] * 4), (100, None, [0.1] * 4), (101, 1, None), (102, 1, [0.1, None, 0.2, 0.1]), (103, 1, [nan, 0.0, 0.0, 0.0]), (104, 1, [inf, 0.0, 0.0, 0.0])]
    rows += [(105, 1, []), (106, 2, []), (120, 3, []), (107, 1, [0.5, 0.5]), (0, 0, [9.0] * 4), rows[3], (140, -1, [0.0] * 4)]
    schema = "vec_id long, label int, embedding array<float>, q string, rank int, anchor_id long"
    vectors = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    found = sorted(tuple(r) for r in B.mine(vectors, F.col("vec_id") % 10 == 0).collect())
    assert found == brute([r[:3] for r in rows], lambda a: a % 10 == 0)
    none = B.mine(vectors.limit(0), F.col("vec_id") % 10 == 0)
    assert none.collect() == [] and none.columns == B.SCHEMA.replace(" long", "").replace(" int", "").split(", ")
    assert B.mine(vectors, F.col("vec_id") == -5).collect() == []


def test_contract_moves_labels(spark):
    vectors = spark.createDataFrame([(7, 9, [1.0]), (8, 9, [1.0]), (14, None, [1.0])], "vec_id long, label int, embedding array<float>")
    assert {(r["vec_id"], r["label"]) for r in B.moved_labels(vectors).collect()} == {(7, 0), (8, 9), (14, None)}


def test_bounds_shrink_the_candidates():
    """Rows that can't matter leave before the last column is read, and what stays is exact."""
    draw = np.random.default_rng(1)
    matrix = draw.integers(-20, 20, (2000, 32))
    matrix[:30] += 200
    block = B.Columns(np.arange(2000), np.zeros(2000, np.int64), matrix)
    anchor = np.full(32, 100)
    left = []

    def settle(lower, upper):
        left.append(len(lower))
        return upper >= B.kth(lower, 5)

    alive, scores = block.scan(anchor, np.arange(2000), settle)
    assert (scores == matrix[alive] @ anchor).all()
    assert left[0] == 2000 and left[-1] <= 30
    best = np.argsort(-(matrix @ anchor), kind="stable")[:5]
    assert set(best) <= set(alive)


def test_products_that_overflow_raise():
    big = np.array([[1 << 40, 1 << 40]])
    with pytest.raises(OverflowError):
        B.Columns(np.arange(1), np.zeros(1, np.int64), big).scan(big[0], np.arange(1), lambda lower, upper: upper >= lower)


def test_ties_go_by_the_smaller_id():
    scores, ids = B.best(np.array([3, 5, 5, 5, 1]), np.array([9, 8, 2, 4, 0]), 2)
    assert scores.tolist() == [5, 5] and ids.tolist() == [2, 4]
    assert B.kth(np.array([1, 2]), 3) == B.NONE
