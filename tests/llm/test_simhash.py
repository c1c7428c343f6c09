import random

import numpy as np
import xxhash

from spanpref.llm import simhash as S


def _fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: 32 for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_golay_indices_meet_within_two_bits():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 3000)
    one = S.golay_indices(v)
    assert set((one >= 0).sum(axis=1)) == {1, 6}
    for a in range(23):
        b = rng.integers(0, 23)
        two = S.golay_indices(v ^ (1 << a) ^ (1 << b))
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(one, two))


def _components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_messy_rows_by_brute_force(messy, empty):
    rows = messy.collect()
    fps = [_fp(r.text or "") for r in rows]
    want = sorted(((r.doc_id or -1), f"{f:016x}", c) for r, f, c in zip(rows, fps, _components(fps, [r.doc_id for r in rows])))
    got = sorted(((r.doc_id or -1), r.fingerprint, r.component_id) for r in S.result(messy).collect())
    assert got == want
    assert S.result(empty).count() == 0 and S.deduplicate(empty).count() == 0


def test_one_row_of_each_group_stays(messy):
    kept = S.deduplicate(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, 1, 2, 4, 8]


def test_dense_and_chained_fingerprints(spark, monkeypatch):
    random.seed(3)
    base = random.getrandbits(64)
    fps = {base}
    while len(fps) < 150:  # a ball around one point, wider than the pairing bound
        fps.add(base ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    chain = random.getrandbits(64)
    for i in range(0, 40, 2):
        fps.add(chain)
        chain ^= 3 << i
    fps |= {random.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long").selectExpr("doc_id", "doc_id as text_hash", "fp")
    monkeypatch.setattr(S, "fingerprints", lambda docs, shingle: docs)
    got = {r.doc_id: r.component_id for r in S.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(fps))] == _components(fps, list(range(len(fps))))
