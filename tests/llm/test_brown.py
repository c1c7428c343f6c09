import collections
import re
import zlib
from math import isclose, log10

import numpy as np

from spanpref.llm import brown as B


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) + ["\0end"]


def test_counts_and_base_by_brute_force(messy, empty):
    rows = messy.collect()
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            counts.update(_tokens(r.text or ""))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = _tokens(r.text or "")
        want.append((r.doc_id or -1, len(t), sum(counts[x] > 0 for x in t), n, sum(log10((counts[x] + 1) / (n + v + 1)) for x in t)))
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in B.score(messy).collect())
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4] and isclose(a[4], b[4], rel_tol=1e-9)
    assert B.score(empty).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    group = rng.integers(0, 3, 61)
    pairs = np.array([[50 if group[b] == (group[a] + 1) % 3 else 1 for b in range(61)] for a in range(61)], float)
    s = np.diag(pairs).copy()
    pairs -= np.diag(s)
    classes = np.concatenate([[0], 1 + np.arange(60) % 4])

    def counts(c):
        x = np.stack([pairs[:, c == k].sum(axis=1) for k in range(5)], axis=1)
        y = np.stack([pairs[c == k].sum(axis=0) for k in range(5)], axis=1)
        return x, y, B.likelihood(B.class_bigrams(x, s, c, 5))

    before = counts(classes)[2]
    ideal = counts(np.concatenate([[0], 1 + group[1:]]))[2]
    values = []
    for turn in range(B.SWEEPS):
        x, y, _ = counts(classes)
        classes = B.exchange(x, y, s, classes, 5, turn)
        values.append(counts(classes)[2])
    assert max(values) - before > 0.9 * (ideal - before)


def test_model_beats_unigrams_on_ordered_text(spark):
    rng = np.random.default_rng(1)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(x for _ in range(40) for x in (nouns[rng.integers(30)], verbs[rng.integers(30)]))) for i in range(120)]
    out = B.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert len(out) and (out["score"] > out["base_score"]).all()
    # two alternating classes: about one of 30 words at a time
    assert abs(out["score"].sum() / out["n_tokens"].sum() + log10(30)) < 0.1


def test_sweeps_go_on_until_they_add_little(spark):
    assert B.HEAD_BITS >= 15 and B.SWEEPS >= 9
    rng = np.random.default_rng(3)
    group = rng.integers(0, 12, 240)
    rows = [(a, b, int(30 if group[b] == (group[a] * 5 + 1) % 12 else rng.integers(0, 3))) for a in range(240) for b in rng.choice(240, 80, replace=False).tolist()]
    pairs = spark.createDataFrame([r for r in rows if r[2]], "a long, b long, n long").cache()
    classes, table = B.cluster(pairs, 240, 14)
    start = np.concatenate([[0], 1 + np.arange(239) % 13])
    x, y, s = B.neighbour_counts(pairs, start, 14)
    rise = B.likelihood(table) - B.likelihood(B.class_bigrams(x, s, start, 14))
    for turn in range(B.PARTS):
        x, y, s = B.neighbour_counts(pairs, classes, 14)
        classes = B.exchange(x, y, s, classes, 14, turn)
    x, y, s = B.neighbour_counts(pairs, classes, 14)
    assert B.likelihood(B.class_bigrams(x, s, classes, 14)) - B.likelihood(table) <= 0.02 * rise


def test_counts_come_to_the_driver_packed(spark):
    """The counts of a sweep, as few compressed rows, are those of a plain aggregation."""
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(n)) for a, b, n in rng.integers(0, 40, (600, 3)) + (0, 0, 1)] + [(0, 1, 1 << 40)]
    pairs = spark.createDataFrame(rows, "a long, b long, n long").groupBy("a", "b").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    classes = np.arange(40) % 7
    x, y, s = B.neighbour_counts(pairs, classes, 7)
    want_x, want_y, want_s = np.zeros((40, 7)), np.zeros((40, 7)), np.zeros(40)
    for a, b, n in rows:
        if a == b:
            want_s[a] += n
        else:
            want_x[a, classes[b]] += n
            want_y[b, classes[a]] += n
    assert (x == want_x).all() and (y == want_y).all() and (s == want_s).all()
    sums = spark.range(5000).selectExpr("id as u", "cast(id % 3 as int) as side", "cast(0 as int) as cls", "id * 7 as n").coalesce(1)
    place, n = (np.concatenate(v) for v in zip(*(B.unpacked(r["bytes"]) for r in B.packed(sums).collect())))
    assert (place // B.SLOTS).tolist() == list(range(5000)) and (n == 7 * np.arange(5000)).all()
    assert sum(len(r["bytes"]) for r in B.packed(sums).collect()) < 5000 * 24 / 4
    assert B.packed(sums.limit(0)).collect() == []
