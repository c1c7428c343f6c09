import numpy as np

from spanpref.llm import covertree as C


def _cloud(rng, n, dim=16):
    centres = rng.normal(size=(max(2, n // 12), dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.05, 0.6], n)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_tree_levels_cover():
    x = _cloud(np.random.default_rng(0), 500)
    tree = C.Tree(x)
    for k, rows in enumerate(tree.rows):
        far = np.linalg.norm(x[rows] - x[tree.centre[k]], axis=1)
        assert far.max() <= tree.radius[k] + 1e-7
        if tree.children[k]:
            assert sorted(np.concatenate([tree.rows[c] for c in tree.children[k]])) == sorted(rows)


def test_dual_traversal_finds_every_pair():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x, y = _cloud(rng, 400), _cloud(rng, 150)
        y[:40] = x[:40]
        want = {(i, j) for i, j in zip(*np.nonzero(x @ y.T >= 0.98))}
        i, j = C.links(C.Tree(x), C.Tree(y), 0.98, False)
        assert len(i) == len(want) and set(zip(i, j)) == want
        want = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero(x @ x.T >= 0.98)) if i != j}
        i, j = C.links(C.Tree(x), C.Tree(x), 0.98, True)
        assert len(i) == len(want) and {(min(a, b), max(a, b)) for a, b in zip(i, j)} == want


def test_rows_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "NODE_ROWS", 24)
    monkeypatch.setattr(C, "FANOUT", 3)
    monkeypatch.setattr(C, "CHUNK_ROWS", 40)
    rng = np.random.default_rng(7)
    x = _cloud(rng, 300, 8) * rng.uniform(0.1, 9, 300)[:, None]
    rows = [(i, v.tolist(), int(rng.random() < 0.3)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(20)]  # copies
    odd = [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [], 1), (2004, [None, 1.0], 1), (2005, rows[0][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    frame = spark.createDataFrame([(*r, 0, "q") for r in rows + odd], "vec_id long, embedding array<double>, label int, n long, x string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(frame).collect()}
    every = rows + odd[-2:]
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in every]
    near = [[j for j in range(len(every)) if j != i and every[i][2] == every[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(every))]
    comp = {}
    for i in sorted(range(len(every)), key=lambda k: every[k][0]):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = every[i][0]
                todo += near[k]
    for i, (vec, _, _) in enumerate(every):
        assert got[vec] == (len(near[i]), comp[i], comp[i] == vec)
    for vec, _, _ in odd[:-2]:
        assert got[vec] == (0, vec, True)
    assert C.near_duplicates(frame.limit(0)).count() == 0


def _frame(spark, x):
    return spark.createDataFrame([(1, x.shape[1], v.tolist(), i, 1) for i, v in enumerate(x)], "label int, dim int, x array<double>, class long, n long")


def test_levels_prune_pairs_of_clustered_nodes(spark, monkeypatch):
    """Tight clusters in one label: most node pairs are pruned, and a vector's copies don't grow with the rows."""
    monkeypatch.setattr(C, "NODE_ROWS", 40)
    monkeypatch.setattr(C, "FANOUT", 8)
    reach = float(np.sqrt(0.04)) + 1e-7
    copies = []
    for n in (600, 2400):
        rng = np.random.default_rng(3)
        centres = rng.normal(size=(50, 64))
        x = centres[rng.integers(0, 50, n)] + rng.normal(size=(n, 64)) * 0.02
        x /= np.linalg.norm(x, axis=1)[:, None]
        frame = _frame(spark, x)
        placed, leaves, pairs = C._levels(frame, reach)
        k = leaves.count()
        assert k > 15 and pairs.count() < 0.35 * k * (k + 1) / 2
        seen = {r.node: (np.array(r.centre), r.radius) for r in leaves.collect()}
        rows = placed.collect()
        assert sorted(r["class"] for r in rows) == list(range(n))
        for r in rows:
            centre, radius = seen[r.node]
            assert np.linalg.norm(np.array(r.x) - centre) <= radius + 1e-7
        copies.append(C._met(frame, reach).count() / n)
    assert copies[1] < 1.5 * copies[0] + 1


def test_nodes_that_cannot_be_split_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "NODE_ROWS", 10)
    rng = np.random.default_rng(5)
    x = np.ones((45, 4)) / 2 + rng.normal(size=(45, 4)) * 1e-9
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert {(r.n_links, r.component_id) for r in C.near_duplicates(frame).collect()} == {(44, 0)}
