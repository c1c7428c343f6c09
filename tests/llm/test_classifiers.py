import random

import numpy as np
import pytest

from spanpref.llm import quality, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common, rude = [f"w{i}" for i in range(400)], [f"zork{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(1200):
        toxic, good = rng.random() < 0.12, rng.random() < 0.8
        words = [rng.choice(common) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        if not good:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "en", "src", 0))
        labels.append((i, int(good), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_rows(corpus):
    docs, labels = corpus
    out = toxicity.result(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 200
    assert ((held["predicted"] == 1) == (held["toxic"] == 1)).mean() > 0.98
    assert ((out["predicted"] == 1) == (out["score"] >= 0.3)).all() and out["score"].between(0, 1).all()
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int((out["predicted"] == 0).sum())


def test_held_out_labels_change_nothing(corpus):
    from pyspark.sql import functions as F

    docs, labels = corpus
    other = labels.withColumn("toxic", F.when(toxicity.id_remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, other))
    assert a.weights == b.weights and a.bias == b.bias


def test_label_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.2
    first = np.where(rng.random(n) < 0.9, y, ~y)
    votes = np.stack([first, first ^ (rng.random(n) < 0.02), np.where(rng.random(n) < 0.8, y, ~y), np.where(rng.random(n) < 0.85, y, ~y)], axis=1)
    code = (votes * (1 << np.arange(4))).sum(axis=1)
    label = np.where(rng.random(n) < 0.1, y.astype(int), -1)
    keys, counts = np.unique(np.stack([code, label], axis=1), axis=0, return_counts=True)
    model = toxicity.LabelModel(4).fit(keys[:, 0], keys[:, 1], counts)
    assert 1 in (model.parent[0], *[j for j in range(4) if model.parent[j] == 0]) or model.parent[1] == 0
    assert ((model.posterior(code, np.full(n, -1)) > 0.5) == y).mean() > 0.92


@pytest.mark.parametrize("seed", range(4))
def test_posterior_by_enumeration(seed):
    """The label model's posterior against the joint probability of both classes, factor by factor."""
    rng = np.random.default_rng(seed)
    m = int(rng.integers(3, 5))
    model = toxicity.LabelModel(m)
    model.parent = [-1] + [int(rng.integers(-1, j)) for j in range(1, m)]
    model.prior = rng.dirichlet([1, 1])
    model.fires = rng.uniform(0.05, 0.95, (m, 2, 2))
    model.says = rng.dirichlet([1, 1], 2)
    for votes in range(1 << m):
        for label in (-1, 0, 1):
            joint = []
            for y in (0, 1):
                p = model.prior[y] * (1.0 if label < 0 else model.says[y][label])
                for j in range(m):
                    up = votes >> model.parent[j] & 1 if model.parent[j] >= 0 else 0
                    chance = model.fires[j, y, up]
                    p *= chance if votes >> j & 1 else 1 - chance
                joint.append(p)
            got = model.posterior(np.array([votes]), np.array([label]))[0]
            assert abs(got - joint[1] / sum(joint)) < 1e-9


def test_families_are_beginnings_of_different_words():
    assert "+abcd" in toxicity.all_terms("abcdef x abcdxy") and "+abcd" not in toxicity.all_terms("abcdef abcdef abcd")
    voters = toxicity.Voters({"+abcd": 6, "=rude": 0})
    votes, found = voters.read("abcdef abcdxy! Rude")
    assert found == {"+abcd", "=rude"} and votes & 1 and votes >> 6 & 1
    assert voters.read("abcdef abcdef")[1] == set() and voters.read("You idiot")[1] == {"=idiot"}


def test_training_rows_vote_once(spark, corpus, monkeypatch):
    docs, labels = corpus
    seen = []
    count = toxicity.vote_counts
    monkeypatch.setattr(toxicity, "vote_counts", lambda rows, lexicon: seen.append(count(rows, lexicon)) or seen[-1])
    toxicity.fit(docs, labels.where("doc_id < 700"))
    assert len(seen) == 1 and seen[0]["n"].sum() == docs.where(toxicity.id_remainder(4) != 2).count()
    assert (seen[0]["label"] == -1).any() and (seen[0]["label"] == 1).any()


@pytest.mark.parametrize("op", [toxicity, quality])
def test_clashing_columns_of_labels(op, spark, corpus):
    from pyspark.sql import functions as F

    docs, labels = (t.limit(300) for t in corpus)
    extra = labels.select("*", F.lit("x").alias("text"), F.lit("y").alias("lang"), F.lit(3).alias("score"), F.lit(1).alias("labelled"))
    a, b = (sorted((r[0], round(r[2], 9)) for r in op.result(docs, x).collect()) for x in (labels, extra))
    assert a == b


@pytest.mark.parametrize("op", [toxicity, quality])
def test_messy_rows_and_missing_labels(op, messy, empty, labels, no_labels):
    for some in (labels, no_labels):
        assert op.result(messy, some).count() == messy.count()
        assert op.result(empty, some).count() == 0
        score = op.result(messy, some).toPandas()
        assert score.iloc[:, 2].notna().all()


def test_quality_on_held_out_rows(corpus):
    docs, labels = corpus
    out = quality.result(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert ((held["selected"] == 1) == (held["quality"] == 1)).mean() > 0.97


def test_three_grades_have_ordered_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, quality.SLOTS // 100)).astype(np.float32)
    z = 2 * x[:, 0] - x[:, 1] + rng.logistic(size=3000) * 0.3
    grade = np.digitize(z, [-1.0, 1.5])
    w, t = quality.fit_ordinal(x, grade, 3, rounds=600)
    assert t[0] < t[1]
    model = quality.Model(w, t, [1, 3, 5])
    p = model.grade_chances(x @ w)
    assert np.allclose(p.sum(axis=1), 1) and (p >= -1e-12).all()
    assert (p.argmax(axis=1) == grade).mean() > 0.8
