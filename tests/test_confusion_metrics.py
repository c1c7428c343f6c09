"""Confusion edges, weights, top-N and metric unit cases against brute force."""

import random
from collections import Counter
from itertools import product

from pyspark.sql import functions as F

from spanpref.operators import confusion, metrics
from spanpref.operators.evaluation_input import evaluation_table, unmatched_report


def _edges_py(pairs, include_none=False):
    out = Counter()
    for t, p in pairs:
        missed, added = sorted(set(t).difference(p)), sorted(set(p).difference(t))
        pad = ["__NONE__"] if include_none and (missed or added) else []
        out.update(product(missed or pad, added or pad))
    return dict(out)


def test_edges_cases(spark):
    pairs = [(["a", "b"], ["b", "c"]), (["a", "b"], ["c", "d"]), (["a"], []), ([], ["a"]), (["x"], ["x"])]
    df = spark.createDataFrame([("m", t, p) for t, p in pairs], "model string, t array<string>, p array<string>")
    for inc in (False, True):
        got = {(r.ground_truth, r.predicted): r["count"] for r in confusion.confusion_edges(df, "t", "p", include_none=inc).collect()}
        assert got == _edges_py(pairs, inc)


def test_edges_random_and_partition_independent(spark):
    rng = random.Random(7)
    labs = list("abcdef")
    pairs = [(rng.sample(labs, rng.randint(0, 3)), rng.sample(labs, rng.randint(0, 3))) for _ in range(300)]
    df = spark.createDataFrame([("m", t, p) for t, p in pairs], "model string, t array<string>, p array<string>")
    want = _edges_py(pairs)
    for n in (1, 7, 64):
        got = {(r.ground_truth, r.predicted): r["count"] for r in confusion.confusion_edges(df.repartition(n), "t", "p").collect()}
        assert got == want


def test_table_holds_both_levels(spark):
    rows = [("m", ["a", "b"], ["b", "c"], ["x"], []), ("m", ["a"], ["c"], ["x"], ["y", "z"])]
    df = spark.createDataFrame(rows, "model string, true_codes array<string>, pred_codes array<string>, true_subcodes array<string>, pred_subcodes array<string>")
    for inc in (False, True):
        got = {(r.kind, r.gt, r.pred): r.cnt for r in confusion.confusion_table(df, include_none=inc).collect()}
        want = {("code", *k): v for k, v in _edges_py([r[1:3] for r in rows], inc).items()} | {("sub_code", *k): v for k, v in _edges_py([r[3:5] for r in rows], inc).items()}
        assert got == want


def test_examples_without_prediction_are_missed(spark):
    ex = spark.createDataFrame([(1, '{"results":[{"Code":"SDOH","Sub-code":"x","Span":"s"}]}'), (2, '{"results":[]}')], "ex_id long, answer string")
    pr = spark.createDataFrame([("a", 1, "{}"), ("b", 1, "{}"), ("b", 2, "{}"), ("b", 9, "{}")], "model string, ex_id long, pred_text string")
    ev = evaluation_table(ex, pr)
    assert sorted((r.model, r.ex_id, r.pred_mode) for r in ev.collect()) == [("a", 1, "strict"), ("a", 2, "empty"), ("b", 1, "strict"), ("b", 2, "strict")]
    assert metrics.with_example_counts(ev).where("model = 'a' and ex_id = 1").first().span_fn == 1
    rep = {r.model: (r.no_prediction, r.no_example) for r in unmatched_report(ex, pr).collect()}
    assert rep == {"a": (1, 0), "b": (0, 1)}


def test_weights_and_top(spark):
    conf = spark.createDataFrame([("m", "code", "x", "p", 3), ("m", "code", "x", "q", 1), ("m", "code", "x", "x", 9)],
                                 "model string, kind string, gt string, pred string, cnt long")
    w = {r.pred: r.weight for r in confusion.confusion_weights(conf).collect()}
    assert w == {"p": 0.75, "q": 0.25}
    assert confusion.top_confusions(conf, top_n=1).count() == 0
    t = confusion.top_confusions(conf, top_n=2).collect()
    assert [(r.slot, r.pred, r.pct) for r in t] == [(2, "p", 75.0)]


def _span_tp_py(true, pred, thr=0.6):
    used = [False] * len(true)
    tp = 0
    for p in pred:
        for j, t in enumerate(true):
            if used[j]:
                continue
            a, b = set(t.lower().split()), set(p.lower().split())
            jac = len(a & b) / len(a | b) if a | b else 0
            if a <= b or b <= a or jac >= thr:
                used[j] = True
                tp += 1
                break
    return tp


def _span_df(spark, cases):
    rows = []
    for i, (t, p) in enumerate(cases):
        g = [("C", "S", s) for s in t]
        q = [("C", "S", s) for s in p]
        rows.append(("m", i, g, q))
    schema = "model string, ex_id int, gold_results array<struct<code:string,sub_code:string,span:string>>, pred_results array<struct<code:string,sub_code:string,span:string>>"
    return spark.createDataFrame(rows, schema)


def test_span_cases(spark):
    cases = [(["a b"], ["a"]), (["a b c d"], ["a b c e"]), (["a b c"], ["c d e"]), (["a"], ["a", "a"]),
             ([""], ["x"]), (["a b", "a"], ["a", "a b"]), ([], ["x"])]
    want_tp = [1, 1, 0, 1, 1, 2, 0]
    got = metrics.with_example_counts(_span_df(spark, cases)).orderBy("ex_id").collect()
    assert [r.span_tp for r in got] == want_tp
    assert got[3].span_fp == 1 and got[6].span_fp == 1


def test_span_random_vs_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e"]

    def span():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))

    cases = [([span() for _ in range(rng.randint(0, 4))], [span() for _ in range(rng.randint(0, 4))]) for _ in range(200)]
    got = metrics.with_example_counts(_span_df(spark, cases)).orderBy("ex_id").collect()
    assert [r.span_tp for r in got] == [_span_tp_py(t, p) for t, p in cases]


def test_code_prf_exact_case(spark):
    rows = [("m", 0, [("SDOH", "Clinical care", "x")], [("SDOH", "Clinical Care", "x")]),
            ("m", 1, [("SDOH", "x", "y"), ("SDOH", "x", "z")], [("sdoh", "x", "y")])]
    schema = "model string, ex_id int, gold_results array<struct<code:string,sub_code:string,span:string>>, pred_results array<struct<code:string,sub_code:string,span:string>>"
    c = metrics.with_example_counts(spark.createDataFrame(rows, schema))
    r = metrics.level_prf(c, "code").first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 1)
    s = metrics.level_prf(c, "sub_code").first()
    assert (s.tp, s.fp, s.fn) == (0, 1, 0)
    rep = {x.level: x for x in metrics.eval_report(c).collect()}
    assert rep["code"].p == 1.0 and rep["code"].r == 0.5
