"""Negative generator: properties and closed-form distributions (SURVEY section 5 (4)-(5))."""

import random

import pytest
from pyspark.sql import functions as F

from spanpref.functions import vocab
from spanpref.operators import negatives as N
from spanpref.operators import pairs as P

SCHEMA = "ex_id long, query string, answer string, gold array<struct<code:string,sub_code:string,span:string>>"
CONF = "model string, kind string, gt string, pred string, cnt long"


def _conf(spark):
    rows = [
        ("m", "code", "SDOH", "PartnershipPatient", 3), ("m", "code", "PartnershipPatient", "SDOH", 2),
        ("m", "code", "PartnershipProvider", "PartnershipPatient", 5), ("m", "code", "SDOH", "SDOH", 7),
        ("m", "sub_code", "EconomicStability", "HealthCareAccessAndQuality", 4),
        ("m", "sub_code", "EconomicStability", "salutation", 2),
        ("m", "sub_code", "salutation", "signoff", 5), ("m", "sub_code", "signoff", "connection", 1),
    ]
    return spark.createDataFrame(rows, CONF)


def _gold(spark, n=400, seed=1):
    rng = random.Random(seed)
    pairs = vocab.hierarchy_pairs()
    rows = []
    for i in range(n):
        k = rng.randint(0, 3)
        g = [(c, s, f"w{rng.randint(0, 9)} w{j}") for c, s in rng.sample(pairs, k) for j in [rng.randint(0, 3)]]
        rows.append((i, "Current sentence: s", "{}", g))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def generated(spark):
    gold = _gold(spark)
    dims = N.confusion_dims(_conf(spark))
    params = N.GeneratorParams(negatives_per_sample=3)
    neg = N.generate_negatives(gold, dims, params=params)
    return gold, dims, params, neg, {(r.ex_id, r.neg_idx): (r.strategy, r.rejected) for r in neg.collect()}


def test_partition_independent(spark, generated):
    gold, dims, params, _, base = generated
    for n in (1, 7):
        again = N.generate_negatives(gold.repartition(n), dims, params=params)
        assert {(r.ex_id, r.neg_idx): (r.strategy, r.rejected) for r in again.collect()} == base


def test_always_different_and_sizes(generated):
    gold, _, _, neg, _ = generated
    rows = neg.select("gold", "rejected", "strategy", N.identical(F.col("gold"), F.col("rejected")).alias("same")).collect()
    assert rows and not any(r.same for r in rows)
    for r in rows:
        assert len(r.rejected) - len(r.gold) in (-1, 0, 1)


def test_generated_pairs_valid(generated):
    _, _, _, neg, _ = generated
    for r in neg.collect():
        if r.strategy.startswith("forced") or r.strategy == "extra_annotation":
            continue
        for a in r.rejected:
            assert vocab.CODE_SUBCODES.get(a.code) is not None and a.sub_code in vocab.CODE_SUBCODES[a.code], r


def test_empty_gold_spurious(generated):
    _, _, _, neg, _ = generated
    for r in neg.where(F.size("gold") == 0).collect():
        assert r.strategy == "spurious_annotation"
        assert len(r.rejected) == 1 and r.rejected[0].span == "spurious annotation"
        assert r.rejected[0].code in {"SDOH", "PartnershipPatient", "PartnershipProvider"}


def test_weights_sum_to_one(spark):
    w = N.confusion_dims(_conf(spark)).first()
    assert w.bag == ["SDOH", "PartnershipPatient", "PartnershipPatient"]
    assert w.gt_codes == ["PartnershipPatient", "PartnershipProvider", "SDOH"]
    assert [x.pred for x in w.sub_conf["EconomicStability"]] == ["HealthCareAccessAndQuality", "salutation"]


def _strategy_freqs(spark, gold_row, conf_rows, n_neg=20000):
    gold = spark.createDataFrame([gold_row], SCHEMA)
    dims = N.confusion_dims(spark.createDataFrame(conf_rows, CONF))
    neg = N.generate_negatives(gold, dims, params=N.GeneratorParams(negatives_per_sample=n_neg))
    c = {r.strategy: r["count"] / n_neg for r in neg.groupBy("strategy").count().collect()}
    return c, neg


def test_closed_form_only_extra(spark):
    # single annotation with no confusion data: only "extra" is eligible
    row = (1, "q", "{}", [("SDOH", "SocialAndCommunityContext", "a b c")])
    c, _ = _strategy_freqs(spark, row, [("m", "code", "PartnershipPatient", "SDOH", 1)])
    assert abs(c["extra_annotation"] - 0.7215) < 0.015
    forced = sum(v for k, v in c.items() if k.startswith("forced"))
    assert abs(forced - 0.2785) < 0.015


def test_closed_form_missing_extra(spark):
    row = (1, "q", "{}", [("SDOH", "SocialAndCommunityContext", "a"), ("SDOH", "EducationAccessAndQuality", "b")])
    c, _ = _strategy_freqs(spark, row, [("m", "code", "PartnershipPatient", "SDOH", 1)])
    assert abs(c["missing_annotation"] - 0.3571) < 0.015
    assert abs(c["extra_annotation"] - 0.5356) < 0.015
    assert abs(c.get("forced_missing_annotation", 0) - 0.1074) < 0.015


def test_subcode_draw_adjusted(spark):
    # v1 .5, v2 .2 valid for SDOH; x1 .2, x2 .1 invalid -> .65 / .35
    conf = [("m", "sub_code", "EconomicStability", p, c) for p, c in
            [("HealthCareAccessAndQuality", 5), ("SocialAndCommunityContext", 2), ("salutation", 2), ("signoff", 1)]]
    row = (1, "q", "{}", [("SDOH", "EconomicStability", "a")])
    c, neg = _strategy_freqs(spark, row, conf, 20000)
    sub = neg.where(F.col("strategy") == "subcode_confusion").select(F.col("rejected")[0]["sub_code"].alias("s"))
    counts = {r.s: r["count"] for r in sub.groupBy("s").count().collect()}
    tot = sum(counts.values())
    assert abs(counts["HealthCareAccessAndQuality"] / tot - 0.65) < 0.02
    assert abs(counts["SocialAndCommunityContext"] / tot - 0.35) < 0.02


def test_pairs_reports(spark, generated):
    _, _, params, neg, _ = generated
    pairs = P.assemble_pairs(neg, params)
    rep = P.identical_filter_report(pairs).first()
    assert rep.removed == 0 and rep.kept == rep.total
    d = P.strategy_distribution(pairs).collect()
    assert abs(sum(r.pct for r in d) - 100.0) < 1e-6
    prev = P.preview(pairs, 3).collect()
    assert len(prev) == 3 and [r.sample for r in sorted(prev, key=lambda r: r.sample)] == [1, 2, 3]


def test_models_without_confusions_keep_their_negatives(spark):
    gold = _gold(spark, n=20)
    models = spark.createDataFrame([("m",), ("perfect",)], "model string")
    for dims in (N.confusion_dims(_conf(spark), models), N.confusion_dims(_conf(spark).limit(0), models)):
        neg = N.generate_negatives(gold, dims)
        per = {r.model: r["count"] for r in neg.groupBy("model").count().collect()}
        assert per == {"m": 20, "perfect": 20}
    strategies = {r.strategy for r in neg.where("model = 'perfect'").collect()}
    assert strategies and not strategies & {"code_confusion", "subcode_confusion", "extra_annotation"}
    named = N.generate_negatives(gold, N.confusion_dims(_conf(spark)), models=["perfect"])
    assert {r.model for r in named.collect()} == {"perfect"} and named.count() == 20
    assert N.generate_negatives(gold, N.confusion_dims(_conf(spark).limit(0))).count() == 0


def test_foreign_labels_never_enter_the_dimensions(spark):
    conf = spark.createDataFrame([("m", "code", "NoSuchCode", "SDOH", 4)], "model string, kind string, gt string, pred string, cnt long")
    assert N.confusion_dims(conf).count() == 0


def test_confusions_outside_the_vocabulary_are_counted(spark):
    a, b = sorted(vocab.CODE_SET)[:2]
    rows = [("m", "code", a, b, 2), ("m", "code", a, vocab.NONE_TOKEN, 3), ("m", "code", "Other", "Other", 1), ("m", "code", a, "Foreign", 4), ("m", "sub_code", "X", "Y", 5), ("m", "code", "Foreign", b, 6)]
    got = sorted(tuple(r) for r in N.unknown_confusions(spark.createDataFrame(rows, CONF)).collect())
    assert got == [("m", "code", 2, 10), ("m", "sub_code", 1, 5)]


def test_gold_that_cannot_be_used_is_quarantined(spark):
    rows = [(1, "q", '{"results":[{"Code":"SDOH","Sub-code":"EconomicStability","Span":"a"}]}'), (2, "q", '{"results":[{"Code":"SD'),
            (3, "q", '{"results":null}'), (4, "q", "[]"), (5, "q", None), (6, "q", '{"results":{}}'), (7, "q", '{"results":[]} x'), (8, "q", '{"results":[]}')]
    valid, bad = N.parse_gold(spark.createDataFrame(rows, "ex_id long, query string, answer string"))
    assert sorted(r.ex_id for r in valid.collect()) == [1, 8]
    assert {r.ex_id: r.reason for r in bad.collect()} == {2: "invalid_json", 3: "results_not_a_list", 4: "results_not_a_list", 5: "invalid_json", 6: "results_not_a_list", 7: "invalid_json"}


def test_labels_outside_the_hierarchy_are_flagged(spark, generated):
    _, _, params, neg, _ = generated
    pairs = P.assemble_pairs(neg, params)
    for r in pairs.collect():
        assert r.valid_labels == all(a.sub_code in vocab.CODE_SUBCODES.get(a.code, ()) for a in r.rejected_annotations)
    report = {r.strategy: r for r in P.validity_report(pairs).collect()}
    assert sum(r.n_pairs for r in report.values()) == pairs.count()
    forced = N.generate_negatives(_gold(spark, 30), N.confusion_dims(_conf(spark).limit(0), spark.createDataFrame([("m",)], "model string")))
    flags = {r.strategy: r.valid_labels for r in P.assemble_pairs(forced).collect()}
    assert flags["forced_code_change"] is False and flags["spurious_annotation"] is False


def test_every_forced_branch(spark):
    """G8 with no strategy to draw, by its rules written out."""
    gold = _gold(spark, 200, seed=4)
    off = N.GeneratorParams(strategies=tuple((s, 0) for s, _ in N.STRATEGIES))
    dims = N.confusion_dims(_conf(spark))
    sub_conf = dims.first().sub_conf
    seen = set()
    for r in N.generate_negatives(gold, dims, params=off).collect():
        g = [tuple(a) for a in r.gold]
        if not g:
            want = "spurious_annotation", None
        elif len(g) > 1:
            want = "forced_missing_annotation", g[:-1]
        else:
            (code, sub, span), = g
            valid = [x.pred for x in sub_conf.get(sub, []) if x.pred in vocab.CODE_SUBCODES.get(code, ())]
            want = ("forced_subcode_change", [(code, valid[0], span)]) if valid else ("forced_code_change", [(vocab.FALLBACK_CODE, vocab.FALLBACK_SUB_CODE, span)])
        assert r.strategy == want[0] and (want[1] is None or [tuple(a) for a in r.rejected] == want[1])
        seen.add(r.strategy)
    assert seen == {"spurious_annotation", "forced_missing_annotation", "forced_subcode_change", "forced_code_change"}


def test_dimensions_are_in_no_explode(spark):
    neg = N.generate_negatives(_gold(spark, 5), N.confusion_dims(_conf(spark)), params=N.GeneratorParams(negatives_per_sample=2))
    plan = neg._jdf.queryExecution().optimizedPlan().toString()
    fans = [line for line in plan.splitlines() if "Generate explode" in line]
    assert plan.count("g4gate") <= 3  # the negatives are written out once
    assert len(fans) == 1 and not any(name in line for line in fans for name in ("sub_conf", "code_conf", "bag", "gt_codes", "dim"))


def test_ranking_and_previews(spark, generated):
    _, _, params, neg, _ = generated
    pairs = P.assemble_pairs(neg, params)
    ranked = P.strategy_ranking(pairs).collect()
    assert [r.place for r in ranked] == list(range(1, len(ranked) + 1))
    assert [(-r["count"], r.strategy) for r in ranked] == sorted((-r["count"], r.strategy) for r in ranked)
    full = {r.pair_id: r for r in pairs.collect()}
    for r in P.text_previews(pairs).collect():
        c, j = ([tuple(a) for a in x] for x in (full[r.pair_id].gold, full[r.pair_id].rejected_annotations))
        assert r.chosen_300 == full[r.pair_id].chosen[:300] and r.rejected_spans_70 == "|".join(a[2][:70] for a in j)
        assert r.added_spans_50 == "|".join(a[2][:50] for a in sorted(set(j) - set(c)))
        assert r.removed_spans_50 == "|".join(a[2][:50] for a in sorted(set(c) - set(j)))
        assert r.changed_spans_40 == "|".join(a[2][:40] for a in c if any(b[2] == a[2] and b[:2] != a[:2] for b in j))
