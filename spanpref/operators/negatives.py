"""Targeted negative generation.

The reference draws a strategy, applies it and retries (up to 10 times)
until the result differs from the gold list, with one generator whose state
runs across all rows.  Here every row is independent:

* every random number is a keyed md5 draw of (seed, model, ex_id, neg_idx,
  purpose), so any partitioning, retry or recomputation gives the same rows;
* the retry loop is replaced by its closed form.  An eligible strategy always
  changes the list, so with W the summed weight of the eligible strategies
  the loop ends forced with probability (1-W)^10 and otherwise picks
  strategy s with probability w_s/W;
* a weighted pick among confusions uses integer counts (r = floor(u * total),
  first cumulative count > r), which is exact and engine-independent;
* G2's "weighted draw, and if the draw is invalid for the code a uniform
  valid one" collapses to p'(x) = w(x) + (1-W_valid)/n_valid over the valid
  confusions x;
* "first annotation with data in a shuffled order" is a uniform pick among
  the eligible positions.

The per-model confusion dimensions (bounded by the label vocabulary) are
computed once as a scalar subquery, so examples are never joined or shuffled.
Rows whose gold is not strict JSON with a ``results`` list go to a
quarantine table (F1, H15, H22) instead of crashing the run.

Differences from the reference, by design: exact draw sequences differ (the
reference's generator is sequential); the forced path does not mutate the gold
list shared with later negatives (H14); ``__NONE__`` never enters the
dimensions (H16); a gold list with duplicate triples that a draw leaves
F4-identical takes the forced path instead of retrying.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanpref.functions import vocab
from spanpref.functions.draws import draw, let
from spanpref.functions.jsonish import ANNOTATION_TYPE, with_parsed
from spanpref.functions.text import corrupt_span

# ---- fixed values: strategy mix (weights per 100 draws), in draw order -------
STRATEGIES = (
    ("code_confusion", 25),
    ("subcode_confusion", 35),
    ("code_and_subcode_confusion", 20),
    ("missing_annotation", 8),
    ("extra_annotation", 12),
)
MAX_ATTEMPTS = 10
SECOND_CONFUSION_GATE = 0.4
SPURIOUS_SPAN = "spurious annotation"

CONF_TYPE = "array<struct<pred:string,cnt:bigint>>"


@dataclass
class GeneratorParams:
    seed: int = 42
    negatives_per_sample: int = 1
    strategies: tuple = field(default=STRATEGIES)
    max_attempts: int = MAX_ATTEMPTS


# ---------------------------------------------------------------- dimensions
def unknown_confusions(conf: DataFrame) -> DataFrame:
    """What ``confusion_dims`` leaves out for labels not in the vocabulary: ``(model, kind, n_rows, n_count)``.

    The ``__NONE__`` token is left out by design (H16) and not counted here.
    """
    code = F.col("kind") == "code"

    def foreign(c):
        known = F.when(code, F.col(c).isin(*vocab.CODE_SET)).otherwise(F.col(c).isin(*vocab.SUB_CODE_SET))
        return ~known & (F.col(c) != vocab.NONE_TOKEN)

    off = conf.where((F.col("gt") != F.col("pred")) & (F.col("cnt") > 0) & (foreign("gt") | foreign("pred")))
    return off.groupBy("model", "kind").agg(F.count("*").alias("n_rows"), F.sum("cnt").alias("n_count"))


def confusion_dims(conf: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One row per model: ``sub_conf``/``code_conf`` (MAP gt -> ordered
    ARRAY<pred, cnt>, weight desc then pred), ``bag`` (X4: preds of all code
    edges with multiplicity, ordered by gt, pred) and ``gt_codes`` (sorted).

    Only off-diagonal rows with a positive count are used (F5, H22), and only
    labels of the vocabulary (mined tables hold no others; a foreign CSV may, see
    ``unknown_confusions``), so
    a model's dimensions are bounded by the vocabulary squared.  This leaves out
    the ``__NONE__`` token (H16).  With ``models (model)`` every model there has
    a row; one without confusions has null dimensions, which count as empty.
    """
    code = F.col("kind") == "code"

    def known(c):
        return F.when(code, F.col(c).isin(*vocab.CODE_SET)).otherwise(F.col(c).isin(*vocab.SUB_CODE_SET))

    off = conf.where((F.col("gt") != F.col("pred")) & (F.col("cnt") > 0) & known("gt") & known("pred"))
    per_gt = off.groupBy("model", "kind", "gt").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("neg"), F.col("pred")))),
            lambda x: F.struct(x["pred"].alias("pred"), (-x["neg"]).alias("cnt")),
        ).alias("lst")
    )
    entry = F.struct(F.col("gt"), F.col("lst"))
    dims = per_gt.groupBy("model").agg(
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("kind") == "sub_code", entry)), lambda e: e.isNotNull())).alias("sub_conf"),
        F.map_from_entries(F.filter(F.collect_list(F.when(F.col("kind") == "code", entry)), lambda e: e.isNotNull())).alias("code_conf"),
    ).select(
        "model",
        "sub_conf",
        "code_conf",
        F.flatten(
            F.transform(
                F.array_sort(F.map_keys("code_conf")),
                lambda g: F.array_sort(F.transform(F.element_at("code_conf", g), lambda x: x["pred"])),
            )
        ).alias("bag"),
        F.array_sort(F.map_keys("code_conf")).alias("gt_codes"),
    )
    return dims if models is None else models.join(dims, "model", "left")


# ---------------------------------------------------------------- helpers
def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sum_cnt(lst: Column) -> Column:
    return F.aggregate(lst, F.lit(0).cast("bigint"), lambda acc, x: acc + x["cnt"])


def _weighted_pick(lst: Column, weight, total: Column, u: Column) -> Column:
    """First element whose cumulative integer weight exceeds floor(u * total)."""
    r = F.floor(u * total)
    init = F.struct(F.lit(0).cast("bigint").alias("acc"), F.lit(None).cast("string").alias("hit"))
    return F.aggregate(
        lst,
        init,
        lambda st, x: F.struct(
            (st["acc"] + weight(x)).alias("acc"),
            F.coalesce(st["hit"], F.when(st["acc"] + weight(x) > r, x["pred"])).alias("hit"),
        ),
        lambda st: st["hit"],
    )


def _pick(arr: Column, u: Column) -> Column:
    return F.get(arr, F.floor(u * F.size(arr)).cast("int"))


def _replace_at(arr: Column, k: Column, code: Column, sub: Column) -> Column:
    return F.transform(
        arr,
        lambda a, i: F.when(
            i == k, F.struct(code.alias("code"), sub.alias("sub_code"), a["span"].alias("span"))
        ).otherwise(a),
    )


def _valid_confusions(code: Column, sub: Column, sub_conf: Column) -> Column:
    lst = F.coalesce(F.try_element_at(sub_conf, sub), F.array().cast(CONF_TYPE))
    return F.filter(lst, lambda x: vocab.is_valid_pair(code, x["pred"]))


def _sub_eligible_positions(arr: Column, sub_conf: Column) -> Column:
    return F.filter(
        F.transform(arr, lambda a, i: F.when(F.size(_valid_confusions(a["code"], a["sub_code"], sub_conf)) > 0, i)),
        lambda i: i.isNotNull(),
    )


def subcode_confusion(arr: Column, positions: Column, sub_conf: Column, u_pos: Column, u_lab: Column) -> Column:
    """G2 on ``arr`` given its eligible positions (NULL when there are none)."""

    def at(k):
        def with_a(a):
            lst = F.coalesce(F.try_element_at(sub_conf, a["sub_code"]), F.array().cast(CONF_TYPE))

            def with_lst(lst):
                valid = F.filter(lst, lambda x: vocab.is_valid_pair(a["code"], x["pred"]))

                def with_valid(valid):
                    stats = F.struct(
                        F.size(valid).cast("bigint").alias("nv"),
                        _sum_cnt(lst).alias("tot"),
                        (_sum_cnt(lst) - _sum_cnt(valid)).alias("rest"),
                    )
                    return let(
                        stats,
                        lambda s: _replace_at(
                            arr, k, a["code"],
                            _weighted_pick(valid, lambda x: s["nv"] * x["cnt"] + s["rest"], s["tot"] * s["nv"], u_lab),
                        ),
                    )

                return let(valid, with_valid)

            return let(lst, with_lst)

        return let(F.get(arr, k), with_a)

    return F.when(F.size(positions) > 0, let(_pick(positions, u_pos), at))


def code_confusion(arr: Column, positions: Column, code_conf: Column, u_pos: Column, u_lab: Column, u_sub: Column) -> Column:
    """G3 on ``arr`` given its eligible positions (NULL when there are none)."""

    def at(k):
        def with_a(a):
            def with_lst(lst):
                def with_code(c):
                    new_sub = F.when(vocab.is_valid_pair(c, a["sub_code"]), a["sub_code"]).otherwise(
                        _pick(vocab.subs_or_fallback(c), u_sub)
                    )
                    return _replace_at(arr, k, c, new_sub)

                return let(_weighted_pick(lst, lambda x: x["cnt"], _sum_cnt(lst), u_lab), with_code)

            return let(F.try_element_at(code_conf, a["code"]), with_lst)

        return let(F.get(arr, k), with_a)

    return F.when(F.size(positions) > 0, let(_pick(positions, u_pos), at))


def identical(a: Column, b: Column) -> Column:
    """same length and same *set* of (code, sub_code, span) triples."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


# ---------------------------------------------------------------- generator
def parse_gold(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``; gold must be strict JSON with a ``results`` list (no repair)."""
    p = with_parsed(examples, "answer", "gold", repair=False)
    ok = F.col("gold_strict") & F.col("gold_results").isNotNull()
    valid = p.where(ok).select("ex_id", "query", "answer", F.col("gold_results").alias("gold"))
    bad = p.where(~ok).select(
        "ex_id",
        "answer",
        F.when(~F.col("gold_strict"), F.lit("invalid_json")).otherwise(F.lit("results_not_a_list")).alias("reason"),
    )
    return valid, bad


def all_dims(dims: DataFrame) -> Column:
    """Scalar subquery: ``MAP<model, STRUCT<sub_conf, code_conf, bag, gt_codes>>``.

    Its size is bounded by (#models x label vocabulary); it is computed once per
    query and rides along every row as a constant (no join, no shuffle of examples).
    """
    entry = F.struct(F.col("model"), F.struct("sub_conf", "code_conf", "bag", "gt_codes"))
    return dims.select(F.map_from_entries(F.collect_list(entry))).scalar()


def generate_negatives(gold: DataFrame, dims: DataFrame, models: list[str] | None = None,
                       params: GeneratorParams = GeneratorParams()) -> DataFrame:
    """One row per (model, ex_id, neg_idx) with ``rejected`` and ``strategy``.

    ``gold``: (ex_id, query, answer, gold ARRAY<STRUCT<code, sub_code, span>>).
    ``dims``: :func:`confusion_dims`, one row per model; ``models`` restricts the
    models generated for (default: every model in ``dims``); one of them that has
    no dimensions still gets its missing, spurious and forced negatives.  Examples fan out to
    models and negatives in-row, so gold is read and parsed once; the dimensions are a
    constant each row reads its model's entry of, and are in no explode's output.
    """
    if models is not None:
        wanted = dims.sparkSession.createDataFrame([(m,) for m in models], "model string")
        dims = wanted.join(dims, "model", "left")
    empty_map = F.create_map().cast(f"map<string,{CONF_TYPE}>")
    # the constant is read once a row, and the negatives of all models are made there: what they were
    # drawn from goes through no explode
    df = gold.select("ex_id", "query", "answer", "gold", all_dims(dims).alias("dims"))

    def of_model(entry):
        dim = F.struct(
            F.coalesce(entry["value"]["sub_conf"], empty_map).alias("sub_conf"),
            F.coalesce(entry["value"]["code_conf"], empty_map).alias("code_conf"),
            F.coalesce(entry["value"]["bag"], F.array().cast("array<string>")).alias("bag"),
            F.coalesce(entry["value"]["gt_codes"], F.array().cast("array<string>")).alias("gt_codes"),
        )
        return let(dim, lambda d: _made(entry["key"], d, params))

    made = F.flatten(F.transform(F.map_entries("dims"), of_model))
    # the outer form: a plain explode infers a filter on the size, which would make them twice
    df = df.select("ex_id", "query", "answer", "gold", made.alias("made")).select("ex_id", "query", "answer", "gold", F.explode_outer("made").alias("n"))
    return df.where(F.col("n").isNotNull()).select(
        F.col("n.model").alias("model"),
        "ex_id",
        F.col("n.neg_idx").alias("neg_idx"),
        "query",
        "answer",
        "gold",
        F.col("n.rejected").alias("rejected"),
        F.col("n.strategy").alias("strategy"),
    )


def _made(model: Column, dim: Column, params: GeneratorParams) -> Column:
    """All negatives of an example for a model, ``ARRAY<STRUCT<model, neg_idx, rejected, strategy>>``, from the model's bound dimensions."""
    code_conf = dim["code_conf"]
    # eligibility does not depend on the negative index
    code_pos = F.filter(
        F.transform(F.col("gold"), lambda a, i: F.when(F.coalesce(F.size(F.try_element_at(code_conf, a["code"])), F.lit(0)) > 0, i)),
        lambda i: i.isNotNull(),
    )
    places = F.struct(_sub_eligible_positions(F.col("gold"), dim["sub_conf"]).alias("sub"), code_pos.alias("code"))
    return let(places, lambda pos: _drawn(model, dim, pos["code"], pos["sub"], params))


def _drawn(model: Column, dim: Column, code_pos: Column, sub_pos: Column, params: GeneratorParams) -> Column:
    n = F.size("gold")
    elig = {
        "code_confusion": F.size(code_pos) > 0,
        "subcode_confusion": F.size(sub_pos) > 0,
        "code_and_subcode_confusion": (F.size(code_pos) > 0) | (F.size(sub_pos) > 0),
        "missing_annotation": n > 1,
        "extra_annotation": F.size(dim["bag"]) > 0,
    }
    weights = F.struct(*[F.when(elig[s], F.lit(w)).otherwise(F.lit(0)).alias(s) for s, w in params.strategies])
    names = [s for s, _ in params.strategies]
    return let(weights, lambda w: let(sum(w[s] for s in names), lambda total: _weighed(model, dim, code_pos, sub_pos, w, total, params)))


def _weighed(model: Column, dim: Column, code_pos: Column, sub_pos: Column, weight: Column, total_w: Column, params: GeneratorParams) -> Column:
    seed, g = params.seed, F.col("gold")
    n = F.size("gold")
    sub_conf, code_conf, bag, gt_codes = (dim[c] for c in ("sub_conf", "code_conf", "bag", "gt_codes"))
    names = [s for s, _ in params.strategies]

    purposes = ("gate", "pick", "pos", "lab", "sub", "g4gate", "pos2", "lab2", "miss", "x1", "x2", "x3", "sp1", "sp2")

    def draws(k):
        return F.struct(*[draw(seed, model, F.col("ex_id"), k, p).alias(p) for p in purposes])

    has_code = F.size(code_pos) > 0

    # closed form of the retry loop: P(forced) = ((100 - W) / 100) ^ max_attempts
    p_fail = (F.lit(100) - total_w).cast("double") / F.lit(100.0)
    q = p_fail
    for _ in range(params.max_attempts - 1):
        q = q * p_fail

    def pick_strategy(u):
        r = F.floor(u["pick"] * total_w)
        cum = F.lit(0)
        chosen = None
        for s in names:
            cum = cum + weight[s]
            cond = (weight[s] > 0) & (cum > r)
            chosen = F.when(cond, F.lit(s)) if chosen is None else chosen.when(cond, F.lit(s))
        return F.when(n == 0, F.lit("spurious_annotation")).when(u["gate"] < q, F.lit("forced")).otherwise(chosen)

    def candidate(u, drawn):
        g3 = code_confusion(g, code_pos, code_conf, u["pos"], u["lab"], u["sub"])
        g2 = subcode_confusion(g, sub_pos, sub_conf, u["pos"], u["lab"])
        miss = F.filter(g, lambda a, i: i != F.floor(u["miss"] * n))
        extra = let(
            _pick(bag, u["x1"]),
            lambda xc: F.concat(
                g,
                F.array(
                    F.struct(
                        xc.alias("code"),
                        _pick(vocab.subs_or_fallback(xc), u["x2"]).alias("sub_code"),
                        corrupt_span(_pick(g, u["x3"])["span"]).alias("span"),
                    )
                ),
            ),
        )
        spurious = let(
            F.coalesce(_pick(gt_codes, u["sp1"]), F.lit(vocab.FALLBACK_CODE)),
            lambda sc: F.array(
                F.struct(
                    sc.alias("code"),
                    F.when(F.size(gt_codes) > 0, _pick(vocab.subs_or_fallback(sc), u["sp2"]))
                    .otherwise(F.lit(vocab.FALLBACK_SUB_CODE))
                    .alias("sub_code"),
                    F.lit(SPURIOUS_SPAN).alias("span"),
                )
            ),
        )
        # After a code change, with probability 0.6 also a sub-code change on the new list
        g4 = let(
            g3,
            lambda c1: F.when(
                u["g4gate"] > SECOND_CONFUSION_GATE,
                let(
                    _sub_eligible_positions(c1, sub_conf),
                    lambda pos2: F.coalesce(subcode_confusion(c1, pos2, sub_conf, u["pos2"], u["lab2"]), c1),
                ),
            ).otherwise(c1),
        )
        return (
            F.when(drawn == "code_confusion", g3)
            .when(drawn == "subcode_confusion", g2)
            .when(drawn == "code_and_subcode_confusion", F.when(has_code, g4).otherwise(g2))
            .when(drawn == "missing_annotation", miss)
            .when(drawn == "extra_annotation", extra)
            .when(drawn == "spurious_annotation", spurious)
            .cast(ANNOTATION_TYPE)
        )

    def forced_result(drawn):
        # Forced fallback
        a0 = F.get(g, 0)

        def with_fv(fv):
            general_ok = vocab.is_valid_pair(a0["code"], F.lit(vocab.FALLBACK_SUB_CODE))

            def one(c, s):
                return F.array(F.struct(c.alias("code"), s.alias("sub_code"), a0["span"].alias("span")))

            strategy = (
                F.when(n > 1, F.lit("forced_missing_annotation"))
                .when(fv.isNotNull(), F.lit("forced_subcode_change"))
                .when(general_ok, F.lit("forced_subcode_to_general"))
                .otherwise(F.lit("forced_code_change"))
            )
            rejected = (
                F.when(n > 1, F.slice(g, F.lit(1), n - 1))
                .when(fv.isNotNull(), one(a0["code"], fv))
                .when(general_ok, one(a0["code"], F.lit(vocab.FALLBACK_SUB_CODE)))
                .otherwise(one(F.lit(vocab.FALLBACK_CODE), F.lit(vocab.FALLBACK_SUB_CODE)))
            )
            return F.struct(rejected.cast(ANNOTATION_TYPE).alias("rejected"), strategy.alias("strategy"))

        fv = F.get(
            F.filter(
                F.coalesce(F.try_element_at(sub_conf, a0["sub_code"]), F.array().cast(CONF_TYPE)),
                lambda x: vocab.is_valid_pair(a0["code"], x["pred"]),
            ),
            0,
        )["pred"]
        return let(F.when(n == 1, fv), with_fv)

    def result(u):
        def with_drawn(drawn):
            def with_cand(cand):
                # forced when drawn so, or when a draw left a duplicate-laden list F4-identical
                forced_needed = (drawn == "forced") | ((drawn != "spurious_annotation") & identical(cand, g))
                return F.when(forced_needed, forced_result(drawn)).otherwise(
                    F.struct(cand.alias("rejected"), drawn.alias("strategy"))
                )

            return let(candidate(u, drawn), with_cand)

        return let(pick_strategy(u), with_drawn)

    def negative(k):
        return let(let(draws(k), result), lambda res: F.struct(model.alias("model"), k.alias("neg_idx"), res["rejected"].alias("rejected"), res["strategy"].alias("strategy")))

    return F.transform(F.sequence(F.lit(0), F.lit(params.negatives_per_sample - 1)), negative)
