"""Evaluation metrics.

Per-example counts are computed in-row; the report is one aggregation with
nine partial sums per model (map-side combined, one tiny shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanpref.functions import labels, text
from spanpref.functions.draws import let

LEVELS = ("code", "sub_code", "span")


def _range(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def greedy_span_tp(true_ws: Column, pred_ws: Column, threshold: float = 0.6) -> Column:
    """Greedy relaxed matching as a fold over the predicted spans.

    State = (unused true indices in ascending order, tp).  Each predicted span
    takes the first unused true span it matches (containment either way, or
    Jaccard >= threshold).  The fold keeps the greedy order, which a join +
    ``row_number`` formulation would not.
    """

    def fold(b):
        tws, pws = b["t"], b["p"]
        init = F.struct(_range(F.size(tws)).alias("rem"), F.lit(0).alias("tp"))

        def step(st, p):
            j = F.get(F.filter(st["rem"], lambda i: text.spans_match(F.get(tws, i), p, threshold)), 0)
            return let(
                j,
                lambda jj: F.struct(
                    F.when(jj.isNull(), st["rem"]).otherwise(F.array_remove(st["rem"], jj)).alias("rem"),
                    (st["tp"] + F.when(jj.isNull(), F.lit(0)).otherwise(F.lit(1))).alias("tp"),
                ),
            )

        return F.aggregate(pws, init, step, lambda st: st["tp"])

    # bind both arrays once: they are read inside the fold
    return let(F.struct(true_ws.alias("t"), pred_ws.alias("p")), fold)


def with_example_counts(df: DataFrame, jaccard_threshold: float = 0.6, canonicalize: bool = False) -> DataFrame:
    """Per-example tp/fp/fn for code, sub-code (exact-case, vocabulary only, H7)
    and span (greedy relaxed match).  ``canonicalize=True`` maps labels through
    the canonical vocabulary first."""
    setf = labels.canonical_set if canonicalize else labels.exact_set
    g, p = F.col("gold_results"), F.col("pred_results")
    out = df
    for kind, field in (("code", "code"), ("sub_code", "sub_code")):
        t = setf(F.transform(g, lambda a: a[field]), kind)
        q = setf(F.transform(p, lambda a: a[field]), kind)
        out = out.withColumn(f"_t_{kind}", t).withColumn(f"_p_{kind}", q)
        out = out.withColumn(f"{kind}_tp", F.size(F.array_intersect(f"_t_{kind}", f"_p_{kind}")))
        out = out.withColumn(f"{kind}_fp", F.size(F.array_except(f"_p_{kind}", f"_t_{kind}")))
        out = out.withColumn(f"{kind}_fn", F.size(F.array_except(f"_t_{kind}", f"_p_{kind}")))
    spans_t = F.filter(F.transform(g, lambda a: a["span"]), lambda s: s.isNotNull())
    spans_p = F.filter(F.transform(p, lambda a: a["span"]), lambda s: s.isNotNull())
    out = out.withColumn("_tws", F.transform(spans_t, text.word_set)).withColumn(
        "_pws", F.transform(spans_p, text.word_set)
    )
    out = out.withColumn("span_tp", greedy_span_tp(F.col("_tws"), F.col("_pws"), jaccard_threshold))
    out = out.withColumn("span_fp", F.size("_pws") - F.col("span_tp")).withColumn(
        "span_fn", F.size("_tws") - F.col("span_tp")
    )
    return out.drop("_t_code", "_p_code", "_t_sub_code", "_p_sub_code", "_tws", "_pws")


def _prf(tp: Column, fp: Column, fn: Column):
    p = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), 2 * tp + fp + fn), F.lit(0.0))
    return p, r, f1


def level_prf(counts: DataFrame, level: str, keys=("model",)) -> DataFrame:
    """Micro P/R/F1 of one level from per-example counts."""
    agg = counts.groupBy(*keys).agg(
        F.sum(f"{level}_tp").cast("bigint").alias("tp"),
        F.sum(f"{level}_fp").cast("bigint").alias("fp"),
        F.sum(f"{level}_fn").cast("bigint").alias("fn"),
    )
    p, r, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(*keys, "tp", "fp", "fn", p.alias("p"), r.alias("r"), f1.alias("f1"))


def eval_report(counts: DataFrame, keys=("model",), digits: int | None = 4) -> DataFrame:
    """Tidy ``(model, level, p, r, f1)`` - one aggregation for all nine sums."""
    sums = [F.sum(f"{lv}_{m}").cast("bigint").alias(f"{lv}_{m}") for lv in LEVELS for m in ("tp", "fp", "fn")]
    agg = counts.groupBy(*keys).agg(*sums)
    rows = []
    for lv, name in (("code", "code"), ("sub_code", "sub-code"), ("span", "span")):
        p, r, f1 = _prf(F.col(f"{lv}_tp"), F.col(f"{lv}_fp"), F.col(f"{lv}_fn"))
        rows.append(F.struct(F.lit(name).alias("level"), p.alias("p"), r.alias("r"), f1.alias("f1")))
    out = agg.select(*keys, F.explode_outer(F.array(*rows)).alias("m")).select(*keys, "m.*")
    if digits is not None:
        out = out.select(*keys, "level", *[F.round(c, digits).alias(c) for c in ("p", "r", "f1")])
    return out


def prediction_dump(df: DataFrame) -> DataFrame:
    """Per example sorted canonical label arrays and the raw prediction."""
    return df.select(
        "model",
        "ex_id",
        F.array_sort("true_codes").alias("true_codes"),
        F.array_sort("pred_codes").alias("pred_codes"),
        F.array_sort("true_subcodes").alias("true_subcodes"),
        F.array_sort("pred_subcodes").alias("pred_subcodes"),
        F.col("pred_text").alias("raw_pred_text"),
    )
