"""Confusion mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanpref.functions import labels
from spanpref.functions.text import pct
from spanpref.functions.draws import let
from spanpref.functions.vocab import NONE_TOKEN


def with_label_sets(df: DataFrame) -> DataFrame:
    """Canonical distinct label sets of gold and prediction (P7):
    ``true_codes, pred_codes, true_subcodes, pred_subcodes``."""
    return df.select(
        "*",
        labels.canonical_set(F.transform("gold_results", lambda a: a["code"]), "code").alias("true_codes"),
        labels.canonical_set(F.transform("pred_results", lambda a: a["code"]), "code").alias("pred_codes"),
        labels.canonical_set(F.transform("gold_results", lambda a: a["sub_code"]), "sub_code").alias("true_subcodes"),
        labels.canonical_set(F.transform("pred_results", lambda a: a["sub_code"]), "sub_code").alias("pred_subcodes"),
    )


def confusion_edges(
    df: DataFrame,
    true_col: str,
    pred_col: str,
    keys: tuple[str, ...] = ("model",),
    include_none: bool = False,
    none_token: str = NONE_TOKEN,
) -> DataFrame:
    """A1: directed edges t -> p for t in T-P, p in P-T, counted per ``keys``.

    The two explodes run inside each row (J2), so the only shuffle is the final
    ``groupBy``, whose map-side partial aggregation leaves at most
    |labels| x (|labels|-1) keys per partition and model.
    """
    t, p = F.col(true_col), F.col(pred_col)
    fn = F.array_except(t, p)
    fp = F.array_except(p, t)
    if include_none:
        none = F.array(F.lit(none_token))
        fn, fp = (
            F.when((F.size(fn) == 0) & (F.size(fp) > 0), none).otherwise(fn),
            F.when((F.size(fp) == 0) & (F.size(fn) > 0), none).otherwise(fp),
        )
    k = [F.col(c) for c in keys]
    e = df.select(*k, fn.alias("fn"), fp.alias("fp"))
    # explode_outer + IS NOT NULL instead of explode: a plain explode makes the
    # optimizer infer ``size(fn) > 0`` and push it below the projections, which
    # copies the whole parse expression into the filter (plan blow-up).
    e = e.select(*keys, F.explode_outer("fn").alias("ground_truth"), "fp").where(F.col("ground_truth").isNotNull())
    e = e.select(*keys, "ground_truth", F.explode_outer("fp").alias("predicted")).where(F.col("predicted").isNotNull())
    return e.groupBy(*keys, "ground_truth", "predicted").agg(F.count(F.lit(1)).alias("count"))


def confusion_table(df: DataFrame, include_none: bool = False) -> DataFrame:
    """Both levels in one tidy table ``(model, kind, gt, pred, cnt)``."""
    none = F.array(F.lit(NONE_TOKEN))

    def edges(kind: str, true_col: str, pred_col: str):
        missed = F.struct(F.array_except(true_col, pred_col).alias("fn"), F.array_except(pred_col, true_col).alias("fp"))

        def cross(s):
            fn, fp = s["fn"], s["fp"]
            if include_none:
                fn = F.when((F.size(fn) == 0) & (F.size(s["fp"]) > 0), none).otherwise(fn)
                fp = F.when((F.size(fp) == 0) & (F.size(s["fn"]) > 0), none).otherwise(fp)
            return F.flatten(F.transform(fn, lambda g: F.transform(fp, lambda p: F.struct(F.lit(kind).alias("kind"), g.alias("gt"), p.alias("pred")))))

        return let(missed, cross)

    # both levels from one pass over the rows; explode_outer for the reason given in confusion_edges
    both = F.concat(edges("code", "true_codes", "pred_codes"), edges("sub_code", "true_subcodes", "pred_subcodes"))
    e = df.select("model", F.explode_outer(both).alias("e")).where(F.col("e").isNotNull()).select("model", "e.*")
    return e.groupBy("model", "kind", "gt", "pred").agg(F.count(F.lit(1)).alias("cnt"))


def total_errors(conf: DataFrame, keys=("model", "kind")) -> DataFrame:
    """A2: sum of off-diagonal counts."""
    return conf.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("gt") != F.col("pred"), F.col("cnt"))), F.lit(0)).cast("bigint").alias("total_errors"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def confusion_weights(conf: DataFrame, keys=("model", "kind")) -> DataFrame:
    """W1-W3 (D9): per gt, weight = cnt / sum(cnt) over off-diagonal rows,
    ordered by weight desc (ties by pred), with cumulative counts and weights.

    The table has at most |labels|^2 rows per model, so the windows are small.
    Rows of a gt whose counts sum to 0 are dropped (H22).
    """
    off = conf.where((F.col("gt") != F.col("pred")) & (F.col("cnt") > 0))
    by_gt = Window.partitionBy(*keys, "gt")
    ordered = by_gt.orderBy(F.col("cnt").desc(), F.col("pred"))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return off.select(
        *keys,
        "gt",
        "pred",
        "cnt",
        F.sum("cnt").over(by_gt).alias("gt_total"),
        (F.col("cnt") / F.sum("cnt").over(by_gt)).alias("weight"),
        F.row_number().over(ordered).alias("rnk"),
        F.sum("cnt").over(running).alias("cum_cnt"),
    ).withColumn("cum", F.col("cum_cnt") / F.col("gt_total"))


def top_confusions(conf: DataFrame, top_n: int = 10, keys=("model", "kind")) -> DataFrame:
    """Sort all pairs by count, keep the first ``top_n`` slots, *then*
    drop the diagonal (slot numbers keep their gaps); pct of off-diagonal total."""
    w = Window.partitionBy(*keys).orderBy(F.col("cnt").desc(), F.col("gt"), F.col("pred"))
    tot = Window.partitionBy(*keys)
    ranked = conf.select(
        "*",
        F.row_number().over(w).alias("slot"),
        F.sum(F.when(F.col("gt") != F.col("pred"), F.col("cnt")).otherwise(F.lit(0))).over(tot).alias("total_errors"),
    )
    return ranked.where((F.col("slot") <= top_n) & (F.col("gt") != F.col("pred"))).select(
        *keys, "slot", "gt", "pred", "cnt", pct(F.col("cnt"), F.col("total_errors")).alias("pct")
    )
