"""Gold x prediction pairing, with both sides parsed once before the join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.functions.jsonish import ANNOTATION_TYPE, with_parsed


def parse_examples(examples: DataFrame, repair: bool = True) -> DataFrame:
    """``examples(ex_id, answer, ...)`` + ``gold_strict, gold_mode, gold_bad_shape, gold_results``."""
    return with_parsed(examples, "answer", "gold", repair=repair)


def parse_predictions(preds: DataFrame) -> DataFrame:
    """``predictions(model, ex_id, pred_text)`` + ``pred_*`` parse columns."""
    return with_parsed(preds, "pred_text", "pred", repair=True)


def evaluation_table(examples: DataFrame, preds: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per (model, example) with parsed gold and prediction.

    Every example is there for every model of ``preds``: one without a
    prediction is scored as an empty answer (all its annotations are missed).
    Predictions for unknown examples are left out; see :func:`unmatched_report`.
    Both sides are parsed *before* the equi-join, the gold answer once, not once
    per model.  (model, ex_id) is unique on both sides, so no join key can be
    hot.  The models are a handful of names, gathered by a scalar subquery.
    """
    g = parse_examples(examples).select(
        "ex_id", "gold_mode", "gold_bad_shape", "gold_results", *(["answer"] if keep_text else [])
    )
    models = preds.select(F.collect_set("model")).scalar()
    g = g.select(F.explode(models).alias("model"), "*")
    p = parse_predictions(preds).select(
        "model", "ex_id", "pred_mode", "pred_bad_shape", "pred_results", *(["pred_text"] if keep_text else [])
    )
    j = g.join(p, ["model", "ex_id"], "left")
    none = F.array().cast(ANNOTATION_TYPE)
    return j.withColumns(
        {
            "pred_mode": F.coalesce("pred_mode", F.lit("empty")),
            "pred_bad_shape": F.coalesce("pred_bad_shape", F.lit(False)),
            "pred_results": F.coalesce("pred_results", none),
        }
    )


def unmatched_report(examples: DataFrame, preds: DataFrame) -> DataFrame:
    """Per model: examples without a prediction and predictions without an example."""
    models = preds.select(F.collect_set("model")).scalar()
    e = examples.select(F.explode(models).alias("model"), "ex_id", F.lit(True).alias("has_example"))
    p = preds.select("model", "ex_id", F.lit(True).alias("has_prediction"))
    j = e.join(p, ["model", "ex_id"], "full_outer")
    return j.groupBy("model").agg(
        F.count_if(F.col("has_prediction").isNull()).alias("no_prediction"),
        F.count_if(F.col("has_example").isNull()).alias("no_example"),
    )
