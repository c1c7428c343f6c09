"""Preference pairs and their reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanpref.functions.jsonish import annotations_json
from spanpref.functions.text import context_struct, first_current_sentence, pct
from spanpref.functions import vocab
from spanpref.operators.negatives import STRATEGIES, GeneratorParams, identical

VERSION = "spanpref-1"


def assemble_pairs(neg: DataFrame, params: GeneratorParams = GeneratorParams()) -> DataFrame:
    """(prompt, chosen, rejected, metadata) per negative.

    ``chosen`` and ``rejected`` are serialised by the same ``to_json`` so the
    string test (F2) compares content, not formatting (H8); the gold text is
    kept as ``chosen_raw``.  ``valid_labels`` tells whether every rejected (code,
    sub-code) is of the hierarchy (H13: the fallback labels are not).
    """
    ctx = context_struct(F.col("query"))
    out = neg.select(
        "model",
        (F.col("ex_id") * F.lit(params.negatives_per_sample) + F.col("neg_idx")).alias("pair_id"),
        "ex_id",
        "neg_idx",
        F.col("query").alias("prompt"),
        annotations_json(F.col("gold")).alias("chosen"),
        F.col("answer").alias("chosen_raw"),
        annotations_json(F.col("rejected")).alias("rejected"),
        "strategy",
        F.size("gold").alias("num_chosen"),
        F.size("rejected").alias("num_rejected"),
        ctx.alias("context"),
        "gold",
        F.col("rejected").alias("rejected_annotations"),
        F.forall("rejected", lambda a: F.coalesce(vocab.is_valid_pair(a["code"], a["sub_code"]), F.lit(False))).alias("valid_labels"),
    )
    meta = F.struct("strategy", "context", "num_chosen", "num_rejected")
    return out.withColumn("metadata", F.to_json(meta))


def drop_identical(pairs: DataFrame) -> DataFrame:
    """keep pairs whose chosen and rejected texts differ."""
    return pairs.where(F.col("chosen") != F.col("rejected"))


def identical_filter_report(pairs: DataFrame) -> DataFrame:
    """Removed / kept counts and percentages per model, one aggregation."""
    agg = pairs.groupBy("model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("chosen") == F.col("rejected")).alias("removed"),
        F.count_if(F.col("chosen") != F.col("rejected")).alias("kept"),
        F.count_if(identical(F.col("gold"), F.col("rejected_annotations"))).alias("identical_sets"),
    )
    return agg.select(
        "model", "total", "removed", "kept", "identical_sets",
        pct(F.col("removed"), F.col("total")).alias("removed_pct"),
        pct(F.col("kept"), F.col("total")).alias("kept_pct"),
    )


def strategy_distribution(pairs: DataFrame) -> DataFrame:
    """Count per strategy (before the identical filter) and % of emitted pairs."""
    per = pairs.groupBy("model", "strategy").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("chosen") != F.col("rejected")).alias("emitted")
    )
    total = F.sum("emitted").over(Window.partitionBy("model"))  # at most a dozen strategies a model
    return per.select("model", "strategy", "count", pct(F.col("count"), total).alias("pct"))


def strategy_ranking(pairs: DataFrame) -> DataFrame:
    """T4: a model's strategies in descending order of their count (ties by name), with their place."""
    order = Window.partitionBy("model").orderBy(F.desc("count"), "strategy")
    ranked = strategy_distribution(pairs).withColumn("place", F.row_number().over(order))
    return ranked.orderBy("model", "place")


def validity_report(pairs: DataFrame) -> DataFrame:
    """Pairs per strategy, and those with a rejected label pair outside the hierarchy."""
    return pairs.groupBy("model", "strategy").agg(F.count("*").alias("n_pairs"), F.count_if(~F.col("valid_labels")).alias("n_invalid"))


def text_previews(pairs: DataFrame) -> DataFrame:
    """The beginnings the reference's reports show of every pair: 300 characters of the answers, 70 of
    every span, 50 of the spans added and removed, 40 of those whose labels changed."""
    c, r = F.col("gold"), F.col("rejected_annotations")

    def spans(annotations, n):
        return F.array_join(F.transform(annotations, lambda a: F.left(a["span"], F.lit(n))), "|")

    changed = F.filter(c, lambda a: F.exists(r, lambda b: (b["span"] == a["span"]) & ((b["code"] != a["code"]) | (b["sub_code"] != a["sub_code"]))))
    return pairs.select(
        "model",
        "pair_id",
        F.left("chosen", F.lit(300)).alias("chosen_300"),
        F.left("rejected", F.lit(300)).alias("rejected_300"),
        spans(c, 70).alias("chosen_spans_70"),
        spans(r, 70).alias("rejected_spans_70"),
        spans(F.array_sort(F.array_except(r, c)), 50).alias("added_spans_50"),
        spans(F.array_sort(F.array_except(c, r)), 50).alias("removed_spans_50"),
        spans(changed, 40).alias("changed_spans_40"),
    )


def pair_diff_counts(pairs: DataFrame) -> DataFrame:
    """Triples added and removed, and code / sub-code changes on equal spans.

    The span-equality join runs inside the row (annotation lists are short),
    counting (chosen, rejected) matches without materialising them.
    """
    c, r = F.col("gold"), F.col("rejected_annotations")

    def changes(kind):
        def per_chosen(a):
            same = F.filter(r, lambda b: b["span"] == a["span"])
            if kind == "code":
                return F.size(F.filter(same, lambda b: b["code"] != a["code"]))
            return F.size(F.filter(same, lambda b: (b["code"] == a["code"]) & (b["sub_code"] != a["sub_code"])))

        return F.aggregate(F.transform(c, per_chosen), F.lit(0), lambda acc, x: acc + x)

    return pairs.select(
        "model",
        "pair_id",
        "strategy",
        F.size(F.array_except(r, c)).alias("n_added"),
        F.size(F.array_except(c, r)).alias("n_removed"),
        changes("code").alias("n_code_changes"),
        changes("sub_code").alias("n_sub_code_changes"),
    )


def preview(pairs: DataFrame, n_samples: int = 3) -> DataFrame:
    """First ``n_samples`` pairs per model by pair id with the inspection fields.

    ``row_number() <= n`` lets Spark apply a per-partition group limit before the
    shuffle, so only n rows per model and partition move.
    """
    w = Window.partitionBy("model").orderBy("pair_id")
    first = pairs.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= n_samples)
    d = pair_diff_counts(first).drop("strategy")
    return first.join(d, ["model", "pair_id"]).select(
        "model", "sample", "pair_id", "strategy",
        F.coalesce(F.col("context.TO_PAT_YN"), F.lit("N/A")).alias("to_pat_yn"),
        first_current_sentence(F.col("prompt")).alias("current_sentence"),
        "num_chosen", "num_rejected", "n_added", "n_removed", "n_code_changes", "n_sub_code_changes",
    )


def run_config(pairs: DataFrame, examples: DataFrame, quarantine: DataFrame, params: GeneratorParams) -> DataFrame:
    """One row per model with parameters and the dataset counts."""
    kept = drop_identical(pairs).groupBy("model").agg(F.count(F.lit(1)).alias("total_pairs"))
    n_ex = examples.select(F.count(F.lit(1))).scalar()
    n_q = quarantine.select(F.count(F.lit(1))).scalar()
    strategies = json.dumps({s: w / 100 for s, w in params.strategies})
    return kept.select(
        "model",
        F.lit(params.seed).cast("bigint").alias("seed"),
        F.lit(params.negatives_per_sample).cast("bigint").alias("negatives_per_sample"),
        "total_pairs",
        n_ex.alias("original_samples"),
        n_q.alias("skipped_invalid"),
        F.lit(strategies).alias("strategies"),
        F.lit(VERSION).alias("version"),
    )


__all__ = [
    "STRATEGIES",
    "assemble_pairs",
    "drop_identical",
    "identical_filter_report",
    "strategy_distribution",
    "strategy_ranking",
    "validity_report",
    "text_previews",
    "pair_diff_counts",
    "preview",
    "run_config",
]
