"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables under ``sf_dir``, derives the extraction
fixture from them (``spanpref.sources.fixtures``) and runs one operator
family over the whole input.  Column names equal the DuckDB oracle's
(``spanpref.plans.oracle``); doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanpref.functions import jsonish, labels, text, vocab
from spanpref.operators import confusion, loss, metrics, negatives, pairs, tokens
from spanpref.lineage import scratch_path, staged
from spanpref.operators.evaluation_input import evaluation_table, unmatched_report
from spanpref.operators.inference import generate_predictions
from spanpref.sources import fixtures, sinks
from spanpref.sources.confusion_csv import read_confusion_csv, write_confusion_csv
from spanpref.sources.tables import read_table

R = 6


def fixture(spark: SparkSession, sf_dir: str, source: str = "conversations", keep_query: bool = True) -> tuple[DataFrame, DataFrame]:
    if source == "conversations":
        sent = fixtures.sentences_from_conversations(read_table(spark, sf_dir, "conversations"))
    else:
        sent = fixtures.sentences_from_documents(read_table(spark, sf_dir, "documents"))
    return fixtures.extraction_fixture(sent, keep_query)


def eval_table(spark, sf_dir, keep_text=False, source="conversations") -> DataFrame:
    ex, pr = fixture(spark, sf_dir, source, keep_query=False)
    return evaluation_table(ex, pr, keep_text=keep_text)


def labelled(spark, sf_dir, keep_text=False, source="conversations") -> DataFrame:
    return confusion.with_label_sets(eval_table(spark, sf_dir, keep_text, source))


# ---------------------------------------------------------------- parsing
def q_parse_status(spark, sf_dir):
    ev = eval_table(spark, sf_dir)
    sides = F.array(
        F.struct(F.lit("gold").alias("side"), F.col("gold_mode").alias("parse_mode"),
                 F.col("gold_bad_shape").alias("bad"), F.size("gold_results").alias("n")),
        F.struct(F.lit("pred").alias("side"), F.col("pred_mode").alias("parse_mode"),
                 F.col("pred_bad_shape").alias("bad"), F.size("pred_results").alias("n")),
    )
    return (
        ev.select("model", F.explode_outer(sides).alias("s"))
        .groupBy("model", "s.side", "s.parse_mode")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col("s.bad").cast("int")).cast("bigint").alias("n_bad_shape"),
            F.sum("s.n").cast("bigint").alias("n_items"),
        )
    )


def q_format_flags(spark, sf_dir):
    _, pr = fixture(spark, sf_dir, keep_query=False)
    return pr.select(
        "model",
        "ex_id",
        jsonish.is_valid_format(F.col("pred_text")).alias("valid_format"),
        jsonish.fix_structure(F.col("pred_text")).alias("fixed_text"),
    )


def q_annotations_long(spark, sf_dir):
    ev = eval_table(spark, sf_dir)

    def side(name):
        return F.transform(f"{name}_results", lambda a, i: F.struct(F.lit(name).alias("side"), i.cast("bigint").alias("pos"), a.alias("a")))

    rows = ev.select("model", "ex_id", F.explode(F.concat(side("gold"), side("pred"))).alias("t")).select("model", "ex_id", "t.side", "t.pos", "t.a")
    return rows.select(
        "model", "ex_id", "side", "pos",
        F.col("a.code").alias("code"), F.col("a.sub_code").alias("sub_code"), F.col("a.span").alias("span"),
        labels.canonicalize(F.col("a.code"), vocab.code_canon_map()).alias("code_canon"),
        labels.canonicalize(F.col("a.sub_code"), vocab.sub_canon_map()).alias("sub_code_canon"),
    )


def q_context_fields(spark, sf_dir):
    ex, _ = fixture(spark, sf_dir)
    c = text.context_struct(F.col("query"))
    return ex.select(
        "ex_id",
        c["TO_PAT_YN"].alias("to_pat_yn"),
        c["previous"].alias("previous"),
        c["current"].alias("current"),
        c["next"].alias("next"),
        text.first_current_sentence(F.col("query")).alias("current_preview"),
    )


def q_unmatched_report(spark, sf_dir):
    return unmatched_report(*fixture(spark, sf_dir, keep_query=False))


# ---------------------------------------------------------------- confusion
def _edges(kind, include_none):
    t, p = ("true_codes", "pred_codes") if kind == "code" else ("true_subcodes", "pred_subcodes")

    def build(spark, sf_dir):
        return confusion.confusion_edges(labelled(spark, sf_dir), t, p, include_none=include_none)

    return build


def conf_table(spark, sf_dir):
    return confusion.confusion_table(labelled(spark, sf_dir))


def q_confusion_weights(spark, sf_dir):
    w = confusion.confusion_weights(conf_table(spark, sf_dir))
    return w.select(
        "model", "kind", "gt", "pred", "cnt", "gt_total", F.round("weight", 9).alias("weight"),
        F.col("rnk").cast("bigint").alias("rnk"), "cum_cnt", F.round("cum", 9).alias("cum"),
    )


def q_top_confusions(spark, sf_dir):
    t = confusion.top_confusions(conf_table(spark, sf_dir), top_n=10)
    return t.select("model", "kind", F.col("slot").cast("bigint").alias("slot"), "gt", "pred", "cnt",
                    F.round("pct", R).alias("pct"))


def q_confusion_totals(spark, sf_dir):
    return confusion.total_errors(conf_table(spark, sf_dir))


# ---------------------------------------------------------------- metrics
def counts(spark, sf_dir, source="conversations"):
    return metrics.with_example_counts(eval_table(spark, sf_dir, source=source))


def _prf(level):
    def build(spark, sf_dir):
        m = metrics.level_prf(counts(spark, sf_dir), level)
        return m.select("model", "tp", "fp", "fn", *[F.round(c, R).alias(c) for c in ("p", "r", "f1")])

    return build


def q_eval_report_by_model(spark, sf_dir):
    return metrics.eval_report(counts(spark, sf_dir), digits=4)


def q_per_example_metrics(spark, sf_dir):
    cols = [f"{lv}_{m}" for lv in metrics.LEVELS for m in ("tp", "fp", "fn")]
    return counts(spark, sf_dir).select("model", "ex_id", *[F.col(c).cast("bigint").alias(c) for c in cols])


def q_prediction_dump(spark, sf_dir):
    d = metrics.prediction_dump(labelled(spark, sf_dir, keep_text=True))
    return d.select(
        "model", "ex_id",
        *[F.array_join(c, "|").alias(c) for c in ("true_codes", "pred_codes", "true_subcodes", "pred_subcodes")],
        "raw_pred_text",
    )


# ---------------------------------------------------------------- preference data
PARAMS = negatives.GeneratorParams(seed=42, negatives_per_sample=2)


def preference_build(spark, sf_dir, params=PARAMS, source="conversations"):
    """Mined confusion -> per-model dimensions -> negatives -> pairs (one job graph)."""
    ex, pr = fixture(spark, sf_dir, source)
    conf = confusion.confusion_table(confusion.with_label_sets(evaluation_table(ex, pr)))
    dims = negatives.confusion_dims(conf, pr.select("model").distinct())
    gold, quarantine = negatives.parse_gold(ex)
    neg = negatives.generate_negatives(gold, dims, params=params)
    return pairs.assemble_pairs(neg, params), ex, quarantine


def q_preference_pairs(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return pairs.drop_identical(p).select(
        "model", "pair_id", "ex_id", "neg_idx", "strategy", "prompt", "chosen", "rejected",
        F.col("num_chosen").cast("bigint").alias("num_chosen"), F.col("num_rejected").cast("bigint").alias("num_rejected"),
    )


def q_pair_metadata(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return p.select("model", "pair_id", "metadata")


def q_negatives_long(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return p.select(
        "model", "pair_id", "strategy", F.posexplode_outer("rejected_annotations").alias("pos", "a")
    ).where(F.col("pos").isNotNull()).select(
        "model", "pair_id", "strategy", F.col("pos").cast("bigint").alias("pos"),
        F.col("a.code").alias("code"), F.col("a.sub_code").alias("sub_code"), F.col("a.span").alias("span"),
    )


def q_strategy_distribution(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return pairs.strategy_distribution(p).select("model", "strategy", "count", F.round("pct", R).alias("pct"))


def q_pair_diff_counts(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    d = pairs.pair_diff_counts(p)
    return d.select("model", "pair_id", "strategy", *[F.col(c).cast("bigint").alias(c) for c in ("n_added", "n_removed", "n_code_changes", "n_sub_code_changes")])


def q_identical_filter_report(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    r = pairs.identical_filter_report(p)
    return r.select("model", "total", "removed", "kept", "identical_sets", F.round("removed_pct", R).alias("removed_pct"), F.round("kept_pct", R).alias("kept_pct"))


def q_pairs_preview(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    v = pairs.preview(p, 3)
    return v.select("model", F.col("sample").cast("bigint").alias("sample"), "pair_id", "strategy", "to_pat_yn", "current_sentence",
                    *[F.col(c).cast("bigint").alias(c) for c in ("num_chosen", "num_rejected", "n_added", "n_removed", "n_code_changes", "n_sub_code_changes")])


def q_run_config(spark, sf_dir):
    p, ex, qn = preference_build(spark, sf_dir)
    return pairs.run_config(p, ex, qn, PARAMS)


def q_strategy_ranking(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return pairs.strategy_ranking(p).select("model", "strategy", "count", F.round("pct", R).alias("pct"), F.col("place").cast("bigint").alias("place"))


#: No strategy can be drawn: every pair comes from the forced fallback.
FORCED = negatives.GeneratorParams(seed=42, negatives_per_sample=1, strategies=tuple((s, 0) for s, _ in negatives.STRATEGIES))


def q_forced_fallbacks(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir, FORCED)
    return p.select("model", "pair_id", "strategy", "rejected")


def q_quarantine_report(spark, sf_dir):
    """examples whose gold can't be used, by reason."""
    _, _, quarantine = preference_build(spark, sf_dir)
    return quarantine.groupBy("reason").agg(F.count("*").alias("n_rows"), F.min("ex_id").alias("first_ex_id"), F.max("ex_id").alias("last_ex_id"))


def q_pair_validity(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return pairs.validity_report(p)


def q_pair_text_previews(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return pairs.text_previews(p)


def q_first_examples(spark, sf_dir):
    """The first 100 examples, as ``--max_samples 100`` takes them."""
    ex, _ = fixture(spark, sf_dir)
    return sinks.first_n(ex, 100)


STUB_ANSWER = '{"results":[{"Code":"SDOH","Sub-code":"EconomicStability","Span":"%s"}]}'


def stub_generator():
    """A generator that answers with the prompt's md5, for the hook's query."""
    import hashlib

    return lambda prompts: [STUB_ANSWER % hashlib.md5(p.encode()).hexdigest() for p in prompts]


def q_generated_predictions(spark, sf_dir):
    """The hook's rows with :func:`stub_generator` in place of a model."""
    ex, _ = fixture(spark, sf_dir)
    return generate_predictions(ex, stub_generator, "stub")


# ---------------------------------------------------------------- sinks, written and read back
def q_confusion_csv(spark, sf_dir):
    """Each model's two confusion CSVs, written and read back."""
    conf = staged(conf_table(spark, sf_dir), "confusions")
    out = None
    for model, _ in fixtures.MODELS:
        for kind in ("code", "sub_code"):
            path = scratch_path(spark, f"confusion-{kind}")
            mine = conf.where((F.col("model") == model) & (F.col("kind") == kind))
            write_confusion_csv(mine.select(F.col("gt").alias("ground_truth"), F.col("pred").alias("predicted"), F.col("cnt").alias("count")), path, kind)
            back = read_confusion_csv(spark, path, model)
            out = back if out is None else out.unionByName(back)
    return out


def _sink(name, rows, write, kind="parquet"):
    def build(spark, sf_dir):
        return sinks.written_twice(staged(rows(spark, sf_dir), name), scratch_path(spark, name), write, kind)

    build.__doc__ = "Rows as read back from their sink after one model was written again."
    return build


def all_pairs(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return pairs.drop_identical(p).select(*sinks.PAIR_COLUMNS)


def padded(spark, sf_dir):
    p, _, _ = preference_build(spark, sf_dir)
    return tokens.pad_batches(pairs.drop_identical(p), TOKEN_PARAMS)


def q_token_table_sink(spark, sf_dir):
    """The padded token table as read back from its sink after one model was written again, summed up by batch."""
    p, _, _ = preference_build(spark, sf_dir)
    placed = tokens.placed_batches(pairs.drop_identical(p), TOKEN_PARAMS)
    make, schema = tokens.padding(placed, TOKEN_PARAMS)

    def write(rows, path):
        sinks.write_token_pass(rows, make, schema, path)

    return batch_summary(sinks.written_twice(placed, scratch_path(spark, "token-table"), write, schema=schema))


# ---------------------------------------------------------------- tokens and loss
TOKEN_PARAMS = tokens.TokenParams(batch_size=4)
LOSS_PARAMS = loss.LossParams(batch_size=4)


def token_sides(spark, sf_dir, source="conversations", offsets=True, tokenizer="char", arrays=("tail_labels", "tail_weights")):
    """Tokens of all pairs; everything before the first supervised one is masked with weight 0, so the queries take the tails."""
    p, _, _ = preference_build(spark, sf_dir, source=source)
    return tokens.token_sides(pairs.drop_identical(p), TOKEN_PARAMS, tokenizer, offsets, arrays=arrays)


def q_token_labels(spark, sf_dir):
    t = token_sides(spark, sf_dir, arrays=("tail_labels",))

    def side(name):
        return F.struct(
            F.lit(name).alias("side"),
            F.col(f"{name}_m").cast("bigint").alias("n_masked"),
            F.aggregate(f"{name}_tail_labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"),
        )

    return t.select("model", "pair_id", F.explode(F.array(side("chosen"), side("rejected"))).alias("s")).select("model", "pair_id", "s.*")


def q_token_weights_no_offsets(spark, sf_dir):
    return weight_rows(token_sides(spark, sf_dir, offsets=False))


def q_token_weights(spark, sf_dir):
    return weight_rows(token_sides(spark, sf_dir))


def weight_rows(t):

    def side(name):
        lab, w = F.col(f"{name}_tail_labels"), F.col(f"{name}_tail_weights")
        return F.struct(
            F.lit(name).alias("side"),
            F.col(f"{name}_n").cast("bigint").alias("n_tokens"),
            F.col(f"{name}_start").cast("bigint").alias("answer_start"),
            F.size(F.filter(lab, lambda x: x != tokens.IGNORE)).cast("bigint").alias("n_supervised"),
            F.size(F.filter(w, lambda x: x > 1.0)).cast("bigint").alias("n_upweighted"),
            F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 4).alias("weight_sum"),
        )

    rows = t.select("model", "pair_id", F.explode(F.array(side("chosen"), side("rejected"))).alias("s"))
    return rows.select("model", "pair_id", "s.*")


def q_token_weights_words_no_offsets(spark, sf_dir):
    """Word tokens, searched as for a tokenizer without an offset map."""
    return weight_rows(token_sides(spark, sf_dir, offsets=False, tokenizer="word"))


def q_padded_batches(spark, sf_dir):
    return batch_summary(padded(spark, sf_dir))


def batch_summary(b):
    def zeros(mask):
        return F.size(mask) - F.size(F.array_remove(mask, F.lit(0).cast("bigint")))

    pad = zeros("chosen_attention_mask") + zeros("rejected_attention_mask")
    return b.groupBy("model", "batch").agg(
        F.max("max_len").cast("bigint").alias("max_len"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(pad).cast("bigint").alias("n_padding"),
    )


def sequence_table(spark, sf_dir):
    return loss.sequence_logps(loss.token_logps_from_sides(token_sides(spark, sf_dir)), LOSS_PARAMS)


def q_sequence_logp(spark, sf_dir):
    """A12/A13/A15 per pair. No table has log-probabilities: keyed draws stand in for a model's logged values."""
    s = sequence_table(spark, sf_dir)
    return s.select(
        "model", "pair_id", *[F.round(c, R).alias(c) for c in ("pi_c", "pi_r", "ref_c", "ref_r", "barrier")],
        "chosen_tokens", "rejected_tokens", "gate_tokens",
    )


def q_preference_loss_metrics(spark, sf_dir):
    """A14-A16 per batch of four consecutive pairs, on the same drawn log-probabilities as ``sequence_logp``."""
    m = loss.batch_metrics(loss.pair_losses(sequence_table(spark, sf_dir), LOSS_PARAMS), LOSS_PARAMS)
    cols = ("loss", "loss_preference", "loss_barrier", "policy_prob_chosen", "barrier_active_pct", "pref_p_pref",
            "logits_mean", "logits_max", "logits_min")
    return m.select("model", "batch", "n_pairs", *[F.round(c, R).alias(c) for c in cols])


# ---------------------------------------------------------------- document-scale variants
def q_doc_code_confusion_edges(spark, sf_dir):
    """Confusion edges with one example per non-empty ``documents`` line (bench scale)."""
    return confusion.confusion_edges(labelled(spark, sf_dir, source="documents"), "true_codes", "pred_codes")


def q_doc_eval_report_by_model(spark, sf_dir):
    return metrics.eval_report(counts(spark, sf_dir, source="documents"), digits=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_status": q_parse_status,
    "format_flags": q_format_flags,
    "annotations_long": q_annotations_long,
    "context_fields": q_context_fields,
    "unmatched_report": q_unmatched_report,
    "code_confusion_edges": _edges("code", False),
    "subcode_confusion_edges": _edges("sub_code", False),
    "code_confusion_edges_with_none": _edges("code", True),
    "subcode_confusion_edges_with_none": _edges("sub_code", True),
    "confusion_weights": q_confusion_weights,
    "top_confusions": q_top_confusions,
    "confusion_totals": q_confusion_totals,
    "code_prf": _prf("code"),
    "subcode_prf": _prf("sub_code"),
    "span_prf": _prf("span"),
    "eval_report_by_model": q_eval_report_by_model,
    "per_example_metrics": q_per_example_metrics,
    "prediction_dump": q_prediction_dump,
    "preference_pairs": q_preference_pairs,
    "pair_metadata": q_pair_metadata,
    "negatives_long": q_negatives_long,
    "strategy_distribution": q_strategy_distribution,
    "pair_diff_counts": q_pair_diff_counts,
    "identical_filter_report": q_identical_filter_report,
    "pairs_preview": q_pairs_preview,
    "run_config": q_run_config,
    "token_labels": q_token_labels,
    "token_weights": q_token_weights,
    "token_weights_no_offsets": q_token_weights_no_offsets,
    "padded_batches": q_padded_batches,
    "sequence_logp": q_sequence_logp,
    "preference_loss_metrics": q_preference_loss_metrics,
    "strategy_ranking": q_strategy_ranking,
    "forced_fallbacks": q_forced_fallbacks,
    "quarantine_report": q_quarantine_report,
    "pair_validity": q_pair_validity,
    "pair_text_previews": q_pair_text_previews,
    "first_examples": q_first_examples,
    "confusion_csv": q_confusion_csv,
    "generated_predictions": q_generated_predictions,
    "token_weights_words_no_offsets": q_token_weights_words_no_offsets,
    "prediction_dump_sink": _sink("prediction-dump", q_prediction_dump, sinks.write_prediction_dump, "json"),
    "pairs_sink": _sink("pairs", all_pairs, sinks.write_pairs),
    "run_config_sink": _sink("run-config", q_run_config, sinks.write_run_config, "json"),
    "example_metrics_sink": _sink("example-metrics", q_per_example_metrics, sinks.write_example_metrics),
    "token_table_sink": q_token_table_sink,
    "doc_code_confusion_edges": q_doc_code_confusion_edges,
    "doc_eval_report_by_model": q_doc_eval_report_by_model,
}
