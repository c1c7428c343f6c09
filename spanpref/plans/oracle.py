"""DuckDB oracle SQL for every query in ``spanpref.plans.queries`` that SQL can express."""

from __future__ import annotations

from spanpref.functions.text import MARKERS, STRIP
from spanpref.plans import sqlfrag as S
from spanpref.plans.sqlfrag import q

R = 6


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().lstrip(",") for c in ctes) + "\n"


def parse_status():
    return _with(S.eval_ctes()) + """
SELECT model, side, parse_mode, count(*)::BIGINT AS n_rows, sum(bad::INT)::BIGINT AS n_bad_shape, sum(n)::BIGINT AS n_items FROM (
  SELECT model, 'gold' AS side, gold_mode AS parse_mode, gold_bad_shape AS bad, len(gold_results) AS n FROM ev
  UNION ALL
  SELECT model, 'pred', pred_mode, pred_bad_shape, len(pred_results) FROM ev)
GROUP BY ALL"""


def format_flags():
    return _with(S.fixture_ctes()) + f"""
SELECT model, ex_id, coalesce(regexp_matches(pred_text, {q(S.VALID_FORMAT_RE)}), false) AS valid_format,
       '{{"results": [' || array_to_string(regexp_extract_all(pred_text, {q(S.FIX_RE)}), ', ') || ']}}' AS fixed_text
FROM fx_pred"""


def annotations_long():
    parts = []
    for side in ("gold", "pred"):
        parts.append(
            f"""SELECT model, ex_id, '{side}' AS side, pos::BIGINT AS pos, a.code AS code, a.sub_code AS sub_code, a.span AS span,
       {S.canon('a.code', 'code')} AS code_canon, {S.canon('a.sub_code', 'sub_code')} AS sub_code_canon
FROM (SELECT model, ex_id, unnest({side}_results) AS a, unnest(range(len({side}_results))) AS pos FROM ev)"""
        )
    return _with(S.eval_ctes()) + "\nUNION ALL\n".join(parts)


def unmatched_report():
    return _with(S.fixture_ctes()) + """
SELECT m.model, count(*) FILTER (WHERE p.ex_id IS NULL)::BIGINT AS no_prediction, 0::BIGINT AS no_example
FROM fx_ex e CROSS JOIN (SELECT DISTINCT model FROM fx_pred) m LEFT JOIN fx_pred p ON p.model = m.model AND p.ex_id = e.ex_id
GROUP BY m.model"""


def strip(x):
    return f"regexp_replace({x}, {q(STRIP)}, '', 'g')"


def context_fields():
    cols = []
    for name, marker in MARKERS.items():
        last = f"list_filter(string_split(query, chr(10)), lambda l: starts_with(l, {q(marker)}))[-1]"
        cols.append(f"{strip(f'replace({last}, {q(marker)}, {q(str())})')} AS {name}")
    first = f"list_filter(string_split(query, chr(10)), lambda l: starts_with(l, {q(MARKERS['current'])}))[1]"
    return _with(S.fixture_ctes()) + f"""
SELECT ex_id,
  CASE WHEN contains(query, 'TO_PAT_YN: Y') THEN 'Y' WHEN contains(query, 'TO_PAT_YN: N') THEN 'N' END AS to_pat_yn,
  {", ".join(cols)},
  left(coalesce({strip(f"replace({first}, {q(MARKERS['current'])}, '')")}, 'N/A'), 100) AS current_preview
FROM fx_ex"""


def edges(kind, include_none, source="conversations"):
    t, p = ("true_codes", "pred_codes") if kind == "code" else ("true_subcodes", "pred_subcodes")
    return _with(S.eval_ctes(source), S.labsets_cte()) + S.edges_sql(t, p, include_none)


def confusion_weights():
    return _with(S.eval_ctes(), S.labsets_cte(), S.conf_table_cte()) + """
SELECT model, kind, gt, pred, cnt, gt_total, round(cnt / gt_total, 9) AS weight, rnk, cum_cnt, round(cum_cnt / gt_total, 9) AS cum FROM (
  SELECT model, kind, gt, pred, cnt,
         sum(cnt) OVER (PARTITION BY model, kind, gt)::BIGINT AS gt_total,
         row_number() OVER (PARTITION BY model, kind, gt ORDER BY cnt DESC, pred)::BIGINT AS rnk,
         sum(cnt) OVER (PARTITION BY model, kind, gt ORDER BY cnt DESC, pred ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum_cnt
  FROM conf WHERE gt <> pred AND cnt > 0)"""


def top_confusions():
    return _with(S.eval_ctes(), S.labsets_cte(), S.conf_table_cte()) + f"""
SELECT model, kind, slot, gt, pred, cnt, round(coalesce(100.0 * cnt / nullif(total_errors, 0), 0.0), {R}) AS pct FROM (
  SELECT *, row_number() OVER (PARTITION BY model, kind ORDER BY cnt DESC, gt, pred)::BIGINT AS slot,
         sum(CASE WHEN gt <> pred THEN cnt ELSE 0 END) OVER (PARTITION BY model, kind) AS total_errors
  FROM conf)
WHERE slot <= 10 AND gt <> pred"""


def confusion_totals():
    return _with(S.eval_ctes(), S.labsets_cte(), S.conf_table_cte()) + """
SELECT model, kind, coalesce(sum(CASE WHEN gt <> pred THEN cnt END), 0)::BIGINT AS total_errors, count(*)::BIGINT AS n_pairs
FROM conf GROUP BY ALL"""


def prf(level):
    return _with(S.eval_ctes(), S.counts_cte()) + f"""
SELECT model, tp, fp, fn, round(p, {R}) AS p, round(r, {R}) AS r, round(f1, {R}) AS f1 FROM (
  SELECT model, tp, fp, fn, {S.prf_sql('tp', 'fp', 'fn')} FROM (
    SELECT model, sum({level}_tp)::BIGINT AS tp, sum({level}_fp)::BIGINT AS fp, sum({level}_fn)::BIGINT AS fn FROM cnt GROUP BY model))"""


def eval_report_by_model(source="conversations"):
    parts = []
    for lv, name in (("code", "code"), ("sub_code", "sub-code"), ("span", "span")):
        parts.append(
            f"""SELECT model, '{name}' AS level, round(p, 4) AS p, round(r, 4) AS r, round(f1, 4) AS f1 FROM (
  SELECT model, {S.prf_sql('tp', 'fp', 'fn')} FROM (
    SELECT model, sum({lv}_tp) AS tp, sum({lv}_fp) AS fp, sum({lv}_fn) AS fn FROM cnt GROUP BY model))"""
        )
    return _with(S.eval_ctes(source), S.counts_cte()) + "\nUNION ALL\n".join(parts)


def per_example_metrics():
    cols = ", ".join(f"{lv}_{m}::BIGINT AS {lv}_{m}" for lv in ("code", "sub_code", "span") for m in ("tp", "fp", "fn"))
    return _with(S.eval_ctes(), S.counts_cte()) + f"SELECT model, ex_id, {cols} FROM cnt"


def prediction_dump():
    cols = ", ".join(f"array_to_string(list_sort({c}), '|') AS {c}" for c in ("true_codes", "pred_codes", "true_subcodes", "pred_subcodes"))
    return _with(S.eval_ctes(), S.labsets_cte()) + f"SELECT model, ex_id, {cols}, pred_text AS raw_pred_text FROM ls"


def _pref_with(params=None):
    from spanpref.operators.negatives import SECOND_CONFUSION_GATE
    from spanpref.plans.queries import PARAMS

    p = params or PARAMS
    return _with(
        S.eval_ctes(), S.labsets_cte(), S.conf_table_cte(),
        S.negatives_ctes(p.seed, p.negatives_per_sample, p.strategies, p.max_attempts, SECOND_CONFUSION_GATE),
        S.pairs_cte(p.negatives_per_sample),
    )


def preference_pairs():
    return _pref_with() + """SELECT model, pair_id, ex_id, neg_idx, strategy, prompt, chosen, rejected,
  num_chosen::BIGINT AS num_chosen, num_rejected::BIGINT AS num_rejected FROM pairs WHERE chosen <> rejected"""


def negatives_long():
    return _pref_with() + """SELECT model, pair_id, strategy, pos::BIGINT AS pos, a.code AS code, a.sub_code AS sub_code, a.span AS span
FROM (SELECT model, pair_id, strategy, unnest(rejected_annotations) AS a, unnest(range(len(rejected_annotations))) AS pos FROM pairs)"""


def strategy_distribution():
    return _pref_with() + f"""SELECT s.model, s.strategy, s.count, round(coalesce(100.0 * s.count / nullif(e.emitted, 0), 0.0), {R}) AS pct
FROM (SELECT model, strategy, count(*)::BIGINT AS count FROM pairs GROUP BY ALL) s
LEFT JOIN (SELECT model, count(*) AS emitted FROM pairs WHERE chosen <> rejected GROUP BY model) e USING (model)"""


def _diff_cols():
    return """len(list_distinct(list_filter(rejected_annotations, lambda x: NOT list_contains(gold, x))))::BIGINT AS n_added,
  len(list_distinct(list_filter(gold, lambda x: NOT list_contains(rejected_annotations, x))))::BIGINT AS n_removed,
  coalesce(list_sum(list_transform(gold, lambda a: len(list_filter(rejected_annotations, lambda b: b.span = a.span AND b.code <> a.code)))), 0)::BIGINT AS n_code_changes,
  coalesce(list_sum(list_transform(gold, lambda a: len(list_filter(rejected_annotations, lambda b: b.span = a.span AND b.code = a.code AND b.sub_code <> a.sub_code)))), 0)::BIGINT AS n_sub_code_changes"""


def pair_diff_counts():
    return _pref_with() + f"SELECT model, pair_id, strategy, {_diff_cols()} FROM pairs"


def identical_filter_report():
    return _pref_with() + f"""SELECT model, total, removed, kept, identical_sets,
  round(coalesce(100.0 * removed / nullif(total, 0), 0.0), {R}) AS removed_pct, round(coalesce(100.0 * kept / nullif(total, 0), 0.0), {R}) AS kept_pct
FROM (SELECT model, count(*)::BIGINT AS total, count(*) FILTER (WHERE chosen = rejected)::BIGINT AS removed,
             count(*) FILTER (WHERE chosen <> rejected)::BIGINT AS kept,
             count(*) FILTER (WHERE {S.identical_sql('gold', 'rejected_annotations')})::BIGINT AS identical_sets
      FROM pairs GROUP BY model)"""


def pairs_preview():
    first = f"list_filter(string_split(prompt, chr(10)), lambda l: starts_with(l, {q(MARKERS['current'])}))[1]"
    return _pref_with() + f"""SELECT model, sample, pair_id, strategy,
  coalesce(CASE WHEN contains(prompt, 'TO_PAT_YN: Y') THEN 'Y' WHEN contains(prompt, 'TO_PAT_YN: N') THEN 'N' END, 'N/A') AS to_pat_yn,
  left(coalesce({strip(f"replace({first}, {q(MARKERS['current'])}, '')")}, 'N/A'), 100) AS current_sentence,
  num_chosen::BIGINT AS num_chosen, num_rejected::BIGINT AS num_rejected, {_diff_cols()}
FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY pair_id)::BIGINT AS sample FROM pairs) WHERE sample <= 3"""


def run_config():
    import json

    from spanpref.operators.pairs import VERSION
    from spanpref.plans.queries import PARAMS

    strategies = json.dumps({s: w / 100 for s, w in PARAMS.strategies})
    return _pref_with() + f"""SELECT model, {PARAMS.seed}::BIGINT AS seed, {PARAMS.negatives_per_sample}::BIGINT AS negatives_per_sample,
  count(*)::BIGINT AS total_pairs, (SELECT count(*) FROM fx_ex)::BIGINT AS original_samples,
  (SELECT count(*) FROM pg WHERE NOT (gold_strict AND gold_si IS NOT NULL))::BIGINT AS skipped_invalid,
  {q(strategies)} AS strategies, {q(VERSION)} AS version
FROM pairs WHERE chosen <> rejected GROUP BY model"""


def pair_metadata():
    ctx = []
    for name, marker in MARKERS.items():
        last = f"list_filter(string_split(prompt, chr(10)), lambda l: starts_with(l, {q(marker)}))[-1]"
        ctx.append(f"'{name}': {strip(f'replace({last}, {q(marker)}, {q(str())})')}")
    yn = "CASE WHEN contains(prompt, 'TO_PAT_YN: Y') THEN 'Y' WHEN contains(prompt, 'TO_PAT_YN: N') THEN 'N' END"
    return _pref_with() + f"""SELECT model, pair_id, to_json({{'strategy': strategy, 'context': {{'TO_PAT_YN': {yn}, {", ".join(ctx)}}},
  'num_chosen': num_chosen, 'num_rejected': num_rejected}})::VARCHAR AS metadata FROM pairs"""


def strategy_ranking():
    return _pref_with() + f"""SELECT s.model, s.strategy, s.count, round(coalesce(100.0 * s.count / nullif(e.emitted, 0), 0.0), {R}) AS pct,
  row_number() OVER (PARTITION BY s.model ORDER BY s.count DESC, s.strategy)::BIGINT AS place
FROM (SELECT model, strategy, count(*)::BIGINT AS count FROM pairs GROUP BY ALL) s
LEFT JOIN (SELECT model, count(*) AS emitted FROM pairs WHERE chosen <> rejected GROUP BY model) e USING (model)"""


def forced_fallbacks():
    from spanpref.plans.queries import FORCED

    return _pref_with(FORCED) + "SELECT model, pair_id, strategy, rejected FROM pairs"


def quarantine_report():
    return _pref_with() + """SELECT CASE WHEN gold_strict THEN 'results_not_a_list' ELSE 'invalid_json' END AS reason, count(*)::BIGINT AS n_rows,
  min(ex_id) AS first_ex_id, max(ex_id) AS last_ex_id FROM pg WHERE NOT (gold_strict AND gold_si IS NOT NULL) GROUP BY 1"""


def pair_validity():
    ok = S.is_valid("a.code", "a.sub_code")
    return _pref_with() + f"""SELECT model, strategy, count(*)::BIGINT AS n_pairs,
  count(*) FILTER (WHERE len(list_filter(rejected_annotations, lambda a: NOT coalesce({ok}, false))) > 0)::BIGINT AS n_invalid
FROM pairs GROUP BY ALL"""


def pair_text_previews():
    def spans(arr, n):
        return f"array_to_string(list_transform({arr}, lambda a: left(a.span, {n})), '|')"

    def less(a, b):
        return f"list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"

    changed = "list_filter(gold, lambda a: len(list_filter(rejected_annotations, lambda b: b.span = a.span AND (b.code <> a.code OR b.sub_code <> a.sub_code))) > 0)"
    return _pref_with() + f"""SELECT model, pair_id, left(chosen, 300) AS chosen_300, left(rejected, 300) AS rejected_300,
  {spans('gold', 70)} AS chosen_spans_70, {spans('rejected_annotations', 70)} AS rejected_spans_70,
  {spans(less('rejected_annotations', 'gold'), 50)} AS added_spans_50, {spans(less('gold', 'rejected_annotations'), 50)} AS removed_spans_50,
  {spans(changed, 40)} AS changed_spans_40 FROM pairs"""


def first_examples():
    return _with(S.fixture_ctes()) + "SELECT ex_id, query, answer FROM fx_ex ORDER BY ex_id LIMIT 100"


def confusion_csv():
    return _with(S.eval_ctes(), S.labsets_cte(), S.conf_table_cte()) + "SELECT model, kind, gt, pred, cnt FROM conf"


def generated_predictions():
    from spanpref.plans.queries import STUB_ANSWER

    before, after = STUB_ANSWER.split("%s")
    return _with(S.fixture_ctes()) + f"SELECT 'stub' AS model, ex_id, {q(before)} || md5(query) || {q(after)} AS pred_text FROM fx_ex"


def pairs_sink():
    return f"SELECT p.model, p.pair_id, p.prompt, p.chosen, p.rejected, m.metadata, p.strategy FROM ({preference_pairs()}) p JOIN ({pair_metadata()}) m USING (model, pair_id)"


def token_weights_words_no_offsets():
    from spanpref.plans.queries import TOKEN_PARAMS

    return _weights_of(_pref_with().rstrip() + ",\n" + S.word_token_ctes(TOKEN_PARAMS) + "\n", "CASE WHEN {pre}_start < 0 THEN -1 ELSE {pre}_start - 1 END")


def _token_with(with_loss: bool = False, offsets: bool = True):
    import math

    from spanpref.plans.queries import LOSS_PARAMS, PARAMS, TOKEN_PARAMS

    ctes = [S.token_ctes(TOKEN_PARAMS, offsets)]
    if with_loss:
        ctes += [S.token_logp_ctes(PARAMS.seed), S.sequence_cte(math.log(LOSS_PARAMS.policy_prob_threshold))]
    return _pref_with().rstrip() + ",\n" + ",\n".join(ctes) + "\n"


def token_labels():
    parts = []
    for side, pre in (("chosen", "c"), ("rejected", "r")):
        parts.append(
            f"""SELECT model, pair_id, '{side}' AS side, len(list_filter({pre}_lab, lambda x: x = -100))::BIGINT AS n_masked,
  coalesce(list_sum(list_filter({pre}_lab, lambda x: x <> -100)), 0)::BIGINT AS label_sum FROM tk"""
        )
    return _token_with() + "\nUNION ALL\n".join(parts)


def token_weights(offsets: bool = True):
    return _weights_of(_token_with(offsets=offsets))


def _weights_of(ctes: str, start: str = "{pre}_start"):
    parts = []
    for side, pre in (("chosen", "c"), ("rejected", "r")):
        parts.append(
            f"""SELECT model, pair_id, '{side}' AS side, len({pre}_ids)::BIGINT AS n_tokens, ({start.format(pre=pre)})::BIGINT AS answer_start,
  len(list_filter({pre}_lab, lambda x: x <> -100))::BIGINT AS n_supervised,
  len(list_filter({pre}_w, lambda x: x > 1.0))::BIGINT AS n_upweighted,
  round(list_reduce({pre}_w, lambda a, x: a + x, 0.0::DOUBLE), 4) AS weight_sum FROM tk"""
        )
    return ctes + "\nUNION ALL\n".join(parts)


def padded_batches():
    return _token_with() + """SELECT model, batch, max(ml)::BIGINT AS max_len, count(*)::BIGINT AS n_pairs,
  sum(2 * bm - len(c_ids) - len(r_ids))::BIGINT AS n_padding
FROM (SELECT *, greatest(len(c_ids), len(r_ids)) AS ml, max(greatest(len(c_ids), len(r_ids))) OVER (PARTITION BY model, batch) AS bm FROM tk)
GROUP BY model, batch"""


def sequence_logp():
    return _token_with(True) + f"""SELECT model, pair_id, round(pi_c, {R}) AS pi_c, round(pi_r, {R}) AS pi_r, round(ref_c, {R}) AS ref_c,
  round(ref_r, {R}) AS ref_r, round(barrier, {R}) AS barrier, chosen_tokens, rejected_tokens, gate_tokens FROM sq"""


def preference_loss_metrics():
    from spanpref.plans.queries import LOSS_PARAMS as P

    b = P.beta
    return _token_with(True) + f"""SELECT model, batch, n_pairs, round(loss_preference + loss_barrier, {R}) AS loss,
  round(loss_preference, {R}) AS loss_preference, round(loss_barrier, {R}) AS loss_barrier,
  round(policy_prob_chosen, {R}) AS policy_prob_chosen, round(barrier_active_pct, {R}) AS barrier_active_pct,
  round(pref_p_pref, {R}) AS pref_p_pref, round(logits_mean, {R}) AS logits_mean, round(logits_max, {R}) AS logits_max,
  round(logits_min, {R}) AS logits_min
FROM (SELECT model, batch, count(*)::BIGINT AS n_pairs,
        avg(greatest(-{b} * x, 0.0) + ln(1 + exp(-abs(-{b} * x)))) AS loss_preference,
        avg(barrier) * {P.sft_barrier_weight} AS loss_barrier, avg(exp(pi_c)) AS policy_prob_chosen,
        sum(gate_tokens) / greatest(sum(chosen_tokens)::DOUBLE, 1.0) AS barrier_active_pct,
        avg(1.0 / (1.0 + exp(-({b} * x)))) AS pref_p_pref, avg(x) AS logits_mean, max(x) AS logits_max, min(x) AS logits_min
      FROM (SELECT *, (pi_c - pi_r) - (ref_c - ref_r) AS x, (row_number() OVER (PARTITION BY model ORDER BY pair_id) - 1) // {P.batch_size} AS batch FROM sq)
      GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "parse_status": parse_status(),
        "format_flags": format_flags(),
        "annotations_long": annotations_long(),
        "context_fields": context_fields(),
        "unmatched_report": unmatched_report(),
        "code_confusion_edges": edges("code", False),
        "subcode_confusion_edges": edges("sub_code", False),
        "code_confusion_edges_with_none": edges("code", True),
        "subcode_confusion_edges_with_none": edges("sub_code", True),
        "confusion_weights": confusion_weights(),
        "top_confusions": top_confusions(),
        "confusion_totals": confusion_totals(),
        "code_prf": prf("code"),
        "subcode_prf": prf("sub_code"),
        "span_prf": prf("span"),
        "eval_report_by_model": eval_report_by_model(),
        "per_example_metrics": per_example_metrics(),
        "prediction_dump": prediction_dump(),
        "preference_pairs": preference_pairs(),
        "pair_metadata": pair_metadata(),
        "negatives_long": negatives_long(),
        "strategy_distribution": strategy_distribution(),
        "pair_diff_counts": pair_diff_counts(),
        "identical_filter_report": identical_filter_report(),
        "pairs_preview": pairs_preview(),
        "run_config": run_config(),
        "token_labels": token_labels(),
        "token_weights": token_weights(),
        "token_weights_no_offsets": token_weights(offsets=False),
        "padded_batches": padded_batches(),
        "sequence_logp": sequence_logp(),
        "preference_loss_metrics": preference_loss_metrics(),
        "strategy_ranking": strategy_ranking(),
        "forced_fallbacks": forced_fallbacks(),
        "quarantine_report": quarantine_report(),
        "pair_validity": pair_validity(),
        "pair_text_previews": pair_text_previews(),
        "first_examples": first_examples(),
        "confusion_csv": confusion_csv(),
        "generated_predictions": generated_predictions(),
        "token_weights_words_no_offsets": token_weights_words_no_offsets(),
        "prediction_dump_sink": prediction_dump(),
        "pairs_sink": pairs_sink(),
        "run_config_sink": run_config(),
        "example_metrics_sink": per_example_metrics(),
        "token_table_sink": padded_batches(),
        "doc_code_confusion_edges": edges("code", False, "documents"),
        "doc_eval_report_by_model": eval_report_by_model("documents"),
    }
