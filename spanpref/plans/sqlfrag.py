"""DuckDB SQL fragments shared by the oracle queries.

These are the SQL twins of the Spark column helpers: the same keyed md5
draws, the same label vocabulary and the same parse/repair rules, written as
plain DuckDB SQL so the driver can run them on the same Parquet tables.
"""

from __future__ import annotations

from spanpref.functions import vocab
from spanpref.functions.jsonish import SUBCODE_VALUE  # noqa: F401  (documentation link)
from spanpref.sources.fixtures import BROKEN_GOLD, CONV_ID_STRIDE, DOC_ID_STRIDE, GOLD_SEED, INSTRUCTION, LOST_SHARE, MODELS, NULL_RESULTS, PADDED, ROOT_ARRAY


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def u(seed, *parts: str) -> str:
    """Uniform draw in [0, 1) from md5 over the ``|``-joined key (twin of ``draws.draw``)."""
    key = ", ".join([str(seed)] + list(parts))
    return f"(('0x' || substr(md5(concat_ws('|', {key})), 1, 13))::BIGINT / 4503599627370496.0)"


def str_list(xs) -> str:
    return "([" + ", ".join(q(x) for x in xs) + "]::VARCHAR[])"


def pairs_list() -> str:
    return "[" + ", ".join("{'code': %s, 'sub_code': %s}" % (q(c), q(s)) for c, s in vocab.hierarchy_pairs()) + "]"


def valid_subs(code: str) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {str_list(subs)}" for c, subs in vocab.CODE_SUBCODES.items())
    return f"(CASE {code} {whens} ELSE ([]::VARCHAR[]) END)"


def subs_or_fallback(code: str) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {str_list(subs)}" for c, subs in vocab.CODE_SUBCODES.items())
    return f"(CASE {code} {whens} ELSE {str_list([vocab.FALLBACK_SUB_CODE])} END)"


def canon(label: str, kind: str) -> str:
    """Canonical label or NULL (twin of ``labels.canonicalize``)."""
    pairs = vocab.canon_pairs(vocab.CODE_SET if kind == "code" else vocab.SUB_CODE_SET)
    whens = " ".join(f"WHEN {q(n)} THEN {q(c)}" for n, c in pairs)
    return f"(CASE {norm(label)} {whens} END)"


def norm(label: str) -> str:
    return f"lower(trim(regexp_replace({label}, '[\\s\\x1c-\\x1f]+', ' ', 'g')))"


def answer_text(annots: str) -> str:
    item = """'{"Code":"' || a.code || '","Sub-code":"' || a.sub_code || '","Span":"' || a.span || '"}'"""
    return f"""('{{"results":[' || array_to_string(list_transform({annots}, lambda a: {item}), ',') || ']}}')"""


def flat(text: str) -> str:
    return f"coalesce(replace({text}, chr(10), ' '), '')"


def sentences_sql(source: str = "conversations") -> str:
    if source == "conversations":
        return f"SELECT conv_id AS grp, turn AS seq, role, text, {CONV_ID_STRIDE} AS stride FROM conversations"
    return f"""SELECT doc_id AS grp, (i - 1)::BIGINT AS seq,
          CASE WHEN (i - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, line AS text, {DOC_ID_STRIDE} AS stride
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                     unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
        WHERE trim(line) <> ''"""


def fixture_ctes(source: str = "conversations") -> str:
    """CTEs ``fx_ex(ex_id, grp, seq, query, answer, gold, words)`` and ``fx_pred(model, ex_id, pred_text)``."""
    g = GOLD_SEED

    def ug(*p):
        return u(g, "grp", "seq", *p)

    start = f"floor({ug(q('s'), 'k')} * greatest(len(words) - 5, 1))::BIGINT"
    gold_item = (
        "{'code': " + pairs_list() + f"[floor({ug(q('pair'), 'k')} * 36)::BIGINT + 1].code, "
        "'sub_code': " + pairs_list() + f"[floor({ug(q('pair'), 'k')} * 36)::BIGINT + 1].sub_code, "
        f"'span': array_to_string(list_slice(words, {start} + 1, {start} + floor({ug(q('l'), 'k')} * 5)::BIGINT + 1), ' ')}}"
    )
    padded = f"seq % {PADDED[0]} = {PADDED[1]}"
    query = (
        f"{q(INSTRUCTION)} || chr(10) || 'TO_PAT_YN: ' || CASE WHEN role = 'assistant' THEN 'Y' ELSE 'N' END"
        f" || chr(10) || 'Previous sentence: ' || {flat('prev_text')}"
        f" || chr(10) || 'Current sentence: ' || CASE WHEN {padded} THEN chr(9) ELSE '' END || {flat('text')}"
        f" || CASE WHEN {padded} THEN chr(160) || chr(13) ELSE '' END"
        f" || chr(10) || 'Next sentence: ' || {flat('next_text')}"
    )
    models = ", ".join(f"({q(name)}, {ms})" for name, ms in MODELS)
    cut, null, array = (bound for _, bound in BROKEN_GOLD)
    answer = (
        f"CASE WHEN {ug(q('broken'))} < {cut} THEN left(whole, floor(length(whole) * 0.8)::BIGINT) "
        f"WHEN {ug(q('broken'))} < {null} THEN {q(NULL_RESULTS)} WHEN {ug(q('broken'))} < {array} THEN {q(ROOT_ARRAY)} ELSE whole END"
    )
    return f"""
fx_sent AS ({sentences_sql(source)}),
fx_b0 AS (
  SELECT c.grp, c.seq, c.role, c.text, c.stride, p.text AS prev_text, n.text AS next_text,
         list_filter(string_split(regexp_replace(c.text, '[^\\p{{L}} ]', ' ', 'g'), ' '), lambda w: w <> '') AS words
  FROM fx_sent c
  LEFT JOIN fx_sent p ON p.grp = c.grp AND p.seq = c.seq - 1
  LEFT JOIN fx_sent n ON n.grp = c.grp AND n.seq = c.seq + 1),
fx_b1 AS (SELECT *, list_transform(range(floor({ug(q('n'))} * 4)::BIGINT), lambda k: {gold_item}) AS gold0 FROM fx_b0),
fx_b2 AS (SELECT *, CASE WHEN {ug(q('dup'))} < 0.05 AND len(gold0) > 0 THEN list_append(gold0, gold0[1]) ELSE gold0 END AS gold FROM fx_b1),
fx_b3 AS (SELECT *, {answer_text('gold')} AS whole FROM fx_b2),
fx_ex AS (SELECT grp * stride + seq AS ex_id, grp, seq, {query} AS query, {answer} AS answer, gold, words FROM fx_b3),
fx_m AS (SELECT * FROM (VALUES {models}) AS m(model, ms)),
{_noisy_pred_ctes()}"""


def _noisy_pred_ctes() -> str:
    """Staged twin of ``fixtures._noisy_annotations`` + format noise (per model seed ``ms``)."""

    def um(*p):
        return u("ms", "grp", "seq", *p)

    k = "(i - 1)"
    codes = str_list(vocab.CODE_SET)
    ci = f"(list_position({codes}, a.code) - 1)"
    alt = um(q("alt"), k)
    new_code = f"{codes}[((({ci} + 1 + floor({alt} * 7)::BIGINT) % 8) + 1)]"
    d1 = (
        f"list_transform(gold, lambda a, i: {{'code': a.code, 'sub_code': a.sub_code, 'span': a.span, "
        f"'fate': {um(q('fate'), k)}, 'alt': {alt}, 'alt2': {um(q('alt2'), k)}, 'noisy': {um(q('case'), k)} < 0.10, "
        f"'subs': {valid_subs('a.code')}, 'new_code': {new_code}}})"
    )
    subs = "d.subs"
    old = f"(list_position({subs}, d.sub_code) - 1)"
    other_sub = (
        f"(CASE WHEN len({subs}) > 1 THEN {subs}[((({old} + 1 + floor(d.alt * (len({subs}) - 1))::BIGINT) % len({subs})) + 1)] "
        "ELSE d.sub_code END)"
    )
    new_sub = "(CASE WHEN list_contains(ns, d.sub_code) THEN d.sub_code ELSE ns[floor(d.alt2 * len(ns))::BIGINT + 1] END)"
    short = "array_to_string(list_slice(string_split(d.span, ' '), 2, len(string_split(d.span, ' '))), ' ')"
    recode = "(d.fate >= 0.70 AND d.fate < 0.85)"
    d2 = (
        f"list_transform(d1, lambda d: list_transform([{valid_subs('d.new_code')}], lambda ns: "
        f"{{'keep': NOT (d.fate >= 0.85 AND d.fate < 0.95), 'noisy': d.noisy, "
        f"'code': CASE WHEN {recode} THEN d.new_code ELSE d.code END, "
        f"'sub_code': CASE WHEN d.fate >= 0.55 AND d.fate < 0.70 THEN {other_sub} WHEN {recode} THEN {new_sub} ELSE d.sub_code END, "
        f"'span': CASE WHEN d.fate >= 0.95 THEN {short} ELSE d.span END}})[1])"
    )
    kept = (
        "list_transform(list_filter(d2, lambda a: a.keep), lambda a: {'code': CASE WHEN a.noisy THEN ' ' || lower(a.code) || '  ' "
        "ELSE a.code END, 'sub_code': CASE WHEN a.noisy THEN upper(a.sub_code) ELSE a.sub_code END, 'span': a.span})"
    )
    pairs = pairs_list()
    xi = f"floor({um(q('xp'))} * 36)::BIGINT + 1"
    xs = f"floor({um(q('xs'))} * greatest(len(words) - 3, 1))::BIGINT"
    extra = (
        f"{{'code': {pairs}[{xi}].code, 'sub_code': {pairs}[{xi}].sub_code, "
        f"'span': array_to_string(list_slice(words, {xs} + 1, {xs} + 2), ' ')}}"
    )
    sq, dq = "''''", "'\"'"
    fmt_case = (
        "CASE WHEN fmt < 0.70 THEN js WHEN fmt < 0.80 THEN js || ' done' "
        "WHEN fmt < 0.88 THEN '```json' || chr(10) || js || chr(10) || '```' "
        f"WHEN fmt < 0.94 THEN replace(js, {dq}, {sq}) WHEN fmt < 0.97 THEN replace(js, {dq}, '&quot;') "
        "ELSE left(js, floor(length(js) * 0.8)::BIGINT) END"
    )
    return f"""fx_p1 AS (SELECT m.model, m.ms, e.ex_id, e.grp, e.seq, e.words, {d1} AS d1 FROM fx_ex e, fx_m m),
fx_p2 AS (SELECT *, {d2} AS d2 FROM fx_p1),
fx_p3 AS (SELECT *, {kept} AS kept FROM fx_p2),
fx_p4 AS (SELECT *, CASE WHEN {um(q('x'))} < 0.12 THEN list_append(kept, {extra}) ELSE kept END AS annots FROM fx_p3),
fx_p5 AS (SELECT model, ex_id, {answer_text('annots')} AS js, {um(q('fmt'))} AS fmt FROM fx_p4 WHERE {um(q('lost'))} >= {LOST_SHARE}),
fx_pred AS (SELECT model, ex_id, {fmt_case} AS pred_text FROM fx_p5)"""


# ---------------------------------------------------------------------------
# parse / repair (twin of spanpref.functions.jsonish)
# ---------------------------------------------------------------------------
ANN_T = "STRUCT(code VARCHAR, sub_code VARCHAR, span VARCHAR)[]"
REPAIR_RE = r'\{\s*"Code"\s*:\s*"[^"]*"\s*,\s*"Sub-code"\s*:\s*"[^"]*"\s*,\s*"Span"\s*:\s*"[^"]*"\s*\}'
FIX_RE = r'\{\s*"Code"\s*:\s*"[^"]+"\s*,\s*"Sub-code"\s*:\s*"[^"]+"\s*,\s*"Span"\s*:\s*"[^"]+"\s*\}'
VALID_FORMAT_RE = (
    r'^\{\s*"results"\s*:\s*\[(\s*\{\s*"Code"\s*:\s*' + "'[^']+'" + r'\s*,\s*"Sub-code"\s*:\s*' + "'[^']+'"
    + r'\s*,\s*"Span"\s*:\s*' + "'[^']+'" + r'\s*\}\s*,?)*\s*\]\s*\}$'
)


def _items(json_list: str) -> str:
    return (
        f"list_filter(list_transform({json_list}, lambda x: {{'code': json_extract_string(x, '$.Code'), "
        "'sub_code': json_extract_string(x, '$.\"Sub-code\"'), 'span': json_extract_string(x, '$.Span')}), "
        "lambda a: a.code IS NOT NULL OR a.sub_code IS NOT NULL OR a.span IS NOT NULL)"
    )


def unescape(t: str) -> str:
    chain = t
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        chain = f"replace({chain}, {q(a)}, {q(b)})"
    return f"(CASE WHEN contains({t}, '&') THEN {chain} ELSE {t} END)"


def parse_cols(t: str, p: str) -> str:
    """Select-list adding ``{p}_strict, {p}_mode, {p}_bad_shape, {p}_results`` (uses a lateral alias)."""
    strict = f"coalesce(json_valid({t}), false)"
    strict_items = (
        f"(CASE WHEN {strict} AND json_type({t}, '$.results') = 'ARRAY' "
        f"THEN {_items(f'json_extract({t}, {q(chr(36) + '.results[*]')})')} END)"
    )
    fixed = f"replace(replace({unescape(t)}, '''', '\"'), '\\', '\\\\')"
    rep = _items(f"list_filter(regexp_extract_all({fixed}, {q(REPAIR_RE)}), lambda m: json_valid(m))")
    return (
        f"{strict} AS {p}_strict, {strict_items} AS {p}_si, CASE WHEN {strict} THEN NULL ELSE {rep} END AS {p}_ri, "
        f"CASE WHEN {p}_strict THEN 'strict' WHEN len({p}_ri) > 0 THEN 'repaired' ELSE 'empty' END AS {p}_mode, "
        f"({p}_strict AND {p}_si IS NULL) AS {p}_bad_shape, "
        f"CASE WHEN {p}_strict THEN coalesce({p}_si, []::{ANN_T}) ELSE coalesce({p}_ri, []::{ANN_T}) END AS {p}_results"
    )


def eval_ctes(source: str = "conversations") -> str:
    """Fixture + parsed evaluation table ``ev(model, ex_id, pred_text, answer, gold_*, pred_*)``."""
    return (
        fixture_ctes(source)
        + f""",
ev_g AS (SELECT ex_id, answer, query, {parse_cols('answer', 'gold')} FROM fx_ex),
ev_p AS (SELECT model, ex_id, pred_text, {parse_cols('pred_text', 'pred')} FROM fx_pred),
ev AS (SELECT m.model, g.ex_id, p.pred_text, g.answer, g.query, g.gold_mode, g.gold_bad_shape, g.gold_results,
              coalesce(p.pred_mode, 'empty') AS pred_mode, coalesce(p.pred_bad_shape, false) AS pred_bad_shape,
              coalesce(p.pred_results, []::{ANN_T}) AS pred_results
       FROM ev_g g CROSS JOIN (SELECT DISTINCT model FROM fx_pred) m LEFT JOIN ev_p p ON p.model = m.model AND p.ex_id = g.ex_id)"""
    )


def canon_set(results: str, field: str, kind: str) -> str:
    return f"list_distinct(list_filter(list_transform({results}, lambda a: {canon('a.' + field, kind)}), lambda x: x IS NOT NULL))"


def exact_set(results: str, field: str, kind: str) -> str:
    voc = str_list(vocab.CODE_SET if kind == "code" else vocab.SUB_CODE_SET)
    return f"list_distinct(list_filter(list_transform({results}, lambda a: a.{field}), lambda x: list_contains({voc}, x)))"


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def word_set(s: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({s}), '[\\s\\x1c-\\x1f]+'), lambda w: w <> ''))"


def labsets_cte(src: str = "ev") -> str:
    return f"""ls AS (SELECT *,
   {canon_set('gold_results', 'code', 'code')} AS true_codes, {canon_set('pred_results', 'code', 'code')} AS pred_codes,
   {canon_set('gold_results', 'sub_code', 'sub_code')} AS true_subcodes, {canon_set('pred_results', 'sub_code', 'sub_code')} AS pred_subcodes
 FROM {src})"""


def edges_sql(tcol: str, pcol: str, include_none: bool) -> str:
    fn, fp = minus(tcol, pcol), minus(pcol, tcol)
    if include_none:
        none = f"[{q(vocab.NONE_TOKEN)}]"
        fn2 = f"CASE WHEN len({fn}) = 0 AND len({fp}) > 0 THEN {none} ELSE {fn} END"
        fp2 = f"CASE WHEN len({fp}) = 0 AND len({fn}) > 0 THEN {none} ELSE {fp} END"
        fn, fp = fn2, fp2
    return f"""SELECT model, ground_truth, predicted, count(*)::BIGINT AS count FROM (
  SELECT model, ground_truth, unnest(fp) AS predicted FROM (
    SELECT model, unnest(fn) AS ground_truth, fp FROM (SELECT model, {fn} AS fn, {fp} AS fp FROM ls)))
GROUP BY ALL"""


def span_tp_sql(tws: str, pws: str, thr: float = 0.6) -> str:
    match = (
        f"(list_has_all(p, {tws}[j + 1]) OR list_has_all({tws}[j + 1], p) OR "
        f"(len(list_distinct(list_concat(p, {tws}[j + 1]))) > 0 AND "
        f"len(list_intersect(p, {tws}[j + 1])) / len(list_distinct(list_concat(p, {tws}[j + 1]))) >= {thr}))"
    )
    first = f"list_filter(st.rem, lambda j: {match})[1]"
    step = (
        f"lambda st, p: {{'rem': CASE WHEN {first} IS NULL THEN st.rem ELSE list_filter(st.rem, lambda r: r <> {first}) END, "
        f"'tp': st.tp + CASE WHEN {first} IS NULL THEN 0 ELSE 1 END}}"
    )
    init = f"{{'rem': range(len({tws})), 'tp': 0}}"
    return f"list_reduce({pws}, {step}, {init}).tp"


def counts_cte(src: str = "ev") -> str:
    cols = []
    for kind in ("code", "sub_code"):
        t = exact_set("gold_results", kind, kind)
        p = exact_set("pred_results", kind, kind)
        cols.append(
            f"len(list_intersect({t}, {p}))::BIGINT AS {kind}_tp, len({minus(p, t)})::BIGINT AS {kind}_fp, "
            f"len({minus(t, p)})::BIGINT AS {kind}_fn"
        )
    tws = f"list_transform(list_filter(list_transform(gold_results, lambda a: a.span), lambda s: s IS NOT NULL), lambda s: {word_set('s')})"
    pws = f"list_transform(list_filter(list_transform(pred_results, lambda a: a.span), lambda s: s IS NOT NULL), lambda s: {word_set('s')})"
    return f"""ec0 AS (SELECT *, {", ".join(cols)}, {tws} AS tws, {pws} AS pws FROM {src}),
ec AS (SELECT *, {span_tp_sql('tws', 'pws')}::BIGINT AS span_tp FROM ec0),
cnt AS (SELECT *, len(pws) - span_tp AS span_fp, len(tws) - span_tp AS span_fn FROM ec)"""


def prf_sql(tp: str, fp: str, fn: str) -> str:
    return (
        f"coalesce({tp}::DOUBLE / nullif({tp} + {fp}, 0), 0.0) AS p, coalesce({tp}::DOUBLE / nullif({tp} + {fn}, 0), 0.0) AS r, "
        f"coalesce((2 * {tp})::DOUBLE / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0) AS f1"
    )


def conf_table_cte() -> str:
    return f"""conf AS (
  SELECT model, 'code' AS kind, ground_truth AS gt, predicted AS pred, count AS cnt FROM ({edges_sql('true_codes', 'pred_codes', False)})
  UNION ALL
  SELECT model, 'sub_code' AS kind, ground_truth AS gt, predicted AS pred, count AS cnt FROM ({edges_sql('true_subcodes', 'pred_subcodes', False)}))"""


# ---------------------------------------------------------------------------
# negative generation (twin of spanpref.operators.negatives)
# ---------------------------------------------------------------------------
_n = [0]


def fresh(prefix: str = "v") -> str:
    _n[0] += 1
    return f"{prefix}{_n[0]}"


def let(value: str, body) -> str:
    """``body(name)`` with ``value`` bound once (list_transform over a 1-element list)."""
    v = fresh()
    return f"list_transform([{value}], lambda {v}: {body(v)})[1]"


def lookup(conf_list: str, key: str) -> str:
    e = fresh("e")
    return f"list_filter({conf_list}, lambda {e}: {e}.gt = {key})[1].lst"


def is_valid(code: str, sub: str) -> str:
    return f"coalesce(list_contains({valid_subs(code)}, {sub}), false)"


def sum_cnt(lst: str) -> str:
    x = fresh("c")
    return f"coalesce(list_sum(list_transform({lst}, lambda {x}: {x}.cnt)), 0)::BIGINT"


def pick(arr: str, u_: str) -> str:
    return f"{arr}[floor({u_} * len({arr}))::BIGINT + 1]"


def weighted_pick(lst: str, weight, total: str, u_: str) -> str:
    st, x = fresh("st"), fresh("x")
    r = f"floor({u_} * {total})"
    w = weight(x)
    return (
        f"list_reduce({lst}, lambda {st}, {x}: {{'acc': {st}.acc + {w}, "
        f"'hit': coalesce({st}.hit, CASE WHEN {st}.acc + {w} > {r} THEN {x}.pred END)}}, "
        f"{{'acc': 0::BIGINT, 'hit': NULL::VARCHAR}}).hit"
    )


CONF_LIST_T = "STRUCT(pred VARCHAR, cnt BIGINT)[]"


def replace_at(arr: str, k: str, code: str, sub: str) -> str:
    b, j = fresh("b"), fresh("j")
    return (
        f"list_transform({arr}, lambda {b}, {j}: CASE WHEN {j} - 1 = {k} "
        f"THEN {{'code': {code}, 'sub_code': {sub}, 'span': {b}.span}} ELSE {b} END)"
    )


def valid_conf(code: str, sub: str) -> str:
    x = fresh("x")
    return f"list_filter(coalesce({lookup('sub_conf', sub)}, []::{CONF_LIST_T}), lambda {x}: {is_valid(code, x + '.pred')})"


def sub_positions(arr: str) -> str:
    a, i, p = fresh("a"), fresh("i"), fresh("p")
    return (
        f"list_filter(list_transform({arr}, lambda {a}, {i}: CASE WHEN len({valid_conf(a + '.code', a + '.sub_code')}) > 0 "
        f"THEN {i} - 1 END), lambda {p}: {p} IS NOT NULL)"
    )


def code_positions(arr: str) -> str:
    a, i, p = fresh("a"), fresh("i"), fresh("p")
    return (
        f"list_filter(list_transform({arr}, lambda {a}, {i}: CASE WHEN coalesce(len({lookup('code_conf', a + '.code')}), 0) > 0 "
        f"THEN {i} - 1 END), lambda {p}: {p} IS NOT NULL)"
    )


def g2_sql(arr: str, positions: str, u_pos: str, u_lab: str) -> str:
    def at(k):
        def with_a(a):
            def with_lst(lst):
                def with_valid(valid):
                    stats = (
                        f"{{'nv': len({valid})::BIGINT, 'tot': {sum_cnt(lst)}, 'rest': {sum_cnt(lst)} - {sum_cnt(valid)}}}"
                    )
                    return let(
                        stats,
                        lambda s: replace_at(
                            arr, k, f"{a}.code",
                            weighted_pick(valid, lambda x: f"{s}.nv * {x}.cnt + {s}.rest", f"({s}.tot * {s}.nv)", u_lab),
                        ),
                    )

                x = fresh("x")
                return let(f"list_filter({lst}, lambda {x}: {is_valid(a + '.code', x + '.pred')})", with_valid)

            return let(f"coalesce({lookup('sub_conf', a + '.sub_code')}, []::{CONF_LIST_T})", with_lst)

        return let(f"{arr}[{k} + 1]", with_a)

    return f"(CASE WHEN len({positions}) > 0 THEN {let(pick(positions, u_pos), at)} END)"


def g3_sql(arr: str, positions: str, u_pos: str, u_lab: str, u_sub: str) -> str:
    def at(k):
        def with_a(a):
            def with_lst(lst):
                def with_code(c):
                    fb = subs_or_fallback(c)
                    new_sub = f"(CASE WHEN {is_valid(c, a + '.sub_code')} THEN {a}.sub_code ELSE {pick(fb, u_sub)} END)"
                    return replace_at(arr, k, c, new_sub)

                return let(weighted_pick(lst, lambda x: f"{x}.cnt", sum_cnt(lst), u_lab), with_code)

            return let(lookup("code_conf", f"{a}.code"), with_lst)

        return let(f"{arr}[{k} + 1]", with_a)

    return f"(CASE WHEN len({positions}) > 0 THEN {let(pick(positions, u_pos), at)} END)"


def corrupt_span(span: str) -> str:
    w = fresh("w")
    words = f"list_filter(regexp_split_to_array({span}, '[\\s\\x1c-\\x1f]+'), lambda {w}: {w} <> '')"
    return let(
        words,
        lambda ws: f"(CASE WHEN len({ws}) > 2 THEN array_to_string(list_slice({ws}, 1, floor(len({ws}) / 2)::BIGINT), ' ') "
        f"ELSE {span} || ' extra' END)",
    )


def identical_sql(a: str, b: str) -> str:
    x, y = fresh("x"), fresh("y")
    return (
        f"(len({a}) = len({b}) AND len(list_filter({a}, lambda {x}: NOT list_contains({b}, {x}))) = 0 "
        f"AND len(list_filter({b}, lambda {y}: NOT list_contains({a}, {y}))) = 0)"
    )


def negatives_ctes(seed: int, n_neg: int, strategies, max_attempts: int, gate: float) -> str:
    """CTEs ``neg(model, ex_id, neg_idx, query, answer, gold, rejected, strategy)`` after ``conf``."""
    from spanpref.functions import vocab as V

    def un(p):
        return u(seed, "model", "ex_id", "neg_idx", q(p))

    names = [s for s, _ in strategies]
    wcols = ", ".join(
        f"CASE WHEN {cond} THEN {w} ELSE 0 END AS w_{s}"
        for (s, w), cond in zip(
            strategies,
            ["len(code_pos) > 0", "len(sub_pos) > 0", "(len(code_pos) > 0 OR len(sub_pos) > 0)", "len(gold) > 1", "len(bag) > 0"],
        )
    )
    q10 = "((100 - total_w)::DOUBLE / 100.0)"
    qexp = q10
    for _ in range(max_attempts - 1):
        qexp = f"({qexp} * {q10})"
    r = f"floor({un('pick')} * total_w)"
    cum = "0"
    whens = []
    for s in names:
        cum = f"({cum} + w_{s})"
        whens.append(f"WHEN w_{s} > 0 AND {cum} > {r} THEN {q(s)}")
    drawn = (
        f"CASE WHEN len(gold) = 0 THEN 'spurious_annotation' WHEN {un('gate')} < {qexp} THEN 'forced' "
        + " ".join(whens) + " END"
    )
    g3 = g3_sql("gold", "code_pos", un("pos"), un("lab"), un("sub"))
    g2 = g2_sql("gold", "sub_pos", un("pos"), un("lab"))
    a_, i_ = fresh("a"), fresh("i")
    miss = f"list_filter(gold, lambda {a_}, {i_}: ({i_} - 1) <> floor({un('miss')} * len(gold)))"
    extra = let(
        pick("bag", un("x1")),
        lambda xc: f"list_append(gold, {{'code': {xc}, 'sub_code': {pick(subs_or_fallback(xc), un('x2'))}, "
        f"'span': {corrupt_span(pick('gold', un('x3')) + '.span')}}})",
    )
    spurious = let(
        f"coalesce({pick('gt_codes', un('sp1'))}, {q(V.FALLBACK_CODE)})",
        lambda sc: f"[{{'code': {sc}, 'sub_code': CASE WHEN len(gt_codes) > 0 THEN {pick(subs_or_fallback(sc), un('sp2'))} "
        f"ELSE {q(V.FALLBACK_SUB_CODE)} END, 'span': {q('spurious annotation')}}}]",
    )
    g4 = let(
        g3,
        lambda c1: f"(CASE WHEN {un('g4gate')} > {gate} THEN "
        + let(sub_positions(c1), lambda p2: f"coalesce({g2_sql(c1, p2, un('pos2'), un('lab2'))}, {c1})")
        + f" ELSE {c1} END)",
    )
    cand = (
        f"(CASE WHEN drawn = 'code_confusion' THEN {g3} WHEN drawn = 'subcode_confusion' THEN {g2} "
        f"WHEN drawn = 'code_and_subcode_confusion' THEN (CASE WHEN len(code_pos) > 0 THEN {g4} ELSE {g2} END) "
        f"WHEN drawn = 'missing_annotation' THEN {miss} WHEN drawn = 'extra_annotation' THEN {extra} "
        f"WHEN drawn = 'spurious_annotation' THEN {spurious} END)"
    )
    x_ = fresh("x")
    fv = (
        f"list_filter(coalesce({lookup('sub_conf', 'gold[1].sub_code')}, []::{CONF_LIST_T}), "
        f"lambda {x_}: {is_valid('gold[1].code', x_ + '.pred')})[1].pred"
    )
    gen_ok = is_valid("gold[1].code", q(V.FALLBACK_SUB_CODE))

    def one(c, s):
        return f"[{{'code': {c}, 'sub_code': {s}, 'span': gold[1].span}}]"

    forced_strategy = (
        f"CASE WHEN len(gold) > 1 THEN 'forced_missing_annotation' WHEN fv IS NOT NULL THEN 'forced_subcode_change' "
        f"WHEN {gen_ok} THEN 'forced_subcode_to_general' ELSE 'forced_code_change' END"
    )
    forced = (
        f"CASE WHEN len(gold) > 1 THEN list_slice(gold, 1, len(gold) - 1) WHEN fv IS NOT NULL THEN {one('gold[1].code', 'fv')} "
        f"WHEN {gen_ok} THEN {one('gold[1].code', q(V.FALLBACK_SUB_CODE))} "
        f"ELSE {one(q(V.FALLBACK_CODE), q(V.FALLBACK_SUB_CODE))} END"
    )
    none = q(V.NONE_TOKEN)
    return f"""cw AS (SELECT model, kind, gt, pred, cnt FROM conf WHERE gt <> pred AND cnt > 0 AND gt <> {none} AND pred <> {none}),
dl AS (SELECT model, kind, gt, list({{'pred': pred, 'cnt': cnt}} ORDER BY cnt DESC, pred) AS lst FROM cw GROUP BY ALL),
dm AS (SELECT model,
         coalesce(list({{'gt': gt, 'lst': lst}}) FILTER (WHERE kind = 'sub_code'), []) AS sub_conf,
         coalesce(list({{'gt': gt, 'lst': lst}}) FILTER (WHERE kind = 'code'), []) AS code_conf,
         coalesce(list(gt ORDER BY gt) FILTER (WHERE kind = 'code'), []::VARCHAR[]) AS gt_codes
       FROM dl GROUP BY model),
db AS (SELECT model, list(pred ORDER BY gt, pred) AS bag FROM cw WHERE kind = 'code' GROUP BY model),
dims AS (SELECT m.model, coalesce(dm.sub_conf, []) AS sub_conf, coalesce(dm.code_conf, []) AS code_conf,
                coalesce(dm.gt_codes, []::VARCHAR[]) AS gt_codes, coalesce(db.bag, []::VARCHAR[]) AS bag
         FROM (SELECT DISTINCT model FROM fx_pred) m LEFT JOIN dm USING (model) LEFT JOIN db USING (model)),
pg AS (SELECT ex_id, query, answer, {parse_cols('answer', 'gold')} FROM fx_ex),
gv AS (SELECT ex_id, query, answer, gold_si AS gold FROM pg WHERE gold_strict AND gold_si IS NOT NULL),
n0 AS (SELECT gv.*, dims.model, dims.sub_conf, dims.code_conf, dims.gt_codes, dims.bag FROM gv, dims),
n1 AS (SELECT *, {sub_positions('gold')} AS sub_pos, {code_positions('gold')} AS code_pos FROM n0),
n2 AS (SELECT *, {wcols} FROM n1),
n3 AS (SELECT *, {" + ".join("w_" + s for s in names)} AS total_w, r.range AS neg_idx FROM n2, range({n_neg}) r),
n4 AS (SELECT *, {drawn} AS drawn FROM n3),
n5 AS (SELECT *, {cand}::{ANN_T} AS cand FROM n4),
n6 AS (SELECT *, (drawn = 'forced' OR (drawn <> 'spurious_annotation' AND {identical_sql('cand', 'gold')})) AS forced_flag,
              CASE WHEN len(gold) = 1 THEN {fv} END AS fv FROM n5),
neg AS (SELECT model, ex_id, neg_idx, query, answer, gold,
               CASE WHEN forced_flag THEN ({forced})::{ANN_T} ELSE cand END AS rejected,
               CASE WHEN forced_flag THEN {forced_strategy} ELSE drawn END AS strategy FROM n6)"""


def ann_json(arr: str) -> str:
    a = fresh("a")
    item = f"""'{{"Code":"' || {a}.code || '","Sub-code":"' || {a}.sub_code || '","Span":"' || {a}.span || '"}}'"""
    return f"""('{{"results":[' || array_to_string(list_transform({arr}, lambda {a}: {item}), ',') || ']}}')"""


def pairs_cte(n_neg: int) -> str:
    return f"""pairs AS (SELECT model, ex_id * {n_neg} + neg_idx AS pair_id, ex_id, neg_idx, query AS prompt,
   {ann_json('gold')} AS chosen, answer AS chosen_raw, {ann_json('rejected')} AS rejected, strategy,
   len(gold) AS num_chosen, len(rejected) AS num_rejected, gold, rejected AS rejected_annotations FROM neg)"""


# ---------------------------------------------------------------------------
# token table and loss (twin of spanpref.operators.tokens / loss)
# ---------------------------------------------------------------------------
def _chars(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, '') END)"


def _full_text(prompt: str, answer: str, p) -> str:
    import re as _re

    parts = _re.split(r"(\{system\}|\{prompt\}|\{answer\})", p.template)
    cols = {"{system}": q(p.system_prompt), "{prompt}": prompt, "{answer}": answer}
    return "(" + " || ".join(cols.get(x, q(x).replace("\n", "' || chr(10) || '")) for x in parts if x != "") + ")"


def _values(answer: str, pattern: str) -> str:
    return f"regexp_extract_all({answer}, {q(pattern)}, 1)"


def token_ctes(p, offsets: bool = True) -> str:
    """``tk(model, pair_id, batch, c_ids, c_lab, c_w, c_start, r_ids, r_lab, r_w, r_start)`` after ``pairs``."""
    from spanpref.functions.jsonish import CODE_VALUE, SPAN_VALUE, SUBCODE_VALUE

    prompt = f"(CASE WHEN length(prompt) <= {p.max_prompt_length} THEN prompt ELSE right(prompt, {p.max_prompt_length}) END)"

    def tok(ft: str) -> str:
        return (
            f"list_slice(list_concat([{{'id': {p.bos_id}, 's': 0, 'e': 0}}], "
            f"list_transform({_chars(ft)}, lambda c, i: {{'id': unicode(c)::INT, 's': (i - 1)::INT, 'e': i::INT}})), 1, {p.max_length})"
        )

    def start(ft: str, ans: str) -> str:
        return (
            f"(CASE WHEN instr(reverse({ft}), reverse({ans})) = 0 THEN -1 "
            f"ELSE length({ft}) - instr(reverse({ft}), reverse({ans})) + 1 - length({ans}) END)"
        )

    if not offsets:

        def start(ft: str, ans: str) -> str:  # noqa: F811
            return (
                f"(CASE WHEN length({ans}) > 0 AND instr({ft}, {ans}) > 0 AND instr({ft}, {ans}) - 1 + length({ans}) < {p.max_length} "
                f"THEN instr({ft}, {ans}) - 1 ELSE -1 END)"
            )

    def first_targets(pre: str) -> str:
        parts = []
        rest = f"substring({pre}_ft, {pre}_start + 1)"
        for pat, w in ((CODE_VALUE, p.weight_code_value), (SUBCODE_VALUE, p.weight_subcode_value), (SPAN_VALUE, p.weight_span_value)):
            parts.append(
                f"list_transform(list_filter({_values(pre + '_ans', pat)}, lambda v: length(v) > 0 AND instr({rest}, v) > 0 "
                f"AND {pre}_start + instr({rest}, v) - 1 + length(v) < {p.max_length}), "
                f"lambda v: {{'s': {pre}_start + instr({rest}, v) - 1, 'e': {pre}_start + instr({rest}, v) - 1 + length(v), 'w': {w}::DOUBLE}})"
            )
        return f"(CASE WHEN {pre}_start >= 0 THEN list_concat({parts[0]}, {parts[1]}, {parts[2]}) ELSE [] END)"

    def targets(pre: str) -> str:
        if not offsets:
            return first_targets(pre)
        parts = []
        for pat, w in ((CODE_VALUE, p.weight_code_value), (SUBCODE_VALUE, p.weight_subcode_value), (SPAN_VALUE, p.weight_span_value)):
            parts.append(
                f"flatten(list_transform({_values(pre + '_ans', pat)}, lambda v: "
                f"list_transform(list_filter(range(0, greatest(length({pre}_ans) - length(v) + 1, 0)), "
                f"lambda i: length(v) > 0 AND substring({pre}_ans, i + 1, length(v)) = v), "
                f"lambda i: {{'s': {pre}_start + i, 'e': {pre}_start + i + length(v), 'w': {w}::DOUBLE}})))"
            )
        return f"(CASE WHEN {pre}_start >= 0 THEN list_concat({parts[0]}, {parts[1]}, {parts[2]}) ELSE [] END)"

    head = f"""tk0 AS (SELECT model, pair_id, {prompt} AS pr, chosen AS c_ans, rejected AS r_ans FROM pairs WHERE chosen <> rejected),
tk1 AS (SELECT *, {_full_text('pr', 'c_ans', p)} AS c_ft, {_full_text('pr', 'r_ans', p)} AS r_ft FROM tk0),
tk2 AS (SELECT *, {tok('c_ft')} AS c_tok, {tok('r_ft')} AS r_tok, {start('c_ft', 'c_ans')} AS c_start, {start('r_ft', 'r_ans')} AS r_start FROM tk1)"""
    return head + ",\n" + _token_tail(p, targets)


def _token_tail(p, targets) -> str:
    """From texts, tokens and starts (``tk2``) to ``tk``: labels, weights of values, differences, batches."""

    def weights(pre: str) -> str:
        return (
            f"list_transform({pre}_tok, lambda t, i: CASE WHEN {pre}_lab[i] = -100 THEN 0.0 "
            f"WHEN t.s = 0 AND t.e = 0 THEN 1.0 ELSE list_reduce({pre}_tg, lambda acc, x: "
            f"CASE WHEN t.s < x.e AND t.e > x.s THEN greatest(acc, x.w) ELSE acc END, 1.0::DOUBLE) END)"
        )

    def sup(lab: str) -> str:
        return f"list_filter(list_transform({lab}, lambda x, i: CASE WHEN x <> -100 THEN i - 1 END), lambda i: i IS NOT NULL)"

    def diff(a: str, b: str) -> str:
        wd = p.weight_diff_tokens
        return (
            f"list_transform({a}_w0, lambda w, i: CASE WHEN {a}0 IS NOT NULL AND {b}0 IS NOT NULL AND i - 1 >= {a}0 "
            f"AND i - 1 < {a}0 + dl AND {a}_lab[i] <> -100 AND {b}_lab[i - 1 - {a}0 + {b}0 + 1] <> -100 "
            f"AND {a}_ids[i] <> {b}_ids[i - 1 - {a}0 + {b}0 + 1] THEN w * {wd} ELSE w END)"
        )

    return f"""tk3 AS (SELECT *, list_transform(c_tok, lambda t: CASE WHEN c_start < 0 OR t.s < c_start THEN -100 ELSE t.id END) AS c_lab,
              list_transform(r_tok, lambda t: CASE WHEN r_start < 0 OR t.s < r_start THEN -100 ELSE t.id END) AS r_lab,
              list_transform(c_tok, lambda t: t.id) AS c_ids, list_transform(r_tok, lambda t: t.id) AS r_ids FROM tk2),
tk4 AS (SELECT *, {targets('c')} AS c_tg, {targets('r')} AS r_tg FROM tk3),
tk5 AS (SELECT *, {weights('c')} AS c_w0, {weights('r')} AS r_w0,
              {sup('c_lab')}[1] AS c0, {sup('r_lab')}[1] AS r0, least(len({sup('c_lab')}), len({sup('r_lab')})) AS dl FROM tk4),
tk AS (SELECT model, pair_id, (row_number() OVER (PARTITION BY model ORDER BY pair_id) - 1) // {p.batch_size} AS batch, c_ids, c_lab, {diff('c', 'r')} AS c_w, c_start,
              r_ids, r_lab, {diff('r', 'c')} AS r_w, r_start FROM tk5)"""


def word_token_ctes(p) -> str:
    """The same CTEs for word tokens searched without offsets (K5, K8); ``s``/``e`` are places among the tokens, the answer's start counts no BOS."""
    from spanpref.functions.jsonish import CODE_VALUE, SPAN_VALUE, SUBCODE_VALUE

    word = q(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")
    every = f"regexp_extract_all(prompt, {q('[A-Za-z0-9]+|[^A-Za-z0-9]')})"
    space = q(r"[\x20\x09-\x0D]")

    def ids(t: str) -> str:
        return f"list_transform(regexp_extract_all({t}, {word}), lambda w: ('0x' || substr(md5(w), 1, 7))::INT)"

    def first(hay: str, needle: str, start: str) -> str:
        """1-based place of the first run of ``needle`` from ``start`` on; NULL if there is none."""
        return (
            f"list_filter(range({start}, len({hay}) - len({needle}) + 2), lambda i: len({needle}) > 0 "
            f"AND {hay}[i] = {needle}[1] AND list_slice({hay}, i, i + len({needle}) - 1) = {needle})[1]"
        )

    prompt = (
        f"(CASE WHEN len(regexp_extract_all(prompt, {word})) <= {p.max_prompt_length} THEN prompt ELSE array_to_string(list_slice({every}, "
        f"list_filter(list_transform({every}, lambda w, i: CASE WHEN NOT regexp_full_match(w, {space}) THEN i END), lambda i: i IS NOT NULL)"
        f"[-{p.max_prompt_length}], len({every})), '') END)"
    )

    def targets(pre: str) -> str:
        parts = []
        for pat, w in ((CODE_VALUE, p.weight_code_value), (SUBCODE_VALUE, p.weight_subcode_value), (SPAN_VALUE, p.weight_span_value)):
            parts.append(
                f"list_transform(list_filter(list_transform({_values(pre + '_ans', pat)}, lambda v: list_transform([{ids('v')}], "
                f"lambda n: {{'at': {first(pre + '_all', 'n', pre + '_start + 1')}, 'n': len(n)}})[1]), lambda t: t.at IS NOT NULL), "
                f"lambda t: {{'s': t.at - 1, 'e': t.at - 1 + t.n, 'w': {w}::DOUBLE}})"
            )
        return f"(CASE WHEN {pre}_start >= 0 THEN list_concat({parts[0]}, {parts[1]}, {parts[2]}) ELSE [] END)"

    def tok(pre: str) -> str:
        return f"list_transform({pre}_all, lambda x, i: {{'id': x, 's': (i - 1)::INT, 'e': CASE WHEN i = 1 THEN 0 ELSE i END::INT}})"

    def whole(ft: str) -> str:
        return f"list_slice(list_concat([{p.bos_id}], {ids(ft)}), 1, {p.max_length})"

    return f"""tk0 AS (SELECT model, pair_id, {prompt} AS pr, chosen AS c_ans, rejected AS r_ans FROM pairs WHERE chosen <> rejected),
tk1 AS (SELECT *, {_full_text('pr', 'c_ans', p)} AS c_ft, {_full_text('pr', 'r_ans', p)} AS r_ft FROM tk0),
tk1a AS (SELECT *, {whole('c_ft')} AS c_all, {whole('r_ft')} AS r_all, {ids('c_ans')} AS c_need, {ids('r_ans')} AS r_need FROM tk1),
tk2 AS (SELECT *, {tok('c')} AS c_tok, {tok('r')} AS r_tok, coalesce({first('c_all', 'c_need', '1')} - 1, -1) AS c_start,
               coalesce({first('r_all', 'r_need', '1')} - 1, -1) AS r_start FROM tk1a),
{_token_tail(p, targets)}"""


def token_logp_ctes(seed: int) -> str:
    def ud(purpose, side):
        return u(seed, q(purpose), "model", "pair_id", q(side), "pos")

    parts = []
    for side, pre in (("chosen", "c"), ("rejected", "r")):
        parts.append(
            f"""SELECT model, pair_id, '{side}' AS side, pos, label, weight,
       ln(greatest({ud('policy', side)}, 1e-6)) AS policy_logp, ln(greatest({ud('reference', side)}, 1e-6)) AS ref_logp
FROM (SELECT model, pair_id, unnest({pre}_lab) AS label, unnest({pre}_w) AS weight, unnest(range(len({pre}_lab))) AS pos FROM tk)
WHERE pos >= 1 AND label <> -100"""
        )
    parts.append("SELECT model, pair_id, 'pair' AS side, 0, -100, 0.0, 0.0, 0.0 FROM tk")
    return "tl AS (" + "\nUNION ALL\n".join(parts) + ")"


def sequence_cte(log_tau: float) -> str:
    tau = repr(log_tau)
    return f"""sq0 AS (SELECT model, pair_id,
   sum(CASE WHEN side = 'chosen' THEN policy_logp * weight END) AS c_pol, sum(CASE WHEN side = 'chosen' THEN ref_logp * weight END) AS c_ref,
   sum(CASE WHEN side = 'chosen' THEN weight END) AS c_w, count(*) FILTER (WHERE side = 'chosen') AS c_n,
   sum(CASE WHEN side = 'rejected' THEN policy_logp * weight END) AS r_pol, sum(CASE WHEN side = 'rejected' THEN ref_logp * weight END) AS r_ref,
   sum(CASE WHEN side = 'rejected' THEN weight END) AS r_w, count(*) FILTER (WHERE side = 'rejected') AS r_n,
   sum(CASE WHEN side = 'chosen' AND policy_logp < {tau} THEN -policy_logp * weight END) AS b_num,
   sum(CASE WHEN side = 'chosen' AND policy_logp < {tau} THEN weight END) AS b_den,
   count(*) FILTER (WHERE side = 'chosen' AND policy_logp < {tau}) AS n_gate
 FROM tl GROUP BY model, pair_id),
sq AS (SELECT model, pair_id,
   coalesce(c_pol, 0.0) / greatest(coalesce(c_w, 0.0), 1e-6) AS pi_c, coalesce(r_pol, 0.0) / greatest(coalesce(r_w, 0.0), 1e-6) AS pi_r,
   coalesce(c_ref, 0.0) / greatest(coalesce(c_w, 0.0), 1e-6) AS ref_c, coalesce(r_ref, 0.0) / greatest(coalesce(r_w, 0.0), 1e-6) AS ref_r,
   c_n::BIGINT AS chosen_tokens, r_n::BIGINT AS rejected_tokens, n_gate::BIGINT AS gate_tokens,
   (greatest(c_n::DOUBLE, 1.0) / greatest(coalesce(c_w, 0.0), 1e-6)) * coalesce(b_num, 0.0)
     / greatest((greatest(c_n::DOUBLE, 1.0) / greatest(coalesce(c_w, 0.0), 1e-6)) * coalesce(b_den, 0.0), 1.0) AS barrier
 FROM sq0)"""
