"""Queries of this subpackage: ``QUERIES`` (spark, sf_dir) -> DataFrame, and ``ORACLE_SQL`` where SQL can express one."""

from __future__ import annotations

from spanpref.llm import bond, bpe, brown, conversations, covertree, decontaminate, pii, quality, secrets, simhash, suffix_trees, token_files, toxicity
from spanpref.llm.common import table


def op1_cover_tree(spark, sf_dir):
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_brown_lm(spark, sf_dir):
    return brown.score(table(spark, sf_dir, "documents"))


def op3_token_files(spark, sf_dir):
    return token_files.digests(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ordinal_quality(spark, sf_dir):
    return quality.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark, sf_dir):
    return pii.result(table(spark, sf_dir, "documents"))


def op8_secrets(spark, sf_dir):
    return secrets.result(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_golay(spark, sf_dir):
    return simhash.result(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.result(table(spark, sf_dir, "conversations"))


def op12_suffix_trees(spark, sf_dir):
    return suffix_trees.result(table(spark, sf_dir, "documents"))


def op13_bond_negatives(spark, sf_dir):
    return bond.result(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_cover_tree": op1_cover_tree,
    "op2_brown_lm": op2_brown_lm,
    "op3_token_files": op3_token_files,
    "op4_decontamination": op4_decontamination,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secrets": op8_secrets,
    "op9_toxicity": op9_toxicity,
    "op10_simhash_golay": op10_simhash_golay,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_suffix_trees": op12_suffix_trees,
    "op13_bond_negatives": op13_bond_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_cover_tree": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
w AS (SELECT vec_id, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
      WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS n, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n)
SELECT v.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.n = v.vec_id LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = v.vec_id""",
    # an insert is in no cheapest path (see the module), so every row takes one letter and audits of a state compare as text
    "op11_conversation_repair": r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
               lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)) % 20 AS kind
  FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM a, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (SELECT *, left(role, 1) AS initial,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM b),
o2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS wrong,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o2),
c AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) AS n,
             count_if(wrong = 'blank') AS blank, count_if(wrong = 'duplicate') AS duplicate, count_if(wrong = 'truncated') AS truncated,
             count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 'e' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS kept FROM a
  UNION ALL
  SELECT conv_id, i, state, cost, audit, kept FROM (
    SELECT d.conv_id, f.i, e.goal AS state, d.cost + e.cost AS cost, d.audit || e.letter AS audit,
           CASE WHEN e.letter = 'D' THEN d.kept ELSE list_append(d.kept, e.role || ':' || f.text) END AS kept
    FROM dp d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1,
         LATERAL (SELECT unnest([
           {'letter': 'D', 'cost': 2, 'role': '', 'goal': d.state},
           {'letter': 'K', 'cost': CASE WHEN f.wrong = 'truncated' THEN 5 ELSE 0 END, 'role': f.role,
            'goal': CASE WHEN f.wrong IN ('blank', 'duplicate') THEN NULL WHEN d.state = 'e' AND f.initial = 's' THEN 's'
                         WHEN d.state <> 'u' AND f.initial = 'u' THEN 'u' WHEN d.state = 'u' AND f.initial = 'a' THEN 'a' END},
           {'letter': 'R', 'cost': CASE WHEN f.wrong = 'truncated' THEN 6 ELSE 1 END, 'role': CASE WHEN d.state = 'u' THEN 'assistant' ELSE 'user' END,
            'goal': CASE WHEN f.wrong IN ('blank', 'duplicate') THEN NULL WHEN d.state = 'u' THEN 'a' ELSE 'u' END}]) AS e)
    WHERE e.goal IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
t AS (SELECT dp.* FROM dp LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(c.n, 0) AND state IN ('e', 'a')
      QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost, audit) = 1)
SELECT t.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, t.cost::BIGINT AS cost, audit,
       sha256(array_to_string(kept, chr(10))) AS repaired_sha256
FROM t LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id""",
    "op12_suffix_trees": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT r, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id) AS low FROM k GROUP BY k),
h AS (SELECT DISTINCT r, i FROM k JOIN f USING (k) WHERE doc_id > low),
x AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT x.r, x.i, word, max((h.i IS NOT NULL)::INT) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM x LEFT JOIN h ON h.r = x.r AND h.i = x.i),
t AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t USING (r)""",
    "op13_bond_negatives": """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, m.label AS label, m.q AS q FROM (SELECT vec_id, min({'label': label, 'q': q}) AS m FROM u GROUP BY vec_id)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CASE WHEN len(a.q) = 0 THEN 0 ELSE list_dot_product(a.q, b.q)::BIGINT END AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q) AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
}
