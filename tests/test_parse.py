"""Parsing / repair unit cases (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from spanpref.functions import jsonish, labels, text

OK = '{"results":[{"Code":"SDOH","Sub-code":"EconomicStability","Span":"a b"}]}'
SQ = OK.replace('"', "'")
CASES = [
    (OK, "strict", 1),
    (OK + " done", "repaired", 1),
    (OK + "]", "repaired", 1),
    (OK + "}", "repaired", 1),
    (OK + OK, "repaired", 2),
    ("```json\n" + OK + "\n```", "repaired", 1),
    (SQ, "repaired", 1),
    (OK.replace('"', "&quot;"), "repaired", 1),
    (OK[:-3], "empty", 0),
    ("{'results':[{'Code':'SDOH','Sub-code':'x','Span':'don't'}]}", "empty", 0),
    ('{"results":[{"Code":"SDOH","Sub-code":"x","Span":"a\nb"}]} x', "empty", 0),
    ('{"results":[{"Span":"a","Code":"SDOH","Sub-code":"x"}]} x', "empty", 0),
    ("[1]", "strict", 0),
    ("5", "strict", 0),
    ("null", "strict", 0),
    ('{"a":1}', "strict", 0),
    ('{"results":"x"}', "strict", 0),
    ('{"results":[1,{"Code":"SDOH"}]}', "strict", 1),
    ('{"results":[],"x":NaN}', "strict", 0),
    ("", "empty", 0),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    out = jsonish.with_parsed(df, "t", "p").select("i", "p_mode", F.size("p_results").alias("n"), "p_results", "p_bad_shape")
    return {r.i: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse_modes(parsed, i):
    _, mode, n = CASES[i]
    assert parsed[i].p_mode == mode
    assert parsed[i].n == n


def test_bad_shape_flag(parsed):
    bad = {i for i, r in parsed.items() if r.p_bad_shape}
    assert bad == {12, 13, 14, 15, 16}


def test_code_only_item(parsed):
    a = parsed[17].p_results[0]
    assert (a.code, a.sub_code, a.span) == ("SDOH", None, None)


def test_label_canonicalisation(spark):
    df = spark.createDataFrame([(" clinical   CARE ",), ("None",), ("InfoGive",), ("5",), ("SDOH",)], "x string")
    from spanpref.functions import vocab

    got = [r[0] for r in df.select(labels.canonicalize(F.col("x"), vocab.sub_canon_map())).collect()]
    assert got == ["Clinical Care", None, None, None, None]
    got = [r[0] for r in df.select(labels.canonicalize(F.col("x"), vocab.code_canon_map())).collect()]
    assert got[-1] == "SDOH"


def test_valid_format_and_fix(spark):
    good = "{\"results\": [{\"Code\": 'A', \"Sub-code\": 'b', \"Span\": 'c'}]}"
    df = spark.createDataFrame([(good,), (OK,), ('{"results": []}',)], "t string")
    rows = df.select(jsonish.is_valid_format(F.col("t")), jsonish.fix_structure(F.col("t"))).collect()
    assert [r[0] for r in rows] == [True, False, True]
    assert rows[1][1] == '{"results": [' + OK[12:-2] + "]}"


def test_jsonish_values_first_seen_unique(spark):
    t = '{"Code":"A","Sub-code":"x","Span":"s"},{"Code":"B","Subcode":"y","Span":"s"},{"Code":"A"}'
    r = spark.range(1).select(jsonish.jsonish_values(F.lit(t)).alias("v")).first().v
    assert (r.code, r.subcode, r.span) == (["A", "B"], ["x", "y"], ["s"])


def test_context_fields(spark):
    p = "TO_PAT_YN: N\nTO_PAT_YN: Y\nCurrent sentence: first\nCurrent sentence:  second Current sentence: x\nPrevious sentence: p"
    r = spark.range(1).select(text.context_struct(F.lit(p)).alias("c"), text.first_current_sentence(F.lit(p)).alias("f")).first()
    assert r.c.TO_PAT_YN == "Y"
    assert r.c.current == "second  x"
    assert r.c.previous == "p" and r.c.next is None
    assert r.f == "first"


def test_word_set_unicode_whitespace(spark):
    r = spark.range(1).select(text.word_set(F.lit("A b  a\x1cC")).alias("w")).first().w
    assert sorted(r) == ["a", "b", "c"]


def test_crafted_tails_are_not_strict(spark):
    from spanpref.functions.jsonish import strict_json_valid

    texts = ['{"results":[]}', "5", "5,0] x", "5,1] x", '{"results":[]},0] tail', '{"results":[]},1] tail', "", None, "[1,2]", '"a"']
    got = [r.ok for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strict_json_valid(F.col("t")).alias("ok")).collect()]
    assert got == [True, True, False, False, False, False, False, False, True, True]


def test_context_is_stripped_of_all_white_space(spark):
    from spanpref.functions.text import context_struct

    prompt = "TO_PAT_YN: N\nCurrent sentence: \t a\u00a0b \u00a0\r\nNext sentence:\x1c\u2003x\u3000\x85"
    row = spark.createDataFrame([(prompt,)], "q string").select(context_struct(F.col("q")).alias("c")).first().c
    assert (row.TO_PAT_YN, row.previous, row.current, row.next) == ("N", None, "a\u00a0b", "x")
