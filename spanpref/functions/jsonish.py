"""Parsing and repair of model answers.

Answers look like ``{"results": [{"Code": .., "Sub-code": .., "Span": ..}]}``.
Text that is strict JSON is read as is; anything else goes through the
repair path: HTML-unescape, ``'`` -> ``"``, ``\\`` -> ``\\\\``, then every flat
``{"Code":"..","Sub-code":"..","Span":".."}`` object is pulled out by regex and
parsed on its own.  All of it is JVM-side except ``html.unescape``, which runs in
an Arrow-batched pandas UDF fed only the rows that need it.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ITEM_SCHEMA = "struct<Code:string,`Sub-code`:string,Span:string>"
ANNOTATION_TYPE = "array<struct<code:string,sub_code:string,span:string>>"

_WS = r"[\s\x1c-\x1f]*"
# flat object with fixed key order; empty values allowed (repair path)
REPAIR_OBJECT = (
    r"(?U)\{" + _WS + r'"Code"' + _WS + ":" + _WS + r'"[^"]*"' + _WS + "," + _WS + r'"Sub-code"' + _WS + ":"
    + _WS + r'"[^"]*"' + _WS + "," + _WS + r'"Span"' + _WS + ":" + _WS + r'"[^"]*"' + _WS + r"\}"
)
# same shape, non-empty values (structure fixer, P9)
FIX_OBJECT = (
    r"(?U)\{" + _WS + r'"Code"' + _WS + ":" + _WS + r'"[^"]+"' + _WS + "," + _WS + r'"Sub-code"' + _WS + ":"
    + _WS + r'"[^"]+"' + _WS + "," + _WS + r'"Span"' + _WS + ":" + _WS + r'"[^"]+"' + _WS + r"\}"
)
# Anchored; keys double-quoted, values single-quoted and non-empty
VALID_FORMAT = (
    r"(?sU)^\{" + r"\s*" + r'"results"\s*:\s*\[' + r"(\s*\{"
    + r"""\s*"Code"\s*:\s*'[^']+'\s*,"""
    + r"""\s*"Sub-code"\s*:\s*'[^']+'\s*,"""
    + r"""\s*"Span"\s*:\s*'[^']+'\s*"""
    + r"\}\s*,?)*" + r"\s*\]" + r"\s*\}$"
)
# P10 value extractors
CODE_VALUE = r'"Code"\s*:\s*"([^"]+)"'
SUBCODE_VALUE = r'"(?:Sub-code|Subcode)"\s*:\s*"([^"]+)"'
SPAN_VALUE = r'"Span"\s*:\s*"([^"]+)"'


@pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """``html.unescape``; callers pass NULL for rows that do not need it."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def strict_json_valid(t: Column) -> Column:
    """P1 validity test: true iff ``t`` is one complete JSON value with nothing after it.

    ``from_json`` alone accepts trailing text, so the value is wrapped as the
    first element of a two-element array; a clean parse returns exactly two
    elements and the second one as it was given.  A text that ends the array itself
    (``5,0] x``) would have to bring that element along, which is the text's own md5.
    """
    mark = F.md5(t)
    probe = F.from_json(F.concat(F.lit("["), t, F.lit(',"'), mark, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(probe) == 2) & (F.get(probe, 1) == mark), F.lit(False))


def _rename(items: Column) -> Column:
    kept = F.filter(items, lambda a: a.isNotNull() & (a["Code"].isNotNull() | a["Sub-code"].isNotNull() | a["Span"].isNotNull()))
    return F.transform(
        kept,
        lambda a: F.struct(a["Code"].alias("code"), a["Sub-code"].alias("sub_code"), a["Span"].alias("span")),
    )


def strict_items(t: Column) -> Column:
    """Items of ``results`` when ``t`` is strict JSON; NULL when ``results`` is not a list (H2).

    ``results`` is read as ``array<string>`` so one non-object item does not
    null the whole list (H3); each item is parsed separately.
    """
    res = F.from_json(t, "struct<results: array<string>>")["results"]
    return _rename(F.transform(res, lambda x: F.from_json(x, ITEM_SCHEMA)))


def repair_text(t: Column, strict: Column) -> Column:
    """P2 pre-processing: HTML-unescape (only rows that need it), quotes, backslashes."""
    needs = (~strict) & F.contains(t, F.lit("&"))
    unesc = F.coalesce(html_unescape(F.when(needs, t)), t)
    return F.replace(F.replace(unesc, F.lit("'"), F.lit('"')), F.lit("\\"), F.lit("\\\\"))


def repaired_items(fixed: Column) -> Column:
    """Every flat object found by regex, parsed alone; bad ones dropped."""
    matches = F.regexp_extract_all(fixed, F.lit(REPAIR_OBJECT), 0)
    return _rename(F.transform(matches, lambda m: F.from_json(m, ITEM_SCHEMA)))


def with_parsed(df, text_col: str, prefix: str, repair: bool = True):
    """Add parsed-answer columns for ``text_col``.

    Adds ``{p}_strict`` (bool), ``{p}_results`` (ARRAY<STRUCT<code,sub_code,span>>),
    ``{p}_mode`` ('strict' | 'repaired' | 'empty') and ``{p}_bad_shape``.
    With ``repair=False`` (gold side of the preference builder, F1) non-strict
    text yields NULL results.
    """
    p = prefix
    t = F.col(text_col)
    df = df.withColumn(f"{p}_strict", strict_json_valid(t))
    df = df.withColumn(f"{p}_strict_items", F.when(F.col(f"{p}_strict"), strict_items(t)))
    if repair:
        df = df.withColumn(
            f"{p}_repaired_items",
            F.when(~F.col(f"{p}_strict"), repaired_items(repair_text(t, F.col(f"{p}_strict")))),
        )
        mode = (
            F.when(F.col(f"{p}_strict"), F.lit("strict"))
            .when(F.size(F.col(f"{p}_repaired_items")) > 0, F.lit("repaired"))
            .otherwise(F.lit("empty"))
        )
        results = F.when(
            F.col(f"{p}_strict"), F.coalesce(F.col(f"{p}_strict_items"), F.array().cast(ANNOTATION_TYPE))
        ).otherwise(F.coalesce(F.col(f"{p}_repaired_items"), F.array().cast(ANNOTATION_TYPE)))
    else:
        mode = F.when(F.col(f"{p}_strict"), F.lit("strict")).otherwise(F.lit("invalid"))
        results = F.col(f"{p}_strict_items")
    df = df.withColumn(f"{p}_mode", mode)
    df = df.withColumn(f"{p}_bad_shape", F.col(f"{p}_strict") & F.col(f"{p}_strict_items").isNull())
    df = df.withColumn(f"{p}_results", results)
    drop = [f"{p}_strict_items"] + ([f"{p}_repaired_items"] if repair else [])
    return df.drop(*drop)


def is_valid_format(t: Column) -> Column:
    """Anchored format check (values single-quoted, keys double-quoted)."""
    return F.coalesce(t.rlike(VALID_FORMAT), F.lit(False))


def fix_structure(t: Column) -> Column:
    """Rebuild ``{"results": [a, b]}`` from the well-formed objects found in ``t``."""
    return F.concat(
        F.lit('{"results": ['), F.array_join(F.regexp_extract_all(t, F.lit(FIX_OBJECT), 0), ", "), F.lit("]}")
    )


def jsonish_values(t: Column) -> Column:
    """``STRUCT<code, subcode, span: ARRAY<STRING>>`` unique in first-seen order."""
    return F.struct(
        F.array_distinct(F.regexp_extract_all(t, F.lit(CODE_VALUE), 1)).alias("code"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(SUBCODE_VALUE), 1)).alias("subcode"),
        F.array_distinct(F.regexp_extract_all(t, F.lit(SPAN_VALUE), 1)).alias("span"),
    )


def annotations_json(results: Column) -> Column:
    """Canonical compact answer text ``{"results":[{"Code":..,"Sub-code":..,"Span":..}]}``."""
    items = F.transform(
        results, lambda a: F.struct(a["code"].alias("Code"), a["sub_code"].alias("Sub-code"), a["span"].alias("Span"))
    )
    return F.to_json(F.struct(items.alias("results")))
