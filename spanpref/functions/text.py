"""Text helpers: prompt context, word sets, span similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanpref.functions.labels import WS_RUN

#: Python's white space, by name: controls 9-13 and 28-32, next line, and the Unicode separators.
WS_CLASS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
STRIP = rf"^{WS_CLASS}+|{WS_CLASS}+\z"

MARKERS = {"previous": "Previous sentence:", "current": "Current sentence:", "next": "Next sentence:"}


def _marker_lines(prompt: Column, marker: str) -> Column:
    return F.filter(F.split(prompt, "\n"), lambda line: F.startswith(line, F.lit(marker)))


def strip(s: Column) -> Column:
    """Python ``str.strip()``: white space of every kind off both ends."""
    return F.regexp_replace(s, STRIP, "")


def context_struct(prompt: Column) -> Column:
    """``STRUCT<TO_PAT_YN, previous, current, next>`` (NULL when absent).

    ``TO_PAT_YN: Y`` anywhere wins over ``: N``; for the sentence lines the
    *last* line starting with the marker wins; every occurrence of the marker
    in that line is removed and the rest stripped of all white space.
    """
    yn = F.when(F.contains(prompt, F.lit("TO_PAT_YN: Y")), F.lit("Y")).when(
        F.contains(prompt, F.lit("TO_PAT_YN: N")), F.lit("N")
    )
    fields = [yn.alias("TO_PAT_YN")]
    for name, marker in MARKERS.items():
        last = F.try_element_at(_marker_lines(prompt, marker), F.lit(-1))
        fields.append(strip(F.replace(last, F.lit(marker), F.lit(""))).alias(name))
    return F.struct(*fields)


def first_current_sentence(prompt: Column, width: int = 100) -> Column:
    """*first* ``Current sentence:`` line, default ``N/A``, cut to ``width`` chars."""
    marker = MARKERS["current"]
    first = F.get(_marker_lines(prompt, marker), 0)
    return F.left(F.coalesce(strip(F.replace(first, F.lit(marker), F.lit(""))), F.lit("N/A")), F.lit(width))


def words(s: Column) -> Column:
    """Python ``str.split()``: non-empty pieces between Unicode whitespace runs."""
    return F.filter(F.split(s, WS_RUN), lambda w: w != F.lit(""))


def word_set(s: Column) -> Column:
    """``set(s.lower().split())`` as a distinct array."""
    return F.array_distinct(words(F.lower(s)))


def contained(a: Column, b: Column) -> Column:
    """Word set ``a`` is a subset of word set ``b`` (empty set is in anything)."""
    return F.size(F.array_except(a, b)) == 0


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b|, 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def spans_match(true_ws: Column, pred_ws: Column, threshold: float) -> Column:
    """J6 predicate: containment either way, else Jaccard >= threshold."""
    return contained(true_ws, pred_ws) | contained(pred_ws, true_ws) | (jaccard(pred_ws, true_ws) >= F.lit(threshold))


def corrupt_span(span: Column) -> Column:
    """>2 words -> first floor(n/2) words; else append `` extra``."""
    w = F.split(span, WS_RUN)
    w = F.filter(w, lambda x: x != F.lit(""))
    n = F.size(w)
    return F.when(n > 2, F.array_join(F.slice(w, F.lit(1), F.floor(n / 2).cast("int")), " ")).otherwise(
        F.concat(span, F.lit(" extra"))
    )


def pct(count: Column, total: Column) -> Column:
    """100*count/total, 0 when total is 0."""
    return F.coalesce(F.try_divide(count * F.lit(100.0), total), F.lit(0.0))
