"""Label normalisation and canonicalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanpref.functions import vocab

# Python's ``str.split``/``\s`` whitespace is Unicode and includes \x1c-\x1f;
# Java's ``\s`` is ASCII unless (?U) is given.
WS_RUN = r"(?U)[\s\x1c-\x1f]+"


def norm_label(c: Column) -> Column:
    """Strip, collapse whitespace runs to one space, lowercase."""
    return F.lower(F.trim(F.regexp_replace(c, WS_RUN, " ")))


def canonicalize(c: Column, canon_map: Column) -> Column:
    """Canonical label or NULL when the normalised label is unknown."""
    return F.try_element_at(canon_map, norm_label(c))


def canonical_set(labels: Column, kind: str) -> Column:
    """Distinct canonical labels of an ``ARRAY<STRING>`` (unknown/NULL dropped)."""
    canon = vocab.code_canon_map() if kind == "code" else vocab.sub_canon_map()
    return F.array_distinct(F.filter(F.transform(labels, lambda x: canonicalize(x, canon)), lambda x: x.isNotNull()))


def exact_set(labels: Column, kind: str) -> Column:
    """Label set as the metric binariser sees it: exact case, vocabulary only, distinct."""
    voc = vocab.code_vocab_array() if kind == "code" else vocab.sub_vocab_array()
    return F.array_intersect(F.filter(labels, lambda x: x.isNotNull()), voc)
