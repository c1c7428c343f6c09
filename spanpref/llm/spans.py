"""Spans of text found with SQL functions alone: places of regex matches, ordering, digests, replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
KIND_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def located(text: Column, pattern: str, keep=None) -> Column:
    """All matches in order (those that ``keep(value)`` holds for) as ``struct(start, end, value)``, code points, end exclusive.

    The texts between the matches (``split``) and the matches alternate, so the
    places are sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        out = F.concat(acc["out"], F.array(one)).cast(SPAN)
        return F.struct(end.alias("at"), (out if keep is None else F.when(keep(x["value"]), out).otherwise(acc["out"])).alias("out"))

    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    both = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap")))
    placed = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), placed).otherwise(none)


def of_kind(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"))).cast(KIND_SPAN)


def by_patterns(text: Column, patterns: dict[str, str], keep: dict) -> Column:
    """Sorted spans of all kinds; ``keep[kind](value)`` drops failing matches."""

    def one(rank: int, kind: str) -> Column:
        return of_kind(F.filter(located(text, patterns[kind]), lambda s: keep[kind](s["value"])), kind, rank)

    return F.array_sort(F.concat(*[one(i, k) for i, k in enumerate(patterns)]).cast(KIND_SPAN))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with every character of the spans (sorted, may overlap) as a space, so that places stay."""

    def add(acc, s):
        begin, end = F.greatest(s["start"], acc["at"]), F.greatest(s["end"], acc["at"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), end - begin))
        return F.struct(end.alias("at"), out.alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def replaced(text: Column, spans: Column, tag) -> Column:
    """``text`` with every span (sorted; overlapping ones as one) replaced by ``tag(span)``."""
    none = F.array().cast("array<struct<start:int,end:int,tag:string>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["tag"].alias("tag"))))
        apart = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), tag(s).alias("tag"))))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), joined).otherwise(apart).cast("array<struct<start:int,end:int,tag:string>>")

    merged = F.aggregate(spans, none, add)

    def piece(s, i):
        begin = F.when(i == 0, 0).otherwise(F.get(merged, i - 1)["end"])
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), s["tag"])

    tail = F.substring(text, F.element_at(merged, -1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(merged, piece), ""), tail))
