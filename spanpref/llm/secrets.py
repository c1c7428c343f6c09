"""Operator 8: secrets, by patterns and sliding-window entropy. SQL functions only.

Besides the pattern spans, strings of ``MIN_LENGTH`` and more characters of the
usual key alphabets are candidates. The Shannon entropy of every window of
``WINDOW`` characters is computed by incremental counts: a step takes one
character in and one out, changing two counts and the sum of ``c log2 c``. The
highest window must reach the threshold of the string's character class (hex,
letters and digits, base64). An allow-list takes out of a candidate what is no
secret (unique ids, runs and alphabets, words that begin like a placeholder), as
the pattern spans are; each piece that is left is scored, and where it stays
under its threshold, its parts between separators are. Paths and words without
digits are no secrets as whole pieces.

Narrow: no shuffle. Defined results: null text counts as empty; empty texts
have no spans; repeated rows are found each; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanpref.llm.spans import KIND_SPAN, blanked, by_patterns, count_of, listed, located, of_kind

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"[0-9a-f]{32,}+",
}
_ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
KEEP = {
    "assign": lambda v: F.length(F.regexp_replace(v, _ASSIGN_HEAD, "")) >= 8,
    "access": lambda v: F.length(v) >= 16,
    "hex": lambda v: F.length(v) >= 32,
}
MIN_LENGTH, WINDOW = 20, 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits per character that the highest window must reach.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: Taken out of a candidate, with the separator behind.
TAKEN = (
    r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])"  # unique ids
    r"|(?<![A-Za-z0-9])(?i:example|placeholder|changeme|dummy|sample)[A-Za-z0-9]*+[/=_-]?"
    r"|(?<![A-Za-z0-9])(?i:your|test)[_-]"
    r"|(?i:x{4,}+|0123456789|abcdefgh)"
    r"|(.)\1{5,}+"  # runs
)
#: No secret if all of a piece is this.
ALLOWED = (
    r"^[A-Za-z_-]+$|^[0-9_=+/-]+$"  # words or numbers alone
    r"|^/?([A-Za-z]+[/_-])+[A-Za-z0-9]{1,8}$"  # paths and names
)
PART = rf"[A-Za-z0-9+]{{{MIN_LENGTH},}}+"


def window_entropy(value: Column) -> Column:
    """Highest Shannon entropy (bits a character) of any ``WINDOW`` characters of ``value``."""
    f = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(WINDOW + 2)])
    codes = F.transform(F.split(value, "(?!^)(?!$)"), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).cast("double").alias("s"), F.lit(0.0).cast("double").alias("best"))

    def step(acc, i):
        into = F.get(codes, i)
        out = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
        moved = into != out
        n_in, n_out = F.get(acc["n"], into), F.when(out >= 0, F.get(acc["n"], out)).otherwise(0)
        s = acc["s"] + F.when(moved, F.get(f, n_in + 1) - F.get(f, n_in) + F.when(out >= 0, F.get(f, n_out - 1) - F.get(f, n_out)).otherwise(0.0)).otherwise(0.0)
        n = F.when(moved, F.transform(acc["n"], lambda c, k: c + F.when(k == into, 1).when(k == out, -1).otherwise(0))).otherwise(acc["n"])
        best = F.when(i >= WINDOW - 1, F.greatest(acc["best"], math.log2(WINDOW) - s / WINDOW)).otherwise(acc["best"])
        return F.struct(n.alias("n"), s.alias("s"), best.alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step, lambda acc: acc["best"])


def suspicious(value: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and it is no path, word or number."""
    limit = F.when(value.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(value.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    return F.when(value.rlike(ALLOWED), False).otherwise(window_entropy(value) >= limit)


def shifted(found: Column, by: Column) -> Column:
    return F.transform(found, lambda p: F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end"), p["value"].alias("value")))


def high_parts(value: Column) -> Column:
    """Places of what is suspicious in a candidate: its pieces without ``TAKEN``, else their parts between separators."""
    pieces = located(F.when(value.rlike(TAKEN), blanked(value, located(value, TAKEN))).otherwise(value), CANDIDATE)

    def one(p):
        parts = F.filter(located(p["value"], PART), lambda x: suspicious(x["value"]))
        return F.when(suspicious(p["value"]), F.array(p)).otherwise(shifted(parts, p["start"]))

    return F.flatten(F.transform(pieces, one))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans, base)`` per row: all spans and the pattern spans, sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), by_patterns(text, PATTERNS, KEEP).alias("base"))
    rows = rows.select("doc_id", "base", located(blanked(F.col("text"), F.col("base")), CANDIDATE).alias("strings"))
    high = F.flatten(F.transform("strings", lambda s: shifted(high_parts(s["value"]), s["start"])))
    extra = of_kind(high, "entropy", len(KINDS))
    return rows.select("doc_id", F.array_sort(F.concat("base", extra).cast(KIND_SPAN)).alias("spans"), "base")


def result(docs: DataFrame) -> DataFrame:
    base = F.col("base")
    return find(docs).select(
        "doc_id", *[count_of(base, k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
