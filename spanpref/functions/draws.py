"""Keyed, partition-independent random draws.

A draw is the first 13 hex digits (52 bits) of ``md5`` over a ``|``-joined key,
so the same key yields the same number on any partitioning, after any retry
or executor loss, and in any engine that has ``md5``.  ``u`` is uniform on
[0, 1) and exact in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2**52)


def _key(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def draw_bits(*parts) -> Column:
    """52-bit non-negative BIGINT from the key ``parts``."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, 13), 16, 10).cast("bigint")


def draw(*parts) -> Column:
    """Uniform double in [0, 1) from the key ``parts``."""
    return draw_bits(*parts) / F.lit(TWO_POW_52)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(bound)``.

    ``get(transform(array(value), body), 0)``: the optimizer never inlines a
    lambda variable, so a value used many times in ``body`` is computed once
    and the plan stays linear even when filters are pushed through it.
    """
    return F.get(F.transform(F.array(value), body), 0)
