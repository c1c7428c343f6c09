"""Consecutive row numbers per group without a window over the group.

A window ``row_number`` per model puts all of a model's rows into one task.  Here
narrow key rows are dealt by ranges of (group, order), numbered inside their
range, and shifted by the number of the group's rows in earlier ranges:

1. range partitions, sorted inside; each row's place is ``monotonically_increasing_id``
   (partition in the high bits, place in the partition in the low ones);
2. the placed rows are written to the shared folder, so ranges and places are the
   same in both uses below, whatever executors are lost;
3. per (group, partition) the first place and the count - as many rows as there are
   groups and partitions - and their running sum give the shift, joined back by
   (group, partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanpref.lineage import staged

_PLACE_BITS = 33  # of monotonically_increasing_id


def number_rows(keys: DataFrame, group: str, order: str, into: str = "row_number") -> DataFrame:
    """``keys`` with the consecutive number (from 0) of each row in its ``group`` by ``order``.

    ``keys`` should be narrow: its rows are shuffled and written once.  Rows with
    equal (group, order) get different numbers, in any order.  A null group is a
    group of its own; null orders come first.
    """
    placed = keys.repartitionByRange(F.col(group), F.col(order)).sortWithinPartitions(group, order)
    placed = staged(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col("_at"), _PLACE_BITS)
    counts = placed.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_g", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = placed.withColumn("_p", part).join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_part")))
    return joined.select(*keys.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias(into))
