"""Tables written to the shared folder of ``spark.checkpoint.dir``, to cut lineage or to be read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanpref.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/spanpref/{name}-{uuid.uuid4().hex}"


#: Rows of a Parquet row group of wide rows.  A reader takes up to 4,096 rows of a row group at
#: once, decoded; token tables have some 100 KB a row.
WIDE_ROWS = 64
WIDE = {"parquet.block.row.count.limit": str(WIDE_ROWS)}


def staged(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back: survives lost executors, computed once.  ``wide``: rows of long arrays."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").options(**(WIDE if wide else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
