"""Confusion-matrix CSV reader and writer.

Reader: three header dialects (``Ground_Truth_Code``, ``Ground_Truth_SubCode``,
``Ground_Truth_Subcode``); rows without any of them are skipped; ``Count`` is an
integer.  Of rows with the same (gt, pred) the last of the file wins, as in a
sequential reader: rows are ordered by their split's place in the file and their
place in the split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIALECTS = {
    "code": ("Ground_Truth_Code", "Predicted_Code"),
    "sub_code": ("Ground_Truth_Subcode", "Predicted_Subcode"),
}
ALT_SUB = ("Ground_Truth_SubCode", "Predicted_SubCode")


def read_confusion_csv(spark: SparkSession, path: str, model: str = "model") -> DataFrame:
    """``(model, kind, gt, pred, cnt)`` from one confusion CSV (any dialect)."""
    raw = spark.read.option("header", True).csv(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    cols = set(raw.columns)
    if "Ground_Truth_Code" in cols:
        kind, (g, p) = "code", DIALECTS["code"]
    elif "Ground_Truth_SubCode" in cols or "Ground_Truth_Subcode" in cols:
        kind = "sub_code"
        g = "Ground_Truth_SubCode" if "Ground_Truth_SubCode" in cols else "Ground_Truth_Subcode"
        p = "Predicted_SubCode" if "Predicted_SubCode" in cols else "Predicted_Subcode"
    else:
        return spark.createDataFrame([], "model string, kind string, gt string, pred string, cnt bigint")
    out = raw.select(
        F.lit(model).alias("model"), F.lit(kind).alias("kind"),
        F.col(g).alias("gt"), F.col(p).alias("pred"), F.col("Count").cast("bigint").alias("cnt"), place.alias("place"),
    )
    return out.groupBy("model", "kind", "gt", "pred").agg(F.max_by("cnt", "place").alias("cnt"))


def write_confusion_csv(edges: DataFrame, path: str, kind: str) -> None:
    """S4 + T1: header CSV with the reference's column names, sorted by count desc.

    The edge table has at most |labels|^2 rows, so one output file is fine.
    """
    g, p = DIALECTS[kind]
    (
        edges.select(F.col("ground_truth").alias(g), F.col("predicted").alias(p), F.col("count").alias("Count"))
        .orderBy(F.col("Count").desc(), F.col(g), F.col(p))
        .coalesce(1)
        .write.mode("overwrite").option("header", True).csv(path)
    )
