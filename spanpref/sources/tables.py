"""Scans of the input tables with explicit schemas (no inference)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "benchmark": "item_id BIGINT, text STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_extraction_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``(ex_id BIGINT, query STRING, answer STRING)`` from Parquet or JSON lines."""
    schema = "ex_id BIGINT, query STRING, answer STRING"
    return spark.read.schema(schema).format(fmt).load(path)
