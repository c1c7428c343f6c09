"""Sinks for predictions, pairs, reports and run config.

A sink is one folder with one sub-folder per model.  Writing replaces the folders of
the models written and leaves the others (dynamic partition overwrite), so one
model's run can be repeated at any time with the same result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from spanpref.lineage import WIDE, WIDE_ROWS

PAIR_COLUMNS = ("model", "pair_id", "prompt", "chosen", "rejected", "metadata", "strategy")


def first_n(df: DataFrame, n: int, order_col: str = "ex_id") -> DataFrame:
    """``--max_samples``: the first n rows by id (0 = all)."""
    return df if not n else df.orderBy(order_col).limit(n)


def write_models(df: DataFrame, path: str, kind: str = "parquet", options: dict[str, str] | None = None) -> None:
    """``df`` under ``path/model=...``, replacing the folders of its models only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**(options or {})).partitionBy("model").format(kind).save(path)


def write_prediction_dump(dump: DataFrame, path: str) -> None:
    """JSON lines per model folder (non-ASCII kept, arrays sorted upstream)."""
    write_models(dump, path, "json")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs as Parquet, one folder per model."""
    write_models(pairs.select(*PAIR_COLUMNS), path)


def write_run_config(config: DataFrame, path: str) -> None:
    """One JSON object per model."""
    write_models(config, path, "json")


def write_example_metrics(counts: DataFrame, path: str) -> None:
    """Per-example tp/fp/fn by level, partitioned by model."""
    keep = ["model", "ex_id"] + [c for c in counts.columns if c.endswith(("_tp", "_fp", "_fn"))]
    write_models(counts.select(*keep), path)


#: Models a task writes side by side; only with more of them it sorts its rows by model.
MODELS_AT_ONCE = 8


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """A task's rows go to the files of their models as they come, without a sort by model first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(MODELS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_token_table(batches: DataFrame, path: str) -> None:
    """Training-ready token table (K11 types), one folder per model.

    A row holds some 100 KB of arrays: rows are not sorted, and row groups are of few rows.
    """
    with unsorted_writes(batches.sparkSession):
        write_models(batches, path, options=WIDE)


ArrowPass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Arrow's names of the codecs of ``spark.sql.parquet.compression.codec`` that it calls otherwise.
CODECS = {"uncompressed": "none", "lz4_raw": "lz4"}
#: Characters that Spark writes as ``%XX`` in the name of a partition's folder.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def model_folder(model: str | None) -> str:
    """The folder of a model, as Spark names it."""
    return "model=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", model) if model else "__HIVE_DEFAULT_PARTITION__")


def shared_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as workers open it, if Spark's files there are plain files; ``None`` for any other file system."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toUri()
    return found.getPath() if found.getScheme() == "file" else None


def write_token_pass(rows: DataFrame, make: ArrowPass, schema: StructType, path: str) -> None:
    """:func:`write_token_table` of ``rows.mapInArrow(make, schema)``, the arrays written by the tasks that make them.

    Spark's writer takes an array value by value, five times the time of making and writing
    it here.  As with Spark's writer, a task's files become the table's only when all tasks
    are done: they lie in a hidden folder before, under names of their own, and of those
    only the ones that finished tasks report are moved.  ``rows`` come by model.  File
    systems that only Spark opens, and models that are no texts, are left to Spark's writer.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, path)
    if folder is None or schema["model"].dataType != StringType():
        return write_token_table(rows.mapInArrow(make, schema), path)
    codec = spark.conf.get("spark.sql.parquet.compression.codec").lower()
    hidden = f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    written = rows.mapInArrow(_files_writer(make, hidden, CODECS.get(codec, codec)), "model string, file string")
    files = arrow_fs.LocalFileSystem()
    files.create_dir(hidden)
    try:
        _replace_models(files, folder, hidden, written.collect())  # a row a file
    finally:
        files.delete_dir(hidden)
    files.open_output_stream(f"{folder}/_SUCCESS").close()
    spark.catalog.refreshByPath(path)


def _files_writer(make: ArrowPass, hidden: str, codec: str) -> ArrowPass:
    """What a task does: a file for each run of a model's rows, a row group for at most ``WIDE_ROWS`` rows; gives out the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done, writer, of = arrow_fs.LocalFileSystem(), [], None, None
        try:
            for made in make(_model_runs(batches)):
                model = made.column("model")[0].as_py()
                if writer is None or model != of:
                    if writer is not None:
                        writer.close()
                    of, (folder, name) = model, (model_folder(model), f"part-{uuid.uuid4().hex}.parquet")
                    files.create_dir(f"{hidden}/{folder}")
                    columns = _dense(made.schema)
                    plain = [f.name for f in columns if not pa.types.is_list(f.type)]
                    writer = pq.ParquetWriter(f"{hidden}/{folder}/{name}", columns, filesystem=files, compression=codec, write_statistics=plain)
                    done.append((folder, name))
                writer.write_batch(made.select(columns.names).cast(columns), row_group_size=WIDE_ROWS)
        finally:
            if writer is not None:
                writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["model", "file"])

    return run


def _dense(schema: pa.Schema) -> pa.Schema:
    """The columns of a file; arrays and their values are never null, which takes fewer levels to write."""
    def dense(kind: pa.DataType) -> pa.DataType:
        return pa.list_(pa.field("element", kind.value_type, nullable=False))

    return pa.schema([pa.field(f.name, dense(f.type), nullable=False) if pa.types.is_list(f.type) else f for f in schema if f.name != "model"])


def _model_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where the model changes."""
    for batch in batches:
        if batch.num_rows:
            models = pc.run_end_encode(batch.column("model"))
            at = 0
            for end in models.run_ends.to_pylist():
                yield batch.slice(at, end - at)
                at = end


def _replace_models(files: arrow_fs.FileSystem, folder: str, hidden: str, written: list) -> None:
    """The files written in place of their models' folders."""
    for model in sorted({row["model"] for row in written}):
        files.create_dir(f"{folder}/{model}")
        files.delete_dir_contents(f"{folder}/{model}")
    for row in written:
        files.move(f"{hidden}/{row['model']}/{row['file']}", f"{folder}/{row['model']}/{row['file']}")


def written_twice(df: DataFrame, path: str, write, kind: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """``df`` as read back from ``path`` after its sink wrote all models, and then every second one again; ``schema``: of what is written, if not that of ``df``."""
    write(df, path)
    for row in df.select("model").distinct().orderBy("model").collect()[::2]:  # one row per model
        write(df.where(F.col("model").eqNullSafe(F.lit(row["model"]))), path)
    return df.sparkSession.read.schema(schema or df.schema).format(kind).load(path)
