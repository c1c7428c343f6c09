"""Shared helpers: table access, staging in the shared folder, bounded memos, graph components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanpref.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The path may be of any file system Spark reads."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones; other columns are left behind."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_remainder(modulus: int, doc_id: str = "doc_id"):
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def lower_ascii(col):
    """A-Z to a-z, other letters unchanged."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of at most ``rows`` rows, so that a task holds little at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_HELD: dict = {}


def held_once(key, build=lambda: None):
    """What ``build`` makes, kept by this worker until an operator asks for something else.

    Workers outlive their tasks and serve one operator after the other; a worker
    keeps the tables of one at a time, so their memory doesn't add up.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = build()
    return _HELD[key]


class Memo(dict):
    """A dict that computes what is missing and holds ``limit`` entries at most.

    Two generations: at half the limit the entries become the old generation,
    and those used again come back from it, so frequent keys stay.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._half, self._old = compute, max(1, limit // 2), {}

    def recall(self, key):
        """Bring a key back from the old generation; None if it is nowhere."""
        value = self._old.get(key)
        if value is not None:
            self[key] = value
        return value

    def __setitem__(self, key, value):
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()
        super().__setitem__(key, value)

    def __missing__(self, key):
        value = self.recall(key)
        if value is None:
            value = self[key] = self._compute(key)
        return value


def dealt_anew(column: str):
    """The same long by an expression Spark doesn't know its partitioning by.

    A join on it shuffles an aggregate once more, so that both sides of the join
    come from exchanges and Spark may split a hot key among tasks.
    """
    return F.bitwise_not(F.bitwise_not(F.col(column)))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)`` as ``(node, component)``, component = smallest node.

    Alternating large-star and small-star steps: every step is an aggregation
    (``min`` per node, summed up before the shuffle) and an equi-join that Spark
    may split, so a node with very many neighbours is no single task's work.
    Each round's edges are written to the shared folder; only a count and a
    checksum come to the driver. Null ends are ignored; a node without edges to
    others has no row. ``max_rounds`` is a guard that raises: the number of
    rounds grows with the logarithm of the graph.
    """

    def least_of(near: DataFrame) -> DataFrame:
        return near.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("k"), F.least("m", "u").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        far = both.where("v > u").join(least_of(both), F.col("u") == F.col("k"))
        return far.select(F.col("v").alias("a"), F.col("m").alias("b"))  # larger end first

    def small_star(e: DataFrame) -> DataFrame:
        near = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = least_of(near)
        linked = near.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        return linked.unionAll(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()

    def print_of(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(a, b) as decimal(38,0))), 0)")).first())

    cur = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = print_of(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        cur = staged(small_star(large_star(cur)), name)
        now = print_of(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    tree = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tree.unionAll(tree.select(F.col("component").alias("node"), "component").distinct())
