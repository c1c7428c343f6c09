"""Operator 13: hard negatives by a BOND vertical scan.

Vectors are scaled to integers and scanned in blocks that hold one column per
dimension, with the column's smallest and largest value. For each anchor the
columns are read in descending order of the anchor's magnitudes. After each few
columns a candidate's partial score, with what the columns left could add at
least and at most, bounds its score; candidates whose bounds can't matter any
more leave the bitmap:

* positives: the ``POSITIVES`` best rows of the anchor's label. A candidate goes
  when its upper bound lies under that many lower bounds or scores known;
* negatives: per positive, the ``NEGATIVES`` best rows of other labels whose score
  lies in the window ``LOW * positive <= 100 * score <= HIGH * positive``. A
  candidate goes when it can't lie in any window, or when each window it may lie
  in has enough better candidates that lie there for certain.

What survives all columns has its exact score, so the results are exact.

Anchors are the query set. They come in blocks of ``ANCHOR_BLOCK``, one after the
other: a block is broadcast (a fixed number of vectors), every block of vectors
meets it in a narrow scan, each task keeps the best rows per anchor, and these few
are merged after a small shuffle. Positives of a block are known before its
negatives are searched. Each block's rows are written to the shared folder.

Defined results: rows with a null id, label or vector, or with any null or
non-finite component take no part; of rows with the same id the one of the least
label, then of the least vector, counts; vectors of different lengths never
meet; a positive of negative score has an empty window; ties go by the smaller
id; an empty table or one without anchors gives no rows; other columns are left
behind. Components are whole numbers of 64 bits; products that could exceed them
raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanpref.llm.common import held_once, scratch_path, staged

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 10, 30, 90
#: Vectors per columnar block, columns read between two looks at the bounds, anchors broadcast at a time.
BLOCK, STEP, ANCHOR_BLOCK = 8192, 8, 8192
NONE = np.iinfo(np.int64).min
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """``(vec_id, label, q)``: one row per id, ``q`` the components times ``scale``, rounded down."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(~broken)
    q = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = usable.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.*")


class Columns:
    """Vectors of one length as columns, with each column's range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels = ids, labels
        self.columns = np.ascontiguousarray(matrix.T)
        self.d = len(self.columns)
        self.low, self.high = (f(self.columns, axis=1) if self.d else np.empty(0, np.int64) for f in (np.min, np.max))
        self.widest = float(np.abs(self.columns.astype(np.float64)).max()) if self.d else 0.0

    def scan(self, anchor: np.ndarray, alive: np.ndarray, settle) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows of ``alive`` that ``settle(lower, upper)`` keeps to the end."""
        if self.d and float(np.abs(anchor.astype(np.float64)).max()) * self.widest * self.d >= 2.0**62:
            raise OverflowError("inner products exceed 64-bit whole numbers")
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        left = [np.concatenate([np.cumsum(f(ends, axis=0)[::-1])[::-1], [0]]) for f in (np.min, np.max)]
        partial = np.zeros(len(alive), np.int64)
        for at in range(0, self.d + 1, STEP):
            keep = settle(partial + left[0][at], partial + left[1][at])
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
            for k in order[at : at + STEP]:
                partial += anchor[k] * self.columns[k][alive]
        return alive, partial


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; the least number there is if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else NONE


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best by score, then by the smaller id."""
    if len(scores) > k:
        some = scores >= kth(scores, k)
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
    """Columnar blocks of ``(vec_id, label, q)`` batches, by the vectors' length."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ids, labels = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            q = part.column(2)
            sizes = np.diff(q.offsets.to_numpy())
            flat = q.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                yield Columns(ids[rows], labels[rows], flat[starts[rows][:, None] + np.arange(d)])


class Anchors:
    """One block of anchors, by the vectors' length: ``{d: (places, matrix)}``."""

    def __init__(self, rows: list):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = [np.array(r["q"], np.int64) for r in rows]
        self.by_length: dict[int, list[int]] = {}
        for i, v in enumerate(self.vectors):
            self.by_length.setdefault(len(v), []).append(i)


def positives_of(anchors: Anchors, batches: Iterator[pa.RecordBatch], k: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per anchor place: scores and ids of the best ``k`` rows of its label in these batches."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    nothing = np.empty(0, np.int64)
    for block in blocks_of(batches):
        rows = {label: np.flatnonzero(block.labels == label) for label in np.unique(block.labels).tolist()}
        for i in anchors.by_length.get(block.d, ()):
            alive = rows.get(int(anchors.labels[i]))
            if alive is None:
                continue
            alive = alive[block.ids[alive] != anchors.ids[i]]
            scores, ids = found.get(i, (nothing, nothing))
            known = kth(scores, k)
            alive, exact = block.scan(anchors.vectors[i], alive, lambda lower, upper: upper >= max(known, kth(lower, k)))  # noqa: B023
            found[i] = best(np.concatenate([scores, exact]), np.concatenate([ids, block.ids[alive]]), k)
    return found


def negatives_of(anchors: Anchors, windows: dict[int, list[tuple[int, int, int]]], batches: Iterator[pa.RecordBatch], k: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per anchor place and window place: scores and ids of the best ``k`` rows of other labels in the window ``(low, high)``."""
    found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    nothing = np.empty(0, np.int64)
    for block in blocks_of(batches):
        for i in anchors.by_length.get(block.d, ()):
            open_ = [(j, low, high) for j, low, high in windows.get(i, ()) if low <= high]
            if not open_:
                continue
            known = {j: kth(found.get((i, j), (nothing,))[0], k) for j, _, _ in open_}

            def settle(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                keep = np.zeros(len(lower), bool)
                for j, low, high in open_:  # noqa: B023
                    certain = lower[(lower >= low) & (upper <= high)]
                    keep |= (upper >= max(low, known[j], kth(certain, k))) & (lower <= high)  # noqa: B023
                return keep

            alive, exact = block.scan(anchors.vectors[i], np.flatnonzero(block.labels != anchors.labels[i]), settle)
            ids = block.ids[alive]
            for j, low, high in open_:
                inside = (exact >= low) & (exact <= high)
                if inside.any():
                    scores, others = found.get((i, j), (nothing, nothing))
                    found[i, j] = best(np.concatenate([scores, exact[inside]]), np.concatenate([others, ids[inside]]), k)
    return found


def _batch(names: list[str], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def anchor_blocks(anchors: DataFrame, size: int) -> Iterator[list]:
    """The anchors in blocks of at most ``size`` rows."""
    block = []
    for row in anchors.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def _positives(vectors: DataFrame, held, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_once("bond")
        anchors = held.value
        found = positives_of(anchors, batches, k)
        rows = [(int(anchors.ids[i]), int(b), int(s)) for i, (scores, ids) in found.items() for s, b in zip(scores, ids)]
        if rows:
            yield _batch(["anchor_id", "positive_id", "positive_score"], list(zip(*rows)))

    local = vectors.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return local.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _negatives(vectors: DataFrame, held, held_windows, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_once("bond")
        anchors, (pairs, windows) = held.value, held_windows.value
        found = negatives_of(anchors, windows, batches, k)
        rows = [(int(anchors.ids[i]), *pairs[i][j], int(b), int(s)) for (i, j), (scores, ids) in found.items() for s, b in zip(scores, ids)]
        if rows:
            yield _batch(["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], list(zip(*rows)))

    local = vectors.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    embeddings: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of the rows for which ``is_anchor`` (a condition on vec_id) holds."""
    spark = embeddings.sparkSession
    # rows of a label side by side: blocks hold few labels, and their columns vary less
    vectors = staged(whole_vectors(embeddings, scale).sortWithinPartitions("label", "vec_id"), "bond-vectors")
    out = scratch_path(spark, "bond-negatives")
    wrote = False
    for n, rows in enumerate(anchor_blocks(vectors.where(is_anchor), anchor_block)):
        anchors = Anchors(rows)
        held = spark.sparkContext.broadcast(anchors)
        place = {int(a): i for i, a in enumerate(anchors.ids)}
        pairs: dict[int, list[tuple[int, int]]] = {}
        windows: dict[int, list[tuple[int, int, int]]] = {}
        # at most ``positives`` rows for each anchor of the block
        for r in sorted(_positives(vectors, held, positives).collect(), key=lambda r: (r["anchor_id"], r["place"])):
            i, score = place[r["anchor_id"]], r["positive_score"]
            pairs.setdefault(i, []).append((r["positive_id"], score))
            windows.setdefault(i, []).append((len(pairs[i]) - 1, -(-low * score // 100), high * score // 100))
        held_windows = spark.sparkContext.broadcast((pairs, windows))
        _negatives(vectors, held, held_windows, negatives).write.option("compression", "zstd").parquet(f"{out}/block={n}")
        held.destroy()
        held_windows.destroy()
        wrote = True
    return spark.read.schema(SCHEMA).parquet(f"{out}/block=*") if wrote else spark.createDataFrame([], SCHEMA)


def moved_labels(embeddings: DataFrame) -> DataFrame:
    """The contract's labels: those of ids divisible by 7 go one up, modulo 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return embeddings.select("vec_id", moved.alias("label"), "embedding")


def result(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: anchors are the rows whose vec_id is divisible by 100."""
    return mine(moved_labels(embeddings), F.col("vec_id") % 100 == 0)
