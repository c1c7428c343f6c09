"""Operator 5: quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector for all grades,
ordered thresholds between them. x hashes a text: how often each word, each
word shape (letters, digits and marks as classes) and each kind of neighbour
occurs, as square roots of shares, with a few measures (length, repetition,
variety). Grades may be any integers; as many thresholds as grades less one.

Weights are fitted on at most ``SAMPLE_ROWS`` labelled rows (a documented bound)
whose crc32(doc_id) mod 4 is not 2, one of each group of copies. Scoring is
narrow: no shuffle. The expected grade and the tail probability of the best
grade select.

Defined results: null text counts as empty and is scored; null grades and those
of unknown documents are left out, of several grades of one document the lowest
counts; with fewer than two grades the known grade (else 0) is expected with
tail probability 1; an empty table gives no rows. Repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import Memo, doc_texts, id_remainder, staged
from spanpref.llm.toxicity import sketch

SAMPLE_ROWS, MODULUS, HELD_OUT, WORD_LIMIT = 6_000, 4, 2, 400_000
WORD_SLOTS, SHAPE_SLOTS, MEASURES = 4096, 2048, 64
SLOTS = WORD_SLOTS + SHAPE_SLOTS + MEASURES
SELECT = 0.5
_CLASSES = ((re.compile(r"[^\W\d_]"), "a"), (re.compile(r"\d"), "0"))
_RUN = re.compile(r"(.)\1+")


def shape_of(word: str) -> str:
    """Letters as ``a``, digits as ``0``, runs as one."""
    for pattern, mark in _CLASSES:
        word = pattern.sub(mark, word)
    return _RUN.sub(r"\1", word)


def slots_of(word: str) -> tuple[int, int]:
    text = word.lower().encode()
    return zlib.crc32(text) % WORD_SLOTS, WORD_SLOTS + zlib.crc32(shape_of(word).encode()) % SHAPE_SLOTS


def features(text: str, memo: dict) -> np.ndarray:
    """Feature vector of a whole text."""
    words = text.split()
    x = np.zeros(SLOTS)
    base = WORD_SLOTS + SHAPE_SLOTS
    x[base] = 1.0
    if not words:
        x[base + 1] = 1.0
        return x
    n = len(words)
    slots = np.array([memo[w] for w in words])
    counts = np.bincount(slots.ravel(), minlength=SLOTS)
    x[: len(counts)] += np.sqrt(counts / n)
    x[base], x[base + 1] = 1.0, 0.0
    x[base + 2] = sum(map(str.__eq__, words, words[1:])) / n
    x[base + 3] = len(set(words)) / n
    x[base + 4] = min(1.0, np.log10(n + 1) / 5)
    lines = text.split("\n")
    x[base + 5] = len(set(lines)) / len(lines)
    x[base + 6] = min(4.0, len(text) / n / 8)
    x[base + 7] = float(np.count_nonzero(slots[:, 0][1:] == slots[:, 0][:-1]) * 4 > n)
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int, l2: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by accelerated gradient steps on the mean log-likelihood."""
    w = np.zeros(x.shape[1])
    shares = np.cumsum(np.bincount(grade, minlength=n_grades) + 0.5)[:-1] / (len(grade) + 0.5 * n_grades)
    t = np.log(shares / (1 - shares))
    scale = 1 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-4)
    low_i, high_i = grade - 1, grade
    past_w, past_t = w.copy(), t.copy()
    for turn in range(rounds):
        ahead = turn / (turn + 3)
        lw, lt = w + ahead * (w - past_w), np.maximum.accumulate(t + ahead * (t - past_t))
        z = (x @ lw.astype(x.dtype)).astype(np.float64)
        upper = np.where(high_i < n_grades - 1, sigmoid(lt[np.minimum(high_i, n_grades - 2)] - z), 1.0)
        lower = np.where(low_i >= 0, sigmoid(lt[np.maximum(low_i, 0)] - z), 0.0)
        chance = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
        grad_w = (du - dl).astype(x.dtype) @ x / len(grade) + l2 * lw / scale
        grad_t = np.array([(du * (high_i == k)).sum() - (dl * (low_i == k)).sum() for k in range(n_grades - 1)]) / len(grade)
        past_w, past_t = w, t
        w = lw - 0.3 * scale * grad_w / np.sqrt(SLOTS) * 8
        t = np.maximum.accumulate(lt + 2.0 * grad_t + np.arange(n_grades - 1) * 1e-9)
    return w, t


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def grade_chances(self, z: np.ndarray) -> np.ndarray:
        """P(grade = k), one row a text."""
        if len(self.grades) < 2:
            return np.ones((len(z), 1))
        below = sigmoid(self.thresholds[None, :] - z[:, None])
        edges = np.concatenate([np.zeros((len(z), 1)), below, np.ones((len(z), 1))], axis=1)
        return np.diff(edges, axis=1)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(text, grade)`` of at most ``SAMPLE_ROWS`` labelled training rows, by a hash of doc_id."""
    train = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(MODULUS) != HELD_OUT))
    one = train.groupBy("doc_id").agg(F.min("quality").cast("int").alias("grade"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).select(F.col("doc_id").alias("labelled"), "grade")
    return doc_texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("text", "grade")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; its feature vectors (sparse) come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(slots_of, WORD_LIMIT)
        for batch in batches:
            at, value, seen = [], [], []
            for text in batch.column(0):
                x = features(text.as_py(), memo)
                at.append(np.flatnonzero(x).astype(np.int32))
                value.append(x[at[-1]].astype(np.float32))
                seen.append(sketch(text.as_py()))
            lists = [pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(seen, pa.int64()), *lists], ["grade", "sketch", "at", "value"])

    rows = labelled_sample(docs, labels).mapInArrow(run, "grade int, sketch long, at array<int>, value array<float>")
    rows = staged(rows, "quality-sample").toPandas().drop_duplicates("sketch")
    grades = sorted({int(g) for g in rows["grade"]})
    if len(grades) < 2:
        return Model(np.zeros(SLOTS), np.zeros(0), grades or [0])
    x = np.zeros((len(rows), SLOTS), np.float32)
    for i, (at, value) in enumerate(zip(rows["at"], rows["value"])):
        x[i, at] = value
    grade = np.searchsorted(grades, rows["grade"].to_numpy())
    w, t = fit_ordinal(x, grade, len(grades))
    return Model(w, t, grades)


def rated(docs: DataFrame, model: Model, tail: int | None = None) -> DataFrame:
    """``(doc_id, expected_grade, tail_prob)`` per row; the tail is P(grade >= ``tail``), by default the best grade."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    tail = model.grades[-1] if tail is None else tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        memo, values = Memo(slots_of, WORD_LIMIT), np.array(m.grades, float)
        for batch in batches:
            z = np.array([features(t.as_py(), memo) @ m.weights for t in batch.column(1)], float)
            p = m.grade_chances(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ values), pa.array(p[:, values >= tail].sum(axis=1))], ["doc_id", "expected_grade", "tail_prob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_texts(docs).mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double")


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, expected_grade, tail_prob, selected)`` per row."""
    rows = rated(docs, fit(docs, labels))
    return rows.select("doc_id", (id_remainder(MODULUS) == HELD_OUT).alias("held_out"), "expected_grade", "tail_prob", F.when(F.col("tail_prob") >= SELECT, 1).otherwise(0).alias("selected"))
