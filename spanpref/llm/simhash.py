"""Operator 10: SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint is cut into three segments (22, 21, 21 bits). Two fingerprints at
most two bits apart agree wholly in one segment at least (pigeonhole), and in
every other segment they differ by two bits at most. The perfect binary Golay
code [23, 12, 7] decodes each 23-bit word to one codeword; the codewords of a
word and of its 23 neighbours give one or six indices, and two words at most two
bits apart share one, as they have a neighbour in common. A key is therefore an
exact segment with one codeword index of the next: sixteen keys a fingerprint,
joined on equality and verified by the bit distance.

Equal fingerprints are one class, so copies are never paired. Keys with very
many classes aren't paired either: their classes are linked through the points
at distance one or less, since two fingerprints are at most two bits apart if
and only if they share such a point. Both ways are exact.

Defined results: null text counts as empty, no words give the zero fingerprint,
which is linked like any other; fewer words than a shingle are one shingle;
null doc_ids get a fingerprint and never name a component (a component of null
ids alone has a null name); repeated rows are copies; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import components, dealt_anew, held_once, slices, staged

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Keys with more classes than this are linked through shared points; it changes the way, not the result.
PAIRED = 48
#: g(x) of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; ``bytes`` split and lower at ASCII only."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        n = min(_CHUNK, total - at)
        h = np.fromiter((digest(g, SEED) for _, g in zip(range(n), grams)), np.uint64, n)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)``: signed 64-bit fingerprints, with a hash that tells rows of equal doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_once("simhash")
        for batch in slices(batches):
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of all 12-bit upper parts and lower parts, and the error pattern of every syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    single = [remainder(1 << i) for i in range(23)]
    upper = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        upper[1 << bit : 2 << bit] = upper[: 1 << bit] ^ single[bit + 11]
    error = np.zeros(1 << 11, np.int64)
    for a in range(23):
        error[single[a]] = 1 << a
        for b in range(a):
            error[single[a] ^ single[b]] = 1 << a | 1 << b
            for c in range(b):
                error[single[a] ^ single[b] ^ single[c]] = 1 << a | 1 << b | 1 << c
    return upper, error


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    upper, error = _golay()
    syndrome = upper[words >> 11] ^ (words & 0x7FF)
    return (words ^ error[syndrome]) >> 11


def golay_indices(words: np.ndarray) -> np.ndarray:
    """24 columns: the indices of each word and of its 23 neighbours, with -1 for repeats."""
    all_ = np.stack([golay_index(words), *(golay_index(words ^ (1 << i)) for i in range(23))], axis=1)
    all_.sort(axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
    return all_


def keys(classes: DataFrame) -> DataFrame:
    """``(key, fp)``: the fuzzy-hash keys of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [(fp >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
            found, whose = [], []
            for i, exact in enumerate(parts):
                index = golay_indices(parts[(i + 1) % 3])
                row, col = np.nonzero(index >= 0)
                found.append((i << 34) | (exact[row] << 12) | index[row, col])
                whose.append(row)
            row = np.concatenate(whose)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(fp[row].view(np.int64))], ["key", "fp"])

    return classes.select("fp").mapInArrow(run, "key long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """``(a, b)``: verified links between classes that connect all within two bits."""
    found = staged(keys(classes), "simhash-keys")
    sizes = found.groupBy("key").agg(F.count("*").alias("n"))
    few = sizes.where(f"n between 2 and {PAIRED}").select(F.col("key").alias("k"))
    small = found.join(few, F.col("key") == F.col("k"), "left_semi")
    left, right = small.select(F.col("key").alias("k1"), F.col("fp").alias("a")), small.select(F.col("key").alias("k2"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = left.join(right, (F.col("k1") == F.col("k2")) & (F.col("a") < F.col("b")) & near).select("a", "b")
    many = sizes.where(f"n > {PAIRED}").select(F.col("key").alias("k"))
    hot = found.join(many, F.col("key") == F.col("k"), "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    points = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select(F.col("point").alias("p"), "a")
    star = points.join(least, F.col("point") == F.col("p")).select("a", F.col("fp").alias("b")).where((F.col("a") != F.col("b")) & near)
    return pairs.unionAll(star)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` per row.

    ``root`` names the component by its smallest fingerprint, ``component_id``
    by the smallest doc_id reachable by links.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the segments and keys are made for a distance of two bits")
    fps = staged(fingerprints(docs, shingle), "simhash-fp")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-classes")
    tree = components(links(classes), "simhash-links").select(F.col("node").alias("n"), "component")
    roots = classes.join(tree, F.col("fp") == F.col("n"), "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id")).select(dealt_anew("root").alias("r"), "component_id")
    named = roots.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return fps.join(named, F.col("fp") == F.col("f")).select("doc_id", "text_hash", "fp", "root", "component_id")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def result(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns as they came.

    That of the smallest doc_id stays; of rows that share it, that of the smallest text hash, once.
    """
    rows = near_duplicates(docs, shingle, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select("kept")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    doc_id, text = (plain[names[docs.columns.index(c)]] for c in ("doc_id", "text"))
    own = F.struct(doc_id.alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"))
    chosen = plain.select(*names, own.alias("own")).join(kept, F.col("own") == F.col("kept"))
    return chosen.dropDuplicates(["kept"]).select(*names).toDF(*docs.columns)
