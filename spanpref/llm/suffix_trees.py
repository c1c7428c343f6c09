"""Operator 12: repeated passages by prefix-partitioned suffix trees.

A suffix starts at every word of a document that has ``WINDOW`` words from there on.
Suffixes with the same first ``WINDOW`` words meet in one deep node of the corpus's
suffix tree; a node that holds several documents is a repeat, and stretches of such
suffixes are the maximal repeats of a document.

The tree is never built whole:

1. Each suffix is dealt by a prefix of ``PREFIX`` words, read from the place in its
   first ``WINDOW`` words where that prefix has the smallest hash. Equal windows read
   equal prefixes, and neighbouring suffixes mostly share theirs, so a run of them is one
   record and the text of a run is sent once.
2. Prefixes are counted over the whole corpus, summed up before the shuffle. Those
   of a single document lead to no deep node: their suffixes end here.
3. A prefix with ``GROUP_RUNS`` runs at most is a group that fits in memory. Groups are
   sent whole; a task joins as many as fit and builds their subtree level by level
   (nodes of 1, 2, 4 ... ``WINDOW`` words, each from two of the level before). Words are
   compared as they are.
4. More frequent prefixes are made longer, up to the whole window. Such a group is
   one deep node and needs no tree, only its smallest document: a minimum by the
   window's 128-bit print, summed up before the shuffle, so a passage in a third of
   all documents is no task's burden.
5. Each document's repeated windows become word spans, and the document is cut by them.

Windows are judged on the input, whatever is removed elsewhere. Words are bytes between
ASCII white space, unchanged.

Defined results: null texts have no words; a null doc_id is smaller than no other and
has no smaller one: nothing is removed there and it removes nothing; documents of the
same doc_id don't remove each other's words; repeated rows each give a row; texts
shorter than a window stay whole; an empty table gives no rows; other columns are left
behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanpref.llm.common import dealt_anew, held_once, slices, staged

WINDOW, PREFIX = 50, 8
#: Runs of a group, and runs whose subtree is built at once.
GROUP_RUNS, TREE_RUNS = 256, 16_384
#: Bytes whose words are coded together, and places looked at together when a prefix is chosen.
PIECE, SPAN = 1 << 16, 1 << 16
SPACE = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), list(SPACE))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space (``bytes.split`` knows just these six)."""
    return text.split()


def words_in(text: bytes, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit code, the start and the end of every word; equal words have equal codes.

    A code is a polynomial of the word's bytes, read off running sums. Texts are taken in pieces cut at white space.
    """
    power, inverse = held_once("suffix-powers", _powers)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and text[end] not in SPACE:
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        letter = np.concatenate([[False], ~IS_SPACE[data], [False]])
        edge = np.flatnonzero(letter[1:] != letter[:-1])
        start, stop = edge[0::2], edge[1::2]
        if len(data) > len(power):  # one word longer than a piece
            power, inverse = _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        parts.append(((sums[stop] - sums[start]) * inverse[start], start + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def _powers(n: int = PIECE + 4096) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of ``width`` values from each place on, the leftmost of equal ones."""
    # the place in the low bits; the runs' minima double in length until two of them cover the window
    keyed = (values & ~np.uint64(2 * SPAN - 1)) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        keyed = np.minimum(keyed[:-have], keyed[have:])
        have *= 2
    if have < width:
        keyed = np.minimum(keyed[: have - width], keyed[width - have :])
    return (keyed & np.uint64(2 * SPAN - 1)).astype(np.int64)


def runs_of(codes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that are dealt by the same prefix: its hash, the first suffix, and the one after the last."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(len(codes) - prefix + 1, np.uint64)
    for i in range(prefix):
        grams = grams * _MIX + codes[i : i + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width = window - prefix + 1
    chosen = np.concatenate([at + _least_places(grams[at : min(at + SPAN, n) + width - 1], width) for at in range(0, n, SPAN)])
    starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return grams[chosen[starts]], starts, np.append(starts[1:], n)


def deep_nodes(runs: list[list[bytes]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(run, suffix, node)`` of every suffix of ``runs`` (word lists): the node of ``window`` words it lies under.

    Level by level: the node of ``2 k`` words is given by those of the first and the last
    ``k``. Places whose words would run over the end of a run have no node (-1).
    """
    sizes = np.array([len(r) for r in runs], np.int64)
    numbers: dict[bytes, int] = {}
    node = np.fromiter((numbers.setdefault(w, len(numbers)) for r in runs for w in r), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(node))
    depth = 1
    while depth < window:
        step = min(depth, window - depth)
        depth += step
        whole = np.flatnonzero(left >= depth)
        pair = node[whole] * (int(node.max(initial=0)) + 1) + node[whole + step]
        deeper = np.full(len(node), -1, np.int64)
        deeper[whole] = pd.factorize(pair)[0]
        node = deeper
    places = np.flatnonzero(left >= window)
    run = np.repeat(np.arange(len(runs)), sizes)[places]
    return run, places - (ends - sizes)[run], node[places]


def stretches(places: np.ndarray) -> list[tuple[int, int]]:
    """Sorted places as half-open stretches of consecutive ones."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), (places[np.append(cut, len(places) - 1)] + 1).tolist()))


def prints_of(held: list[bytes], window: int) -> Iterator[tuple[int, int]]:
    """128-bit prints of all windows of these words, as two signed halves."""
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = memoryview(b" ".join(held))
    for i in range(len(held) - window + 1):
        halves = np.frombuffer(xxhash.xxh3_128_digest(joined[begins[i] : begins[i + window] - 1]), "<i8")
        yield int(halves[0]), int(halves[1])


# ------------------------------------------------------------------ on Spark
def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, text)``: whole texts as bytes; rows of one id and text have one key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("print"), text.cast("binary").alias("text"))


def _prefix_runs(keyed: DataFrame, window: int, prefix: int) -> DataFrame:
    """``(key, doc_id, print, run)``: every run of suffixes and the prefix it is dealt by."""
    kind = keyed.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keys, sizes = [], []
            for text in batch.column(2):
                k = runs_of(words_in(text.as_py())[0], window, prefix)[0]
                keys.append(k)
                sizes.append(len(k))
            number = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32)
            row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            if len(number):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(number)],
                    ["key", "doc_id", "print", "run"],
                )

    return keyed.mapInArrow(run, f"key long, doc_id {kind.simpleString()}, print long, run int")


def _cut_runs(docs: DataFrame, crowded: bool, window: int, prefix: int) -> DataFrame:
    """The shared runs of ``(doc_id, print, text, runs)``: with their text, or, if crowded, suffix by suffix with their prints."""
    kind = docs.schema["doc_id"].dataType
    doc_type = to_arrow_type(kind)
    names = ["key", "other", "doc_id", "print", "start"] if crowded else ["key", "doc_id", "print", "start", "text"]
    types = [pa.int64(), pa.int64(), doc_type, pa.int64(), pa.int32()] if crowded else [pa.int64(), doc_type, pa.int64(), pa.int32(), pa.binary()]
    spec = f"key long, other long, doc_id {kind.simpleString()}, print long, start int" if crowded else f"key long, doc_id {kind.simpleString()}, print long, start int, text binary"

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, print_, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            wanted = [r["run"] for r in wanted.as_py() or () if r["crowded"] == crowded]
            if not wanted:
                continue
            text = text.as_py()
            codes, begins, stops = words_in(text)
            keys, starts, ends = runs_of(codes, window, prefix)
            for r in wanted:
                start, end = int(starts[r]), int(ends[r])
                piece = text[begins[start] : stops[end + window - 2]]
                if crowded:
                    yield from ((high, low, doc_id, print_, start + i) for i, (high, low) in enumerate(prints_of(words_of(piece), window)))
                else:
                    yield int(keys[r : r + 1].view(np.int64)[0]), doc_id, print_, start, piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            held = []
            for row in rows(batch):
                held.append(row)
                if len(held) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return docs.select("doc_id", "print", "text", "runs").mapInArrow(run, spec)


def _subtrees(runs: DataFrame, window: int) -> DataFrame:
    """``(doc_id, print, start, end)``: stretches of suffixes of these groups that a smaller document has too."""
    kind = runs.schema["doc_id"].dataType
    doc_type = to_arrow_type(kind)
    names = ["doc_id", "print", "start", "end"]

    def repeats(held: list[tuple]) -> Iterator[tuple]:
        run, suffix, node = deep_nodes([words_of(r[4]) for r in held], window)
        docs = sorted({r[1] for r in held})
        place = {d: i for i, d in enumerate(docs)}
        doc = np.fromiter((place[r[1]] for r in held), np.int64, len(held))[run]
        least = np.full(int(node.max(initial=-1)) + 1, len(docs), np.int64)
        np.minimum.at(least, node, doc)
        later = np.flatnonzero(least[node] < doc)
        for at in np.split(later, np.flatnonzero(np.diff(run[later])) + 1):
            if len(at):
                _, doc_id, print_, start, _ = held[run[at[0]]]
                yield from ((doc_id, print_, start + a, start + b) for a, b in stretches(suffix[at]))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [doc_type, pa.int64(), pa.int32(), pa.int32()])], names)

        held: list[tuple] = []
        for batch in slices(batches, 4096):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= TREE_RUNS and row[0] != held[-1][0]:
                    if found := list(repeats(held)):
                        yield batch_of(found)
                    held = []
                held.append(row)
        if held and (found := list(repeats(held))):
            yield batch_of(found)

    grouped = runs.repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(run_, f"doc_id {kind.simpleString()}, print long, start int, end int")


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``(doc_id, print, start, end)``: stretches of window starts (in words) that also start in a document of a smaller id.

    ``print`` is the text's hash and tells rows of one id apart; the maximal repeats are the word spans ``start`` to ``end - 1 + window``.
    """
    return _repeats(_keyed(docs), window, prefix, group_runs)


def _repeats(keyed: DataFrame, window: int, prefix: int, group_runs: int) -> DataFrame:
    runs = staged(_prefix_runs(keyed.where("doc_id is not null"), window, prefix), "suffix-runs")
    counts = runs.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    shared = counts.where("low <> high").select(dealt_anew("key").alias("k"), (F.col("n") > group_runs).alias("crowded"))
    per_doc = (
        runs.join(shared, F.col("key") == F.col("k"))
        .groupBy("doc_id", "print")
        .agg(F.collect_set(F.struct("run", "crowded")).alias("runs"))
        .select(F.col("doc_id").alias("d"), F.col("print").alias("p"), "runs")
    )
    marked = keyed.join(per_doc, (F.col("doc_id") == F.col("d")) & (F.col("print") == F.col("p")), "left")
    trees = _subtrees(_cut_runs(marked, False, window, prefix), window)
    windows = _cut_runs(marked, True, window, prefix)
    nodes = windows.groupBy("key", "other").agg(F.min("doc_id").alias("low"))
    nodes = nodes.select(dealt_anew("key").alias("k"), dealt_anew("other").alias("o"), "low")
    later = windows.join(nodes, (F.col("key") == F.col("k")) & (F.col("other") == F.col("o")) & (F.col("doc_id") > F.col("low")))
    return trees.unionAll(later.select("doc_id", "print", "start", (F.col("start") + 1).alias("end")))


def covered(n_words: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which words lie in a window that starts in one of the half-open stretches."""
    turn = np.zeros(n_words + 1, np.int64)
    for start, end in spans:
        turn[start] += 1
        turn[end - 1 + window] -= 1
    return np.cumsum(turn[:-1]) > 0


def result(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_runs: int = GROUP_RUNS, texts: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per row; ``texts``: with ``kept``, the text that is left."""
    keyed = _keyed(docs)
    kind = docs.schema["doc_id"].dataType
    doc_type = to_arrow_type(kind)
    found = _repeats(keyed, window, prefix, group_runs).groupBy(F.col("doc_id").alias("d"), F.col("print").alias("p")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                spans = spans.as_py()
                gone = covered(len(words), [(s["start"], s["end"]) for s in spans], window) if spans else None
                kept = b" ".join(words if gone is None else [w for w, x in zip(words, gone.tolist()) if not x])
                rows.append((len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[: len(names) - 1]], names)

    both = keyed.join(found, (F.col("doc_id") == F.col("d")) & (F.col("print") == F.col("p")), "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
