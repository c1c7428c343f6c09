"""Operator 4: benchmark decontamination by q-gram lemma filtering.

A passage of ``m`` characters that occurs with at most ``k`` edits shares at
least ``m + 1 - q * (k + 1)`` of its q-grams with the place where it occurs, all
on neighbouring diagonals (text position minus passage position). Hits are
counted in diagonal bands ``2k + 1`` wide that overlap by half and more, so every
occurrence lies whole in one band. Within a band, hits must reach the bound
inside one stretch of text as long as the passage may be; each such band is
verified by itself, by an alignment that keeps to its ``2k + 1`` diagonals (edit distance
of the whole passage against the best piece of the text there). What bands find is
merged: the best occurrence first, then those apart from it.

Passages are the benchmark's items: whole texts, lower-cased, white space runs
as one space. Of items over ``PART_WORDS`` words, every part of that many words
from each ``PART_STEP``-th word on (and the last one) is a passage too, with its own
budget, so a quote of ``PART_WORDS + PART_STEP - 1`` words always holds one. Parts
use the item's own q-grams, and those found in a row give one match: the item, the
region and its edits against that stretch of the item. A part in an occurrence of
the whole item gives none. Documents are treated likewise and scanned whole. The benchmark
is the query set: it is broadcast in blocks of at most ``BLOCK_CHARS``
characters, one after the other: what a block finds (or leaves) is written to the
shared folder and its broadcast destroyed before the next but one is read, so what is
held has a fixed bound, and every document meets every block. Scanning is narrow: no shuffle.

Defined results: null and empty texts hold no passage and are none; items of the
same text each give their rows; items too short for the lemma (bound under
one) are found by an unchanged piece, aligned with their budget, as whole words; of
equally good occurrences that share more than their edits the first counts; repeated
rows are matched each; extra columns take no part; empty tables give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanpref.llm.common import doc_texts, held_once, slices, staged

Q, EDIT_SHARE = 8, 0.08
PART_WORDS, PART_STEP = 25, 12
#: Characters of the benchmark that are broadcast and matched at a time.
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 23
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(r"\s+")
_ODD_SPACE = re.compile(r"[^\S ]")


def normal(text: str) -> tuple[str, np.ndarray | None]:
    """Lower-cased text with runs of white space as one space, and each character's place in the original (None: the same)."""
    low = "".join([c if len(c) == 1 else x for x, c in zip(text, map(str.lower, text))]) if len(text.lower()) != len(text) else text.lower()
    flat = low.replace("\n", " ")
    if "  " not in flat and not _ODD_SPACE.search(flat):
        return flat, None
    parts, places, at = [], [], 0
    for m in _SPACE.finditer(low):
        parts += [low[at : m.start()], " "]
        places.append(np.arange(at, m.start() + 1))
        at = m.end()
    parts.append(low[at:])
    places.append(np.arange(at, len(low)))
    return "".join(parts), np.concatenate(places)


def grams(text: str, q: int = Q) -> np.ndarray:
    """A 64-bit code of every q-gram; equal grams have equal codes (others seldom, and alignment verifies)."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q == 8:
        packed = (codes & 0xFF).astype(np.uint8)
        return np.ndarray((n,), "<u8", packed.tobytes(), 0, (1,)).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = (out * _MIX) + codes[i : i + n]
    return out


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def align(passage: np.ndarray, text: np.ndarray, first: int, budget: int) -> tuple[int, int, int] | None:
    """``(edits, start, end)`` of the best piece of ``text`` whose alignment stays on the diagonals ``first`` to
    ``first + 2 * budget`` (text position minus passage position); None if it takes more edits than the budget.

    Rows run over the passage and hold ``2 * budget + 1`` cells, one a diagonal. A cell is
    edits * 2^32 + start, so the smallest value also names where the piece begins; of
    equally good pieces the one that ends first counts.
    """
    width, m, n = 2 * budget + 1, len(passage), len(text)
    one = np.int64(1) << 32
    beyond = np.int64(budget + 1) << 32
    span = np.full(m + width, 0xFFFFFFFF, np.uint32)  # no character
    low, high = max(0, first), min(n, first + m + width)
    if high > low:
        span[low - first : high - first] = text[low:high]
    climb = np.arange(width, dtype=np.int64) * one
    place = first + np.arange(width, dtype=np.int64)
    row = np.where((place >= 0) & (place <= n), np.maximum(place, 0), beyond)
    for i in range(m):
        now = row + (span[i : i + width] != passage[i]) * one
        np.minimum(now[:-1], row[1:] + one, out=now[:-1])
        now = np.minimum.accumulate(now - climb) + climb
        if first + i + width > n:
            now[max(0, n - first - i) :] = beyond
        if now.min() >= beyond:
            return None
        row = now
    edits = row >> 32
    best = int(edits.min())
    if best > budget:
        return None
    at = int(np.flatnonzero(edits == best)[0])
    return best, int(row[at] & (one - 1)), first + m + at


def apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, edits)`` of different occurrences: the best first, then those that share no more with one of them than its or their edits.

    Edits at the border of two occurrences may have taken a neighbour's characters. Of equally good ones the first counts.
    """
    starts: list[int] = []
    out: list[tuple[int, int, int]] = []
    for hit in sorted(set(hits), key=lambda h: (h[2], h[0], h[1])):
        at = bisect(starts, hit[0])
        if all(min(hit[1], x[1]) - max(hit[0], x[0]) <= max(hit[2], x[2]) for x in out[max(0, at - 1) : at + 1]):
            starts.insert(at, hit[0])
            out.insert(at, hit)
    return out


class Flat:
    """A text (or passage) as characters and, once they are needed, as codes."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def codes(self) -> np.ndarray:
        return codes_of(self.text)

    def piece(self, a: int, b: int) -> "Flat":
        out = Flat(self.text[a:b])
        out.codes = self.codes[a:b]
        return out


def verified(passage: Flat, flat: Flat, diagonals: list[int], budget: int) -> list[tuple[int, int, int]]:
    """Occurrences on the bands that begin at these diagonals, each aligned by itself.

    An unchanged passage on a band is the band's best piece. A band that holds the start of one
    found before has nothing better, and what else it holds isn't apart from that one.
    """
    m, hits, exact = len(passage.text), [], None  # no place: bands may begin before the text
    for first in sorted(set(diagonals)):
        if exact is not None and first <= exact <= first + 2 * budget:
            continue
        at = flat.text.find(passage.text, max(0, first), max(0, first + 2 * budget + m))
        if at >= 0:
            exact = at
            hits.append((at, at + m, 0))
        elif hit := align(passage.codes, flat.codes, first, budget):
            hits.append((hit[1], hit[2], hit[0]))
    return apart(hits)


def short_occurrences(passage: str, flat: str, budget: int) -> list[tuple[int, int, int]]:
    """Occurrences, as whole words, of a passage too short for the lemma: of ``budget + 1`` pieces of it one is unchanged."""
    if not budget:
        return [(m.start(), m.end(), 0) for m in re.finditer(rf"(?<!\w){re.escape(passage)}(?!\w)", flat)]
    m, diagonals = len(passage), []
    cuts = [m * j // (budget + 1) for j in range(budget + 2)]
    for a, b in zip(cuts, cuts[1:]):
        at = flat.find(passage[a:b])
        while at >= 0:
            diagonals.append(at - a - budget)
            at = flat.find(passage[a:b], at + 1)
    if not diagonals:
        return []
    edge = re.compile(r"\w")
    hits = verified(Flat(passage), Flat(flat), diagonals, budget)
    return [(s, e, k) for s, e, k in hits if not (s and edge.match(flat[s - 1]) and edge.match(flat[s])) and not (e < len(flat) and edge.match(flat[e]) and edge.match(flat[e - 1]))]


def parts_of(passage: str) -> list[tuple[int, int]]:
    """Places of a passage's overlapping parts of ``PART_WORDS`` words; none if it has no more words."""
    words = [m.span() for m in re.finditer(r"\S+", passage)]
    last = len(words) - PART_WORDS
    return [(words[i][0], words[i + PART_WORDS - 1][1]) for i in sorted({*range(0, last, PART_STEP), last})] if last > 0 else []


class Index:
    """Q-grams of one block of passages."""

    def __init__(self, items: list[tuple], q: int = Q, edit_share: float = EDIT_SHARE):
        self.q, self.items = q, []
        codes, whose, where = [], [], []
        self.short: list[tuple] = []
        self.least: list[int] = []
        for item_id, text in items:
            passage = normal(text)[0].strip()
            if not passage:
                continue
            budget = int(len(passage) * edit_share)
            need = len(passage) + 1 - q * (budget + 1)
            if need < 1:
                self.short.append((item_id, passage, budget))
                continue
            g = grams(passage, q)
            codes.append(g)
            whose.append(np.full(len(g), len(self.items)))
            where.append(np.arange(len(g)))
            parts = [(a, b, int((b - a) * edit_share)) for a, b in parts_of(passage)]
            parts = [(a, b, k, b - a + 1 - q * (k + 1)) for a, b, k in parts]
            parts = np.array([p for p in parts if p[3] > 0], np.int64).reshape(-1, 4)
            self.items.append((item_id, Flat(passage), budget, need, parts))
            self.least.append(min([need, *parts[:, 3].tolist()]))
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, first, self.size = np.unique(code[order], return_index=True, return_counts=True)
        self.first = first
        self.whose = np.concatenate(whose)[order] if codes else np.empty(0, np.int64)
        self.where = np.concatenate(where)[order] if codes else np.empty(0, np.int64)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * _MIX) >> np.uint64(64 - _FILTER_BITS)

    def find(self, text: str, first: bool = False) -> list[tuple]:
        """``(item_id, start, end, edits)`` of all passages in a text, places in the original text; ``first``: of one item at least, if there is any."""
        flat, places = normal(text)
        out = []
        for item_id, passage, budget in self.short:
            out += [(item_id, *hit) for hit in short_occurrences(passage, flat, budget)]
            if first and out:
                break
        if len(self.code) and not (first and out):
            g = grams(flat, self.q)
            spot = np.flatnonzero(self.seen[self._slot(g)])
            if len(spot):
                at = np.minimum(np.searchsorted(self.code, g[spot]), len(self.code) - 1)
                same = self.code[at] == g[spot]
                for item_id, hits in self._regions(flat, spot[same], at[same]):
                    out += [(item_id, *hit) for hit in hits]
                    if first and out:
                        break
        if places is not None:
            out = [(i, int(places[s]), int(places[e - 1]) + 1, k) for i, s, e, k in out]
        return out

    def _regions(self, flat: str, spot: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """``(item_id, hits)`` of the items these q-grams belong to; no step looks at an item without any."""
        size = self.size[at]
        if int(size.sum()) < min(self.least):
            return
        spread = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pos, item, where = np.repeat(spot, size), self.whose[spread], self.where[spread]
        order = np.argsort(item, kind="stable")  # by item, and by text position in each
        pos, item, where = pos[order], item[order], where[order]
        begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])).tolist()
        text = Flat(flat)
        for low, high in zip(begins, [*begins[1:], len(item)]):
            i = int(item[low])
            if high - low < self.least[i]:
                continue
            item_id, passage, budget, need, parts = self.items[i]
            p, w = pos[low:high], where[low:high]
            whole = self._bands(text, passage, budget, need, p, p - w)
            pieces = []
            if len(parts):
                on = np.sort(w)
                inside = np.searchsorted(on, parts[:, 1] - self.q, "right") - np.searchsorted(on, parts[:, 0])
                for a, b, k, least in parts[inside >= parts[:, 3]].tolist():
                    own = (w >= a) & (w <= b - self.q)
                    pieces += [(*hit, a, b) for hit in self._bands(text, passage.piece(a, b), k, least, p[own], p[own] - w[own] + a)]
                covers = [(s, e) for s, e, _ in whole]
                pieces = [x for x in pieces if not _mostly_in(x, covers)]
            hits = whole + self._joined(text, passage, pieces)
            if hits:
                yield item_id, hits

    @staticmethod
    def _joined(text: Flat, passage: Flat, pieces: list[tuple]) -> list[tuple]:
        """``(start, end, edits)`` of parts found, those that follow each other in text and passage as one."""
        rows: list[list[tuple]] = []
        for x in sorted(pieces, key=lambda x: (x[0], x[3])):
            # rows that ended before this part can take no other: parts come by their start
            row = next((r for r in reversed(rows[-len(pieces) :]) if x[0] <= r[-1][1] + 1 and x[3] > r[-1][3] and abs((x[0] - x[3]) - (r[-1][0] - r[-1][3])) <= x[2] + r[-1][2]), None)
            if row is None:
                rows.append([x])
            else:
                row.append(x)
        out = []
        for row in rows:
            low, high, budget = row[0][0], max(x[1] for x in row), sum(x[2] for x in row)
            hit = align(passage.codes[row[0][3] : row[-1][4]], text.codes[:high], low - budget, budget) if len(row) > 1 else (row[0][2], low, high)
            out += [(hit[1], hit[2], hit[0])] if hit else [x[:3] for x in row]
        return out

    @staticmethod
    def _bands(text: Flat, passage: Flat, budget: int, need: int, pos: np.ndarray, diagonal: np.ndarray) -> list[tuple]:
        """Occurrences on the bands whose hits reach the bound within a stretch as long as the passage may be."""
        if len(pos) < need:
            return []
        m = len(passage.text)
        width, reach = 2 * budget + 1, m + budget
        bands = []
        for shift in (0, budget):  # every run of budget + 1 diagonals lies in a band of one of the two rows of bands
            band = (diagonal + m + shift) // width
            if int(np.bincount(band).max()) < need:
                continue
            order = np.lexsort((pos, band))
            b, p = band[order], pos[order]
            last = np.arange(need - 1, len(p))
            dense = (b[last] == b[last - need + 1]) & (p[last] - p[last - need + 1] <= reach)
            bands += [x * width - m - shift for x in np.unique(b[last[dense]]).tolist()]
        return verified(passage, text, bands, budget) if bands else []


def _mostly_in(piece: tuple, covers: list[tuple[int, int]]) -> bool:
    """Whether more than half of a part's place lies in one of the sorted occurrences."""
    at = bisect(covers, (piece[0], piece[1]))
    return any(min(piece[1], e) - max(piece[0], s) > (piece[1] - piece[0]) // 2 for s, e in covers[max(0, at - 2) : at + 2])


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The benchmark's ``(item_id, text)`` in blocks of at most ``size`` characters (one item at least)."""
    block, held = [], 0
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    for row in rows.toLocalIterator():
        if block and held + len(row["text"]) > size:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
    if block:
        yield block


def _with_last(items: Iterator) -> Iterator[tuple]:
    """Each item and whether it is the last."""
    for item in items:
        following = next(items, None)
        while following is not None:
            yield item, False
            item, following = following, next(items, None)
        yield item, True


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: every passage in every document, in code points, end exclusive."""
    spark = docs.sparkSession
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits int"
    out = None
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for block, last in _with_last(blocks(benchmark)):
        held = spark.sparkContext.broadcast(block)
        part = doc_texts(docs).mapInArrow(_finder(held, q, edit_share, item_type), schema)
        if not last:
            part = staged(part, "decontaminate-block")
            held.destroy()
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _finder(held, q: int, edit_share: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_once("decontaminate")
        index = Index(held.value, q, edit_share)
        for batch in slices(batches):
            rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in index.find(t.as_py())]
            if rows:
                doc, item, start, end, edits = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, batch.schema.field(0).type), pa.array(item, item_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())],
                    ["doc_id", "item_id", "start", "end", "edits"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; all columns as they came."""
    out = docs
    for block, last in _with_last(blocks(benchmark)):
        held = docs.sparkSession.sparkContext.broadcast(block)
        out = out.where(~_flag(held, q, edit_share)(F.coalesce(out["text"], F.lit(""))))
        if not last:
            out = staged(out, "decontaminate-block")
            held.destroy()
    return out


def _flag(held, q: int, edit_share: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held_once("decontaminate")
        index = Index(held.value, q, edit_share)
        for texts in batches:
            yield pd.Series([bool(index.find(t, first=True)) for t in texts], dtype=bool)

    return holds
