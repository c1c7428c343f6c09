"""Operator 3: token ids in compressed files, by a static range asymmetric numeral system (rANS).

Writing: texts become ids (word BPE), a frequency table over all ids of the
corpus is built once and shared by every block, and documents go by range of
doc_id into shards of ascending blocks. A block is coded on its own: ``LANES``
interleaved 64-bit coder states over one stream of 32-bit words, with
checkpoints (stream position and all states) every ``CHECKPOINT`` steps, so a
reader may decode the segments of a block in parallel or enter at any of them.
A block carries checksums of its stored bytes and of its ids.

File format: a folder with ``table`` (the frequencies) and ``blocks``, Parquet
files written by Spark's committer, so a lost executor's attempt leaves nothing
behind and any file system Spark knows will do. A row of ``blocks``: shard,
block, first (ids before it in its shard), n_ids, doc_ids, lengths, payload.

Reading: shard totals (one row a shard) give every block's place; blocks decode
independently.

Defined results: null text counts as empty; an empty text is its end id alone;
equal or null doc_ids keep their own rows (nulls first, equal ids in the order
of a hash of their token ids); an empty table gives no blocks and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanpref.llm.common import Memo, doc_texts, held_once, scratch_path, slices, staged

END_ID = 2
#: Words a worker remembers; changes speed only.
WORD_LIMIT = 900_000
LANES, CHECKPOINT, BLOCK_IDS = 2048, 128, 1 << 20
SCALE_BITS = 22
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


# ---- ids

#: Letters of Latin-1 in UTF-8, A-Z lowered before.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Such letters and then ASCII marks, apostrophes apart.
MARKED = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]+)")


def _byte_char(b: int) -> int:
    """Byte-level BPE writes the bytes 7F to A0 as the characters from U+0121 on, AD as U+0143, other letters' as in Latin-1."""
    return b + 0x121 - 0x7F if 0x7F <= b <= 0xA0 else 0x143 if b == 0xAD else b


#: Second bytes of Latin-1's letters as characters, capitals (80 to 9E) lowered.
BYTE_CHARS = {b: _byte_char(b + 0x20 if b < 0x9F else b) for b in range(0x80, 0xC0)}


class Words:
    """Ids of whole texts with the tokenizers library, word by word.

    The file's normaliser and splitter treat white space as a border and drop
    it, so a text's ids are those of its white-space words in a row. Marks after
    letters are a piece of their own, so such a word's ids are those
    of the letters and of the marks. A word of Latin-1's letters alone (they are
    composed already) is one piece that normalisation only lowers: it goes to the
    library's model directly, its bytes as the characters the file has for them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.memo = Memo(self._one, WORD_LIMIT)

    def _one(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # of bytes: ASCII letters only
            ids = [t.id for t in self.model.tokenize(word.decode())]
        elif PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_CHARS))]
        elif found := MARKED.fullmatch(word):
            return self.memo[found[1]] + self.memo[found[2]]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        ``bytes`` split and lower at ASCII only. Lowering beforehand could change
        what a combining mark (lead bytes CC, CD) composes with, so not with those.
        """
        data = text.encode()
        low = data.lower()
        if any(x in low for x in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words_ = (data if b"\xcc" in data or b"\xcd" in data else low).split()
        return b"".join(map(self.memo.__getitem__, words_))


def words(path: str) -> Words:
    return held_once(("words", path), lambda: Words(path))


def token_ids(docs: DataFrame, path: str, end_id: int = END_ID, width: str = "<u4") -> DataFrame:
    """``(doc_id, n long, ids binary)``: little-endian ids of type ``width`` with the end id."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        for batch in slices(batches):
            ids = [np.frombuffer(w.encode(t.as_py()) + tail, "<u4").astype(width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_texts(docs).mapInArrow(run, f"doc_id {kind}, n long, ids binary")


# ---- the coder


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to ``2 ** bits``, one at least for every id of the alphabet."""
    total = 1 << bits
    if len(counts) > total // 2:
        raise ValueError("alphabet too large for the scale")
    free = total - len(counts)
    share = counts.astype(np.float64) / max(1, counts.sum()) * free
    freq = share.astype(np.int64) + 1
    freq[int(counts.argmax()) if counts.any() else 0] += total - int(freq.sum())
    return freq.astype(np.uint32)


class Coder:
    """rANS with one frequency table for all blocks."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.mask = np.uint64((1 << bits) - 1)

    @property
    def symbol(self) -> np.ndarray:
        if not hasattr(self, "_symbol"):
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, ids: np.ndarray) -> bytes:
        """Payload of one block: id ``t`` is coded by lane ``t % LANES`` at step ``t // LANES``."""
        n = len(ids)
        steps = -(-n // LANES)
        state = np.full(LANES, _LOW, np.uint64)
        out, marks, written = [], [], 0
        for step in range(steps - 1, -1, -1):
            sym = ids[step * LANES : (step + 1) * LANES]
            x = state[: len(sym)]
            f = self.freq[sym]
            full = x >= self.limit[sym]
            if full.any():
                out.append(x[full].astype(np.uint32))
                written += len(out[-1])
                x = np.where(full, x >> _WORD, x)
            q = x // f
            state[: len(sym)] = (q << self.bits) + (x - q * f) + self.start[sym]
            if step % CHECKPOINT == 0:
                marks.append((step, written, state.copy()))
        words_ = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
        marks.reverse()
        head = np.array([n, len(words_), len(marks)], "<u8").tobytes()
        body = b"".join(np.array([step, len(words_) - at], "<u8").tobytes() + s.astype("<u8").tobytes() for step, at, s in marks)
        body = head + body + words_.astype("<u4").tobytes()
        return np.array([zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())], "<u4").tobytes() + body

    def segments(self, payload: bytes) -> list[tuple]:
        """``(first step, steps, states, words from its place on)`` of every checkpoint; raises on damaged bytes."""
        stored, _ = np.frombuffer(payload, "<u4", 2)
        body = memoryview(payload)[8:]
        if zlib.crc32(body) != stored:
            raise ValueError("block checksum differs")
        n, n_words, n_marks = (int(v) for v in np.frombuffer(body, "<u8", 3))
        words_ = np.frombuffer(body, "<u4", n_words, len(body) - 4 * n_words)
        size, out = 16 + 8 * LANES, []
        for k in range(n_marks):
            step, at = (int(v) for v in np.frombuffer(body, "<u8", 2, 24 + k * size))
            out.append((step, min(n, (step + CHECKPOINT) * LANES) - step * LANES, np.frombuffer(body, "<u8", LANES, 24 + k * size + 16), words_[at:]))
        return out

    def decode_segment(self, segment: tuple) -> np.ndarray:
        """The ids of one checkpoint's steps, without the blocks before it."""
        _, n, state, words_ = segment
        state, at, out = state.copy(), 0, np.empty(n, np.uint32)
        for first in range(0, n, LANES):
            x = state[: min(LANES, n - first)]
            slot = x & self.mask
            sym = self.symbol[slot]
            out[first : first + len(x)] = sym
            x = self.freq[sym] * (x >> self.bits) + slot - self.start[sym]
            low = x < _LOW
            k = int(np.count_nonzero(low))
            if k:
                x[low] = (x[low] << _WORD) | words_[at : at + k]
                at += k
            state[: len(x)] = x
        return out

    def decode(self, payload: bytes) -> np.ndarray:
        parts = [self.decode_segment(s) for s in self.segments(payload)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != int(np.frombuffer(payload, "<u4", 2)[1]):
            raise ValueError("id checksum differs")
        return ids


# ---- files


def frequencies(ids: DataFrame, alphabet: int, width: str) -> np.ndarray:
    """How often each id occurs in all rows; ``alphabet`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(alphabet, np.int64)
        for batch in batches:
            for part in slices([batch]):
                found = np.frombuffer(b"".join(part.column(0).to_pylist()), width)
                counts += np.bincount(found, minlength=alphabet)  # one table a slice, not one a document
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(alphabet, np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return counts


def write_ids(docs: DataFrame, folder: str, path: str, alphabet: int, shards: int | None = None) -> None:
    """Encode ``docs`` and write them to ``folder`` in ascending doc_id order.

    ``shards``: how many ranges of doc_id; by default as many as the input has partitions.
    """
    spark = docs.sparkSession
    width = "<u2" if alphabet <= 1 << 16 else "<u4"
    ids = staged(token_ids(docs, path, width=width), "token-ids")
    freq = scaled(frequencies(ids, alphabet, width))
    spark.createDataFrame([(SCALE_BITS, freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{folder}/table")
    held = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(held.value), TaskContext.get().partitionId()
        block, first, rows, parts, size = 0, 0, [], [], 0

        def done():
            nonlocal block, first, rows, parts, size
            payload = coder.encode(np.frombuffer(b"".join(parts), width))
            columns = [[shard], [block], [first], [size], [[r for r, _ in rows]], [[n for _, n in rows]], [payload]]
            block, first, rows, parts, size = block + 1, first + size, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        names = ["shard", "block", "first", "n_ids", "doc_ids", "lengths", "payload"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            for doc, x in zip(batch.column(0), batch.column(1)):
                data = x.as_py()
                n = len(data) // int(width[2])
                rows.append((doc.as_py(), n))
                parts.append(data)
                size += n
                if size >= BLOCK_IDS:
                    yield done()
        if rows:
            yield done()

    kind = docs.schema["doc_id"].dataType.simpleString()
    n = shards or max(1, ids.rdd.getNumPartitions())
    ordered = ids.select("doc_id", "ids").repartitionByRange(n, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", F.xxhash64("ids"), "ids")
    ordered.mapInArrow(run, f"shard int, block int, first long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary").write.option(
        "compression", "none"
    ).parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids binary)`` of every document in the files of ``folder``."""
    row = spark.read.parquet(f"{folder}/table").first()
    held = spark.sparkContext.broadcast((row["bits"], np.frombuffer(row["freq"], "<u4").copy()))
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, place = 0, {}
    for shard, n in totals:
        place[shard], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value[1], held.value[0])
        for batch in batches:
            for shard, first, docs, lengths, payload in zip(*(batch.column(i) for i in range(5))):
                data = memoryview(coder.decode(payload.as_py()).astype("<u4").tobytes())
                n = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(n)
                starts = place[shard.as_py()] + first.as_py() + ends - n
                ids = [bytes(data[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("shard", "first", "doc_ids", "lengths", "payload").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None, alphabet: int = 49_408) -> DataFrame:
    """Write all documents, read them back: per document its start, number of ids and their CRC-32."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_ids(docs, folder, path or default_tokenizer(), alphabet)
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
