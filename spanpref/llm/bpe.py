"""Operator 7: byte-level BPE encoding and decoding with a lazily determinised transducer.

The merge ranks are compiled into a finite-state transducer. While bytes of a
piece come in, every position where a token may still begin is a path in the
vocabulary's trie; the set of these paths, together with the last token already
emitted, is one deterministic state, built when it is first met (subset
construction on demand). All paths share the tokens up to their last common
boundary, and these are emitted at once, so the lookahead is bounded by the
longest run of bytes that can still grow into a longer token.

Which token ends at a position follows from a local rule: a sequence of tokens
is what the merges give if and only if every neighbouring pair is, so the token
ending at a position is the only one that agrees with the token before it.

Decoding joins the tokens' bytes and runs them through an incremental UTF-8
state machine, chunk by chunk, so a character cut by a chunk's end is carried.

Defined results: null text counts as empty; an empty text has no ids and
decodes to the empty text; texts of any length are taken whole, piece by piece;
repeated rows each give their row; an empty table gives no rows; other columns are
left behind; ids unknown to the vocabulary raise.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import Memo, doc_texts, held_once, slices

#: Memory bounds of a worker; they change speed only, never results.
STATE_LIMIT, PAIR_LIMIT, PIECE_LIMIT = 150_000, 300_000, 600_000
#: Trie subtrees up to this size are searched for the tokens that may still follow; larger ones count as open.
HOPE_LIMIT = 48
#: Tokens given to the UTF-8 machine at a time.
DECODE_CHUNK = 65_536
_NEVER = 1 << 60
_BYTE = [bytes([i]) for i in range(256)]


class Transducer:
    """Encodes one piece of bytes by ``ranks`` (bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], state_limit: int = STATE_LIMIT):
        self.ranks, self.state_limit = ranks, state_limit
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._step: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self._token = array("i", [-1])
        self._inner = bytearray(1)
        self._low, self._high = array("i", [0]), array("i", [0])  # of a node: the range of ``_sorted`` that begins with it
        self._sorted = [rank for _, rank in sorted(ranks.items())]
        for at, (word, rank) in enumerate(sorted(ranks.items())):
            node = 0
            for byte in word:
                self._high[node] = at + 1
                nxt = self._step.get(node * 256 + byte)
                if nxt is None:
                    nxt = self._step[node * 256 + byte] = len(self._token)
                    self._token.append(-1)
                    self._inner.append(0)
                    self._low.append(at)
                    self._high.append(at)
                self._inner[node] = 1
                node = nxt
            self._high[node] = at + 1
            self._token[node] = rank
        self._split = Memo(self._derive, len(ranks) + 1)
        self._fits = Memo(self._pair, PAIR_LIMIT)
        self._open = Memo(self._hope, PAIR_LIMIT)
        self._forget(None)

    def _merge(self, data: bytes) -> list[bytes]:
        """The merges applied one by one, lowest rank first, leftmost of equals; for single tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                self._last_two = (parts[0], parts[1])
        return parts

    def _derive(self, token: int):
        """``(left, right)`` of the merge that makes a token, ``()`` for one byte, None if the merges never make it."""
        word = self.bytes_of[token]
        if len(word) == 1:
            return ()
        self._last_two = (word[:1], word[1:]) if len(word) == 2 else None
        if len(self._merge(word)) != 1:
            return None
        left, right = (self.ranks[x] for x in self._last_two)
        if max(left, right) >= token and len(word) > 2:
            raise ValueError(f"rank {token} comes before a part of it")
        return left, right

    def _pair(self, pair: tuple[int, int]) -> bool:
        """Whether two neighbouring tokens stay as they are.

        Runs both tokens' derivations in the order of ranks and looks at the
        two parts that touch: if they merge before either grows, the pair never arises.
        """
        left, right, sides = [], [], pair
        for spine, token, end in ((left, sides[0], 1), (right, sides[1], 0)):
            while True:
                spine.append(token)
                made = self._split[token]
                if not made:
                    break
                token = made[end]
            spine.reverse()
        i = j = 0
        while True:
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], _NEVER)
            grow_l = left[i + 1] if i + 1 < len(left) else _NEVER
            grow_r = right[j + 1] if j + 1 < len(right) else _NEVER
            if across < grow_l and (across <= grow_r and across != _NEVER):
                return False
            if grow_l == grow_r == _NEVER:
                return True
            if grow_l <= grow_r:
                i += 1
            else:
                j += 1

    def _hope(self, key: tuple[int, int]) -> bytes:
        """Which longer tokens below a trie node may follow ``last``: all (``+``), none (empty) or one sign each.

        Of a large subtree the answer is ``last`` itself: it may go on, and only like ``last`` does.
        """
        last, node = key
        low, high = self._low[node], self._high[node]
        if high - low > HOPE_LIMIT:
            return b"%d" % last
        own = self._token[node]
        signs = bytes(43 if t != own and self._split[t] is not None and (last < 0 or self._pair((last, t))) else 45 for t in self._sorted[low:high])
        return b"" if b"+" not in signs else signs

    def _forget(self, keep) -> int:
        """Drop all states but ``keep``; returns its new number."""
        self._ids: dict = {}
        self._states: list = []
        self._next: list[dict] = []
        self._ends: list = []
        self._start = self._intern(-1, b"", [(0, 0)], (None,), b"-1")
        return self._intern(*keep) if keep is not None else self._start

    def _intern(self, last: int, pending: bytes, live: list, chain: tuple, outlook: bytes) -> int:
        """Number of a state. Tokens before it count only by ``outlook``: what may still begin at its first byte."""
        key = (pending, chain, outlook)
        number = self._ids.get(key)
        if number is None:
            number = self._ids[key] = len(self._states)
            self._states.append((last, pending, live, chain))
            self._next.append({})
            self._ends.append(None)
        return number

    def _advance(self, state: int, byte: int) -> tuple[int, tuple]:
        """Build the transition of ``state`` on ``byte``: (next state, tokens emitted)."""
        last, pending, live, chain = self._states[state]
        here = len(pending) + 1
        grown, signs, ends = [], [], None
        for begin, node in live:
            node = self._step.get(node * 256 + byte)
            if node is None:
                continue
            token = self._token[node]
            if ends is None and token >= 0 and self._split[token] is not None:
                before = chain[begin][1] if begin else last
                if before < 0 or self._fits[before, token]:
                    ends = (begin, token)
            if self._inner[node]:
                after = self._open[chain[begin][1] if begin else last, node]
                if after:
                    grown.append((begin, node))
                    signs.append((begin, after))
        if ends is None:
            raise ValueError("the ranks lack a single byte")
        # from the last open position back to the last boundary that all open paths share
        chain = (*chain, ends)
        tips = {here, *[b for b, _ in grown]}
        while len(tips) > 1:
            tip = max(tips)
            tips.remove(tip)
            tips.add(chain[tip][0])
        shared = at = tips.pop()
        out = ()
        while at:
            at, token = chain[at]
            out = (token, *out)
        if shared:
            chain = (None, *[(b - shared, t) if b >= shared else None for b, t in [x or (-1, 0) for x in chain[shared + 1 :]]])
            grown = [(b - shared, n) for b, n in grown]
            last = out[-1]
        if shared == here:
            outlook = b"%d" % last
        else:
            outlook = signs[0][1] if signs and signs[0][0] == shared else b""
        grown.append((here - shared, 0))
        now = (last, (pending + _BYTE[byte])[shared:], grown, chain, outlook)
        if len(self._states) >= self.state_limit:
            return self._forget(now), out
        edge = self._next[state][byte] = (self._intern(*now), out)
        return edge

    def _finish(self, state: int) -> tuple:
        _, pending, _, chain = self._states[state]
        out, at = [], len(pending)
        while at:
            at, token = chain[at]
            out.append(token)
        self._ends[state] = done = tuple(reversed(out))
        return done

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece. A piece that is itself in the vocabulary is its token."""
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = self._start, []
        for byte in piece:
            edge = self._next[state].get(byte)
            state, emitted = edge if edge is not None else self._advance(state, byte)
            if emitted:
                out.extend(emitted)
        out.extend(self._ends[state] or self._finish(state))
        return out


class Codec:
    """Whole texts to ids and back, for one vocabulary file and split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).findall
        self.memo = Memo(lambda piece: np.array(self.transducer.encode(piece.encode()), "<i4").tobytes(), PIECE_LIMIT)
        self.table = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.table[rank] = word

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.ranks)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def decode(self, ids: list[int]) -> str:
        machine, table = codecs.getincrementaldecoder("utf-8")("strict"), self.table
        text = [machine.decode(b"".join([table[i] for i in ids[at : at + DECODE_CHUNK]])) for at in range(0, len(ids), DECODE_CHUNK)]
        return "".join(text) + machine.decode(b"", final=True)


def codec(path: str, pattern: str) -> Codec:
    return held_once(("bpe", path, pattern), lambda: Codec(path, pattern))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids in one batch")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>)`` per row of ``docs``. Narrow: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            parts = [c.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_texts(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, text)``: the ids of ``encode_documents`` with their decoded text. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            texts = [c.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids, text)``: ids of every text, and the text decoded from them, in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches):
            parts = [c.encode(t.as_py()) for t in batch.column(1)]
            texts = [c.decode(np.frombuffer(x, "<i4").tolist()) for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(parts), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_texts(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids as text and of the decoded bytes."""
    own_path, own_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or own_path, pattern or own_pattern
    done = round_trip(docs, path, pattern)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
