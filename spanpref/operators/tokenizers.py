"""Tokenizers (U2): texts in, flat arrays of ids and character offsets out.

A tokenizer is any object with

* ``encode(texts, special=True) -> Tokens``: all texts of an Arrow batch at once;
  ``starts``/``ends`` are ``None`` if it has no offset map;
* ``encode_ids(texts, special=True) -> Tokens``, if it has one: the same ids, quicker without offsets;
* ``tail(text, n)``: the text of the last ``n`` tokens (K1).

Jobs take a name of ``TOKENIZERS`` or a factory; a worker calls the factory once
(:mod:`spanpref.operators.workers`).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from typing import NamedTuple, Protocol

import numpy as np

BOS = 1


class Tokens(NamedTuple):
    """Ids of several texts end to end; text ``i`` has those from ``first[i]`` to ``first[i + 1]``."""

    ids: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None
    first: np.ndarray

    def of(self, i: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        a, b = int(self.first[i]), int(self.first[i + 1])
        b = b if limit is None else min(b, a + limit)
        return self.ids[a:b], None if self.starts is None else self.starts[a:b], None if self.ends is None else self.ends[a:b]


class Tokenizer(Protocol):
    def encode(self, texts: list[str], special: bool = True) -> Tokens: ...

    def tail(self, text: str, n: int) -> str: ...


TokenizerFactory = Callable[[], Tokenizer]


def _first(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


class CharTokenizer:
    """One token a character (its code point); the beginning of the text is a token at (0, 0)."""

    def __init__(self, bos_id: int = BOS):
        self.bos_id = bos_id

    def encode(self, texts: list[str], special: bool = True) -> Tokens:
        head = int(special)
        first = _first([len(t) + head for t in texts])
        ids = np.empty(int(first[-1]), np.int32)
        starts, ends = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
        for t, a, b in zip(texts, first.tolist(), first[1:].tolist()):
            ids[a : a + head] = self.bos_id
            ids[a + head : b] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<i4")
            starts[a + head : b] = np.arange(len(t))
            ends[a + head : b] = np.arange(1, len(t) + 1)
        return Tokens(ids, starts, ends, first)

    def tail(self, text: str, n: int) -> str:
        return text[-n:] if n else ""


class PieceTokenizer:
    """Pieces found by a pattern; the beginning of the text is a token at (0, 0)."""

    def __init__(self, pattern: str, number: Callable[[str], int], bos_id: int = BOS):
        self.pattern, self.number, self.bos_id = re.compile(pattern), number, bos_id
        self.known: dict[str, int] = {}

    def _id(self, piece: str) -> int:
        if len(self.known) > 200_000:
            self.known.clear()
        if piece not in self.known:
            self.known[piece] = self.number(piece)
        return self.known[piece]

    def encode(self, texts: list[str], special: bool = True) -> Tokens:
        ids, starts, ends, sizes = [], [], [], []
        for text in texts:
            before = len(ids)
            if special:
                ids.append(self.bos_id)
                starts.append(0)
                ends.append(0)
            for m in self.pattern.finditer(text):
                ids.append(self._id(m.group()))
                starts.append(m.start())
                ends.append(m.end())
            sizes.append(len(ids) - before)
        return Tokens(np.array(ids, np.int32), np.array(starts, np.int32), np.array(ends, np.int32), _first(sizes))

    def encode_ids(self, texts: list[str], special: bool = True) -> Tokens:
        """:meth:`encode` without offsets: the pattern's pieces come as one list, each piece's id from the table."""
        ids, sizes = [], []
        for text in texts:
            pieces = [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)
            if special:
                ids.append(self.bos_id)
            try:
                ids += map(self.known.__getitem__, pieces)
            except KeyError:
                del ids[sum(sizes) + special :]
                ids += [self._id(piece) for piece in pieces]
            sizes.append(len(pieces) + special)
        return Tokens(np.array(ids, np.int32), None, None, _first(sizes))

    def tail(self, text: str, n: int) -> str:
        if 2 * len(text) < n:  # as many pieces and empty ones at most
            return text
        starts = [m.start() for m in self.pattern.finditer(text)]
        return text if len(starts) <= n else text[starts[-n] :] if n else ""


def regex_tokenizer() -> PieceTokenizer:
    """Words and punctuation with stable ids below 50,000 (crc32)."""
    return PieceTokenizer(r"\w+|[^\w\s]", lambda piece: 3 + zlib.crc32(piece.encode()) % 49_997)


def word_tokenizer() -> PieceTokenizer:
    """Runs of ASCII letters and digits, any other character but ASCII space alone; ids are 28 bits of md5."""
    return PieceTokenizer(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]", lambda piece: int(hashlib.md5(piece.encode()).hexdigest()[:7], 16))


class LibraryTokenizer:
    """A tokenizer file of the ``tokenizers`` library; with ``offsets=False`` as one without an offset map."""

    def __init__(self, path: str, offsets: bool = True):
        from tokenizers import Tokenizer as Library

        self.library, self.offsets = Library.from_file(path), offsets

    def encode(self, texts: list[str], special: bool = True) -> Tokens:
        found = self.library.encode_batch(texts, add_special_tokens=special)
        first = _first([len(e.ids) for e in found])
        ids = np.fromiter((i for e in found for i in e.ids), np.int32, int(first[-1]))
        if not self.offsets:
            return Tokens(ids, None, None, first)
        places = np.fromiter((x for e in found for o in e.offsets for x in o), np.int32, 2 * int(first[-1]))
        return Tokens(ids, places[0::2], places[1::2], first)

    def tail(self, text: str, n: int) -> str:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return text if len(ids) <= n else self.library.decode(ids[-n:], skip_special_tokens=False) if n else ""


TOKENIZERS: dict[str, TokenizerFactory] = {"char": CharTokenizer, "regex": regex_tokenizer, "word": word_tokenizer}


def factory_of(tokenizer: str | TokenizerFactory) -> TokenizerFactory:
    return TOKENIZERS[tokenizer] if isinstance(tokenizer, str) else tokenizer
