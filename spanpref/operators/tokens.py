"""Token table for preference training.

The reference builds these tensors inside its training collator; here they are
one offline Spark job that writes a training-ready table, one row per pair
with eight arrays (``{chosen,rejected}_{input_ids,attention_mask,labels,weights}``).

Tokenizers are pluggable (:mod:`spanpref.operators.tokenizers`).  Token work runs in
one Arrow pass over the pairs (:func:`token_sides`): a batch's texts are encoded
together, ids, labels and weights are flat arrays, and a row's work is linear in
its tokens and targets.  Padding needs each batch's longest row first; that comes
from narrow rows of lengths, so token arrays are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from spanpref.functions.jsonish import CODE_VALUE, SPAN_VALUE, SUBCODE_VALUE
from spanpref.lineage import staged
from spanpref.operators.numbering import number_rows
from spanpref.operators.tokenizers import Tokenizer, TokenizerFactory, Tokens, factory_of
from spanpref.operators.workers import held, new_key

IGNORE = -100
SIDES = ("chosen", "rejected")
PADDED = ("input_ids", "attention_mask", "labels", "weights")


@dataclass
class TokenParams:
    """Mirrors the training configuration (lengths, weights, batch size)."""

    max_length: int = 8192
    max_prompt_length: int = 8192
    weight_code_value: float = 1.1
    weight_subcode_value: float = 1.2
    weight_span_value: float = 1.1
    weight_diff_tokens: float = 1.2
    batch_size: int = 1
    system_prompt: str = "You are a helpful assistant."
    template: str = "<|system|>\n{system}\n<|user|>\n{prompt}\n<|assistant|>\n{answer}\n<|end|>"
    bos_id: int = 1
    pad_id: int = 2


def require_columns(df: DataFrame, needed=("prompt", "chosen", "rejected"), name: str = "train") -> None:
    """Fail before any action when a required column is missing."""
    missing = set(needed) - set(df.columns)
    if missing:
        raise ValueError(f"{name} dataset missing columns: {sorted(missing)}")


# ---------------------------------------------------------------- one row
def full_text(prompt: str, answer: str, p: TokenParams) -> str:
    """K2: render system + user + assistant turns with the template."""
    parts = re.split(r"(\{system\}|\{prompt\}|\{answer\})", p.template)
    values = {"{system}": p.system_prompt, "{prompt}": prompt, "{answer}": answer}
    return "".join(values.get(x, x) for x in parts)


_VALUES = tuple(re.compile(x) for x in (CODE_VALUE, SUBCODE_VALUE, SPAN_VALUE))


def values_by_weight(answer: str, p: TokenParams) -> dict[float, list[str]]:
    """The different Code, Sub-code and Span values of an answer, by their weight."""
    out: dict[float, dict[str, None]] = {}
    for pattern, weight in zip(_VALUES, (p.weight_code_value, p.weight_subcode_value, p.weight_span_value)):
        out.setdefault(weight, {}).update(dict.fromkeys(pattern.findall(answer)))
    return {weight: list(values) for weight, values in out.items()}


def places_of(value: str, text: str) -> list[int]:
    """Every place of ``value`` in ``text``, overlapping ones too."""
    out, at = [], text.find(value)
    while at >= 0:
        out.append(at)
        at = text.find(value, at + 1)
    return out


def joined_runs(low: list[int], high: list[int]) -> list[list[int]]:
    """The half-open runs, joined where they meet or overlap: no place is in two of them."""
    out: list[list[int]] = []
    for a, b in sorted(zip(low, high)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def value_weights(weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, answer: str, base: int, p: TokenParams) -> None:
    """Raise the weights of tokens that overlap a value of the answer to the value's weight.

    The tokens that overlap a value's place are one run, found by bisection; runs of one
    weight are joined first, so a weight meets a token once.  Tokens at (0, 0) belong to
    no text.
    """
    real = np.flatnonzero((starts != 0) | (ends != 0))
    begins, stops = starts[real], ends[real]
    for weight, values in values_by_weight(answer, p).items():
        runs = [(base + at, base + at + len(v)) for v in values for at in places_of(v, answer)]
        if runs:
            s, e = np.array(runs, np.int64).T
            for low, high in joined_runs(np.searchsorted(stops, s, "right").tolist(), np.searchsorted(begins, e, "left").tolist()):
                hit = real[low:high]
                weights[hit] = np.maximum(weights[hit], weight)


def first_run(ids: bytes, needle: bytes, start: int = 0) -> int:
    """The first place from ``start`` on where the ids of ``needle`` stand in a row (both as 32-bit bytes); -1 if nowhere."""
    at = ids.find(needle, 4 * start) if needle else -1
    while at % 4 and at >= 0:
        at = ids.find(needle, at + 1)
    return at // 4 if at >= 0 else -1


class Side:
    """K3-K8 of one answer: ids, labels, weights and the answer's start.

    The start is a character; without offsets a token, the ``head`` special ones before the text not counted.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None, text: str, answer: str, tok: Tokenizer, p: TokenParams, head: int = 0):
        self.ids, self.n = ids, len(ids)
        n = self.n
        if starts is not None:
            self.start = text.rfind(answer)
            open_ = np.flatnonzero(starts >= self.start) if self.start >= 0 else np.arange(0)
        else:
            flat = ids.astype("<i4").tobytes()
            at = first_run(flat, _ids([answer], tok, False).ids.astype("<i4").tobytes())
            self.start = at - head if at >= 0 else -1
            open_ = np.arange(at if at >= 0 else n, n)
        self.m = int(open_[0]) if len(open_) else n
        self.supervised = len(open_)
        if self.supervised == n - self.m:
            open_ = slice(self.m, n)
        self.labels, self.weights = np.full(n, IGNORE, ids.dtype), np.zeros(n)
        self.labels[open_], self.weights[open_] = ids[open_], 1.0
        if not self.supervised:
            return
        if starts is not None:
            tail = slice(self.m, n)  # prompts are long
            value_weights(self.weights[tail], starts[tail], ends[tail], answer, self.start, p)
        else:
            for weight, values in values_by_weight(answer, p).items():
                found = _ids(values, tok, False)
                for k in range(len(values)):
                    needle = found.of(k)[0]
                    at = first_run(flat, needle.astype("<i4").tobytes(), self.m)
                    if at >= 0:
                        self.weights[at : at + len(needle)] = np.maximum(self.weights[at : at + len(needle)], weight)
        if self.supervised < n - self.m:
            raised, self.weights = self.weights, np.zeros(n)
            self.weights[open_] = raised[open_]

    def array(self, name: str) -> np.ndarray:
        """``ids``, ``labels`` or ``weights``, or one of the latter from the first supervised token on."""
        return getattr(self, name[5:])[self.m :] if name.startswith("tail_") else getattr(self, name)


def weigh_differences(c: Side, r: Side, factor: float) -> None:
    """From each answer's first token on, side by side; where the ids differ both weigh more."""
    if not factor or factor <= 1.0:
        return
    n = min(c.supervised, r.supervised)
    a, b = slice(c.m, c.m + n), slice(r.m, r.m + n)
    unlike = (c.ids[a] != r.ids[b]) & (c.labels[a] != IGNORE) & (r.labels[b] != IGNORE)
    for side, at in ((c, a), (r, b)):
        side.weights[at] = np.where(unlike, side.weights[at] * factor, side.weights[at])


# ---------------------------------------------------------------- the Arrow pass
def _texts(batch: pa.RecordBatch, tok: Tokenizer, p: TokenParams) -> tuple[list[list[str]], list[list[str]]]:
    """K1/K2: answers and rendered texts of both sides of a batch; null texts are empty."""
    columns = {name: [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()] for name in ("prompt", *SIDES)}
    prompts = [tok.tail(x, p.max_prompt_length) for x in columns["prompt"]]
    answers = [columns[s] for s in SIDES]
    return answers, [[full_text(x, a, p) for x, a in zip(prompts, side)] for side in answers]


def _ids(texts: list[str], tok: Tokenizer, special: bool) -> Tokens:
    """Ids without offsets; a tokenizer may have a quicker ``encode_ids`` for them."""
    found = getattr(tok, "encode_ids", tok.encode)(texts, special)
    return Tokens(found.ids, None, None, found.first)


def _encoded(texts: list[str], tok: Tokenizer, offsets: bool) -> Tokens:
    return tok.encode(texts) if offsets else _ids(texts, tok, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def _padded(sides: tuple[Side, ...], widths: list[int], name: str, p: TokenParams) -> pa.Array:
    """One of ``PADDED`` of a side's rows, filled up to their widths and cast; made flat, at its final size."""
    offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    out = np.full(offsets[-1], {"input_ids": p.pad_id, "labels": IGNORE}.get(name, 0), np.float32 if name == "weights" else np.int64)
    for at, side in zip(offsets.tolist(), sides):
        out[at : at + side.n] = 1 if name == "attention_mask" else side.array("ids" if name == "input_ids" else name)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))


def _sides(batch: pa.RecordBatch, tok: Tokenizer, p: TokenParams, offsets: bool) -> list[tuple[Side, Side]]:
    """K1-K9: both sides of every pair of a batch."""
    head = len(tok.encode([""]).ids)
    answers, texts = _texts(batch, tok, p)
    tokens = [_encoded(side, tok, offsets) for side in texts]
    rows = []
    for i in range(batch.num_rows):
        c, r = (Side(*tokens[k].of(i, p.max_length), texts[k][i], answers[k][i], tok, p, head) for k in (0, 1))
        weigh_differences(c, r, p.weight_diff_tokens)
        rows.append((c, r))
    return rows


def token_sides(
    pairs: DataFrame,
    p: TokenParams = TokenParams(),
    tokenizer: str | TokenizerFactory = "char",
    offsets: bool = True,
    keep: tuple[str, ...] = (),
    arrays: tuple[str, ...] = ("ids", "labels", "weights"),
) -> DataFrame:
    """K1-K9 per pair: ids, labels and weights of both sides (unpadded, double weights),
    the answers' starts, plus ``*_m``, the index of the first supervised token, and ``*_n``, the number of tokens.

    ``arrays``: which arrays to give out.  ``tail_labels`` and ``tail_weights`` are those of the
    tokens from ``*_m`` on; prompts are long, and all before it is masked with weight 0.

    ``offsets=False``, or a tokenizer without an offset map: the answer is the first run of
    its tokens (K5), and a value counts where its tokens first occur from there on (K8).
    ``keep``: columns of ``pairs`` to carry along.
    """
    require_columns(pairs)
    factory, key = factory_of(tokenizer), new_key()
    narrow = pairs.select("model", "pair_id", *keep, "prompt", *SIDES)
    fields = [narrow.schema[c] for c in ("model", "pair_id", *keep)]
    ints, doubles = ArrayType(IntegerType()), ArrayType(DoubleType())
    for s in SIDES:
        kinds = {name: doubles if name.endswith("weights") else ints for name in arrays}
        kinds |= {"start": IntegerType(), "m": IntegerType(), "n": IntegerType()}
        fields += [StructField(f"{s}_{name}", kind) for name, kind in kinds.items()]
    schema = StructType(fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = held("tokenizer", key, factory)
        for batch in slices(batches):
            columns = [batch.column(k) for k in range(2 + len(keep))]
            for side in zip(*_sides(batch, tok, p, offsets)):
                columns += [_lists([x.array(name) for x in side], pa.float64() if name.endswith("weights") else pa.int32()) for name in arrays]
                columns += [pa.array([getattr(x, name) for x in side], pa.int32()) for name in ("start", "m", "n")]
            yield pa.RecordBatch.from_arrays(columns, names)

    return narrow.mapInArrow(run, schema)


def token_lengths(pairs: DataFrame, p: TokenParams = TokenParams(), tokenizer: str | TokenizerFactory = "char") -> DataFrame:
    """``(model, pair_id, longest)``: the number of tokens of a pair's longer side."""
    factory, key = factory_of(tokenizer), new_key()
    narrow = pairs.select("model", "pair_id", "prompt", *SIDES)
    schema = StructType([narrow.schema["model"], narrow.schema["pair_id"], StructField("longest", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = held("tokenizer", key, factory)
        for batch in slices(batches):
            _, texts = _texts(batch, tok, p)
            sizes = [np.diff(_ids(side, tok, True).first) for side in texts]
            longest = np.minimum(np.maximum(*sizes), p.max_length)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(longest, pa.int32())], schema.names)

    return narrow.mapInArrow(run, schema)


def number_batches(rows: DataFrame, batch_size: int) -> DataFrame:
    """``rows`` (narrow) with ``batch``: the row's number in its model by pair_id, ``div batch_size``."""
    numbered = number_rows(rows, "model", "pair_id", "_number")
    return numbered.withColumn("batch", F.expr(f"_number div {int(batch_size)}")).drop("_number")


def placed_batches(pairs: DataFrame, p: TokenParams = TokenParams(), tokenizer: str | TokenizerFactory = "char") -> DataFrame:
    """The pairs' texts with ``batch`` and ``max_len``, the tokens of the batch's longest side.

    Lengths, batches and their longest rows are worked out on narrow rows and joined to the
    texts, once.  Then whole batches are dealt out evenly, in the order of models: tokens take
    some 20 times the texts' size, and AQE would make few tasks, or one, of a join of texts.
    """
    require_columns(pairs)
    texts = staged(pairs.select("model", "pair_id", "prompt", *SIDES), "pairs")
    lengths = staged(token_lengths(texts, p, tokenizer), "lengths")  # numbering reads them twice
    batches = staged(number_batches(lengths, p.batch_size), "batches")
    longest = batches.groupBy("model", "batch").agg(F.max("longest").alias("max_len"))
    placed = batches.drop("longest").join(longest, ["model", "batch"])
    joined = staged(texts.join(placed, ["model", "pair_id"]).select("model", "pair_id", "batch", "max_len", "prompt", *SIDES), "placed")
    n_parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # an explicit count is kept by AQE
    return joined.repartition(n_parts, "model", "batch").sortWithinPartitions("model", "batch", "pair_id")


def padding(placed: DataFrame, p: TokenParams = TokenParams(), tokenizer: str | TokenizerFactory = "char", offsets: bool = True):
    """The Arrow pass over :func:`placed_batches` that makes and pads the arrays of both sides, and its schema."""
    factory, key = factory_of(tokenizer), new_key()
    longs, floats = ArrayType(LongType()), ArrayType(FloatType())
    fields = [placed.schema[c] for c in ("model", "pair_id", "batch", "max_len")]
    fields += [StructField(f"{s}_{name}", floats if name == "weights" else longs) for s in SIDES for name in PADDED]
    schema = StructType(fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = held("tokenizer", key, factory)
        for batch in slices(batches, 64):  # some 100 KB a row
            widths = batch.column(3).to_pylist()
            columns = [batch.column(k) for k in range(4)]
            for side in zip(*_sides(batch, tok, p, offsets)):
                columns += [_padded(side, widths, name, p) for name in PADDED]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run, schema


def pad_batches(pairs: DataFrame, p: TokenParams = TokenParams(), tokenizer: str | TokenizerFactory = "char", offsets: bool = True) -> DataFrame:
    """Batches of ``batch_size`` consecutive pairs of a model, both sides padded to the batch's longest, cast.

    The token arrays are made after texts, batches and longest rows are joined, and padded
    where they are made, in the Arrow pass: array functions over them took most of the time
    and memory.
    """
    placed = placed_batches(pairs, p, tokenizer)
    return placed.mapInArrow(*padding(placed, p, tokenizer, offsets))
