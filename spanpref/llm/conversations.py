"""Operator 11: conversation structure repair by scalar big-integer weights.

A conversation's rows, in the order of their turns, are brought into the form
``(s?(ua)+)?`` of role initials by the cheapest edits: keep a row (0, and 5 if it is
truncated), give it the role user or assistant (1, likewise 5 more), delete it (2;
required for blank and duplicate rows), insert an empty user or assistant row (5).

Edits are the edges of a directed acyclic graph over (rows used, rows inserted, state
of the form). An edge's weight is one whole number: its high digits are the cost, its
low digits, one octal digit for every place of the audit, hold the edit's letter at
the place where it stands (D 1, I 2, K 3, R 4, in ASCII order) and zeros elsewhere, so
places after the end count as zero. Weights add up along a path, and the ordinary
smallest whole number gives the least cost and, among those, the ASCII-least audit.
Its digits are the result.

``MAX_INSERTS`` bounds the graph. No cheapest path has an insert: its row and the other
row of its pair (and a leading system row, were it left alone) can go for less than 5.
Tests compare with searches that allow any number.

A conversation of over ``CROWD_ROWS`` rows or ``CROWD_CHARS`` characters is no single
task's work. Its rows are dealt by ranges of their order and cut into chunks; a chunk's
shortest paths from each state to each state are such numbers too, and numbers of
adjoining chunks add up with their digits side by side. Rows seen earlier are found by
an aggregation per (role, text). Per chunk only these numbers (a few digits a row) come
together for the choice of a path; texts are hashed chunk after chunk, one at a time.

Defined results: null roles and texts are one space; a null turn comes first and counts
for no gap; rows of one turn are in the order of role and the text's MD5, repeated rows
each count; a null conv_id is one conversation; an empty table gives no rows; other columns
are left behind. A role that begins with s, u or a fits by its initial and keeps its name;
one without an initial (the empty text) fits nowhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanpref.llm.common import staged

MAX_INSERTS = 2
CROWD_ROWS, CROWD_CHARS = 4_096, 16_000_000
CHUNK_ROWS, CHUNK_CHARS = 1_024, 4_000_000
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
SPACE = " \t\n\x0b\x0c\r"
#: States of the form, and where the initials lead.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
STEP = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMED = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (EMPTY, ASSISTANT)
LETTERS, BITS = "DIKR", 3
DIGIT = {letter: n for n, letter in enumerate(LETTERS, 1)}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def fault(role: str, text: str, seen: bool) -> str | None:
    """The first fault of a row; ``seen``: its role and text stood in the conversation before."""
    core = text.rstrip(SPACE)
    return BLANK if not core else DUPLICATE if seen else TRUNCATED if core[-1] not in ".!?" else None


def shortest(rows: list[tuple[str, str | None]], start: int = EMPTY, inserts: int = MAX_INSERTS) -> dict[int, int]:
    """The least weight of a path over ``rows`` (initial, fault) to each state, with ``len(rows) + inserts`` octal places."""
    places = len(rows) + inserts
    high = BITS * places

    def weight(cost: int, letter: str, place: int) -> int:
        return (cost << high) + (DIGIT[letter] << BITS * (places - 1 - place))

    def lower(table: dict, key: tuple[int, int], value: int) -> None:
        if key not in table or value < table[key]:
            table[key] = value

    layer = {(0, start): 0}
    for i in range(len(rows) + 1):
        for k in range(inserts):
            added = weight(COSTS["insert"], "I", i + k)
            for state in STATES:
                if (k, state) in layer:
                    lower(layer, (k + 1, NAMED[state]), layer[k, state] + added)
        if i == len(rows):
            break
        initial, wrong = rows[i]
        extra = COSTS["truncated"] if wrong == TRUNCATED else 0
        following: dict[tuple[int, int], int] = {}
        for k in range(inserts + 1):
            edges = [(k, state) for state in STATES if (k, state) in layer]
            if not edges:
                continue
            drop = weight(COSTS["delete"], "D", i + k)
            keep = weight(COSTS["keep"] + extra, "K", i + k)
            name = weight(COSTS["rerole"] + extra, "R", i + k)
            for _, state in edges:
                value = layer[k, state]
                lower(following, (k, state), value + drop)
                if wrong in (BLANK, DUPLICATE):
                    continue
                if initial in STEP[state]:
                    lower(following, (k, STEP[state][initial]), value + keep)
                lower(following, (k, NAMED[state]), value + name)
        layer = following
    out: dict[int, int] = {}
    for (_, state), value in layer.items():
        if state not in out or value < out[state]:
            out[state] = value
    return out


def read(weight: int, places: int) -> tuple[int, str]:
    """A weight's cost and audit."""
    cost = weight >> BITS * places
    digits = format(weight - (cost << BITS * places), f"0{max(1, places)}o") if places else ""
    return cost, digits.rstrip("0").translate({ord(str(n)): c for c, n in DIGIT.items()})


def edited(rows: list[tuple[str, str]], audit: str, state: int = EMPTY) -> tuple[list[tuple[str, str]], int]:
    """The rows ``(role, text)`` that an audit leaves, from a state on, and the state it ends in."""
    out, at = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = NAMED[state]
            out.append((ROLE[state], ""))
            continue
        role, text = next(at)
        if letter == "K":
            state = STEP[state][role[:1]]
            out.append((role, text))
        elif letter == "R":
            state = NAMED[state]
            out.append((ROLE[state], text))
    return out, state


@dataclass
class Facts:
    """Counts over rows of one conversation, in order; those of adjoining pieces can be added."""

    faults: dict = field(default_factory=lambda: dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0))
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    turns: int = 0
    least: int | None = None
    most: int | None = None

    def add(self, turn: int | None, role: str, wrong: str | None) -> None:
        initial = role[:1]
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if wrong:
            self.faults[wrong] += 1
        if turn is not None:
            if self.most is None or turn != self.most:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def join(self, other: "Facts") -> None:
        """Add the facts of the rows that follow."""
        if other.last is None:
            return
        for name, n in other.faults.items():
            self.faults[name] += n
        self.illegal += other.illegal + (self.last is not None and self.last + other.first not in LEGAL)
        self.first, self.last = (other.first if self.last is None else self.first), other.last
        if other.least is not None:
            self.turns += other.turns - (other.least == self.most)
            self.least = other.least if self.least is None else self.least
            self.most = other.most

    def counts(self, cost: int) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (gaps, *(self.faults[x] for x in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, cost)


def repair_rows(rows: list[tuple]) -> tuple[tuple, str, list[tuple[str, str]]]:
    """Counts, audit and repaired rows of one conversation's ordered ``(turn, role, text)``."""
    facts, seen, graph = Facts(), set(), []
    for turn, role, text in rows:
        wrong = fault(role, text, (role, text) in seen)
        seen.add((role, text))
        facts.add(turn, role, wrong)
        graph.append((role[:1], wrong))
    ends = shortest(graph)
    cost, audit = read(min(ends[s] for s in ENDS if s in ends), len(graph) + MAX_INSERTS)
    return facts.counts(cost), audit, edited([(r, t) for _, r, t in rows], audit)[0]


def lines(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


# ------------------------------------------------------------------ on Spark
ORDER = ("conv_id", "turn", "role", "print")
ROW = (*ORDER, "text", "alive")
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, alive)`` after the contract's damage; a dropped row stays as one that is not alive."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("alive"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as tuples, a thousand at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))


def _out(schema: pa.Schema, rows: Iterator[tuple], size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


def _schema(conv: pa.DataType, columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "strings": pa.list_(pa.string()), "paths": PATHS}
    return pa.schema([("conv_id", conv), *((c.split()[0], kinds[c.split()[1]]) for c in columns.split(", "))])


PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _in_tasks(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations that fit a task, one at a time."""
    kind = rows.schema["conv_id"].dataType
    spec = "place long, role string, text string" if texts else RESULT
    schema = _schema(to_arrow_type(kind), spec)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, group in groupby(_rows(batches), key=itemgetter(0)):
            counts, audit, out = repair_rows([(turn, role, text) for _, turn, role, text, alive in group if alive])
            if texts:
                yield from ((conv_id, n, *row) for n, row in enumerate(out))
            else:
                yield (conv_id, *counts, audit, hashlib.sha256(lines(out)).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(schema, repaired(batches))

    dealt = rows.repartition("conv_id").sortWithinPartitions(*ORDER)
    return dealt.select("conv_id", "turn", "role", "text", "alive").mapInArrow(run, f"conv_id {kind.simpleString()}, {spec}")


def chained(first: int, n: int, second: int, m: int) -> int:
    """The weight of a path of ``n`` places followed by one of ``m``."""
    costs = (first >> BITS * n) + (second >> BITS * m)
    digits = [w & ((1 << BITS * k) - 1) for w, k in ((first, n), (second, m))]
    return (costs << BITS * (n + m)) + (digits[0] << BITS * m) + digits[1]


def written(cost: int, audit: str) -> int:
    """The weight of an audit that fills all its places."""
    return (cost << BITS * len(audit)) + int("0" + audit.translate({ord(c): str(n) for c, n in DIGIT.items()}), 8)


def choose(chunks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost, audit and per chunk (start state, audit) of the cheapest path through chunks of ``(start, end, cost, audit)``."""
    best, places, back = {EMPTY: 0}, 0, []
    for paths in chunks:
        size = len(paths[0][3])
        following: dict[int, int] = {}
        came: dict[int, tuple[int, str]] = {}
        for start, end, cost, audit in paths:
            if start in best:
                value = chained(best[start], places, written(cost, audit), size)
                if end not in following or value < following[end]:
                    following[end], came[end] = value, (start, audit)
        best, places = following, places + size
        back.append(came)
    state = min((s for s in ENDS if s in best), key=best.__getitem__)
    cost, audit = read(best[state], places)
    taken = []
    for came in reversed(back):
        taken.append(came[state])
        state = came[state][0]
    return cost, audit, taken[::-1]


CHUNK = "part int, seq int, paths paths, facts string, roles strings, texts strings"


def _chunked(rows: DataFrame) -> DataFrame:
    """Crowded conversations in chunks: shortest paths from state to state, facts, and the rows themselves."""
    kind = rows.schema["conv_id"].dataType
    schema = _schema(to_arrow_type(kind), CHUNK)
    first = rows.where("alive").groupBy("conv_id", "role", "print").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("m"))
    # keys by other expressions: both sides of the join come from exchanges, and Spark may split a hot key
    first = first.select(F.col("conv_id").alias("c"), F.concat("role", F.lit("")).alias("r"), F.concat("print", F.lit("")).alias("p"), F.col("m.turn").alias("t"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("print") == F.col("p")), "left")
    dealt = joined.withColumn("later", ~F.col("turn").eqNullSafe(F.col("t"))).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)

    def chunk(conv_id, part, seq, held):
        facts, graph = Facts(), []
        for turn, role, text, seen in held:
            wrong = fault(role, text, seen)
            facts.add(turn, role, wrong)
            graph.append((role[:1], wrong))
        paths = [(start, end, *read(w, len(graph))) for start in STATES for end, w in shortest(graph, start, 0).items()]
        return conv_id, part, seq, [dict(zip(("start", "end", "cost", "audit"), x)) for x in paths], json.dumps(asdict(facts)), [x[1] for x in held], [x[2] for x in held]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        for conv_id, group in groupby(_rows(batches), key=itemgetter(0)):
            held, size, seq, before = [], 0, 0, None
            for _, turn, role, text, later, alive in group:
                if not alive:
                    continue
                row = (turn, role, text)
                held.append((*row, later or row == before))
                before, size = row, size + len(text)
                if len(held) == CHUNK_ROWS or size >= CHUNK_CHARS:
                    yield chunk(conv_id, part, seq, held)
                    held, size, seq = [], 0, seq + 1
            if held or not seq:
                yield chunk(conv_id, part, seq, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(schema, cut(batches), 1)

    spark_kinds = CHUNK.replace(" paths paths", " paths array<struct<start:int,end:int,cost:long,audit:string>>").replace(" strings", " array<string>")
    return staged(dealt.select("conv_id", "turn", "role", "text", "later", "alive").mapInArrow(run, f"conv_id {kind.simpleString()}, {spark_kinds}"), "conversation-chunks")


def _crowded(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations that are too large for a task."""
    kind = rows.schema["conv_id"].dataType
    conv, name = to_arrow_type(kind), kind.simpleString()
    chunks = _chunked(rows)
    chosen_spec = "part int, seq int, start int, piece string, " + RESULT.replace(", repaired_sha256 string", "")
    chosen_schema = _schema(conv, chosen_spec)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, pieces in _rows(batches):
            facts = Facts()
            for p in pieces:
                facts.join(Facts(**json.loads(p["facts"])))
            cost, audit, taken = choose([[tuple(x[c] for c in ("start", "end", "cost", "audit")) for x in p["paths"]] for p in pieces])
            nothing = (None,) * (len(COUNTS) + 1)
            for n, (p, (start, piece)) in enumerate(zip(pieces, taken)):
                yield (conv_id, p["part"], p["seq"], start, piece, *((*facts.counts(cost), audit) if not n else nothing))

    def run_pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(chosen_schema, pick(batches), 1)

    listed = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "paths", "facts"))).alias("pieces"))
    chosen = staged(listed.mapInArrow(run_pick, f"conv_id {name}, {chosen_spec}"), "conversation-paths")
    taken = chosen.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("seq").alias("s"), "start", "piece")
    both = chunks.join(taken, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    spec = "place long, role string, text string" if texts else "repaired_sha256 string"
    schema = _schema(conv, spec)

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, group in groupby(_rows(batches), key=itemgetter(0)):
            place, print_ = 0, hashlib.sha256()
            for _, start, piece, roles, bodies in group:
                out, _ = edited(list(zip(roles, bodies)), piece, start)
                if texts:
                    yield from ((conv_id, place + n, *row) for n, row in enumerate(out))
                elif out:
                    print_.update((b"\n" if place else b"") + lines(out))
                place += len(out)
            if not texts:
                yield conv_id, print_.hexdigest()

    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(schema, repaired(batches))

    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "start", "piece", "roles", "texts")
    found = dealt.mapInArrow(run_texts, f"conv_id {name}, {spec}")
    if texts:
        return found
    heads = chosen.where("cost is not null").select(F.col("conv_id").alias("c"), *COUNTS, "audit")
    return heads.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repair(rows: DataFrame, texts: bool = False, crowd_rows: int = CROWD_ROWS, crowd_chars: int = CROWD_CHARS) -> DataFrame:
    """Per conversation its counts, the least cost, the audit and a hash of the repaired rows.

    ``rows``: ``(conv_id, turn, role, text)`` and, optionally, ``alive`` (false: the row
    only keeps its conversation). ``texts``: the repaired rows themselves instead, as
    ``(conv_id, place, role, text)``.
    """
    alive = F.coalesce(F.col("alive"), F.lit(True)) if "alive" in rows.columns else F.lit(True)
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    base = rows.select("conv_id", F.col("turn").cast("long"), role, text, alive.alias("alive")).withColumn("print", F.md5("text"))
    sizes = base.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    crowds = staged(sizes.where((F.col("n") > crowd_rows) | (F.col("size") > crowd_chars)).select(F.col("conv_id").alias("crowd"), F.lit(True).alias("is_crowd")), "conversation-crowds")
    if crowds.isEmpty():
        return _in_tasks(base, texts)
    marked = base.join(crowds, F.col("conv_id").eqNullSafe(F.col("crowd")), "left")
    usual, crowded = (marked.where(c).select(*ROW) for c in ("is_crowd is null", "is_crowd"))
    return _in_tasks(usual, texts).unionAll(_crowded(crowded, texts))


def result(conversations: DataFrame) -> DataFrame:
    """The contract's row for every conv_id of the table."""
    return repair(damaged(conversations))
