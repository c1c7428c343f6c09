"""Operator 2: language-model scoring with Brown class-based bigrams.

Counting: every training text's tokens, per task before the shuffle. Words of a
relative frequency of 2^-15 and more (hence at most 2^15) are units of their own;
rarer and unseen words are units by the hash of their ending (``TAIL_GROUPS``),
so that every word of any corpus has a unit, and the table of unit bigrams is
bounded while the counts behind it cover all training tokens.

Exchange clustering: units move between ``CLASSES`` classes, one after the
other, to the class that raises the likelihood of the class bigrams most (of equally
good classes the one of the smallest number, and a unit stays where no class is better); each
sweep's statistics (per unit, counts of next and previous classes) are
aggregated from the bigram table by Spark. There are ``SWEEPS`` sweeps, and more
until ``PARTS`` of them (each unit's turn once) add less than ``TOLERANCE`` of
the rise so far.

Model: p(w | previous) = p(class | previous class) p(w | class); transitions are
smoothed towards class frequencies, emissions by adding one to every known word
of the class and one for all unknown. The text's end is a class of its own.

Scoring: transitions and frequent words (2^-18 and more, broadcast) in the scan;
counts of rarer words by a join on the word, summed per text before the shuffle.

Defined results: null text counts as empty (one end token); null doc_ids hash as
the empty text; repeated rows are scored each and count each; without training
rows all counts are 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import id_remainder, slices, staged

MODULUS, HELD_OUT = 7, 2
CLASSES, SWEEPS = 48, 9
#: Share of the likelihood's rise under which sweeping ends, and a guard for the number of sweeps.
TOLERANCE, MAX_SWEEPS = 0.01, 30
#: Of the units, one in so many may move in a sweep: the others' counts are those of the sweep's start.
PARTS = 3
HEAD_BITS, LOOKUP_BITS, TAIL_GROUPS = 15, 18, 512
#: Weight of the class frequencies in smoothed transitions.
BACKOFF = 20.0
#: Entries a task gathers before it sends them on.
FLUSH = 600_000


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lowered; ``bytes`` methods know ASCII only."""
    return text.encode().lower().split()


def word_counts(train: DataFrame) -> DataFrame:
    """``(word, c)`` over all of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > FLUSH:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    return train.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def positions(words: list[bytes], known: dict[bytes, int], first_tail: int) -> np.ndarray:
    """The number of every known word, that of its tail group for the others."""
    get, crc = known.get, zlib.crc32
    return np.array([at if (at := get(w)) is not None else first_tail + crc(w[-3:]) % TAIL_GROUPS for w in words], np.int64)


class Units:
    """Unit numbers: 0 the text's end, then frequent words, then tail groups."""

    def __init__(self, head: list[str]):
        self.number = {w.encode(): i + 1 for i, w in enumerate(head)}
        self.first_tail = len(head) + 1
        self.total = self.first_tail + TAIL_GROUPS

    def of(self, words: list[bytes]) -> np.ndarray:
        return positions(words, self.number, self.first_tail)


def bigrams(train: DataFrame, head: list[str]) -> DataFrame:
    """``(a, b, n)``: how often unit b follows unit a, over all of ``text``."""
    held = train.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(held.value)
        parts, size = [], 0

        def sent():
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code // units.total), pa.array(code % units.total), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            for text in batch.column(0):
                u = np.concatenate([[0], units.of(words_of(text.as_py())), [0]])
                parts.append(u[:-1] * units.total + u[1:])
                size += len(u)
                if size > 8 * FLUSH:
                    yield sent()
                    parts, size = [], 0
        if parts:
            yield sent()

    return train.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def neighbour_counts(pairs: DataFrame, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit: counts of next classes, of previous classes, of itself next. At most units x classes numbers."""
    spark = pairs.sparkSession
    of = spark.createDataFrame([(i, int(c)) for i, c in enumerate(classes)], "unit long, cls int")
    ahead = pairs.where("a <> b").join(F.broadcast(of), F.col("b") == F.col("unit")).select(F.col("a").alias("u"), F.lit(0).alias("side"), "cls", "n")
    back = pairs.where("a <> b").join(F.broadcast(of), F.col("a") == F.col("unit")).select(F.col("b").alias("u"), F.lit(1).alias("side"), "cls", "n")
    own = pairs.where("a = b").select(F.col("a").alias("u"), F.lit(2).alias("side"), F.lit(0).alias("cls"), "n")
    sums = ahead.unionAll(back).unionAll(own).groupBy("u", "side", "cls").agg(F.sum("n").alias("n"))
    x, y, s = np.zeros((len(classes), n_classes)), np.zeros((len(classes), n_classes)), np.zeros(len(classes))
    for row in packed(sums).collect():
        place, n = unpacked(row["bytes"])
        u, at = np.divmod(place, SLOTS)
        side, cls = np.divmod(at, SLOTS // 4)
        for table, k in ((x, 0), (y, 1)):
            table[u[side == k], cls[side == k]] = n[side == k]
        s[u[side == 2]] = n[side == 2]
    return x, y, s


#: Places of a unit among packed counts: four sides of as many classes.
SLOTS = 1 << 12


def packed(sums: DataFrame) -> DataFrame:
    """``sums (u, side, cls, n)`` as few rows ``bytes``: ascending places and their counts, compressed.

    As rows of their own the counts (units x classes x 2 at most) took several hundred
    MB of the driver in every sweep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, side, cls, n = (batch.column(c).to_numpy() for c in ("u", "side", "cls", "n"))
            place = u * SLOTS + side * (SLOTS // 4) + cls
            order = np.argsort(place)
            body = np.diff(place[order], prepend=0).astype("<i8").tobytes() + n[order].astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(body, 1)], pa.binary())], ["bytes"])

    return sums.mapInArrow(run, "bytes binary")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a row of :func:`packed`."""
    place, n = np.frombuffer(zlib.decompress(data), "<i8").reshape(2, -1)
    return np.cumsum(place), n


def _phi(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0.0)


def class_bigrams(x: np.ndarray, s: np.ndarray, classes: np.ndarray, n_classes: int) -> np.ndarray:
    table = np.zeros((n_classes, n_classes))
    np.add.at(table, classes, x)
    np.add.at(table, (classes, classes), s)
    return table


def likelihood(table: np.ndarray) -> float:
    """What exchange raises: the class bigrams' part of the log-likelihood."""
    return float(_phi(table).sum() - _phi(table.sum(axis=0)).sum() - _phi(table.sum(axis=1)).sum())


def exchange(x: np.ndarray, y: np.ndarray, s: np.ndarray, classes: np.ndarray, n_classes: int, turn: int) -> np.ndarray:
    """One sweep: each unit whose turn it is (the end never) to its best class, frequent ones first."""
    classes = classes.copy()
    table = class_bigrams(x, s, classes, n_classes)
    order = np.argsort(-(x.sum(axis=1) + s), kind="stable")
    for u in order:
        if u == 0 or u % PARTS != turn % PARTS:
            continue
        a, xu, yu, su = classes[u], x[u], y[u], s[u]
        table[a] -= xu
        table[:, a] -= yu
        table[a, a] -= su
        np.maximum(table, 0, out=table)
        rows, cols = table.sum(axis=1), table.sum(axis=0)
        corner = np.arange(n_classes)
        row_new = table + xu[None, :]
        row_new[corner, corner] += yu + su
        col_new = table + yu[:, None]
        col_new[corner, corner] = table[corner, corner]
        gain = (_phi(row_new) - _phi(table)).sum(axis=1) + (_phi(col_new) - _phi(table)).sum(axis=0)
        gain -= _phi(rows + xu.sum() + su) - _phi(rows) + _phi(cols + yu.sum() + su) - _phi(cols)
        gain[0] = -np.inf  # the end's class
        best = int(gain.argmax())
        if gain[best] <= gain[a] + 1e-9:
            best = int(a)
        table[best] += xu
        table[:, best] += yu
        table[best, best] += su
        if best != a:
            classes[u] = best
    return classes


def cluster(pairs: DataFrame, total: int, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and the class bigram counts, after ``sweeps`` exchange sweeps and as many more as pay."""
    classes = np.concatenate([[0], 1 + np.arange(total - 1) % (n_classes - 1)])
    best: tuple = ()
    reached: list[float] = []
    for turn in range(MAX_SWEEPS + 1):
        x, y, s = neighbour_counts(pairs, classes, n_classes)
        table = class_bigrams(x, s, classes, n_classes)
        if not best or likelihood(table) > best[0]:
            best = (likelihood(table), classes, table)
        reached.append(best[0])
        if turn == MAX_SWEEPS or turn >= sweeps and reached[-1] - reached[-1 - PARTS] <= TOLERANCE * (reached[-1] - reached[0]):
            break
        classes = exchange(x, y, s, classes, n_classes, turn)
    return best[1], best[2]


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", (id_remainder(MODULUS) == HELD_OUT).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = rows.where("not held_out")
    counts = staged(word_counts(train), "brown-words")
    ends = train.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = sums["n"] + ends, sums["v"] + (1 if ends else 0)

    # at most 2^bits words have a share of 2^-bits or more
    head = [r["word"] for r in counts.where(F.col("c") * (1 << HEAD_BITS) >= n_train).select("word").orderBy("word").toLocalIterator()]
    lookup = {r["word"]: r["c"] for r in counts.where(F.col("c") * (1 << LOOKUP_BITS) >= n_train).toLocalIterator()}
    pairs = staged(bigrams(train, head), "brown-bigrams")
    units = Units(head)
    classes, table = cluster(pairs, units.total)

    # class sizes: tokens and distinct words, the end apart
    head_set = spark.createDataFrame([(w,) for w in head], "h string")
    grouped = counts.join(F.broadcast(head_set), F.col("word") == F.col("h"), "left_anti")
    suffix = F.expr("substring(cast(word as binary), greatest(octet_length(word) - 2, 1), 3)")
    tails = grouped.groupBy(F.pmod(F.crc32(suffix), F.lit(TAIL_GROUPS)).alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for i, w in enumerate(head):
        mass[classes[i + 1]] += lookup[w]
        kinds[classes[i + 1]] += 1
    for r in tails:
        mass[classes[units.first_tail + r["g"]]] += r["c"]
        kinds[classes[units.first_tail + r["g"]]] += r["v"]
    mass[0] = ends
    share = (mass + 1) / (mass.sum() + CLASSES)
    moves = np.log10((table + BACKOFF * share[None, :]) / (table.sum(axis=1) + BACKOFF)[:, None])
    given = np.log10(mass + kinds + 1)  # minus this: a word of the class, its count plus one
    base_given = float(np.log10(n_train + v_train + 1))
    end_base = float(np.log10(ends + 1)) - base_given

    held = spark.sparkContext.broadcast((head, lookup, classes, moves, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_, lookup_, classes_, moves_, given_ = held.value
        units_ = Units(head_)
        # entries: the frequent words, then the tail groups (class known, count not)
        names_ = [w.encode() for w in lookup_]
        place_ = {w: i for i, w in enumerate(names_)}
        class_at = np.concatenate([classes_[units_.of(names_)], classes_[units_.first_tail :]])
        log_at = np.concatenate([np.log10(np.fromiter(lookup_.values(), np.float64, len(lookup_)) + 1), np.full(TAIL_GROUPS, -1.0)])
        for batch in slices(batches):
            base, model, known, tokens, tail = [], [], [], [], []
            for text in batch.column(3):
                w = words_of(text.as_py())
                at = positions(w, place_, len(names_))
                c = np.concatenate([[0], class_at[at], [0]])
                logs, found = log_at[at], at < len(names_)
                sure = float(logs[found].sum())
                base.append(sure - base_given * int(found.sum()) + end_base)
                model.append(float(moves_[c[:-1], c[1:]].sum()) - float(given_[c[1:-1]].sum()) + sure)
                known.append(int(found.sum()) + (1 if ends else 0))
                tokens.append(len(w) + 1)
                tail.append(Counter(compress(w, (~found).tolist())))
            bounds = np.cumsum([0] + [len(t) for t in tail]).astype(np.int32)
            names = pa.array([x.decode() for t in tail for x in t], pa.string())
            often = pa.array([k for t in tail for k in t.values()], pa.int64())
            rare = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([names, often], ["w", "k"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model), rare],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out_schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<w:string,k:long>>"
    scored = staged(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(run, out_schema), "brown-scored")
    seldom = scored.select("row", F.explode("rare").alias("t")).select("row", "t.w", "t.k")
    less = counts.where(F.col("c") * (1 << LOOKUP_BITS) < n_train)
    joined = seldom.join(less, F.col("w") == F.col("word"), "left")
    extra = joined.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("log_counts"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"),
        F.sum("k").alias("seldom"),
    ).select(F.col("row").alias("r"), "log_counts", "more_known", "seldom")
    both = scored.drop("rare").join(extra, F.col("row") == F.col("r"), "left")
    logs = F.coalesce("log_counts", F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.coalesce("seldom", F.lit(0)) * base_given).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
