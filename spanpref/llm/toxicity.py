"""Operator 9: toxicity by weak supervision.

1. Terms that mark toxic rows are mined from a bounded sample of labelled training
   rows, by a binomial bound that allows for the number of terms tried: words,
   word beginnings, and families (beginnings that two or more different words of
   a text share). They fill several lexicon voters; a plain public list of insults and
   patterns (density, variety, neighbourhood of hits, shouting) are further voters.
2. Every training document, labelled or not, votes once. Votes are bits, so there
   are at most 2^14 vote patterns, and only their counts leave the executors.
3. A generative label model is fitted to these counts by expectation
   maximisation: a hidden class, each voter's chances of firing given the class,
   and correlations as a tree of voters (each given one other voter and the
   class), chosen by conditional mutual information. The labels at hand are one
   more voter whose accuracy is estimated, not the truth.
4. A linear (logistic) classifier learns the posterior labels of the sample and scores
   whole texts. It weighs the terms and, as back-off for terms that few rows have,
   the voters and each kind of lexicon as a whole. Scoring is narrow: no shuffle.

Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2; lang,
source and doc_id are no inputs of a score.

Defined results: null text counts as empty and is scored (the bias); null
labels and labels of unknown documents are left out, several labels of one
document count as toxic if any is; without labelled rows only the fixed voters
count; an empty table gives no rows. Repeated rows are scored each; extra columns of
either table take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import Memo, doc_texts, held_once, id_remainder, slices, staged

#: Bounds of the fit (documented parameters): labelled rows, terms, words remembered by a worker.
SAMPLE_ROWS, MAX_TERMS, WORD_LIMIT = 16_000, 4_000, 300_000
HELD_OUT, MODULUS, CUT = 2, 4, 0.3
MIN_ROWS = 3
#: Lexicon voters for each kind of term, and the lengths of beginnings.
GROUPS, BEGINNINGS = 3, (4, 5, 6, 7)
#: Everyday English insults; one voter among fourteen.
INSULTS = ("idiot", "stupid", "moron", "loser", "trash", "scum", "clown", "worthless", "pathetic", "disgusting",
           "dumb", "jerk", "fool", "imbecile", "garbage", "filthy", "hate", "vermin", "bastard", "bitch")
_WORD = re.compile(r"\w+")
_SHOUT = re.compile(r"!{2,}|\?{2,}")
KINDS = ("word", "beginning", "family")
FIXED = len(KINDS) * GROUPS
N_VOTERS = FIXED + 5
_NOTHING = ((), ())


def kind_of(term: str) -> int:
    return {"=": 0, "+": 2}.get(term[0], 1)


def terms_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings; the mark tells them apart."""
    return (f"={word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n))


def families_of(word: str) -> tuple[str, ...]:
    """The families a word belongs to."""
    return tuple(f"+{word[:n]}" for n in BEGINNINGS if len(word) > n)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def all_terms(text: str) -> set[str]:
    words = set(words_of(text))
    families = Counter(f for w in words for f in families_of(w))
    return {t for w in words for t in terms_of(w)} | {f for f, n in families.items() if n >= 2}


class Voters:
    """Votes of one text as bits, given the mined terms (term -> lexicon voter), and the terms found."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.memo = Memo(self._known, WORD_LIMIT)

    def _known(self, word: str) -> tuple[tuple, tuple]:
        single = tuple(t for t in terms_of(word) if t in self.lexicon)
        if word in INSULTS and f"={word}" not in self.lexicon:
            single += (f"={word}",)
        families = tuple(f for f in families_of(word) if f in self.lexicon)
        return (single, families) if single or families else _NOTHING

    def read(self, text: str) -> tuple[int, set[str]]:
        """Votes, and the terms behind them."""
        words = words_of(text)
        known = {w: k for w in set(words) if (k := self.memo[w]) is not _NOTHING}
        found = {t for single, _ in known.values() for t in single}
        families = Counter(f for _, fs in known.values() for f in fs)
        found.update(f for f, n in families.items() if n >= 2)
        bits = {self.lexicon[t] for t in found if t in self.lexicon}
        hits = {w for w, (single, _) in known.items() if single}
        at = [i for i, w in enumerate(words) if w in hits] if hits else []
        if any(w in INSULTS for w in hits):
            bits.add(FIXED)
        if len(hits) >= 2:
            bits.add(FIXED + 1)
        if at and len(at) * 200 >= len(words):
            bits.add(FIXED + 2)
        if any(b - a <= 8 for a, b in zip(at, at[1:])):
            bits.add(FIXED + 3)
        if _SHOUT.search(text):
            bits.add(FIXED + 4)
        return sum(1 << b for b in bits), found

    def features(self, text: str) -> tuple[int, list[str]]:
        """Votes, and what the classifier weighs: terms, voters but the shouting one, kinds of lexicon."""
        votes, found = self.read(text)
        names = sorted(found)
        names += [f"voter {j}" for j in range(N_VOTERS - 1) if votes >> j & 1]
        names += [f"any {KINDS[k]}" for k in range(len(KINDS)) if votes >> (k * GROUPS) & ((1 << GROUPS) - 1)]
        return votes, names


def _voters(lexicon: dict[str, int], key: int) -> Voters:
    """One worker's voters; kept until another operator asks for its tables."""
    return held_once(("toxicity", key), lambda: Voters(lexicon))


def _key(lexicon: dict[str, int]) -> int:
    return xxhash.xxh64_intdigest(repr(sorted(lexicon.items())))


def sketch(text: str) -> int:
    """Smallest hash of the text's runs of four words; copies, also slightly changed ones, mostly share it."""
    words = words_of(text)
    grams = zip(*(words[i:] for i in range(4))) if len(words) > 4 else [tuple(words)]
    return min(xxhash.xxh64_intdigest(" ".join(g)) for g in grams) >> 1


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labelled, toxic)`` of at most ``SAMPLE_ROWS`` labelled training rows, taken by a hash of doc_id, and ``(text, toxic)`` of their documents.

    Of copies one is taken, else the words of a text that was copied often look like signs of its label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_once("toxicity-fit")
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(t.as_py()) for t in batch.column(1)], pa.int64())], ["labelled", "sketch"])

    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(MODULUS) != HELD_OUT))
    one = train.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).select(F.col("doc_id").alias("labelled"), "toxic")
    texts = doc_texts(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("doc_id", "text").mapInArrow(run, f"labelled {kind}, sketch long")
    single = seen.groupBy("sketch").agg(F.min("labelled").alias("labelled")).select("labelled").distinct()
    kept = staged(chosen.join(F.broadcast(single), "labelled"), "toxicity-labels")
    sample = texts.join(F.broadcast(kept), F.col("doc_id") == F.col("labelled")).select("text", "toxic")
    return kept, staged(sample, "toxicity-sample")


def mine_terms(sample: DataFrame) -> dict[str, int]:
    """Terms that mark toxic rows, each with its lexicon voter; ``MAX_TERMS`` at most, the strongest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_once("toxicity-fit")
        for batch in slices(batches):
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0), batch.column(1)):
                counts[toxic.as_py()].update(all_terms(text.as_py()))
            names = list(counts[1] | counts[0])
            both = [pa.array([c[t] for t in names], pa.int64()) for c in (counts[1], counts[0])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *both], ["term", "a", "b"])

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return {}
    base = totals["t"] / totals["n"]
    terms = sample.select("text", "toxic").mapInArrow(run, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tried = staged(terms.where(F.col("a") >= MIN_ROWS), "toxicity-terms")
    share, rest = F.col("a") / (F.col("a") + F.col("b")), F.col("b") / (F.col("a") + F.col("b"))
    spread = share * F.log(share / base) + F.when(rest > 0, rest * F.log(rest / (1 - base))).otherwise(0.0)
    mark = F.substring("term", 1, 1)
    kind = F.when(mark == "=", 0).when(mark == "+", 2).otherwise(1)
    scored = tried.withColumn("score", F.when(share > base, (F.col("a") + F.col("b")) * spread).otherwise(0.0)).withColumn("kind", kind)
    bound = F.lit(float("inf"))
    for row in tried.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect():  # three rows at most
        bound = F.when(F.col("kind") == row["kind"], float(np.log(max(2, row["n"])))).otherwise(bound)
    best = scored.where(F.col("score") >= bound).orderBy(F.desc("score"), "term").limit(MAX_TERMS).select("term").collect()
    group: dict[str, int] = {}
    place = [0] * len(KINDS)
    for row in best:
        k = kind_of(row["term"])
        group[row["term"]] = k * GROUPS + place[k] % GROUPS
        place[k] += 1
    return group


def vote_counts(rows: DataFrame, lexicon: dict[str, int]) -> pd.DataFrame:
    """``(votes, label, n)`` over all rows ``(text, label)``; label -1 where there is none. At most ``3 * 2^14`` rows."""
    held, key = rows.sparkSession.sparkContext.broadcast(lexicon), _key(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = _voters(held.value, key)
        for batch in slices(batches):
            found = Counter((voters.read(t.as_py())[0], y.as_py()) for t, y in zip(batch.column(0), batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.int64()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], ["votes", "label", "n"])

    return rows.select("text", F.col("label").cast("long")).mapInArrow(run, "votes long, label long, n long").groupBy("votes", "label").agg(F.sum("n").alias("n")).toPandas()


class LabelModel:
    """Hidden class, voters in a tree of dependences given the class, fitted to pattern counts."""

    def __init__(self, n_voters: int, rounds: int = 40, smooth: float = 0.5):
        self.m, self.rounds, self.smooth = n_voters, rounds, smooth

    def fit(self, votes: np.ndarray, label: np.ndarray, n: np.ndarray) -> "LabelModel":
        v = (votes[:, None] >> np.arange(self.m)) & 1
        lab, n = label.astype(np.int64), n.astype(np.float64)
        known = lab >= 0
        if known.any() and (lab[known] == 1).any():
            toxic_share = n[known & (lab == 1)].sum() / n[known].sum()
            any_vote = v[:, : self.m - 1].any(axis=1)
            q = np.where(known, np.clip(lab, 0.02, 0.98), np.where(any_vote, 0.5, toxic_share / 4))
        else:
            q = np.where(v.sum(axis=1) >= 2, 0.9, 0.02)
        # voters that agree beyond the class would pass for accurate; labelled rows show it best
        seen = known if n[known].sum() >= 100 else np.ones(len(v), bool)
        self.parent = self._tree(v[seen], n[seen], q[seen])
        for _ in range(self.rounds):
            self._maximise(v, lab, n, q)
            q = self._posterior(v, lab)
        return self

    def _maximise(self, v, lab, n, q):
        weight = np.stack([n * (1 - q), n * q])
        self.prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        s = self.smooth
        self.fires = np.zeros((self.m, 2, 2))  # voter, class, parent's vote
        for j in range(self.m):
            up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), np.int64)
            for y in (0, 1):
                for p in (0, 1):
                    w = weight[y] * (up == p)
                    self.fires[j, y, p] = ((w * v[:, j]).sum() + s) / (w.sum() + 2 * s)
        known = lab >= 0
        self.says = np.array([[((weight[y] * known * (lab == k)).sum() + (50 if k == y else 1)) / ((weight[y] * known).sum() + 51) for k in (0, 1)] for y in (0, 1)])

    def _tree(self, v, n, q) -> list[int]:
        """Maximum spanning tree of conditional mutual information given the class; weak links are left out."""
        gain = np.zeros((self.m, self.m))
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            total = w.sum() + 1e-9
            for a in range(self.m):
                for b in range(a):
                    for x in (0, 1):
                        for z in (0, 1):
                            both = (w * (v[:, a] == x) * (v[:, b] == z)).sum() / total
                            alone = (w * (v[:, a] == x)).sum() * (w * (v[:, b] == z)).sum() / total**2
                            if both > 0 and alone > 0:
                                gain[a, b] += total / n.sum() * both * np.log(both / alone)
        gain += gain.T
        parent, inside = [-1] * self.m, {0}
        while len(inside) < self.m:
            a, b = max(((a, b) for a in inside for b in range(self.m) if b not in inside), key=lambda ab: gain[ab])
            parent[b] = a if gain[a, b] > 1e-6 else -1
            inside.add(b)
        return parent

    def _posterior(self, v, lab):
        log = np.log(self.prior)[None, :].repeat(len(v), axis=0)
        for j in range(self.m):
            up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), np.int64)
            for y in (0, 1):
                p = self.fires[j, y][up]
                log[:, y] += np.log(np.where(v[:, j] == 1, p, 1 - p))
        known = lab >= 0
        for y in (0, 1):
            log[known, y] += np.log(self.says[y][lab[known]])
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        return self._posterior((votes[:, None] >> np.arange(self.m)) & 1, label.astype(np.int64))


def fit_logistic(rows: list[np.ndarray], target: np.ndarray, n_terms: int, l2: float = 0.01, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on present terms, by accelerated gradient steps on soft targets."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.concatenate(rows).astype(np.int64) if len(doc) else np.empty(0, np.int64)
    w, bias = np.zeros(n_terms), float(np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5)))
    often = np.bincount(term, minlength=n_terms) / max(1, len(rows)) + 1e-3
    step, past, past_bias = 0.5, w.copy(), bias
    for turn in range(rounds):
        ahead = turn / (turn + 3)
        look, look_bias = w + ahead * (w - past), bias + ahead * (bias - past_bias)
        z = np.bincount(doc, look[term], minlength=len(rows)) + look_bias
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        grad = np.bincount(term, miss[doc], minlength=n_terms) / max(1, len(rows))
        past, past_bias = w, bias
        w = look - step * (grad + l2 * often * look) / np.sqrt(often) / 4
        bias = look_bias - step * miss.mean()
    return w, bias


@dataclass
class Model:
    """Lexicon, weights of features and bias; ``score`` gives a column."""

    lexicon: dict[str, int]
    weights: dict[str, float]
    bias: float

    def score(self, text):
        """Score column of a text column, 0 to 1."""
        model, key = self, _key(self.lexicon)

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            voters = _voters(model.lexicon, key)
            for texts in batches:
                yield pd.Series([model.score_of(voters, t) for t in texts], dtype="float64")

        return scored(F.coalesce(text, F.lit("")))

    def score_of(self, voters: Voters, text: str) -> float:
        z = self.bias + sum(self.weights.get(name, 0.0) for name in voters.features(text)[1])
        return 1 / (1 + float(np.exp(-min(50.0, max(-50.0, z)))))


def feature_names(lexicon: dict[str, int]) -> list[str]:
    return sorted({f"={w}" for w in INSULTS} | set(lexicon)) + [f"voter {j}" for j in range(N_VOTERS - 1)] + [f"any {k}" for k in KINDS]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the label model and the classifier on the training rows of ``docs``."""
    kept, sample = labelled_sample(docs, labels)
    lexicon = mine_terms(sample)
    train = doc_texts(docs.where(id_remainder(MODULUS) != HELD_OUT)).join(F.broadcast(kept), F.col("doc_id") == F.col("labelled"), "left")
    counts = vote_counts(train.select("text", F.coalesce("toxic", F.lit(-1)).alias("label")), lexicon)
    if not len(counts):
        return Model(lexicon, {}, -4.0)
    model = LabelModel(N_VOTERS).fit(counts["votes"].to_numpy(), counts["label"].to_numpy(), counts["n"].to_numpy())
    names = feature_names(lexicon)
    number = {t: i for i, t in enumerate(names)}
    held, key = docs.sparkSession.sparkContext.broadcast((lexicon, number)), _key(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, num = held.value
        voters = _voters(lex, key)
        for batch in slices(batches):
            read = [voters.features(t.as_py()) for t in batch.column(0)]
            found = [sorted(num[x] for x in fs) for _, fs in read]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in read], pa.int64()), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["votes", "label", "found"])

    rows = sample.select("text", F.col("toxic").cast("long")).mapInArrow(run, "votes long, label long, found array<int>").toPandas()
    if len(rows):
        target = model.posterior(rows["votes"].to_numpy(), rows["label"].to_numpy())
        w, bias = fit_logistic([np.asarray(x, np.int64) for x in rows["found"]], target, len(names))
    else:
        w, bias = np.array([6.0 if t[0] == "=" else 0.0 for t in names]), -4.0
    return Model(lexicon, {t: float(x) for t, x in zip(names, w) if x}, bias)


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row."""
    scored = docs.select("doc_id", (id_remainder(MODULUS) == HELD_OUT).alias("held_out"), fit(docs, labels).score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored ``CUT`` or more; all columns as they came."""
    return docs.where(fit(docs, labels).score(docs["text"]) < CUT)
