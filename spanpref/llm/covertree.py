"""Operator 1: embedding near-duplicates, exact pairs over a cosine threshold by cover trees.

Vectors are scaled to length one, where cosine >= c is a distance of at most
``sqrt(2 - 2c)``. Equal vectors of a label are one class.

The upper levels of the tree are laid over the cluster. A label's vectors are the
first node. A node of more than ``NODE_ROWS`` vectors is split by pivots at half its
radius or less (a net over a bounded sample of its own vectors, ``FANOUT`` at most) into
nodes of the next level, which know their covering radius, until nodes are small.
Pairs of nodes go down level by level: the pairs of a level's children whose pivots lie
further apart than both radii and the threshold are pruned, so only pairs that may hold a
link reach the next level, and no vector moves before. Splitting is dealt by node and,
in large nodes, by hash; nothing that grows with the data is broadcast. At the end a
vector goes only where its own distance to the other node's pivot allows links. A node
that no pivot can split (vectors equal but for rounding) is dealt by hash into parts that
all meet.

The lower levels are built where a pair of nodes meets: nested cover levels
with halving radii on both sides, traversed together; pairs of tree nodes
further apart than their radii and the threshold are pruned, what is left is
compared exactly in double precision. A task sends on link counts per class and
a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are their own
component; vectors of different length never link; repeated rows are copies;
a null vec_id names no component unless there is no other; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanpref.llm.common import components, dealt_anew, slices, staged

THRESHOLD = 0.98
#: Vectors in a node that is small, children of a node, vectors that choose them, vectors a task assigns at a time.
NODE_ROWS, FANOUT, SAMPLE_ROWS, CHUNK_ROWS = 1_024, 32, 512, 16_384
#: Vectors in a leaf of the trees that are built inside a task.
LEAF = 24
#: Rounding allowance of distances; bounds are loosened by it, links are decided by the cosine itself.
_SLACK = 1e-7


class Tree:
    """Cover tree over the rows of ``x``: nested levels with halving radii.

    A node has a centre (one of its rows), the rows it covers and their true
    largest distance. Children of a node of level radius r are a net: centres
    more than r / 2 apart, every row with one at most r / 2 away.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.centre: list[int] = []
        self.radius: list[float] = []
        if len(x):
            far = _distances(x, x[0])
            self._add(0, np.arange(len(x)), far, max(1e-9, float(far.max())))

    def _add(self, centre: int, rows: np.ndarray, far: np.ndarray, level: float) -> int:
        """Append the node and, below it, its net; levels that part nothing are passed over."""
        top = len(self.rows)
        todo = [(centre, rows, far, level, -1)]
        while todo:
            centre, rows, far, level, parent = todo.pop()
            number = len(self.rows)
            radius = float(far.max())
            self.children.append([])
            self.rows.append(rows)
            self.centre.append(centre)
            self.radius.append(radius)
            if parent >= 0:
                self.children[parent].append(number)
            if len(rows) <= LEAF or radius < 1e-9:
                continue
            half = min(level, radius) / 2
            left, reach, next_centre = rows, far, centre
            while len(left):
                near = reach <= half
                todo.append((next_centre, left[near], reach[near], half, number))
                left = left[~near]
                if len(left):
                    next_centre = int(left[0])
                    reach = _distances(self.x[left], self.x[next_centre])
        return top


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ centre)))


def links(a: Tree, b: Tree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs ``(i, j)`` of two trees with cosine >= threshold; of one tree with itself, i < j only."""
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + _SLACK
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not a.rows or not b.rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        twin = same and p == q  # a node with itself: every unordered pair once
        ups, downs = a.children[p], b.children[q]
        if not ups and not downs or len(a.rows[p]) * len(b.rows[q]) <= LEAF * LEAF:
            i, j = np.nonzero(a.x[a.rows[p]] @ b.x[b.rows[q]].T >= threshold)
            i, j = a.rows[p][i], b.rows[q][j]
            found.append((i[i < j], j[i < j]) if twin else (i, j))
            continue
        one, two = ups or [p], downs or [q]
        r1, r2 = np.array([a.radius[k] for k in one]), np.array([b.radius[k] for k in two])
        n1, n2 = np.array([len(a.rows[k]) for k in one]), np.array([len(b.rows[k]) for k in two])
        c1, c2 = np.array([a.centre[k] for k in one]), np.array([b.centre[k] for k in two])
        cosine = a.x[c1] @ b.x[c2].T
        near = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine)) <= r1[:, None] + r2[None, :] + reach
        if twin:
            near = np.triu(near)
        single = (n1 == 1)[:, None] & (n2 == 1)[None, :]  # centres of single points are the points
        s, t = np.nonzero(near & single & (cosine >= threshold))
        if twin:
            s, t = s[s < t], t[s < t]
        found.append((c1[s], c2[t]))
        s, t = np.nonzero(near & ~single)
        todo += [(one[k], two[m]) for k, m in zip(s.tolist(), t.tolist())]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links."""
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    kept = []
    for s, t in zip(i.tolist(), j.tolist()):
        s, t = root(s), root(t)
        if s != t:
            parent[t] = s
            kept.append((s, t))
    return kept


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows of a net of ``x`` with half its radius, each the row farthest from those before it."""
    picked, reach = [0], _distances(x, x[0])
    half = max(float(reach.max()) / 2, 1e-6)
    while len(picked) < most and reach.max() > half:
        picked.append(int(reach.argmax()))
        reach = np.minimum(reach, _distances(x, x[picked[-1]]))
    return x[picked]


def unit(values: pa.Scalar) -> list[float] | None:
    """A vector scaled to length one in double precision; None if it can't link."""
    if not values.is_valid or not len(values.values) or values.values.null_count:
        return None
    x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return (x / math.sqrt(float(x @ x))).tolist()


def scaled(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, x)`` per row; ``x`` is the vector scaled to length one, null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [unit(v) if known.is_valid else None for known, v in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["vec_id", "label", "x"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, x array<double>")


def _gap(a, b):
    """Distance of two columns of vectors of length one."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * dot))


def _split(rows: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of crowded nodes dealt to their children, and the children ``(parent, node, centre, radius, size, stuck)``."""
    own = rows.join(crowded.select(F.col("node").alias("o"), "size"), F.col("node") == F.col("o"))
    kind = rows.schema["label"].dataType.simpleString()

    def net(group: pd.DataFrame) -> pd.DataFrame:
        most = min(FANOUT, 2 * -(-int(group["size"].iloc[0]) // NODE_ROWS))
        group = group.sort_values("class")
        pivots = pivots_of(np.stack(group["x"].to_numpy()), most)
        return pd.DataFrame({"node": group["node"].iloc[0], "kid": np.arange(len(pivots), dtype=np.int32), "centre": list(pivots)})

    sample = own.where(F.pmod(F.xxhash64("class", F.lit(1)), F.col("size")) < SAMPLE_ROWS).select("node", "size", "class", "x")
    pivots = staged(sample.groupBy("node").applyInPandas(net, "node string, kid int, centre array<double>"), "cover-pivots")

    def deal(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return mine.assign(far=0.0)[names]
        x, known = np.stack(mine["x"].to_numpy()), known.sort_values("kid")
        if len(known):
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ np.stack(known["centre"].to_numpy()).T)))
            nearest = gap.argmin(axis=1)
            far, kid = gap[np.arange(len(x)), nearest], known["kid"].to_numpy()[nearest]
        else:  # no vector of the node was in the sample
            far, kid = np.full(len(x), 2.0), np.zeros(len(x), np.int32)
        return mine.assign(far=far, node=[f"{n}/{k}" for n, k in zip(mine["node"], kid)])[names]

    names = ["label", "dim", "x", "class", "n", "node", "far"]
    parts = F.ceil(F.col("size") / CHUNK_ROWS).cast("int")
    left = own.select(*names[:6], F.pmod(F.xxhash64("class"), parts).cast("int").alias("part")).groupBy("node", "part")
    sent = pivots.join(crowded.select(F.col("node").alias("o"), parts.alias("parts")), F.col("node") == F.col("o"))
    right = sent.select("node", "kid", "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).groupBy("node", "part")
    moved = staged(left.cogroup(right).applyInPandas(deal, f"label {kind}, dim int, x array<double>, class long, n long, node string, far double"), "cover-moved")
    found = moved.groupBy("node").agg(F.max("far").alias("radius"), F.count("*").alias("size"))
    centres = pivots.select(F.concat_ws("/", "node", F.col("kid").cast("string")).alias("c"), "centre")
    above = crowded.select(F.col("node").alias("a"), F.col("size").alias("before"))
    kids = found.withColumn("parent", F.regexp_replace("node", "/[0-9]+$", "")).join(centres, F.col("node") == F.col("c"), "left").join(above, F.col("parent") == F.col("a"))
    return moved, staged(kids.select("parent", "node", "centre", "radius", "size", (F.col("size") == F.col("before")).alias("stuck")), "cover-kids")


def _levels(classes: DataFrame, reach: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes in their last nodes, these nodes, and the pairs of them that may hold links."""
    node = F.concat_ws(":", F.col("label").cast("string"), F.col("dim").cast("string"))
    rows = classes.select("label", "dim", "x", "class", "n", node.alias("node"), F.lit(2.0).alias("far"))
    vector = F.lit(None).cast("array<double>")
    nodes = rows.groupBy("node").agg(F.max("far").alias("radius"), F.count("*").alias("size"))
    nodes = staged(nodes.select("node", vector.alias("centre"), "radius", "size", F.lit(False).alias("stuck")), "cover-roots")
    pairs = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
    settled, leaves = None, None
    while True:
        open_ = (F.col("size") > NODE_ROWS) & (F.col("radius") > 1e-6) & ~F.col("stuck")
        crowded = nodes.where(open_)
        done = nodes.where(~open_)
        leaves = done if leaves is None else leaves.unionByName(done)
        if crowded.isEmpty():
            settled = rows if settled is None else settled.unionByName(rows)
            return settled, leaves, pairs
        rest = rows.join(crowded.select(F.col("node").alias("o")), F.col("node") == F.col("o"), "left_anti")
        settled = rest if settled is None else settled.unionByName(rest)
        rows, kids = _split(rows, crowded)
        # a pair goes on as the pairs of both sides' children; a node that stays is its own only child
        below = kids.select("parent", "node", "centre", "radius").unionByName(leaves.select(F.col("node").alias("parent"), "node", "centre", "radius"))
        one, two = (below.select(*[F.col(c).alias(f"{side}_{c}") for c in below.columns]) for side in "ab")
        met = pairs.join(one, F.col("a") == F.col("a_parent")).join(two, F.col("b") == F.col("b_parent"))
        met = met.where((F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node")))
        apart = _gap(F.col("a_centre"), F.col("b_centre")) > F.col("a_radius") + F.col("b_radius") + reach
        met = met.where((F.col("a_node") == F.col("b_node")) | ~F.coalesce(apart, F.lit(False)))
        pairs = staged(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "cover-node-pairs")
        nodes = kids.drop("parent")


def _met(classes: DataFrame, reach: float) -> DataFrame:
    """``(pair, side, same, class, x, n)``: for every pair of nodes that may hold links, the vectors of both that may link there."""
    placed, leaves, pairs = _levels(classes, reach)
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / NODE_ROWS)).cast("int")  # one, but for nodes that couldn't be split
    known = staged(leaves.select("node", "centre", "radius", parts.alias("parts")), "cover-leaves")
    one, two = (known.select(*[F.col(c).alias(f"{side}_{c}") for c in known.columns]) for side in "ab")
    each = pairs.join(one, F.col("a") == F.col("a_node")).join(two, F.col("b") == F.col("b_node"))
    each = each.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1))).withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1)))
    each = each.where((F.col("a") != F.col("b")) | (F.col("a_part") <= F.col("b_part")))
    met = staged(each.select("a", "b", "a_part", "b_part", "a_centre", "b_centre", "a_radius", "b_radius", F.monotonically_increasing_id().alias("pair")), "cover-pairs")
    same = (F.col("a") == F.col("b")) & (F.col("a_part") == F.col("b_part"))

    def sent(side: str, other: str, number: int) -> DataFrame:
        return met.where(F.lit(True) if not number else ~same).select(
            "pair", F.lit(number).alias("side"), same.alias("same"), F.col(side).alias("k"), F.col(f"{side}_part").alias("k_part"),
            F.when(F.col("a") != F.col("b"), F.col(f"{other}_centre")).alias("to"), F.col(f"{other}_radius").alias("to_radius"),
        )

    whole = placed.join(known.select(F.col("node").alias("l"), "parts"), F.col("node") == F.col("l"))
    own = whole.select("class", "x", "n", "node", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"))
    every = sent("a", "b", 0).unionAll(sent("b", "a", 1))
    moved = own.join(every, (F.col("node") == F.col("k")) & (F.col("part") == F.col("k_part")))
    near = F.col("to").isNull() | (_gap(F.col("x"), F.col("to")) <= F.col("to_radius") + reach)
    return moved.where(near).select("pair", "side", "same", "class", "x", "n")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row."""
    rows = staged(scaled(vectors), "cover-scaled")
    grouped = rows.where("x is not null").groupBy("label", "x").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    numbered = staged(grouped.select("label", F.size("x").alias("dim"), "x", "first", "n", F.monotonically_increasing_id().alias("class")), "cover-classes")
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + _SLACK
    moved = _met(numbered, reach)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = group[group["side"] == 0]
        x = np.stack(first["x"].to_numpy()) if len(first) else None
        if x is None or not bool(group["same"].iloc[0]) and len(first) == len(group):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if bool(group["same"].iloc[0]):
            ids, n = first["class"].to_numpy(), first["n"].to_numpy()
            tree = Tree(x)
            i, j = links(tree, tree, threshold, True)
        else:
            second = group[group["side"] == 1]
            ids, n = np.concatenate([first["class"], second["class"]]), np.concatenate([first["n"], second["n"]])
            i, j = links(Tree(x), Tree(np.stack(second["x"].to_numpy())), threshold, False)
            j = j + len(first)
        count = np.bincount(i, n[j], len(ids)).astype(np.int64) + np.bincount(j, n[i], len(ids)).astype(np.int64)
        linked = np.flatnonzero(count)
        edges = forest(len(ids), i, j)
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[linked], ids[[e[0] for e in edges]] if edges else ids[:0]]),
                "b": np.concatenate([ids[linked], ids[[e[1] for e in edges]] if edges else ids[:0]]),
                "links": np.concatenate([count[linked], np.zeros(len(edges), np.int64)]),
            }
        )

    told = staged(moved.groupBy("pair").applyInPandas(compare, "a long, b long, links long"), "cover-links")
    counts = told.where("a = b").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("c"), "links")
    tree = components(told.where("a <> b").select("a", "b"), "cover-components").select(F.col("node").alias("m"), "component")
    named = numbered.select("class", "label", "x", "first", "n").join(counts, F.col("class") == F.col("c"), "left").join(tree, F.col("class") == F.col("m"), "left")
    named = named.select("class", "label", "x", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id")).select(dealt_anew("root").alias("r"), "component_id")
    known = named.join(least, F.col("root") == F.col("r")).select(F.col("label").alias("l"), F.col("x").alias("v"), "n_links", "component_id")
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("x") == F.col("v")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
