"""Agglomeration in rounds, over pairs of blocks or a distributed matrix of distances.

A row of the matrix is a cluster with its distances to all others.  Ward,
complete and average linkage never bring two clusters nearer to a third than
both were, so that all pairs that are nearest to each other may merge at once:
one round folds the columns of all rows inside their tasks and brings together
the rows of pairs alone.  Rows are tables in the shared folder, a table a round.
Once few clusters are left, one task merges those.  Ward's linkage has the same
rounds without the matrix, because means and sizes tell its distances.  Single linkage is read off
the minimum spanning tree, which needs no matrix: every chain of leaves takes its
least edge to another one, read off lists of nearest leaves found over pairs of blocks.

What comes to the driver are sizes, nearest neighbours and merges: a few
numbers a leaf.  Vectors and distances never do.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.operators import pairwise
from sondeframe.sources.storage import checkpointed, shared_folder

METHODS = ("ward", "complete", "average", "single")
TAIL = 1024  # clusters that one task merges
TILE = 1024  # vectors on a side of the blocks in which distances are first found
PART_BYTES = 1 << 26
TASK_PAIRS = 40_000_000  # pairs of clusters to a task of a round of ward's linkage, about
LISTED = 8  # nearest leaves of other chains in a leaf's list
NOBODY = np.iinfo(np.int32).max

_ROW = "node int, d array<double>, near int, height double"


def _combine(method: str, da, db, a, b, s, h):
    """Distances to the union of clusters of sizes a and b, h apart, from clusters of size s (of ward: squares)."""
    if method == "ward":
        return ((a + s) * da + (b + s) * db - s * h) / (a + b + s)
    return (a * da + b * db) / (a + b) if method == "average" else np.maximum(da, db)


def _rows(nodes: np.ndarray, d: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """Rows with their nearest clusters, of equal ones the first."""
    d[np.arange(len(nodes)), np.searchsorted(names, nodes)] = np.inf
    at = d.argmin(axis=1)
    return pd.DataFrame({"node": nodes, "d": list(d), "near": names[at], "height": d[np.arange(len(nodes)), at]})


@dataclass(frozen=True)
class _Round:
    """Names and sizes of the columns, the names they go by afterwards, and the pairs (positions, distance)."""

    method: str
    names: np.ndarray
    sizes: np.ndarray
    goes_by: np.ndarray
    left: np.ndarray
    right: np.ndarray
    apart: np.ndarray

    def after(self) -> np.ndarray:
        return self.names[self.goes_by == self.names]

    def sizes_after(self) -> np.ndarray:
        total = np.zeros(len(self.names))
        np.add.at(total, np.searchsorted(self.names, self.goes_by), self.sizes)
        return total[self.goes_by == self.names]

    def folded(self, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Columns of pairs made one, for rows of sizes ``own``."""
        new = d[:, self.goes_by == self.names]
        a, b = self.left, self.right
        new[:, np.searchsorted(self.after(), self.names[a])] = _combine(self.method, d[:, a], d[:, b], self.sizes[a], self.sizes[b], own[:, None], self.apart)
        return new

    def others(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                nodes = batch["node"].to_numpy()
                yield _rows(nodes, self.folded(np.stack(batch["d"]), self.sizes[np.searchsorted(self.names, nodes)]), self.after())

    def united(self, pair: pd.DataFrame) -> pd.DataFrame:
        """The row of a pair.  Against another pair the later one is united first, on both sides, so that the matrix stays symmetric to the last bit."""
        pair = pair.sort_values("node")
        at = np.searchsorted(self.names, pair["node"].to_numpy())
        (a, b), d = self.sizes[at], np.stack(pair["d"])
        h = self.apart[np.searchsorted(self.names[self.left], self.names[at[0]])]
        columns_first = self.folded(d, self.sizes[at])
        columns_first = _combine(self.method, columns_first[0], columns_first[1], a, b, self.sizes_after(), h)
        rows_first = self.folded(_combine(self.method, d[0], d[1], a, b, self.sizes, h)[None], np.array([a + b]))[0]
        node = self.names[at[:1]]
        return _rows(node, np.where(self.after() > node, columns_first, rows_first)[None], self.after())

    def apply(self, rows: DataFrame) -> DataFrame:
        merging = np.concatenate([self.left, self.right])
        named = [(int(n), int(g)) for n, g in zip(self.names[merging], self.goes_by[merging], strict=True)]
        pairs = F.broadcast(rows.sparkSession.createDataFrame(named, "node int, pair int"))  # two numbers a leaf at most
        rest = rows.join(pairs, "node", "left_anti").select("node", "d").mapInPandas(self.others, _ROW)
        return rest.unionByName(rows.join(pairs, "node").select("pair", "node", "d").groupBy("pair").applyInPandas(lambda pair: self.united(pair), _ROW))


def _distances(leaves: DataFrame, n: int) -> DataFrame:
    """(node, d): of each leaf the distances to all, in order; the matrix is found in tiles."""
    keyed = leaves.withColumn("own", F.floor(F.col("leaf") / TILE).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // TILE)))
    left, right = keyed.select(F.col("own").alias("r"), every.alias("c"), "leaf", "x"), keyed.select(every.alias("r"), F.col("own").alias("c"), "leaf", "x")

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("leaf"), b.sort_values("leaf")
        x, y = np.stack(a["x"]), np.stack(b["x"])
        d = np.zeros((len(a), len(b)))
        for k in range(x.shape[1]):  # in one order for both triangles
            d += np.subtract.outer(x[:, k], y[:, k]) ** 2
        return pd.DataFrame({"node": a["leaf"], "c": b["c"].iloc[0], "d": list(np.sqrt(d))})

    tiles = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(tile, "node int, c int, d array<double>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "d"))), lambda t: t["d"]))
    return tiles.repartition(max(1, 8 * n * n // PART_BYTES), "node").groupBy("node").agg(whole.alias("d"))


def _nearest(names: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        for batch in batches:
            if len(batch):
                yield _rows(batch["node"].to_numpy(), np.stack(batch["d"]), names)

    return run


def _last(method: str, names: np.ndarray, sizes: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Merges (step, a, b, height) of the clusters that are left, one after another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        d, size, alive, out = np.stack(rows["d"]), sizes.copy(), np.ones(len(rows), dtype=bool), []
        np.fill_diagonal(d, np.inf)
        for step in range(len(rows) - 1):
            i, j = sorted(divmod(int(d.argmin()), len(rows)))
            h, a, b = d[i, j], size[i], size[j]
            alive[j] = False
            new = np.full(len(rows), np.inf)
            new[alive] = _combine(method, d[i, alive], d[j, alive], a, b, size[alive], h)
            new[i] = np.inf
            d[i], d[:, i], d[j], d[:, j], size[i] = new, new, np.inf, np.inf, a + b
            out.append((step, names[i], names[j], h))
        return pd.DataFrame(out, columns=["step", "a", "b", "height"])

    return run


def _chains(names: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The least name of each chain of nearest neighbours, by pointer jumping."""
    to = np.searchsorted(names, near)
    own = np.arange(len(names))
    to = np.where((to[to] == own) & (own < to), own, to)  # of a mutual pair the first is the root
    while (to[to] != to).any():
        to = to[to]
    least = np.full(len(names), len(names))
    np.minimum.at(least, to, own)
    return names[least[to]]


def _shortest(group: np.ndarray, square: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Positions of the LISTED least (square, node) of each group; in the order of the groups, which have so many at least."""
    order = np.lexsort((node, square, group))
    ends = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
    rank = np.arange(len(order)) - np.repeat(ends, np.diff(np.r_[ends, len(order)]))
    return order[rank < LISTED]


class _Lists:
    """Of the leaves of a block the LISTED nearest ones of other chains, of equally near ones the first; without so many, the rest is infinitely far."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes = nodes
        self.square, self.near = np.full((len(nodes), LISTED), np.inf), np.full((len(nodes), LISTED), NOBODY, dtype=np.int32)

    def take(self, at: np.ndarray, d: np.ndarray, axis: int, x: np.ndarray, y: np.ndarray, others: np.ndarray, noise: float) -> None:
        """Squares ``d`` of the rows ``at``, which are on that axis, to others, good to the noise; what comes near enough is taken again exactly."""
        limit = self.square[at, -1]
        open_ = np.flatnonzero(np.isinf(limit))
        if len(open_) and d.shape[1 - axis] > LISTED:
            limit[open_] = np.partition(d.take(open_, axis), LISTED - 1, 1 - axis).take(LISTED - 1, 1 - axis)
        limit = np.minimum(limit + noise, np.finfo(float).max)
        found = np.nonzero(d <= np.expand_dims(limit, 1 - axis))
        i, j = found[axis], found[1 - axis]
        if not len(i):
            return
        rows = np.unique(i)
        own = at[rows]
        group = np.concatenate([np.repeat(rows, LISTED), i])
        square, near = np.concatenate([self.square[own].ravel(), pairwise.exact(x[at[i]], y[j])]), np.concatenate([self.near[own].ravel(), others[j]])
        kept = _shortest(group, square, near)
        self.square[own], self.near[own] = square[kept].reshape(-1, LISTED), near[kept].reshape(-1, LISTED)


def _listed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of the leaves that ask, by block, as far as a task's pairs of blocks know them."""

    def run(batches):
        chain, asking = shared.value
        lists: dict[int, _Lists] = {}

        def side(batch: pa.RecordBatch, s: str, r: int) -> tuple[np.ndarray, _Lists, np.ndarray]:
            at, nodes = batch.column(s)[r].as_py(), np.frombuffer(batch.column(f"{s}_cell")[r].as_py(), np.int32)
            if at not in lists:
                lists[at] = _Lists(nodes)
            return np.frombuffer(batch.column(f"{s}_x")[r].as_py()).reshape(len(nodes), -1), lists[at], np.flatnonzero(asking[nodes])

        for batch in batches:
            for r in range(batch.num_rows):
                (x, own, mine), (y, other, theirs) = side(batch, "a", r), side(batch, "b", r)
                noise = 1e-13 * ((x**2).sum(axis=1).max() + (y**2).sum(axis=1).max()) if x.shape[1] > pairwise.NARROW else 0.0
                one, meeting = own is other, len(np.intersect1d(chain[own.nodes], chain[other.nodes])) > 0
                both = not one and len(mine) == len(x) and len(theirs) > 0  # then distances serve either side
                looks = [(x, own, mine, y, other)] if one or both else [(x, own, mine, y, other), (y, other, theirs, x, own)]
                for p, asks, rows, q, answers in looks:
                    for k in range(0, len(rows), pairwise.SIDE):
                        at = rows[k : k + pairwise.SIDE]
                        d = pairwise.squares(p[at], q)
                        if meeting:
                            d[chain[asks.nodes[at]][:, None] == chain[answers.nodes]] = np.inf
                        asks.take(at, d, 0, p, q, answers.nodes, noise)
                        if both:
                            answers.take(theirs, d[:, theirs] if len(theirs) < len(q) else d, 1, q, p[at], asks.nodes[at], noise)
        yield from _sent((at, own.nodes[some], own.square[some], own.near[some]) for at, own in lists.items() if (some := np.isfinite(own.square[:, 0])).any())

    return run


_LISTS = "block long, nodes binary, square binary, near binary"


def _sent(lists) -> Iterator[pa.RecordBatch]:
    for block, *arrays in lists:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], names=["block", "nodes", "square", "near"])


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves, squares and nearest leaves, a row a leaf."""
    read = lambda name, kind: np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(name).combine_chunks()])
    return read("nodes", np.int32), read("square", np.float64).reshape(-1, LISTED), read("near", np.int32).reshape(-1, LISTED)


def _joined(table: pa.Table) -> pa.Table:
    """The lists of a block's leaves, from all tasks that met it."""
    nodes, square, near = _received(table)
    kept = _shortest(np.repeat(nodes, LISTED), square.ravel(), near.ravel())
    return pa.Table.from_batches(_sent([(table.column("block")[0].as_py(), np.unique(nodes), square.ravel()[kept], near.ravel()[kept])]))


def _spanning(leaves: DataFrame, n: int) -> list[tuple[int, int, float]]:
    """Edges (a, b, height) of the minimum spanning tree, without a matrix, in few passes over pairs of blocks.

    A pass lists the nearest leaves of other chains for every leaf that asks.
    A chain takes its least edge as long as none that isn't listed can be less;
    when no chain can, leaves whose lists are used up ask again, but for those
    of the largest chain, because the others take theirs.  Lists come to the
    driver, LISTED squares and leaves for each.
    """
    rows = leaves.select(F.col("leaf").cast("int").alias("profile_id"), "x", F.col("leaf").cast("int").alias("cell"))
    blocks = pairwise.packed(rows, n, leaves.select(F.size("x")).first()[0])
    chain, asking, found = np.arange(n), np.ones(n, dtype=bool), []
    square, near = np.full((n, LISTED), np.inf), np.full((n, LISTED), NOBODY, dtype=np.int32)
    while asking.any():
        shared = leaves.sparkSession.sparkContext.broadcast((chain, asking))
        parts = pairwise.met(blocks, ["x", "cell"]).mapInArrow(_listed(shared), _LISTS)
        nodes, *lists = _received(parts.groupBy("block").applyInArrow(_joined, _LISTS).toArrow())
        shared.destroy()
        square[nodes], near[nodes] = lists
        chain, edges, asking = _taken(chain, square, near)
        found += edges
    return found


def _taken(chain: np.ndarray, square: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]], np.ndarray]:
    """The chains after all edges that the lists prove, those edges, and which leaves must ask."""
    found, every = [], np.arange(len(chain))
    while True:
        names, at = np.unique(chain, return_inverse=True)
        if len(names) == 1:
            return chain, found, np.zeros(len(chain), dtype=bool)
        other = (near != NOBODY) & (chain[np.where(near != NOBODY, near, 0)] != chain[:, None])
        some, place = other.any(axis=1), other.argmax(axis=1)
        ends, height = near[every, place], np.where(some, square[every, place], np.inf)
        order = np.lexsort((np.maximum(every, ends), np.minimum(every, ends), height, at))
        least = order[np.r_[True, np.diff(at[order]) > 0]]  # a leaf of each chain
        unlisted = np.where(some, np.inf, square[:, -1])
        bound = np.full(len(names), np.inf)
        np.minimum.at(bound, at, unlisted)
        sure = np.flatnonzero(height[least] < bound)
        if not len(sure):
            largest = np.bincount(at).argmax()
            return chain, found, np.isfinite(unlisted) & (unlisted <= height[least][at]) & (at != largest)
        node = least[sure]
        to = names.copy()
        to[sure] = chain[ends[node]]
        once = (to[np.searchsorted(names, to[sure])] != names[sure]) | (names[sure] < to[sure])
        found += zip(node[once].tolist(), ends[node[once]].tolist(), np.sqrt(height[node[once]]).tolist(), strict=True)
        chain = _chains(names, to)[at]


def _ward_squares(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared heights at which clusters of means x, y and sizes p, q would merge; columns in one order, so that both ways give the same bits."""
    total, step = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for k in range(x.shape[1]):
        np.subtract.outer(x[:, k], y[:, k], out=step)
        step *= step
        total += step
    np.multiply.outer(p, q, out=step)
    step /= np.add.outer(p, q)
    step *= 2
    total *= step
    return total


def _ward_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, height, near): of each cluster the nearest one that a task's pairs of blocks know, of equally near ones the first."""
    best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def side(batch: pa.RecordBatch, s: str, r: int) -> tuple[np.ndarray, ...]:
        nodes = np.frombuffer(batch.column(f"{s}_cell")[r].as_py(), np.int32)
        order = nodes.argsort()
        x = np.frombuffer(batch.column(f"{s}_x")[r].as_py()).reshape(len(nodes), -1)[order]
        found = best.setdefault(batch.column(s)[r].as_py(), (nodes[order], np.full(len(nodes), np.inf), np.full(len(nodes), NOBODY, dtype=np.int32)))
        return x, np.frombuffer(batch.column(f"{s}_weight")[r].as_py())[order], *found

    def nearer(height: np.ndarray, near: np.ndarray, at: slice, d: np.ndarray, axis: int, others: np.ndarray) -> None:
        place = d.argmin(axis=axis)
        new, who = np.take_along_axis(d, np.expand_dims(place, axis), axis).ravel(), others[place]
        better = (new < height[at]) | ((new == height[at]) & (who < near[at]))
        height[at][better], near[at][better] = new[better], who[better]

    for batch in batches:
        for r in range(batch.num_rows):
            (x, p, nodes, height, near), (y, q, others, far, next_) = side(batch, "a", r), side(batch, "b", r)
            one = nodes is others
            for k in range(0, len(x), pairwise.SIDE):
                at = slice(k, min(k + pairwise.SIDE, len(x)))
                d = _ward_squares(x[at], p[at], y, q)
                if one:
                    d[np.arange(len(d)), np.arange(len(d)) + k] = np.inf
                nearer(height, near, at, d, 1, others)
                if not one:
                    nearer(far, next_, slice(0, len(y)), d, 0, nodes[at])
    for nodes, height, near in best.values():
        some = np.isfinite(height)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(height[some]), pa.array(near[some])], names=["node", "height", "near"])


def _ward(leaves: DataFrame, names: np.ndarray, sizes: np.ndarray, tail: int) -> list[tuple[int, int, float]]:
    """Merges (a, b, squared height) by ward's linkage, without a matrix: clusters are their means and sizes, which tell all distances.

    A round finds each cluster's nearest one over pairs of blocks, and merges all pairs that are nearest to each other.
    """
    found = []
    rows = checkpointed(leaves.select(F.col("leaf").cast("int").alias("node"), "x", F.col("n").cast("double").alias("n")))
    d = rows.select(F.size("x")).first()[0]
    while len(names) > max(tail, 2):
        blocks = pairwise.packed(rows.select(F.col("node").alias("profile_id"), "x", F.col("node").alias("cell"), F.col("n").alias("weight")), len(names), d, parts=min(pairwise.PARTS, math.isqrt(len(names) ** 2 // TASK_PAIRS)))
        parts = pairwise.met(blocks, ["x", "cell", "weight"]).mapInArrow(_ward_nearest, "node int, height double, near int")
        ends = parts.groupBy("node").agg(F.min(F.struct("height", "near")).alias("e")).select("node", "e.height", "e.near").toArrow().sort_by("node")  # three numbers a cluster
        near, height = ends.column("near").to_numpy(), ends.column("height").to_numpy()
        edges = (near[np.searchsorted(names, near)] == names) & (names < near)
        left, right = names[edges], near[edges]
        found += zip(left.tolist(), right.tolist(), height[edges].tolist(), strict=True)
        later = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"node": right, "pair": left})))  # two numbers a pair
        own = rows.join(later, "node", "left").groupBy(F.coalesce("pair", "node").alias("to")).agg(F.array_sort(F.collect_list(F.struct("node", "x", "n"))).alias("of"))
        a, b = F.col("of")[0], F.get("of", F.lit(1))
        mean = F.zip_with(a["x"], b["x"], lambda u, v: (a["n"] * u + b["n"] * v) / (a["n"] + b["n"]))
        rows = checkpointed(own.select(F.col("to").alias("node"), F.when(F.size("of") == 2, mean).otherwise(a["x"]).alias("x"), (a["n"] + F.coalesce(b["n"], F.lit(0.0))).alias("n")))
        total = sizes.copy()
        total[np.searchsorted(names, left)] += sizes[np.searchsorted(names, right)]
        stay = ~np.isin(names, right)
        names, sizes = names[stay], total[stay]
    if len(names) > 1:
        last = _last("ward", names, sizes)

        def matrix(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("node")
            x, n = np.stack(own["x"]), own["n"].to_numpy()
            return last(pd.DataFrame({"node": own["node"], "d": list(_ward_squares(x, n, x, n))}))

        ends = rows.groupBy().applyInPandas(matrix, "step int, a int, b int, height double")  # tail rows
        found += [(r["a"], r["b"], r["height"]) for r in ends.orderBy("step").collect()]
    return found


def agglomerate(leaves: DataFrame, method: str = "ward", tail: int = TAIL) -> list[tuple[int, int, float, int]]:
    """Merges (left, right, height, size) in order of height; ids of merges go on from the leaves'.

    ``leaves`` is (leaf from 0, x, n): different vectors and how often each occurs.
    By complete and average linkage the matrix takes 8 bytes for a pair of leaves over all tasks
    and shrinks by rounds, by the others there is none; of equally near clusters those of the first leaves merge first.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    spark = leaves.sparkSession
    first = leaves.select("leaf", "n").toArrow().sort_by("leaf")  # two numbers a leaf
    names, weights = first.column("leaf").to_numpy().astype(np.int32), first.column("n").to_pylist()
    sizes = np.array(weights, dtype=float)
    if len(names) < 2:
        return []
    if method == "single":
        return _in_order(_spanning(leaves, len(names)), weights, method)
    if method == "ward":
        return _in_order(_ward(leaves, names, sizes, tail), weights, method)
    folder, found = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}", []
    rows = _distances(leaves, len(names))
    rows = rows.mapInPandas(_nearest(names), _ROW)
    for step in range(len(names)):
        rows.write.parquet(f"{folder}/{step}")
        rows = spark.read.schema(_ROW).parquet(f"{folder}/{step}")
        if len(names) <= max(tail, 2):
            break
        ends = rows.select("node", "near", "height").toPandas().sort_values("node")  # three numbers a cluster
        near, height = ends["near"].to_numpy(), ends["height"].to_numpy()
        mutual = near[np.searchsorted(names, near)] == names
        edges = mutual & (names < near)
        goes_by = np.where(mutual, np.minimum(names, near), names)
        left, right = np.flatnonzero(edges), np.searchsorted(names, near[edges])
        found += zip(names[left].tolist(), names[right].tolist(), height[edges].tolist(), strict=True)
        this = _Round(method, names, sizes, goes_by, left, right, height[edges])
        rows, names, sizes = this.apply(rows), this.after(), this.sizes_after()
    if len(names) > 1:
        ends = rows.select("node", "d").groupBy().applyInPandas(_last(method, names, sizes), "step int, a int, b int, height double")  # tail rows
        found += [(r["a"], r["b"], r["height"]) for r in ends.orderBy("step").collect()]
    return _in_order(found, weights, method)


def _in_order(found: list[tuple[int, int, float]], weights: list[int], method: str) -> list[tuple[int, int, float, int]]:
    if method != "single":  # a merge is never below its parts, even by rounding
        top, raised = [0.0] * len(weights), []
        for a, b, h in found:
            top[min(a, b)] = h = max(h, top[a], top[b])
            raised.append((a, b, math.sqrt(h) if method == "ward" else h))
        found = raised
    parent, size = list(range(2 * len(weights) - 1)), list(weights)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    merges = []
    for a, b, h in sorted(found, key=lambda m: m[2]):
        left, right = sorted((root(a), root(b)))
        parent[left] = parent[right] = len(size)
        size.append(size[left] + size[right])
        merges.append((left, right, h, size[-1]))
    return merges
