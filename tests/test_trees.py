"""Hierarchies from rounds over a distributed matrix, against a plain agglomeration."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from sondeframe.operators import cluster as K
from sondeframe.operators import trees

METHODS = ["ward", "complete", "average", "single"]


def plain(x: np.ndarray, weights: list[int], method: str) -> list[tuple[float, frozenset]]:
    """(height, members) of each merge, from the vectors of two groups each time."""

    def cost(a: list[int], b: list[int]) -> float:
        if method == "ward":
            p, q = sum(weights[i] for i in a), sum(weights[j] for j in b)
            gap = sum(weights[i] * x[i] for i in a) / p - sum(weights[j] * x[j] for j in b) / q
            return np.sqrt(2 * p * q / (p + q)) * np.linalg.norm(gap)
        far = [(np.linalg.norm(x[i] - x[j]), weights[i] * weights[j]) for i in a for j in b]
        if method == "average":
            return sum(d * w for d, w in far) / sum(w for _, w in far)
        return (max if method == "complete" else min)(d for d, _ in far)

    groups, out = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        groups[j] = groups[j] + groups.pop(i)
        out.append((h, frozenset(groups[j])))
    return out


def merged(merges: list[tuple[int, int, float, int]], n: int) -> list[tuple[float, frozenset]]:
    held, out = [frozenset([k]) for k in range(n)], []
    for a, b, h, _ in merges:
        held.append(held[a] | held[b])
        out.append((h, held[-1]))
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, (30, 3)), rng.normal(4, 2, (15, 3)), rng.uniform(-9, 9, (5, 3))])
    return x[np.lexsort(x.T[::-1])], rng.integers(1, 4, 50).tolist()


@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("tail", [2, 20, 1024])
def test_rounds_and_tail_make_the_plain_tree(spark, cloud, monkeypatch, method, tail):
    monkeypatch.setattr(trees, "TILE", 16)
    x, weights = cloud
    leaves = spark.createDataFrame([(k, row.tolist(), n) for k, (row, n) in enumerate(zip(x, weights, strict=True))], "leaf int, x array<double>, n long")
    got, want = merged(trees.agglomerate(leaves.repartition(3), method, tail), len(x)), plain(x, weights, method)
    assert [m[1] for m in got] == [m[1] for m in want]
    assert [m[0] for m in got] == pytest.approx([m[0] for m in want])


@pytest.mark.parametrize("method", METHODS)
def test_ties_end_and_heights_rise(spark, method):
    """Points of a grid, all equally far from their neighbours; the heights of single linkage are known."""
    rows = [(k, [float(k % 6), float(k // 6)], 1) for k in range(36)]
    leaves = spark.createDataFrame(rows, "leaf int, x array<double>, n long")
    rounds, one = trees.agglomerate(leaves, method, 2), trees.agglomerate(leaves, method, 100)
    for merges in (rounds, one):
        assert len(merges) == 35 and merges[-1][3] == 36
        assert [m[2] for m in merges] == sorted(m[2] for m in merges)
        assert len({n for m in merges for n in m[:2]}) == 70  # each node but the last goes into one merge
    if method == "single":
        assert {m[2] for m in rounds} == {1.0}


def test_few_leaves_and_repeated_vectors(spark):
    def points(rows):
        return spark.createDataFrame(rows, "profile_id string, x array<double>").select("profile_id", array_to_vector("x").alias("features"))

    none = K.linkage_tree(points([]))
    assert none.merges == [] and K.hierarchical(none, 2).count() == 0
    same = K.linkage_tree(points([("a", [1.0, 2.0]), ("b", [1.0, 2.0])]))
    assert same.merges == [] and [r["cluster"] for r in K.hierarchical(same, 1).collect()] == [0, 0]
    two = K.linkage_tree(points([("a", [0.0]), ("b", [0.0]), ("c", [3.0])]), "average")
    assert two.merges == [(0, 1, 3.0, 3)]


def test_a_path_takes_few_rounds(spark, monkeypatch):
    """Of single linkage even a path, whose growing cluster is everyone's nearest, halves in each round."""
    rounds, chains = [], trees._chains
    monkeypatch.setattr(trees, "_chains", lambda names, near: rounds.append(len(names)) or chains(names, near))
    gaps = np.cumsum(np.linspace(1, 2, 128))
    leaves = spark.createDataFrame([(k, [float(g)], 1) for k, g in enumerate(gaps)], "leaf int, x array<double>, n long")
    assert [m[2] for m in trees.agglomerate(leaves, "single")] == pytest.approx(np.diff(gaps).tolist())
    assert all(b <= a / 2 for a, b in zip(rounds, rounds[1:], strict=False))


def test_single_linkage_is_exact_beyond_the_leaves_of_a_matrix(spark, monkeypatch):
    """Blocks of few vectors in several parts, 20 columns, with copies; heights are those of Prim's tree."""
    from sondeframe.operators import pairwise

    monkeypatch.setattr(K, "MAX_LEAVES", 30)
    monkeypatch.setattr(pairwise, "PART_ROWS", 20)
    x = np.random.default_rng(9).normal(100, 1, (90, 20))
    rows = [(f"p{k}", x[k % 90].tolist()) for k in range(100)]
    tree = K.linkage_tree(spark.createDataFrame(rows, "profile_id string, x array<double>").repartition(4).select("profile_id", array_to_vector("x").alias("features")), "single")
    d, inside, heights = np.linalg.norm(x[:, None] - x[None], axis=2), [0], []
    while len(inside) < 90:
        rest = [k for k in range(90) if k not in inside]
        near = d[np.ix_(inside, rest)]
        heights.append(near.min())
        inside.append(rest[near.min(axis=0).argmin()])
    assert [m[2] for m in tree.merges] == pytest.approx(sorted(heights)) and tree.merges[-1][3] == 100
    scan = {r["k"]: r["silhouette"] for r in K.scan_tree(tree, 3).collect()}
    for k in (2, 3):
        assert scan[k] == pytest.approx(K.mean_silhouette(K.hierarchical(tree, k)))


def test_a_spanning_tree_takes_few_passes_over_all_pairs(spark, monkeypatch):
    """chains grow by lists of nearest leaves, not by a pass over all pairs for each round."""
    from sondeframe.operators import pairwise

    passes, met = [], pairwise.met
    monkeypatch.setattr(pairwise, "met", lambda *a: passes.append(1) or met(*a))
    x = np.random.default_rng(3).normal(0, 1, (400, 6))
    x = x[np.lexsort(x.T[::-1])]
    leaves = spark.createDataFrame([(k, row.tolist(), 1) for k, row in enumerate(x)], "leaf int, x array<double>, n long")
    heights = [m[2] for m in trees.agglomerate(leaves, "single")]
    d, inside, want = np.linalg.norm(x[:, None] - x[None], axis=2), np.arange(400) == 0, []
    while not inside.all():
        near = np.where(inside, np.inf, d[inside].min(axis=0))
        want.append(near.min())
        inside[near.argmin()] = True
    assert heights == pytest.approx(sorted(want)) and len(passes) <= 2


def test_a_deep_tree_is_cut_in_linear_time():
    """a chain of 50,000 leaves, each merging with all before it; walking up from every leaf took n squared steps."""
    import time

    n = 50_000
    tree = K.Tree([(0, 1, 1.0, 2), *((k, n + k - 2, float(k), k + 1) for k in range(2, n))], range(n), None)
    began = time.perf_counter()
    labels = tree.cut(3)
    assert labels == [0] * (n - 2) + [1, 2] and time.perf_counter() - began < 5
    assert tree.cut(n) == list(range(n)) and set(tree.cut(1)) == {0}


@pytest.mark.parametrize("method", ["ward", "average"])
def test_no_size_makes_leaves_of_centres(spark, monkeypatch, method):
    """beyond MAX_LEAVES vectors the leaves were k-means centres, another tree."""
    monkeypatch.setattr(K, "MAX_LEAVES", 30)
    x = np.random.default_rng(5).normal(0, 1, (60, 3))
    points = spark.createDataFrame([(f"p{k}", row.tolist()) for k, row in enumerate(x)], "profile_id string, x array<double>").select("profile_id", array_to_vector("x").alias("features"))
    tree = K.linkage_tree(points, method, tail=10)
    assert len(tree.leaves) == 60 and [m[2] for m in tree.merges] == pytest.approx([h for h, _ in plain(x, [1] * 60, method)])
    monkeypatch.setattr(K, "MAX_LEAVES", 100)
    assert K.linkage_tree(points, method, tail=10).merges == tree.merges


def test_ward_makes_no_matrix(spark, monkeypatch):
    monkeypatch.delattr(trees, "_distances")
    leaves = spark.createDataFrame([(k, [float(k * k)], 1) for k in range(40)], "leaf int, x array<double>, n long")
    assert trees.agglomerate(leaves, "ward", 4)[-1][3] == 40
