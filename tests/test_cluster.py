"""Invariants of reductions and clusterings on planted groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sondeframe.operators import cluster as K
from sondeframe.operators import evaluate as E
from sondeframe.operators import matrix as M
from sondeframe.operators.aggregate import density


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0, 0], [9, 0, 0, 0], [0, 9, 9, 0]])
    return [(f"p{i:02d}", i % 3, (centres[i % 3] + rng.normal(0, 0.7, 4)).tolist()) for i in range(45)]


@pytest.fixture(scope="module")
def points(spark, planted):
    df = spark.createDataFrame(planted, "profile_id string, truth int, x array<double>")
    return df.select("profile_id", array_to_vector("x").alias("features")).cache()


@pytest.fixture(scope="module")
def truth(spark, planted):
    return spark.createDataFrame([p[:2] for p in planted], "profile_id string, truth int").cache()


def agreement(assigned, truth):
    return E.adjusted_rand(assigned.select("profile_id", "cluster").join(truth, "profile_id"), "cluster", "truth").first()["ari"]


def test_components(points, planted):
    x = np.array([p[2] for p in planted])
    got = K.reduce(points, 3)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert got.explained == pytest.approx(values[:3] / values.sum())
    assert got.components.T @ got.components == pytest.approx(np.eye(3), abs=1e-9)
    assert all(c[np.abs(c).argmax()] > 0 for c in got.components.T)
    scores = {r[0]: r[1] for r in got.scores.select("profile_id", vector_to_array("features")).collect()}
    want = (x - x.mean(axis=0)) @ got.components
    assert all(scores[p[0]] == pytest.approx(w, abs=1e-9) for p, w in zip(planted, want, strict=True))
    assert K.components_for(np.array([0.5, 0.3, 0.2]), 0.8) == 2


def test_k_means(points, truth):
    one, many = K.k_means(points, 3, 0, 1), K.k_means(points, 3, 0, 4)
    assert many.inertia <= one.inertia and agreement(many.assignments, truth) == 1.0
    scan = {r["k"]: r for r in K.scan_k(points, 4, 0, 3).collect()}
    assert max(scan, key=lambda k: scan[k]["silhouette"]) == 3


@pytest.mark.parametrize("method", ["ward", "complete", "average", "single"])
@pytest.mark.parametrize("leaves", [2000, 12])
def test_linkage(points, truth, method, leaves):
    tree = K.linkage_tree(points, method, leaves)
    heights = [m[2] for m in tree.merges]
    assert heights == sorted(heights) and tree.merges[-1][3] == 45 and len(tree.leaves) <= leaves
    assert agreement(K.hierarchical(tree, 3), truth) == 1.0
    assert heights[-3] <= tree.height_between(3) <= heights[-2]


def test_linkage_against_plain_agglomeration(points, planted):
    x = [np.array(p[2]) for p in planted]
    groups, heights = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        cost = lambda a, b: np.mean([np.linalg.norm(x[i] - x[j]) for i in a for j in b])
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        heights.append(h)
        groups[j] = groups[j] + groups.pop(i)
    assert [m[2] for m in K.linkage_tree(points, "average").merges] == pytest.approx(heights)


def test_two_stages(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        wind, heat = 10.0 * (i % 2), 20.0 * (i // 2 % 2) if i % 2 else 0.0
        for g in range(3):
            rows += [(f"p{i}", "u", g, wind + rng.normal(0, 0.3)), (f"p{i}", "v", g, rng.normal(0, 0.3)), (f"p{i}", "t", g, heat + rng.normal(0, 0.3))]
    table = spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "profile_id string, var string, g_idx int, val double")
    got = K.two_stage(table, 2, max_k=3, n_init=2, min_silhouette=0.6)
    sizes = sorted(r["count"] for r in got.assignments.groupBy("cluster").count().collect())
    assert sizes == [15, 15, 30] and len(got.map) == 3
    fixed = K.two_stage(table, 2, k_therm=2, n_init=1)
    assert len(fixed.map) == 4
    with pytest.raises(ValueError):
        K.two_stage(table, 2, thermal=["td"])


def test_mixture(points, truth):
    best, scores = K.mixture(points, [2, 3], [0, 1])
    assert scores.count() == 4 and agreement(best, truth) > 0.5


def test_agreement_measures(spark):
    df = spark.createDataFrame([(i, i % 3, (i % 3 + 1) % 3) for i in range(12)], "i int, a int, b int")
    assert E.adjusted_rand(df, "a", "b").first()["ari"] == 1.0
    assert E.best_match(df, "a", "b") == (1.0, [(0, 1), (1, 2), (2, 0)])
    assert E.adjusted_rand(df.withColumn("c", F.lit(1)), "c", "c").first()["ari"] == 1.0


def test_f_tail():
    assert E.f_tail(4.0, 1, 1) == pytest.approx(0.29516724)  # 1 - 2 / pi * atan(2)
    assert E.f_tail(3.0, 2, 10) == pytest.approx((1 + 2 * 3.0 / 10) ** -5)
    assert E.f_tail(0.0, 2, 10) == 1.0 and E.f_tail(None, 2, 10) is None


def test_density_against_the_sum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 2)) @ np.array([[1, 0.4], [0, 0.8]])
    got = {(round(r["gx"], 9), round(r["gy"], 9)): r["density"] for r in density(spark.createDataFrame(x.tolist(), "a double, b double").repartition(3), "a", "b", cells=5).collect()}
    cov = np.cov(x.T) * 0.09
    for gx in np.linspace(x[:, 0].min(), x[:, 0].max(), 5):
        for gy in np.linspace(x[:, 1].min(), x[:, 1].max(), 5):
            d = x - [gx, gy]
            want = np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)).sum() / (40 * 2 * np.pi * np.sqrt(np.linalg.det(cov)))
            assert got[round(gx, 9), round(gy, 9)] == pytest.approx(want)


def test_scaling_and_imputation(spark):
    rows = [("a", "t", 0, 1.0), ("b", "t", 0, None), ("c", "t", 0, 4.0), ("a", "t", 1, None), ("b", "t", 1, None), ("c", "t", 1, None), ("a", "u", 0, 5.0), ("b", "u", 0, 5.0), ("c", "u", 0, 5.0)]
    df = spark.createDataFrame(rows, "profile_id string, var string, g_idx int, val double")
    filled = {(r[0], r[1], r[2]): r[3] for r in M.impute(df, "median").collect()}
    assert filled["b", "t", 0] == 2.5 and ("a", "t", 1) not in filled  # a column without values goes
    assert {r["val"] for r in M.standardise(df.filter("var = 'u'")).collect()} == {0.0}
    assert {r["val"] for r in M.scale_shape(df.filter("var = 'u'")).collect()} == {0.5}
    assert M.impute(df.filter("g_idx = 0"), "drop").select("profile_id").distinct().count() == 2
    for bad in (lambda: M.impute(df, "other"), lambda: M.scale_block(df, ["q"]), lambda: M.scale_block(df, None, "other")):
        with pytest.raises(ValueError):
            bad()


def test_densities_on_a_line_and_of_repeated_points(spark):
    """Equal points count as often as they occur; points nearly on a line are added one by one."""
    from sondeframe.operators.aggregate import density

    rng = np.random.default_rng(6)
    for noise in (0.5, 1e-3):
        u = rng.integers(0, 9, 40).astype(float)
        x = np.stack([u, 2 * u + noise * rng.integers(0, 5, 40)], axis=1)
        x = np.concatenate([x, x[:15]])
        inverse = np.linalg.inv(np.cov(x.T) * 0.09)
        for r in density(spark.createDataFrame(x.tolist(), "a double, b double").repartition(3), "a", "b", cells=5).collect():
            d = np.array([r["gx"], r["gy"]]) - x
            want = np.exp(-0.5 * np.einsum("pi,ij,pj->p", d, inverse, d)).mean() * np.sqrt(np.linalg.det(inverse)) / (2 * np.pi)
            assert r["density"] == pytest.approx(want, rel=1e-6, abs=1e-12)
