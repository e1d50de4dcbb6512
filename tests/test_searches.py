"""Searches of many fits at once, consensus without pairs, and exact quantiles, against plain versions."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeframe.operators import cells, cluster, evaluate, kmeans, mixtures
from sondeframe.operators import quantiles as Q
from sondeframe.operators.kmeans import Run


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    return [(f"p{i}", (rng.normal(0, 1, 4) + 3 * np.array([i % 3, i % 2, 0, 0])).tolist(), i % 2) for i in range(90)]


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame(rows, "profile_id string, features array<double>, group int").repartition(3).cache()


def plain(rows, run):
    """One run at a time, by the definition."""
    own = [(i, np.array(x)[: run.width]) for i, x, g in rows if g == run.group]
    h = [int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % kmeans.PRIME for i, _ in own]
    centres = []
    for draw in range(run.k):
        n = kmeans.draw_number(run, draw)
        a, b = 1 + (n * kmeans.MULTIPLIERS[0] + kmeans.MULTIPLIERS[1]) % (kmeans.PRIME - 1), (n * kmeans.SHIFTS[0] + kmeans.SHIFTS[1]) % kmeans.PRIME
        times = []
        for k, (i, x) in enumerate(own):
            far = min((float(((x - c) ** 2).sum()) for c in centres), default=1.0)
            if far > 1e-9:
                times.append((-np.log(((a * h[k] + b) % kmeans.PRIME + 1) / (kmeans.PRIME + 1)) / far, i, k))
        if not times:
            break
        centres.append(own[min(times)[2]][1])
    centres = np.array(centres)
    while True:
        at = np.array([((centres - x) ** 2).sum(axis=1).argmin() for _, x in own])
        new = np.array([np.mean([x for (_, x), c in zip(own, at, strict=True) if c == j], axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
        if np.abs(new - centres).max() < 1e-9:
            return centres, {i: int(c) for (i, _), c in zip(own, at, strict=True)}, sum(((x - centres[c]) ** 2).sum() for (_, x), c in zip(own, at, strict=True))
        centres = new


def test_runs_together_are_the_runs_alone(points, rows, monkeypatch):
    monkeypatch.setattr(kmeans, "TILE", 64)
    runs = [Run(k, seed, start, width, group) for k, seed, start, width, group in [(2, 0, 0, None, 0), (3, 0, 1, None, 1), (5, 7, 0, 2, 0), (4, 1, 3, 1, 1), (1, 0, 0, None, 0)]]
    fitted = kmeans.fit(points, runs)
    labels = {}
    for r in kmeans.assign(points, fitted).collect():
        labels.setdefault(r["run"], {})[r["profile_id"]] = r["cluster"]
    for n, f in enumerate(fitted):
        centres, own, inertia = plain(rows, f.run)
        assert f.centres == pytest.approx(centres, abs=1e-7) and labels[n] == own and f.inertia == pytest.approx(inertia)
    monkeypatch.setattr(kmeans, "CENTRE_BYTES", 100)  # in several parts
    assert [f.inertia for f in kmeans.fit(points, runs)] == pytest.approx([f.inertia for f in fitted])


def test_few_different_rows_make_few_clusters(spark):
    same = spark.createDataFrame([(f"p{i}", [float(i % 2), 1.0]) for i in range(9)], "profile_id string, features array<double>")
    (f,) = kmeans.fit(same, [Run(5)])
    assert len(f.centres) == 2 and f.inertia == pytest.approx(0)
    assert kmeans.fit(same.limit(0), [Run(3)])[0].centres.shape[0] == 0
    assert cluster.k_means(same, 4, n_init=2).assignments.select("cluster").distinct().count() == 2


def test_best_start_wins(points):
    fitted = kmeans.fit(points, [Run(4, 0, s) for s in range(6)] + [Run(3, 1, s) for s in range(6)])
    best = kmeans.best_of(fitted)
    assert [(f.run.k, f.run.seed) for f in best] == [(4, 0), (3, 1)]
    assert best[0].inertia == pytest.approx(min(f.inertia for f in fitted[:6]))


def test_silhouettes_of_many_labelings(points):
    fitted = kmeans.fit(points, [Run(2), Run(4, 3), Run(3, 0, 0, 2), Run(1), Run(3, 5, group=1)])
    labels = kmeans.labelled(points, fitted)
    got = evaluate.mean_silhouettes(labels, [len(f.centres) for f in fitted], [f.run.width for f in fitted], block=20)
    for n, f in enumerate(fitted):
        own = labels.select("profile_id", F.slice("x", 1, f.run.width or 4).alias("features"), F.col("labels")[n].alias("cluster")).filter("cluster >= 0")
        want = evaluate.silhouette(own).agg(F.avg("silhouette")).first()[0]
        assert got[n] == pytest.approx(want)


def test_consensus_without_pairs(spark):
    rng = np.random.default_rng(2)
    labels = {f"p{i}": rng.integers(0, 2, 6) if i % 3 else np.array([0, 1, 0, 1, 0, 1]) for i in range(60)}
    rows = [(r, p, int(x[r])) for p, x in labels.items() for r in range(6) if not (p == "p7" and r < 3)]
    runs = spark.createDataFrame(rows, "run int, profile_id string, cluster int")
    got = {r["profile_id"]: r for r in evaluate.consensus_classes(runs, block=7).collect()}
    have = {p: {r: c for r, q, c in rows if q == p} for p in labels}
    totals = Counter()
    for p in labels:
        shares = [sum(have[p].get(r, -1) == have[q].get(r, -2) for r in range(6)) / 6 for q in labels if q != p]
        want = (sum(s > 0.8 for s in shares), sum(s < 0.2 for s in shares), sum(0.3 <= s <= 0.7 for s in shares))
        assert (got[p]["stable"], got[p]["separate"], got[p]["ambiguous"]) == want
        same = [q for q in labels if have[q] == have[p]]
        assert got[p]["class_id"] == min(same) and got[p]["size"] == len(same)
        totals.update(dict(zip(("stable", "separate", "ambiguous"), want, strict=True)))
    bands = evaluate.pair_bands(evaluate.consensus_classes(runs)).first().asDict()
    assert bands == {k: v // 2 for k, v in totals.items()}


def test_mixtures_gain_and_are_told_apart(points, rows):
    runs = [Run(k, s) for k in (1, 2, 3) for s in (0, 1)]
    flat = points.drop("group")
    fitted, n = mixtures.fit(flat, runs)
    x = np.array([r[1] for r in rows])
    assert n == 90 and all(b >= a - 1e-9 for f in fitted for a, b in itertools.pairwise(f.gains))
    one = fitted[0]  # of one component the moments are the fit
    assert one.means[0] == pytest.approx(x.mean(axis=0)) and one.covariances[0] == pytest.approx(np.cov(x.T, bias=True) + mixtures.RIDGE * np.eye(4))
    for f in fitted:
        d = x[:, None] - f.means[None]
        logs = np.stack([np.log(w) - 0.5 * (np.einsum("ni,ij,nj->n", d[:, c], np.linalg.inv(s), d[:, c]) + np.linalg.slogdet(2 * np.pi * s)[1]) for c, (w, s) in enumerate(zip(f.weights, f.covariances, strict=True))], axis=1)
        assert f.log_likelihood == pytest.approx(np.log(np.exp(logs).sum(axis=1)).sum())
        k = len(f.weights)
        assert f.bic(n) == pytest.approx(-2 * f.log_likelihood + (k * 15 - 1) * np.log(90))
    assigned = mixtures.assign(flat, fitted[2]).collect()
    assert all(r["probability"].toArray().sum() == pytest.approx(1) and r["probability"].toArray().argmax() == r["cluster"] for r in assigned)


def quantile(values, p):
    return float(np.quantile(np.array(values), p))


def test_quantiles_of_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(0, 1e3, 700)] + [("b", float(v)) for v in rng.integers(-3, 3, 300)] + [(None, v) for v in (1.5, -0.0, 0.0, float("nan"), None)]
    rows += [("c", 7.25)] * 40 + [("d", None), ("e", 1e-310), ("e", -1e308), ("e", 1e308), ("e", float("inf"))] + [("f", v) for v in (1.0, 1.0 + 2**-52)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in Q.quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {"a", "b", "c", None, "e", "f"}
    for k in ("a", "b", "c", None, "f"):
        values = [v for g, v in rows if g == k and v is not None and v == v]
        assert got[k][0] == len(values) and got[k][1] == pytest.approx([quantile(values, p) for p in shares], rel=1e-15)
    assert got["e"][1][0] == -1e308 and got["e"][1][-1] == float("inf")
    monkeypatch.setattr(Q, "BROADCAST_ROWS", 0)
    again = {r["k"]: r["q"] for r in Q.quantiles(df, ["k"], "v", shares).collect()}
    assert {k: q for k, (_, q) in got.items() if k != "e"} == {k: q for k, q in again.items() if k != "e"}
    with pytest.raises(ValueError):
        Q.quantiles(df, ["k"], "v", [1.5])


def test_quantiles_of_a_whole_column_and_of_none(spark):
    df = spark.createDataFrame([(float(k), None if k % 2 else float(k * k)) for k in range(101)], "a double, b double")
    facts = df.agg(F.count("*").alias("n"))
    got = Q.with_quantiles(facts, df, [], {"a": {"low": 0.05, "mid": 0.5}, "b": {"high": 0.9}}).first()
    assert (got["n"], got["low"], got["mid"]) == (101, 5.0, 50.0) and got["high"] == pytest.approx(quantile([k * k for k in range(0, 101, 2)], 0.9))
    empty = Q.with_quantiles(df.limit(0).agg(F.count("*").alias("n")), df.limit(0), [], {"a": {"mid": 0.5}}).first()
    assert (empty["n"], empty["mid"]) == (0, None)


def test_silhouettes_by_cells(spark):
    rng = np.random.default_rng(12)
    rows = [(f"p{i}", (rng.normal(0, 0.05, 3) + np.array([(i % 3) * 20, (i // 3 % 4) * 3, 0])).tolist(), i % 3) for i in range(400)] + [("alone", [100.0, 0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "profile_id string, features array<double>, cluster int").repartition(3)
    want = {r["profile_id"]: r["silhouette"] for r in evaluate.silhouette(df).collect()}
    opened = []
    for tolerance in (0.0, 0.002, 0.05):
        found = cells.silhouette_cells(df, tolerance, pivots=16)
        got = {r["profile_id"]: r["silhouette"] for r in found.rows.collect()}
        assert set(got) == set(want) and max(abs(got[p] - want[p]) for p in want) <= max(1e-9, 2.5 * tolerance)
        opened.append(found.opened)
    assert opened[0] > opened[1] > opened[2] and found.pairs >= opened[0]
    one = cells.silhouette_cells(df.filter("cluster = 1"))
    assert {r["silhouette"] for r in one.rows.collect()} == {0.0}
    same = spark.createDataFrame([(f"p{i}", [1.0], i % 2) for i in range(6)], "profile_id string, features array<double>, cluster int")
    assert {r["silhouette"] for r in cells.silhouette_cells(same).rows.collect()} == {0.0}
    assert cells.silhouette_cells(df.limit(0)).rows.count() == 0


def test_co_membership_writes_no_pairs(spark, monkeypatch):
    """The plan over the blocks shuffles nothing; pairs are those of a plain count, also where labels are missing."""
    from sondeframe.operators import pairwise

    monkeypatch.setattr(pairwise, "PART_ROWS", 10)
    rng = np.random.default_rng(4)
    rows = [(r, f"p{i}", f"c{rng.integers(0, 3)}") for r in range(4) for i in range(50) if (r + i) % 7]
    found = evaluate.co_membership(spark.createDataFrame(rows, "run int, profile_id string, cluster string").repartition(3))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    have = {(r, p): c for r, p, c in rows}
    want = Counter((a, b) for r in range(4) for a, b in itertools.combinations(sorted(f"p{i}" for i in range(50)), 2) if have.get((r, a), 0) == have.get((r, b), 1))
    assert {(r["a"], r["b"]): r["share"] for r in found.collect()} == {p: c / 4 for p, c in want.items()}


@pytest.mark.parametrize("d", [3, 20])
def test_silhouettes_far_from_the_origin_and_in_parts(spark, monkeypatch, d):
    """Blocks of one profile and several parts; copies have distances of exactly 0."""
    from sondeframe.operators import pairwise

    monkeypatch.setattr(pairwise, "PART_ROWS", 10)
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(0, 1, (61, d)) + 3 * (np.arange(61) % 3 == 1)[:, None]
    x[40:50] = x[30]
    c = [None if i == 60 else i % 3 for i in range(61)]
    df = spark.createDataFrame([(f"p{i}", x[i].tolist(), c[i]) for i in range(61)], "profile_id string, features array<double>, cluster int").repartition(4)
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {r["profile_id"]: r["silhouette"] for r in evaluate.silhouette(df, block=7).collect()}
    for i in range(60):
        means = [apart[i, [j for j in range(60) if c[j] == k and j != i]].mean() for k in range(3)]
        a, b = means[c[i]], min(m for k, m in enumerate(means) if k != c[i])
        assert got[f"p{i}"] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    assert got["p60"] == 0.0


def test_rounds_that_end_by_their_number_make_them_all(points, rows):
    """After one round centres are means once, and the inertia is that of their own clusters."""
    (start,), (once,) = kmeans.fit(points, [Run(3, 2)], max_rounds=0), kmeans.fit(points, [Run(3, 2)], max_rounds=1)
    x = np.array([v for _, v, g in rows if g == 0])
    at = ((x[:, None] - start.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert once.centres == pytest.approx(np.array([x[at == c].mean(axis=0) for c in range(3)])) and once.rounds == 1
    assert once.inertia == pytest.approx(((x[:, None] - once.centres[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_narrow_widths_go_on_from_one_another():
    """Distances of rising widths, narrow ones and wide ones, are those of each width alone."""
    from sondeframe.operators import pairwise

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(9, 20)), rng.normal(size=(7, 20))
    widths = [1, 3, 16, 18, None]
    got = [part.copy() for part in pairwise.distances(x, np.ascontiguousarray(y.T), widths)]
    for w, part in zip(widths, got, strict=True):
        assert part == pytest.approx(np.sqrt(((x[:, None, :w] - y[None, :, :w]) ** 2).sum(axis=2)), abs=1e-12)


def test_mean_silhouettes_meet_equal_profiles_once(spark, monkeypatch):
    """Copies are one row with a weight, and means are those over all copies."""
    met = []
    sums = evaluate.distance_sums

    def counted(rows, *rest):
        met.append(rows.count())
        return sums(rows, *rest)

    monkeypatch.setattr(evaluate, "distance_sums", counted)
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(12, 3)), [1, 5, 2, 1, 7, 1, 1, 3, 1, 2, 1, 4], axis=0)
    c = (x[:, 0] > 0).astype(int)
    labels = np.stack([c, 2 * c + (x[:, 1] > 0)], axis=1)
    df = spark.createDataFrame([(f"p{i}", x[i].tolist(), 0, labels[i].tolist()) for i in range(len(x))], "profile_id string, x array<double>, g int, labels array<int>").repartition(3)
    got = evaluate.mean_silhouettes(df, [2, 4], [1, None], block=5)
    assert met == [12]
    for j, w in enumerate((1, 3)):
        apart, own, each = np.sqrt(((x[:, None, :w] - x[None, :, :w]) ** 2).sum(axis=2)), labels[:, j], []
        for i in range(len(x)):
            if (own == own[i]).sum() == 1:
                each.append(0.0)
                continue
            a = apart[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
            b = min(apart[i, own == k].mean() for k in set(own) - {own[i]})
            each.append((b - a) / max(a, b))
        assert got[j] == pytest.approx(np.mean(each), abs=1e-9)


def test_two_stages_resample_once(spark, monkeypatch):
    """The matrix of the query is read from the resampled profiles, which are written once."""
    from types import SimpleNamespace

    from sondeframe.queries import learning

    seen = []
    monkeypatch.setattr(learning.cluster, "two_stage", lambda rows, k: seen.append(rows) or SimpleNamespace(assignments=rows))
    learning.two_stage(spark, "/root/testdata/sf0.001")
    assert "Window" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_labelings_of_other_groups_are_left_out():
    """A pair of blocks computes the widths of its own labelings alone."""
    from sondeframe.operators import pairwise

    begin = np.array([0, 2, 5, 7])
    assert pairwise.widths_of([4, 4, 9], begin, (0, 1)) == [(4, slice(0, 5))]
    assert pairwise.widths_of([4, 4, 9], begin, (2,)) == [(9, slice(5, 7))]
    assert pairwise.widths_of([4, 4, 9], begin, ()) == []


def test_equal_profiles_of_a_group_keep_equal_scores(spark):
    """To the last bit, wherever they stand in a batch."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(7, 23))[np.arange(203) % 7]
    df = spark.createDataFrame([(f"p{i}", i % 7 % 2, x[i].tolist()) for i in range(203)], "profile_id string, group int, features array<double>").repartition(3)
    scores = cluster._reduced_groups(df, {0: 23, 1: 23}, 0.99)[1]
    assert scores.select("group", "features").distinct().count() == 7
