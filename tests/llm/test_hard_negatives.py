from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondeframe.llm import hard_negatives as H

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, n_positives=5, n_negatives=10):
    """Of (id, label, components) rows, all pairs in plain Python."""
    live = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, lab, q) in enumerate(live):
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, w, strict=False)), j, other) for k, (j, other, w) in enumerate(live) if k != at]
        positives = sorted((s, j) for s, j, other in scored if other == lab)[:n_positives]
        for s, j in positives:
            fits = sorted((t, k) for t, k, other in scored if other != lab and 30 * -s <= 100 * -t <= 90 * -s)[:n_negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(fits, 1)]
    return sorted(out)


def found(points, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in H.hard_negatives(points, F.col("vec_id") % 100 == 0, **options).collect())


def table(spark, rows):
    return H.embedding_points(spark.createDataFrame([(i, v, lab, "x", 1) for i, lab, v in rows], "vec_id long, embedding array<float>, label int, rank string, score int"))


def planted(seed, n, d=8, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    own = rng.integers(0, labels, n)
    x = (centres[own] + rng.normal(size=(n, d))).astype(np.float32)
    return [(int(k), int(lab), [float(v) for v in row]) for k, (lab, row) in enumerate(zip(own, x, strict=True))]


def test_bounds_hold_and_are_exact_for_single_values():
    rng = np.random.default_rng(3)
    for values in (rng.integers(-40, 40, (700, 6)), rng.integers(-2, 2, (50, 3)), np.full((5, 2), 7)):
        cells = H.Approximation(values.astype(np.int32), cells=16)
        anchors = rng.integers(-60, 60, (9, values.shape[1]))
        low, high = cells.bounds(cells.tables(anchors), slice(0, len(values)))
        exact = values @ anchors.T
        assert (low <= exact).all() and (exact <= high).all()
    assert (low == exact).all() and (high == exact).all()


def test_large_components_are_bounded_in_64_bits():
    cells = H.Approximation(np.array([[2**30, -(2**30)]], dtype=np.int32))
    low, high = cells.bounds(cells.tables(np.array([[2**30, 2**30]])), slice(0, 1))
    assert low[0, 0] == high[0, 0] == 0


@pytest.mark.parametrize("split_bytes", [2_000, 1 << 20])
def test_against_brute_force(spark, monkeypatch, split_bytes):
    monkeypatch.setattr(H, "CHUNK", 64)
    monkeypatch.setattr(H, "TILE", 2)
    rows = planted(5, 900)
    assert found(table(spark, rows), split_bytes=split_bytes) == brute(rows)


def test_ties_repeats_nulls_and_short_vectors(spark):
    rows = planted(9, 320, d=3, labels=3)
    rows += [(1000 + k, k % 3, [1.0, 1.0, 0.5]) for k in range(90)]  # equal scores
    rows += [rows[100], rows[100], rows[7], rows[7], (200, 2, rows[200][2]), (300, 1, [1.0, 1.0, 0.5])]  # repeated rows and ids
    rows += [(400, None, [1.0, 1.0, 1.0]), (500, 1, None), (600, 1, [1.0, None, 1.0]), (700, 1, [float("nan"), 1.0, 1.0]), (800, 1, [float("inf"), 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(900, 0, []), (2000, 1, [1.5]), (2100, 99, [1.0, 1.0, 1.0]), (-100, 0, [-1.0, -1.0, -1.0])]
    assert found(table(spark, rows)) == brute(rows)


def test_empty_table_and_no_anchor(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(k, k % 2, [1.0]) for k in range(1, 50)])) == []


def test_most_rows_are_never_scored(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 16)) * 200
    split = H._Split.__new__(H._Split)
    split.ids, split.labels, split.vectors = np.arange(20_000), np.arange(20_000) % 5, x.astype(np.int32)
    split.cells = H.Approximation(split.vectors)
    scored = []
    exact = H._Split.exact
    monkeypatch.setattr(H._Split, "exact", lambda self, rows, vectors, of: scored.append(len(rows)) or exact(self, rows, vectors, of))
    own = split.vectors[:50].astype(np.int64)
    high = (own * own).sum(axis=1)[:, None] // 2
    anchors = {"anchor": np.arange(50), "id": np.arange(50), "label": split.labels[:50], "q": own, "low": high // 3, "high": high}
    list(H._negatives(split, anchors, 10))
    assert sum(scored) < 0.1 * 50 * 20_000
