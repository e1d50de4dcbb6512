"""Many Gaussian mixtures in one pass: expectation maximisation of all fits together.

A fit starts from the clusters of one k-means run.  A round is one job: tasks
compute each row's shares in the components of every fit and add up weights,
sums and products by fit and component; fits that gain less than TOLERANCE of
mean log-likelihood drop out.  To the driver come the sums: fits x components x
columns squared, cut into parts of at most SUM_BYTES.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.operators import kmeans
from sondeframe.operators.kmeans import Run
from sondeframe.sources.storage import checkpointed

TOLERANCE = 1e-3
MAX_ROUNDS = 100
#: Added to each variance.
RIDGE = 1e-6
SUM_BYTES = 64 << 20


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of k components; gains holds the mean log-likelihood of each round."""

    run: Run
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    gains: list[float] = field(default_factory=list)

    def bic(self, n: int) -> float:
        k, d = self.means.shape
        return -2 * self.log_likelihood + (k * d * (d + 1) / 2 + k * d + k - 1) * float(np.log(n))


class _Densities:
    """Log densities of the weighted components of one fit."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> None:
        self.means = means
        lower = np.linalg.cholesky(covariances)
        self.whiten = np.linalg.inv(lower)
        d = means.shape[1]
        self.constants = np.log(weights) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1) - d / 2 * np.log(2 * np.pi)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each row, its share in each component)."""
        logs = np.stack([c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for c, m, w in zip(self.constants, self.means, self.whiten, strict=True)], axis=1)
        most = logs.max(axis=1)
        part = np.exp(logs - most[:, None])
        total = part.sum(axis=1)
        return most + np.log(total), part / total[:, None]


class _Nearest:
    """Whole shares in the nearest centre: the start."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = ((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)
        return np.zeros(len(x)), np.eye(len(self.centres))[at]


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each partition, fit and component: the shares, and their sums of rows and products; component -1 has the log-likelihood."""
        models, shift = shared.value
        totals: dict[tuple[int, int], tuple[float, np.ndarray]] = {}

        def add(key: tuple[int, int], n: float, part: np.ndarray) -> None:
            old = totals.get(key)
            totals[key] = (n, part) if old is None else (old[0] + n, old[1] + part)

        for batch in batches:
            x = kmeans._matrix(batch.column("x")) - shift
            for number, model in models.items():
                logs, shares = model.shares(x)
                add((number, -1), float(logs.sum()), np.zeros(0))
                for c in range(shares.shape[1]):
                    weighted = x * shares[:, c, None]
                    add((number, c), float(shares[:, c].sum()), np.concatenate([weighted.sum(axis=0), (weighted.T @ x).ravel()]))
        size = max((len(t[1]) for t in totals.values()), default=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in totals], pa.int32()), pa.array([k[1] for k in totals], pa.int32()), pa.array([t[0] for t in totals.values()], pa.float64()),
             pa.array([t[1].tolist() or [0.0] * size for t in totals.values()], pa.list_(pa.float64()))], names=["fit", "component", "n", "x"])

    return run


def fit(points: DataFrame, runs: list[Run], max_rounds: int = MAX_ROUNDS) -> tuple[list[Mixture], int]:
    """The mixtures of all runs over points (profile_id, features), and the number of rows.

    A mixture has fewer components where the rows have fewer different vectors.
    """
    starts = kmeans.fit(points, runs)
    source = checkpointed(kmeans.prepared(points).select("x"))
    n = source.count()
    if not n:
        return [], 0
    shift = source.select(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"].toArray()
    d = len(shift)
    rows = kmeans.together(source, n, d, d * sum(r.k for r in runs)).persist()  # a component's products are d centres' work
    try:
        found: dict[int, Mixture] = {}
        step = max(1, SUM_BYTES // (8 * (d + d * d) * max(r.k for r in runs)))
        for k in range(0, len(runs), step):
            found |= _fit(rows, {j: (runs[j], starts[j].centres - shift) for j in range(k, min(k + step, len(runs)))}, n, shift, max_rounds)
        return [found[j] for j in range(len(runs))], n
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, starts: dict[int, tuple[Run, np.ndarray]], n: int, shift: np.ndarray, max_rounds: int) -> dict[int, Mixture]:
    d = len(shift)
    models: dict = {j: _Nearest(c) for j, (_, c) in starts.items()}
    values: dict[int, tuple] = {}
    gains: dict[int, list[float]] = {j: [] for j in starts}
    found: dict[int, Mixture] = {}
    for step in range(max_rounds + 1):
        shared = rows.sparkSession.sparkContext.broadcast((models, shift))
        sums = (
            rows.mapInArrow(_sums(shared), "fit int, component int, n double, x array<double>").withColumn("x", array_to_vector("x"))
            .groupBy("fit", "component").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("x")).alias("x")).collect()
        )
        shared.destroy()
        new: dict[int, dict[int, tuple[float, np.ndarray]]] = {}
        for row in sums:
            new.setdefault(row["fit"], {})[row["component"]] = (row["n"], row["x"].toArray())
        for j in list(models):
            own = new[j]
            if step:
                gains[j].append(own[-1][0] / n)
                if step == max_rounds or step > 1 and gains[j][-1] - gains[j][-2] < TOLERANCE:
                    weights, means, covariances = values[j]
                    found[j] = Mixture(starts[j][0], weights, means + shift, covariances, own[-1][0], gains[j])
                    del models[j]
                    continue
            k = len(own) - 1
            counts = np.array([own[c][0] for c in range(k)]) + 10 * np.finfo(float).eps
            means = np.stack([own[c][1][:d] for c in range(k)]) / counts[:, None]
            products = np.stack([own[c][1][d:].reshape(d, d) for c in range(k)]) / counts[:, None, None]
            covariances = products - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
            values[j] = (counts / counts.sum(), means, covariances)
            models[j] = _Densities(*values[j])
        if not models:
            break
    return found


def assign(points: DataFrame, mixture: Mixture) -> DataFrame:
    """(profile_id, features, cluster, probability): the component of the largest share, of equal ones the first."""
    model = _Densities(mixture.weights, mixture.means, mixture.covariances)
    kind = points.schema["profile_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, shares = model.shares(kmeans._matrix(batch.column("x"))) if batch.num_rows else (None, np.zeros((0, 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("profile_id"), batch.column("x"), pa.array(shares.argmax(axis=1).astype(np.int32)), pa.array(shares.tolist(), pa.list_(pa.float64()))], names=["profile_id", "x", "cluster", "p"])

    rows = kmeans.prepared(points).select("profile_id", "x").mapInArrow(run, f"profile_id {kind}, x array<double>, cluster int, p array<double>")
    return rows.select("profile_id", array_to_vector("x").alias("features"), "cluster", array_to_vector("p").alias("probability"))
