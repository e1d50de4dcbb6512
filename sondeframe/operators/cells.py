"""Silhouettes by cells: distances to far cells are answered by their centres, others are opened.

Profiles of one cluster that have the same nearest pivot are a cell, with a
centre and a radius.  From any profile of a cell A, the distances to the members
of a cell B lie within B's radius of the distance to its centre; where that is a
small share of the least distance between the cells, the centre stands for them
all.  The other pairs of cells are opened: their members meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.operators.pairwise import distance_sums
from sondeframe.sources.storage import checkpointed

#: Profiles to a pivot, about, and the most pivots.
PIVOT_ROWS = 512
MOST_PIVOTS = 1024


@dataclass(frozen=True)
class Silhouettes:
    """(profile_id, cluster, silhouette), and how many of the pairs of cells were opened."""

    rows: DataFrame
    opened: int
    pairs: int


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt(((x[k : k + 16, None] - y[None]) ** 2).sum(axis=2)) for k in range(0, len(x), 16)]) if len(x) else np.zeros((0, len(y)))


def silhouette_cells(points: DataFrame, tolerance: float = 0.0, pivots: int | None = None, features: str = "features", cluster: str = "cluster") -> Silhouettes:
    """Silhouettes with each mean distance within the share ``tolerance`` of the exact one; exact at 0.

    ``features`` are arrays.  A profile alone in its cluster, or one cluster
    alone, has 0.  To the driver come pivots and cells (pivots x clusters), never profiles.
    """
    rows = checkpointed(points.select("profile_id", F.col(cluster).alias("c"), F.col(features).cast("array<double>").alias("x")))
    n = rows.count()
    if not n:
        return Silhouettes(rows.select("profile_id", F.col("c").alias("cluster"), F.lit(0.0).alias("silhouette")), 0, 0)
    count = pivots or min(MOST_PIVOTS, max(1, -(-n // PIVOT_ROWS)))
    near = np.array([r["x"] for r in rows.orderBy(F.xxhash64("profile_id"), "profile_id").limit(count).collect()])
    kinds = dict(rows.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)
            at = _apart(x, near).argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "p"])

    placed = rows.mapInArrow(place, f"profile_id {kinds['profile_id']}, c {kinds['c']}, x array<double>, p int")
    found = placed.groupBy("c", "p").agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector("x")).alias("m")).orderBy("c", "p").select("c", "p", "n", vector_to_array("m").alias("m")).collect()
    spark = points.sparkSession
    named = spark.createDataFrame([(r["c"], r["p"], k, r["m"]) for k, r in enumerate(found)], f"c {kinds['c']}, p int, cell int, m array<double>")
    apart = F.sqrt(F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    held = checkpointed(placed.join(F.broadcast(named), ["c", "p"]).select("profile_id", "c", "x", "cell", apart.alias("r")))  # a row a cell
    radius = np.zeros(len(found))
    for r in held.groupBy("cell").agg(F.max("r").alias("r")).collect():
        radius[r["cell"]] = r["r"]
    centres, sizes = np.array([r["m"] for r in found]).reshape(len(found), -1), np.array([r["n"] for r in found], dtype=np.int64)
    clusters = sorted({r["c"] for r in found})
    of = np.array([clusters.index(r["c"]) for r in found], dtype=np.int64)
    gap = _apart(centres, centres) - radius[:, None]
    # a row's distance to a far cell's member differs by the radius at most
    far = (radius[None, :] <= tolerance * gap) & (gap > 0)
    member = np.eye(len(clusters))[of] * sizes[:, None]

    def by_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)
            sums = (_apart(x, centres) * far[batch.column("cell").to_numpy()]) @ member if batch.num_rows else np.zeros((0, len(clusters)))
            row, c = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([batch.column("profile_id").take(pa.array(row)), pa.array(c.astype(np.int32)), pa.array(sums[row, c])], names=["profile_id", "cj", "d"])

    schema = f"profile_id {kinds['profile_id']}, cj int, d double"
    coded = spark.createDataFrame([(c, k) for k, c in enumerate(clusters)], f"c {kinds['c']}, k int")  # a row a cluster
    # pairs of cells that are opened meet in blocks, which hold whole cells or neighbouring ones
    rows = held.join(F.broadcast(coded), "c").select("profile_id", "x", "cell", F.array("k").alias("labels"))
    exact = distance_sums(rows, [len(clusters)], far=far if far.any() else None)
    exact = exact.select("profile_id", F.posexplode("sums").alias("cj", "d"))
    sums = (held.mapInArrow(by_centre, schema).unionByName(exact) if far.any() else exact).groupBy("profile_id", "cj").agg(F.sum("d").alias("d"))
    total = {k: int(sizes[of == k].sum()) for k in range(len(clusters))}
    known = spark.createDataFrame([(clusters[k], k, total[k]) for k in total], f"c {kinds['c']}, k int, n long")
    own = held.select("profile_id", "c").join(F.broadcast(known.select("c", F.col("k").alias("ci"))), "c")
    # a profile of distance 0 to all of a cluster has no sum of it
    each = own.withColumn("cj", F.explode(F.sequence(F.lit(0), F.lit(len(clusters) - 1))))
    cells = each.join(F.broadcast(known.select(F.col("k").alias("cj"), "n")), "cj").join(sums, ["profile_id", "cj"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    mean = F.try_divide("d", F.col("n") - (F.col("ci") == F.col("cj")).cast("long"))
    facts = cells.groupBy("profile_id", "c").agg(F.max(F.when(F.col("ci") == F.col("cj"), mean)).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), mean)).alias("b"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return Silhouettes(facts.select("profile_id", F.col("c").alias("cluster"), score.alias("silhouette")), int((~far).sum()), far.size)
