"""Reduction and clustering of profiles: PCA, k-means, mixtures, hierarchies, two stages.

All fits of a search advance together (``kmeans``, ``mixtures``); components run
on Spark ML.  What comes to the driver is bounded
by the number of columns, clusters or leaves, never by the number of profiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeframe.operators import kmeans, mixtures, trees
from sondeframe.operators.evaluate import mean_silhouettes, silhouette
from sondeframe.operators.kmeans import Fitted, Run
from sondeframe.operators.matrix import blocks, vectors
from sondeframe.sources.storage import checkpointed

#: Leaves that a join broadcasts; the result is the same beyond.
MAX_LEAVES = 10_000
MAX_CENTRES = 2000


@dataclass(frozen=True)
class Reduction:
    """Scores (profile_id, features), the components as columns, and each one's share of the variance."""

    scores: DataFrame
    components: np.ndarray
    explained: np.ndarray


def reduce(points: DataFrame, n: int) -> Reduction:
    """Principal components of centred vectors; of each the largest loading is positive."""
    mean = points.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    shift = F.array(*[F.lit(float(x)) for x in mean])
    centred = points.select("profile_id", array_to_vector(F.zip_with(vector_to_array("features"), shift, lambda a, b: a - b)).alias("features"))
    n = min(n, len(mean))
    model = PCA(k=n, inputCol="features", outputCol="scores").fit(centred)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(n)])
    flips = F.array(*[F.lit(float(s)) for s in sign])
    scores = model.transform(centred).select("profile_id", array_to_vector(F.zip_with(vector_to_array("scores"), flips, lambda a, b: a * b)).alias("features"))
    return Reduction(scores, loadings * sign, np.asarray(model.explainedVariance.toArray()))


def cumulative_variance(spark: SparkSession, explained: np.ndarray) -> DataFrame:
    """(component, share, total)."""
    rows = [(k + 1, float(x), float(t)) for k, (x, t) in enumerate(zip(explained, np.cumsum(explained), strict=True))]
    return spark.createDataFrame(rows, "component int, share double, total double")


def components_for(explained: np.ndarray, share: float) -> int:
    """How many components reach the share."""
    return min(int(np.searchsorted(np.cumsum(explained), share)) + 1, len(explained))


def loadings(spark: SparkSession, components: np.ndarray, names: list[str]) -> DataFrame:
    """(feature, component, loading)."""
    rows = [(names[i], j + 1, float(components[i, j])) for i in range(len(names)) for j in range(components.shape[1])]
    return spark.createDataFrame(rows, "feature string, component int, loading double")


def top_loadings(table: DataFrame, k: int) -> DataFrame:
    """Of each component the k loadings of the largest magnitude; of equal ones by name."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Fit:
    """Assignments (profile_id, cluster) with the features, the centres and the inertia."""

    assignments: DataFrame
    centres: np.ndarray
    inertia: float


def k_means(points: DataFrame, k: int, seed: int = 0, n_init: int = 20) -> Fit:
    """The best by inertia of n_init starts, which are fitted together."""
    best = kmeans.best_of(kmeans.fit(points, [Run(k, seed, s) for s in range(n_init)]))[0]
    rows = kmeans.labelled(points, [best])
    return Fit(rows.select("profile_id", array_to_vector("x").alias("features"), F.col("labels")[0].alias("cluster")), best.centres, best.inertia)


def mean_silhouette(assigned: DataFrame) -> float:
    """Over all profiles, exact; 0 with fewer than two clusters."""
    rows = assigned.select("profile_id", "cluster", vector_to_array("features").alias("features"))
    return float(silhouette(rows).agg(F.avg("silhouette")).first()[0] or 0.0)


def _silhouettes(points: DataFrame, fitted: list[Fitted]) -> list[float]:
    return mean_silhouettes(kmeans.labelled(points, fitted), [max(1, len(f.centres)) for f in fitted], [f.run.width for f in fitted])


def scan_k(points: DataFrame, max_k: int = 10, seed: int = 0, n_init: int = 20) -> DataFrame:
    """(k, inertia, silhouette) for k from 2: all numbers and starts in one search."""
    best = kmeans.best_of(kmeans.fit(points, [Run(k, seed, s) for k in range(2, max_k + 1) for s in range(n_init)]))
    rows = [(f.run.k, f.inertia, s) for f, s in zip(best, _silhouettes(points, best), strict=True)]
    return points.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def scan_components(points: DataFrame, k: int, max_n: int = 8, seed: int = 0, n_init: int = 5) -> DataFrame:
    """(n, silhouette) of clusterings in 1 to max_n components, all in one search."""
    kept = points.is_cached
    points.persist()
    whole = reduce(points, max_n)
    scores = checkpointed(whole.scores)
    if not kept:
        points.unpersist()
    best = kmeans.best_of(kmeans.fit(scores, [Run(k, seed, s, n) for n in range(1, len(whole.explained) + 1) for s in range(n_init)]))
    rows = [(f.run.width, s) for f, s in zip(best, _silhouettes(scores, best), strict=True)]
    return points.sparkSession.createDataFrame(rows, "n int, silhouette double")


def seed_sweep(points: DataFrame, ks: list[int], seeds: list[int]) -> DataFrame:
    """(k, seed, inertia, silhouette) of single starts, all in one search."""
    fitted = kmeans.fit(points, [Run(k, seed) for k in ks for seed in seeds])
    rows = [(f.run.k, f.run.seed, f.inertia, s) for f, s in zip(fitted, _silhouettes(points, fitted), strict=True)]
    return points.sparkSession.createDataFrame(rows, "k int, seed int, inertia double, silhouette double")


def runs(points: DataFrame, k: int, seeds: list[int], n_init: int = 1) -> DataFrame:
    """(run, profile_id, cluster) of a fit for each seed, all in one search: the input of a consensus."""
    best = kmeans.best_of(kmeans.fit(points, [Run(k, seed, s) for seed in seeds for s in range(n_init)]))
    return kmeans.assign(points, best)


def mixture(points: DataFrame, ks: list[int], seeds: list[int]) -> tuple[DataFrame, DataFrame]:
    """(assignments of the fit of least BIC, (k, seed, log_likelihood, bic) of all), fitted together."""
    fitted, n = mixtures.fit(points, [Run(k, seed) for k in ks for seed in seeds])
    best = min(fitted, key=lambda f: f.bic(n))
    rows = [(f.run.k, f.run.seed, f.log_likelihood, f.bic(n)) for f in fitted]
    return mixtures.assign(points, best), points.sparkSession.createDataFrame(rows, "k int, seed int, log_likelihood double, bic double")


@dataclass(frozen=True)
class Tree:
    """Merges (left, right, height, size) of weighted leaves; ids of merges go on from the leaves'."""

    merges: list[tuple[int, int, float, int]]
    leaves: range
    members: DataFrame  # (profile_id, features, leaf)

    def cut(self, k: int) -> list[int]:
        """The cluster of each leaf when k are left, numbered by their first leaf."""
        n = len(self.leaves)
        merges = self.merges[: max(0, n - k)]
        top = list(range(n + len(merges)))
        for step in range(len(merges) - 1, -1, -1):  # a merge's own top is known before its parts'
            a, b, _, _ = merges[step]
            top[a] = top[b] = top[n + step]
        names: dict[int, int] = {}
        return [names.setdefault(x, len(names)) for x in top[:n]]

    def height_between(self, k: int) -> float:
        """A height that parts k clusters from k - 1."""
        n = len(self.leaves)
        below = self.merges[n - k - 1][2] if 0 <= n - k - 1 else 0.0
        above = self.merges[n - k][2] if n - k < len(self.merges) else below
        return (below + above) / 2


def linkage_tree(points: DataFrame, method: str = "ward", max_leaves: int | None = None, seed: int = 0, tail: int = trees.TAIL) -> Tree:
    """Agglomeration by ward, complete, average or single linkage.

    Exact at any size, with all different vectors as leaves, unless the caller
    asks for ``max_leaves`` at most: then, if there are more, the leaves are
    k-means centres (``MAX_CENTRES`` at most) with their sizes as weights.  By
    ward and single linkage memory and disk grow with the vectors, by complete
    and average the distances are a matrix over all tasks, on disk.  One task
    takes the last ``tail`` clusters.
    """
    spark = points.sparkSession
    keyed = points.withColumn("x", vector_to_array("features"))
    distinct = keyed.groupBy("x").agg(F.count("*").alias("n"))
    if max_leaves is None or distinct.limit(max_leaves + 1).count() <= max_leaves:
        leaves = checkpointed(_numbered(distinct))
        own, n = leaves.select("x", "leaf"), leaves.count()
        members = keyed.join(F.broadcast(own) if n <= MAX_LEAVES else own, "x").select("profile_id", "features", "leaf")
        return Tree(trees.agglomerate(leaves, method, tail), range(n), members)
    model = KMeans(k=min(max_leaves, MAX_CENTRES), seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
    assigned = model.transform(points)
    sizes = {r["cluster"]: r["count"] for r in assigned.groupBy("cluster").count().collect()}
    rows = [(k, c, model.clusterCenters()[c].tolist(), sizes[c]) for k, c in enumerate(sorted(sizes))]
    leaves = spark.createDataFrame(rows, "leaf int, cluster int, x array<double>, n long")
    members = assigned.join(F.broadcast(leaves.select("cluster", "leaf")), "cluster").select("profile_id", "features", "leaf")  # MAX_CENTRES rows
    return Tree(trees.agglomerate(leaves, method, tail), range(len(rows)), members)


def _numbered(distinct: DataFrame) -> DataFrame:
    """(leaf, x, n): leaves in the order of x, numbered over all partitions."""
    placed = checkpointed(distinct.orderBy("x").select("x", "n", F.monotonically_increasing_id().alias("m")))
    sizes = sorted((r["p"], r["count"]) for r in placed.groupBy(F.shiftright("m", 33).alias("p")).count().collect())  # a row a partition
    begin = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    first = distinct.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, begin, strict=False)], "p long, b long")
    return placed.join(F.broadcast(first), F.shiftright("m", 33) == F.col("p")).select((F.col("b") + F.col("m").bitwiseAND((1 << 33) - 1)).cast("int").alias("leaf"), "x", "n")


def hierarchical(tree: Tree, k: int) -> DataFrame:
    """(profile_id, features, cluster) of the tree cut into k."""
    labels = np.array(tree.cut(k), dtype=np.int32)
    own = tree.members.sparkSession.createDataFrame(pa.table({"leaf": np.arange(len(labels), dtype=np.int32), "cluster": labels}))
    return tree.members.join(F.broadcast(own), "leaf").select("profile_id", "features", "cluster")  # a row a leaf


def merge_table(spark: SparkSession, tree: Tree) -> DataFrame:
    """(step, left, right, height, size)."""
    left, right, height, size = zip(*tree.merges, strict=True) if tree.merges else ((), (), (), ())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
    columns = [pa.array(c, k) for c, k in zip((range(len(size)), left, right, height, size), kinds, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=["step", "left", "right", "height", "size"]))


def scan_tree(tree: Tree, max_k: int) -> DataFrame:
    """(k, silhouette) of the tree's cuts; the best k is the first by ``ranked``."""
    ks = list(range(2, min(max_k, len(tree.leaves)) + 1))
    if not ks:
        return tree.members.sparkSession.createDataFrame([], "k int, silhouette double")
    cuts = np.array([tree.cut(k) for k in ks], dtype=np.int32).T
    own = tree.members.sparkSession.createDataFrame(pa.table({"leaf": pa.array(np.arange(len(cuts), dtype=np.int32)), "labels": pa.array(cuts.tolist(), pa.list_(pa.int32()))}))
    rows = tree.members.join(own, "leaf").select("profile_id", vector_to_array("features").alias("x"), "labels")
    return tree.members.sparkSession.createDataFrame(list(zip(ks, mean_silhouettes(rows, ks), strict=True)), "k int, silhouette double")


@dataclass(frozen=True)
class Stages:
    """assignments: (profile_id, cluster_wind, cluster_therm, cluster); map: cluster to its two parts."""

    assignments: DataFrame
    map: dict[int, tuple[int, int]]


def two_stage(matrix: DataFrame, k_wind: int, wind: list[str] | None = None, thermal: list[str] | None = None, n_wind: int = 3, k_therm: int | None = None,
              n_therm: int = 2, max_k: int = 5, share: float = 0.90, min_silhouette: float = 0.05, min_size: int = 10, n_init: int = 10, seed: int = 0) -> Stages:
    """Wind regimes, then thermal types in each.

    With ``k_therm`` every regime large enough has so many types.  Without, a
    regime's components reach ``share`` of its variance and its number of types
    is that of the best silhouette, from ``min_silhouette`` on, whose types all
    have ``min_size`` profiles; else 1.
    """
    kept = matrix.is_cached
    matrix.persist()  # of three passes
    present = {r["var"] for r in matrix.select("var").distinct().collect()}
    wind = [v for v in ("u", "v") if v in present] if wind is None else wind
    thermal = [v for v in ("t", "td", "t-td") if v in present] if thermal is None else thermal
    for names, what in ((wind, "wind"), (thermal, "thermal")):
        if not names:
            raise ValueError(f"no {what} variable")
        if set(names) - present:
            raise ValueError(f"unknown variables: {sorted(set(names) - present)}")
    points = vectors(blocks(matrix, wind), wind).persist()
    n = points.count()
    first = k_means(reduce(points, max(1, min(n_wind, n - 1))).scores, k_wind, seed, n_init).assignments.select("profile_id", F.col("cluster").alias("cluster_wind")).persist()
    heat = vectors(blocks(matrix, thermal), thermal).join(first, "profile_id").withColumnRenamed("cluster_wind", "group").persist()
    sizes = {r["group"]: r["count"] for r in heat.groupBy("group").count().collect()}
    points.unpersist()
    if not kept:
        matrix.unpersist()
    if k_therm is None:
        wanted = {w: range(2, min(max_k + 1, m)) for w, m in sizes.items() if m > 1}
    else:
        wanted = {w: [k_therm] for w, m in sizes.items() if 2 <= k_therm <= m}
    widths, scores = _reduced_groups(heat, {w: max(1, sizes[w] - 1) if k_therm is None else min(n_therm, sizes[w] - 1) for w in wanted}, share if k_therm is None else None)
    fitted = kmeans.best_of(kmeans.fit(scores, [Run(k, seed, s, widths[w], w) for w, ks in wanted.items() for k in ks for s in range(n_init)])) if widths else []
    labels = kmeans.labelled(scores, fitted).persist()
    chosen = {f.run.group: j for j, f in enumerate(fitted)}
    if k_therm is None and fitted:
        counts: dict[int, dict[int, int]] = {}
        for r in labels.select(F.posexplode("labels").alias("run", "c")).filter("c >= 0").groupBy("run", "c").count().collect():
            counts.setdefault(r["run"], {})[r["c"]] = r["count"]
        found = mean_silhouettes(labels, [max(1, len(f.centres)) for f in fitted], [f.run.width for f in fitted])
        good = [j for j in range(len(fitted)) if len(counts[j]) > 1 and min(counts[j].values()) >= min_size and found[j] >= min_silhouette]
        chosen = {}
        for j in sorted(good, key=lambda j: (found[j], -fitted[j].run.k)):  # the last is the best, of equal ones that of fewer types
            chosen[fitted[j].run.group] = j
    types = {w: len(fitted[chosen[w]].centres) if w in chosen else 1 for w in range(k_wind)}
    pairs = [(w, t) for w in range(k_wind) for t in range(types[w])]
    at = F.create_map(*[F.lit(x) for w, j in chosen.items() for x in (w, j)])[F.col("g")] if chosen else F.lit(None).cast("int")
    heat_type = labels.select("profile_id", F.coalesce(F.get("labels", at), F.lit(0)).alias("cluster_therm")) if fitted else first.select("profile_id", F.lit(0).alias("cluster_therm"))
    # a regime with too few profiles for components has no scores and one type
    out = first.join(heat_type, "profile_id", "left").withColumn("cluster_therm", F.coalesce("cluster_therm", F.lit(0)))
    place = F.create_map(*[F.lit(x) for k, (w, t) in enumerate(pairs) for x in (f"{w}:{t}", k)])
    out = out.withColumn("cluster", place[F.concat_ws(":", F.col("cluster_wind").cast("string"), F.col("cluster_therm").cast("string"))])
    return Stages(out.select("profile_id", "cluster_wind", "cluster_therm", "cluster"), dict(enumerate(pairs)))


def _moments(shift: dict[int, np.ndarray] | None):
    """Of each partition and group: rows, and the sum of vectors, or of products of vectors less their group's mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            own = batch.column("g").to_numpy()
            for g in np.unique(own):
                x = kmeans._matrix(batch.column("x").take(pa.array(np.flatnonzero(own == g))))
                part = x.sum(axis=0) if shift is None else ((x - shift[int(g)]).T @ (x - shift[int(g)])).ravel()
                if int(g) in total:
                    total[int(g)][0] += len(x)
                    total[int(g)][1] += part
                else:
                    total[int(g)] = [len(x), part]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([float(t[0]) for t in total.values()], pa.float64()), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64()))], names=["g", "n", "x"])

    return run


def _reduced_groups(points: DataFrame, most: dict[int, int], share: float | None) -> tuple[dict[int, int], DataFrame]:
    """Principal components inside each group, all groups at once: (how many count by group, (profile_id, group, features)).

    Of a group its ``most`` first components, or as many of them as reach
    ``share`` of its variance.  A matrix of columns by columns a group comes to the driver.
    """
    rows = kmeans.prepared(points).filter(F.col("g").isin(*most)) if most else kmeans.prepared(points).limit(0)
    summed = lambda shift: rows.select("g", "x").mapInArrow(_moments(shift), "g int, n double, x array<double>").withColumn("x", array_to_vector("x")).groupBy("g").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("x")).alias("x")).collect()
    means = {r["g"]: r["x"].toArray() / r["n"] for r in summed(None)}
    bases, widths = {}, {}
    for r in summed(means):
        d = len(means[r["g"]])
        values, vectors_ = np.linalg.eigh(r["x"].toArray().reshape(d, d) / max(1.0, r["n"] - 1))
        values, vectors_ = np.maximum(values[::-1], 0), vectors_[:, ::-1]
        vectors_ = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(d)] < 0, -1, 1)
        explained = values / values.sum() if values.sum() else np.ones(d)
        n = min(most[r["g"]], d)
        widths[r["g"]] = n if share is None else max(1, min(components_for(explained[:n], share), n))
        bases[r["g"]] = vectors_
    wide = max(widths.values(), default=1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = batch.column("g").to_numpy(), np.zeros((batch.num_rows, wide))
            for g in np.unique(own):
                at = np.flatnonzero(own == g)
                x = kmeans._matrix(batch.column("x").take(pa.array(at))) - means[int(g)]
                base = bases[int(g)][:, :wide]
                part = np.zeros((len(x), base.shape[1]))
                for k in range(x.shape[1]):  # column by column, so that equal rows stay equal to the last bit
                    part += x[:, k : k + 1] * base[k]
                out[at, : part.shape[1]] = part
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * wide), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("profile_id"), batch.column("g"), lists], names=["profile_id", "group", "features"])

    kind = points.schema["profile_id"].dataType.simpleString()
    return widths, rows.select("profile_id", "g", "x").mapInArrow(project, f"profile_id {kind}, group int, features array<double>")
