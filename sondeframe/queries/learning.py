"""Feature matrices, clusterings and their evaluation, from vectors and event profiles."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.operators import aggregate, cells, cluster, evaluate, matrix, qc
from sondeframe.queries.common import E, G, events, on_grid, r, round_to, rounded, table
from sondeframe.sources import adapters
from sondeframe.sources.storage import checkpointed


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return adapters.vector_matrix(table(spark, d, "embeddings"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return adapters.vector_labels(table(spark, d, "embeddings"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    return matrix.vectors(_vectors(spark, d))


def _array_points(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").cast("string").alias("profile_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster"))


def _gappy(spark: SparkSession, d: str, limits: dict[str, tuple[float, float]] = {"t": (205.0, 320.0), "ff": (1.0, 30.0)}) -> DataFrame:  # noqa: B006
    """Event profiles with values out of range as nulls: a matrix over all levels."""
    rows = qc.apply_limits(events(spark, d), limits)
    pairs = F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).alias("val")) for v in ("t", "ff")])
    return rows.select("profile_id", F.col("level_idx").cast("int").alias("g_idx"), F.explode(pairs).alias("x")).select("profile_id", "x.var", "g_idx", "x.val")


def build_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.build_matrix(on_grid(spark, d), anomaly=True), 5)


def impute_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.impute(_gappy(spark, d), "mean"))


def impute_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.impute(_gappy(spark, d), "median"))


def impute_most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.impute(_gappy(spark, d), "most_frequent"))


def impute_drop(spark: SparkSession, d: str) -> DataFrame:
    """Of profiles with few values out of range those without any."""
    return rounded(matrix.impute(_gappy(spark, d, {"t": (200.0, 1000.0), "ff": (0.2, 100.0)}), "drop"))


def standardise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.standardise(_vectors(spark, d)), 5)


def scale_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.scale_shape(_gappy(spark, d), ["t"]))


def scale_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.scale_shape(_gappy(spark, d), everywhere=True))


def scale_block_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.scale_block(_gappy(spark, d), None, "std"), 5)


def scale_block_z(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.scale_block(_gappy(spark, d), None, "z"), 5)


def scale_block_max(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.scale_block(_gappy(spark, d), ["ff"], "max"), 5)


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("profile_id"), *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(64)])
    return rounded(aggregate.cluster_summary(rows, _labels(spark, d), [f"e{k}" for k in range(64)]), 5)


def effect_size(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.effect_size(_vectors(spark, d), _labels(spark, d)), 4)


def anova_f(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.anova(_vectors(spark, d), _labels(spark, d)).select("var", "f"), 4)


def anova_p(spark: SparkSession, d: str) -> DataFrame:
    """With the tail probability, which SQL integrates."""
    found = evaluate.anova(_vectors(spark, d), _labels(spark, d))
    return found.select("var", round_to(F.col("f"), 4).alias("f"), round_to(F.col("p"), 5).alias("p"))


def correlations(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 5)


def silhouettes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.silhouette(_array_points(spark, d)), 5)


def silhouettes_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same by cells, at tolerance 0."""
    return rounded(cells.silhouette_cells(_array_points(spark, d)).rows, 5)


def cluster_inertia(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.inertia(_array_points(spark, d)), 3)


def _labelings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select((F.col("p_size") % 4).alias("a"), F.substring("p_brand", -1, 1).alias("b"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_labelings(spark, d), "a", "b")


def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.adjusted_rand(_labelings(spark, d), "a", "b"), 8)


def best_match(spark: SparkSession, d: str) -> DataFrame:
    """How well the best one-to-one matching does; of several equally good ones any is the operator's."""
    score, pairs = evaluate.best_match(_labelings(spark, d), "a", "b")
    return rounded(spark.createDataFrame([(float(score), len(pairs))], "accuracy double, pairs int"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Five labelings of the vectors, by the signs of single coordinates."""
    rows = table(spark, d, "embeddings")
    signs = F.array(*[(F.col("embedding")[3 * k] > 0).cast("int") + 2 * (F.col("embedding")[3 * k + 1] > 0).cast("int") for k in range(5)])
    return rows.select(F.col("vec_id").cast("string").alias("profile_id"), F.posexplode(signs).alias("run", "cluster"))


def co_membership(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.co_membership(_runs(spark, d)))


def pair_bands(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.pair_bands(evaluate.consensus_classes(_runs(spark, d)))


def ranked_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("score"))
    return evaluate.curve_peaks(evaluate.ranked(scores, "score", "p_size", ["p_brand"]), "score", "p_size", ["p_brand"])


def most_common(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.most_common(table(spark, d, "lineitem"), "l_quantity", 10)


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = cluster.reduce(_points(spark, d), 5).scores
    return rounded(scores.select("profile_id", *[vector_to_array("features")[k].alias(f"pc{k + 1}") for k in range(5)]), 6)


def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.cumulative_variance(spark, cluster.reduce(_points(spark, d), 10).explained))


def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.reduce(_points(spark, d), 3)
    return rounded(cluster.top_loadings(cluster.loadings(spark, found.components, [f"e{k:02d}" for k in range(found.components.shape[0])]), 8))


def _reduced(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    return cluster.reduce(_points(spark, d), n).scores


def k_means(spark: SparkSession, d: str) -> DataFrame:
    return cluster.k_means(_points(spark, d), 6).assignments.select("profile_id", "cluster")


def k_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.scan_k(_points(spark, d)), 4)


def component_scan(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.scan_components(_points(spark, d), 4), 4)


def seed_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.seed_sweep(_points(spark, d), list(range(2, 7)), list(range(20))), 4)


def consensus(spark: SparkSession, d: str) -> DataFrame:
    """200 runs: which profiles always share a cluster, and with how many others each such class does so mostly, hardly or now and then."""
    return evaluate.consensus_classes(cluster.runs(_points(spark, d), 6, list(range(200))))


def gaussian_mixture(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.mixture(_reduced(spark, d, 2), [3, 4, 5], list(range(30)))[1], 2)


def linkage_ward(spark: SparkSession, d: str) -> DataFrame:
    return cluster.merge_table(spark, cluster.linkage_tree(_reduced(spark, d)))


def _single(spark: SparkSession, d: str) -> cluster.Tree:
    return cluster.linkage_tree(_points(spark, d), "single")


def linkage_single(spark: SparkSession, d: str) -> DataFrame:
    """Heights of the merges in order."""
    return rounded(cluster.merge_table(spark, _single(spark, d)).select("step", "height"), 5)


def hierarchical_single(spark: SparkSession, d: str) -> DataFrame:
    """A cluster is named by its smallest id."""
    own = cluster.hierarchical(_single(spark, d), 6)
    names = own.groupBy("cluster").agg(F.min("profile_id").alias("name"))
    return own.join(F.broadcast(names), "cluster").select("profile_id", F.col("name").alias("cluster"))  # a row a cluster


def tree_scan_single(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cluster.scan_tree(_single(spark, d), 4), 5)


def hierarchical(spark: SparkSession, d: str) -> DataFrame:
    return cluster.hierarchical(cluster.linkage_tree(_reduced(spark, d), "average"), 6).select("profile_id", "cluster")


def tree_scan(spark: SparkSession, d: str) -> DataFrame:
    return cluster.scan_tree(cluster.linkage_tree(_reduced(spark, d)), 4)


def two_stage(spark: SparkSession, d: str) -> DataFrame:
    grid = checkpointed(on_grid(spark, d))  # fills and scales are passes over it
    rows = matrix.standardise(matrix.impute(matrix.build_matrix(grid), "mean"))
    return cluster.two_stage(rows, 2).assignments


QUERIES = {f.__name__: f for f in (
    build_matrix, impute_mean, impute_median, impute_most_frequent, impute_drop, standardise, scale_profile, scale_global, scale_block_std, scale_block_z, scale_block_max,
    cluster_summary, effect_size, anova_f, anova_p, correlations, silhouettes, silhouettes_cells, cluster_inertia, confusion, adjusted_rand, best_match, co_membership, pair_bands, ranked_scores,
    most_common, pca_scores, pca_variance, pca_loadings, k_means, k_scan, component_scan, seed_sweep, consensus, gaussian_mixture, linkage_ward, linkage_single, hierarchical, hierarchical_single,
    tree_scan, tree_scan_single, two_stage,
)}

_V = "v AS (SELECT CAST(vec_id AS VARCHAR) AS profile_id, label AS cluster, printf('e%02d', CAST(i - 1 AS INTEGER)) AS var, CAST(i - 1 AS INTEGER) AS g_idx, CAST(embedding[i] AS DOUBLE) AS val FROM embeddings, range(1, 65) t(i))"
_GAPPY = f"""{E}, m AS (
    SELECT profile_id, 't' AS var, CAST(level_idx AS INTEGER) AS g_idx, CASE WHEN t BETWEEN 205 AND 320 THEN t END AS val FROM e
    UNION ALL SELECT profile_id, 'ff', CAST(level_idx AS INTEGER), CASE WHEN ff BETWEEN 1 AND 30 THEN ff END FROM e)"""
_BLOCKS = f"""{_GAPPY}, lv AS (SELECT var, g_idx, var_pop(val) AS v, sum(val) AS s, count(val) AS n, max(abs(val)) AS m FROM m GROUP BY 1, 2),
    bl AS (SELECT var, sqrt(avg(v)) AS sd, sum(s) / sum(n) AS mu, max(m) AS mx FROM lv GROUP BY 1)"""
_RUNS = """runs AS (SELECT CAST(vec_id AS VARCHAR) AS profile_id, i AS run, CAST(embedding[3 * i + 1] > 0 AS INT) + 2 * CAST(embedding[3 * i + 2] > 0 AS INT) AS cluster FROM embeddings, range(5) t(i)),
    co AS (SELECT x.profile_id AS a, y.profile_id AS b, count(*) / 5e0 AS share FROM runs x JOIN runs y ON x.run = y.run AND x.cluster = y.cluster AND x.profile_id < y.profile_id GROUP BY 1, 2)"""
_LAB = "l AS (SELECT CAST(p_size % 4 AS INTEGER) AS a, right(p_brand, 1) AS b FROM part)"


def _build_sql() -> str:
    t0, z0 = ("first_value({}) OVER (PARTITION BY profile_id ORDER BY altitude)".format(c) for c in ("t", "altitude"))
    dry = f"({t0} - 0.0098e0 * (altitude - {z0}))"
    values = {"t": f"t - {dry}", "td": f"td - {dry}", "t-td": "t - td", "u": "-1 * ff * sin(radians(dd))", "v": "-1 * ff * cos(radians(dd))"}
    parts = " UNION ALL ".join(f"SELECT profile_id, '{n}' AS var, g_idx, {r(x, 'val', 5)} FROM g" for n, x in values.items())
    return f"WITH {E}, {G} {parts}"


def _components_sql(n: int, squarings: int = 14) -> str:
    """Tables a0 (covariances as rows) and v1 to vn (the components, their variance and what they leave of the covariances).

    A matrix squared so often projects on its first component, which is then taken out of it.
    """
    parts = [f"""{_V}, c AS (SELECT x.g_idx AS i, y.g_idx AS j, covar_samp(x.val, y.val) AS c FROM v x JOIN v y USING (profile_id) GROUP BY 1, 2),
        a0 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS row FROM c GROUP BY 1))"""]
    for k in range(1, n + 1):
        parts.append(f"""p{k} AS (
            SELECT 0 AS step, m FROM a{k - 1}
            UNION ALL
            SELECT step + 1, list_transform(m, lambda x: list_transform(m, lambda y: list_inner_product(x, y)))
            FROM (SELECT step, list_transform(m, lambda x: list_transform(x, lambda y: y / size)) AS m
                  FROM (SELECT step, m, list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS size FROM p{k} WHERE step < {squarings}))),
        r{k} AS (SELECT m[list_position(diag, list_max(diag))] AS row FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diag FROM p{k} WHERE step = {squarings})),
        u{k} AS (SELECT list_transform(row, lambda x: x / norm) AS v
                 FROM (SELECT row, sqrt(list_inner_product(row, row)) * CASE WHEN list_max(row) >= -list_min(row) THEN 1 ELSE -1 END AS norm FROM r{k})),
        v{k} AS (SELECT v, list_inner_product(v, list_transform(m, lambda x: list_inner_product(x, v))) AS variance, m FROM u{k}, a{k - 1}),
        a{k} AS (SELECT list_transform(m, lambda x, i: list_transform(x, lambda y, j: y - variance * v[i] * v[j])) AS m FROM v{k})""")
    return "WITH RECURSIVE " + ", ".join(parts)


def _fits_sql(runs: str, points: str = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings", widths: str = "(64)", most: int = 64) -> str:
    """Tables runs (run, k, seed, start, width), pts, fits (run, centres), labels (run, id, x, cluster, far): the races of the draws and the rounds replayed."""
    number = "((CAST(seed AS BIGINT) * 1000 + start) * 1000 + {})"
    time = "-ln((((1 + ({0} * 1103515245 + 12345) % 2147483646) * h + ({0} * 22695477 + 1) % 2147483647) % 2147483647 + 1) / 2147483648e0)"
    first, later = time.format(number.format("0")), time.format(number.format("draw + 1"))
    return f"""raw AS ({points}), pts AS (SELECT w AS width, id, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 2147483647 AS h, x[1:w] AS x FROM raw, (VALUES {widths}) t(w)),
        runs AS ({runs}),
        draws AS (
            SELECT 0 AS draw, run, [arg_min(x, ({first}, id))] AS centres FROM runs JOIN pts USING (width) GROUP BY run
            UNION ALL
            SELECT draw + 1, run, list_append(any_value(centres), arg_min(x, ({later} / (far * far), id)))
            FROM (SELECT s.draw, r.*, s.centres, p.id, p.h, p.x, list_min(list_transform(s.centres, lambda c: list_distance(c, p.x))) AS far
                  FROM draws s JOIN runs r USING (run) JOIN pts p USING (width) WHERE s.draw + 1 < r.k) WHERE far > 1e-12 GROUP BY draw, run),
        lloyd AS (
            SELECT 0 AS step, run, centres, true AS moving FROM draws JOIN runs USING (run) WHERE draw + 1 = k
            UNION ALL
            SELECT step + 1, run, new, list_max(list_transform(new, lambda c, i: list_distance(c, centres[i]))) > 1e-9
            FROM (SELECT step, run, centres, list_transform(centres, lambda c, i: coalesce(means[i], c)) AS new
                  FROM (SELECT step, run, any_value(centres) AS centres, map_from_entries(list({{'k': near, 'v': mean}})) AS means
                        FROM (SELECT step, run, near, any_value(centres) AS centres, [{", ".join(f"avg(x[{i}])" for i in range(1, most + 1))}][1:any_value(width)] AS mean
                              FROM (SELECT step, run, centres, width, x, list_position(d, list_min(d)) AS near
                                    FROM (SELECT l.step, l.run, l.centres, p.width, p.x, list_transform(l.centres, lambda c: list_distance(c, p.x)) AS d
                                          FROM lloyd l JOIN runs USING (run) JOIN pts p USING (width) WHERE l.moving AND l.step < 100))
                              GROUP BY step, run, near)
                        GROUP BY step, run))),
        fits AS (SELECT run, arg_max(centres, step) AS centres FROM lloyd GROUP BY 1),
        labels AS (SELECT run, k, seed, start, width, id, x, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS cluster, list_min(d) * list_min(d) AS far
                   FROM (SELECT r.*, p.id, p.x, list_transform(f.centres, lambda c: list_distance(c, p.x)) AS d FROM fits f JOIN runs r USING (run) JOIN pts p USING (width))),
        costs AS (SELECT run, k, seed, start, width, sum(far) AS inertia FROM labels GROUP BY ALL)"""


#: Mean silhouettes of the labelings in ``chosen`` (run).
_SCORES = """far AS (SELECT a.width, a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM pts a JOIN pts b ON a.width = b.width AND a.id <> b.id),
    sums AS (SELECT x.run, i, x.cluster AS ci, y.cluster AS cj, avg(d) AS d FROM labels x JOIN chosen USING (run) JOIN far ON far.width = x.width AND far.i = x.id JOIN labels y ON y.run = x.run AND y.id = far.j GROUP BY 1, 2, 3, 4),
    own AS (SELECT run, i, max(d) FILTER (ci = cj) AS a, min(d) FILTER (ci <> cj) AS b FROM sums GROUP BY 1, 2),
    scores AS (SELECT run, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0e0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0e0), 0e0) END) AS silhouette FROM own GROUP BY 1)"""

#: Prim's order of the vectors: of single linkage, clusters are runs of it, cut at the greatest heights.
_PRIM = """RECURSIVE pts AS (SELECT row_number() OVER (ORDER BY x) AS node, x, ids FROM (SELECT CAST(embedding AS DOUBLE[]) AS x, list(CAST(vec_id AS VARCHAR)) AS ids FROM embeddings GROUP BY 1)),
    prim AS (SELECT 0 AS step, node, CASE WHEN node = 1 THEN -1e0 ELSE 1e300 END AS dist FROM pts
             UNION ALL
             SELECT s.step + 1, s.node, least(s.dist, list_distance(p.x, q.x))
             FROM (SELECT *, first_value(node) OVER (ORDER BY dist, node) AS taken FROM prim) s JOIN pts p ON p.node = s.taken JOIN pts q ON q.node = s.node WHERE s.node <> s.taken),
    reached AS (SELECT step, arg_min(node, (dist, node)) AS node, min(dist) AS height FROM prim GROUP BY 1),
    ordered AS (SELECT *, row_number() OVER (ORDER BY height DESC) AS place FROM reached WHERE step > 0),
    cuts AS (SELECT k, node, sum(CASE WHEN place < k THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY step) AS part
             FROM (SELECT step, node, NULL AS place FROM reached WHERE step = 0 UNION ALL SELECT step, node, place FROM ordered), range(2, 7) t(k)),
    members AS (SELECT k, part, unnest(ids) AS profile_id FROM cuts JOIN pts USING (node))"""


SQL = {
    "pca_variance": _components_sql(10) + f""", each AS ({" UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS component, variance FROM v{k}" for k in range(1, 11))}),
        t AS (SELECT list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i])) AS total FROM a0)
        SELECT component, {r('variance / total', 'share')}, {r('sum(variance) OVER (ORDER BY component) / total', 'total')} FROM each, t""",
    "pca_loadings": _components_sql(3) + f""", each AS ({" UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS component, printf('e%02d', CAST(i - 1 AS INTEGER)) AS feature, v[i] AS loading FROM v{k}, range(1, 65) t(i)" for k in range(1, 4))}),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS INTEGER) AS rank FROM each)
        SELECT feature, component, {r('loading', 'loading')}, rank FROM ranked WHERE rank <= 8""",
    "pca_scores": _components_sql(5) + f""", mean AS (SELECT list(m ORDER BY g_idx) AS mean FROM (SELECT g_idx, avg(val) AS m FROM v GROUP BY 1)),
        centred AS (SELECT CAST(vec_id AS VARCHAR) AS profile_id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) - mean[i]) AS x FROM embeddings, mean)
        SELECT profile_id, {", ".join(r(f'list_inner_product(x, v{k}.v)', f'pc{k}', 6) for k in range(1, 6))} FROM centred, v1, v2, v3, v4, v5""",
    "k_means": "WITH RECURSIVE " + _fits_sql("SELECT CAST(s AS INTEGER) AS run, 6 AS k, 0 AS seed, s AS start, 64 AS width FROM range(20) t(s)") + """
        SELECT id AS profile_id, cluster FROM labels WHERE run = (SELECT arg_min(run, (inertia, start)) FROM costs)""",
    "k_scan": "WITH RECURSIVE " + _fits_sql("SELECT CAST(k * 100 + s AS INTEGER) AS run, CAST(k AS INTEGER) AS k, 0 AS seed, s AS start, 64 AS width FROM range(2, 11) a(k), range(20) t(s)") + f""",
        chosen AS (SELECT k, arg_min(run, (inertia, start)) AS run, min(inertia) AS inertia FROM costs GROUP BY 1), {_SCORES}
        SELECT k, {r('inertia', 'inertia', 4)}, {r('silhouette', 'silhouette', 4)} FROM chosen JOIN scores USING (run)""",
    "seed_sweep": "WITH RECURSIVE " + _fits_sql("SELECT CAST(k * 100 + s AS INTEGER) AS run, CAST(k AS INTEGER) AS k, CAST(s AS INTEGER) AS seed, 0 AS start, 64 AS width FROM range(2, 7) a(k), range(20) t(s)") + f""",
        chosen AS (SELECT run FROM runs), {_SCORES}
        SELECT k, seed, {r('inertia', 'inertia', 4)}, {r('silhouette', 'silhouette', 4)} FROM costs JOIN scores USING (run)""",
    "component_scan": _components_sql(8, 20) + f""", mean AS (SELECT list(m ORDER BY g_idx) AS mean FROM (SELECT g_idx, avg(val) AS m FROM v GROUP BY 1)),
        centred AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) - mean[i]) AS x FROM embeddings, mean),
        {_fits_sql("SELECT CAST(w * 100 + s AS INTEGER) AS run, 4 AS k, 0 AS seed, s AS start, w AS width FROM range(1, 9) a(w), range(5) t(s)",
                   "SELECT id, [" + ", ".join(f"list_inner_product(x, v{k}.v)" for k in range(1, 9)) + "] AS x FROM centred, " + ", ".join(f"v{k}" for k in range(1, 9)), ", ".join(f"({w})" for w in range(1, 9)), 8)},
        chosen AS (SELECT width, arg_min(run, (inertia, start)) AS run FROM costs GROUP BY 1), {_SCORES}
        SELECT CAST(width AS INTEGER) AS n, {r('silhouette', 'silhouette', 4)} FROM chosen JOIN scores USING (run)""",
    "consensus": "WITH RECURSIVE " + _fits_sql("SELECT CAST(s AS INTEGER) AS run, 6 AS k, s AS seed, 0 AS start, 64 AS width FROM range(200) t(s)") + """,
        own AS (SELECT id, list(cluster ORDER BY run) AS l FROM labels GROUP BY 1),
        classes AS (SELECT l, min(id) AS class_id, count(*) AS size, list(id) AS ids FROM own GROUP BY 1),
        shares AS (SELECT a.class_id, b.size - CAST(a.class_id = b.class_id AS INTEGER) AS n, list_sum(list_transform(a.l, lambda x, i: CAST(x = b.l[i] AS INTEGER))) / 200e0 AS share FROM classes a, classes b),
        links AS (SELECT class_id, CAST(coalesce(sum(n) FILTER (share > 0.8e0), 0) AS BIGINT) AS stable, CAST(coalesce(sum(n) FILTER (share < 0.2e0), 0) AS BIGINT) AS separate,
                         CAST(coalesce(sum(n) FILTER (share BETWEEN 0.3e0 AND 0.7e0), 0) AS BIGINT) AS ambiguous FROM shares GROUP BY 1)
        SELECT unnest(ids) AS profile_id, class_id, size, stable, separate, ambiguous FROM classes JOIN links USING (class_id)""",
    "gaussian_mixture": _components_sql(2, 20) + f""", mean AS (SELECT list(m ORDER BY g_idx) AS mean FROM (SELECT g_idx, avg(val) AS m FROM v GROUP BY 1)),
        centred AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) - mean[i]) AS x FROM embeddings, mean),
        {_fits_sql("SELECT CAST(k * 100 + s AS INTEGER) AS run, CAST(k AS INTEGER) AS k, CAST(s AS INTEGER) AS seed, 0 AS start, 2 AS width FROM range(3, 6) a(k), range(30) t(s)",
                   "SELECT id, [list_inner_product(x, v1.v), list_inner_product(x, v2.v)] AS x FROM centred, v1, v2", "(2)", 2)},
        em AS (
            SELECT 0 AS step, run, cluster AS c, CAST(count(*) AS DOUBLE) AS n, avg(x[1]) AS a, avg(x[2]) AS b, avg(x[1] * x[1]) - avg(x[1]) * avg(x[1]) + 1e-6 AS s, avg(x[2] * x[2]) - avg(x[2]) * avg(x[2]) + 1e-6 AS t,
                   avg(x[1] * x[2]) - avg(x[1]) * avg(x[2]) AS u, -1e300 AS last, -1e300 AS before FROM labels GROUP BY run, cluster
            UNION ALL
            SELECT step + 1, run, c, sum(p) AS n, sum(p * x[1]) / sum(p), sum(p * x[2]) / sum(p), sum(p * x[1] * x[1]) / sum(p) - (sum(p * x[1]) / sum(p)) * (sum(p * x[1]) / sum(p)) + 1e-6,
                   sum(p * x[2] * x[2]) / sum(p) - (sum(p * x[2]) / sum(p)) * (sum(p * x[2]) / sum(p)) + 1e-6, sum(p * x[1] * x[2]) / sum(p) - (sum(p * x[1]) / sum(p)) * (sum(p * x[2]) / sum(p)),
                   any_value(total), any_value(last)
            FROM (SELECT *, sum(own) OVER (PARTITION BY run) AS total
                  FROM (SELECT step, run, c, x, last, exp(l - m) / sum(exp(l - m)) OVER (PARTITION BY run, id) AS p,
                               CASE WHEN c = min(c) OVER (PARTITION BY run, id) THEN m + ln(sum(exp(l - m)) OVER (PARTITION BY run, id)) ELSE 0e0 END AS own
                        FROM (SELECT *, max(l) OVER (PARTITION BY run, id) AS m
                              FROM (SELECT e.step, e.run, e.c, e.last, p.id, p.x, ln(e.n / (SELECT count(*) FROM embeddings)) - 0.5e0 * ln(e.s * e.t - e.u * e.u) - ln(2 * pi())
                                           - 0.5e0 * (e.t * (p.x[1] - e.a) * (p.x[1] - e.a) - 2 * e.u * (p.x[1] - e.a) * (p.x[2] - e.b) + e.s * (p.x[2] - e.b) * (p.x[2] - e.b)) / (e.s * e.t - e.u * e.u) AS l
                                    FROM em e, pts p WHERE e.step < 101 AND (e.step < 2 OR (e.last - e.before) / (SELECT count(*) FROM embeddings) >= 1e-3)))))
            GROUP BY step, run, c),
        ends AS (SELECT run, arg_max(last, step) AS log_likelihood FROM em GROUP BY 1)
        SELECT k, seed, {r('log_likelihood', 'log_likelihood', 2)}, {r('-2 * log_likelihood + (6 * k - 1) * ln((SELECT count(*) FROM embeddings))', 'bic', 2)} FROM ends JOIN runs USING (run)""",
    "linkage_single": f"WITH {_PRIM} SELECT CAST(row_number() OVER (ORDER BY height) - 1 AS INTEGER) AS step, {r('height', 'height', 5)} FROM reached WHERE step > 0",
    "hierarchical_single": f"WITH {_PRIM} SELECT profile_id, min(profile_id) OVER (PARTITION BY part) AS cluster FROM members WHERE k = 6",
    "tree_scan_single": f"""WITH {_PRIM}, x AS (SELECT CAST(vec_id AS VARCHAR) AS profile_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
        pairs AS (SELECT a.profile_id AS i, b.profile_id AS j, list_distance(a.x, b.x) AS d FROM x a JOIN x b ON a.profile_id <> b.profile_id),
        m AS (SELECT a.k, i, a.part AS ci, b.part AS cj, avg(d) AS d FROM pairs JOIN members a ON a.profile_id = i JOIN members b ON b.profile_id = j AND b.k = a.k WHERE a.k <= 4 GROUP BY 1, 2, 3, 4),
        s AS (SELECT k, i, max(d) FILTER (ci = cj) AS a, min(d) FILTER (ci <> cj) AS b FROM m GROUP BY 1, 2)
        SELECT CAST(k AS INTEGER) AS k, {r('avg(CASE WHEN a IS NULL OR b IS NULL THEN 0e0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0e0), 0e0) END)', 'silhouette', 5)} FROM s GROUP BY 1""",
    "build_matrix": _build_sql(),
    "impute_mean": f"WITH {_GAPPY} SELECT profile_id, var, g_idx, {r('coalesce(val, avg(val) OVER (PARTITION BY var, g_idx))', 'val')} FROM m QUALIFY count(val) OVER (PARTITION BY var, g_idx) > 0",
    "impute_median": f"WITH {_GAPPY}, f AS (SELECT var, g_idx, median(val) AS fill FROM m GROUP BY 1, 2) SELECT profile_id, var, g_idx, {r('coalesce(val, fill)', 'val')} FROM m JOIN f USING (var, g_idx) WHERE fill IS NOT NULL",
    "impute_most_frequent": f"""WITH {_GAPPY}, c AS (SELECT var, g_idx, val AS fill, row_number() OVER (PARTITION BY var, g_idx ORDER BY count(*) DESC, val) AS k FROM m WHERE val IS NOT NULL GROUP BY 1, 2, 3)
        SELECT profile_id, var, g_idx, {r('coalesce(val, fill)', 'val')} FROM m JOIN c USING (var, g_idx) WHERE k = 1""",
    "impute_drop": f"WITH {E}, s AS (SELECT profile_id, 't' AS var, CAST(level_idx AS INTEGER) AS g_idx, CASE WHEN t BETWEEN 200 AND 1000 THEN t END AS val FROM e UNION ALL SELECT profile_id, 'ff', CAST(level_idx AS INTEGER), CASE WHEN ff BETWEEN 0.2e0 AND 100 THEN ff END FROM e), ok AS (SELECT profile_id FROM s GROUP BY 1 HAVING bool_and(val IS NOT NULL)) SELECT profile_id, var, g_idx, {r('val', 'val')} FROM s JOIN ok USING (profile_id)",
    "standardise": f"WITH {_V}, f AS (SELECT var, avg(val) AS m, stddev_pop(val) AS s FROM v GROUP BY 1) SELECT profile_id, var, g_idx, {r('(val - m) / CASE WHEN s = 0 THEN 1 ELSE s END', 'val', 5)} FROM v JOIN f USING (var)",
    "scale_profile": f"""WITH {_GAPPY}, w AS (SELECT *, min(val) OVER k AS lo, max(val) OVER k AS hi FROM m WINDOW k AS (PARTITION BY profile_id, var))
        SELECT profile_id, var, g_idx, {r("CASE WHEN var <> 't' THEN val WHEN val IS NULL THEN NULL WHEN hi - lo <= 1e-6 THEN 0.5e0 ELSE (val - lo) / (hi - lo) END", 'val')} FROM w""",
    "scale_global": f"""WITH {_GAPPY}, w AS (SELECT *, min(val) OVER k AS lo, max(val) OVER k AS hi FROM m WINDOW k AS (PARTITION BY var))
        SELECT profile_id, var, g_idx, {r('CASE WHEN val IS NULL THEN NULL WHEN hi - lo <= 1e-6 THEN 0.5e0 ELSE (val - lo) / (hi - lo) END', 'val')} FROM w""",
    "scale_block_std": f"WITH {_BLOCKS} SELECT profile_id, var, g_idx, {r('CASE WHEN sd > 1e-8 THEN val / sd ELSE val END', 'val', 5)} FROM m JOIN bl USING (var)",
    "scale_block_z": f"WITH {_BLOCKS} SELECT profile_id, var, g_idx, {r('CASE WHEN sd > 1e-8 THEN (val - mu) / sd ELSE val - mu END', 'val', 5)} FROM m JOIN bl USING (var)",
    "scale_block_max": f"""WITH {_BLOCKS} SELECT profile_id, var, g_idx, {r("CASE WHEN var = 'ff' AND mx > 1e-8 THEN val / mx ELSE val END", 'val', 5)} FROM m JOIN bl USING (var)""",
    "cluster_summary": f"""SELECT label AS cluster, count(*) AS n, {', '.join(x for k in range(64) for x in (r(f'avg(CAST(embedding[{k + 1}] AS DOUBLE))', f'e{k}_mean', 5), r(f'stddev_samp(CAST(embedding[{k + 1}] AS DOUBLE))', f'e{k}_std', 5)))}
        FROM embeddings GROUP BY GROUPING SETS ((label), ())""",
    "effect_size": f"""WITH {_V}, w AS (SELECT var, avg(val) AS m, stddev_samp(val) AS s FROM v GROUP BY 1), c AS (SELECT var, cluster, avg(val) AS cm, stddev_samp(val) AS cs FROM v GROUP BY 1, 2)
        SELECT var, cluster, {r('(cm - m) / nullif(s, 0)', 'effect', 4)}, {r('cs / nullif(s, 0)', 'relative_std', 4)} FROM c JOIN w USING (var)""",
    "anova_f": f"""WITH {_V}, g AS (SELECT var, cluster, count(*) AS n, avg(val) AS m, var_pop(val) AS s FROM v GROUP BY 1, 2), a AS (SELECT var, avg(val) AS mu FROM v GROUP BY 1)
        SELECT var, {r('(sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*)))', 'f', 4)} FROM g JOIN a USING (var) GROUP BY 1""",
    "correlations": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'r', 5)} FROM lineitem" for a, b in (
        ("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))),
    "silhouettes": f"""WITH d AS (SELECT x.vec_id AS i, x.label AS ci, y.label AS cj, sum(sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))))) AS d, count(*) AS n
            FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id GROUP BY 1, 2, 3),
        s AS (SELECT i, ci, max(d / n) FILTER (ci = cj) AS a, min(d / n) FILTER (ci <> cj) AS b FROM d GROUP BY 1, 2)
        SELECT CAST(i AS VARCHAR) AS profile_id, ci AS cluster, {r('CASE WHEN a IS NULL OR b IS NULL THEN 0e0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0e0), 0e0) END', 'silhouette', 5)} FROM s""",
    "cluster_inertia": f"WITH {_V} SELECT {r('sum(x)', 'inertia', 3)} FROM (SELECT var_pop(val) * count(*) AS x FROM v GROUP BY cluster, var)",
    "confusion": f"WITH {_LAB} SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2",
    "adjusted_rand": f"""WITH {_LAB}, c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY 1, 2),
        s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), x AS (SELECT sum(k * (k - 1) / 2) AS a FROM (SELECT sum(n) AS k FROM c GROUP BY a)), y AS (SELECT sum(k * (k - 1) / 2) AS b FROM (SELECT sum(n) AS k FROM c GROUP BY b))
        SELECT {r('coalesce((s - a * b / (n * (n - 1) / 2)) / nullif((a + b) / 2 - a * b / (n * (n - 1) / 2), 0e0), 1e0)', 'ari', 8)}, CAST(n AS BIGINT) AS n FROM s, x, y""",
    "co_membership": f"WITH {_RUNS} SELECT a, b, {r('share', 'share')} FROM co",
    "pair_bands": f"""WITH {_RUNS}, t AS (SELECT count(*) * (count(*) - 1) // 2 AS total FROM embeddings)
        SELECT count(*) FILTER (share > 0.8e0) AS stable, count(*) FILTER (share < 0.2e0) + any_value(total) - count(*) AS separate, count(*) FILTER (share BETWEEN 0.3e0 AND 0.7e0) AS ambiguous FROM co, t""",
    "ranked_scores": """WITH s AS (SELECT p_brand, p_size, count(*) AS score FROM part GROUP BY 1, 2)
        SELECT p_brand, p_size, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_size) AS INTEGER) AS rank,
               coalesce(score > lag(score) OVER w AND score > lead(score) OVER w, false) AS peak FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""",
    "best_match": f"""WITH {_LAB}, c AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2), cs AS (SELECT DISTINCT b FROM l),
        p AS (SELECT p0.b AS b0, p1.b AS b1, p2.b AS b2, p3.b AS b3 FROM cs p0, cs p1, cs p2, cs p3 WHERE len(list_distinct([p0.b, p1.b, p2.b, p3.b])) = 4),
        s AS (SELECT (SELECT sum(n) FROM c WHERE (a, b) IN ((0, b0), (1, b1), (2, b2), (3, b3))) AS hit FROM p)
        SELECT {r('max(hit) / CAST((SELECT count(*) FROM l) AS DOUBLE)', 'accuracy')}, CAST(4 AS INTEGER) AS pairs FROM s""",
    "anova_p": f"""WITH {_V}, g AS (SELECT var, cluster, count(*) AS n, avg(val) AS m, var_pop(val) AS s FROM v GROUP BY 1, 2), a AS (SELECT var, avg(val) AS mu FROM v GROUP BY 1),
        f AS (SELECT var, (sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f, (count(*) - 1) / 2e0 AS k, (sum(n) - count(*)) / 2e0 AS w FROM g JOIN a USING (var) GROUP BY 1),
        x AS (SELECT var, f, k, w, w / (w + k * f) AS x, lgamma(w + k) - lgamma(w) - lgamma(k) AS front FROM f),
        y AS (SELECT var, i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS c, x * i / 4000e0 AS t FROM x, range(4001) q(i))
        SELECT var, {r('any_value(f)', 'f', 4)}, {r('sum(CASE WHEN t > 0 AND t < 1 THEN c * exp(front + (w - 1) * ln(t) + (k - 1) * ln(1 - t)) ELSE 0 END) * any_value(x) / 12000e0', 'p', 5)} FROM x JOIN y USING (var) GROUP BY 1""",
    "most_common": "SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_quantity LIMIT 10",
}
SQL["silhouettes_cells"] = SQL["silhouettes"]
