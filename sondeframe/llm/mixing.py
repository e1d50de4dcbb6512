"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled rows gives every document posteriors over the
domains.  Nonnegative document rates are then fitted, by projected gradient on
the executors, so that the expected token totals of the domains match their
targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import fresh, hash_sample, materialise, text_or_empty
from sondeframe.llm.wordscan import scan

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
MAX_LABELLED = 20_000
STEPS = 60
TOLERANCE = 1e-6
#: A rate so close below a whole number counts as that number.
SLACK = 1e-4
#: Words whose evidence counts whole; that of longer texts is scaled down to it.
EVIDENCE_WORDS = 20
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
#: Of the query: half of the tokens, of a mixture without one of the domains, so that rates sink and reach 0.
QUERY_TARGETS, QUERY_SHARE = {"en": 0.5, "de": 0.3, "fr": 0.2, "es": 0.0}, 0.5


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(n_domains: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_domains, BUCKETS), dtype=np.int64)
        for batch in batches:
            domain = batch.column("domain").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, words in scan(batch.column("text"), lower=True):
                at = domain[first : first + len(words.bounds) - 1][words.docs] * BUCKETS + _buckets(words.hashes)
                counts += np.bincount(at, minlength=n_domains * BUCKETS).reshape(counts.shape)
        d, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[d, b])], names=["domain", "bucket", "n"]
        )

    return run


def _posteriors(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = model.value
        for batch in batches:
            for first, words in scan(batch.column("text"), lower=True):
                docs = len(words.bounds) - 1
                n = np.diff(words.bounds)
                buckets, owner = _buckets(words.hashes), words.docs
                sums = np.stack([np.bincount(owner, weights=row[buckets], minlength=docs) for row in logs], axis=1)
                scaled = prior + sums * np.minimum(1.0, EVIDENCE_WORDS / np.maximum(n, 1))[:, None]
                scaled -= scaled.max(axis=1, keepdims=True)
                p = np.exp(scaled)
                p /= p.sum(axis=1, keepdims=True)
                lists = pa.ListArray.from_arrays(np.arange(docs + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, docs), batch.column("key").slice(first, docs), pa.array(n, pa.int64()), lists],
                    names=["doc_id", "key", "n_tokens", "posterior"],
                )

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = MAX_LABELLED) -> DataFrame:
    """The documents whose id is in ``labels``, for at most about ``most`` of its ids.

    Only of these the domain counts as known; all others are scored unseen.
    """
    ids = labels.select(id_col).na.drop().distinct()
    chosen = hash_sample(ids, id_col, ids.count(), most, "labelled")
    return docs.join(F.broadcast(chosen), id_col, "left_semi")


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], domain_col: str,
                      id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, key, n_tokens, posterior) for every document.

    A naive Bayes classifier over hashed words is fitted on at most
    ``max_labelled`` rows of ``labelled`` (about that many, chosen by a hash of
    the id) with one of the domains; others are not used.  A document without
    words gets the prior.
    """
    context = docs.sparkSession.sparkContext
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col(domain_col)) - 1
    sample = labelled.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), number.cast("int").alias("domain")).filter("domain >= 0")
    sample = hash_sample(sample, "doc_id", sample.count(), max_labelled)
    rows = (
        sample.select("domain", "text").mapInArrow(_count(len(domains)), "domain int, bucket int, n long")
        .groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()  # domains * BUCKETS rows at most
    )
    counts = np.zeros((len(domains), BUCKETS))
    counts[rows["domain"], rows["bucket"]] = rows["n"]
    logs = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS))
    mass = counts.sum(axis=1) + 1
    model = context.broadcast((logs, np.log(mass / mass.sum())))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    return source.mapInArrow(_posteriors(model), "doc_id long, key long, n_tokens long, posterior array<double>")


def _rate(history: list[list[float]]) -> Column:
    """A document's rate after the gradient steps so far.

    Every step moves a rate by its posterior's product with the domains'
    relative excess and cuts it off at 0; replaying the steps needs only the
    posterior, so that no iteration writes or joins a table of rates.
    """
    if not history:
        return F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in history])

    def move(rate: Column, step: Column) -> Column:
        dot = F.aggregate(F.zip_with("posterior", step, lambda p, e: p * e), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(rate - dot, F.lit(0.0))

    return F.aggregate(steps, F.lit(1.0), move)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "lang",
                 id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, budget_share: float | None = None, steps: int = STEPS) -> DataFrame:
    """One row per document: posteriors over the domains, rate and copies.

    With n the tokens of a document, p its posteriors and r its rate, the rates
    minimise the sum over domains of (sum of r n p - target)^2 / (sum of n p),
    r >= 0, from r = 1.  The step is 1, which is safe because in these units
    the largest eigenvalue of the Gram matrix is 1 (posteriors sum to 1).
    Targets are the weights times ``budget`` tokens, or ``budget_share`` of all
    the tokens.  Without either it is the least at which no domain must shrink,
    so that no document is thinned out.  A target of 0 takes a domain's
    documents to rate 0; a domain with no mass is left out.  ``copies`` is the rate rounded down, and
    up with the fraction as chance, by a hash of the id.  Null or empty texts
    have 0 tokens: rate 1 moved like any other.

    Columns: the id, n_tokens, p_<domain> for each, rate (double), copies
    (long), key (hash of the text).
    """
    targets = targets or TARGETS
    domains = list(targets)
    weights = np.array([targets[d] for d in domains], dtype=float)
    weights /= weights.sum()
    scored = domain_posteriors(docs, labelled, domains, domain_col, id_col, text_col)
    table = materialise(scored)
    few = max(1, min(table.rdd.getNumPartitions(), 1 + table.count() // 200_000))
    packed = table.coalesce(max(few, 6)).persist()  # small rows, read once a step

    def totals(rate: Column) -> np.ndarray:
        sums = [F.sum(F.col("rate") * F.col("n_tokens") * F.col("posterior")[k]) for k in range(len(domains))]
        return np.array([float(x or 0.0) for x in packed.withColumn("rate", rate).agg(*sums).first()])

    base = totals(F.lit(1.0))
    live = base > 0
    history: list[list[float]] = []
    if live.any():
        share = np.where(live, weights, 0.0)
        share /= share.sum() or 1.0
        tokens = budget or budget_share and budget_share * float(base.sum()) or float((base[share > 0] / share[share > 0]).max())
        wanted = share * tokens
        now = base
        for _ in range(steps):
            excess = np.where(live, (now - wanted) / np.maximum(base, 1e-9), 0.0)
            if np.abs(excess).max() < TOLERANCE:
                break
            history.append(excess.tolist())
            before, now = now, totals(_rate(history))
            if np.abs(np.where(live, (now - before) / np.maximum(base, 1e-9), 0.0)).max() < TOLERANCE:
                break  # the bound at 0 holds what excess is left
    packed.unpersist()
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("copies")), 11) / F.lit(float(1 << 53))
    rated = table.withColumn("rate", _rate(history)).withColumn(
        "copies", F.floor(F.col("rate") + SLACK) + (chance < F.col("rate") - F.floor(F.col("rate") + SLACK)).cast("long")
    )
    return rated.select(
        F.col("doc_id").alias(id_col), "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(domains)], "rate", "copies", "key"
    )


def mix(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """The input's rows with columns rate and copies; rows of no copies go.

    A consumer reads a row ``copies`` times.  Column names that the input has
    already get an underscore.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    m_id, m_key, key, rate, copies = (fresh(docs, x) for x in ("m_id", "m_key", "t_key", "rate", "copies"))
    rates = (
        mixing_rates(docs, labelled, **options).filter("copies > 0")
        .groupBy(F.col(id_col).alias(m_id), F.col("key").alias(m_key)).agg(F.first("rate").alias(rate), F.first("copies").alias(copies))
    )
    found = docs.withColumn(key, F.xxhash64(text_or_empty(text_col))).join(
        rates, F.col(id_col).cast("long").eqNullSafe(F.col(m_id)) & (F.col(key) == F.col(m_key))
    )
    return found.drop(m_id, m_key, key)
