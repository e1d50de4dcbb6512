"""Quality classifier by importance resampling.

Three pairs of hashed n-gram models are counted: of target text (labelled good,
not toxic) and of the raw text of all documents, over byte 4-grams, word
bigrams and the first bytes of words.  A document's log weight is the sum over
all its n-grams of log(p_target / p_raw), smoothed and shrunk, for a kind as a
share of the square root of its length and of its spread in held-out target
text.  A Gumbel top-k draws k documents by weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import fresh, hash_sample, kth_largest, materialise, text_or_empty
from sondeframe.llm.wordscan import SPACE, Words, mix, scan

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
BYTE_N, WORD_N = 4, 2
#: A word's first bytes, which tell stems in any of their endings.
PREFIX_BYTES = 6
KINDS = 3
MAX_LABELLED = 200_000
#: Counts are smoothed by ADD, log ratios are shrunk towards 0 by SHRINK (as by a Laplace prior), so that chance differences of rare n-grams don't add up.
ADD, SHRINK = 3.0, 0.5
#: The keys are log weight / temperature + Gumbel noise.
TEMPERATURE = 0.25
#: What a lost good document costs against a kept bad one, as shares of their kinds.
LOSS = 4.0
FIT, GOOD, BAD = 1, 2, 3
#: Share of the held-out target text, by length, in documents of at most the penalty a gram that is allowed to all texts.
ALLOWED = 0.9
#: What is kept of a document to form the ratios once the scale is known.
SUMS = ("n_bytes", "byte_sum", "word_sum", "prefix_sum")
#: Units added to a length, so that a few n-grams decide nothing.
PADS = (100.0, 20.0, 20.0)
RATIOS = ("byte_ratio", "word_ratio", "prefix_ratio")

_fold = np.arange(256, dtype=np.uint8)
_fold[0x41:0x5B] += 0x20
_fold[SPACE] = 0x20


def _features(words: Words, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document numbers, buckets) of the byte n-grams, the word bigrams and the words' first bytes."""
    data = _fold[words.data].astype(np.uint64)
    n = max(0, len(data) - BYTE_N + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(BYTE_N):
        h = h * np.uint64(0x100000001B3) + data[j : n + j] + np.uint64(1)
    h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    sizes = np.diff(offsets)
    docs = np.repeat(np.arange(len(sizes), dtype=np.int32), np.maximum(sizes - BYTE_N + 1, 0))
    inside = np.repeat(offsets[:-1], np.maximum(sizes - BYTE_N + 1, 0)) + _ranks(np.maximum(sizes - BYTE_N + 1, 0))
    yield docs, h[inside]
    at, grams = words.grams(WORD_N)
    yield words.docs[at], (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    h = np.zeros(len(words.starts), dtype=np.uint64)
    for j in range(PREFIX_BYTES):
        at = words.starts + j
        inside = at < words.ends
        h[inside] = h[inside] * np.uint64(0x100000001B3) + data[at[inside]] + np.uint64(1)
    yield words.docs, (mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray]]:
    lengths = np.array(pa.compute.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)
    for first, words in scan(batch.column("text"), lower=True):
        own = lengths[first : first + len(words.bounds) - 1]
        yield first, words, np.concatenate([[0], np.cumsum(own)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((KINDS, 2, BUCKETS), dtype=np.int64)  # raw or target
    for batch in batches:
        fit = batch.column("role").to_numpy(zero_copy_only=False) == FIT
        for first, words, offsets in _runs(batch):
            own = fit[first : first + len(offsets) - 1]
            for kind, (docs, buckets) in enumerate(_features(words, offsets)):
                counts[kind, 0] += np.bincount(buckets, minlength=BUCKETS)
                counts[kind, 1] += np.bincount(buckets[own[docs]], minlength=BUCKETS)
    for kind in range(KINDS):
        at = np.flatnonzero(counts[kind, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at + kind * BUCKETS, pa.int32()), pa.array(counts[kind, 0, at]), pa.array(counts[kind, 1, at])],
            names=["bucket", "raw", "target"],
        )


def _score(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = ratios.value
        for batch in batches:
            for first, words, offsets in _runs(batch):
                docs = len(offsets) - 1
                sums = []
                for kind, (owner, buckets) in enumerate(_features(words, offsets)):
                    sums.append(np.bincount(owner, weights=tables[kind][buckets], minlength=docs).astype(np.float64))  # without grams it counts integers
                n_words = np.diff(words.bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, docs), batch.column("role").slice(first, docs),
                     pa.array(n_words, pa.int64()),
                     pa.array(np.diff(offsets).astype(np.float64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2])],
                    names=["doc_id", "role", "n_words", *SUMS],
                )

    return run


@dataclass
class Scale:
    """Of held-out target documents, for each kind: penalty allowed a unit of length, centre and spread; the cut between good and bad."""

    allowed: tuple[float, ...] = (0.0,) * KINDS
    centres: tuple[float, ...] = (0.0,) * KINDS
    spreads: tuple[float, ...] = (1.0,) * KINDS
    cut: float | None = None


def shrunk(ratio: np.ndarray) -> np.ndarray:
    return np.sign(ratio) * np.maximum(np.abs(ratio) - SHRINK, 0)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, smoothed and shrunk."""
    wanted = raw * (target.sum() / max(1.0, raw.sum()))
    return shrunk(np.log((target + ADD) / (wanted + ADD)))


def _allowed(sums: np.ndarray, lengths: np.ndarray) -> float:
    """The penalty a unit of length that ALLOWED of the text, by length, stays within."""
    rates = -sums / np.maximum(lengths, 1.0)
    order = np.argsort(rates)
    total = np.cumsum(lengths[order])
    return float(rates[order][np.searchsorted(total, ALLOWED * total[-1])]) if total[-1] > 0 else 0.0


def _ratios(n_words: np.ndarray, sums: np.ndarray, allowed: tuple[float, ...]) -> np.ndarray:
    lengths = (sums[:, 0], n_words, n_words)
    return np.stack([np.minimum(sums[:, k + 1] + allowed[k] * lengths[k], 0) / np.sqrt(lengths[k] + PADS[k]) for k in range(KINDS)], axis=1)


def _calibrate(n_words: np.ndarray, sums: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Scale:
    """From held-out rows of SUMS; ``good`` and ``bad`` say which are."""
    if not good.any():
        return Scale()
    words = n_words.astype(np.float64)
    allowed = tuple(_allowed(sums[good, k + 1], (sums[:, 0], words, words)[k][good]) for k in range(KINDS))
    x = _ratios(words, sums, allowed)
    centres, spreads = np.median(x[good], axis=0), np.maximum(x[good].std(axis=0), 1e-6)
    scale = Scale(allowed, tuple(map(float, centres)), tuple(map(float, spreads)))
    if bad.any():
        weight = ((x - centres) / spreads).sum(axis=1)
        g, b = np.sort(weight[good]), np.sort(weight[bad])
        at = np.sort(np.concatenate([g, b]))
        cost = LOSS * np.searchsorted(g, at) / len(g) + 1 - np.searchsorted(b, at) / len(b)
        best = int(np.argmin(cost))
        scale.cut = float(at[best] + at[max(0, best - 1)]) / 2  # midway between the two sides
    return scale


def gumbel_key(weight: Column, temperature: float = TEMPERATURE, seed: int = 0, id_col: str = "doc_id") -> Column:
    """log weight / temperature + Gumbel noise by a hash of the id.

    The rows of the k largest keys are a sample without replacement in which
    each next row is drawn with chances as weight^(1 / temperature).
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(f"gumbel {seed}")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return weight / temperature - F.log(-F.log(uniform))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_labelled: int = MAX_LABELLED, k: int | None = None, temperature: float = TEMPERATURE, seed: int = 0) -> DataFrame:
    """One row per document: its log weight and whether the resampling draws it.

    ``k`` documents are drawn; without it, as many as weigh more than the cut
    that parts held-out good and bad documents best.

    ``labels`` has the id, quality (1 good) and toxic (1 toxic).  A label row
    with a null is not used; of repeated ids the worst counts.  At most
    ``max_labelled`` labels, chosen by a hash of the id, are used: three
    quarters of the target documents fit the target model, the others and the
    bad ones set the scale and the cut.  Penalties count beyond the rate that
    clean text has anyway (``ALLOWED``), at any length.  Without target or bad labels every
    document is drawn, unless k is given.  Raw counts are of all whole texts; null counts as
    empty.  Documents of the same id share the noise and so a key; all that
    reach the k-th key are drawn.

    Columns: the id, n_words, byte_ratio, word_ratio, prefix_ratio, weight,
    gumbel_key (doubles), kept (boolean).
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").na.drop()
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    known = hash_sample(known, "doc_id", n, max_labelled)
    target = (F.col("quality") == 1) & (F.col("toxic") == 0)
    fitted = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) > 0
    roles = known.select("doc_id", F.when(target & fitted, FIT).when(target, GOOD).otherwise(BAD).alias("role"))
    source = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        .join(F.broadcast(roles), "doc_id", "left")  # max_labelled rows at most
        .withColumn("role", F.coalesce("role", F.lit(0)))
    )
    counted = (
        source.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()  # KINDS * BUCKETS rows at most
    )
    bucket, n_raw, n_target = (counted[c].to_numpy() for c in ("bucket", "raw", "target"))
    tables = []
    for kind in range(KINDS):
        raw, fit = np.zeros(BUCKETS), np.zeros(BUCKETS)
        own = bucket // BUCKETS == kind
        raw[bucket[own] - kind * BUCKETS], fit[bucket[own] - kind * BUCKETS] = n_raw[own], n_target[own]
        tables.append(log_ratios(fit, raw).astype(np.float32))
    ratios = context.broadcast(tables)
    schema = "doc_id long, role int, n_words long, " + ", ".join(f"{c} double" for c in SUMS)
    scored = materialise(source.mapInArrow(_score(ratios), schema))

    held = scored.filter(F.col("role").isin(GOOD, BAD)).select("role", "n_words", *SUMS).toArrow()  # max_labelled rows at most
    role, words_of, sums_of = held["role"].to_numpy(), held["n_words"].to_numpy(), np.stack([held[c].to_numpy() for c in SUMS], axis=1)
    scale = _calibrate(words_of, sums_of, role == GOOD, role == BAD)
    lengths = [F.col("n_bytes"), F.col("n_words"), F.col("n_words")]
    weighed = scored.withColumns({
        # without the allowance the ratios of clean text would fall like the root of its length
        name: F.least(F.col(total) + scale.allowed[kind] * lengths[kind], F.lit(0.0)) / F.sqrt(lengths[kind] + PADS[kind])
        for kind, (name, total) in enumerate(zip(RATIOS, SUMS[1:], strict=True))
    })
    terms = [(F.col(name) - scale.centres[kind]) / scale.spreads[kind] for kind, name in enumerate(RATIOS)]
    weighed = weighed.withColumn("weight", sum(terms[1:], terms[0])).withColumn("gumbel_key", gumbel_key(F.col("weight"), temperature, seed))
    if k is None and scale.cut is None:
        drawn = weighed.withColumn("kept", F.lit(True))
    else:
        k = weighed.filter(F.col("weight") >= scale.cut).count() if k is None else k
        least = kth_largest(weighed, "gumbel_key", k)
        every = k > 0  # fewer rows than k
        drawn = weighed.withColumn("kept", F.lit(every) if least is None else F.col("gumbel_key") >= least)
    return drawn.select(F.col("doc_id").alias(id_col), "n_words", *RATIOS, "weight", "gumbel_key", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows that the resampling draws.

    Of documents that share an id, all stay if one is drawn.  Null and empty
    texts have the weight of a text without n-grams, a null id is an id like
    others; an empty table stays empty.
    """
    kept_id = fresh(docs, "kept_id")
    kept = quality_scores(docs, labels, id_col, text_col).filter("kept").select(F.col(id_col).alias(kept_id))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
