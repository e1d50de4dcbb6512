"""Hidden Markov language model.

Words fall into hashed classes, a bounded alphabet; latent states emit classes
and a class emits its words by their corpus counts.  Baum-Welch counts are
summed over partitions, and a scaled forward recursion gives the exact
likelihood of a text of any length: texts are cut into segments whose transfer
matrices are multiplied, so that numpy steps run over many segments at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import materialise, text_or_empty
from sondeframe.llm.wordscan import Words, mix, scan

STATES = 6
CLASS_BITS = 14
CLASSES = 1 << CLASS_BITS
END = CLASSES  # the class of the end token
SEGMENT = 128
#: Training stops once a round gains less log10 likelihood a token than this, or after so many rounds.
TOLERANCE = 0.001
MOST_ROUNDS = 20
#: Words whose counts are broadcast; those of rarer words come by a join.
HEAD_WORDS = 1 << 19
PRIOR_TOKENS = 50.0
RESCALE = 8


@dataclass
class Model:
    start: np.ndarray  # (K,)
    moves: np.ndarray  # (K, K), rows sum to 1
    emits: np.ndarray  # (CLASSES + 1, K), columns sum to 1


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def sequences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts' classes, each text closed by END, and their bounds."""
    docs = len(words.bounds) - 1
    bounds = words.bounds + np.arange(docs + 1)
    tokens = np.full(int(bounds[-1]), END, dtype=np.int64)
    tokens[np.arange(len(words.hashes)) + words.docs] = classes_of(words.hashes)
    return tokens, bounds


class Segments:
    """Texts in segments of at most SEGMENT tokens, longest first, with their transfers."""

    def __init__(self, model: Model, tokens: np.ndarray, bounds: np.ndarray):
        self.model, self.tokens = model, tokens
        sizes = np.diff(bounds)
        counts = -(-sizes // SEGMENT)  # one at least: END is a token
        doc = np.repeat(np.arange(len(sizes)), counts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = bounds[doc] + place * SEGMENT
        length = np.minimum(bounds[doc + 1], begin + SEGMENT) - begin
        order = np.argsort(-length, kind="stable")
        self.doc, self.place, self.begin, self.length = doc[order], place[order], begin[order], length[order]
        self.active = np.searchsorted(-self.length, -np.arange(int(self.length[0]) if len(length) else 0), side="left")
        self.docs, self.rounds = len(sizes), int(counts.max()) if len(counts) else 0
        self.by_place = [np.flatnonzero(self.place == j) for j in range(self.rounds)]
        self._transfers()
        self._chain()

    def _transfers(self) -> None:
        """For each segment the matrix from the state before it to the state at its end."""
        a, k = self.model.moves, len(self.model.start)
        n = len(self.doc)
        f = np.where((self.place == 0)[:, None, None], np.eye(k), a)
        logs = np.zeros(n)
        for t, m in enumerate(self.active):
            if t:
                f[:m] = (f[:m].reshape(-1, k) @ a).reshape(m, k, k)
            f[:m] *= self.model.emits[self.tokens[self.begin[:m] + t]][:, None, :]
            if t % RESCALE == RESCALE - 1 or t == len(self.active) - 1:
                top = f[:m].max(axis=(1, 2))
                f[:m] /= top[:, None, None]
                logs[:m] += np.log(top)
        self.transfer, self.logs = f, logs

    def _chain(self) -> None:
        """The scaled state before each segment, and each text's log likelihood."""
        k = len(self.model.start)
        self.before = np.zeros((len(self.doc), k))
        self.likelihood = np.zeros(self.docs)
        alpha = np.tile(self.model.start, (self.docs, 1))
        for own in self.by_place:
            d = self.doc[own]
            self.before[own] = alpha[d]
            now = np.einsum("nk,nkj->nj", alpha[d], self.transfer[own])
            total = now.sum(axis=1)
            alpha[d] = now / total[:, None]
            self.likelihood[d] += np.log(total) + self.logs[own]

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected (starts, moves, emissions) of Baum-Welch, over whole texts."""
        k = len(self.model.start)
        a = self.model.moves
        after = np.ones((len(self.doc), k))
        beta = np.ones((self.docs, k))
        for own in reversed(self.by_place):
            d = self.doc[own]
            after[own] = beta[d]
            back = np.einsum("nkj,nj->nk", self.transfer[own], beta[d])
            beta[d] = back / back.sum(axis=1, keepdims=True)
        n, steps = len(self.doc), len(self.active)
        alphas = np.zeros((steps + 1, n, k))
        alphas[0] = self.before
        for t, m in enumerate(self.active):
            now = alphas[t, :m] @ a
            if t == 0:
                now = np.where((self.place == 0)[:m, None], self.before[:m], now)
            now *= self.model.emits[self.tokens[self.begin[:m] + t]]
            alphas[t + 1, :m] = now / now.sum(axis=1, keepdims=True)
        starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES + 1, k))
        first = self.place == 0
        posterior = np.zeros((len(self.tokens), k))
        b = after
        for t in range(steps - 1, -1, -1):
            m = self.active[t]
            at = self.begin[:m] + t
            token = self.tokens[at]
            gamma = alphas[t + 1, :m] * b[:m]
            gamma /= gamma.sum(axis=1, keepdims=True)
            posterior[at] = gamma
            seen = self.model.emits[token] * b[:m]
            ahead = seen @ a.T
            previous = alphas[t, :m]
            share = 1.0 / np.maximum((previous * ahead).sum(axis=1, keepdims=True), 1e-300)
            if t == 0:
                starts += gamma[first[:m]].sum(axis=0)
                share = np.where(first[:m, None], 0.0, share)
            moves += ((previous * share).T @ seen) * a
            b[:m] = ahead / ahead.sum(axis=1, keepdims=True)
        for s in range(k):
            emissions[:, s] = np.bincount(self.tokens, weights=posterior[:, s], minlength=CLASSES + 1)
        return starts, moves, emissions


_SUMS = ", ".join(["row int", *[f"s{k} double" for k in range(STATES)]])
LIKELIHOOD = CLASSES + 1 + STATES + 1  # the row whose s0 is the log likelihood


def _sums_batch(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, likelihood: float = 0.0) -> pa.RecordBatch:
    """Rows 0 to CLASSES: emissions; then STATES rows of moves; then the starts and LIKELIHOOD."""
    table = np.concatenate([emissions, moves, starts[None], np.full((1, STATES), likelihood)])
    at = np.flatnonzero(table.sum(axis=1))
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int32()), *[pa.array(table[at, k]) for k in range(STATES)]], names=["row", *[f"s{k}" for k in range(STATES)]]
    )


def _first_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text wholly in the state that its most frequent class is hashed to."""
    starts, moves, emissions = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))
    for batch in batches:
        for _, words in scan(batch.column("text"), lower=True):
            tokens, bounds = sequences(words)
            docs = len(bounds) - 1
            owner = np.repeat(np.arange(docs), np.diff(bounds))
            pairs, n = np.unique(owner * (CLASSES + 1) + tokens, return_counts=True)
            order = np.lexsort((-n, pairs // (CLASSES + 1)))
            doc = pairs[order] // (CLASSES + 1)
            top = np.ones(len(order), dtype=bool)
            top[1:] = doc[1:] != doc[:-1]
            state = (mix(pairs[order][top] % (CLASSES + 1)) % np.uint64(STATES)).astype(np.int64)
            starts += np.bincount(state, minlength=STATES)
            emissions += np.bincount(tokens * STATES + state[owner], minlength=emissions.size).reshape(emissions.shape)
            moves += np.diag(np.bincount(state, weights=np.diff(bounds) - 1, minlength=STATES))
    yield _sums_batch(starts, moves, emissions)


def _expected(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))]
        likelihood = 0.0
        for batch in batches:
            for _, words in scan(batch.column("text"), lower=True):
                own = Segments(model.value, *sequences(words))
                likelihood += own.likelihood.sum()
                for into, x in zip(total, own.counts(), strict=True):
                    into += x
        yield _sums_batch(*total, likelihood)

    return run


def _model(rows, prior: np.ndarray) -> Model:
    table = np.zeros((LIKELIHOOD, STATES))
    for r in rows:
        if r[0] < LIKELIHOOD:
            table[r[0]] = r[1:]
    emissions, moves, starts = table[: CLASSES + 1], table[CLASSES + 1 : -1] + 0.5 + 5 * np.eye(STATES), table[-1] + 0.5
    emissions = emissions + PRIOR_TOKENS * prior[:, None]
    return Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words in scan(batch.column("text"), lower=True):
            word, n = np.unique(words.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])


_TAIL = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
_SCORED = "doc_id long, row_uid long, held_out boolean, n_tokens long, head_known long, head_logs double, rest double, tail array<struct<word: long, n: long>>"


def _score(shared):
    """head_logs: sum of log10(count + 1) of head words; rest: what the score has besides all words' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, counts, class_logs = shared.value
        logs = np.log10(counts + 1.0)
        for batch in batches:
            for first, words in scan(batch.column("text"), lower=True):
                docs = len(words.bounds) - 1
                owner, h = words.docs, words.hashes
                at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
                found = head[at] == h if len(head) else np.zeros(len(h), dtype=bool)
                known = np.bincount(owner[found], minlength=docs)
                head_logs = np.bincount(owner[found], weights=logs[at[found]] if len(head) else None, minlength=docs)
                tokens, bounds = sequences(words)
                likelihood = Segments(model, tokens, bounds).likelihood / math.log(10) if model else np.zeros(docs)
                rest = likelihood - np.bincount(owner, weights=class_logs[classes_of(h)], minlength=docs)
                d, w = owner[~found], h[~found]
                order = np.lexsort((w, d))
                d, w = d[order], w[order]
                new = np.ones(len(d), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(d)))
                d, w = d[new], w[new]
                tail = pa.ListArray.from_arrays(
                    np.searchsorted(d, np.arange(docs + 1)).astype(np.int32),
                    pa.StructArray.from_arrays([pa.array(w.view(np.int64)), pa.array(times, pa.int64())], fields=list(_TAIL.value_type)),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(first, docs) for c in ("doc_id", "row_uid", "held_out")]
                    + [pa.array(np.diff(bounds), pa.int64()), pa.array(known, pa.int64()), pa.array(head_logs.astype(float)), pa.array(rest), tail],
                    names=["doc_id", "row_uid", "held_out", "n_tokens", "head_known", "head_logs", "rest", "tail"],
                )

    return run


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE, head_words: int = HEAD_WORDS, with_score: bool = True) -> DataFrame:
    """One row per input row: its probability by a count model and by the HMM.

    Trained on the rows whose crc32 of the id as text, modulo 7, is not 2 (a
    null id counts as empty text and is trained on).  Tokens are the words,
    A-Z lower-cased, and one end for each text; null counts as empty.  Words
    are told apart by a 64-bit hash.  Without any training row all counts are 0
    and the model is its prior.  Baum-Welch goes on until a round gains less
    than ``tolerance`` of log10 likelihood a training token, or ``most_rounds``.

    Without ``with_score`` nothing is trained beyond the counts, and there is no score.

    Columns: the id, held_out, n_tokens, n_known, train_tokens (longs),
    base_score, score (doubles, log10).
    """
    context = docs.sparkSession.sparkContext
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), (crc % 7 == 2).alias("held_out"))
    training = source.filter(~F.col("held_out")).select("text")
    words = materialise(training.mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top_bits = F.shiftrightunsigned("word", 64 - CLASS_BITS).cast("int")
    by_class = words.groupBy(top_bits.alias("class")).agg(F.sum("n"), F.count("*")).collect()  # CLASSES rows at most
    n_class, v_class = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for c, n, v in by_class:
        n_class[c], v_class[c] = n, v
    n_docs = training.count()
    n_class[END] = n_docs
    train_tokens, distinct = int(n_class.sum()), int(v_class.sum()) + (n_docs > 0)

    prior = (n_class + 1) / (n_class + 1).sum()

    def summed(step) -> list:
        return training.mapInArrow(step, _SUMS).groupBy("row").agg(*[F.sum(f"s{k}") for k in range(STATES)]).collect()

    model = _model(summed(_first_counts), prior) if with_score else None
    before = -math.inf
    for _ in range(most_rounds if n_docs and with_score else 0):
        sums = summed(_expected(context.broadcast(model)))
        model = _model(sums, prior)
        reached = next((r[1] for r in sums if r[0] == LIKELIHOOD), 0.0) / math.log(10) / train_tokens
        if reached - before < tolerance:
            break
        before = reached

    # the commonest words up to a bound on their number
    sizes = sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().orderBy(F.col("n").desc()).limit(1 << 16).collect()), reverse=True)
    least, held = None, 0
    for n, count in sizes:
        if held + count > head_words:
            break
        least, held = n, held + count
    head = (words.filter(F.col("n") >= least) if least else words.limit(0)).toArrow()  # head_words rows at most, as columns
    hashes = head["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    counts = head["n"].to_numpy()[order]
    class_logs = np.log10(n_class + v_class + 1)
    shared = context.broadcast((model, hashes[order], counts, class_logs))
    numbered = source.withColumn("row_uid", F.monotonically_increasing_id())
    scored = materialise(numbered.mapInArrow(_score(shared), _SCORED))

    rare = scored.select("row_uid", F.explode("tail").alias("t")).select("row_uid", "t.word", F.col("t.n").alias("times"))
    counted = words.filter(F.col("n") < least) if least else words
    tails = (
        rare.join(counted, "word").groupBy("row_uid")
        .agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_logs"))
    )
    logs = F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0))
    end_log = math.log10(n_docs + 1)
    per_token = math.log10(train_tokens + distinct + 1)
    found = scored.join(tails, "row_uid", "left").select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (logs + end_log - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("rest") + logs).alias("score"),
    )
    return found if with_score else found.drop("score")
