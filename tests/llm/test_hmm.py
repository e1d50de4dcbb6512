from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sondeframe.llm import hmm as H
from sondeframe.llm.wordscan import scan
from tests.llm.conftest import prose


def lowered(text):
    """Words parted by ASCII white space, A-Z lower-cased."""
    return [w.lower().decode() for w in (text or "").encode().split()]


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    start, moves, emits = rng.random(H.STATES), rng.random((H.STATES, H.STATES)), rng.random((H.CLASSES + 1, H.STATES))
    return H.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def forward(model, tokens):
    """Scaled steps over one text: (log likelihood, forward, backward)."""
    alpha, scale = [model.start * model.emits[tokens[0]]], []
    for t, token in enumerate(tokens):
        if t:
            alpha.append((alpha[-1] @ model.moves) * model.emits[token])
        scale.append(alpha[-1].sum())
        alpha[-1] = alpha[-1] / scale[-1]
    beta = [np.ones(H.STATES)]
    for t in range(len(tokens) - 1, 0, -1):
        beta.append(model.moves @ (model.emits[tokens[t]] * beta[-1]) / scale[t])
    return float(np.log(scale).sum()), np.array(alpha), np.array(beta[::-1]), scale


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_segments_against_the_plain_recursion(monkeypatch, segment):
    monkeypatch.setattr(H, "SEGMENT", segment)
    model, rng = random_model(), np.random.default_rng(1)
    sizes = [1, 2, 3, 7, 20, 40]
    bounds = np.cumsum([0, *sizes])
    tokens = rng.integers(0, 50, bounds[-1])
    own = H.Segments(model, tokens, bounds)
    starts, moves, emissions = np.zeros(H.STATES), np.zeros((H.STATES, H.STATES)), np.zeros((H.CLASSES + 1, H.STATES))
    for d in range(len(sizes)):
        text = tokens[bounds[d] : bounds[d + 1]]
        log, alpha, beta, scale = forward(model, text)
        assert own.likelihood[d] == pytest.approx(log)
        gamma = alpha * beta
        starts += gamma[0]
        np.add.at(emissions, text, gamma)
        for t in range(1, len(text)):
            moves += alpha[t - 1][:, None] * model.moves * (model.emits[text[t]] * beta[t])[None] / scale[t]
    for mine, want in zip(own.counts(), (starts, moves, emissions), strict=True):
        np.testing.assert_allclose(mine, want, atol=1e-9)


@pytest.mark.parametrize("head", [1 << 21, 20, 0])
def test_scores_against_brute_force(docs_of, rng, monkeypatch, head):
    models = []
    build = H._model
    monkeypatch.setattr(H, "_model", lambda rows, prior: models.append(build(rows, prior)) or models[-1])
    rows = [(k, prose(rng, rng.randrange(0, 120))) for k in range(60)] + [(100, None), (101, ""), (102, "W1 w1 x Ä\tä"), (None, "w1 w2"), (103, prose(rng, 3000)), (5, "w3 w4")]
    found = H.hmm_scores(docs_of(rows).repartition(3), head_words=head).collect()
    assert len(found) == len(rows)

    def held(i):
        return zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2

    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update([*lowered(text), "<end>"])
    n, v = sum(counts.values()), len(counts)
    n_class, v_class = np.zeros(H.CLASSES + 1), np.zeros(H.CLASSES + 1)
    names = [w for w in counts if w != "<end>"]
    hashed = next(scan(pa.array([" ".join(names)]), lower=True))[1].hashes
    for w, c in zip(names, H.classes_of(hashed), strict=True):
        n_class[c] += counts[w]
        v_class[c] += 1
    want = {}
    for i, text in rows:
        words = lowered(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words, "<end>"])
        _, scanned = next(scan(pa.array([text or ""]), lower=True))
        own = H.classes_of(scanned.hashes)
        log = forward(models[-1], np.append(own, H.END))[0] / math.log(10)
        score = log + sum(math.log10((counts[w] + 1) / (n_class[c] + v_class[c] + 1)) for w, c in zip(words, own, strict=True))
        want.setdefault(i, []).append((held(i), len(words) + 1, sum(counts[w] > 0 for w in [*words, "<end>"]), n, base, score))
    for i, own in want.items():
        got = sorted(tuple(r)[1:] for r in found if r["doc_id"] == i)
        for a, b in zip(got, sorted(own), strict=True):
            assert a == pytest.approx(b, rel=1e-9)


def test_training_helps_on_held_out_text(docs_of, rng):
    """Two vocabularies never mixed in a text: states beat the count model there."""
    rows = [(k, " ".join(f"{'ab'[k % 2]}{rng.randrange(80)}" for _ in range(60))) for k in range(300)]
    sums = H.hmm_scores(docs_of(rows)).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert sums[0] > sums[1]


def test_empty_table(docs_of):
    assert H.hmm_scores(docs_of([]).limit(0)).count() == 0


def test_training_stops_where_a_round_gains_little(docs_of, rng, monkeypatch):
    """Rounds go on until the tolerance, and each gains likelihood on the training rows."""
    rows = [(k, " ".join(f"{'abc'[k % 3]}{rng.randrange(60)}" for _ in range(40))) for k in range(200)]
    docs, calls, expected = docs_of(rows).cache(), [], H._expected
    monkeypatch.setattr(H, "_expected", lambda model: calls.append(1) or expected(model))

    def trained(**options):
        calls.clear()
        total = H.hmm_scores(docs, **options).filter("not held_out").selectExpr("sum(score)").first()[0]
        return total, len(calls)

    by_rounds = [trained(most_rounds=k, tolerance=0.0)[0] for k in range(4)]
    assert by_rounds[0] < by_rounds[1] <= by_rounds[2] + 1e-3 and by_rounds[2] <= by_rounds[3] + 1e-3
    assert trained(most_rounds=3, tolerance=0.0)[1] == 3
    wide, fine = trained(tolerance=10.0), trained(tolerance=1e-4)
    assert wide[1] == 2 and 2 < fine[1] <= H.MOST_ROUNDS and fine[0] >= wide[0] - 1e-3


def test_base_columns_need_no_training(spark, monkeypatch):
    from sondeframe.llm import hmm

    docs = spark.createDataFrame([(k, " ".join(f"w{k % 5} x{j % 7}".split() * (k % 3))) for k in range(40) for j in [k * 3]], "doc_id long, text string")
    want = sorted(hmm.hmm_scores(docs).drop("score").collect())
    monkeypatch.setattr(hmm, "_expected", None)
    monkeypatch.setattr(hmm, "_model", None)
    assert sorted(hmm.hmm_scores(docs, with_score=False).collect()) == want
