from __future__ import annotations

import numpy as np
import pytest

from sondeframe.llm import mixing as M

TARGETS = {"en": 0.5, "de": 0.3, "fr": 0.2}


@pytest.fixture
def three(spark, rng):
    """Documents of three languages with words of their own and some in common."""
    rows = []
    for k in range(300):
        lang = ("en", "en", "en", "de", "fr")[k % 5]
        words = [rng.choice([f"{lang}{rng.randrange(60)}", f"all{rng.randrange(20)}"]) for _ in range(rng.randrange(1, 200))]
        rows.append((k, " ".join(words), lang, "x", 2))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string, copies int")


def test_token_totals_match_the_targets(three):
    rows = M.mixing_rates(three, three, TARGETS).collect()
    p = np.array([[r[f"p_{d}"] for d in TARGETS] for r in rows])
    n, rate = (np.array([r[c] for r in rows], dtype=float) for c in ("n_tokens", "rate"))
    totals = (rate * n) @ p
    assert totals / totals.sum() == pytest.approx(list(TARGETS.values()), abs=1e-3)
    assert (rate >= 0).all() and p.sum(axis=1) == pytest.approx(1)
    copies = np.array([r["copies"] for r in rows])
    assert (np.abs(copies - rate) < 1 + M.SLACK).all()
    assert (copies * n) @ p / (copies * n).sum() == pytest.approx(list(TARGETS.values()), abs=0.05)


def test_classifier_on_documents_it_has_not_seen(three):
    seen, unseen = three.filter("doc_id < 150"), three.filter("doc_id >= 150")
    rows = M.mixing_rates(unseen, seen, TARGETS).join(unseen.select("doc_id", "lang"), "doc_id").filter("n_tokens > 10").collect()
    assert np.mean([r[f"p_{r['lang']}"] > 0.5 for r in rows]) > 0.95


def test_gradient_descent_finds_the_least_squares_solution(three):
    rows = M.mixing_rates(three, three, TARGETS, budget=5_000.0, steps=400).collect()  # less than there is: rates sink to 0
    p = np.array([[r[f"p_{d}"] for d in TARGETS] for r in rows])
    n, rate = (np.array([r[c] for r in rows], dtype=float) for c in ("n_tokens", "rate"))
    base = n @ p
    excess = ((rate * n) @ p - 5_000 * np.array(list(TARGETS.values()))) / base
    slope = p @ excess  # of half the objective by a rate, over n
    assert np.abs(slope[rate > 1e-9]).max() < 1e-3 and slope[rate <= 1e-9].min(initial=0) > -1e-3


def test_stage_and_edge_cases(spark, three):
    odd = three.unionByName(spark.createDataFrame([(900, None, "en", "x", 2), (901, "", "de", "x", 2), (None, "en1 en2", None, "x", 2), (3, "de1 de2", "de", "x", 2)], three.schema))
    out = M.mix(odd, odd, targets=TARGETS)
    assert out.columns == [*three.columns, "rate_", "copies_"]
    assert out.count() == M.mixing_rates(odd, odd, TARGETS).filter("copies > 0").count()
    assert M.mix(odd.limit(0), odd.limit(0), targets=TARGETS).count() == 0
    empty = odd.filter("doc_id in (900, 901)")
    assert {r["rate"] for r in M.mixing_rates(empty, empty, TARGETS).collect()} == {1.0}
    assert M.mix(three, three.limit(0), targets=TARGETS).count() > 0  # without labels all posteriors are the prior


def test_domains_sink_to_zero_under_a_budget(spark, three):
    """The classifier knows a few rows' languages; a domain without weight goes, others are thinned out."""
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 3)] + [(None, 1), (3, 1)], "doc_id long, quality int")
    known = M.labelled_rows(three, labels)
    assert known.count() == 100 and known.columns == three.columns
    targets = {"en": 0.75, "de": 0.25, "fr": 0.0}
    rows = M.mixing_rates(three, known, targets, budget_share=0.5).join(three.select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r["doc_id"] % 3 and r["n_tokens"] > 10]
    assert np.mean([r[f"p_{r['lang']}"] > 0.5 for r in unseen]) > 0.95
    sunk = [r["rate"] for r in rows if r["lang"] == "fr" and r["n_tokens"] > 10]
    assert np.mean(np.array(sunk) == 0) > 0.9
    n = sum(r["n_tokens"] for r in rows)
    for d, w in targets.items():
        total = sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in rows)
        assert total / n == pytest.approx(0.5 * w, abs=0.01)
    dropped = M.mix(three, known, targets=targets, budget_share=0.5)
    assert dropped.count() == sum(r["copies"] > 0 for r in rows) < 250
    assert M.labelled_rows(three, labels, most=10).count() < 40
