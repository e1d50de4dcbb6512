from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from sondeframe.llm import substring_dedup as S
from tests.llm.conftest import prose


def brute(rows, window=50):
    words = [(i, (t or "").split()) for i, t in rows]
    starts = defaultdict(set)
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                starts[tuple(w[k : k + window])].add(i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if min(starts[tuple(w[k : k + window])]) < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.remove_repeats(df).collect()), key=str)


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_against_brute_force(docs_of, rng, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(S, "SHARD_CONTEXTS", 5)
    shared = [prose(rng, n) for n in (49, 50, 51, 80, 140)]
    rows = []
    for k in range(50):
        part = shared[k % 5].split()
        cut = part[rng.randrange(3) : len(part) - rng.randrange(3)]
        rows.append((k, prose(rng, rng.randrange(60)) + " " + " ".join(cut) + "\n" + prose(rng, rng.randrange(60))))
    rows += [(60, rows[4][1]), (61, rows[4][1]), (62, None), (63, ""), (64, "same " * 200), (65, "same " * 130), (66, "a b " * 100), (None, rows[4][1])]
    assert found(docs_of(rows).repartition(6)) == brute(rows)


def test_one_very_common_passage(docs_of, rng):
    passage = prose(rng, 60)
    rows = [(k, f"{prose(rng, 5)} {passage} {prose(rng, 5)}") for k in range(200)]
    assert found(docs_of(rows)) == brute(rows)
    assert found(docs_of([]).limit(0)) == []


def test_kept_text(docs_of, rng):
    passage = prose(rng, 55)
    rows = {r["doc_id"]: r["kept_text"] for r in S.remove_repeats(docs_of([(1, passage), (2, f"before {passage} after")])).collect()}
    assert rows == {1: passage, 2: "before after"}


def test_automaton_spans():
    rng = random.Random(3)
    for _ in range(60):
        known = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        text = [rng.randrange(3) for _ in range(40)]
        own = S.SuffixAutomaton()
        for sequence in known:
            own.add(sequence)
        covered = [False] * len(text)
        for k in range(len(text) - 3):
            if any(text[k : k + 4] == s[j : j + 4] for s in known for j in range(len(s) - 3)):
                covered[k : k + 4] = [True] * 4
        marked = [False] * len(text)
        for lo, hi in own.spans(text, 4):
            marked[lo:hi] = [True] * (hi - lo)
        assert marked == covered


def test_windows_across_the_seam_of_two_known_excerpts(docs_of, rng):
    rows = []
    for k in range(12):
        p = prose(rng, 160).split()
        cuts = [(0, 100), (60, 160), (0, 160), (52, 108)] + [sorted(rng.sample(range(161), 2)) for _ in range(12)]
        rows += [(100 * k + j, " ".join(p[a:b])) for j, (a, b) in enumerate(cuts)]
    assert found(docs_of(rows).repartition(6)) == brute(rows)


def test_spans_part_where_a_window_is_unknown():
    own = S.SuffixAutomaton()
    own.add(list(range(5)))
    own.add(list(range(3, 10)))
    assert own.spans(list(range(10)), 4) == [(0, 5), (3, 10)]
    assert own.spans(list(range(1, 5)), 4) == [(0, 4)]
