from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from sondeframe.llm import tiered_search as T
from tests.llm.conftest import prose

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n, length = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = []
    for item, text in set(items):
        scores = []
        for i, t in own:
            many = Counter(t)
            m = 10 + (90 * len(t) * n) // length if length else 10
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * many[x] // (1000 * many[x] + 8 * m)) for x in set(terms(text)) if many[x])
            scores.append((-score, i is None, i))
        best = sorted((s for s in scores if s[0]), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, rank int")


def found(spark, docs_of, docs, items):
    rows = T.ranked_search(docs_of(docs), items_of(spark, items)).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=str), Counter(r["tier"] for r in rows if r["rank"] == 1)


@pytest.mark.parametrize(("tiers", "broadcast"), [((1 << 10, 1 << 15), 200_000), ((4, 40), 200_000), ((4, 40), 0), ((1, 2, 3, 300), 200_000)])
def test_against_brute_force(spark, docs_of, rng, monkeypatch, tiers, broadcast):
    monkeypatch.setattr(T, "TIERS", tiers)
    monkeypatch.setattr(T, "BROADCAST_ROWS", broadcast)
    docs = [(k, prose(rng, rng.randrange(0, 60))) for k in range(400)]
    docs += [(400 + k, docs[k][1]) for k in range(40)]  # equal scores
    docs += [(500, None), (501, ""), (502, "..."), (3, docs[3][1]), (None, docs[5][1]), (503, "Größe W1 w1 W2-w3 東京")]
    items = [(k, " ".join(docs[7 * k][1].split()[:25])) for k in range(12)]
    items += [(20, None), (21, "unknownword"), (22, "w1 w2 w3 W1"), (22, "w1 w2 w3 W1"), (22, "größe 東京"), (23, "w5")]
    got, tier = found(spark, docs_of, docs, items)
    assert got == brute(docs, items)
    if tiers[0] < 10:
        assert len(tier) > 1  # some items are proven early, others fall through


def test_a_word_of_all_documents_and_a_long_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(T, "TIERS", (8, 64))
    docs = [(k, "common " * (k % 5 + 1) + f"own{k} shared{k % 40}") for k in range(500)] + [(900, "common " + " ".join(f"x{k}" for k in range(300_000)))]
    items = [(1, "common own7 shared3"), (2, "common"), (3, "shared7 own47"), (4, "x299999")]
    assert found(spark, docs_of, docs, items)[0] == brute(docs, items)


def test_empty_tables(spark, docs_of):
    assert found(spark, docs_of, [], [(1, "word")])[0] == []
    assert found(spark, docs_of, [(1, "word")], [])[0] == []
    assert found(spark, docs_of, [(1, None)], [(1, "word")])[0] == []


def test_index_of_all_terms(spark, docs_of):
    index = T.build_index(docs_of([(1, "a b b"), (2, "b c")]))
    own, wanted = T.item_terms(items_of(spark, [(1, "b c")]))
    assert [(r["rank"], r["doc_id"]) for r in T.search(index, own, wanted).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert index.terms().count() == 3
    index.remove()
