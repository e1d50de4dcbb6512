from __future__ import annotations

from itertools import combinations

import pytest

from sondeframe.llm import jaccard_join as J
from tests.llm.conftest import prose


def grams(text, n=5):
    words = (text or "").split()
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows if i is not None}
    links = {i: set() for i in sets}
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    out, seen = {}, set()
    for i in sorted(sets):
        if i in seen:
            continue
        todo, own = [i], set()
        while todo:
            x = todo.pop()
            if x not in own:
                own.add(x)
                todo += links[x]
        seen |= own
        out |= {x: (min(own), len(links[x])) for x in own}
    return out


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit%d" % rng.randrange(1000)
    return " ".join(words)


@pytest.mark.parametrize("block", [3, 256])
def test_against_brute_force(docs_of, rng, block):
    base = [prose(rng, n) for n in (3, 5, 40, 120, 300)]
    rows = [(k, b) for k, b in enumerate(base)]
    for k in range(40):
        rows.append((100 + k, edited(rng, base[2 + k % 3], k % 4)))
    rows += [(200, base[3]), (201, base[3]), (202, base[0]), (300, None), (301, ""), (302, " \n"), (303, "one"), (304, "one"), (305, "one two")]
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_classes(docs_of(rows), block=block).collect()}
    assert found == brute(rows)


def test_drop_keeps_one_of_each_class(docs_of, rng):
    base = prose(rng, 200)
    df = docs_of([(5, base), (3, edited(rng, base, 1)), (9, base), (1, prose(rng, 50)), (None, base), (1, "again")])
    kept = J.drop_near_duplicates(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert kept.columns == df.columns
    assert J.jaccard_classes(docs_of([]).limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = J.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= J.MAX_HASHES
    with pytest.raises(ValueError):
        J.choose_bands(0.05, 0.9999999, 4)


def test_unlike_texts_that_share_bands_are_not_compared(spark, docs_of, rng):
    """A chain: each text shares half of its words with the next, a similarity of about 0.3; one in fifty has a near copy."""
    words = [f"c{k}" for k in range(50 * 1501)]
    rows = [(k, " ".join(words[50 * k : 50 * k + 100])) for k in range(1500)]
    rows += [(10_000 + k, rows[k][1] + " tail") for k in range(0, 1500, 50)]
    groups = J.candidate_groups(sketched(docs_of(rows)), *J.choose_bands(J.THRESHOLD, J.RECALL), J.THRESHOLD)
    per = groups.groupBy("component").count().collect()
    assert len(per) == 30 and {r["count"] for r in per} == {2}
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_classes(docs_of(rows)).collect()}
    assert found == {k: (k % 10_000, int(k % 50 == 0)) for k, _ in rows}


def sketched(docs):
    bands, rows = J.choose_bands(J.THRESHOLD, J.RECALL)
    return docs.selectExpr("doc_id", "text", "unhex(sha2(text, 256)) AS key").mapInArrow(J._sign(J.WORDS, bands, rows), "doc_id long, key binary, bands array<long>, sketch binary")


@pytest.mark.parametrize("block", [4, 1024])
def test_candidates_tie_all_that_the_threshold_does(docs_of, rng, block):
    base = [prose(rng, 150) for _ in range(4)]
    rows = [(k, edited(rng, base[k % 4], k % 5)) for k in range(160)]
    groups = {r["node"]: r["component"] for r in J.candidate_groups(sketched(docs_of(rows)), *J.choose_bands(J.THRESHOLD, J.RECALL), J.THRESHOLD, block).collect()}
    want = brute(rows)
    for a, (root, links) in want.items():
        assert not links or groups[a] == groups[root]


def test_sketch_groups():
    import numpy as np

    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (60, 40), dtype=np.uint8)
    for k in range(20, 60):
        rows[k] = rows[k - 20]
        rows[k, rng.integers(0, 40, 6)] = 0
    group = J.sketch_groups(rows, 30)
    near = (rows[:, None] == rows[None]).sum(axis=2) >= 30
    reach = near.copy()
    for _ in range(6):
        reach = reach @ reach
    assert (group == reach.argmax(axis=1)).all()


def test_least_agreement_costs_no_recall():
    bands, rows = J.choose_bands(J.THRESHOLD, J.RECALL)
    least = J.least_agreement(J.THRESHOLD, bands * rows)
    from math import comb

    n = bands * rows
    assert sum(comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least)) < 1e-6 and least > 0.55 * n


def test_blocks_are_bounded_in_bytes(spark, docs_of, rng, monkeypatch):
    """Long near copies meet in more blocks, and give the same classes and links."""
    base = prose(rng, 4000)
    rows = [(k, base + f" end{k} of copy{k}") for k in range(24)] + [(100, prose(rng, 50)), (101, base)]
    one = sorted(map(tuple, J.jaccard_classes(docs_of(rows)).collect()))
    monkeypatch.setattr(J, "BLOCK_BYTES", 50_000)
    assert sorted(map(tuple, J.jaccard_classes(docs_of(rows)).collect())) == one
    assert {r[1] for r in one if r[0] != 100} == {0}
