from __future__ import annotations

import random

import numpy as np

from sondeframe.llm import decontaminate as D
from tests.llm.conftest import prose


def naive(item, text):
    best, table = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            same = D.MATCH if item[i - 1] == text[j - 1] else D.MISMATCH
            table[i][j] = max(0, table[i - 1][j - 1] + same, table[i - 1][j] + D.GAP, table[i][j - 1] + D.GAP)
            best = max(best, table[i][j])
    return best


def test_alignment_against_the_table():
    rng = random.Random(2)
    for _ in range(60):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        score, start, stop = D.align(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64))
        assert score == naive(item, text)
        if score:
            assert naive(item, text[start:stop]) == score


def changed(rng, item, n):
    words = item.split()
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + 1] = [] if kind == 0 else ["other"] if kind == 1 else [words[at], "added"]
    return " ".join(words)


def items_and_docs(spark, docs_of, rng):
    items = [f"unique{k} " + prose(rng, 30) for k in range(8)] + ["two words", "", None]
    bench = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(items)], "item_id long, text string, score string")
    rows = [(k, prose(rng, 120)) for k in range(40)]
    planted = {}
    for k in range(8):
        planted[100 + k] = k
        rows.append((100 + k, f"{prose(rng, 50)}\n{changed(rng, items[k], k % 5).upper() if k % 2 else changed(rng, items[k], 3)}, {prose(rng, 40)}"))
    rows += [(300, None), (301, ""), (302, "some, Two.Words! here"), (303, "two other words"), (None, items[0]), (100, "again without")]
    return bench, docs_of(rows), planted | {302: 8, None: 0}


def test_edited_copies_are_found(spark, docs_of, rng):
    bench, df, planted = items_and_docs(spark, docs_of, rng)
    found = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(df, bench).collect()}
    assert set(found) == set(planted.items())
    assert all(D.LEAST_SCORE <= r["score"] <= 1 for r in found.values())
    exact = found[None, 0]
    assert (exact["score"], exact["start"], exact["n_words"]) == (1.0, 0, 31)


def test_case_of_any_letter_is_ignored(spark, docs_of):
    item = "Élan vêtu, où l'âge évité ÈS çà naïf Ünder größer señal mañana"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = D.contaminated(docs_of([(1, "some words " + item.upper().replace("SS", "ß")), (2, "other words")]), bench).collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(1, 1.0)]


def test_the_shuffle_of_seeds_gives_the_same(spark, docs_of, rng, monkeypatch):
    bench, df, planted = items_and_docs(spark, docs_of, rng)
    bench = bench.unionByName(spark.createDataFrame([(None, "an item that has no number at all", "x"), (3, "a second text of the third item"), (3, "a second text of the third item")][:1], bench.schema))
    df = df.unionByName(docs_of([(500, "here is an item that has no number, at all. " + "long " * 3000), (100, "again without")]))
    one = sorted(map(str, D.contaminated(df, bench).collect()))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    assert sorted(map(str, D.contaminated(df, bench).collect())) == one and len(one) == len(planted) + 1
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.filter("item_id = 9")).count() == 0


def test_recall_against_alignment_without_seeds(spark, docs_of, rng):
    """Every document with every item, whole; copies of which up to two fifths of the words are edited."""
    items = [prose(rng, 40) for _ in range(10)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = []
    for share in (0.0, 0.1, 0.2, 0.3, 0.4):
        rows += [(len(rows) + k, f"{prose(rng, 60)} {changed(rng, items[k % 10], int(40 * share))} {prose(rng, 60)}") for k in range(30)]
    hashed = D._hashes([t for _, t in rows])
    wanted = D._hashes(items)
    brute = {(rows[d][0], k): s / (D.MATCH * len(item)) for k, item in enumerate(wanted) for d, words in enumerate(hashed) if (s := D.align(item, words)[0]) / (D.MATCH * len(item)) >= D.LEAST_SCORE}
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated(docs_of(rows), bench).collect()}
    assert set(found) <= set(brute) and len(brute) > 110
    assert len(found) / len(brute) >= 0.97
    assert sum(found[x] == brute[x] for x in found) / len(found) > 0.95


def test_ties_take_the_first_placement(spark, docs_of, rng):
    item = prose(rng, 25)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (row,) = D.contaminated(docs_of([(1, f"{prose(rng, 30)} {item} {prose(rng, 70)} {item}")]), bench).collect()
    assert (row["score"], row["start"], row["n_words"]) == (1.0, 30, 25)


def test_clean_documents_stay(spark, docs_of, rng):
    bench, df, planted = items_and_docs(spark, docs_of, rng)
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == ({*range(40), 300, 301, 303})
    assert D.contaminated(df, bench.limit(0)).count() == 0
    assert D.drop_contaminated(df.limit(0), bench).count() == 0


def test_seeds_survive_edits_at_any_size_of_corpus():
    """Of copies with three tenths of their words replaced, nearly all that the aligner accepts keep a seed, whatever the counts."""
    rng = random.Random(4)
    words = [k + 1 for k in range(3000)]
    weights = [1 / k for k in words]
    items = [np.array(rng.choices(words, weights, k=rng.randrange(15, 60)), dtype=np.uint64) for _ in range(150)]
    rate = float(np.log(D.seed_rate(sum(map(len, items)))))
    chosen = []
    for scale in (1, 3_000, 200_000):
        counts = {w: max(1, int(4e6 / 9 / w)) * scale for w in words}
        total = float(np.log(4e6 * scale))
        chosen.append([D.seed_places(h, np.log([float(counts[int(w)]) for w in h]) - total, rate) for h in items])
    assert all([s[1].tolist() for s in one] == [s[1].tolist() for s in chosen[0]] for one in chosen)
    for edit in ("random", "spread", "rarest"):
        kept = accepted = 0
        for h, (n, _, hashes) in zip(items, chosen[0], strict=True):
            many = int(0.3 * len(h))
            where = rng.sample(range(len(h)), many) if edit == "random" else [int((k + 0.5) * len(h) / many) for k in range(many)] if edit == "spread" else np.argsort(h)[::-1][:many]
            copy = h.copy()
            copy[where] = [rng.getrandbits(62) for _ in range(many)]
            if D.align(h, copy)[0] >= D.LEAST_SCORE * D.MATCH * len(h):
                accepted += 1
                kept += bool(set(hashes.tolist()) & set(D._grams(copy, n).tolist()))
        assert accepted > 50 and kept >= 0.9 * accepted, edit


def test_items_of_a_document_come_in_rows_of_bounded_length(spark, docs_of, rng, monkeypatch):
    bench, df, planted = items_and_docs(spark, docs_of, rng)
    texts = [r["text"] for r in bench.filter("item_id < 8").collect()]
    df = df.unionByName(docs_of([(700, " and ".join(texts))]))
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    whole = sorted(map(str, D.contaminated(df, bench).collect()))
    monkeypatch.setattr(D, "ITEMS_A_ROW", 3)
    assert sorted(map(str, D.contaminated(df, bench).collect())) == whole and len(whole) == len(planted) + 8
