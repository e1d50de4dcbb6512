from __future__ import annotations

import random

import pytest

from sondeframe.llm import quality as Q
from sondeframe.llm.common import kth_largest


@pytest.fixture
def judged(spark, docs_of, rng):
    """Good prose and junk of two kinds; every second document is labelled."""
    good = [f"word{k}" for k in range(200)]
    kinds = {"good": lambda: " ".join(rng.choice(good) for _ in range(80)), "junk": lambda: " ".join("#$%&!"[rng.randrange(5)] * 4 + str(rng.randrange(9)) for _ in range(80)),
             "toxic": lambda: " ".join(rng.choice(good) if rng.random() < 0.7 else f"slur{rng.randrange(5)}" for _ in range(80))}
    rows = [(k, kinds["good" if k % 10 < 7 else "junk" if k % 10 < 9 else "toxic"]()) for k in range(600)]
    labels = [(k, int(k % 10 < 7), int(k % 10 == 9)) for k in range(0, 600) if k // 10 % 2] + [(None, 1, 0), (5, None, 1)]
    return docs_of(rows), spark.createDataFrame([(*r, "clash") for r in labels], "doc_id long, quality int, toxic int, text string")


def test_held_out_documents(judged):
    docs, labels = judged
    found = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    assert len(found) == 600
    unseen = [k for k in found if not k // 10 % 2]
    assert sum(found[k]["weight"] for k in unseen if k % 10 < 7) / 210 > sum(found[k]["weight"] for k in unseen if k % 10 >= 7) / 90 + 3
    kept = {k for k in unseen if found[k]["kept"]}
    assert sum(k % 10 < 7 for k in kept) >= 0.9 * 210
    assert sum(k % 10 >= 7 for k in kept) <= 0.05 * 90


def test_draw_is_the_top_of_the_gumbel_keys(judged):
    rows = Q.quality_scores(*judged).collect()
    kept, dropped = ([r["gumbel_key"] for r in rows if r["kept"] is x] for x in (True, False))
    assert min(kept) > max(dropped)


def test_stage_and_edge_cases(judged, docs_of, spark):
    docs, labels = judged
    odd = docs.unionByName(docs_of([(900, None), (901, ""), (None, "word1 word2 word3"), (902, "x" * 200_000), (3, "word1 word2")]))
    kept = Q.keep_quality(odd, labels)
    assert kept.columns == docs.columns
    assert Q.quality_scores(odd, labels).count() == 605
    assert Q.keep_quality(docs.limit(0), labels).count() == 0
    assert Q.keep_quality(docs, labels.limit(0)).count() == 600  # without labels all stay


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.25] * 500
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    own = sorted(values, reverse=True)
    for k in (1, 7, 1500, 3500):
        assert kth_largest(df, "x", k, buckets=16, few=10) == own[k - 1]
    assert kth_largest(df, "x", 0) is None and kth_largest(df, "x", 3501) is None


def test_length_alone_rejects_no_clean_text(docs_of, spark, rng):
    """Clean text has a few of the words that toxic text is full of."""
    clean = [f"word{k}" for k in range(200)]

    def text(n, slurs):
        return " ".join(f"slur{rng.randrange(5)}" if rng.random() < slurs else rng.choice(clean) for _ in range(n))

    rows = [(k, text(80, 0.3 if k % 5 == 0 else 0.005)) for k in range(3000)]
    long = {9000: text(100_000, 0.005), 9001: text(300_000, 0.005), 9002: text(1_000_000, 0.005), 9003: text(90_000, 0.005) + " " + text(10_000, 0.3)}
    labels = spark.createDataFrame([(k, int(k % 5 > 0), int(k % 5 == 0)) for k in range(0, 3000) if k // 10 % 2], "doc_id long, quality int, toxic int")
    kept = {}
    for k, t in long.items():  # one at a time, so that the raw counts are of the short texts
        kept |= {r["doc_id"]: r["kept"] for r in Q.quality_scores(docs_of([*rows, (k, t)]), labels).collect() if r["doc_id"] == k}
    assert kept == {9000: True, 9001: True, 9002: True, 9003: False}


def test_weights_against_a_count_by_hand(judged):
    """Counts, log ratios and weights again, a document and an n-gram at a time."""
    import numpy as np
    import pyarrow as pa

    docs, labels = judged
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.na.drop().collect()}
    side = {r["doc_id"]: r["fit"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'fit'), 4) > 0 AS fit").collect()}
    grams, lengths = {}, {}
    for k, text in texts.items():
        ((_, words, offsets),) = Q._runs(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]))
        grams[k] = [buckets.tolist() for _, buckets in Q._features(words, offsets)]
        lengths[k] = (len(text.encode()), len(text.split()), len(text.split()))
        assert [len(g) for g in grams[k]] == [len(text.encode()) - 3, len(text.split()) - 1, len(text.split())]
    tables = []
    for kind in range(Q.KINDS):
        raw, target = ({}, {})
        for k, own in grams.items():
            for b in own[kind]:
                raw[b] = raw.get(b, 0) + 1
                if known.get(k) == (1, 0) and side[k]:
                    target[b] = target.get(b, 0) + 1
        share = sum(target.values()) / sum(raw.values())
        ratio = {b: np.log((target.get(b, 0) + Q.ADD) / (n * share + Q.ADD)) for b, n in raw.items()}
        tables.append({b: np.sign(x) * max(abs(x) - Q.SHRINK, 0) for b, x in ratio.items()})
    sums = {k: [sum(tables[kind][b] for b in own[kind]) for kind in range(Q.KINDS)] for k, own in grams.items()}
    good = [k for k, v in known.items() if v == (1, 0) and not side[k] and k in texts]
    want = dict.fromkeys(texts, 0.0)
    for kind in range(Q.KINDS):
        rates = sorted((-sums[k][kind] / lengths[k][kind], lengths[k][kind]) for k in good)
        total, allowed = 0, None
        for rate, n in rates:
            total += n
            if total >= Q.ALLOWED * sum(n for _, n in rates) - 1e-9:
                allowed = rate
                break
        x = {k: min(sums[k][kind] + allowed * lengths[k][kind], 0) / (lengths[k][kind] + Q.PADS[kind]) ** 0.5 for k in texts}
        centre, spread = np.median([x[k] for k in good]), max(np.std([x[k] for k in good]), 1e-6)
        want = {k: want[k] + (x[k] - centre) / spread for k in texts}
    found = {r["doc_id"]: r["weight"] for r in Q.quality_scores(docs, labels).collect()}
    assert all(found[k] == pytest.approx(want[k], rel=1e-3, abs=1e-2) for k in texts)


def test_draws_follow_the_weights(spark):
    """Of three rows of log weights 0, -0.5 and -1 the first key is largest as often as its weight says."""
    import numpy as np

    df = spark.range(60_000).selectExpr("id AS doc_id", "id div 3 AS trial", "-0.5D * (id % 3) AS weight")
    for temperature in (1.0, 0.25):
        keyed = df.withColumn("key", Q.gumbel_key(df["weight"], temperature, 3))
        won = {r["w"]: r["count"] for r in keyed.groupBy("trial").agg({"key": "max"}).join(keyed, "trial").filter("key = `max(key)`").selectExpr("weight AS w").groupBy("w").count().collect()}
        chances = np.exp(np.array([0, -0.5, -1]) / temperature)
        assert [won.get(w, 0) / 20_000 for w in (0.0, -0.5, -1.0)] == pytest.approx((chances / chances.sum()).tolist(), abs=0.012)


def test_k_documents_and_ties(judged, docs_of):
    docs, labels = judged
    rows = Q.quality_scores(docs, labels, k=50).collect()
    assert sum(r["kept"] for r in rows) == 50
    twice = docs.unionByName(docs.filter("doc_id = 0")).unionByName(docs.filter("doc_id = 0"))  # repeated rows share a key
    keys = {r["gumbel_key"] for r in Q.quality_scores(twice, labels).filter("doc_id = 0").collect()}
    assert len(keys) == 1 and Q.quality_scores(docs, labels, k=10_000).filter("kept").count() == 600
    assert Q.quality_scores(docs, labels, k=0).filter("kept").count() == 0


def test_samples_of_any_table_size():
    from sondeframe.llm.common import hash_bound

    for n in (10**6, 25 * 10**9, 10**12, 10**15):
        assert (hash_bound(20_000, n) + 2**63) / 2**64 == pytest.approx(20_000 / n, rel=0.01)
    assert hash_bound(5, 5) == 2**63 - 1
