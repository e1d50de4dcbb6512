from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondeframe.llm import exact_dedup as D


@given(st.lists(st.integers(0, 2**40), max_size=200), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values, rice):
    own = np.unique(np.array(values, dtype=np.int64))
    rice = max(rice, int(own.max()).bit_length() - 10 if len(own) else 0)  # keeps the unary parts short
    assert D.golomb_decode(D.golomb_encode(own, rice), len(own), rice).tolist() == own.tolist()


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_ROWS", 4)
    texts = ["a", "a ", "b", "", "long " * 5000, "ü", "u\u0308", "x\n"]
    rows = [(k, texts[k % 7 if k < 30 else k % 3]) for k in range(60)] + [(100, None), (101, None), (None, "a"), (None, "only null"), (102, "single")]
    found = D.exact_duplicates(docs_of(rows).repartition(5), owners=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == brute(rows)
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in found})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_repeated_rows_and_empty_table(docs_of):
    df = docs_of([(1, "same"), (1, "same"), (2, "other")])
    assert sorted(r["doc_id"] for r in D.drop_exact_duplicates(df).collect()) == [1, 2]
    assert D.drop_exact_duplicates(df).columns == df.columns
    assert D.exact_duplicates(docs_of([]).limit(0)).count() == 0


@pytest.mark.parametrize("owners", [1, 7])
def test_one_large_group(docs_of, owners):
    found = D.exact_duplicates(docs_of([(k, "copy" if k % 3 else f"own {k}") for k in range(300)]), owners=owners)
    assert {r["group_size"] for r in found.filter("doc_id % 3 != 0").collect()} == {200}
    assert found.filter("kept").count() == 101


@pytest.mark.parametrize(("n", "batch", "owners"), [(4_000, 7, 7), (40_000, 10_000, 1), (40_000, 10_000, 7), (12_000, 10_000, 16_384)])
def test_chunks_span_arrow_batches(spark, n, batch, owners):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        docs = spark.range(0, n, 1, 1).selectExpr("id AS doc_id", "concat('text ', CASE WHEN id % 10 = 0 THEN id DIV 20 * 20 ELSE id END) AS text")
        found = D.exact_duplicates(docs, owners=owners)
        kept, groups = found.selectExpr("count_if(kept)", "count_if(group_size = 2 AND keep_id % 20 = 10)").first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (kept, groups) == (n - n // 20, n // 10)
