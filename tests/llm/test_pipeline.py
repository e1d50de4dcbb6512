from __future__ import annotations

import pytest

import corpus_pipeline as P
from sondeframe.llm import queries as Q
from tests.llm.conftest import prose


@pytest.fixture
def tables(spark, docs_of, rng, tmp_path):
    """Clean prose with planted junk, copies, near copies and a leak."""
    items = [prose(rng, 40) for _ in range(3)]
    rows = [(k, prose(rng, 100)) for k in range(120)]
    rows += [(200 + k, " ".join(f"##{rng.randrange(9)}$$" for _ in range(80))) for k in range(30)]
    rows += [(300, rows[5][1]), (301, rows[6][1] + " tail"), (302, rows[7][1] + " " + items[0]), (303, None), (304, "")]
    docs_of(rows).drop("keep_id", "rate").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 120, 2)] + [(200 + k, 0, k % 2) for k in range(0, 30, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tables):
    ids = {}
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = stage(spark, docs, tables)
        path = f"{tables}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids[name] = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == (columns if name != "mixture" else [*columns, "rate", "copies"])
    assert len(ids["quality"] & set(range(120))) >= 110 and not ids["quality"] & set(range(200, 230))
    assert not ids["exact_dedup"] & {5} and ids["exact_dedup"] >= {300} & ids["quality"]
    near = {6, 301} & ids["exact_dedup"]
    assert len({6, 301} & ids["near_dedup"]) == min(1, len(near))
    assert ids["near_dedup"] - ids["decontaminate"] <= {302} and 302 not in ids["decontaminate"]
    assert ids["mixture"] == ids["decontaminate"]


def test_run_gives_the_last_stage(spark, tables, monkeypatch):
    monkeypatch.setattr(P, "STAGES", [s for s in P.STAGES if s[0] in ("exact_dedup", "decontaminate")])
    ids = {r["doc_id"] for r in P.run(spark, tables).collect()}
    assert len(P.STAGES) == 2 and not ids & {5, 302} and {6, 300, 301} <= ids


CONTRACTS = {
    "op1_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op5_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_hmm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_columns(spark, name):
    out = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert ", ".join(" ".join(x) for x in out.dtypes) == CONTRACTS[name]
    source = "pages" if "page_id" in out.columns else "documents"
    assert out.count() == spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").count()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    out = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
