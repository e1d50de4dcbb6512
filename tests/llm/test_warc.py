from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from sondeframe.llm import warc as W

ROWS = [(k, f"http://a/{k}", f"<p>{k % 40} " + "x" * (k % 7 * 300)) for k in range(120)] + [
    (10_001, None, None), (10_002, "http://a/\r\n", ""), (None, "u", ""), (None, "u", "x"), (None, "v", "x"), (10_004, "z", "y\r\n\r\nWARC/1.1"), (10_004, "z", "y\r\n\r\nWARC/1.1"), (3, "again", "<p>5 " + "x" * 1500),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, shard int")


def brute(rows, least=0):
    last = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if page is not None and len(payload) >= least:
            last[payload] = max(last.get(payload, -1), page)
    out = []
    for page, url, html in rows:
        payload = (html or "").encode()
        first = last.get(payload) in (None, page) or len(payload) < least
        out.append((page, None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if first else "revisit", None if first else last[payload], payload if first else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 400])
def test_round_trip(spark, tmp_path, least):
    folder = f"file://{tmp_path}/w"
    manifest = W.write_warc(table(spark), folder, least_bytes=least, shard_bytes=8_000, roll_bytes=1_500)
    assert sorted((tuple(r) for r in W.read_warc(spark, folder).collect()), key=str) == brute(ROWS, least)
    files = sorted(p.name for p in Path(tmp_path, "w").glob("*.warc.gz"))
    assert files == sorted(r["name"] for r in manifest.collect()) and len(files) > 5
    assert not list(Path(tmp_path, "w").glob("*.tmp")) and Path(tmp_path, "w", "manifest.jsonl").exists()
    for r in manifest.collect():
        assert hashlib.sha256(Path(tmp_path, "w", r["name"]).read_bytes()).hexdigest() == r["sha256"]


def test_equal_tables_give_equal_files(spark, tmp_path):
    for name, parts in (("a", 1), ("b", 5)):
        W.write_warc(table(spark).repartition(parts), f"file://{tmp_path}/{name}", shard_bytes=8_000, roll_bytes=1_500)
    one, two = ({p.name: p.read_bytes() for p in Path(tmp_path, n).glob("*.warc.gz")} for n in ("a", "b"))
    assert one == two


def test_empty_table(spark, tmp_path):
    W.write_warc(table(spark).limit(0), f"file://{tmp_path}/w")
    assert not list(Path(tmp_path, "w").glob("*.warc.gz"))


def test_members():
    parts = [b"", b"a" * 100_000, b"xyz"]
    assert list(W.members(b"".join(gzip.compress(p) for p in parts), step=7)) == parts
    with pytest.raises(ValueError):
        list(W.members(gzip.compress(b"abc")[:-3]))


def test_the_number_of_jobs_does_not_follow_the_shards(spark, tmp_path):
    jobs = []
    for name, size in (("many", 1_000), ("few", 40_000)):
        group = f"warc-{name}"
        spark.sparkContext.setJobGroup(group, group)
        W.write_warc(table(spark, ROWS * 3), f"file://{tmp_path}/{name}", shard_bytes=size)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        shards = {p.name.split("-")[0] for p in Path(tmp_path, name).glob("*.warc.gz")}
        jobs.append((len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), len(shards)))
    (many, shards), (few, fewer) = jobs
    assert shards > 4 * fewer and many <= few + 2


def test_shards_are_even_where_one_id_holds_most_rows(spark, tmp_path):
    rows = [(None, f"u{k}", f"<p>{k}") for k in range(2000)] + [(k, "v", f"<b>{k}") for k in range(200)] + [(2**62, "w", "last")]
    manifest = W.write_warc(table(spark, rows), f"file://{tmp_path}/w", shard_bytes=50_000)
    per = {}
    for r in manifest.collect():
        per[r["name"][:6]] = per.get(r["name"][:6], 0) + r["records"]
    assert sum(per.values()) == len(rows) and len(per) > 15 and max(per.values()) < 150


def test_uris():
    assert W.store_of("file:///a/b")[1] == "/a/b"
    kind, path = W.store_of("s3a://bucket/w?region=us-east-1")
    assert kind.type_name == "s3" and path == "bucket/w"
