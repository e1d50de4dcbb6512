"""Stateful streams against what the batch operators find."""

from __future__ import annotations

import datetime
import random

import pytest

from sondeframe.operators import stitch
from sondeframe.streaming import stitching

BASE = datetime.datetime(2023, 6, 1, tzinfo=datetime.UTC)
COLUMNS = "station string, profile_seq long, profile_id string, bottom double, top double, date timestamp, event_time timestamp"


def fragments(rng):
    """Ascents of three stations, cut into fragments; some begin anew, some have gaps, some have no date."""
    rows, seq = [], 0
    for k in range(60):
        at = BASE + datetime.timedelta(hours=12 * (k // 3), minutes=k % 7)
        top = 0.0
        for part in range(rng.randrange(1, 5)):
            bottom = max(0.0, top + rng.choice([-200.0, 100.0, 450.0, 900.0])) if part else 20.0
            top = bottom + rng.uniform(300, 6000)
            seq += 1
            when = at + datetime.timedelta(minutes=part)
            rows.append((f"s{k % 3}", seq, f"p{seq}", None if rng.random() < 0.05 else bottom, top, None if rng.random() < 0.05 else when, when))
    return rows


def write(spark, rows, path, sizes):
    """Rows as files whose order of arrival is that of their times of writing."""
    at = 0
    for k, n in enumerate(sizes):
        spark.createDataFrame(rows[at : at + n], COLUMNS).coalesce(1).write.mode("append").parquet(f"{path}/{k:03d}")
        at += n
    assert at >= len(rows)


def streamed(spark, path, n):
    """The folders as a stream, one to a batch."""
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", n).option("recursiveFileLookup", True).parquet(str(path))


def test_shuffled_batches_give_the_chains_of_the_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = fragments(rng)
    want = {(r["station"], r["profile_seq"]): r["chain"] for r in stitch.chains(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(set(want.values())) < len(want)
    shuffled = sorted(rows, key=lambda r: r[6] + datetime.timedelta(hours=rng.uniform(0, 5)))
    shuffled += [("other", 10**6, "end", 0.0, 1.0, None, BASE + datetime.timedelta(days=90))]
    write(spark, shuffled, tmp_path / "in", [17] * (len(shuffled) // 17 + 1))
    query = stitching.land_stitched(spark, streamed(spark, tmp_path / "in", 1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination()
    got = {(r["station"], r["profile_seq"]): r["chain"] for r in spark.read.parquet(f"{tmp_path}/out/chains").filter("station <> 'other'").collect()}
    assert got == want
    assert spark.read.parquet(f"{tmp_path}/out/late").count() == 0
    state = [o for p in query.recentProgress for o in p["stateOperators"]]
    assert state and state[-1]["numRowsTotal"] < len(rows)  # what is over is forgotten


def test_late_fragments_are_set_aside(spark, tmp_path):
    hour = datetime.timedelta(hours=1)
    rows = [("a", 1, "p1", 0.0, 1000.0, BASE, BASE), ("a", 3, "p3", 2100.0, 3000.0, BASE, BASE + 0.2 * hour)]
    rows += [("b", 9, "p9", 0.0, 1.0, None, BASE + 20 * hour), ("b", 11, "p11", 0.0, 1.0, None, BASE + 21 * hour), ("a", 2, "p2", 1100.0, 2000.0, BASE, BASE + 0.1 * hour), ("b", 10, "p10", 0.0, 1.0, None, BASE + 400 * hour)]
    write(spark, rows, tmp_path / "in", [2, 1, 1, 1, 1])
    stitching.land_stitched(spark, streamed(spark, tmp_path / "in", 1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True).awaitTermination()
    chains = {r["profile_id"]: r["chain"] for r in spark.read.parquet(f"{tmp_path}/out/chains").collect()}
    late = [r["profile_id"] for r in spark.read.parquet(f"{tmp_path}/out/late").collect()]
    assert late == ["p2"] and chains["p1"] == 1 and chains["p3"] == 3


@pytest.mark.parametrize(("chain", "fragment", "want"), [
    (None, ("x", 10.0, 900.0, 5), (7, 900.0, 5)), ((1, 900.0, 5), ("x", 1300.0, 1200.0, 5), (1, 1200.0, 5)), ((1, 900.0, 5), ("x", 1300.0, 2000.0, 6), (7, 2000.0, 6)),
    ((1, 900.0, None), ("x", 1300.0, 2000.0, 6), (1, 2000.0, None)), ((1, 900.0, 5), ("x", None, 2000.0, 5), (7, None, 5)), ((1, None, 5), ("x", 900.0, 2000.0, 5), (7, 2000.0, 5)),
    ((1, 400.0, 5), ("x", 50.0, 2000.0, 5), (7, 2000.0, 5)), ((1, 400.0, 5), ("x", 900.0, None, 5), (1, None, 5)),
])
def test_join(chain, fragment, want):
    assert stitching.join(chain, 7, fragment, 500.0) == want


def test_keep_covers_hold(spark):
    rows = spark.createDataFrame([], COLUMNS)
    with pytest.raises(ValueError):
        stitching.stitched(rows, hold=datetime.timedelta(days=3), keep=datetime.timedelta(days=1))
