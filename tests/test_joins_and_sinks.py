"""As-of joins against all pairs, cubes of sketches, table functions in SQL, and the figure sink."""

from __future__ import annotations

import datetime
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sondeframe.operators import features, qc
from sondeframe.operators.asof import asof_join
from sondeframe.plans import cubes, sql
from sondeframe.sources import figures
from tests.test_numerics import COLUMNS, random_levels

BASE = datetime.datetime(2023, 1, 1, tzinfo=datetime.UTC)


def nearest(row, right, direction, tolerance):
    k, t = row[0], row[1]
    best = None
    for q, u, name in right:
        if k is None or t is None or q != k or u is None:
            continue
        gap = (t - u).total_seconds()
        if direction == "before" and gap < 0 or direction == "after" and gap > 0 or tolerance is not None and abs(gap) > tolerance:
            continue
        key = (abs(gap), gap < 0, name)
        best = key if best is None or key < best else best
    return (None, None) if best is None else (best[2], best[0])


@pytest.mark.parametrize("direction", ["before", "after", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 7200.0])
def test_asof_against_all_pairs(spark, direction, tolerance):
    rng = random.Random(3)
    at = lambda: BASE + datetime.timedelta(minutes=10 * rng.randrange(0, 2500))
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([at(), at(), at(), None]), k) for k in range(300)]
    right = [(rng.choice(["a", "b", "b", "d", None]), rng.choice([at(), at(), None]), k) for k in range(150)]
    right += [("a", right[0][1] or BASE, 900), ("a", right[0][1] or BASE, 901)]  # equal times
    a = spark.createDataFrame(left, "station string, t timestamp, n int")
    b = spark.createDataFrame(right, "station string, u timestamp, m int")
    got = {r["n"]: (r["m"], r["distance"]) for r in asof_join(a, b, ["station"], "t", "u", direction, tolerance, ["m"], bucket=86_400.0).collect()}
    assert got == {n: nearest((k, t), right, direction, tolerance) for k, t, n in left}
    small = {r["n"]: (r["m"], r["distance"]) for r in asof_join(a, b, ["station"], "t", "u", direction, tolerance, ["m"], bucket=600.0).collect()}
    assert small == got
    assert asof_join(a, b.limit(0), ["station"], "t", "u", direction).filter("m is null").count() == 300
    for bad in (lambda: asof_join(a, b, ["station"], "t", "u", "other"), lambda: asof_join(a, b.withColumn("n", F.lit(1)), ["station"], "t", "u")):
        with pytest.raises(ValueError):
            bad()


def test_cells_merge_as_the_rows_would(spark, tmp_path):
    rng = random.Random(6)
    rows = spark.createDataFrame([(f"s{rng.randrange(3)}", rng.randrange(1, 5), rng.randrange(2), rng.choice([None, rng.uniform(0, 9)]), f"p{rng.randrange(4000)}") for _ in range(20_000)],
                                 "station string, month int, cluster int, v double, profile_id string")
    path = str(tmp_path / "cells")
    cubes.land_cells(cubes.cells(rows.filter("month < 4"), "v", "profile_id"), path)
    cubes.land_cells(cubes.cells(rows.filter("month >= 3"), "v", "profile_id"), path)  # month 3 again, month 4 new
    landed = spark.read.parquet(path)
    assert landed.agg(F.sum("n")).first()[0] == 20_000
    cube = {(r["station"], r["month"], r["cluster"], r["level"]): r for r in cubes.roll_up(landed).collect()}
    assert len(cube) == (3 + 1) * (4 + 1) * (2 + 1)
    exact = rows.cube("station", "month", "cluster").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.avg("v").alias("mean"), F.count_distinct("profile_id").alias("d")).collect()
    for r in exact:
        own = cube[r["station"], r["month"], r["cluster"], r["level"]]
        assert own["n"] == r["n"] and own["mean"] == pytest.approx(r["mean"]) and abs(own["n_distinct"] - r["d"]) <= 4 * cubes.relative_error() * r["d"] + 1


def test_sql_gives_what_the_calls_give(spark):
    levels = spark.createDataFrame(random_levels(30), COLUMNS)
    sql.register(spark, levels=levels)
    want = {r["profile_id"]: r.asDict() for r in qc.monotonicity(levels).collect()}
    got = {r["profile_id"]: r.asDict() for r in spark.sql("SELECT * FROM pressure_check(TABLE(levels))").collect()}
    assert got == want
    ours = features.parcel_profile(levels).filter("parcel_t is not null and not isnan(parcel_t)")
    lifted = {(r["profile_id"], r["level_idx"]): r["parcel_t"] for r in ours.collect()}
    found = spark.sql("SELECT p.profile_id, p.level_idx, p.parcel_t FROM parcel_temperature(TABLE(SELECT * FROM levels)) p WHERE p.parcel_t IS NOT NULL")
    assert {(r["profile_id"], r["level_idx"]): r["parcel_t"] for r in found.collect()} == pytest.approx(lifted) and lifted
    with pytest.raises(Exception, match="p_niv"):
        spark.sql("SELECT * FROM pressure_check(TABLE(SELECT profile_id, altitude, level_idx FROM levels))").collect()


def lines(spark, n=12):
    rows = [(f"profile {k}/x", s, i, None if i == 3 else float(i * k), float(100 * i)) for k in range(n) for s in ("t", "td<") for i in range(8)]
    return spark.createDataFrame(rows, figures.SCHEMA).repartition(5)


def test_equal_tables_give_equal_figures(spark, tmp_path):
    for name in ("a", "b"):
        figures.draw(lines(spark), str(tmp_path / name))
    files = sorted(os.listdir(tmp_path / "a"))
    assert files == sorted(figures.file_name(f"profile {k}/x") for k in range(12)) == sorted(os.listdir(tmp_path / "b"))
    for f in files:
        text = (tmp_path / "a" / f).read_text()
        assert text == (tmp_path / "b" / f).read_text() and text.count("<polyline") == 4 and "td&lt;" in text


def test_a_failed_job_leaves_no_figure(spark, tmp_path):
    fail = F.udf(lambda x: 1 / 0 if x == "profile 5/x" else x)
    with pytest.raises(Exception, match="division"):
        figures.draw(lines(spark).withColumn("figure", fail("figure")), str(tmp_path / "out"))
    writer = figures.FigureWriter(str(tmp_path / "out"))
    drawn = writer.write(iter([{"figure": "f", "series": "s", "x": 1.0, "y": 2.0}]))
    assert os.path.exists(f"{drawn.folder}/f.svg")
    writer.abort([drawn, None])
    assert [f for f in os.listdir(tmp_path / "out") if f.endswith(".svg")] == [] and not os.path.exists(drawn.folder)
    again = figures.FigureWriter(str(tmp_path / "out"))
    lost, kept = (again.write(iter([{"figure": "f", "series": "s", "x": 1.0, "y": float(k)}])) for k in (1, 2))
    again.commit([kept])  # the first task was lost after it wrote
    assert [f for f in os.listdir(tmp_path / "out") if not f.startswith("_temporary")] == ["f.svg"] and not os.path.exists(lost.folder)


def test_profiles_as_lines(spark):
    levels = spark.createDataFrame(random_levels(3), COLUMNS)
    got = figures.profile_lines(levels, ["t", "td"])
    assert got.select("figure").distinct().count() == 6 and got.groupBy("figure", "series", "place").count().filter("count > 1").count() == 0
    assert re.fullmatch(r"[A-Za-z0-9._%-]+\.svg", figures.file_name("a b/c:ü"))
