"""Hand-made profiles: parsing, stitching, quality control, plans and streams."""

from __future__ import annotations

import datetime
import io
import zipfile

import pytest
from pyspark.sql.datasource import EqualTo, In
from pyspark.sql import functions as F

from sondeframe.operators import aggregate as A
from sondeframe.operators import calendar as C
from sondeframe.operators import features, qc, stitch
from sondeframe.plans import analysis, figures
from sondeframe.schema import height_alias, without_nan
from sondeframe.sources import archives as Z
from sondeframe.sources import soundings as S
from sondeframe.streaming import recent
from tests.test_numerics import COLUMNS, random_levels

RECORD = """some preamble
numer_sta,date,nb_niv,Extra
89642,20230615001500,3,x
p_niv,altitude,t,td,dd,ff
98650,43,255.1,250.2,120,14.2
98000,95,256.0,250.9,125
97000,,abc,250.1,130,16.1
p_cis,altitude,p_cis
97500,60,1
"""
SECOND = """numer_sta,date,nb_niv
89643,20230615121500,1
p_niv,altitude,t,td,dd,ff
98650,43,255.1,nan,120,14.2
  numer_sta,looks,like,a,row,0
numer_sta,date,nb_niv
89644,20230616001500,1
p_niv,altitude,t,td,dd,ff
1,2,3,4,5,6,7
numer_sta,date,nb_niv
89645,20230617001500,1
p_niv,altitude,t,td,dd,ff
1,2
"""


def write(tmp_path):
    (tmp_path / "a.csv").write_text(RECORD)
    (tmp_path / "b.csv").write_text(SECOND)
    return f"file://{tmp_path}"


def test_parsing(spark, tmp_path):
    profiles, levels, cis = S.read_files(spark, write(tmp_path))
    found = {r["station"]: r for r in profiles.collect()}
    assert set(found) == {"89642", "89643"}  # a longer row, or only short rows, spoil a record
    assert found["89642"]["date"] == datetime.datetime(2023, 6, 15, 0, 15) and found["89642"]["nb_niv"] == 3 and found["89642"]["extra"] == {"Extra": "x"}
    assert found["89642"]["profile_seq"] < found["89643"]["profile_seq"]
    rows = [tuple(r) for r in levels.join(profiles.filter("station = '89642'"), "profile_id", "left_semi").orderBy("level_idx").drop("profile_id", "dep_lat", "dep_lon").collect()]
    assert rows == [(0, 43.0, 98650.0, 255.1, 250.2, 120.0, 14.2), (1, 95.0, 98000.0, 256.0, 250.9, 125.0, None), (2, None, 97000.0, None, 250.1, 130.0, 16.1)]
    other = levels.join(profiles.filter("station = '89643'"), "profile_id", "left_semi").orderBy("level_idx").collect()
    assert len(other) == 2 and other[0]["td"] is None and other[1]["altitude"] is None  # an indented line inside is a row
    block = cis.orderBy("row_idx").collect()
    assert block[0]["values"] == {"p_cis": 97500.0, "altitude": 60.0}


def test_archives(spark, tmp_path):
    own = io.BytesIO()
    with zipfile.ZipFile(own, "w") as z:
        for name in ("89642.2023061500.HR.csv", "89642.2023061512.HR.csv", "89642.2023061600.HR.csv", "11111.2023061500.HR.csv", "89642.2023061500.txt"):
            z.writestr(name, SECOND)
    (tmp_path / "rs.202306.zip").write_bytes(own.getvalue())
    (tmp_path / "rs.202307.zip").write_bytes(b"no archive")
    names = lambda **o: sorted(r["file"] for r in S.read_archives(spark, f"file://{tmp_path}", **o).select("file").collect())
    assert len(names()) == 4 and names(station="89642", days=["20230615"], hours=[0]) == ["89642.2023061500.HR.csv"]
    assert S.read_profiles(S.split_lines(S.read_archives(spark, f"file://{tmp_path}", station="11111")))[0].count() == 1
    broken = bytearray(own.getvalue())
    at = broken.index(b"p_niv")
    broken[at : at + 5] = b"\xff\xff\xff\xff\xff"
    (tmp_path / "rs.202308.zip").write_bytes(bytes(broken))
    found = S.archive_status(spark, f"file://{tmp_path}").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in found} == {"read": 7, "damaged": 1, "no archive": 1}


def test_filters_open_only_their_members(spark, tmp_path, monkeypatch):
    for month in (6, 7):
        with zipfile.ZipFile(tmp_path / f"rs.2023{month:02d}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for day in range(1, 29):
                for hour in (0, 12):
                    z.writestr(f"89642.2023{month:02d}{day:02d}{hour:02d}.HR.csv", f"record of {month} {day} {hour}\n" * 2000)
    reader = Z.ArchiveReader({"path": f"{tmp_path}/*.zip"})
    kept = list(reader.pushFilters([EqualTo(("day",), "20230615"), In(("hour",), (12, 13)), EqualTo(("status",), "read")]))
    assert kept == [EqualTo(("status",), "read")]
    assert [(p.path, [m.name for m in p.members]) for p in reader.partitions()] == [(f"{tmp_path}/rs.202306.zip", ["89642.2023061512.HR.csv"])]
    opened = []
    read = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, *a: opened.append(name) or read(self, name, *a))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert opened == ["89642.2023061512.HR.csv"] and [r[1:5] for r in rows] == [("89642.2023061512.HR.csv", "89642", "20230615", 12)]
    found = S.read_archives(spark, [f"file://{tmp_path}/rs.202306.zip", f"{tmp_path}/rs.202307.zip"], days=["20230615", "20230701"])
    assert sorted(r["file"] for r in found.collect()) == ["89642.2023061500.HR.csv", "89642.2023061512.HR.csv", "89642.2023070100.HR.csv", "89642.2023070112.HR.csv"]
    assert S.archive_members(spark, str(tmp_path)).filter("hour = 12 AND day > '20230620'").count() == 8 + 28


def test_partitions_hold_bounded_members(tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "PARTITION_BYTES", 1000)
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(50):
            z.writestr(f"1.20230601{k % 24:02d}.{k}.HR.csv", "x" * (90 if k else 5000))
    parts = Z.ArchiveReader({"path": str(tmp_path)}).partitions()
    assert [len(p.members) for p in parts] == [1, 11, 11, 11, 11, 5]


def test_selection(spark):
    files = spark.createDataFrame([(f"x/89642.2023{m:02d}01{h:02d}.HR.csv",) for m in (1, 2) for h in (0, 6, 12)], "file string")
    assert S.select_files(files, years=[2023], months=[1]).count() == 2
    assert S.select_files(files, dates=["20230201"], hours=None).count() == 3
    assert S.select_files(files).count() == 0
    with pytest.raises(ValueError):
        S.select_files(files, years=[2023], dates=["20230101"])


def test_landing_prunes_by_month(spark, tmp_path):
    profiles, levels, _ = S.read_files(spark, write(tmp_path))
    S.land(profiles, levels, f"{tmp_path}/landed")
    p, own = S.read_landed(spark, f"{tmp_path}/landed", [2023], [6])
    assert p.count() == 2 and own.count() == 5
    assert S.read_landed(spark, f"{tmp_path}/landed", [2023], [7])[1].count() == 0


def fragments(spark, rows):
    return spark.createDataFrame([("s", k, str(k), b, t, None if d is None else datetime.datetime(2023, 6, 15, d)) for k, (b, t, d) in enumerate(rows)],
                                 "station string, profile_seq long, profile_id string, bottom double, top double, date timestamp")


@pytest.mark.parametrize(("rows", "chains"), [
    ([(0.0, 1000.0, 0), (1500.0, 2000.0, 0)], [0, 0]),
    ([(0.0, 1000.0, 0), (1501.0, 2000.0, 0)], [0, 1]),
    ([(0.0, 1000.0, 0), (1200.0, 2000.0, 1)], [0, 1]),
    ([(0.0, 300.0, 0), (50.0, 2000.0, 0)], [0, 1]),
    ([(0.0, 1000.0, None), (1200.0, 2000.0, 1)], [0, 0]),
    ([(0.0, 3000.0, 0), (2600.0, 2700.0, 0), (3100.0, 4000.0, 0)], [0, 0, 0]),
    ([(0.0, None, 0), (100.0, 900.0, 0), (None, 5.0, 0), (100.0, 200.0, 0)], [0, 1, 2, 3]),
])
def test_chains(spark, rows, chains):
    assert [r["chain"] for r in stitch.chains(fragments(spark, rows)).orderBy("profile_seq").collect()] == chains


def test_stitching_keeps_all_heights(spark):
    profiles = fragments(spark, [(0.0, 0.0, 0)] * 2).select("station", "profile_seq", "profile_id", "date")
    levels = spark.createDataFrame([("0", i, float(z), None, float(i), None, None, None) for i, z in enumerate((10, 500, 1000))] + [("1", i, float(z), None, 9.0, None, None, None) for i, z in enumerate((1000, 1500))], COLUMNS)
    heads, merged, merges = stitch.stitch(profiles, levels)
    assert [r["profile_id"] for r in heads.collect()] == ["0"]
    assert [(r["altitude"], r["t"]) for r in merged.orderBy("level_idx").collect()] == [(10.0, 0.0), (500.0, 1.0), (1000.0, 2.0), (1500.0, 9.0)]
    assert [tuple(r) for r in merges.collect()] == [("0", 1)]


def one(spark, **columns):
    n = len(next(iter(columns.values())))
    get = lambda c, i: None if c not in columns or columns[c][i] is None else float(columns[c][i])
    return spark.createDataFrame([("a", i, get("z", i) if "z" in columns else 100.0 * i, get("p", i), get("t", i), get("td", i), get("dd", i), get("ff", i)) for i in range(n)], COLUMNS)


def test_limits(spark):
    rows = qc.apply_limits(one(spark, t=[149, 150, 350, 351, None], dd=[360, 361, 0, 0, 0])).orderBy("level_idx").collect()
    assert [r["t"] for r in rows] == [None, 150.0, 350.0, None, None] and [r["n_threshold"] for r in rows] == [1, 1, 0, 1, 0]
    again = qc.apply_limits(qc.apply_limits(one(spark, t=[149, 150])).drop("n_threshold"))
    assert again.agg(F.sum("n_threshold")).first()[0] == 0
    td = qc.limit_dew_point(one(spark, t=[250, 250, 250, None], td=[251, 250, None, 200])).orderBy("level_idx").collect()
    assert [r["td"] for r in td] == [None, 250.0, None, 200.0]


def test_falling_pressure(spark):
    df = one(spark, p=[100, 90, 95, 90, 92, 80, 80])
    assert [r["p_niv"] for r in qc.keep_descending(df).orderBy("level_idx").collect()] == [100.0, 90.0, 90.0, 80.0, 80.0]
    row = qc.monotonicity(df).first()
    assert row["violation_idx"] == [2, 4] and row["violation_ratio"] == pytest.approx(2 / 7) and row["violation_type"] == "dense"
    assert not qc.strictly_descending(df).first()["descending"]


def test_spikes(spark):
    rows = qc.flag_spikes(one(spark, z=[0, 50, 101, 201], t=[250, 256, 262, 263], ff=[1, 1, 10, 10], dd=[5, 5, 5, 5])).orderBy("level_idx").collect()
    assert [r["t"] for r in rows] == [250.0, 256.0, None, 263.0] and [r["ff"] for r in rows] == [1.0, 1.0, None, 10.0] and [r["dd"] for r in rows] == [5.0] * 4


@pytest.mark.parametrize(("gap", "levels", "status"), [(5, 30, "kept"), (6, 30, "pressure_gap"), (0, 20, "kept"), (0, 19, "short")])
def test_cleaning(spark, gap, levels, status):
    p = [None] * gap + [90_000 - 500 * i for i in range(levels - gap if gap else levels)]
    kept, stats = qc.clean(one(spark, p=p, t=[250] * len(p)))
    row = stats.first()
    assert row["status"] == status and row["largest_gap_pressure_removed"] == gap and row["pressure_nan"] == gap
    assert kept.count() == (len(p) - gap if status == "kept" else 0)


def test_first_at_height(spark):
    rows = qc.first_at_height(one(spark, z=[100, 100, None, None, 200], t=[1, 2, 3, 4, 5])).orderBy("level_idx").collect()
    assert [r["t"] for r in rows] == [1.0, 3.0, 5.0]


def test_coverage_bounds(spark):
    spans = lambda z: qc.coverage(one(spark, z=z), 0.0, 1000.0).first()["covered"]
    assert spans([500, 800]) and not spans([501, 900]) and not spans([0, 799.9]) and not spans([None, None])
    good, bad = qc.filter_by_coverage(one(spark, z=[500, 800]), 0.0, 1000.0)
    assert (good.count(), bad.count()) == (2, 0)


def test_height_alias_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan"))], ["geop", "altitude", "t"])
    assert height_alias(df).first()["altitude"] == 1.0
    assert without_nan(df).first()["t"] is None
    with pytest.raises(ValueError):
        height_alias(df.select("t"))


def test_season_calendar(spark):
    assert C.season_offsets([12, 1, 2]) == {12: 0, 1: 31, 2: 62} and C.season_days([12, 1, 2]) == 91
    rows = [(str(k), datetime.datetime(y, 6, 1 + b * 7 + i), c) for k, (y, b, i, c) in enumerate([
        (2020, 0, 0, 1), (2020, 0, 1, 1), (2020, 0, 2, 0), (2020, 0, 3, 0), (2021, 0, 0, 2), (2021, 0, 1, 2), (2021, 0, 2, 2), (2021, 1, 0, 1), (2021, 1, 1, 1)])]
    frame = C.with_parts(spark.createDataFrame(rows, "profile_id string, date timestamp, cluster int"))
    top = C.dominant(C.season_bins(frame, [6, 7, 8]))
    assert sorted(tuple(r) for r in top.collect()) == [(2020, 0, 0), (2021, 0, 2)]  # of a tie the smaller; a bin of two has none
    entropy = C.bin_entropy(top, 3).first()
    assert entropy["years"] == 2 and entropy["entropy"] == pytest.approx(0.6309297)
    with pytest.raises(ValueError):
        C.check_aligned(frame.filter("cluster = 1"), frame)


def test_circular_mean(spark):
    df = spark.createDataFrame([(350.0,), (10.0,)], "dd double")
    value = df.agg(A.circular_mean(F.col("dd")).alias("x")).first()["x"]
    assert min(value, 360 - value) == pytest.approx(0, abs=1e-9)


def test_whole_analysis(spark, tmp_path):
    levels = spark.createDataFrame(random_levels(3, 40), COLUMNS)
    profiles = spark.createDataFrame([("s", k, str(k), datetime.datetime(2023, 1 + k % 12, 1 + k // 12, 0)) for k in range(40)], "station string, profile_seq long, profile_id string, date timestamp")
    ready = analysis.prepare(profiles, levels, 0.0, 5000.0, 250.0, path=str(tmp_path))
    assert ready.statistics.count() == 40 and ready.resampled.select("profile_id").distinct().count() == ready.profiles.count() > 30
    fit = analysis.profile_shapes(ready, 3, ["t", "td", "u", "v"], 3, n_init=2)
    assert fit.assignments.count() == ready.profiles.count() and len(fit.centres) == 3
    told = analysis.explain(ready, fit.assignments).cache()
    assert told.count() == 4 and told.filter("cluster is null").first()["n"] == ready.profiles.count()
    pages = figures.cluster_pages(ready.resampled, fit.assignments, top=2000.0).cache()
    assert pages.filter("g_idx > 8").count() == 0 and {"t_q10", "rhi_mean", "dd"} <= set(pages.columns)
    assert figures.cluster_mean_profiles(ready.resampled, fit.assignments).count() == 3 * 21
    assert figures.scatter(fit.assignments, fit.assignments).count() == ready.profiles.count()
    table = features.diagnostics(ready.levels)
    assert figures.lapse_map(table, fit.assignments).count() == 30
    assert all(len(r["lapse_0_500_mean"].split(".")[1]) == 5 for r in figures.with_digits(told.na.fill(0.0)).select("lapse_0_500_mean").collect())
    assert {r["season"] for r in analysis.compare_seasons(ready).collect()} == {"winter", "summer", "rest"}
    assert analysis.profile_features(levels, 2, 2, n_init=1).assignments.count() > 30
    entropy, agreement = analysis.yearly_consistency(ready.profiles, fit.assignments, [6, 7, 8], 31, 1)
    assert entropy.count() == 0 and agreement.count() == 0  # one year


def test_stream_lands_what_a_batch_reads(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    path = write(source)
    recent.land_stream(spark, path, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    (source / "c.csv").write_text(RECORD.replace("89642", "70000"))
    recent.land_stream(spark, path, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    profiles, levels, _ = S.read_files(spark, path)
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out/profiles").select("station").collect()) == sorted(r["station"] for r in profiles.collect())
    assert spark.read.parquet(f"{tmp_path}/out/levels").count() == levels.count()


def test_windowed_levels(spark):
    rows = [(datetime.datetime(2023, 6, 15, h), 1.0 * h, 2.0) for h in range(30) if h < 24]
    df = spark.createDataFrame(rows, "time timestamp, t double, ff double")
    assert [tuple(r)[1:] for r in recent.windowed_levels(df, "time", "12 hours").orderBy("start").collect()] == [(12, 5.5, 2.0), (12, 17.5, 2.0)]


def test_sites_and_paths(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("name,lat,lon\nA,-66.66,140.0\nB,,10\n")
    rows = S.read_site(spark, f"file://{tmp_path}/sites.csv").collect()
    assert [tuple(r) for r in rows] == [("A", -66.66, 140.0), ("B", None, 10.0)]
    levels = spark.createDataFrame([("p", 0, 0.5, -1.0), ("p", 1, None, 2.0)], "profile_id string, level_idx long, dep_lat double, dep_lon double")
    assert [tuple(r) for r in S.trajectory(levels, 10.0, 20.0).orderBy("level_idx").collect()] == [("p", 0, 10.5, 19.0), ("p", 1, None, 22.0)]


def test_numbers_follow_the_order_over_many_partitions(spark):
    df = spark.range(500).selectExpr("concat('f', (id * 37) % 500) AS file").repartition(9)
    found = sorted((r["file"], r["n"]) for r in S.numbered(df, "file", "n").collect())
    assert [n for _, n in found] == list(range(500))
    assert S.numbered(df.limit(0), "file", "n").count() == 0
