"""Text records of profiles: files and archives to profile and level tables.

A record is a header line that starts with ``numer_sta``, its values, a line of
column names, data rows, and perhaps a second block that starts with ``p_cis``.
Lines are cut into records by running windows over each file's line numbers, so
that a file of any length needs no Python loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeframe.schema import height_alias, number
from sondeframe.sources import archives
from sondeframe.sources.storage import checkpointed

HEADER, SECOND = "numer_sta", "p_cis"
NUMBERS = ("altitude", "geop", "0", "p_niv", "t", "td", "dd", "ff", "dep_lat", "dep_lon")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no, line) of text files, each file read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return split_lines(files)


def split_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) of (file, content)."""
    return files.select("file", F.posexplode(F.split("content", "\r\n|\n|\r")).alias("line_no", "line"))


def read_archives(spark: SparkSession, path: str | list[str], station: str | None = None, days: list[str] | None = None, hours: list[int] | None = None) -> DataFrame:
    """(file, content) of the members of zip archives.

    Members are named station.yyyyMMddHH.* and end in ``archives.SUFFIX``; those
    of a station, of days (yyyyMMdd) and of hours are chosen in the archive's
    directory, before any is unpacked.  A file that is no archive gives
    nothing, a member that can't be unpacked or decoded is left out;
    ``archive_status`` tells which they are.
    """
    return archive_members(spark, path, station, days, hours).filter("status = 'read'").select("file", "content")


def archive_status(spark: SparkSession, path: str | list[str], station: str | None = None, days: list[str] | None = None, hours: list[int] | None = None) -> DataFrame:
    """(archive, file, status) of each member that ``read_archives`` is asked for.

    status is read, damaged or undecodable; an archive that can't be opened has
    one row without a file, of status no archive, where all members are asked for.
    """
    return archive_members(spark, path, station, days, hours).select("archive", "file", "status")


def archive_members(spark: SparkSession, path: str | list[str], station: str | None = None, days: list[str] | None = None, hours: list[int] | None = None) -> DataFrame:
    """The table of ``archives.SCHEMA``, with filters that its source takes over."""
    archives.register(spark)
    rows = spark.read.format(archives.FORMAT).load("\n".join([path] if isinstance(path, str) else path))
    rows = rows if station is None else rows.filter(F.col("station") == station)
    rows = rows.filter(F.col("day").isin(list(days))) if days else rows
    return rows.filter(F.col("hour").isin([int(h) for h in hours])) if hours else rows


def select_files(files: DataFrame, station: str | None = None, years: list[int] | None = None, months: list[int] | None = None,
                 dates: list[str] | None = None, hours: list[int] | None = (0, 12)) -> DataFrame:
    """Files named station.yyyyMMddHH.*: those of a station, of years and months or of dates, and of hours.

    Years and dates exclude each other; with neither nothing is selected.
    """
    if years and dates:
        raise ValueError("years and dates exclude each other")
    if not years and not dates:
        return files.limit(0)
    stamp = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"(\d{10})", 1)
    ok = F.substring(stamp, 1, 8).isin(list(dates)) if dates else (
        F.substring(stamp, 1, 4).isin([str(y) for y in years]) & F.substring(stamp, 5, 2).isin([f"{m:02d}" for m in months or range(1, 13)])
    )
    if hours:
        ok &= F.substring(stamp, 9, 2).isin([f"{h:02d}" for h in hours])
    return files.filter(ok if station is None else ok & F.col("file").contains(station))


def timestamp(text: Column) -> Column:
    """yyyyMMddHHmmss; null where it is none."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def _cells(line: str) -> Column:
    return F.split(F.trim(line), ",")


def parse(lines: DataFrame) -> DataFrame:
    """(file, record, kind, place, line) of (file, line_no, line).

    kind is header, values, columns, data, second_columns or second; place counts
    the lines of a kind.  The first header of a run may be indented; inside a
    record only an unindented header line begins the next.  Lines before the
    first record are dropped.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("_head", F.startswith(F.col("line"), F.lit(HEADER)) | (F.startswith(F.trim("line"), F.lit(HEADER)) & ~_inside(w)))
    rows = marked.withColumn("record", F.sum(F.col("_head").cast("int")).over(w)).filter("record > 0")
    own = Window.partitionBy("file", "record").orderBy("line_no")
    rows = rows.withColumn("_row", F.row_number().over(own))
    second = F.startswith(F.col("line"), F.lit(SECOND)) & (F.col("_row") > 3)
    rows = rows.withColumn("_second", F.sum(second.cast("int")).over(own))
    kind = (
        F.when(F.col("_row") == 1, "header").when(F.col("_row") == 2, "values").when(F.col("_row") == 3, "columns").when(F.col("_second") == 0, "data")
    )
    rows = rows.withColumn("_new", F.col("_second") - F.coalesce(F.lag("_second").over(own), F.lit(0)))
    kind = kind.when((F.col("_second") == 1) & (F.col("_new") == 1), "second_columns").otherwise("second")
    rows = rows.withColumn("kind", kind)
    place = F.row_number().over(Window.partitionBy("file", "record", "kind").orderBy("line_no")) - 1
    return rows.select("file", "record", "kind", place.cast("long").alias("place"), "line")


def _inside(w) -> Column:
    """Whether an unindented header line came before: then only such a line ends a record."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.startswith(F.trim("line"), F.lit(HEADER))).over(before), F.lit(False))


def _with_names(parsed: DataFrame) -> DataFrame:
    """Value rows of all kinds with their column names, without spoiled records.

    A row shorter than the names is padded with null later.  A longer row, or a
    block whose rows are all shorter, spoils its record.  All by windows over
    the partitioning by file that parsing has already.
    """
    own = Window.partitionBy("file", "record")
    first = {k: F.max(F.when((F.col("kind") == k) & (F.col("place") == 0), F.col("line"))).over(own) for k in ("header", "columns", "second_columns")}
    line = F.when(F.col("kind") == "values", first["header"]).when(F.col("kind") == "data", first["columns"]).when(F.col("kind") == "second", first["second_columns"])
    rows = parsed.withColumn("_line", line).withColumn("_names", F.split(F.trim("_line"), ","))
    n, width = F.size(_cells("line")), F.size("_names")
    spoiled = F.coalesce(F.bool_or(n > width).over(own), F.lit(False))
    for k in ("values", "data", "second"):
        spoiled |= ~F.coalesce(F.bool_or(F.when(F.col("kind") == k, n >= width)).over(own), F.lit(True))
    return rows.withColumn("_spoiled", spoiled).filter(~F.col("_spoiled") & F.col("_names").isNotNull()).withColumn("cells", _pairs())


def _pairs() -> Column:
    """A row's cells by name; of a name that occurs twice the first stays."""
    cells, names = _cells("line"), F.col("_names")
    places = F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda k: F.array_position(names, F.get(names, k)) == k + 1)
    return F.map_from_entries(F.transform(places, lambda k: F.struct(F.get(names, k).alias("key"), F.get(cells, k).alias("value"))))


def profile_id() -> Column:
    return F.concat_ws("#", "file", F.col("record").cast("string"))


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the number of each row in the order of a column, from 0.

    Rows are range-partitioned; only the partitions' sizes meet on the driver.
    They are written, because their bounds come from a sample.
    """
    ranged = checkpointed(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id()))
    total, before = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("_part").count().collect()):
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return ranged.withColumn("_at", place).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before")


def read_profiles(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, levels, cis_levels) of (file, line_no, line).

    Numbers that can't be read are null; columns of the level block that the
    level table doesn't have are left out, those of the header are in ``extra``.
    A record with a malformed block is left out.  Profiles are ordered by file
    name and place: profile_seq rises with both.
    """
    rows = _with_names(parse(lines))
    lower = F.transform_keys("cells", lambda k, v: F.lower(k))
    known = ("numer_sta", "date", "nb_niv")
    date = F.get(F.map_values(F.map_filter(lower, lambda k, v: k == "date")), 0)
    files = numbered(lines.select("file").distinct(), "file", "_file")
    profiles = rows.filter("kind = 'values' and place = 0").join(files, "file").select(
        profile_id().alias("profile_id"), ((F.col("_file") + 1) * F.lit(1 << 32) + F.col("record")).alias("profile_seq"), "file",
        F.col("cells")["numer_sta"].alias("station"), timestamp(date).alias("date"), F.col("cells")["nb_niv"].try_cast("int").alias("nb_niv"),
        F.map_filter("cells", lambda k, v: ~F.lower(k).isin(*known)).alias("extra"),
    )
    named = rows.filter("kind = 'data'").select(profile_id().alias("profile_id"), F.col("place").alias("level_idx"), *[number(F.col("cells")[c]).alias(c) for c in NUMBERS])
    levels = height_alias(named).select("profile_id", "level_idx", "altitude", "p_niv", "t", "td", "dd", "ff", "dep_lat", "dep_lon")
    cis = rows.filter("kind = 'second'").select(profile_id().alias("profile_id"), F.col("place").alias("row_idx"), F.transform_values("cells", lambda k, v: number(v)).alias("values"))
    return profiles, levels, cis


def read_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of text files."""
    return read_profiles(read_lines(spark, path))


def land(profiles: DataFrame, levels: DataFrame, path: str) -> None:
    """Write both tables as Parquet by year and month, so that a later read prunes by date."""
    parts = profiles.withColumns({"year": F.year("date"), "month": F.month("date")})
    parts.repartition("year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(f"{path}/profiles")
    dated = levels.join(parts.select("profile_id", "year", "month"), "profile_id")
    dated.repartition("year", "month", F.pmod(F.xxhash64("profile_id"), F.lit(8))).write.mode("overwrite").partitionBy("year", "month").parquet(f"{path}/levels")


def read_landed(spark: SparkSession, path: str, years: list[int] | None = None, months: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    def pruned(name: str) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        df = df.filter(F.col("year").isin(years)) if years else df
        return df.filter(F.col("month").isin(months)) if months else df

    return pruned("profiles"), pruned("levels")


def read_site(spark: SparkSession, path: str) -> DataFrame:
    """A table of sites with a header line."""
    return spark.read.csv(path, header=True, inferSchema=True)


def trajectory(levels: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """(profile_id, level_idx, lat, lon): the launch point moved by each level's offsets."""
    return levels.select("profile_id", "level_idx", (F.lit(latitude) + F.col("dep_lat")).alias("lat"), (F.lit(longitude) + F.col("dep_lon")).alias("lon"))
