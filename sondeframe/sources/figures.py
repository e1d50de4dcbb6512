"""Line figures as a sink: ``df.write.format("svg_figures")`` draws one SVG file a figure on the executors.

Rows are (figure, series, place, x, y).  Tasks write under a temporary name in the
target folder; the job's commit gives the files their names, an abort removes
them, so that a lost or repeated task leaves none under a final name.  Equal
tables give equal files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sondeframe.sources.archives import _open

FORMAT = "svg_figures"
SCHEMA = "figure string, series string, place long, x double, y double"
WIDTH, HEIGHT, MARGIN, TICKS = 480, 640, 56, 5
#: The colours of series, in turn.
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#17becf")


def svg(title: str, series: dict[str, list[tuple[float | None, float | None]]]) -> str:
    """A figure of lines; a point without x or y breaks its line."""
    points = [p for own in series.values() for p in own if p[0] is not None and p[1] is not None]

    def scale(k: int, low: float, high: float):
        least, most = min((p[k] for p in points), default=0.0), max((p[k] for p in points), default=1.0)
        span = most - least or 1.0
        return least, span, lambda v: low + (v - least) / span * (high - low)

    x0, xs, at_x = scale(0, MARGIN, WIDTH - MARGIN / 2)
    y0, ys, at_y = scale(1, HEIGHT - MARGIN, MARGIN / 2)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11">',
           f'<title>{escape(title)}</title><rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>']
    for k in range(TICKS):
        x, y = x0 + xs * k / (TICKS - 1), y0 + ys * k / (TICKS - 1)
        out.append(f'<text x="{at_x(x):.1f}" y="{HEIGHT - MARGIN + 16}" text-anchor="middle">{x:.4g}</text><text x="{MARGIN - 6}" y="{at_y(y) + 4:.1f}" text-anchor="end">{y:.4g}</text>')
        out.append(f'<path d="M{at_x(x):.1f} {MARGIN / 2:.1f}V{HEIGHT - MARGIN}M{MARGIN} {at_y(y):.1f}H{WIDTH - MARGIN / 2:.1f}" stroke="#ddd" fill="none"/>')
    for k, (name, own) in enumerate(series.items()):
        colour = COLOURS[k % len(COLOURS)]
        for there, run in groupby(own, key=lambda p: p[0] is not None and p[1] is not None):
            if there:
                out.append(f'<polyline points="{" ".join(f"{at_x(x):.1f},{at_y(y):.1f}" for x, y in run)}" stroke="{colour}" fill="none" stroke-width="1.5"/>')
        out.append(f'<text x="{MARGIN + 8}" y="{MARGIN / 2 + 14 * (k + 1):.1f}" fill="{colour}">{escape(name)}</text>')
    return "\n".join([*out, "</svg>", ""])


def file_name(figure: str) -> str:
    """A file's name: other characters than letters, digits, dots and lines become their code."""
    return re.sub(r"[^A-Za-z0-9._-]", lambda m: f"%{ord(m[0]):x}", figure) + ".svg"


@dataclass
class Drawn(WriterCommitMessage):
    names: list[str]
    folder: str


class FigureWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, root = _open(self.path)
        return store, root.rstrip("/")

    def write(self, rows: Iterator) -> Drawn:
        """Rows of a figure follow each other; one figure is held at a time."""
        store, root = self._store()
        folder = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        names = []
        for figure, own in groupby(rows, key=lambda r: r["figure"]):
            series: dict[str, list] = {}
            for r in own:
                series.setdefault(r["series"] or "", []).append((r["x"], r["y"]))
            name = file_name(figure or "")
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(svg(figure or "", series).encode())
            names.append(name)
        return Drawn(names, folder)

    def commit(self, messages: list[Drawn | None]) -> None:
        store, root = self._store()
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Drawn | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        left = f"{root}/_temporary-{self.job}"
        if store.get_file_info(left).type == fs.FileType.Directory:
            store.delete_dir(left)


class FigureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FigureWriter:
        return FigureWriter(self.options["path"])


def draw(lines: DataFrame, path: str) -> None:
    """Draw the figures of a table (figure, series, place, x, y) into a folder; a figure of the same name is replaced."""
    spark = lines.sparkSession
    spark.dataSource.register(FigureSink)
    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")]
    lines.select(*columns).repartition("figure").sortWithinPartitions("figure", "series", "place").write.format(FORMAT).mode("append").save(path)


def profile_lines(levels: DataFrame, variables: list[str]) -> DataFrame:
    """A figure a profile: its variables over height."""
    pairs = F.array(*[F.struct(F.lit(v).alias("series"), F.col(v).cast("double").alias("x")) for v in variables])
    return levels.filter("altitude is not null").select(F.col("profile_id").cast("string").alias("figure"), F.col("altitude").alias("y"), "level_idx", F.explode(pairs).alias("p")).select(
        "figure", "p.series", F.row_number().over(Window.partitionBy("figure", "p.series").orderBy("y", "level_idx")).alias("place"), "p.x", "y")


def cluster_lines(profiles: DataFrame, variable: str, by: str = "cluster") -> DataFrame:
    """A figure of a cluster's mean profile: (cluster, altitude, variable) rows of ``mean_profile`` by cluster."""
    return profiles.select(F.concat(F.lit("cluster-"), F.col(by).cast("string")).alias("figure"), F.lit(variable).alias("series"), F.col("altitude").cast("long").alias("place"), F.col(variable).alias("x"), F.col("altitude").alias("y"))
