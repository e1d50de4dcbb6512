"""Zip archives of text records as a data source: ``spark.read.format("sounding_archive")``.

Partitions are planned from the archives' central directories, which lie at
their ends and name the members; a filter on station, day or hour drops members
there.  A task opens its archive by ranged reads and unpacks one member at a
time, so that neither an archive nor a partition is ever held whole.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "sounding_archive"
SUFFIX = ".HR.csv"
SCHEMA = "archive string, file string, station string, day string, hour int, content string, status string"
#: Unpacked bytes and members of a partition.
PARTITION_BYTES = 64 << 20
PARTITION_MEMBERS = 2048


@dataclass(frozen=True)
class Member:
    """A member's name and what it says: station.yyyyMMddHH.*"""

    name: str
    size: int

    @property
    def station(self) -> str:
        return posixpath.basename(self.name).split(".")[0]

    @property
    def stamp(self) -> str:
        found = re.search(r"\.(\d{8})(\d{2})?", posixpath.basename(self.name))
        return found.group(1) + (found.group(2) or "") if found else ""

    @property
    def day(self) -> str | None:
        return self.stamp[:8] or None

    @property
    def hour(self) -> int | None:
        return int(self.stamp[8:]) if len(self.stamp) == 10 else None


@dataclass
class Archive(InputPartition):
    """Members of one archive that a task reads; without any, the archive can't be opened."""

    path: str
    members: tuple[Member, ...]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", re.sub(r"^s3a://", "s3://", path)))


def _name(store: fs.FileSystem, path: str) -> str:
    return f"file:{path}" if store.type_name == "local" else f"{store.type_name}://{path}"


def listed(paths: list[str]) -> Iterator[tuple[str, fs.FileSystem, str]]:
    """(name, file system, path) of the files that paths, folders and patterns name, in order."""
    for path in paths:
        store, at = _open(path)
        if "*" in at or "?" in at:
            folder = posixpath.dirname(at)
            own = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, at))
        elif store.get_file_info(at).type == fs.FileType.Directory:
            own = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File)
        else:
            own = [at]
        for file in own:
            if not posixpath.basename(file).startswith((".", "_")):
                yield _name(store, file), store, file


class ArchiveReader(DataSourceReader):
    """Plans and reads; ``wanted`` holds the values that pushed filters allow."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("path", "").split("\n") if p]
        self.suffix = options.get("suffix", SUFFIX)
        self.wanted: dict[str, set] = {}
        if not self.paths:
            raise ValueError("a path is needed")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and lists on station, day and hour choose members by name; nothing of them is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("station",), ("day",), ("hour",)):
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def _takes(self, member: Member) -> bool:
        return member.name.endswith(self.suffix) and all(getattr(member, name) in values for name, values in self.wanted.items())

    def partitions(self) -> list[Archive]:
        out = []
        for _, store, path in listed(self.paths):
            uri = path if store.type_name == "local" else f"{store.type_name}://{path}"
            try:
                with store.open_input_file(path) as handle, zipfile.ZipFile(handle) as archive:
                    members = [m for m in (Member(i.filename, i.file_size) for i in archive.infolist()) if self._takes(m)]
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # a file shorter than a directory can be sought in nowhere
                if not self.wanted:
                    out.append(Archive(uri, ()))
                continue
            part, size = [], 0
            for m in members:
                if part and (size + m.size > PARTITION_BYTES or len(part) >= PARTITION_MEMBERS):
                    out.append(Archive(uri, tuple(part)))
                    part, size = [], 0
                part.append(m)
                size += m.size
            if part:
                out.append(Archive(uri, tuple(part)))
        return out

    def read(self, partition: Archive) -> Iterator[tuple]:
        store, path = _open(partition.path)
        name = _name(store, path)
        if not partition.members:
            yield name, None, None, None, None, None, "no archive"
            return
        with store.open_input_file(path) as handle, zipfile.ZipFile(handle) as archive:
            for m in partition.members:
                content, status = None, "read"
                try:
                    content = archive.read(m.name).decode("utf-8")
                except UnicodeDecodeError:
                    status = "undecodable"
                except (zipfile.BadZipFile, zlib.error):
                    status = "damaged"
                yield name, m.name, m.station, m.day, m.hour, content, status


class ArchiveSource(DataSource):
    """Options: path (several parted by a line break; folders and * patterns too), suffix of the members' names."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
