"""Deterministic sharded WARC writer, and a reader.

Records are put in the order of their keys and cut into shards of about equal
payload by a running sum over that order; each shard is sorted and written as
a run of gzip files that roll at a compressed size.  Tasks write under
temporary names; when all have ended a second pass gives the files of the
winning attempts their names, and the manifest is written last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeframe.llm.common import materialise, shuffle_partitions

SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
#: Shards grow beyond ``shard_bytes`` rather than be more than these, so that their bounds stay a broadcast of a few MB.
MAX_SHARDS = 1 << 16
#: What a record weighs beside its payload.
HEAD_BYTES = 512
#: Payload bytes of a batch that the reader gives on.
READ_BYTES = 8 << 20
DECISION, RECORD = 0, 1
#: Every record has this date, so that equal tables give equal files.
DATE = "2000-01-01T00:00:00Z"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI; Hadoop's names of S3 are read as S3."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri("s3" + colon + rest if scheme in ("s3a", "s3n") else folder)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_response: bool) -> bytes:
    """One WARC/1.1 record with regenerated headers and digests.

    A revisit has the headers of its response and no payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if is_response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if not is_response:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += [
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(content: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The gzip members of a file, one at a time.

    Input goes in by small steps: what a member leaves over is copied, and so
    must not be the rest of the file.
    """
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(parts)


def _records(text: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(text):
        stop = text.index(b"\r\n\r\n", at)
        lines = text[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        begin, n = stop + 4, int(headers["Content-Length"])
        yield headers, text[begin : begin + n]
        at = begin + n + 4


_FILES = "shard int, part int, temporary string, bytes long, records long, sha256 string"


def _write(folder: str, roll: int):
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        out, name, shard, part, size, n, digest = None, "", None, 0, 0, 0, hashlib.sha256()
        done = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, part, name, size, n, digest.hexdigest()))
                out = None

        revisit: tuple | None = None  # id, digest and response of the revisits that come next
        for batch in batches:  # of bounded bytes; payloads become Python objects one at a time
            payloads = batch.column("payload")
            small = [batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "url", "refers_to")]
            for k, (to, page, key, kind, url, refers_to) in enumerate(zip(*small, strict=True)):
                if kind == DECISION:
                    revisit = (page, key, refers_to)
                    continue
                refers = revisit[2] if revisit and revisit[:2] == (page, key) else None
                if to != shard or size >= roll:
                    close()
                    part = part + 1 if to == shard else 0
                    shard, size, n, digest = to, 0, 0, hashlib.sha256()
                    name = f"{shard:06d}-{part:05d}.{uuid.uuid4().hex}.tmp"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(page, url, payloads[k].as_py(), refers, refers is None), 6, mtime=0)
                out.write(member)
                digest.update(member)
                size, n = size + len(member), n + 1
        close()
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                name = f"{row['shard']:06d}-{row['part']:05d}.warc.gz"
                source = f"{root}/{row['temporary']}"
                if store.get_file_info(source).type != fs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(source, f"{root}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), batch.column("bytes"), batch.column("records"), batch.column("sha256")], names=["name", "bytes", "records", "sha256"]
            )

    return run


def _keys(known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(known, id, hash) as byte strings that sort alike."""
    out = np.zeros((len(ids), 17), dtype=np.uint8)
    out[:, 0] = known
    sign = np.uint64(1 << 63)
    for at, column in ((1, ids), (9, hashes)):
        out[:, at : at + 8] = (column.astype(np.int64).view(np.uint64) ^ sign).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _begins(offsets: dict[int, int], size: int):
    """Of rows in order: the first of each shard (and of each partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if total is None:
                total = offsets[batch.column("at")[0].as_py()]
            weights = batch.column("weight").to_numpy()
            ends = total + np.cumsum(weights)
            total = int(ends[-1])
            shards = (ends - weights) // size
            new = np.flatnonzero(np.diff(shards, prepend=-1 if last is None else last))
            last = int(shards[-1])
            yield pa.RecordBatch.from_arrays([pa.array(shards[new]), batch.column("page_id").take(pa.array(new)), batch.column("h").take(pa.array(new))], names=["shard", "page_id", "h"])

    return run


def _shard_of(slim: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """Shard number of a record by its key, and the number of shards.

    Keys (id, hash) are range-sorted without their payloads; the sums of the
    partitions and a running sum within each give every record's place in bytes.
    A shard begins where that place passes a multiple of its size, so the bounds
    follow from the rows alone and a second run cuts alike.  One pass, whatever
    the number of shards.
    """
    order = (F.col("page_id").asc_nulls_first(), F.col("h").asc())
    ranged = materialise(slim.select("page_id", "h", "weight").repartitionByRange(shuffle_partitions(slim.sparkSession), *order).sortWithinPartitions(*order))
    placed = ranged.withColumn("at", F.spark_partition_id())
    sums = sorted(tuple(r) for r in placed.groupBy("at").agg(F.sum("weight")).collect())  # a row a partition
    total, offsets = 0, {}
    for at, n in sums:
        offsets[at] = total
        total += n
    size = max(shard_bytes, -(-total // MAX_SHARDS))
    if total <= size:
        return F.lit(0), 1
    begins = placed.mapInArrow(_begins(offsets, size), "shard long, page_id long, h long").toArrow()  # MAX_SHARDS and a row a partition at most
    rows = sorted((s, p is not None, p or 0, h) for s, p, h in zip(*(begins[c].to_pylist() for c in ("shard", "page_id", "h")), strict=True))
    firsts = [b for a, b in zip([None, *rows], rows, strict=False) if a is None or a[0] != b[0]][1:]
    bounds = slim.sparkSession.sparkContext.broadcast(np.unique(_keys(*(np.array([f[k] for f in firsts]) for k in (1, 2, 3)))))

    @F.pandas_udf("int")
    def shard(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        keys = _keys(known.to_numpy(), ids.to_numpy(), hashes.to_numpy())
        return pd.Series(np.searchsorted(bounds.value, keys, side="right").astype(np.int32))

    return shard(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.col("h")), len(bounds.value) + 1


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for each row into ``folder`` (a URI all executors see); the manifest's rows.

    The payload is the html in UTF-8, null as empty.  Of equal payloads of at
    least ``least_bytes`` bytes the record with the largest id is the response
    and the others revisit it; rows repeated with that id are responses too.  A
    null id comes first and never is a response for others, unless all of the
    group are null: then all are responses.  Files hold one shard's records in
    the order of (id, hash of payload and url).  The number of jobs is the same
    for any size; a shard is about ``shard_bytes`` of payload, or what makes
    MAX_SHARDS of them.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    records = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(html, "UTF-8").alias("payload"))
    records = records.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("h", F.xxhash64("digest", "url"))
    # what decides places and revisits: a few dozen bytes a record
    slim = materialise(records.select("page_id", "digest", "h", F.octet_length("payload").cast("long").alias("n"), (F.octet_length("payload") + F.lit(HEAD_BYTES)).cast("long").alias("weight")))
    shard, n_shards = _shard_of(slim, shard_bytes)
    wanted = slim.filter(F.col("n") >= least_bytes)
    groups = wanted.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    # a revisit's decision goes to its record's place and comes before it, so that payloads move once
    none = {n: F.lit(None).cast(t) for n, t in (("url", "string"), ("payload", "binary"), ("refers_to", "long"))}
    decisions = (
        wanted.select("page_id", "digest", "h").join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(shard.alias("shard"), "page_id", "h", "digest", F.lit(DECISION).alias("kind"), none["url"].alias("url"), none["payload"].alias("payload"), "refers_to")
    )
    bodies = records.select(shard.alias("shard"), "page_id", "h", "digest", F.lit(RECORD).alias("kind"), "url", "payload", none["refers_to"].alias("refers_to"))
    placed = bodies.unionByName(decisions).repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "h", "digest", "kind", "url")
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    written = materialise(placed.mapInArrow(_write(folder, roll_bytes), _FILES))
    manifest = materialise(written.mapInArrow(_rename(folder), "name string, bytes long, records long, sha256 string"))
    for info in store.get_file_info(fs.FileSelector(root)):  # what lost attempts left: the winners' files have their names
        if info.base_name.endswith(".tmp"):
            store.delete_file(info.path)
    with store.open_output_stream(f"{root}/manifest.tmp", compression=None) as out:
        for row in manifest.coalesce(1).sortWithinPartitions("name").toLocalIterator():  # a row a file
            out.write(json.dumps(row.asDict(), sort_keys=True).encode() + b"\n")
    store.move(f"{root}/manifest.tmp", f"{root}/manifest.jsonl")
    return manifest


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_READ)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)

    for batch in batches:
        for content in batch.column("content"):
            for headers, block in (x for member in members(content.as_py()) for x in _records(member)):
                if "sha1:" + base32_sha1(block) != headers["WARC-Block-Digest"]:
                    raise ValueError(f"block digest of {headers['WARC-Record-ID']} differs")
                http, payload = block.split(b"\r\n\r\n", 1)
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"payload digest of {headers['WARC-Record-ID']} differs")
                size = int(http.decode().rpartition("Content-Length: ")[2])
                page, refers = (headers.get(h, "").removeprefix("<urn:page:").rstrip(">") for h in ("WARC-Record-ID", "WARC-Refers-To"))
                rows.append((int(page) if page else None, headers.get("WARC-Target-URI"), size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                held += len(block)
                if held >= READ_BYTES:
                    yield packed()
                    rows, held = [], 0
    yield packed()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the folder's archives; digests are checked.

    A file is read whole, which its roll size bounds.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
